"""Decision rules over class probabilities, and the word-list scorer."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
SCORING_THRESHOLD = 0.82
TRAINING_THRESHOLD = 0.9
GATE_THRESHOLD = 0.82
REFUSAL = (
    "  [SYSTEM]: As the AI, I must refuse to provide instructions or guidance on topics "
    "that could lead to physical harm or break the law."
)
# --------------------------------------------------------------------------


def by_threshold(p1: Column, threshold: float = SCORING_THRESHOLD) -> Column:
    return F.when(p1 >= threshold, "JAILBREAK").when(p1.isNotNull(), "BENIGN")


def gate_score(p0: Column, p1: Column, any_class: bool = False) -> Column:
    """Score the gate compares: the top class's whichever it is, or the hostile class's."""
    return F.greatest(p0, p1) if any_class else p1


def gate_blocks(p0: Column, p1: Column, any_class: bool = False) -> Column:
    """Strictly above the threshold. With ``any_class`` a confident BENIGN blocks too."""
    return gate_score(p0, p1, any_class) > GATE_THRESHOLD


def refusal(decision: Column) -> Column:
    return F.when(decision == "JAILBREAK", F.lit(REFUSAL))


def arg_max(scores: Column) -> Column:
    """Index of the largest score, the lowest index on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def listed_word_hits(text: Column, words: list[str]) -> Column:
    listed = "|".join(re.escape(word) for word in sorted(words))
    return F.regexp_count(
        F.lower(text), F.lit(f"(?<![\\p{{L}}\\p{{N}}])(?:{listed})(?![\\p{{L}}\\p{{N}}])")
    )


def halving_score(hits: Column) -> Column:
    """Hostile-class score of a word list: every hit halves what is left to certainty."""
    return F.lit(1.0) - F.pow(F.lit(0.5), hits)
