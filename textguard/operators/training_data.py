"""Labelled prompts: filtering, capping, balancing, interleaving, splitting, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators.ranking import grouped_rank
from textguard.sources.shared import cut

BENIGN, JAILBREAK = 0, 1
BENIGN_CAP = 600
EVAL_PERCENT = 20
#: The length that examples may be cut to where a caller asks for it.
MAX_TOKENS = 128


def drop_empty(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.filter(F.col(text).isNotNull() & (F.col(text) != ""))


def with_label(rows: DataFrame, label: int | Column) -> DataFrame:
    value = F.lit(label) if isinstance(label, int) else label
    return rows.withColumn("label", value.cast("int"))


def first_rows(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by key. The cap is a setting of the corpus, not a sample."""
    ranked = grouped_rank(rows, [], [key])
    return ranked.filter(F.col("rn") <= n).drop("rn")


def balance(rows: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """Keeps the first rows of each class, as many as the smaller class has; adds ``rn``.

    A class without rows leaves none of the other.
    """
    smallest = rows.agg(
        F.least(
            F.count_if(F.col(label) == JAILBREAK), F.count_if(F.col(label) == BENIGN)
        ).alias("n")
    )
    ranked = grouped_rank(rows, [label], [key])
    return ranked.filter(F.col("rn") <= smallest.scalar())


def interleave(balanced: DataFrame, label: str = "label") -> DataFrame:
    """Adds 0-based ``position``: hostile, benign, hostile, benign, …"""
    return balanced.withColumn(
        "position", 2 * F.col("rn") - 1 - F.col(label).cast("bigint")
    )


def stratified_split(
    rows: DataFrame,
    key: str = "doc_id",
    label: str = "label",
    eval_percent: int = EVAL_PERCENT,
    seed: int = 42,
) -> DataFrame:
    """Adds ``is_eval``. Eval rows number ``eval_percent`` of all, rounded up, and each
    class gets its share: whole part first, then by largest remainder."""
    totals = rows.groupBy(label).agg(F.count("*").alias("n"))
    everything = totals.agg(F.sum("n").alias("n"))
    quota = totals.withColumn("_all", everything.scalar()).select(
        label,
        "n",
        "_all",
        F.expr(f"(_all * {eval_percent} + 99) div 100").alias("_eval"),
    ).select(
        label,
        "_eval",
        F.expr("(n * _eval) div _all").alias("_whole"),
        F.expr("(n * _eval) % _all").alias("_rest"),
    )
    # classes are few; their quotas fit one row
    listed = quota.agg(
        (F.max("_eval") - F.sum("_whole")).alias("spare"),
        F.array_sort(
            F.collect_list(
                F.struct((-F.col("_rest")).alias("rest"), F.col(label).alias("label"), "_whole")
            )
        ).alias("classes"),
    ).select(
        F.map_from_entries(
            F.transform(
                "classes",
                lambda c, i: F.struct(
                    c["label"],
                    c["_whole"] + F.when(i < F.col("spare"), 1).otherwise(0),
                ),
            )
        ).alias("quota")
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)).cast("binary"))
    hashed = rows.withColumn("_digest", digest)
    ranked = grouped_rank(hashed, [label], ["_digest", key], "_place")
    return ranked.withColumn(
        "is_eval",
        F.col("_place") <= F.element_at(listed.scalar(), F.col(label)),
    ).drop("_place", "_digest")


def tokens(text: Column, max_tokens: int | None = None) -> Column:
    """Lower-case word tokens, cut to ``max_tokens`` when given."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))
    return found if max_tokens is None else F.slice(found, 1, max_tokens)


def tokenise(
    rows: DataFrame, text: str = "text", max_tokens: int | None = None
) -> DataFrame:
    """Replaces the text with its tokens."""
    return rows.withColumn("tokens", tokens(F.col(text), max_tokens)).drop(text)


def prepare(
    hostile: DataFrame,
    benign: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    benign_cap: int | None = BENIGN_CAP,
    seed: int = 42,
) -> DataFrame:
    """The whole preparation: ``(key, text, label, position, is_eval)``.

    Texts are read once to drop the empty ones and once for the rows that stay. All
    counting and ranking in between runs on a written table of keys and labels.
    """
    bad = with_label(drop_empty(hostile, text), JAILBREAK)
    good = with_label(drop_empty(benign, text), BENIGN)
    keys = cut(bad.select(key, "label").unionByName(good.select(key, "label")))
    if benign_cap is not None:
        capped = first_rows(keys.filter(F.col("label") == BENIGN), benign_cap, key)
        keys = keys.filter(F.col("label") == JAILBREAK).unionByName(capped.select(key, "label"))
    chosen = cut(interleave(balance(keys, key)).drop("rn"))
    placed = stratified_split(chosen, key, seed=seed)
    texts = bad.select(key, "label", text).unionByName(good.select(key, "label", text))
    return placed.join(texts, [key, "label"]).select(
        key, text, "label", "position", "is_eval"
    )
