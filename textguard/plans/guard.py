"""The seven-step guard as one plan over a message table or stream.

obfuscation -> translation -> hostile-prompt gate -> redaction -> reply -> redaction of
the reply -> translation back. A blocked message leaves the later steps by carrying NULL
into them: the plan is a single pass with no split, so nothing upstream is computed twice
and the same plan runs on a stream. The only exchanges are those of the look-up joins, and
only when the looked-up table is too large to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions import decisions as D
from textguard.functions import primitives as P
from textguard.functions import redact as R
from textguard.operators import answers as AN
from textguard.operators import translation as TR
from textguard.operators.language import detect_language
from textguard.operators.obfuscation import detect_obfuscation
from textguard.operators.replies import NO_REPLY, attach_replies
from textguard.operators.spans import Masking

BLOCKED_OBFUSCATION = "BLOCKED_OBFUSCATION"
BLOCKED_JAILBREAK = "BLOCKED_JAILBREAK"
PASSED = "PASSED"
ERROR = "ERROR"

# --- fixed values ---------------------------------------------------------
# Step keys and the texts a user reads after each step.
STEPS = (
    "obfuscation",
    "translation",
    "jailbreak",
    "pii1",
    "llm",
    "pii2",
    "translate_back",
    "final_output",
)
OBFUSCATION_BLOCK = "🚩 BLOCKED: Obfuscation detected. Reasons: "
OBFUSCATION_PASS = "✅ PASSED: No obfuscation detected"
TRANSLATED = "🔄 Text translated from {} to English"
NOT_TRANSLATED = "✅ Text is already in English or translation not needed"
JAILBREAK_BLOCK = "🚩 BLOCKED: Jailbreak detected (Score: {})"
JAILBREAK_PASS = "✅ PASSED: No jailbreak detected (Score: {})"
PII_FOUND = "🔄 PII detected and redacted\n📝 Text after PII redaction: '{}'"
PII_NONE = "✅ No PII detected"
REPLY = "📝 LLM Response: '{}'"
REPLY_PII_FOUND = (
    "🔄 PII detected and redacted in LLM response\n📝 Text after final PII redaction: '{}'"
)
REPLY_PII_NONE = "✅ No PII detected in LLM response"
BACK = "🌐 Translating back to {}\n📝 Final translated output: '{}'"
NO_BACK = "✅ No translation back needed"
FLAGGED_OUTPUT = "🛑 Final Output: Sorry, flagged "
FINAL_OUTPUT = "🏁 Final Output: '{}'"
ERROR_OUTPUT = "An error occurred:\n{}"
# --------------------------------------------------------------------------

Scorer = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class GuardTables:
    """What the guard looks things up in.

    ``large`` says that memory and replies are beyond a broadcast: a table of messages is then
    shuffled once for all look-ups (:mod:`textguard.operators.answers`). A stream, which cannot be
    joined to itself, has its look-ups one by one.
    """

    memory: DataFrame
    replies: DataFrame
    language_lookup: DataFrame
    unique_memory: bool = False
    unique_replies: bool = False
    large: bool = False


def _fill(template: str, *values: Column) -> Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def check_obfuscation(messages: DataFrame, reversed_rule: bool = True) -> DataFrame:
    """Adds ``report`` and sets ``verdict`` for blocked and for unusable rows."""
    return detect_obfuscation(messages, "text", reversed_rule).withColumn(
        "verdict",
        F.when(F.col("text").isNull(), ERROR).when(
            F.col("report.should_flag"), BLOCKED_OBFUSCATION
        ),
    )


def _open(column: str) -> Column:
    return F.when(F.col("verdict").isNull(), F.col(column))


def translate(messages: DataFrame, tables: GuardTables) -> DataFrame:
    """Adds ``lang``, ``current_text`` and ``stored_lang``; NULL on closed rows."""
    spoken = detect_language(messages, tables.language_lookup, _open("text"))
    if AN.TRANSLATIONS in messages.columns:
        found = TR.as_translation(
            spoken.withColumn("_translated", AN.translation_of(F.col("lang"), F.col("text"))), spoken.columns
        )
    else:
        found = TR.translate_to_english(
            spoken, tables.memory, unique_memory=tables.unique_memory
        )
    return TR.adopt_translation(found).withColumn(
        "current_text", _open("current_text")
    ).drop("translation")


def gate(messages: DataFrame, scorer: Scorer, any_class: bool = False) -> DataFrame:
    """Adds ``score`` and blocks rows above the threshold; a missing score is an error."""
    scored = scorer(messages, "current_text")
    kept = [F.col(f"`{c}`") for c in messages.columns if c != "verdict"]
    score = F.when(
        F.col("verdict").isNull(), D.gate_score(F.col("p0"), F.col("p1"), any_class)
    )
    judged = scored.select(
        *kept, F.col("verdict").alias("_before"), P.settled(score=score)
    )
    verdict = F.when(F.col("score").isNull(), ERROR).when(
        F.col("score") > D.GATE_THRESHOLD, BLOCKED_JAILBREAK
    )
    return judged.withColumn("verdict", F.coalesce("_before", verdict)).drop("_before")


def _redact(messages: DataFrame, text: str, out: str, masking: Masking | None) -> DataFrame:
    """Adds the masked text of open rows; rows that a tagger fails on become errors."""
    if masking is None:
        return messages.withColumn(
            out, F.when(F.col("verdict").isNull(), R.mask_pii(F.col(text)))
        )
    opened = messages.withColumn("_open_text", _open(text))
    done = masking.apply(opened, "_open_text", out, "_failed").drop("_open_text")
    failed = F.col("_failed").isNotNull()
    return done.withColumns(
        {
            "verdict": F.when(failed, ERROR).otherwise(F.col("verdict")),
            "redaction_error": F.coalesce("redaction_error", "_failed"),
        }
    ).drop("_failed")


def answer(
    messages: DataFrame, tables: GuardTables, masking: Masking | None = None
) -> DataFrame:
    """Redacts the prompt, attaches the reply, redacts it and translates it back."""
    if masking is not None:
        messages = messages.withColumn("redaction_error", F.lit(None).cast("string"))
    prompt = _redact(messages, "current_text", "prompt", masking)
    answered = AN.REPLY in messages.columns
    if answered:
        replied = prompt.withColumn("reply", F.coalesce(AN.REPLY, F.lit(NO_REPLY)))
    else:
        replied = attach_replies(prompt, tables.replies, unique=tables.unique_replies)
    masked = _redact(
        replied.withColumn("reply", _open("reply")), "reply", "safe_reply", masking
    )
    if answered and masking is None:
        back = AN.way_back(F.col("stored_lang"))
        return masked.withColumn("final_text", F.coalesce(F.when(_open("safe_reply").isNotNull(), back), "safe_reply"))
    return TR.translate_back(
        masked,
        tables.memory,
        text="safe_reply",
        out="final_text",
        unique_memory=tables.unique_memory,
    )


def _entry(step: str, status: Column, message: Column) -> Column:
    return F.struct(
        F.lit(step).alias("step"), status.alias("status"), message.alias("message")
    )


def step_log() -> Column:
    """ARRAY<STRUCT<step, status, message>> of the steps a row went through."""
    verdict, score = F.col("verdict"), F.format_string("%.4f", F.col("score"))
    by_obfuscation = verdict == BLOCKED_OBFUSCATION
    by_gate = verdict == BLOCKED_JAILBREAK
    failed = verdict == ERROR
    unread = F.col("text").isNull()
    past_check = ~by_obfuscation & ~unread
    score_known = F.col("score").isNotNull()
    passed = verdict == PASSED
    translated = F.col("stored_lang").isNotNull()
    masked_in = F.col("prompt") != F.col("current_text")
    masked_out = F.col("safe_reply") != F.col("reply")
    reasons = F.array_join("report.flag_reasons", ", ")
    return F.array_compact(
        F.array(
            F.when(
                ~unread,
                _entry(
                    "obfuscation",
                    F.when(by_obfuscation, "BLOCKED").otherwise("PASSED"),
                    F.when(by_obfuscation, _fill(OBFUSCATION_BLOCK + "{}", reasons)).otherwise(
                        OBFUSCATION_PASS
                    ),
                ),
            ),
            F.when(
                past_check,
                _entry(
                    "translation",
                    F.when(translated, "CHANGED").otherwise("PASSED"),
                    F.when(translated, _fill(TRANSLATED, F.col("stored_lang"))).otherwise(
                        NOT_TRANSLATED
                    ),
                ),
            ),
            F.when(
                past_check & score_known,
                _entry(
                    "jailbreak",
                    F.when(by_gate, "BLOCKED").otherwise("PASSED"),
                    F.when(by_gate, _fill(JAILBREAK_BLOCK, score)).otherwise(
                        _fill(JAILBREAK_PASS, score)
                    ),
                ),
            ),
            F.when(
                passed,
                _entry(
                    "pii1",
                    F.when(masked_in, "CHANGED").otherwise("PASSED"),
                    F.when(masked_in, _fill(PII_FOUND, F.col("prompt"))).otherwise(PII_NONE),
                ),
            ),
            F.when(passed, _entry("llm", F.lit("PASSED"), _fill(REPLY, F.col("reply")))),
            F.when(
                passed,
                _entry(
                    "pii2",
                    F.when(masked_out, "CHANGED").otherwise("PASSED"),
                    F.when(masked_out, _fill(REPLY_PII_FOUND, F.col("safe_reply"))).otherwise(
                        REPLY_PII_NONE
                    ),
                ),
            ),
            F.when(
                passed,
                _entry(
                    "translate_back",
                    F.when(translated, "CHANGED").otherwise("PASSED"),
                    F.when(
                        translated, _fill(BACK, F.col("stored_lang"), F.col("final_text"))
                    ).otherwise(NO_BACK),
                ),
            ),
            _entry(
                "final_output",
                F.when(passed, "PASSED").when(failed, "ERROR").otherwise("BLOCKED"),
                F.col("final_output"),
            ),
        )
    )


def conclude(messages: DataFrame, log: bool = True) -> DataFrame:
    """Settles ``verdict``, ``final_output`` and ``error``, and writes the step log."""
    settled = messages.withColumn("verdict", F.coalesce("verdict", F.lit(PASSED)))
    failed = F.col("verdict") == ERROR
    error = F.when(F.col("text").isNull(), "message has no text")
    if "redaction_error" in messages.columns:
        problem = F.col("redaction_error")
        error = error.when(problem.isNotNull(), F.concat(F.lit("redaction failed: "), problem))
    error = F.when(failed, error.otherwise("classifier gave no score"))
    told = settled.withColumn("error", error).withColumn(
        "final_output",
        F.when(F.col("verdict") == PASSED, _fill(FINAL_OUTPUT, F.col("final_text")))
        .when(failed, _fill(ERROR_OUTPUT, F.col("error")))
        .otherwise(FLAGGED_OUTPUT),
    )
    told = told.withColumn("step_log", step_log()) if log else told
    return told.drop("redaction_error")


def guard(
    messages: DataFrame,
    tables: GuardTables,
    scorer: Scorer,
    any_class: bool = False,
    reversed_rule: bool = True,
    log: bool = True,
    masking: Masking | None = None,
) -> DataFrame:
    """Runs all steps over ``messages(msg_id, text, …)``.

    Adds ``report, verdict, lang, current_text, stored_lang, score, prompt, reply,
    safe_reply, final_text, error, final_output`` and, with ``log``, ``step_log``.
    ``any_class=True`` and ``reversed_rule=True`` are the rules as first written;
    ``any_class=False`` makes the gate look at the hostile class only. ``masking`` adds names
    and a tagger to the patterns, at both redactions; a message that the tagger fails on gets the
    verdict ``ERROR``. Names are met by joins and windows, so that they are not for a stream.
    """
    plan = messages
    if tables.large and not messages.isStreaming:
        plan = AN.with_answers(
            messages,
            tables.memory,
            tables.replies,
            unique_memory=tables.unique_memory,
            unique_replies=tables.unique_replies,
            backs=masking is None,
        )
    plan = check_obfuscation(plan, reversed_rule)
    plan = translate(plan, tables)
    plan = gate(plan, scorer, any_class)
    plan = answer(plan, tables, masking)
    return conclude(plan.drop(AN.REPLY, AN.TRANSLATIONS, AN.BACKS), log)


def verdict_summary(guarded: DataFrame, by: str = "source") -> DataFrame:
    """Messages per ``by`` and verdict, with subtotals and a grand total."""
    return guarded.rollup(by, "verdict").agg(F.count("*").alias("n"))
