"""Obfuscation report over a table or stream of messages.

Everything is one chain of row-wise projections: no shuffle, so it runs at scan
speed on any number of partitions and works unchanged on a stream. Each layer
binds what the next one uses more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.functions import charsets as C
from textguard.functions import primitives as P
from textguard.functions import words as WD
from textguard.functions.whole_text import whole_text_label


_NOT_ENCODED = f"[{C.UNCHECKED_MARK}{C.CLEAN_MARK}]++"


def run_threshold(n_words: Column) -> Column:
    low, share, high = C.RUN_THRESHOLD
    return F.greatest(
        F.lit(low), F.least(F.rint(n_words * F.lit(share)), F.lit(high)).cast("int")
    )


def same_type_threshold(n_words: Column) -> Column:
    low, share, high = C.SAME_TYPE_THRESHOLD
    return F.greatest(
        F.lit(low), F.least(F.rint(n_words * F.lit(share)), F.lit(high)).cast("int")
    )


# Marks are ASCII: their number is that of their bytes, which is known without counting.
def longest_run(marks: Column) -> Column:
    """Longest run of encoded words; a clean or an unchecked word ends a run."""
    return F.array_max(F.transform(F.split(marks, "[_.]+"), F.octet_length))


def type_counts(marks: Column) -> Column:
    """MAP type -> count over the types that occur, in the order in which they first occur."""
    # one mark for each run of a type, so that few are left to be told apart
    runs = F.regexp_replace(F.regexp_replace(marks, _NOT_ENCODED, ""), "(.)\\1++", "$1")
    kinds = F.create_map(*[F.lit(v) for kind, mark in C.WORD_MARKS.items() for v in (mark, kind)])
    found = F.when(runs == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(runs, "")))
    return F.map_from_entries(
        F.transform(
            found,
            lambda mark: F.struct(
                F.element_at(kinds, mark).alias("key"),
                (F.octet_length(marks) - F.octet_length(F.regexp_replace(marks, mark, F.lit("")))).alias("value"),
            ),
        )
    )


def encoded_positions(marks: Column) -> Column:
    # types are marked by small letters, which come after both other marks and the empty string
    spots = F.transform(F.split(marks, ""), lambda mark, i: F.when(mark >= "a", i))
    return F.when(encoded_count(marks) == 0, F.array().cast("array<int>")).otherwise(F.array_compact(spots))


def checked_count(marks: Column) -> Column:
    return F.octet_length(F.regexp_replace(marks, f"{C.UNCHECKED_MARK}++", ""))


def encoded_count(marks: Column) -> Column:
    return F.octet_length(F.regexp_replace(marks, _NOT_ENCODED, ""))


def same_type_flag(counts: Column, threshold: Column) -> Column:
    return F.exists(F.map_values(counts), lambda n: n >= threshold)


def _run_reason(run: Column, threshold: Column) -> Column:
    return F.concat(
        F.lit("More than "),
        threshold - 1,
        F.lit(" consecutive encoded words ("),
        run,
        F.lit(" found). (Threshold: "),
        threshold,
        F.lit(")"),
    )


def _type_reason(kind: Column, count: Column, threshold: Column) -> Column:
    return F.concat(
        F.lit("More than "),
        threshold - 1,
        F.lit(" "),
        kind,
        F.lit(" encoded words ("),
        count,
        F.lit(" found). (Threshold: "),
        threshold,
        F.lit(")"),
    )


def flag_reasons(
    run: Column, run_limit: Column, counts: Column, type_limit: Column
) -> Column:
    over = F.filter(F.map_entries(counts), lambda e: e["value"] >= type_limit)
    return F.concat(
        F.array_compact(
            F.array(F.when(run >= run_limit, _run_reason(run, run_limit)))
        ),
        F.transform(over, lambda e: _type_reason(e["key"], e["value"], type_limit)),
    )


def mark_words(
    messages: DataFrame, text: str = "text", reversed_rule: bool = True
) -> DataFrame:
    """Adds ``whole_type``, ``n_words`` and ``marks`` (NULL after a whole-text hit)."""
    kept = [F.col(f"`{c}`") for c in messages.columns]
    trimmed = messages.select(*kept, P.trim_whitespace(F.col(text)).alias("_trimmed"))
    sized = trimmed.select(*kept, "_trimmed", F.length("_trimmed").alias("_length"))
    judged = sized.select(
        *kept,
        whole_text_label(F.col("_trimmed"), reversed_rule, F.col("_length")).alias("_whole"),
        "_trimmed",
    )
    whole, trimmed = F.col("_whole"), F.col("_trimmed")
    marked = judged.select(
        *kept,
        P.settled(
            whole_type=whole,
            # such a text is not empty
            _unmarked=F.when(whole.isNotNull(), P.count_matches(trimmed, f"{C.WS}++") + 1),
            marks=WD.text_marks(F.when(whole.isNull(), trimmed)),
        ),
    )
    # one mark a word
    n_words = F.coalesce(F.octet_length("marks"), "_unmarked")
    return marked.select(*kept, "whole_type", n_words.alias("n_words"), "marks")


def detect_obfuscation(
    messages: DataFrame, text: str = "text", reversed_rule: bool = True
) -> DataFrame:
    """Adds the ``report`` struct; NULL text gives a NULL report."""
    kept = [F.col(f"`{c}`") for c in messages.columns]
    marks, n_words, whole = F.col("marks"), F.col("n_words"), F.col("whole_type")
    hit = whole.isNotNull()
    measured = mark_words(messages, text, reversed_rule).select(
        *kept,
        "whole_type",
        "n_words",
        "marks",
        F.when(hit, 0).otherwise(longest_run(marks)).alias("_run"),
        F.when(hit, 0).otherwise(run_threshold(n_words)).alias("_run_limit"),
        F.when(hit, 0).otherwise(same_type_threshold(n_words)).alias("_type_limit"),
        F.when(hit, F.create_map(whole, F.lit(1)))
        .otherwise(type_counts(marks))
        .alias("_counts"),
    )
    run, run_limit = F.col("_run"), F.col("_run_limit")
    counts, type_limit = F.col("_counts"), F.col("_type_limit")
    whole_reason = F.concat(
        F.lit("Entire text appears to be "),
        F.replace(whole, F.lit("_"), F.lit(" ")),
        F.lit(" encoded"),
    )
    report = F.struct(
        (hit | (run >= run_limit) | same_type_flag(counts, type_limit)).alias("should_flag"),
        hit.alias("whole_text_obfuscation"),
        whole.alias("whole_text_encoding_type"),
        run.alias("consecutive_encoded_count"),
        run_limit.alias("consecutive_threshold_applied"),
        counts.alias("encoding_counts"),
        type_limit.alias("same_encoding_threshold_applied"),
        F.when(hit, F.array(whole_reason))
        .otherwise(flag_reasons(run, run_limit, counts, type_limit))
        .alias("flag_reasons"),
        n_words.alias("total_words_in_message"),
        F.when(hit, 0).otherwise(checked_count(marks)).alias(
            "total_words_checked_for_obfuscation"
        ),
        F.when(hit, 1).otherwise(encoded_count(marks)).alias("total_encoded_words"),
        F.when(hit, F.array().cast("array<int>"))
        .otherwise(encoded_positions(marks))
        .alias("encoded_word_positions"),
    )
    return measured.select(*kept, F.when(n_words.isNotNull(), report).alias("report"))


def quick_flag(
    messages: DataFrame, text: str = "text", reversed_rule: bool = True
) -> DataFrame:
    """Adds ``should_flag`` only; the rest of the report is never computed."""
    reported = detect_obfuscation(messages, text, reversed_rule)
    return reported.withColumn("should_flag", F.col("report.should_flag")).drop("report")


def word_audit(
    messages: DataFrame, key: str = "msg_id", text: str = "text", wordless: bool = False
) -> DataFrame:
    """One row per word: ``(key, pos, word, checked, encoding)``, whole-text hits included.

    With ``wordless`` a message without words has one row, without position and word.
    """
    explode = F.posexplode_outer if wordless else F.posexplode
    words = messages.select(key, explode(P.split_words(F.col(text))).alias("pos", "word"))
    return words.select(
        key, "pos", "word", P.strip_punctuation(F.col("word")).alias("_core")
    ).select(
        key,
        "pos",
        "word",
        WD.is_checked(F.col("_core")).alias("checked"),
        F.when(WD.is_checked(F.col("_core")), WD.core_label(F.col("_core"))).alias("encoding"),
    )


def run_islands(audit: DataFrame, key: str = "msg_id") -> DataFrame:
    """``(key, island, run)``: a row for each island of encoded words, and one without island
    and with run 0 for all other words of a message, which keeps it in the result."""
    order = Window.partitionBy(key).orderBy("pos")
    hits = audit.select(key, "pos", F.col("encoding").isNotNull().cast("int").alias("hit"))
    island = F.when(F.col("hit") == 1, F.col("pos") - F.sum("hit").over(order))
    return hits.select(key, "hit", island.alias("island")).groupBy(key, "island").agg(F.sum("hit").alias("run"))


def longest_runs_by_window(audit: DataFrame, key: str = "msg_id") -> DataFrame:
    """Longest run per message from audit rows, 0 without an encoded word: islands of
    consecutive positions.

    For audit tables already laid out by word; :func:`longest_run` answers the
    same from the marks without a shuffle.
    """
    return run_islands(audit, key).groupBy(key).agg(F.max("run").alias("longest_run"))
