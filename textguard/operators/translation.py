"""Translation to and from English through a translation-memory table.

``memory`` has columns ``(lang_pair, src_md5, target_text)``. No size is assumed of
it: the joins carry no hint, so Spark broadcasts it only when its measured size allows
and otherwise shuffles both sides. Rows that need no look-up get a key of their own,
which no entry can equal, so they spread evenly instead of meeting on one NULL key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGLISH = "en"


def memory_from_pairs(
    pairs: DataFrame, source: str, target: str, source_text: str, target_text: str
) -> DataFrame:
    """Builds memory rows from a table of text pairs and their language columns."""
    return pairs.select(
        F.concat_ws("|", F.col(source), F.col(target)).alias("lang_pair"),
        F.md5(F.col(source_text).cast("binary")).alias("src_md5"),
        F.col(target_text).alias("target_text"),
    )


def _unique(memory: DataFrame) -> DataFrame:
    return memory.groupBy("lang_pair", "src_md5").agg(
        F.min("target_text").alias("target_text")
    )


def look_up(
    messages: DataFrame,
    memory: DataFrame,
    pair: Column,
    text: Column,
    wanted: Column,
    key: str,
    out: str,
    unique_memory: bool = False,
) -> DataFrame:
    """Adds ``out``: the memory's text for ``(pair, text)`` where ``wanted``, else NULL.

    With ``unique_memory`` the caller vouches for one entry per key and the memory is
    joined as it is; otherwise duplicates are folded first.
    """
    entries = memory if unique_memory else _unique(memory)
    entries = entries.select(
        F.concat_ws("#", "lang_pair", "src_md5").alias("_tm_key"),
        F.col("target_text").alias(out),
    )
    own = F.concat(F.lit("-"), F.xxhash64(F.col(key)).cast("string"))
    sought = F.concat_ws("#", pair, F.md5(text.cast("binary")))
    keyed = messages.withColumn(
        "_tm_key", F.when(wanted, F.when(text.isNotNull(), sought)).otherwise(own)
    ).withColumn("_tm_key", F.coalesce("_tm_key", own))
    return keyed.join(entries, "_tm_key", "left").drop("_tm_key")


def translate_to_english(
    messages: DataFrame,
    memory: DataFrame,
    key: str = "msg_id",
    text: str = "text",
    lang: str = "lang",
    unique_memory: bool = False,
) -> DataFrame:
    """Adds ``translation`` STRUCT<lang, text>: both NULL when either is missing.

    English text is looked up as ``en|en`` like any other pair.
    """
    found = look_up(
        messages,
        memory,
        F.concat(F.col(lang), F.lit("|" + ENGLISH)),
        F.col(text),
        F.col(lang).isNotNull(),
        key,
        "_translated",
        unique_memory,
    )
    return as_translation(found, messages.columns, lang)


def as_translation(found: DataFrame, kept: list[str], lang: str = "lang") -> DataFrame:
    """The columns ``kept`` and ``translation`` STRUCT<lang, text> of ``_translated``."""
    hit = F.coalesce(F.col("_translated") != "", F.lit(False))
    return found.select(
        *[F.col(f"`{c}`") for c in kept],
        F.struct(
            F.when(hit, F.col(lang)).alias("lang"),
            F.when(hit, F.col("_translated")).alias("text"),
        ).alias("translation"),
    )


def uses_translation(translation: Column) -> Column:
    return F.coalesce(
        (translation["lang"] != ENGLISH) & (translation["text"] != ""), F.lit(False)
    )


def adopt_translation(
    messages: DataFrame, text: str = "text", translation: str = "translation"
) -> DataFrame:
    """Adds ``current_text`` and ``stored_lang`` (NULL when the text is used as it came)."""
    used = uses_translation(F.col(translation))
    return messages.withColumns(
        {
            "current_text": F.when(used, F.col(translation)["text"]).otherwise(F.col(text)),
            "stored_lang": F.when(used, F.col(translation)["lang"]),
        }
    )


def translate_back(
    messages: DataFrame,
    memory: DataFrame,
    key: str = "msg_id",
    text: str = "reply",
    lang: str = "stored_lang",
    out: str = "final_text",
    unique_memory: bool = False,
) -> DataFrame:
    """Adds ``out``: the reply in the stored language, or as it is when English or unknown."""
    wanted = F.col(lang).isNotNull() & (F.col(lang) != ENGLISH)
    found = look_up(
        messages,
        memory,
        F.concat(F.lit(ENGLISH + "|"), F.col(lang)),
        F.col(text),
        wanted,
        key,
        "_back",
        unique_memory,
    )
    kept = [F.col(f"`{c}`") for c in messages.columns]
    return found.select(
        *kept,
        F.when(F.col("_back") != "", F.col("_back")).otherwise(F.col(text)).alias(out),
    )
