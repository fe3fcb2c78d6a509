"""Queries over language profiles, detection and translation memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.operators import language as L
from textguard.operators import translation as TR
from textguard.plans.catalog.registry import register
from textguard.sources.tables import read_table, spread, turn_id

_ACCENTS, _BARE = "éèêçóñüäöíÉÈÊÇÓÑÜÄÖÍ", "eeeconuaoiEEECONUAOI"


def fold(text: Column) -> Column:
    """Stands in for an English translation: the text without accents."""
    return F.translate(text, _ACCENTS, _BARE)


FOLD_SQL = f"translate(text, '{_ACCENTS}', '{_BARE}')"


def documents(spark, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return spread(docs.select(F.col("doc_id").alias("msg_id"), "text", "lang", "source"))


def grams_sql(text: str) -> str:
    spaced = f"regexp_replace(concat(' ', lower({text}), ' '), '[^\\p{{L}}]+', ' ', 'g')"
    return f"""list_transform(list_zip(string_split({spaced}, '')[:-3],
        string_split({spaced}, '')[2:-2], string_split({spaced}, '')[3:]),
        lambda p: p[1] || p[2] || p[3])"""


PROFILES_SQL = f"""
    profiles AS (
      SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) - 1 AS rank
      FROM (SELECT lang, gram, count(*) AS n
            FROM (SELECT lang, unnest({grams_sql('text')}) AS gram FROM documents) GROUP BY ALL)
      QUALIFY rank < 300
    )"""


def detect_sql(messages: str) -> str:
    """CTEs ``profiles`` and ``spoken(msg_id, lang, gain)`` for ``messages(msg_id, text)``."""
    return f"""{PROFILES_SQL},
    gains AS (
      SELECT msg_id, lang, sum(300 - rank)::BIGINT AS gain
      FROM (SELECT msg_id, unnest({grams_sql('text')}) AS gram FROM {messages}) JOIN profiles USING (gram)
      GROUP BY ALL
    ),
    spoken AS (
      SELECT msg_id, lang, gain FROM gains
      QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY gain DESC, lang) = 1
    )"""


@register("language_profiles", f"WITH {PROFILES_SQL} SELECT lang, gram, n, rank FROM profiles")
def language_profiles(spark, folder):
    return L.build_profiles(documents(spark, folder))


_TURNS_SQL = "(SELECT conv_id || ':' || turn AS msg_id, text FROM conversations)"


@register(
    "detect_language",
    f"""WITH {detect_sql(_TURNS_SQL)}
        SELECT msg_id, lang FROM {_TURNS_SQL} LEFT JOIN spoken USING (msg_id)""",
)
def detect_language(spark, folder):
    lookup = L.profile_lookup(L.build_profiles(documents(spark, folder)))
    turns = spread(read_table(spark, folder, "conversations"))
    messages = turns.select(turn_id().alias("msg_id"), "text")
    return L.detect_language(messages, lookup).select("msg_id", "lang")


@register(
    "detect_language_by_join",
    f"""WITH messages AS (SELECT doc_id AS msg_id, text FROM documents), {detect_sql('messages')}
        SELECT msg_id, lang, gain FROM messages LEFT JOIN spoken USING (msg_id)""",
)
def detect_language_by_join(spark, folder):
    docs = documents(spark, folder)
    return L.detect_language_by_join(docs.drop("lang"), L.build_profiles(docs))


def memory(docs: DataFrame) -> DataFrame:
    """Translation memory for all documents that are not English, both ways."""
    pairs = docs.filter(F.col("lang") != "en").select(
        "lang", F.lit("en").alias("en"), "text", fold(F.col("text")).alias("folded")
    )
    return TR.memory_from_pairs(pairs, "lang", "en", "text", "folded").unionByName(
        TR.memory_from_pairs(pairs, "en", "lang", "folded", "text")
    )


MEMORY_SQL = f"""
    memory AS (
      SELECT lang_pair, src_md5, min(target_text) AS target_text FROM (
        SELECT lang || '|en' AS lang_pair, md5(text) AS src_md5, {FOLD_SQL} AS target_text
        FROM documents WHERE lang <> 'en'
        UNION ALL
        SELECT 'en|' || lang, md5({FOLD_SQL}), text FROM documents WHERE lang <> 'en'
      ) GROUP BY ALL
    )"""


def _translated(spark, folder) -> DataFrame:
    docs = documents(spark, folder)
    return TR.translate_to_english(docs, memory(docs))


@register(
    "translate_to_english",
    f"""WITH {MEMORY_SQL}
        SELECT doc_id AS msg_id, CASE WHEN target_text IS NOT NULL THEN lang END AS found_lang,
               md5(target_text) AS digest
        FROM documents LEFT JOIN memory ON lang_pair = lang || '|en' AND src_md5 = md5(text)""",
)
def translate_to_english(spark, folder):
    return _translated(spark, folder).select(
        "msg_id",
        F.col("translation.lang").alias("found_lang"),
        F.md5(F.col("translation.text").cast("binary")).alias("digest"),
    )


@register(
    "use_translation",
    f"""WITH {MEMORY_SQL}
        SELECT doc_id AS msg_id, CASE WHEN target_text IS NOT NULL AND lang <> 'en' THEN lang END
                 AS stored_lang,
               md5(CASE WHEN target_text IS NOT NULL AND lang <> 'en' THEN target_text ELSE text END)
                 AS digest
        FROM documents LEFT JOIN memory ON lang_pair = lang || '|en' AND src_md5 = md5(text)""",
)
def use_translation(spark, folder):
    return TR.adopt_translation(_translated(spark, folder)).select(
        "msg_id", "stored_lang", F.md5(F.col("current_text").cast("binary")).alias("digest")
    )


@register(
    "translate_back",
    f"""WITH {MEMORY_SQL},
        replies AS (SELECT doc_id AS msg_id, lang, {FOLD_SQL} AS reply FROM documents)
        SELECT msg_id, md5(coalesce(target_text, reply)) AS digest
        FROM replies LEFT JOIN memory
          ON lang <> 'en' AND lang_pair = 'en|' || lang AND src_md5 = md5(reply)""",
)
def translate_back(spark, folder):
    docs = documents(spark, folder)
    replies = docs.select("msg_id", F.col("lang").alias("stored_lang"), fold(F.col("text")).alias("reply"))
    return TR.translate_back(replies, memory(docs)).select(
        "msg_id", F.md5(F.col("final_text").cast("binary")).alias("digest")
    )
