import pytest
from pyspark.sql import functions as F

from textguard.functions import language as LG
from textguard.operators import language as L
from textguard.operators import translation as TR


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("msg_id"), "text", "lang"
    )


@pytest.fixture(scope="module")
def profiles(docs):
    return L.build_profiles(docs).cache()


def test_grams(spark):
    rows = spark.createDataFrame([("Ab, é!",), ("",), ("12",)], "t string")
    got = [r[0] for r in rows.select(LG.grams(F.col("t"))).collect()]
    assert got == [[" ab", "ab ", "b é", " é "], [], []]


def test_profiles_hold_at_most_the_top(profiles):
    sizes = {r.lang: (r["n"], r.top) for r in profiles.groupBy("lang").agg(
        F.count("*").alias("n"), F.max("rank").alias("top")).collect()}
    assert set(sizes) == {"de", "en", "es", "fr"}
    assert all(n <= 300 and top == n - 1 for n, top in sizes.values())


def test_row_wise_and_join_forms_agree(docs, profiles):
    rows = L.detect_language(docs.drop("lang"), L.profile_lookup(profiles))
    joined = L.detect_language_by_join(docs, profiles)
    assert sorted((r.msg_id, r.lang) for r in rows.collect() if r.lang) == sorted(
        (r.msg_id, r.lang) for r in joined.select("msg_id", "lang").collect()
    )


def test_documents_are_told_apart(docs, profiles):
    spoken = L.detect_language(docs, L.profile_lookup(profiles), out="found")
    right = spoken.select(F.avg((F.col("found") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95


def test_no_letters_no_language(spark, profiles):
    rows = spark.createDataFrame([(1, "123 !"), (2, ""), (3, None)], "msg_id long, text string")
    found = L.detect_language(rows, L.profile_lookup(profiles))
    assert [r.lang for r in found.collect()] == [None, None, None]


@pytest.fixture(scope="module")
def memory(spark):
    pairs = spark.createDataFrame(
        [("es", "Hola", "Hello"), ("fr", "Oui", "Yes"), ("es", "Hola", "Hello")],
        "lang string, text string, english string",
    ).withColumn("en", F.lit("en"))
    there = TR.memory_from_pairs(pairs, "lang", "en", "text", "english")
    return there.unionByName(TR.memory_from_pairs(pairs, "en", "lang", "english", "text"))


def test_translation_is_all_or_nothing(spark, memory):
    rows = spark.createDataFrame(
        [(1, "Hola", "es"), (2, "Ciao", "it"), (3, "Hi", "en"), (4, "Oui", None), (5, None, "es")],
        "msg_id long, text string, lang string",
    )
    found = TR.translate_to_english(rows, memory)
    assert found.count() == 5  # duplicate memory entries add no rows
    got = {r.msg_id: (r.translation.lang, r.translation.text) for r in found.collect()}
    assert got[1] == ("es", "Hello")
    assert all(got[i] == (None, None) for i in (2, 3, 4, 5))
    adopted = {r.msg_id: (r.current_text, r.stored_lang) for r in TR.adopt_translation(found).collect()}
    assert adopted[1] == ("Hello", "es")
    assert adopted[2] == ("Ciao", None)


def test_english_entries_are_found_but_not_used(spark):
    memory = spark.createDataFrame(
        [("en|en", "Hi", "Hi there")], "pair string, text string, target_text string"
    ).select(F.col("pair").alias("lang_pair"), F.md5("text").alias("src_md5"), "target_text")
    rows = spark.createDataFrame([(1, "Hi", "en")], "msg_id long, text string, lang string")
    row = TR.adopt_translation(TR.translate_to_english(rows, memory)).first()
    assert row.translation.text == "Hi there"
    assert (row.current_text, row.stored_lang) == ("Hi", None)


def test_translate_back(spark, memory):
    rows = spark.createDataFrame(
        [(1, "Hello", "es"), (2, "Hello", "en"), (3, "Hello", None), (4, "Unknown", "es")],
        "msg_id long, reply string, stored_lang string",
    )
    got = {r.msg_id: r.final_text for r in TR.translate_back(rows, memory).collect()}
    assert got == {1: "Hola", 2: "Hello", 3: "Hello", 4: "Unknown"}


def test_rows_without_a_key_do_not_meet(spark, memory):
    """English rows get keys of their own instead of one shared NULL."""
    rows = spark.range(1000).select(
        F.col("id").alias("msg_id"), F.lit("same").alias("reply"), F.lit("en").alias("stored_lang")
    )
    plan = TR.translate_back(rows, memory)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
    assert TR.translate_back(rows, memory).filter("final_text = 'same'").count() == 1000
