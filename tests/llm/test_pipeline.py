import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_quality_lines import slow_lines, slow_verdict
from tests.llm.test_simhash import brute


def test_every_stage_against_plain_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept == {i: t for i, t in rows.items() if slow_verdict(t)[-1]}
    clean = corpus_pipeline.line_dedup(spark, good, sf)
    assert clean.columns == docs.columns
    lines = {r.doc_id: r.text for r in clean.collect()}
    assert lines == {doc: text for doc, _, _, text in slow_lines(list(kept.items()))}
    assert clean.where(F.col("n_chars") != F.length("text")).count() == 0
    single = corpus_pipeline.near_dedup(spark, clean, sf)
    ids = {r.doc_id for r in single.collect()}
    assert ids == {name for _, name in brute(sorted(lines.items())).values()}
    mixed = corpus_pipeline.mix_sources(spark, single, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= ids
    packed = corpus_pipeline.pack_sequences(spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count()


def test_run_agrees_with_itself(spark, sf):
    first = corpus_pipeline.run(spark, sf)
    totals = [F.count("*").alias("n"), F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("bins")]
    one, two = first.agg(*totals).first(), corpus_pipeline.run(spark, sf).agg(*totals).first()
    assert one == two and -(-one.tokens // 4096) <= one.bins <= -(-one.tokens // 4096) + 1
