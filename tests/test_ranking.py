from pyspark.sql import Window
from pyspark.sql import functions as F

from textguard.operators import training_data as TD
from textguard.operators.ranking import grouped_rank, task_counts


def hashed(spark, rows=30_000):
    """64-bit hashed ids in two classes, one of them with most rows."""
    return spark.range(0, rows, 1, 6).select(
        F.xxhash64("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label")
    )


def test_ranks_of_hashed_ids(spark):
    rows = hashed(spark)
    plain = F.row_number().over(Window.partitionBy("label").orderBy("doc_id"))
    want = {(r.doc_id, r.label, r.rn) for r in rows.withColumn("rn", plain).collect()}
    ranked = grouped_rank(rows, ["label"], ["doc_id"])
    assert {(r.doc_id, r.label, r.rn) for r in ranked.collect()} == want
    whole = grouped_rank(rows, [], ["doc_id"], "place")
    assert sorted(r.place for r in whole.collect()) == list(range(1, 30_001))


def test_the_table_of_counts_is_small(spark):
    rows = hashed(spark).repartitionByRange(4, "label", "doc_id").sortWithinPartitions("label", "doc_id")
    held = rows.withColumn("_spot", F.monotonically_increasing_id())
    assert task_counts(held, ["label"]).count() <= 4 + 1


def test_first_rows_and_balance_of_hashed_ids(spark):
    rows = hashed(spark, 5_000)
    ids = sorted(r.doc_id for r in rows.collect())
    assert sorted(r.doc_id for r in TD.first_rows(rows, 600).collect()) == ids[:600]
    balanced = TD.balance(rows).collect()
    assert sum(r.label == 1 for r in balanced) == sum(r.label == 0 for r in balanced) == 500
    benign = sorted(r.doc_id for r in rows.where("label = 0").collect())
    assert sorted(r.doc_id for r in balanced if r.label == 0) == benign[:500]


def test_repeated_keys_and_empty_tables(spark):
    rows = spark.createDataFrame([(7, 1)] * 5 + [(3, 1), (9, 0)], "doc_id long, label int")
    ranked = grouped_rank(rows, ["label"], ["doc_id"]).collect()
    assert sorted(r.rn for r in ranked if r.label == 1) == [1, 2, 3, 4, 5, 6]
    assert grouped_rank(rows.limit(0), ["label"], ["doc_id"]).count() == 0
