import pandas as pd
import pytest
from pyspark.sql import functions as F

from textguard.functions import redact as R
from textguard.operators import pii as PI

DEMO = (
    "My name is John Doe, and my email is john.doe@example.com. My phone number is "
    "123-456-7890. I live at 123 Main St, Anytown, USA."
)
HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
CASES = [
    (DEMO, DEMO.replace("john.doe@example.com.", "[redacted].").replace("123-456-7890", "[redacted]"),
     DEMO.replace("john.doe@example.com", "[EMAIL]").replace("123-456-7890", "[PHONE]")),
    ("", "", ""),
    (None, "", ""),
    ("nothing here", "nothing here", "nothing here"),
    ("a@b.co", "[redacted]", "[EMAIL]"),
    ("a@b.co c@d.org", "[redacted]", "[EMAIL]"),
    ("a@b.co 10.0.0.1 x", "[redacted] x", "[EMAIL][IPV4] x"),
    ("10.0.0.1, 10.0.0.2", "[redacted], [redacted]", "[IPV4], [IPV4]"),
    (f"key {HEX} card 4111 1111 1111 1111!", "key [redacted] card [redacted]!",
     "key [SECRET] card [DIGITS]!"),
    ("no  match ]", "no match]", "no match]"),
    ("12345678", "12345678", "12345678"),
    (f"x {'m' * 100}@h.io y", "x [redacted] y", "x [EMAIL] y"),
    (f"x a@{'d' * 70}.io y", "x [redacted] y", "x [EMAIL] y"),
    (f"x a@{'l.' * 26}io y", "x [redacted] y", "x [EMAIL] y"),
    ("a@b.co_x@y.org z", "[redacted] z", "[EMAIL] z"),
    ("a@b@c.com", "a@[redacted]", "a@[EMAIL]"),
    ("+1 555-123-4567\n", "[redacted]\n", "[PHONE]\n"),
]


def run(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "msg_id long, text string")
    got = rows.select("msg_id", build(F.col("text")).alias("x")).collect()
    return [r.x for r in sorted(got, key=lambda r: r.msg_id)]


def test_masks(spark):
    texts = [c[0] for c in CASES]
    assert run(spark, texts, R.mask_pii) == [c[1] for c in CASES]
    assert run(spark, texts, lambda t: R.mask_pii(t, aggregate=False)) == [c[2] for c in CASES]


def test_masking_twice_is_masking_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for aggregate in (True, False):
        once = docs.select(R.mask_pii(F.col("text"), aggregate).alias("a"))
        assert once.filter(R.mask_pii(F.col("a"), aggregate) != F.col("a")).count() == 0


def test_span_offsets_cut_out_the_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("msg_id"), "text"
    )
    spans = PI.pii_spans(docs)
    cut = spans.join(docs, "msg_id").select(
        "value", F.expr("substring(text, int(start) + 1, int(end - start))").alias("piece")
    )
    assert cut.count() > 0 and cut.filter("value <> piece").count() == 0
    counted = {r.label: r.n for r in PI.count_by_type(docs).collect()}
    assert counted == {r.label: r["count"] for r in spans.groupBy("label").count().collect()}


def test_merge_touching(spark):
    rows = [(1, 0, 4, "A"), (1, 4, 9, "B"), (1, 10, 12, "A"), (1, 2, 3, "A"), (2, 0, 1, "B")]
    spans = spark.createDataFrame(rows, "msg_id long, start long, end long, label string")
    together = sorted(tuple(r) for r in PI.merge_touching(spans).collect())
    assert together == [(1, 0, 9, "A", 3), (1, 10, 12, "A", 1), (2, 0, 1, "B", 1)]
    typed = sorted(tuple(r) for r in PI.merge_touching(spans, aggregate=False).collect())
    assert typed == [(1, 0, 4, "A", 2), (1, 4, 9, "B", 1), (1, 10, 12, "A", 1), (2, 0, 1, "B", 1)]


def make_tagger():
    # a local function, so that workers get its code and need not import this file
    def name_tagger(texts: pd.Series) -> pd.Series:
        return texts.map(spans)

    def spans(text):
        if text is None:
            return []
        found, at = [], 0
        for word in text.split(" "):
            if word.strip(".,") in ("John", "Doe", "Paris"):
                label = "CITY" if word.startswith("Paris") else "NAME"
                found.append({"start": at, "end": at + len(word.strip(".,")), "label": label})
            at += len(word) + 1
        return found

    return name_tagger


@pytest.mark.parametrize(
    "aggregate,want",
    [(True, ["Hi [redacted], bye", "none", "[redacted]", ""]),
     (False, ["Hi [NAME], bye", "none", "[NAME][CITY]", ""])],
)
def test_tagger_spans_are_merged_and_masked(spark, aggregate, want):
    texts = ["Hi John Doe, bye", "none", "John Paris", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string")
    tagged = PI.tag_with(rows, make_tagger())
    merged = R.merge_spans(F.col("text"), F.col("spans"), aggregate)
    masked = tagged.withColumn("merged", merged).select(
        "msg_id", R.mask_spans(F.col("text"), F.col("merged"), aggregate).alias("x")
    )
    assert [r.x for r in sorted(masked.collect())] == want


def test_tagger_sees_only_wanted_rows(spark):
    rows = spark.createDataFrame([(1, "John"), (2, "John")], "msg_id long, text string")
    tagged = PI.tag_with(rows, make_tagger(), wanted=F.col("msg_id") == 2)
    assert {r.msg_id: len(r.spans) for r in tagged.collect()} == {1: 0, 2: 1}


def test_names_from_a_list(spark):
    rows = spark.createDataFrame(
        [(1, "John met JOHN and Johnny"), (2, "nobody"), (3, None)], "msg_id long, text string"
    )
    names = spark.createDataFrame([("john",), ("Zoë",)], "name string")
    got = {r.msg_id: r.redacted for r in PI.redact_names(rows, names).collect()}
    assert got == {1: "[redacted] met [redacted] and Johnny", 2: "nobody", 3: None}


def test_long_texts_stay_cheap(spark):
    texts = ["z" * 300_000, "a@" + "b." * 100_000, "10.0.0.1 " * 20_000, "@" * 100_000, "a@" * 100_000, "m" * 200_000 + "@x.io"]
    got = run(spark, texts, R.mask_pii)
    assert got[0] == texts[0] and got[2].count("[redacted]") == 1 and got[-1] == "[redacted]"
