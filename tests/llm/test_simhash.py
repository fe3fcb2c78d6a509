import random

import pytest
import xxhash
from pyspark.sql import functions as F

from textguard.llm import components, simhash
from textguard.llm.components import connected


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    found = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in found) > len(found))


def brute(rows):
    """component by comparing all fingerprints"""
    prints = [slow_fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc)
    return {
        doc: (f"{prints[i]:016x}", min((d for d in names[find(i)] if d is not None), default=None))
        for i, (doc, _) in enumerate(rows)
    }


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 400]))) for _ in range(60)]
    near = []
    for text in base[:40]:
        words = text.split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    return [*base, *near, *base[:10], base[3].upper(), None, "", " \n\t", "İ x  y"]


def test_components_match_all_pairs(spark):
    rows = list(enumerate(texts()))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()} == brute(rows)


def test_long_postings_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT_LIST", 2)
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    prints = {seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for seed in seeds for _ in range(40)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    roots = {r.node: r.root for r in connected(links).collect()}
    parent = {p: p for p in signed}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(signed):
        for q in signed[:i]:
            if ((p ^ q) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = find(p), find(q)
                parent[max(x, y)] = min(x, y)
    assert {p: roots.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(1).shuffle(ids)
    chain = spark.createDataFrame([*zip(ids, ids[1:]), (100, 101), (100, 100)], "a bigint, b bigint")
    roots = {r.node: r.root for r in connected(chain).collect()}
    assert roots == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d", "x", 9), (1, "a b c d", "x", 9), (None, "a b c d", "y", 9), (None, "q w e r t y", "z", 9), (5, None, None, 9)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    found = simhash.near_duplicates(frame)
    assert found.columns == ["doc_id", "fp", "fingerprint", "component_id"]
    assert sorted((r.doc_id or 0, r.fp or "", r.component_id or 0) for r in found.collect()) == [
        (0, "y", 1), (0, "z", 0), (1, "x", 1), (1, "x", 1), (5, "", 5)
    ]
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0, r.fp or "") for r in kept.collect()) == [(0, "y"), (0, "z"), (1, "x"), (5, "")]


@pytest.mark.parametrize("build", [simhash.near_duplicates, simhash.keep_one_of_each])
def test_empty_table(spark, build):
    assert build(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_spark_and_python_hash_alike(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("wörd two three and more than thirty-two bytes")).alias("h")).first()
    assert row.h & ((1 << 64) - 1) == xxhash.xxh64_intdigest("wörd two three and more than thirty-two bytes".encode(), 42)


def test_rows_that_share_an_id_keep_one_row_for_each_component(spark):
    one, two = "a b c d e f g h", "quite another text of many other words"
    rows = [(1, one, "x"), (1, two, "y"), (1, two, None), (1, None, "z"), (2, one, "x"), (3, two, "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, tag string")
    runs = [sorted(map(repr, simhash.keep_one_of_each(frame.repartition(n)).collect())) for n in (1, 2, 4, 5)]
    kept = simhash.keep_one_of_each(frame).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == [(1, ""), (1, one), (1, two)]
    assert all(run == runs[0] for run in runs)


def test_columns_with_dots(spark):
    frame = spark.createDataFrame([(1, "a b c d", "x"), (2, "a b c d", "y"), (None, None, "z")], "doc_id bigint, text string, `a.b` string")
    found = simhash.near_duplicates(frame)
    assert found.columns == ["doc_id", "a.b", "fingerprint", "component_id"]
    assert {(r["a.b"], r.component_id) for r in found.collect()} >= {("x", 1), ("y", 1)}
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns and sorted(r["a.b"] for r in kept.collect()) == ["x", "z"]


def test_a_hub_can_be_split(spark):
    """With broadcasts off, the join of a star's links is split at its hub."""
    off = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        edges = spark.range(1, 40000, 1, 8).selectExpr("id as a", "if(id % 50 = 0, id - 1, 0L) as b").where("a > b")
        done = components._small_star(edges.selectExpr("if(b = 0, 50000L, a) as a", "if(b = 0, a, b) as b"))
        assert done.count() > 0
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
