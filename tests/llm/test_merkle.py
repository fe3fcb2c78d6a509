import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from textguard.llm import merkle as MK
from textguard.llm.queries import QUERIES

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(leaves):
    """All levels, and for each leaf its siblings as (digest, whether it stands left)."""
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([digest("".join(rows[-1][i : i + 2])) for i in range(0, len(rows[-1]), 2)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in rows[:-1]:
            j = i ^ 1
            way.append((level[j], j < i) if j < len(level) else None)
            i //= 2
        ways.append(way)
    return rows[-1][0], ways


def slow_fold(leaf, way):
    for step in way:
        leaf = digest(leaf if step is None else step[0] + leaf if step[1] else leaf + step[0])
    return leaf


def slow_manifest(rows, shown):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for group in order:
        held = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
        trees.append((held, *slow_tree([slow_leaf(r) for r in held])))
    root, high = slow_tree([t[1] for t in trees])
    out = []
    for n, (held, subroot, ways) in enumerate(trees):
        for row, way in zip(held, ways, strict=True):
            whole = way + high[n]
            proof = digest("".join(s[0] for s in whole if s))
            folded = slow_fold(shown(row) or slow_leaf(row), whole)
            out.append((row[0], slow_leaf(row), subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def shown_by_rule(row):
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 7:
        return None
    return slow_leaf((row[0], row[1], row[2], None if row[3] is None else row[3] + 1, row[4]))


def made_rows():
    rng = random.Random(2)
    sizes = {"en": 300, "de": 33, "fr": 16, "Zz": 1, "é": 2, None: 5, "": 3, "xx": 17}
    rows, n = [], 0
    for lang, count in sizes.items():
        for _ in range(count):
            text = rng.choice([None, "", "plain", "ünï", "a" * rng.randint(0, 50)])
            rows.append((n, rng.choice([None, "s1", "s-2"]), lang, rng.choice([None, n, 0, -5]), text))
            n += 1
    rows += [(7, "s", "en", 1, "same")] * 3 + [(7, "s", "en", 2, "other"), (None, "s", "en", 1, "x"), (None,) * 5]
    rows += [(n, "s", "en", 1, "long " * 100_000), (-3, "s", "de", 1, "below zero")]
    rng.shuffle(rows)
    return rows


COLUMNS = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def shown_column():
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(touched, MK.leaf_of("doc_id", "source", "lang", F.col("n_chars") + 1, "text"))


@pytest.mark.parametrize("step", [2, MK.STEP])
def test_proofs_match_the_plain_tree(spark, step):
    """With two levels a stored level, trees have up to five of them."""
    rows = made_rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    manifest = MK.commit(frame, FIELDS, "doc_id", "lang", shown_column(), step=step)
    got = sorted((tuple(r) for r in MK.proofs(manifest).select(*COLUMNS).collect()), key=repr)
    assert got == slow_manifest(rows, shown_by_rule)
    assert {r[-1] for r in got} == {True, False}
    if step == 2:
        assert len(manifest.trees) == 6  # 305 leaves: 4, 16, 64, 256, 1,024
        stored = sum(level.count() for level in manifest.trees[1:])
        assert stored < len(rows) // 2


def test_a_manifest_opened_again(spark, tmp_path):
    rows = made_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    MK.commit(frame, FIELDS, "doc_id", "lang", folder=str(tmp_path / "m"), step=3)
    manifest = MK.open_manifest(spark, str(tmp_path / "m"), step=3)
    proved = MK.proofs(manifest).select(*COLUMNS).collect()
    assert all(r.verified for r in proved) and len(proved) == len(rows)
    want = slow_manifest(rows, lambda row: None)
    assert sorted((tuple(r) for r in proved), key=repr) == want
    roots = {r.group: (r.leaves, r.subroot) for r in manifest.roots().collect()}
    assert roots["Zz"][0] == 1 and roots[None][0] == 6
    assert manifest.root().collect()[0].root == want[0][3]


def test_any_change_of_a_field_is_seen(spark):
    rows = made_rows()[:60]
    frame = spark.createDataFrame(rows, SCHEMA)
    for shown in (
        MK.leaf_of("doc_id", "lang", "source", "n_chars", "text"),
        MK.leaf_of("doc_id", "source", "lang", "n_chars", F.concat("text", F.lit(" "))),
    ):
        got = MK.proofs(MK.commit(frame, FIELDS, "doc_id", "lang", shown, step=2)).collect()
        assert not any(r.verified for r in got if r.folded_root != r.root)
        assert sum(not r.verified for r in got) > 20


def test_one_row_and_none(spark):
    frame = spark.createDataFrame([(1, "s", "en", 2, "t", "x", "y")], SCHEMA + ", `a.b` string, leaf string")
    (row,) = MK.proofs(MK.commit(frame, FIELDS, "doc_id", "lang")).collect()
    leaf = slow_leaf((1, "s", "en", 2, "t"))
    assert (row.leaf, row.subroot, row.root, row.folded_root, row.path, row.verified) == (leaf, leaf, leaf, leaf, "", True)
    assert row.proof_sha256 == digest("")
    empty = MK.commit(frame.limit(0), FIELDS, "doc_id", "lang")
    assert MK.proofs(empty).count() == 0 and empty.root().count() == 0


def test_names_with_dots(spark):
    frame = spark.createDataFrame([(i, "k", "v") for i in range(5)], "`the.id` bigint, `the.group` string, `a.b` string")
    got = MK.proofs(MK.commit(frame, ["the.id", "a.b"], "the.id", "the.group", step=1)).collect()
    assert len(got) == 5 and all(r.verified for r in got)


def test_a_group_with_most_rows_is_spread(spark):
    """No task gets more than a subtree's rows together."""
    frame = spark.range(0, 5000, 1, 4).selectExpr("id as doc_id", "'en' as lang")
    manifest = MK.commit(frame, ["doc_id"], "doc_id", "lang", step=5)
    assert MK.proofs(manifest).where("verified").count() == 5000
    assert [level.count() for level in manifest.trees] == [5000, 157, 5, 1]


def test_query_on_the_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS)
    got = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, sf).collect()), key=repr)
    assert got == slow_manifest([tuple(r) for r in docs.collect()], shown_by_rule)
