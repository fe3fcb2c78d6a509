import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from textguard.llm import sketch

rng = random.Random(8)
VOCABULARY = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(900)]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows():
    texts = [prose(n) for n in (0, 1, 3, 5, 9, 80, 400, 400, 3000, 9000)] + [None, "", "é" * 7, "\n\n"]
    texts += texts[5:8]
    return [(doc * 1000, text, doc) for doc, text in enumerate(texts)]


@pytest.mark.parametrize("range_bytes", [2_000, 1 << 24])
def test_successors_edits_and_estimates(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(sketch, "RANGE_BYTES", range_bytes)
    given = rows()
    frame = spark.createDataFrame(given, "doc_id bigint, text string, range int").repartition(4)
    found = {r.doc_id: r for r in sketch.compare(frame).collect()}
    assert len(found) == len(given)
    for k, (doc, text, mark) in enumerate(given):
        text, following = text or "", given[(k + 1) % len(given)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = found[doc]
        assert (r.n_chars, r.range) == (len(text), mark)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        words, others = text.split(), changed.split()
        exact = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        a, b = exact(words), exact(others)
        assert int(r.fingerprint.split(":")[0]) == len(a)
        assert int(r.edited_fingerprint.split(":")[0]) == len(b)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(a) > 300:
            assert r.near_edited == pytest.approx(len(a & b) / min(len(a), len(b)), abs=0.2)
    assert found[5000].fingerprint == found[14000].fingerprint


def test_containment_between_unequal_texts_and_merging():
    whole = prose(20_000).split()
    part = whole[4_000:6_000]
    big, small, rest = sketch.sketches(pa.array([" ".join(whole), " ".join(part), prose(1000)]))
    assert sketch.likeness(big, small) == 1 and sketch.likeness(big, rest) == 0
    parts = sketch.sketches(pa.array([" ".join(whole[:10_004]), " ".join(whole[10_000:])]))
    assert (sketch.merged(*sketch.at_common(*parts)) == big.kept).all()
    assert len(big.kept) == pytest.approx(20_000 / sketch.FRACTION, rel=0.1) and (np.diff(big.kept.astype(object)) > 0).all()
    for one in (big, small, rest, *parts):
        again = sketch.read_back(sketch.written_out(one))
        assert (again.distinct, again.sequence, again.threshold) == (one.distinct, one.sequence, one.threshold)
        assert (again.kept == one.kept).all()


@pytest.mark.parametrize("length, deviation", [(60, 0), (200, 0.06), (1_000, 0.06), (4_000, 0.06), (20_000, 0.03)])
def test_error_against_exact_containment(length, deviation):
    """Half, a quarter and all but a tenth of a text kept: mean square error by length class."""
    errors = []
    for share in (0.25, 0.5, 0.9) * 8:
        words = prose(length).split()
        other = words[: int(share * length)] + prose(length - int(share * length)).split()
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words, other))
        got = sketch.likeness(*sketch.sketches(pa.array([" ".join(words), " ".join(other)])))
        errors.append(got - len(a & b) / min(len(a), len(b)))
    assert np.sqrt(np.mean(np.square(errors))) <= 1.4 * deviation + 1e-9


def test_fingerprints_are_small():
    for length in (2_200, 5_000, 40_000):
        text = prose(length)
        assert len(text) > 10_000
        assert len(sketch.written_out(sketch.sketches(pa.array([text]))[0])) < 0.05 * len(text.encode())


def test_few_rows_repeats_and_nulls(spark):
    schema = "doc_id bigint, text string, fingerprint string"
    one = sketch.compare(spark.createDataFrame([(1, "a b", "x")], schema))
    assert [(r.doc_id, r.near_next) for r in one.collect()] == [(1, 1.0)]
    assert sketch.compare(spark.createDataFrame([], schema)).count() == 0
    many = [(1, "a b c", "x")] * 3 + [(None, None, None)] * 2 + [(0, "q", "y")]
    found = sketch.compare(spark.createDataFrame(many, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in found) == [(False, 0, 1), *[(False, 1, 5)] * 3, *[(True, 0, 0)] * 2]
    edits = sorted(r.edited_sha256 for r in found if r.doc_id == 1)
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for t in ("a ba ", "a ba ", "a b"))
    assert edits == want


def test_short_texts_have_their_own_fingerprints_and_exact_containment(spark):
    texts = [prose(n) for n in [1, 2, 3, 4, 5, 6, 8, 12, 20, 40, 80, 160, 640] * 8] + [prose(6_000), ""]
    texts += [" ".join(texts[-2].split()[k : k + n]) for k, n in ((0, 3), (70, 9), (900, 30), (50, 700))] + [prose(6_000), "\t"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in sketch.compare(frame).collect()}
    prints = {}
    for doc, text in enumerate(texts):
        prints.setdefault(found[doc].fingerprint, set()).add(tuple(text.split()))
    assert all(len(words) == 1 for words in prints.values())
    exact = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for doc, text in enumerate(texts):
        following = texts[(doc + 1) % len(texts)]
        half = len(text) // 2
        for other, near in ((text[: len(text) - half] + following[:half], "near_edited"), (following, "near_next")):
            a, b = exact(text.split()), exact(other.split())
            want = len(a & b) / min(len(a), len(b)) if a and b else float(a == b)
            if max(len(a), len(b)) <= sketch.LEAST:
                assert found[doc][near] == pytest.approx(want, abs=1e-9), (doc, near)
            pair = map(sketch.read_back, (found[doc].fingerprint, found[doc].edited_fingerprint))
            if near == "near_edited":
                assert found[doc][near] == sketch.likeness(*pair)
            else:
                successor = found[(doc + 1) % len(texts)].fingerprint
                assert found[doc][near] == sketch.likeness(next(pair), sketch.read_back(successor))


def test_names_with_dots(spark):
    rows = spark.createDataFrame([(1, "a b", 7)], ["doc_id", "text", "a.b"])
    assert sketch.compare(rows).first()["a.b"] == 7
