import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from textguard.llm import lattice


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(lattice.vocabulary_path())


def all_segmentations(pieces, log, word):
    """Sum of products over every segmentation, by plain recursion, and expected uses of pieces."""
    text = lattice.MARK + word

    def go(at):
        if at == len(text):
            return [(0.0, ())]
        out = []
        spelled = tuple(int(pieces.byte_ids[b]) for b in text[at].encode())
        for rest, used in go(at + 1):
            out.append((sum(log[i] for i in spelled) + rest, (*spelled, *used)))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces.ids:
                i = pieces.ids[text[at:end]]
                out += [(log[i] + rest, (i, *used)) for rest, used in go(end)]
        return out

    found = go(0)
    total = sum(math.exp(weight) for weight, _ in found)
    expected = Counter()
    for weight, used in found:
        for i in used:
            expected[i] += math.exp(weight) / total
    return math.log(total), expected


def test_forward_and_expectation_match_all_segmentations(pieces):
    words = ["a", "the", "hello", "naïve", "日本", "😀x", "ab,c", "q"]
    log = np.log(np.append(pieces.zipf, 0.01) + 1e-300)
    model = lattice.Lattice(pieces, log)
    for own, points, lengths in lattice.batches_of(words, 3):
        sums = model.forward(points, lengths)
        counts = np.arange(1, len(own) + 1)
        used = model.expected(points, lengths, counts)
        want = Counter()
        for row, i in enumerate(own):
            total, expected = all_segmentations(pieces, log, words[i])
            assert sums[row, lengths[row]] == pytest.approx(total, rel=1e-9)
            for piece, amount in expected.items():
                want[piece] += amount * counts[row]
        assert used.sum() == pytest.approx(sum(want.values()))
        assert all(used[piece] == pytest.approx(amount) for piece, amount in want.items())


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_scores_match_the_plain_rules(spark, pieces, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 40)
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("thesandioé", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(vocabulary, range(200, 0, -1), k=rng.choice([0, 1, 30, 200])))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "The THE É \n\tx"), (3, rows[3][1]), (None, "no id here"), (63, "z" * 700), (64, rows[5][1] * 30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = lattice.score(frame).collect()
    held = lambda doc: doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
    counts, ends = Counter(), 0
    for doc, text in rows:
        if not held(doc):
            counts.update(lower(text).split())
            ends += 1
    total, types = sum(counts.values()) + ends, len(counts) + 1
    counts_of = {**counts, None: ends}
    want = []
    for doc, text in rows:
        words = [*lower(text).split(), None]
        base = sum(math.log10((counts_of.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in words)
        want.append((doc is None, doc or 0, held(doc), len(words), sum(counts_of.get(w, 0) > 0 for w in words), total, round(base, 5)))
    got = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found]
    assert sorted(got) == sorted(want)
    # the score of a text is that of its words, and an end
    import pyspark.sql.functions as F

    words = spark.createDataFrame([(w, c) for w, c in counts.items()], "word string, known bigint")
    log = lattice.fit(words, ends, pieces)
    assert np.exp(log[np.isfinite(log)]).sum() == pytest.approx(1)
    model = lattice.Lattice(pieces, log)
    every = sorted({w for _, text in rows for w in lower(text).split()})
    weight = {}
    for own, points, lengths in lattice.batches_of(every):
        weight.update({every[i]: s[n] for i, s, n in zip(own, model.forward(points, lengths), lengths, strict=True)})
    scores = {r.doc_id: r.score for r in found}
    for doc, text in rows:
        assert scores[doc] == pytest.approx((sum(weight[w] for w in lower(text).split()) + log[-1]) / math.log(10), rel=1e-6)
    assert F is not None


def test_training_helps_held_out_text(spark, sf, pieces):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    fitted = lattice.score(rows).where("held_out").selectExpr("sum(score) s").first().s
    plain = lattice.EM_ROUNDS
    lattice.EM_ROUNDS = 0
    try:
        unfitted = lattice.score(rows).where("held_out").selectExpr("sum(score) s").first().s
    finally:
        lattice.EM_ROUNDS = plain
    assert fitted > 0.9 * unfitted and fitted > unfitted


def test_empty_table(spark):
    assert lattice.score(spark.createDataFrame([], "doc_id bigint, text string, word string")).count() == 0
