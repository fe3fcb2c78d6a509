import dataclasses
import random
import zlib

import numpy as np
import pyarrow as pa

from textguard.llm import toxicity


def test_terms_are_the_distinct_bare_words():
    rows, buckets = toxicity.terms(pa.array(["Idiot, idiot! \"idiot\" x", None, "... !!", "x\ty X."]))
    assert rows.tolist() == [0, 0, 3, 3]
    assert set(buckets[:2]) & set(buckets[2:]) and len(set(buckets.tolist())) == 3


def corpus(n=3000):
    """Toxic only if an insult meets a group: neither says anything alone."""
    rng = random.Random(1)
    fill = [f"w{i}" for i in range(200)]
    rows = []
    for doc in range(n):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        words = rng.choices(fill, k=12) + ["nasty"] * insult + ["folk"] * group
        rng.shuffle(words)
        rows.append((doc, " ".join(words), int(insult and group)))
    return rows


def test_pairs_are_learned_and_held_out_rows_are_not_used(spark):
    rows = corpus()
    flipped = [(d, t, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, t, y in rows]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    documents, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    machine = toxicity.fit(documents, labels)
    other = toxicity.fit(documents, spark.createDataFrame(flipped, frame.schema).select("doc_id", "toxic"))
    assert machine.slots == other.slots and np.allclose(machine.linear, other.linear)
    truth = {d: y for d, _, y in rows}
    found = toxicity.apply(documents, machine).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_pairs_of_terms_that_tell_nothing_alone(spark):
    """Toxic where one of two words is there and the other is not: no single term helps."""
    rng = np.random.default_rng(3)
    filler = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]
    rows = []
    for doc in range(3_000):
        one, other = (rng.random(2) < 0.5).tolist()
        words = rng.choice(filler, 20).tolist() + ["zuvo"] * one + ["wyxk"] * other
        rows.append((doc, " ".join(words), int(one != other)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    documents = frame.select("doc_id", "text")
    machine = toxicity.fit(documents, frame.select("doc_id", "toxic"))
    flat = dataclasses.replace(machine, factors=np.zeros_like(machine.factors))

    def accuracy(m):
        found = toxicity.apply(documents, m, 0.5).where("held_out").collect()
        return np.mean([r.predicted == rows[r.doc_id][2] for r in found])

    assert accuracy(flat) < 0.6
    assert accuracy(machine) > accuracy(flat) + 0.15


def test_names_with_dots(spark):
    documents = spark.createDataFrame([(1, "a b", 7)], ["doc_id", "text", "a.b"])
    machine = toxicity.Machine({}, 0.0, np.zeros(0), np.zeros((0, 4)))
    assert toxicity.apply(documents, machine).first()["a.b"] == 7


def test_scores_equal_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    machine = toxicity.Machine({10: 0, 20: 1, 30: 2}, -0.5, rng.normal(size=3), rng.normal(size=(3, 4)))
    score = machine.scores(np.array([0, 0, 0, 1, 2]), np.array([10, 20, 30, 20, 99]), 4)
    raw = [machine.bias] * 4
    raw[0] += machine.linear.sum() + sum(machine.factors[i] @ machine.factors[j] for i in range(3) for j in range(i))
    raw[1] += machine.linear[1]
    assert np.allclose(score, 1 / (1 + np.exp(-np.array(raw))))


def test_nulls_repeats_clashes_and_no_labels(spark):
    rows = [(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None), (6, "", 1, "y")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, score int, toxic string")
    labels = spark.createDataFrame([(1, None), (None, 1), (6, 0)], "doc_id bigint, toxic int")
    machine = toxicity.fit(documents, labels)
    done = toxicity.apply(documents, machine)
    assert done.columns == ["doc_id", "toxic", "held_out", "score", "predicted"]
    assert len({r.score for r in done.collect()}) == 1 and done.count() == 4
    assert toxicity.apply(documents.limit(0), toxicity.fit(documents.limit(0), labels.limit(0))).count() == 0


def test_held_out_accuracy_on_the_tables(spark, sf):
    documents = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    done = toxicity.apply(documents, toxicity.fit(documents, labels)).join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in done.groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 1 and counts[1, 1] >= counts.get((1, 0), 0)


def test_rare_and_unseen_forms_of_an_insult_are_found(spark):
    rng = random.Random(4)
    fill = [f"{rng.choice('bdfgkl')}{rng.choice('aeiou')}{i}" for i in range(300)]
    endings = ["".join(rng.choice("aeioulnrst") for _ in range(3)) for _ in range(400)]
    rows = []
    for doc in range(3000):
        toxic = rng.random() < 0.1
        words = rng.choices(fill, k=20) + ["grobian" + rng.choice(endings)] * toxic
        rng.shuffle(words)
        rows.append((doc, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    found = toxicity.apply(frame, machine).where("held_out").select("doc_id", "predicted").collect()
    truth = {d: y for d, _, y in rows}
    assert sum(r.predicted for r in found if truth[r.doc_id]) > 0.95 * sum(truth[r.doc_id] for r in found)
    assert sum(r.predicted for r in found if not truth[r.doc_id]) <= 2


def test_every_term_of_two_documents_is_an_input(spark):
    rows = [(doc, f"common pair{doc // 2} once{doc}", doc % 2) for doc in range(80)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    kept = [doc for doc, _, _ in rows if zlib.crc32(str(doc).encode()) % 4 != 2]
    both = [d for d in kept if d % 2 == 0 and d + 1 in kept]
    names = toxicity.word_buckets(pa.array(["common", *[f"pair{d // 2}" for d in both]]))
    assert len(both) > 5 and set(names.tolist()) <= set(machine.slots)


def test_factors_do_not_upset_what_single_terms_tell():
    """Rows of a thousand terms in many batches, one term telling all: factors must not cost a decision."""
    rng = np.random.default_rng(0)
    batches, seen, hits = [], np.zeros(20_000, int), np.zeros(20_000, int)
    for _ in range(10):
        label = (rng.random(300) < 0.1).astype(float)
        terms = [np.unique(np.append(rng.zipf(1.3, 3_000) % 19_999 + 1, [0] * int(y)).astype(int)) for y in label]
        row, slot = np.repeat(np.arange(300), [len(t) for t in terms]), np.concatenate(terms)
        seen += np.bincount(slot, minlength=20_000)
        hits += np.bincount(slot[label[row] > 0], minlength=20_000)
        batches.append(toxicity.batch_of(label, row.astype(np.int32), slot.astype(np.int32)))
    rate = hits[0] / 3_000
    bias, linear, factors = toxicity.learned(batches, toxicity.scales(seen, hits, rate), rate)

    def loss(vectors):
        machine = toxicity.Machine(dict(zip(range(20_000), range(20_000), strict=True)), bias, linear, vectors)
        scores = [machine.scores(b.row, b.slot, 300) for b in batches]
        wrong = sum(((s >= toxicity.THRESHOLD) != (b.label > 0)).sum() for s, b in zip(scores, batches, strict=True))
        likely = [np.where(b.label > 0, s, 1 - s) for s, b in zip(scores, batches, strict=True)]
        return wrong, -np.log(np.clip(np.concatenate(likely), 1e-12, 1)).sum()

    assert loss(factors)[0] <= loss(0 * factors)[0] + 3
    assert loss(factors)[1] <= loss(0 * factors)[1] + 1e-6
