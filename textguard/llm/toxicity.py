"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, small letters, without marks at both ends, hashed into
``BUCKETS`` buckets, and the runs of ``GRAM`` characters of these words with their two edges, so that
unseen inflected forms share terms with seen ones. Every bucket that ``LEAST_DOCUMENTS`` documents of
the training sample hold is an input of the machine, whatever it tells about the label: presence, a
weight, and for every pair the inner product of two learned vectors, so that two harmless terms can be
toxic together.

The machine is fitted by gradient steps (Adam) over batches of rows, on a bounded sample, the
``SAMPLE`` labelled training rows that come first by a hash of their id: bias and weights first, then
the vectors beside them, from what the single terms leave unexplained. A step of the vectors is bounded by
what it does to whole rows (``REACH``): a row's pairs grow with the square of its terms, and steps that are
small for each of a thousand terms would upset it. Squares add to the loss: of
weights the less, the clearer a term's own relation to the label is, and for no term without bound; of
vectors for all terms alike, so that terms that tell nothing alone can tell something together. Every text is scored whole. Labels come only from rows whose crc32(doc_id as text) mod
4 is not 2; labels, lang, source and doc_id are no inputs of a score.

A NULL or blank text has no terms and gets the machine's score for none. A NULL ``doc_id`` is never
held out and has no label. Labels that are NULL are left out; a document labelled more than once
counts as toxic if any label says so. With labels of one class or none, every text gets the same
score, the smoothed share of toxic labels. Repeated rows are scored each, an empty table gives an
empty table, other columns pass through unless they carry the names of new columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.columns import others
from textguard.llm.scratch import written
from textguard.llm.words import mixed, numbered, row_of_word, slices, word_names, words_of

BUCKETS = 1 << 22
GRAM = 5
SAMPLE = 20_000
#: A bucket must occur in so many documents of the sample: what one document holds says nothing of others.
LEAST_DOCUMENTS = 2
FACTORS = 4
STEPS = 120
BATCH = 2048
RATE = 0.02
#: A step moves the rows' sums of factors by so much at most (root mean square), falling to none at the last step.
REACH = 0.2
#: That is measured on so many rows of a batch; they come in the order of a hash.
PROBE = 256
#: Shares of the learned factors of which that with the least mean loss is kept.
SHARES = (1, 0.5, 0.25, 0.125, 0)
#: Weight of the squares of linear weights, for a term of scale 1, and of factors in the mean loss.
SHRINK = (1e-4, 1e-2)
#: A term's linear scale is (z / FULL) to this power, z its z-score and FLOOR at least.
POWER = 2
FULL, FLOOR = 4.0, 0.5
THRESHOLD = 0.3
MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_"
NEW = ("held_out", "score", "predicted")


@dataclass(frozen=True)
class Machine:
    """``score = sigmoid(bias + sum(linear) + sum of pairwise products of factors)``."""

    slots: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def table(self) -> tuple[np.ndarray, float, np.ndarray]:
        """Sorted buckets, bias, and a row of linear weight and factors for each bucket."""
        wanted = np.array(sorted(self.slots), np.int64)
        slots = np.array([self.slots[b] for b in wanted.tolist()], np.int64)
        return wanted, self.bias, np.column_stack((self.linear[slots], self.factors[slots]))

    def scores(self, rows: np.ndarray, buckets: np.ndarray, count: int) -> np.ndarray:
        """For ``count`` texts whose distinct buckets are given as flat pairs."""
        return scores_from(self.table(), rows, buckets, count)


def scores_from(table: tuple[np.ndarray, float, np.ndarray], rows: np.ndarray, buckets: np.ndarray, count: int) -> np.ndarray:
    wanted, bias, weights = table
    raw = np.full(count, bias)
    if len(wanted) and len(buckets):
        at = np.minimum(np.searchsorted(wanted, buckets), len(wanted) - 1)
        hit = wanted[at] == buckets
        row, slot = rows[hit], at[hit]
        raw += np.bincount(row, weights=weights[slot, 0], minlength=count)
        for factor in weights.T[1:]:
            own = factor[slot]
            raw += (np.bincount(row, weights=own, minlength=count) ** 2 - np.bincount(row, weights=own**2, minlength=count)) / 2
    return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def bare_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(pairs, bare)``: row * 2**32 + number of each distinct word of a row, and the words without marks."""
    flat, bounds = words_of(pc.ascii_lower(texts.fill_null("")))
    ids, distinct = numbered(flat)
    return np.unique((row_of_word(bounds) << 32) + ids), pc.utf8_trim(distinct, characters=MARKS)


def word_buckets(bare: pa.Array) -> np.ndarray:
    """The bucket of each word, -1 for an empty one."""
    full = pc.binary_length(bare).to_numpy() > 0
    bucket = np.full(len(bare), -1, np.int64)
    if full.any():
        bucket[full] = (word_names(bare.filter(pa.array(full)), 0) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket


def gram_buckets(bare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(words, buckets)`` of the runs of ``GRAM`` characters, line feeds standing for a word's edges."""
    codes = np.frombuffer("\n".join(["", *bare.to_pylist(), ""]).encode("utf-32-le"), np.uint32)
    edge = codes == 10
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = ~np.lib.stride_tricks.sliding_window_view(edge, GRAM)[:, 1:-1].any(axis=1)
    start = np.flatnonzero(within)
    name = np.zeros(len(start), np.uint64)
    for k in range(GRAM):
        name = mixed(name + codes[start + k] + np.uint64(1))
    return (np.cumsum(edge) - 1)[start], (name % np.uint64(BUCKETS)).astype(np.int64)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, buckets)``: the distinct buckets of each text's words."""
    pairs, bare = bare_words(texts)
    bucket = word_buckets(bare)[pairs & 0xFFFFFFFF]
    pairs = np.unique((pairs >> 32)[bucket >= 0] * BUCKETS + bucket[bucket >= 0])
    return pairs // BUCKETS, pairs % BUCKETS


def inputs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, buckets)``: the distinct buckets of each text's words and of their runs of characters."""
    pairs, bare = bare_words(texts)
    whole = word_buckets(bare)
    word, gram = gram_buckets(bare)
    owner = np.concatenate((np.flatnonzero(whole >= 0), word))
    order = np.argsort(owner, kind="stable")
    bucket = np.concatenate((whole[whole >= 0], gram))[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(bare)))
    ids = pairs & 0xFFFFFFFF
    count = np.diff(ends, prepend=0)[ids]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - ends[ids], count)
    pairs = np.unique(np.repeat(pairs >> 32, count) * BUCKETS + bucket[at])
    return pairs // BUCKETS, pairs % BUCKETS


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample_of(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``(at, toxic, buckets)`` of the sample's documents; ``at`` puts them in a lasting order."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, buckets = inputs(part.column("text"))
            ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("_at"), part.column("_toxic"), lists], ["at", "toxic", "buckets"])

    # at most ``size`` ids and labels go to all tasks
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.xxhash64("doc_id", "text").alias("_at"), "_toxic", "text"
    )
    return written(rows.mapInArrow(encode, "at bigint, toxic int, buckets array<int>"), "toxicity-sample")


@dataclass(frozen=True)
class Batch:
    """Labels of some rows, and their terms by row and by slot; ``starts`` says where each of ``slots`` begins."""

    label: np.ndarray
    row: np.ndarray
    slot: np.ndarray
    row_by_slot: np.ndarray
    slots: np.ndarray
    starts: np.ndarray


def batch_of(label: np.ndarray, row: np.ndarray, slot: np.ndarray) -> Batch:
    order = np.argsort(slot, kind="stable")
    return Batch(label, row, slot, row[order], *np.unique(slot[order], return_index=True))


def fit(documents: DataFrame, labels: DataFrame) -> Machine:
    sample = sample_of(documents, labels)
    counts = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    flat = Machine({}, float(np.log((counts.toxic + 1) / (counts.n - counts.toxic + 1))), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < counts.toxic < counts.n:
        return flat
    seen, hits = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    read, parts = [], -(-counts.n // BATCH)
    for part in range(parts):  # about BATCH rows' labels and buckets pass to the driver at a time
        rows = sample.where(F.pmod("at", F.lit(parts)) == part).toArrow().sort_by("at").combine_chunks()
        label, lists = rows.column("toxic").to_numpy(), rows.column("buckets")
        bucket = pc.list_flatten(lists).to_numpy().copy()
        row = np.repeat(np.arange(len(label), dtype=np.int32), pc.list_value_length(lists).to_numpy())
        seen += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
        hits += np.bincount(bucket[label[row] > 0], minlength=BUCKETS).astype(np.int32)
        if len(label):
            read.append((label.astype(float), row, bucket))
        del rows, lists
        pa.default_memory_pool().release_unused()
    chosen = np.flatnonzero(seen >= LEAST_DOCUMENTS)
    if not len(chosen):
        return flat
    slots = np.full(BUCKETS, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    batches = []
    while read:
        label, row, bucket = read.pop()
        slot = slots[bucket]
        batches.append(batch_of(label, row[slot >= 0], slot[slot >= 0]))
    learnt = learned(batches, scales(seen[chosen], hits[chosen], counts.toxic / counts.n), counts.toxic / counts.n)
    return Machine(dict(zip(chosen.tolist(), range(len(chosen)), strict=True)), *learnt)


def scales(seen: np.ndarray, hits: np.ndarray, rate: float) -> np.ndarray:
    """For each term the scale of its weight, never 0; factors have none."""
    clear = np.abs(hits - seen * rate) / np.sqrt(seen * rate * (1 - rate) + 1)
    return ((np.maximum(clear, FLOOR) / FULL) ** POWER).astype(np.float32)[:, None]


def learned(batches: list[Batch], scale: np.ndarray, rate: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and factors with a small mean log loss, by Adam over batches of rows.

    First bias and weights, then the factors beside them, fixed, so that pairs are learned
    from what the single terms leave unexplained, whatever the terms tell on their own.
    """
    terms = len(scale)
    theta = [np.zeros((terms, 1), np.float32), np.random.default_rng(7).normal(0, 0.01, (terms, FACTORS)).astype(np.float32)]
    bias = np.array([np.log(rate / (1 - rate))])
    fixed = [np.zeros(len(batch.label)) for batch in batches]  # what the weights say of each row
    for stage in (0, 1):
        x, unit = theta[stage], scale if stage == 0 else np.ones((1, 1), np.float32)
        moving = (x,) if stage else (x, bias)
        moments = [(np.zeros_like(y), np.zeros_like(y)) for y in moving]
        for step in range(1, STEPS + 1):
            at = step % len(batches)
            batch, rows = batches[at], len(batches[at].label)
            weights = x * unit
            sums = _sums(batch, weights)
            raw = bias + fixed[at] + (_paired(batch, weights, sums) if stage else sums[:, 0])
            off = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - batch.label) / rows
            through = off[:, None].astype(np.float32) * np.column_stack((np.ones(rows, np.float32), sums))
            slope = np.float32(SHRINK[stage]) * x
            if len(batch.slots):
                gradient = np.add.reduceat(through[batch.row_by_slot], batch.starts, axis=0)
                own = gradient[:, 1:] - weights[batch.slots] * gradient[:, :1] if stage else gradient[:, :1]
                slope[batch.slots] += own * (unit if stage else unit[batch.slots])
            for y, down, (mean, square) in zip(moving, (slope, np.array([off.sum()])), moments):
                mean += 0.1 * (down - mean)
                square += 0.001 * (down**2 - square)
                move = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                if stage:
                    some = np.searchsorted(batch.row, PROBE)
                    probe = replace(batch, label=batch.label[:PROBE], row=batch.row[:some], slot=batch.slot[:some])
                    far = np.sqrt((_sums(probe, move) ** 2).sum(axis=1).mean())
                    move *= np.float32(min(1, REACH * (1 - (step - 1) / STEPS) / max(far, 1e-30)))
                y -= move
        if stage == 0:
            fixed = [_sums(batch, x * unit)[:, 0] for batch in batches]
    paired = [_paired(batch, theta[1], _sums(batch, theta[1])) for batch in batches]
    share = min(SHARES, key=lambda share: sum(
        np.logaddexp(0, (1 - 2 * batch.label) * (bias + alone + share**2 * pairs)).sum()
        for batch, alone, pairs in zip(batches, fixed, paired, strict=True)
    ))
    return float(bias[0]), (theta[0] * scale)[:, 0].astype(float), theta[1].astype(float) * share


def _sums(batch: Batch, weights: np.ndarray) -> np.ndarray:
    """For each row the sum of its terms' rows of ``weights``."""
    sums = np.zeros((len(batch.label), weights.shape[1]), np.float32)
    filled = np.flatnonzero(np.diff(batch.row, prepend=-1))
    if len(filled):
        sums[batch.row[filled]] = np.add.reduceat(weights[batch.slot], filled, axis=0)
    return sums


def _paired(batch: Batch, factors: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """For each row the sum of its pairs' inner products."""
    own = np.bincount(batch.row, weights=(factors**2).sum(axis=1)[batch.slot], minlength=len(batch.label))
    return ((sums**2).sum(axis=1) - own) / 2


def apply(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Each row with ``held_out``, ``score`` and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(machine.table())

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = scores_from(shared.value, *inputs(part.column("text")), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found)], ["_row", "score"])

    rows = documents.select(F.struct(*others(documents, "text", *NEW), held_out().alias("held_out")).alias("_row"), "text")
    scored = rows.mapInArrow(judge, rows.select("_row").schema.add("score", "double"))
    return scored.select("_row.*", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
