"""Document fingerprints by a threshold-scaled sketch.

A five-word shingle is named by ``BITS`` bits of a hash. The sketch of a text keeps the names below a
fixed fraction of their range, one in ``FRACTION``, and of a text with fewer than ``LEAST`` such names
its ``LEAST`` smallest, all of them if there are no more. A text of fewer than five words has one
shingle, its whole word sequence, a text without words none. A sketch is complete below its threshold:
that of the fraction, or the largest name kept, or none if all are kept. Two sketches are compared, and
merged by union, at the smaller of their two thresholds, so that the sketch of a small text is found
again in that of a large one. Likeness is the share of the smaller set found in the larger, an estimate
of containment that does not suffer from unequal sizes, from the two fingerprints alone. It is exact
where both texts have at most ``LEAST`` shingles, rests on about ``LEAST`` names or more where the texts
are of like sizes (standard error 0.06 or less), and on one name in ``FRACTION`` of the smaller text
beside a long one. Where nothing is left below the common threshold, likeness is 1 for equal word
sequences and 0 otherwise. A fingerprint is ``<distinct shingles>:<kept names, base64>:<hash of the
word sequence>``, so that unequal word sequences have unequal fingerprints.

``compare`` fingerprints every text, the text edited by its successor's beginning, and says how
near both and the successor are. The successor is the next row by ascending ``doc_id``, equal ids by
a hash of their texts, NULL ids last, and the first row after the last. Rows are dealt to ranges of
ids whose bounds come from a quantile summary; the first row of a range is also sent to the end of
the range before, so that each text is shuffled once and no range waits for another.

A NULL text counts as empty. A single row is its own successor. Repeated rows succeed each other.
An empty table gives an empty table. Other columns pass through under any names but those of the new columns.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.columns import others
from textguard.llm.words import Rolling, slices, word_names, words_of

SHINGLE = 5
FRACTION = 32
LEAST = 64
BITS = 40  # of a shingle's name; five bytes of a fingerprint
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000
LAST_ID = (1 << 63) - 1
LIMIT = (1 << BITS) // FRACTION
ALL = 1 << BITS
NEW = "n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()


class Sketch(NamedTuple):
    distinct: int
    kept: np.ndarray
    sequence: int

    @property
    def threshold(self) -> int:
        """All names of the text below it are kept."""
        if self.distinct == len(self.kept):
            return ALL
        return max(LIMIT, int(self.kept[-1]) + 1)


def sketches(texts: pa.Array) -> list[Sketch]:
    """For each text, the number of distinct shingles, the sorted kept names and a hash of all words in order."""
    flat, bounds = words_of(texts)
    counts = np.diff(bounds)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    ends = np.cumsum(shingles)
    if not len(flat):
        return [Sketch(0, np.zeros(0, np.uint64), 0)] * len(counts)
    names = word_names(flat, 0)
    row = np.repeat(np.arange(len(counts)), shingles)
    start = np.arange(ends[-1]) - np.repeat(ends - shingles, shingles) + bounds[row]
    stop = np.minimum(start + SHINGLE, bounds[row + 1])
    found = Rolling(names, 0)(start, stop) >> np.uint64(64 - BITS)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    fresh = np.append(True, (found[1:] != found[:-1]) | (row[1:] != row[:-1]))
    found, row = found[fresh], row[fresh]
    distinct = np.bincount(row, minlength=len(counts))
    rank = np.arange(len(row)) - (np.cumsum(distinct) - distinct)[row]
    kept = (found < LIMIT) | (rank < LEAST)
    cuts = np.cumsum(np.bincount(row[kept], minlength=len(counts)))
    sequences = np.where(counts > 0, Rolling(names, 1)(bounds[:-1], bounds[1:]), np.uint64(0))
    return list(map(Sketch, distinct.tolist(), np.split(found[kept], cuts[:-1]), sequences.tolist()))


def written_out(sketch: Sketch) -> str:
    low = np.ascontiguousarray(sketch.kept.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return f"{sketch.distinct}:{base64.b64encode(low.tobytes()).decode()}:{sketch.sequence:016x}"


def read_back(fingerprint: str) -> Sketch:
    distinct, names, sequence = fingerprint.split(":")
    low = np.frombuffer(base64.b64decode(names), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, : BITS // 8] = low
    return Sketch(int(distinct), wide.reshape(-1).view("<u8").astype(np.uint64), int(sequence, 16))


def at_common(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """The names of both below the smaller of their two thresholds."""
    limit = np.uint64(min(a.threshold, b.threshold))
    return a.kept[: np.searchsorted(a.kept, limit)], b.kept[: np.searchsorted(b.kept, limit)]


def likeness(a: Sketch, b: Sketch) -> float:
    one, other = at_common(a, b)
    least = min(len(one), len(other))
    if not least:
        return float(a.distinct == b.distinct and a.sequence == b.sequence)
    return len(np.intersect1d(one, other, assume_unique=True)) / least


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kept names of two parts together, both at one threshold (``at_common``)."""
    return np.union1d(a, b)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, role and place; a row's successor comes right after it."""
    held: pa.RecordBatch | None = None
    for part in slices(batches, "text"):
        rows = pa.Table.from_batches([held, part] if held else [part]).combine_chunks().to_batches()[0]
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows > 1:
            yield _compared(rows)


def _compared(rows: pa.RecordBatch) -> pa.RecordBatch:
    near = rows.column("range").to_numpy(), rows.column("ahead").to_numpy(zero_copy_only=False)
    has = np.flatnonzero((near[0][1:] == near[0][:-1]) & ~near[1][:-1])
    texts = [text or "" for text in rows.column("text").to_pylist()]
    changed = [edited(texts[i], texts[i + 1]) for i in has.tolist()]
    own = sketches(pa.array(texts, pa.string()))
    other = sketches(pa.array(changed, pa.string()))
    columns = {
        "_row": rows.column("_row").take(pa.array(has)),
        "n_chars": pa.array([len(texts[i]) for i in has.tolist()], pa.int64()),
        "edited_sha256": [hashlib.sha256(text.encode()).hexdigest() for text in changed],
        "fingerprint": [written_out(own[i]) for i in has.tolist()],
        "edited_fingerprint": [written_out(sketch) for sketch in other],
        "near_edited": pa.array(
            [likeness(own[i], sketch) for i, sketch in zip(has.tolist(), other, strict=True)], pa.float64()
        ),
        "near_next": pa.array([likeness(own[i], own[i + 1]) for i in has.tolist()], pa.float64()),
    }
    columns = {n: c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for n, c in columns.items()}
    return pa.RecordBatch.from_pydict(columns)


def in_ranges(rows: DataFrame) -> DataFrame:
    """``rows(_row, at, text)`` dealt to sorted ranges of ``at``, with the row that follows each range."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = int(max(1, min(MOST_RANGES, size // RANGE_BYTES)))
    probe = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("at", F.array(*map(F.lit, probe)), 10 * ranges)).first()[0] if probe else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def range_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), side="right").astype(np.int32))

    firsts = rows.select("at", range_of("at").alias("range")).groupBy("range").agg(F.min("at").alias("first")).collect()
    firsts = sorted((r.range, r.first) for r in firsts)  # one row a range
    before = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}

    @F.pandas_udf("array<struct<range:int,ahead:boolean>>")
    def places(at: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, at.to_numpy(), side="right")
        return pd.Series(
            [
                [{"range": int(r), "ahead": False}, *([{"range": before[a], "ahead": True}] if a in before else [])]
                for r, a in zip(own, at.tolist(), strict=True)
            ]
        )

    dealt = rows.select("*", F.explode(places("at")).alias("_place")).select("_row", "at", "text", "_place.*")
    return dealt.repartition("range").sortWithinPartitions("range", "ahead", "at", F.xxhash64("text"))


def compare(documents: DataFrame) -> DataFrame:
    """Each row with the columns ``NEW``."""
    rows = documents.select(
        F.struct(*others(documents, "text", *NEW)).alias("_row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("at"), "text"
    )
    schema = rows.select("_row").schema.add("n_chars", "long")
    for name in NEW[1:4]:
        schema = schema.add(name, "string")
    for name in NEW[4:]:
        schema = schema.add(name, "double")
    return in_ranges(rows).select("_row", "text", "range", "ahead").mapInArrow(_pairs, schema).select("_row.*", *NEW)
