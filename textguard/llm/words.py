"""Whole texts as flat arrays of words, a bounded slice of rows at a time.

A word is a longest run of characters other than space, tab, line feed, vertical tab, form
feed and carriage return. A NULL text has no words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: The same words as a Java or SQL pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20

#: Odd multipliers of the 64-bit finaliser (splitmix64).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: Odd bases of the two rolling hashes, and their inverses.
BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASE)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the batches that Spark hands to Python workers small, for tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * SLICE_BYTES))


def slices(
    batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that ``column`` holds about ``size`` bytes in each."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``(flat, bounds)``: the words of text i are ``flat[bounds[i]:bounds[i + 1]]``."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy() > 0
    bounds = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    return (flat if full.all() else flat.filter(pa.array(full))), bounds


def numbered(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``(ids, distinct)``: equal strings have equal ids, ``distinct[id]`` is the string."""
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def row_of_word(bounds: np.ndarray) -> np.ndarray:
    """For each flat word, the row it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def windows_in_rows(bounds: np.ndarray, width: int) -> np.ndarray:
    """Flat positions at which ``width`` consecutive words of one row start."""
    starts = np.arange(bounds[-1], dtype=np.int64)
    return starts[starts + width <= bounds[1:][row_of_word(bounds)]]


def word_names(flat: pa.Array, lane: int) -> np.ndarray:
    """A 64-bit name for each word: a sum of its bytes by keys of their places, mixed."""
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    keys = mixed(np.arange(int(lengths.max()), dtype=np.uint64) * BASE[lane] + BASE[1 - lane])
    products = keys[np.arange(len(data)) - np.repeat(starts, lengths)]
    products *= data.astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(products, starts))


class Rolling:
    """Hashes of any range of a flat name sequence."""

    def __init__(self, names: np.ndarray, lane: int):
        steps = np.full(len(names), BASE[lane], np.uint64)
        steps[:1] = 1
        back = np.full(len(names) + 1, _INVERSE[lane], np.uint64)
        back[:1] = 1
        self.sums = np.append(np.uint64(0), np.cumsum(names * np.cumprod(steps)))
        self.back = np.cumprod(back)

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        ranges = (self.sums[stops] - self.sums[starts]) * self.back[starts]
        return mixed(ranges ^ mixed((stops - starts).astype(np.uint64)))
