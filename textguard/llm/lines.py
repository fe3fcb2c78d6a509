"""Line dedup with two Bloom filters.

A line's key is the line without white space at both ends and with A-Z in lower case. Keys of at
least ``least_chars`` code points that occur in at least ``least_documents`` documents lose all
their lines except those in the largest ``doc_id`` that holds them.

1. Each task reads its texts and keeps a once-seen and a twice-seen bit array over hashes of the
   keys, a key counting once per document. Two such pairs merge into one by bit operations, in any
   order: once = a | b, twice = A | B | (a & b). Segments of the arrays meet by a shuffle.
2. The twice-seen array, of at most ``most_bits`` bits, goes to all tasks. A key found in several
   documents always passes it; a key found in one passes rarely. Only lines that pass are shuffled.
   With more lines than the array can hold, more of them pass; the result stays exact.
3. The passing lines are grouped by their text for the exact count and the largest document, and
   the decisions go back to the documents by ``doc_id``.

Rows that share a ``doc_id`` are one document with several parts: the key counts once, and all
parts keep or lose its lines together. A NULL ``doc_id`` counts as one document, smaller than any
other. A NULL or empty text is one empty line. An empty table gives an empty table. Lines of a
very long text are handled one slice of rows at a time; other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.columns import others
from textguard.llm.scratch import written
from textguard.llm.words import slices

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
SPACE = " \t\n\v\f\r"
#: Bits of the filter per expected line, bits set per key, bits in a segment.
BITS_PER_LINE = 16
PROBES = 2
SEGMENT_BITS = 1 << 20
#: 64 MB for each of the two arrays.
MOST_BITS = 1 << 29
NO_ID = -(1 << 63)

def key_of(line: str) -> bytes:
    """The key's UTF-8 bytes; of bytes only A-Z have a lower case."""
    return line.encode().strip(SPACE.encode()).lower()


def keys_of(texts: pa.Array, least_chars: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(row, index, keys)``: the distinct keys, and each text's own, once, by index."""
    lines = pc.split_pattern(texts.fill_null(""), "\n")
    row = pc.list_parent_indices(lines).to_numpy()
    flat = lines.flatten()
    able = pc.greater_equal(pc.binary_length(flat), least_chars)
    trimmed = pc.ascii_lower(pc.ascii_trim(flat.filter(able), characters=SPACE))
    long = pc.greater_equal(pc.utf8_length(trimmed), least_chars)
    row = row[able.to_numpy(zero_copy_only=False)][long.to_numpy(zero_copy_only=False)]
    coded = trimmed.filter(long).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    own = np.unique(row.astype(np.int64) * size + coded.indices.to_numpy())
    return own // size, own % size, coded.dictionary


def probes(keys: list[str], bits: int) -> np.ndarray:
    """``PROBES`` bit positions per key, one column each; ``bits`` is a power of two."""
    digest = xxhash.xxh3_128_digest
    halves = np.frombuffer(b"".join(map(digest, keys)), np.uint64).reshape(-1, 2)
    return (halves & np.uint64(bits - 1)).astype(np.int64)


class SeenBits:
    """The once-seen and twice-seen arrays, by segment; a segment is made when first needed."""

    def __init__(self, bits: int):
        self.bits = bits
        self.width = min(bits, SEGMENT_BITS)
        self.once: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(self.width // 8, np.uint8))
        self.twice: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(self.width // 8, np.uint8))

    def add(self, positions: np.ndarray) -> None:
        """Count one more key at each position."""
        values, counts = np.unique(positions, return_counts=True)
        segments = values // self.width
        for segment in np.unique(segments):
            here = segments == segment
            inside = values[here] % self.width
            self.merge(segment, _bits(inside, self.width), _bits(inside[counts[here] > 1], self.width))

    def merge(self, segment: int, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice[segment] |= twice | (self.once[segment] & once)
        self.once[segment] |= once


def _bits(positions: np.ndarray, width: int) -> np.ndarray:
    flags = np.zeros(width, np.uint8)
    flags[positions] = 1
    return np.packbits(flags)


def twice_seen(documents: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """``(segment, twice)``: the twice-seen array of all documents, compressed by segment."""

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenBits(bits)
        for part in slices(batches, "text"):
            _, index, keys = keys_of(part.column("text"), least_chars)
            if len(keys):
                # the probes of one key may fall together: they count once
                spots = np.sort(probes(keys.to_pylist(), bits), axis=1)
                fresh = np.ones(spots.shape, bool)
                fresh[:, 1:] = spots[:, 1:] != spots[:, :-1]
                seen.add(spots[index][fresh[index]])
        yield from _packed(seen)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = SeenBits(bits)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                seen.merge(row["segment"], *(np.frombuffer(unpack(row[c]), np.uint8) for c in ("once", "twice")))
        yield from _packed(seen)

    def _packed(seen: SeenBits) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for segment in list(seen.once):
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([int(segment)], pa.int32()),
                    "once": [pack(seen.once[segment].tobytes())],
                    "twice": [pack(seen.twice[segment].tobytes())],
                }
            )

    schema = "segment int, once binary, twice binary"
    found = documents.select("text").mapInArrow(collect, schema)
    # one row per task and segment; a reducer holds only its own segments
    return found.repartition("segment").mapInArrow(merge, schema).select("segment", "twice")


def filter_bits(documents: DataFrame, most_bits: int) -> int:
    """A power of two with room for a line per 64 bytes of text, at most ``most_bits``."""
    size = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(1 << 10, size // 64 * BITS_PER_LINE)
    return min(most_bits, 1 << (wanted - 1).bit_length())


def suspects(documents: DataFrame, shared: Broadcast, bits: int, least_chars: int) -> DataFrame:
    """``(doc, key)`` for each document's keys that pass the twice-seen array."""

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        array = np.zeros(bits // 8, np.uint8)
        width = min(bits, SEGMENT_BITS) // 8
        for segment, packed in shared.value.items():
            array[segment * width : (segment + 1) * width] = np.frombuffer(unpack(packed), np.uint8)
        for part in slices(batches, "text"):
            row, index, keys = keys_of(part.column("text"), least_chars)
            if not len(keys):
                continue
            spots = probes(keys.to_pylist(), bits)
            hit = ((array[spots >> 3] >> (7 - (spots & 7)).astype(np.uint8)) & 1).all(axis=1)[index]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc").take(pa.array(row[hit])), keys.take(pa.array(index[hit]))], ["doc", "key"]
            )

    return documents.select("doc", "text").mapInArrow(passing, "doc bigint, key string")


def drop_repeated_lines(
    documents: DataFrame,
    least_chars: int = LEAST_CHARS,
    least_documents: int = LEAST_DOCUMENTS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """The rows with repeated lines taken out of ``text``, and ``n_lines`` and ``n_dropped``."""
    spark = documents.sparkSession
    new = ("text", "n_lines", "n_dropped")
    rows = documents.select(
        F.struct(*others(documents, *new)).alias("_row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        "text",
    )
    bits = filter_bits(documents, most_bits)
    twice = {row.segment: bytes(row.twice) for row in twice_seen(documents, bits, least_chars).toLocalIterator()}
    shared = spark.sparkContext.broadcast(twice)
    candidates = written(suspects(rows, shared, bits, least_chars).distinct(), "line-suspects")
    repeated = (
        candidates.groupBy("key")
        .agg(F.count("*").alias("documents"), F.max("doc").alias("keeper"))
        .where(F.col("documents") >= least_documents)
        .select("key", "keeper")
    )
    repeated = written(repeated, "repeated-lines")  # so that the join below can be split at a hot line
    losing = (
        candidates.join(repeated, "key")
        .where(F.col("doc") != F.col("keeper"))
        .groupBy("doc")
        .agg(F.collect_list("key").alias("losing"))
    )

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            whole = part.column("text").fill_null("")
            texts, losing = whole.to_pylist(), part.column("losing").to_pylist()
            dropped = np.zeros(len(texts), np.int64)
            for i, gone in enumerate(losing):
                if gone:
                    gone, lines = {key.encode() for key in gone}, texts[i].split("\n")
                    kept = [line for line in lines if key_of(line) not in gone]
                    texts[i], dropped[i] = "\n".join(kept), len(lines) - len(kept)
            totals = pc.add(pc.count_substring(whole, "\n"), 1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), pa.array(texts, pa.string()), totals, pa.array(dropped)],
                ["_row", "text", "n_lines", "n_dropped"],
            )

    whole = rows.join(losing, "doc", "left").select("_row", "text", "losing")
    schema = rows.select("_row").schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")
    done = whole.mapInArrow(rewrite, schema)
    kept_order = ["_row.*", "text", "n_lines", "n_dropped"]
    return done.select(*kept_order)


