"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprint: words of the text with A-Z in lower case, three-word shingles with repeats (fewer
words: the whole sequence; none: fingerprint zero), XXH64 with seed 42 of each shingle; a bit is
set when it is set in more than half of the hashes. Two fingerprints link when they differ in at
most two bits; a component is named by its smallest ``doc_id``.

Two bits touch at most two of the eight bytes, so linked fingerprints share at least six bytes at
their positions. The index works on distinct fingerprints, copies having been folded before:

1. The eight positions form four couples; linked fingerprints agree on at least two couples, that
   is on one of six postings of four positional bytes.
2. Postings with up to ``SHORT_LIST`` fingerprints give their pairs. The shared positional bytes
   of each pair are tallied over all eight positions, pairs under six are dropped, the rest are
   verified by their differing bits.
3. Longer postings, which groups of near copies cause, give no pairs. Their fingerprints are keyed
   by every fingerprint one bit away: two fingerprints are at most two bits apart exactly when they
   share such a key, and all that share one are linked, so that one link to the smallest is enough.
   This loses no link and needs 65 rows a fingerprint whatever the size of the group.

A NULL or blank text has fingerprint zero and is linked like any other. Rows with a NULL ``doc_id``
are fingerprinted and linked; a component that has no other ``doc_id`` has a NULL name. Repeated
rows keep their rows. Other columns pass through unless they carry the names of new columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.columns import named, others
from textguard.llm.components import connected
from textguard.llm.scratch import written
from textguard.llm.words import slices

SHINGLE = 3
SEED = 42
MOST_BITS_APART = 2
LEAST_SHARED_BYTES = 8 - MOST_BITS_APART
SHORT_LIST = 32


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    # bytes.lower and bytes.split know ASCII only, as the rules want it
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = [0, *ends[:-SHINGLE].tolist()]
    stops = (ends[SHINGLE - 1 :] - 1).tolist() if len(words) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    found = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)), np.uint64, len(stops))
    counts = np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        found = np.array([fingerprint(t) for t in part.column("_text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*(c for c, n in zip(part.columns, part.schema.names, strict=True) if n != "_text"), pa.array(found.view(np.int64))],
            [*(n for n in part.schema.names if n != "_text"), "fp"],
        )


def fingerprints(documents: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of each row and ``fp``, the fingerprint as a signed long."""
    rows = documents.select(*kept, F.col("text").alias("_text"))
    schema = documents.select(*kept).schema.add("fp", "long")
    return rows.mapInArrow(_fingerprints, schema)


def _positional_bytes(fp: str):
    return [F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]


def postings(distinct: DataFrame) -> DataFrame:
    """``(place, bytes, fp)``: the six ways to choose two of the four couples of positions."""
    couples = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    choices = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    entries = [
        F.struct(F.lit(n).alias("place"), F.shiftleft(couples[i], 16).bitwiseOR(couples[j]).alias("bytes"))
        for n, (i, j) in enumerate(choices)
    ]
    return distinct.select("fp", F.explode(F.array(*entries)).alias("entry")).select("entry.*", "fp")


def near_pairs(lists: DataFrame) -> DataFrame:
    """``(a, b)`` from short lists: candidates, the tally of shared bytes, the exact check."""
    left = lists.select("place", "bytes", F.col("fp").alias("a"))
    right = lists.select("place", "bytes", F.col("fp").alias("b"))
    candidates = left.join(right, ["place", "bytes"]).where("a < b").select("a", "b")
    shared = sum(
        (x == y).cast("int") for x, y in zip(_positional_bytes("a"), _positional_bytes("b"), strict=True)
    )
    return candidates.where(shared >= LEAST_SHARED_BYTES).where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS_APART
    )


def star_links(crowded: DataFrame) -> DataFrame:
    """``(a, b)`` for fingerprints of long lists, by their neighbours one bit away."""
    bits = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    keyed = crowded.select("fp", F.explode(F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("near"))
    least = keyed.groupBy("near").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    return (
        keyed.join(written(least.select("near", "least"), "least-near"), "near")
        .where("fp <> least")
        .select(F.col("fp").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints to give their components."""
    lists = postings(distinct)
    # written, so that Spark can split a long list in the join
    sizes = written(lists.groupBy("place", "bytes").agg(F.count("*").alias("n")).where("n > 1"), "list-sizes")
    sized = lists.join(sizes, ["place", "bytes"])
    short = sized.where(F.col("n") <= SHORT_LIST).drop("n")
    crowded = sized.where(F.col("n") > SHORT_LIST).select("fp").distinct()
    return near_pairs(short).unionByName(star_links(crowded)).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Each row with ``fingerprint`` (16 hex digits) and ``component_id``."""
    marked = written(
        fingerprints(documents.select(F.col("doc_id").cast("bigint").alias("_id"), F.struct(*others(documents, "text", "fingerprint", "component_id")).alias("_row"), "text"), "_id", "_row"),
        "fingerprints",
    )
    return marked.join(component_names(marked), "fp").select(
        "_row.*",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def component_names(marked: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` for the distinct fingerprints of ``marked(_id, fp)``."""
    distinct = written(marked.groupBy("fp").agg(F.min("_id").alias("least_id")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    return rooted.join(smallest, "root").select("fp", "root", "component_id")


def row_hash(documents: DataFrame):
    """A hash of all columns, and of which of them are NULL."""
    told = [F.to_json(F.struct(named(c))) if "<" in kind else named(c) for c, kind in documents.dtypes]
    return F.xxhash64(*told, *[named(c).isNull() for c in documents.columns])


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest ``doc_id``; rows without one stay.

    Of several rows of the component with that ``doc_id`` the first by all its columns' hash stays.
    """
    whole = documents.select(
        F.col("doc_id").cast("bigint").alias("_id"), row_hash(documents).alias("_hash"), F.struct("*").alias("_row"), "text"
    )
    marked = written(fingerprints(whole.select("_id", "_hash", "text"), "_id", "_hash"), "fingerprints")
    firsts = marked.where("_id is not null").groupBy("fp").agg(F.min(F.struct("_id", "_hash")).alias("first"))
    keepers = firsts.join(component_names(marked).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    chosen = whole.join(keepers.select("first.*"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return chosen.unionByName(whole.where("_id is null")).select("_row.*")
