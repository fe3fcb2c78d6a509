"""Removal of long repeated passages by recompression.

A window is 50 consecutive words of one document. Words covered by a window whose word sequence
also starts in a document with a smaller ``doc_id`` are removed.

Recompression rewrites the word sequence in rounds. The first round names runs of equal words, the
next ones name pairs: a bit of each symbol's name, another one each round, puts it left or right,
and a left symbol followed by a right one becomes a new symbol. A symbol's name is a hash of what it
stands for, so that all tasks give equal substrings equal names without exchanging a dictionary,
and the rounds need no shuffle of the corpus. Symbols stop growing at ``MOST_WORDS`` words.

For each symbol the words that its existence depends on are kept. A symbol whose dependence lies
inside a window is an *interior* symbol: every occurrence of the window has it. The longest interior
symbol after the last round anchors the window, so that equal windows have equal anchors, and long
symbols are rare. Neighbouring windows with one anchor form a block.

1. Anchors that occur in one document only fall away, and their blocks with them.
2. Blocks are compared by anchor and content hash: an equal block in a smaller document covers all
   windows of a block. This settles copies and the inside of repeated passages.
3. Where an anchor has several different blocks, at the ends of passages, the single windows of each
   block's smallest document are compared by their 128-bit hashes.
4. The covered windows go back to their documents, which drop the words.

Windows without an interior symbol make blocks of their own. Nothing is grouped into one task: keys
with very many rows are pre-aggregated, and joins on them can be split by Spark.

Rows with one ``doc_id`` count as one document; their texts are cleaned separately. A NULL ``doc_id``
is smaller than any other. A NULL text has no words; texts under 50 words lose none. Repeated rows
stay and are cleaned alike. An empty table gives an empty table. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.columns import others
from textguard.llm.scratch import written
from textguard.llm.words import BASE, Rolling, mixed, slices, word_names, words_of

WINDOW = 50
ROUNDS = 5
MOST_WORDS = 16
NO_ID = -(1 << 63)


class Parse:
    """The symbols of a flat word sequence after the rounds.

    ``name``; ``start`` and ``stop``, the words it stands for; ``low`` and ``high``, the words it
    depends on. Dependence on a row's edge is written as a place outside of all windows.
    """

    def __init__(self, names: np.ndarray, bounds: np.ndarray):
        self.name = names
        self.start = np.arange(len(names))
        self.stop = self.start + 1
        self.low, self.high = self.start, self.stop
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))

    def _depend(self) -> tuple[np.ndarray, np.ndarray]:
        """What each symbol and its left, or its right, neighbour depend on."""
        far = np.int64(1 << 40)
        apart = self.row[1:] != self.row[:-1]
        low = np.append(-far, np.where(apart, -far, self.low[:-1]))
        high = np.append(np.where(apart, far, self.high[1:]), far)
        return np.minimum(low, self.low), np.maximum(high, self.high)

    def _joined(self, first: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Keep the symbols flagged ``first``; each takes in those up to the next one."""
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(first)) - 1
        self.name, self.row = name[at], self.row[at]
        self.start, self.stop = self.start[at], self.stop[ends]
        self.low, self.high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    def runs(self) -> None:
        """Name runs of equal words; runs longer than a symbol may be stay as they are."""
        same = (self.name[1:] == self.name[:-1]) & (self.row[1:] == self.row[:-1])
        head = np.append(True, ~same)
        at = np.flatnonzero(head)
        counts = np.diff(np.append(at, len(head)))
        long = np.repeat(counts > MOST_WORDS, counts)
        name = self.name.copy()
        many = (counts > 1) & (counts <= MOST_WORDS)
        name[at[many]] = mixed(name[at[many]] * BASE[0] + counts[many].astype(np.uint64))
        low, high = self._depend()
        # inside an overlong run, being overlong is seen from as many words around
        low, high = np.where(long, low - MOST_WORDS, low), np.where(long, high + MOST_WORDS, high)
        self._joined(head | long, name, low, high)

    def pairs(self, round_: int) -> None:
        """Name pairs of a left and a right symbol."""
        right = (self.name >> np.uint64(8 + round_)) & np.uint64(1) == 1
        fits = self.stop[1:] - self.start[:-1] <= MOST_WORDS
        pair = ~right[:-1] & right[1:] & fits & (self.row[1:] == self.row[:-1])
        second = np.append(False, pair)
        name = self.name.copy()
        at = np.flatnonzero(pair)
        name[at] = mixed(mixed(name[at] + BASE[1]) + name[at + 1] * BASE[0] + np.uint64(round_))
        # a left symbol looks at its right neighbour only, and the other way round
        low, high = self._depend()
        full = self.stop - self.start >= MOST_WORDS
        low = np.where(right & ~full, low, self.low)
        high = np.where(~right & ~full, high, self.high)
        # a named pair depends on its two symbols alone
        low[second] = self.low[second]
        self._joined(~second, name, low, high)


def recompressed(names: np.ndarray, bounds: np.ndarray) -> Parse:
    parse = Parse(names, bounds)
    if len(names):
        parse.runs()
        for round_ in range(ROUNDS):
            parse.pairs(round_)
    return parse


def anchors(parse: Parse, words: int) -> np.ndarray:
    """For each place, the longest interior symbol of the window there, or -1.

    Of equal lengths the smallest name counts, of equal names the leftmost symbol, so that only the
    window's content decides. Long symbols are rare, and rare anchors leave little to compare.
    """
    owner = np.full(words, -1, np.int64)
    first, last = parse.high - WINDOW, parse.low + 1
    usable = np.flatnonzero((first < last) & (last > 0) & (parse.high <= words))
    rank = mixed(parse.name[usable])
    # painted from the shortest to the longest, and so on
    order = usable[np.lexsort((-usable, ~rank, parse.stop[usable] - parse.start[usable]))]
    for symbol, a, b in zip(order.tolist(), np.maximum(first[order], 0).tolist(), last[order].tolist(), strict=True):
        owner[a:b] = symbol
    return owner


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        flat, bounds = words_of(part.column("text"))
        if len(flat) < WINDOW:
            continue
        names = word_names(flat, 0)
        parse = recompressed(names, bounds)
        owner = anchors(parse, len(names))
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        places = np.flatnonzero(np.arange(len(names)) + WINDOW <= bounds[1:][row])
        if not len(places):
            continue
        own = owner[places]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (own[1:] != own[:-1]) | (own[1:] < 0) | (places[1:] != places[:-1] + 1)
        first = np.flatnonzero(fresh)
        starts, counts = places[first], np.diff(np.append(first, len(places)))
        stops = starts + counts + WINDOW - 1
        symbol = own[first]
        # anchor and content together are a hash of 128 bits
        anchor = np.where(symbol < 0, Rolling(names, 0)(starts, stops), parse.name[symbol])
        content = Rolling(word_names(flat, 1), 1)(starts, stops)
        # where the anchor stands in the block tells apart equal words around another anchor
        content = mixed(content ^ np.where(symbol < 0, 0, parse.start[symbol] - starts).astype(np.uint64))
        rows = pa.array(row[starts])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc").take(rows), part.column("version").take(rows), _signed(anchor), _signed(content),
             pa.array((starts - bounds[row[starts]]).astype(np.int32)), pa.array(counts.astype(np.int32))],
            ["doc", "version", "anchor", "content", "start", "windows"],
        )


def _single_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The window hashes of the wanted blocks ``spots`` of each text."""
    for part in slices(batches, "text"):
        flat, bounds = words_of(part.column("text"))
        spots = part.column("spots")
        counts = np.diff(spots.offsets.to_numpy())
        inner = spots.flatten()
        row = np.repeat(np.arange(len(counts)), counts)
        windows = inner.field("windows").to_numpy().astype(np.int64)
        first = bounds[row] + inner.field("start").to_numpy()
        ends = np.cumsum(windows)
        places = np.repeat(first - (ends - windows), windows) + np.arange(ends[-1])
        rows = np.repeat(row, windows)
        left, right = (Rolling(word_names(flat, lane), lane)(places, places + WINDOW) for lane in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc").take(pa.array(rows)), part.column("version").take(pa.array(rows)), _signed(left), _signed(right),
             pa.array((places - bounds[rows]).astype(np.int32))],
            ["doc", "version", "left", "right", "start"],
        )


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` without the covered words, joined by one space."""
    for part in slices(batches, "text"):
        texts, totals, removed = [], [], []
        for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = np.zeros(len(words) + 1, np.int64)
            if spans:
                begin = np.array([s["start"] for s in spans])
                gone += np.bincount(begin, minlength=len(gone))
                gone -= np.bincount(begin + np.array([s["windows"] for s in spans]) + WINDOW - 1, minlength=len(gone))
            kept = np.cumsum(gone)[:-1] == 0
            totals.append(len(words))
            removed.append(len(words) - int(kept.sum()))
            texts.append(b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k] if spans else words))
        yield pa.RecordBatch.from_arrays(
            [part.column("_row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
            ["_row", "text", "n_words", "n_removed"],
        )


def covered(rows: DataFrame) -> DataFrame:
    """``(doc, version, spans)`` for ``rows(doc, version, text)``: runs of windows to remove."""
    # read twice: computing the blocks again takes less than keeping all of them
    blocks = rows.mapInArrow(_blocks, "doc bigint, version bigint, anchor bigint, content bigint, start int, windows int")
    shared = blocks.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    # written, so that the join below has an exchange on both sides and Spark can split hot anchors
    shared = written(shared, "anchors")
    blocks = written(blocks.join(shared, "anchor", "left_semi"), "blocks")
    same = ["anchor", "content"]
    distinct = blocks.groupBy(*same).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    several = (
        distinct.groupBy("anchor").agg(F.min("least").alias("a"), F.max("least").alias("b"))
        .where("a < b").select("anchor", F.lit(True).alias("several"))
    )
    several = written(several, "several")  # as above, for an anchor that many different blocks share
    facts = distinct.join(several, "anchor", "left").where("least < most or several")
    found = written(
        blocks.join(facts, same).where("doc > least or several")
        .select("doc", "version", "start", "windows", (F.col("doc") > F.col("least")).alias("settled")),
        "blocks-found",
    )
    settled = found.where("settled").drop("settled")
    wanted = found.where("not settled").groupBy("doc", "version").agg(F.collect_set(F.struct("start", "windows")).alias("spots"))
    windows = rows.join(wanted, ["doc", "version"]).dropDuplicates(["doc", "version"]).mapInArrow(
        _single_windows, "doc bigint, version bigint, left bigint, right bigint, start int"
    )
    least = windows.groupBy("left", "right").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    least = written(least, "shared-windows")
    single = windows.join(least, ["left", "right"]).where("doc > least").select("doc", "version", "start", F.lit(1).alias("windows"))
    return settled.unionByName(single).groupBy("doc", "version").agg(
        F.collect_set(F.struct("start", "windows")).alias("spans")
    )


def drop_repeats(documents: DataFrame) -> DataFrame:
    """Each row with the kept words as ``text``, and ``n_words`` and ``n_removed``."""
    whole = documents.select(
        F.struct(*others(documents, "text", "n_words", "n_removed")).alias("_row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )
    spans = covered(whole.select("doc", "version", "text"))
    schema = whole.select("_row").schema.add("text", "string").add("n_words", "long").add("n_removed", "long")
    joined = whole.join(spans, ["doc", "version"], "left").select("_row", "text", "spans")
    return joined.mapInArrow(_clean, schema).select("_row.*", "text", "n_words", "n_removed")
