"""Phrases whose words keep company, counted by direct-address tiles of frequency-ranked ids.

A text with A-Z in lower case is cut at ``. , ; : ! ?`` and line ends into pieces, a piece at spaces
and tabs into words. All counts are per language, a NULL language being ``und``. A phrase of two to
``longest`` words that occurs at least ``least`` times is a candidate.

1. Words are counted. Those that can be in a candidate get ids by falling frequency, language after
   language.
2. Tasks turn words into ids, and neighbours into addresses ``(tile, row in tile, column in tile)``.
   A tile that holds many of them is counted by one dense ``bincount`` over its addresses, the
   others are sorted together and counted as runs. Spark adds up the tasks' counts by address.
3. Frequent pairs get ids of their own by falling frequency, and a frequent pair and its next word
   are counted as pairs are, and so on up to ``longest`` words.
4. A candidate is cut in two at every place; ``score = floor(1000000 a a / (l r))`` in exact decimals,
   of its own count and its parts'. The lowest-scoring cut counts, the first of equal ones.
5. Candidates that lie inside a longer one with at least half of their count go, and each language's
   first ``most`` by score, count and phrase are ranked: first in slices of the language, then among
   what the slices keep.

Ids are sent to all tasks for the ``HEAD_WORDS`` most frequent words of at most ``LONGEST_WORD`` bytes
and the ``HEAD_PHRASES`` most frequent phrases of each length: some 100 MB and 32 MB at most, whatever
the corpus. Where more are frequent, the phrases that hold any of the rest are counted by their text in
Spark: slower, but all of them. Tasks hold a bounded number of addresses (``HELD``), then pass them on.

NULL and empty texts have no words; a language without candidates has no rows, as has an empty table.
Repeated rows count each time. Texts are read in windows that end at the end of a piece, so that a
very long text needs no more room than its longest piece. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.places import numbered
from textguard.llm.scratch import new_folder, written
from textguard.llm.words import slices

LEAST, LONGEST, MOST = 10, 3, 2000
#: Percent of a phrase's count that a longer one around it must reach for the phrase to go.
COVERED_PERCENT = 50
UNKNOWN = "und"
HEAD_WORDS, LONGEST_WORD, HEAD_PHRASES = 1_000_000, 100, 2_000_000
#: A tile has 1,024 rows and columns, and there may be 2,097,152 rows and columns of tiles; a tile
#: is counted densely from a sixteenth of its places on.
SIDE_BITS = 10
TILE_BITS = 21
DENSE_FROM = 1 << (2 * SIDE_BITS - 4)
#: Addresses that a task holds at a time.
HELD = 1 << 21
WINDOW_BYTES = 4 << 20
#: Slices of a language that are ranked apart first.
RANK_SLICES = 256

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class Words:
    """Words in order: ``index`` into ``distinct``, ``row`` of the text, and whether the next word
    stands in the same piece."""

    distinct: pa.Array
    index: np.ndarray
    row: np.ndarray
    joined: np.ndarray


def words_in(texts: pa.Array) -> Iterator[Words]:
    """The words of the texts, in windows that end where a piece or a text ends."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    first = offsets[:-1] - offsets[0]
    at = 0
    while at < len(data):
        stop = min(at + WINDOW_BYTES, len(data))
        if stop < len(data):
            ends = np.flatnonzero(_KIND[data[at:stop]] == 2)
            if len(ends):
                stop = at + int(ends[-1]) + 1
            else:
                stop = next((p for p in _breaks(data, stop)), len(data))
        yield from _window(data[at:stop], at, first)
        at = stop


def _breaks(data: np.ndarray, at: int) -> Iterator[int]:
    """Places after the ends of pieces from ``at`` on."""
    while at < len(data):
        ends = np.flatnonzero(_KIND[data[at : at + WINDOW_BYTES]] == 2)
        yield from (at + int(e) + 1 for e in ends[:1])
        at += WINDOW_BYTES


def _window(data: np.ndarray, at: int, first: np.ndarray) -> Iterator[Words]:
    kind = _KIND[data]
    inside = kind == 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = first[(first >= at) & (first < at + len(data))] - at
    opens[heads] = inside[heads]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return
    place = np.cumsum(inside, dtype=np.int32)
    bounds = np.append(place[starts] - 1, place[-1]).astype(np.int32)
    letters = _LOWER[data[inside]]
    flat = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    coded = flat.dictionary_encode()
    row = np.searchsorted(first, starts + at, side="right") - 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    joined = np.append((row[1:] == row[:-1]) & (piece[1:] == piece[:-1]), False)
    yield Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), row, joined)


def _languages(part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = part.column("lang").fill_null(UNKNOWN).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def count_words(documents: DataFrame) -> DataFrame:
    """``(lang, phrase, n)`` for every word."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            langs, lang_of = _languages(part)
            for words in words_in(part.column("text")):
                size = len(words.distinct)
                found = np.bincount(lang_of[words.row] * size + words.index, minlength=len(langs) * size)
                keys = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs).take(keys // size), words.distinct.take(keys % size), pa.array(found[keys], pa.int64())],
                    ["lang", "phrase", "n"],
                )

    counted = documents.select("lang", "text").mapInArrow(count, "lang string, phrase string, n bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def head_of(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The rows with the largest ``n``, at most ``most`` of them, and whether that is all.

    Taken by whole steps of a scale of counts, sixteen to the doubling.
    """
    if rows.count() <= most:
        return rows, True
    step = F.floor(F.log2("n") * 16)
    sizes = rows.groupBy(step.alias("step")).agg(F.count("*").alias("size")).orderBy(F.desc("step")).collect()
    least, taken = None, 0
    for row in sizes:
        taken += row["size"]
        if taken > most:
            break
        least = row["step"]
    return rows.where(F.lit(False) if least is None else step >= least), False


def with_ids(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written, with ``id``: from 0 by language, falling count and phrase."""
    folder = new_folder(rows.sparkSession, purpose)
    return numbered(rows.withColumn("_rare", -F.col("n")), ["lang", "_rare", "phrase"], "id", folder).drop("_rare")


def addresses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each pair of ids: the tile's row and column, then those inside the tile."""
    side, mask = SIDE_BITS, (1 << SIDE_BITS) - 1
    tile = ((a >> side) << TILE_BITS) | (b >> side)
    return (tile << 2 * side) | ((a & mask) << side) | (b & mask)


def ids_at(address: Column) -> tuple[Column, Column]:
    """The pair of ids of an address."""
    side = SIDE_BITS

    def bits(start: int, width: int) -> Column:
        return F.shiftright(address, start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    high, low = bits(2 * side + TILE_BITS, TILE_BITS), bits(2 * side, TILE_BITS)
    return F.shiftleft(high, side) + bits(side, side), F.shiftleft(low, side) + bits(0, side)


def tiled_counts(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct addresses and their counts: full tiles by direct address, the rest as sorted runs."""
    places = 1 << 2 * SIDE_BITS
    tiles = held >> 2 * SIDE_BITS
    kinds, sizes = np.unique(tiles, return_counts=True)
    found, counts = [], []
    rest = np.ones(len(held), bool)
    for tile in kinds[sizes >= DENSE_FROM]:
        here = tiles == tile
        rest &= ~here
        dense = np.bincount(held[here] & (places - 1), minlength=places)
        own = np.flatnonzero(dense)
        found.append((tile << 2 * SIDE_BITS) | own)
        counts.append(dense[own])
    sparse, runs = np.unique(held[rest], return_counts=True)
    return np.concatenate([*found, sparse]), np.concatenate([*counts, runs])


@dataclass(frozen=True)
class Known:
    """What tasks look ids up in: words by language, then for each length from two on the pairs of a
    prefix's and a word's id in order, with the phrase's id. ``whole`` says of each whether every
    frequent one is in it."""

    words: dict[str, dict[str, int]]
    pairs: tuple[tuple[np.ndarray, np.ndarray], ...]
    whole: tuple[bool, ...]


def _look_up(table: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    keys, ids = table
    if not len(keys):
        return np.full(len(a), -1)
    wanted = (a << 32) | b
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((a >= 0) & (b >= 0) & (keys[at] == wanted), ids[at], -1)


def _word_ids(words: Words, langs: list[str], lang_of: np.ndarray, known: Known) -> np.ndarray:
    size = len(words.distinct)
    keys = lang_of[words.row] * size + words.index
    seen = np.zeros(len(langs) * size, bool)
    seen[keys] = True
    table = np.full(len(seen), -1)
    names = words.distinct.to_pylist()
    for n, lang in enumerate(langs):
        ids = known.words.get(lang, {})
        here = np.flatnonzero(seen[n * size : (n + 1) * size])
        table[n * size + here] = [ids.get(names[i], -1) for i in here]
    return table[keys]


def count_phrases(documents: DataFrame, known: Known) -> DataFrame:
    """``(address, lang, phrase, n)`` for phrases one word longer than the longest known ones: by
    address where both ids are known, else, where that does not rule a phrase out, by language and
    text."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(known)
    length = len(known.pairs) + 2

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, holding = shared.value, [], 0
        for part in slices(batches, "text"):
            langs, lang_of = _languages(part)
            for words in words_in(part.column("text")):
                many = len(words.index) - length + 1
                if many < 1:
                    continue
                ids = _word_ids(words, langs, lang_of, known)
                prefix, stands = ids, np.ones(len(ids), bool)
                for n, table in enumerate(known.pairs, 1):
                    stands = stands[:-1] & words.joined[n - 1 : -1]
                    prefix = np.where(stands, _look_up(table, prefix[:-1], ids[n:]), -1)
                stands = stands[:-1] & words.joined[length - 2 : -1]
                last = ids[length - 1 :]
                good = stands & (prefix[:-1] >= 0) & (last >= 0)
                if not all(known.whole):
                    open_ = stands & ~good
                    if known.whole[0]:
                        for n in range(length):
                            open_ &= ids[n : n + many] >= 0
                    yield from _by_text(words, np.flatnonzero(open_), length, langs, lang_of)
                elif length > 2:
                    good &= prefix[1:] >= 0  # the phrase without its first word must be frequent too
                found = addresses(prefix[:-1][good], last[good])
                held.append(found)
                holding += len(found)
                if holding >= HELD:
                    yield _by_address(np.concatenate(held))
                    held, holding = [], 0
        if holding:
            yield _by_address(np.concatenate(held))

    counted = documents.select("lang", "text").mapInArrow(count, "address bigint, lang string, phrase string, n bigint")
    return counted.groupBy("address", "lang", "phrase").agg(F.sum("n").alias("n"))


def _by_address(held: np.ndarray) -> pa.RecordBatch:
    found, counts = tiled_counts(held)
    none = pa.nulls(len(found), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int64()), none, none, pa.array(counts, pa.int64())], ["address", "lang", "phrase", "n"]
    )


def _by_text(words: Words, at: np.ndarray, length: int, langs: list[str], lang_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(at):
        return
    parts = [words.distinct.take(pa.array(words.index[at + n])) for n in range(length)]
    rows = pa.table({"lang": pa.array(langs).take(pa.array(lang_of[words.row[at]])), "phrase": pc.binary_join_element_wise(*parts, " ")})
    found = rows.group_by(["lang", "phrase"]).aggregate([([], "count_all")])
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(found.num_rows, pa.int64()), *(found.column(c).combine_chunks() for c in ("lang", "phrase", "count_all"))],
        ["address", "lang", "phrase", "n"],
    )


def frequent_phrases(
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    head_words: int = HEAD_WORDS,
    head_phrases: int = HEAD_PHRASES,
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, length, n)`` of all phrases of up to ``longest`` words that occur ``least``
    times, and ``(lang, n)``, all words of a language."""
    everything = written(count_words(documents), "words")
    totals = everything.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = everything.where(F.col("n") >= least)
    short = frequent.where(F.octet_length("phrase") <= LONGEST_WORD)
    head, whole = head_of(short, head_words)
    whole = whole and frequent.where(F.octet_length("phrase") > LONGEST_WORD).isEmpty()
    named = with_ids(head.select("lang", "phrase", "n"), "word-ids")
    words: dict[str, dict[str, int]] = defaultdict(dict)
    for batch in named.select("lang", "phrase", "id").toArrow().to_batches():
        for lang, word, number in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            words[lang][word] = number
    spelled = named.select(F.col("id").alias("b"), "lang", F.col("phrase").alias("word"))

    known = Known(dict(words), (), (whole,))
    prefixes = spelled.select(F.col("b").alias("a"), F.col("word").alias("prefix"))
    found = [frequent.select("lang", "phrase", F.lit(1).alias("length"), "n")]
    for length in range(2, longest + 1):
        counted = written(count_phrases(documents, known).where(F.col("n") >= least), f"counts-{length}")
        a, b = ids_at(F.col("address"))
        told = (
            counted.where("address is not null").select(a.alias("a"), b.alias("b"), "n")
            .join(prefixes, "a").join(spelled, "b")
            .select("a", "b", "lang", F.concat("prefix", F.lit(" "), "word").alias("phrase"), "n")
        )
        told = written(told, f"phrases-{length}")
        rest = counted.where("address is null").select("lang", "phrase", "n")
        found += [rows.select("lang", "phrase", F.lit(length).alias("length"), "n") for rows in (told, rest)]
        if length == longest:
            break
        head, whole = head_of(told, head_phrases)
        named = with_ids(head, f"phrase-ids-{length}")
        prefixes = named.select(F.col("id").alias("a"), F.col("phrase").alias("prefix"))
        pairs = named.select((F.shiftleft("a", 32) + F.col("b")).alias("pair"), "id").orderBy("pair").toArrow()
        table = (pairs.column("pair").to_numpy(), pairs.column("id").to_numpy())
        known = Known(known.words, (*known.pairs, table), (*known.whole, whole and rest.isEmpty()))
    whole_list = found[0]
    for rows in found[1:]:
        whole_list = whole_list.unionByName(rows)
    return written(whole_list, "frequent-phrases"), totals


def _joined(words: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, start, count), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, score)`` of the candidates, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    longer = phrases.where("length > 1")
    cuts = longer.select(
        "lang", "phrase", F.col("n").alias("a"), "length", words.alias("words"),
        F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "a", "k",
        _joined(F.col("words"), F.lit(1), F.col("k")).alias("left"),
        _joined(F.col("words"), F.col("k") + 1, F.col("length") - F.col("k")).alias("right"),
    )
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    measured = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # a candidate's count below 10 to the 16 keeps the products within 38 digits; "div" drops the fraction
    top = "cast(a as decimal(16, 0)) * cast(a as decimal(16, 0)) * cast(1000000 as decimal(7, 0))"
    score = F.expr(f"cast({top} div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0))) as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return measured.groupBy("lang", "phrase").agg(F.first("a").alias("a"), best).select(
        "lang", "phrase", "a", "best.l", "best.r", "best.score"
    )


def uncovered(candidates: DataFrame, phrases: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """The candidates that no longer phrase around them reaches ``percent`` of their count."""
    words = F.split("phrase", " ")
    inside = phrases.where("length > 2").select("lang", "n", "length", words.alias("words"))
    inside = inside.select("lang", "n", "length", "words", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("size"))
    inside = inside.select(
        "lang", "n", "words", "size", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)).alias("start")
    ).select("lang", "n", _joined(F.col("words"), F.col("start"), F.col("size")).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = F.col("around").isNull() | (100 * F.col("around") < percent * F.col("a"))
    return candidates.join(around, ["lang", "phrase"], "left").where(kept).drop("around")


def first_by_language(rows: DataFrame, most: int) -> DataFrame:
    """Each language's first ``most`` rows with their ``rank``: of every slice of it first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SLICES)))
    inner = F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))
    kept = sliced.withColumn("_place", inner).where(F.col("_place") <= most).drop("_place", "_slice")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return kept.withColumn("rank", place).where(F.col("rank") <= most)


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    most: int = MOST,
    head_words: int = HEAD_WORDS,
    head_phrases: int = HEAD_PHRASES,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` from ``documents(lang, text, …)``."""
    phrases, totals = frequent_phrases(documents, least, longest, head_words, head_phrases)
    kept = uncovered(scored(phrases), phrases)
    listed = first_by_language(kept, most)
    return listed.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
