"""Best-fit packing of tokenised documents by bin completion with branch and bound.

Documents become token ids (a public tokenizer, one end id each) and pieces of at most ``CAPACITY``
tokens; only longer documents are cut. The number of sequences depends on the pieces' lengths only,
of which there are at most ``CAPACITY``. So the search works on the counts of lengths, which are
tiny whatever the size of the corpus, and decides patterns (which lengths share a sequence) with
multiplicities; the pieces then take the places of the patterns by their rank among equal lengths.

Search: the largest length left is completed with undominated fillings, that is with sets of smaller
lengths in which no group could be replaced by one length that is left and fills as much or more.
All of them are branched on, fullest first, each as often as the counts allow and less often. The
incumbent starts as best-fit decreasing. A branch ends when the waste of its full sequences and what
the lengths left must lose exclude a better result; the search ends at the lower bound, when the tree
is done, or after ``STEPS`` tried lengths, where the incumbent stands.

Ranks need no sorting of the corpus: each task numbers its own pieces of a length, the counts of
the tasks are added up, and a piece's rank is its number plus the counts of the tasks before.

A NULL or empty text has the end id only. Repeated rows are packed separately. An empty table gives
an empty result. Of other columns only ``doc_id`` is carried, NULL or not.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.scratch import written
from textguard.llm.words import numbered, slices, words_of

CAPACITY = 4096
END_ID = 1
#: Lengths that the search tries in all, some seconds of one core.
STEPS = 1_000_000
#: Part of the steps left that a start below the first pattern gets.
SHARE = 0.125
#: Distinct words a task keeps the ids of at a time.
KEPT_WORDS = 250_000
VOCABULARY = "word_bpe_49k.json"

_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _among(characters: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(characters.encode(), np.uint8))


_MARKS = _among(".,;:!?#$%&*")
_LETTERS = _among(string.ascii_lowercase)
_CAPITALS = _among(string.ascii_uppercase)
_BLANKS = _among(" \t\n\v\f\r")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of whole texts, each distinct word being encoded once.

    The vocabulary's rules split at white space first and never join over it, so that the ids of a
    text are those of its words in turn. Two things are done beforehand as the same rules would do
    them, which leaves far fewer distinct words: Latin-1 capitals become small, and a few marks
    between a Latin-1 letter and white space become a word of their own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        as_symbols = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.symbols = str.maketrans({c: as_symbols(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if _PLAIN.fullmatch(c)})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        merge = self.tokenizer.model.tokenize
        plain, odd = [], []
        for word in words:
            (plain if _PLAIN.fullmatch(word) else odd).append(word)
        found = [
            [t.id for t in (merge(word) if word.isascii() else merge(word.translate(self.symbols)))] for word in plain
        ]
        found += [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        self.known.update(zip([*plain, *odd], range(len(self.known), len(self.known) + len(words)), strict=True))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), np.int32, counts.sum())))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)`` of the texts, without end ids."""
        flat, bounds = words_of(part_marks(texts, self.special))
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        places, distinct = numbered(flat)
        words = distinct.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self._forget()
        self._learn([word for word in words if word not in self.known])
        own = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[places]
        starts = self.ends[own]
        lengths = self.ends[own + 1] - starts
        ends = np.cumsum(lengths)
        # token k of the slice is token (k - its word's first k) of the word
        spots = np.repeat(starts - (ends - lengths), lengths)
        spots += np.arange(len(spots))
        return self.flat[spots], np.concatenate(([0], ends))[bounds]


def part_marks(texts: pa.Array, special: list[str]) -> pa.Array:
    """Texts in small letters, with a space before up to four marks that end a word."""
    texts = texts.fill_null("")
    if not len(texts):
        return texts
    # a text that holds a special token's own string stays as it is
    held = np.logical_or.reduce([pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in special])
    if held.any():
        plain = iter(part_marks(texts.filter(pa.array(~held)), special).to_pylist())
        return pa.array([t if h else next(plain) for t, h in zip(texts.to_pylist(), held, strict=True)], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    lead = np.append(False, data[:-1] == 0xC3)  # the byte before opens a Latin-1 letter
    data[_CAPITALS[data] | (lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))] += 0x20
    letter = _LETTERS[data] | (lead & (data >= 0x9F) & (data != 0xB7))
    mark = _MARKS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # the bytes where texts start, and the end
    tail = blank = _BLANKS[data]
    for _ in range(4):
        tail = blank | (mark & (np.append(tail[1:], True) | first[1:]))
    marks = np.flatnonzero(mark[1:] & letter[:-1] & tail[1:] & ~first[1:-1]) + 1
    out = np.insert(data, marks, ord(" "))
    moved = (offsets + np.searchsorted(marks, offsets)).astype(np.int32)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(moved), pa.py_buffer(out))


def pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, task, number)``: pieces, and their number among
    the pieces of their length in their task."""
    path = path or vocabulary_path()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(path)
        seen: Counter[int] = Counter()
        task = TaskContext.get().partitionId()
        for part in slices(batches, "text"):
            ids, bounds = coder.ids(part.column("text"))
            rows = []
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    some = own[start : start + capacity]
                    rows.append((row, k, start, len(some), zlib.crc32(some.tobytes()), seen[len(some)]))
                    seen[len(some)] += 1
            row, *columns = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(row), columns[0].cast(pa.int32()), *columns[1:4],
                 pa.array([task] * len(rows), pa.int32()), columns[4]],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"],
            )

    rows = documents.select("doc_id", "text")
    schema = rows.select("doc_id").schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "integer"), ("number", "long")):
        schema = schema.add(name, kind)
    return rows.mapInArrow(cut, schema)


# --- the search over counts of lengths ---


class Lengths:
    """How many pieces of each length are left; ``have`` has a bit for every length that is."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        self.have = sum(1 << int(n) for n in np.flatnonzero(self.counts) if n)

    def most(self, top: int) -> int:
        """The largest length left up to ``top``; 0 if there is none."""
        return max(0, (self.have & ((2 << top) - 1)).bit_length() - 1)

    def least(self) -> int:
        return (self.have & -self.have).bit_length() - 1

    def take(self, filling: tuple[int, ...], times: int) -> None:
        """Pieces of ``times`` sequences go, or come back where that is negative."""
        for length in filling:
            self.counts[length] -= times
            if self.counts[length]:
                self.have |= 1 << length
            else:
                self.have &= ~(1 << length)

    def times(self, filling: tuple[int, ...]) -> int:
        return min(int(self.counts[length]) // n for length, n in Counter(filling).items())


def fewest_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: lengths over half of ``capacity`` are alone, and the room beside those that are
    too long for any length from k on is lost to these, for every k."""
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    k, half = sizes[: capacity // 2 + 1], capacity // 2
    alone = number[-1] - number[capacity - k]
    long, long_total = number[capacity - k] - number[half], total[capacity - k] - total[half]
    short_total = total[half] - np.where(k > 0, total[k - 1], 0)
    more = np.maximum(0, -(-(short_total - (long * capacity - long_total)) // capacity))
    return int((alone + long + more).max())


def dominated(left: Lengths, others: list[int], room: int) -> bool:
    """Whether a length that is left could replace some of ``others``, filling as much or more.

    Any group of two or more may be replaced by a length of at least its sum, one length only by a
    larger one, and nothing at all by any length that still fits.
    """
    groups: dict[int, bool] = {0: True}  # sum, and whether only an equal length makes it
    for length in others:
        groups |= {total + length: total == 0 and groups.get(length, True) for total in list(groups)}
    used = Counter(others)
    for total, single in groups.items():
        new = left.most(total + room)
        while new >= max(1, total + single):
            if left.counts[new] > used[new]:
                return True
            new = left.most(new - 1)
    return False


class Search:
    """Depth-first bin completion; ``steps`` bounds the lengths that it tries in all."""

    def __init__(self, counts: np.ndarray, capacity: int, steps: int):
        self.left, self.capacity, self.steps = Lengths(counts), capacity, steps

    def fillings(self, largest: int, waste: int) -> Iterator[tuple[int, ...]]:
        """All undominated fillings around ``largest`` that leave ``waste`` at most, fullest first in
        steps of doubling waste."""
        self.left.take((largest,), 1)
        have = self.left.have
        self.left.take((largest,), -1)
        if not have or have & -have > 1 << (self.capacity - largest):
            if self.capacity - largest <= waste:
                yield (largest,)
            return
        low, high = 0, 0
        while low <= waste:
            yield from self._completed(largest, [], self.capacity - largest, low, min(high, waste))
            low, high = high + 1, 2 * high + 1

    def _completed(self, largest: int, others: list[int], room: int, low: int, high: int) -> Iterator[tuple[int, ...]]:
        left = self.left
        length = left.most(min(room, others[-1] if others else largest))
        while length and self.steps > 0:
            self.steps -= 1
            if left.counts[length] > others.count(length) + (length == largest):
                rest, own = room - length, [*others, length]
                last = rest < left.least()
                if low <= rest <= high:
                    left.take((largest,), 1)
                    keep = not dominated(left, own, rest)
                    left.take((largest,), -1)
                    if keep:
                        yield (largest, *own)
                if not last:
                    yield from self._completed(largest, own, rest, low, high)
                else:  # alone, a smaller one leaves more
                    length = min(length, room - left.least() + 1)
            length = left.most(length - 1)

    def branches(self, waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Fillings around the largest length left, as often as they can be and less often."""
        for filling in self.fillings(self.left.most(self.capacity), waste):
            times = self.left.times(filling)
            while times:
                yield filling, times
                times //= 2

    def descend(self, waste: int, share: float, seen: dict[bytes, int]) -> list[tuple[tuple[int, ...], int]] | None:
        """Patterns for all that is left with ``waste`` at most, or None if a ``share`` of the steps
        finds none. ``seen`` has the states found hopeless, with the waste they were tried at."""
        if not self.left.have:
            return []
        stop = self.steps - max(1, int(self.steps * share))
        chosen, wastes = [], [waste]
        ways, states = [self.branches(waste)], [b""]
        while ways and self.steps > stop:
            step = next(ways[-1], None)
            if step is None:
                ways.pop()
                seen[states.pop()] = wastes.pop()
                if chosen:
                    self.left.take(chosen[-1][0], -chosen[-1][1])
                    chosen.pop()
                continue
            filling, times = step
            after = wastes[-1] - times * (self.capacity - sum(filling))
            if after < 0:
                continue
            self.left.take(filling, times)
            chosen.append(step)
            if not self.left.have:
                return chosen
            self.steps -= 1
            wastes.append(after)
            state = hashlib.blake2b(self.left.counts.tobytes(), digest_size=16).digest()
            hopeless = seen.get(state, -1) >= after or self._must_lose() > after
            states.append(b"" if hopeless else state)
            ways.append(iter(()) if hopeless else self.branches(after))
        for filling, times in reversed(chosen):
            self.left.take(filling, -times)
        return None

    def _must_lose(self) -> int:
        total = int((self.left.counts * np.arange(self.capacity + 1)).sum())
        return fewest_bins(self.left.counts, self.capacity) * self.capacity - total


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with multiplicities, every largest length completed by the largest that fit, or by
    two that fit better."""
    left, out = Lengths(counts), []
    while largest := left.most(capacity):
        left.take((largest,), 1)
        filling = (largest, *_best_fit(left, capacity - largest))
        left.take((largest,), -1)
        times = left.times(filling)
        left.take(filling, times)
        out.append((filling, times))
    return out


def _best_fit(left: Lengths, room: int) -> list[int]:
    """The largest lengths that fit, or one or two that leave less room."""
    greedy, rest, used = [], room, Counter()
    length = left.most(room)
    while length:
        if left.counts[length] > used[length]:
            greedy.append(length)
            used[length] += 1
            rest -= length
            length = left.most(min(length, rest))
        else:
            length = left.most(length - 1)
    if not rest:
        return greedy
    present = np.flatnonzero(left.counts[: room + 1] > 0)[::-1]
    present = present[present * 2 >= room]  # the longer of two
    below = np.maximum.accumulate(np.where(left.counts > 0, np.arange(len(left.counts)), 0))
    seconds = below[np.minimum(room - present, present)]
    seconds = np.where((seconds == present) & (left.counts[present] < 2), 0, seconds)
    if len(present):
        waste = room - present - seconds
        at = int(np.argmin(waste))
        if waste[at] < rest:
            return [int(n) for n in (present[at], seconds[at]) if n]
    return greedy


def complete(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """The best packing found: ``counts[n]`` pieces of length n in patterns with multiplicities.

    The search for one sequence fewer than the incumbent keeps the incumbent's patterns up to the
    first whose waste is more than such a packing may have, and goes up from there: 1, 2, 4 and more
    patterns, at last to the first one, from where it covers the whole tree.
    """
    total = int((counts * np.arange(len(counts))).sum())
    if not total:
        return []
    bound = fewest_bins(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(times for _, times in best)
    search = Search(counts, capacity, steps)
    while fewest > bound and search.steps > 1:
        allowed = (fewest - 1) * capacity - total
        lost = np.cumsum([times * (capacity - sum(filling)) for filling, times in best])
        start, up, found, seen = int(np.searchsorted(lost, allowed, side="right")), 1, None, {}
        while found is None and search.steps > 1:
            search.left = Lengths(counts)
            for filling, times in best[:start]:
                search.left.take(filling, times)
            found = search.descend(allowed - (int(lost[start - 1]) if start else 0), SHARE if start else 1, seen)
            if found is None and not start:
                break
            if found is None:
                start, up = max(0, start - up), 2 * up
        if found is None:
            break
        best = [*best[:start], *found]
        fewest = sum(times for _, times in best)
    return best


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, times, first sequence, offset)`` for every place of every pattern."""
    ranks: Counter[int] = Counter()
    out, sequence = [], 0
    for filling, times in patterns:
        offset = 0
        for length in filling:
            out.append((length, ranks[length], times, sequence, offset))
            ranks[length] += times
            offset += length
        sequence += times
    return out


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = documents.sparkSession
    cut = written(pieces(documents, path, capacity), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("shift"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[row.length] = row.n
    slots = places(complete(counts, capacity, steps))
    # every pattern uses up some length to below its own need: a few rows for each length at most
    table: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in slots:
        table.setdefault(length, []).append((rank, sequence, offset))
    shared = spark.sparkContext.broadcast({n: np.array(rows, np.int64).T for n, rows in table.items()})

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                first, seq, off = shared.value[int(length)]
                slot = np.searchsorted(first, ranks[here], side="right") - 1
                sequence[here] = seq[slot] + ranks[here] - first[slot]
                offset[here] = off[slot]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    ranked = cut.join(shifts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("shift")).alias("rank")
    )
    schema = cut.select("doc_id", "piece", "start", "length", "ids_crc32").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(settle, schema)
