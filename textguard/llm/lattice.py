"""Language-model scores by a subword lattice.

The model is a unigram over the pieces of an existing public vocabulary and one end symbol. A text
is its words (A-Z in lower case), each with the vocabulary's word mark before it, then one end.
Its probability is the sum over all segmentations: a forward recursion in log space over each word,
whose results add up over the words, as no piece crosses a word. Any character may also be spelled
by byte pieces, so that every text has a probability above zero.

Piece weights come from the vocabulary's own scores, which rank the pieces, as a Zipf law, and are
then fitted to the training rows by expectation-maximisation: the expected use of each piece over
all segmentations of all training words. Training rows are those whose crc32(doc_id as text) mod 5
is not 1.

1. Every text gives its distinct words with counts, combined into one table of words, with how
   often each occurs in training rows.
2. The lattice is run once for each distinct word, not once for each occurrence.
3. The ``HEAD`` most frequent words, a bounded table, go to all tasks and settle most tokens where
   they stand. The other words of a document are joined with the table of words, and the parts are
   summed by row.

A NULL text counts as empty and has the end alone; a NULL ``doc_id`` is a training row. Repeated
rows count and are scored each. Without training rows N and V are zero, the base score is taken
with V + 1 = 1, and the weights stay the Zipf law's. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.scratch import written
from textguard.llm.words import numbered, row_of_word, slices, words_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
HEAD = 1 << 17
#: Words of a task are counted over this much text before Spark combines the counts.
GATHER_BYTES = 12 << 20
#: Added to each piece's expected count, by its Zipf weight, for pieces unseen in training.
PRIOR_COUNTS = 1_000.0
EM_ROUNDS = 2


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary: texts of ordinary pieces, and which ids spell bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.ids: dict[str, int] = {}
        scores = np.full(self.size, -np.inf)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                scores[i] = -self.size  # ranked after all merged pieces
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece.strip(MARK):
                self.ids[piece] = i
                scores[i] = max(model.get_score(i), -self.size)
            elif piece == MARK:
                self.ids[piece] = i
                scores[i] = model.get_score(i)
        self.zipf = np.where(np.isfinite(scores), 1 / (2.7 - scores), 0.0)
        self.zipf /= self.zipf.sum()
        self.longest = max(map(len, self.ids))
        self._tables()

    def _tables(self) -> None:
        """Single characters by code point; longer pieces by length as sorted keys of their code points,
        and which keys occur at all."""
        self.by_length = {}
        self.present = np.zeros(1 << _KEY_BITS, bool)
        self.single = np.full(0x110000, -1, np.int32)  # by code point
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        for length in range(2, self.longest + 1):
            found = [p for p in self.ids if len(p) == length]
            if found:
                points = np.array([[ord(c) for c in p] for p in found], np.uint64)
                keys = _prefix_keys(points)[-1]
                order = np.argsort(keys)
                self.by_length[length] = keys[order], np.array([self.ids[p] for p in found])[order], points[order].T.astype(np.int64)
                self.present[_short(keys)] = True


_KEY_BITS = 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _prefix_keys(points: np.ndarray) -> np.ndarray:
    """``[end, row]``: a polynomial key of each row's first ``end`` code points."""
    keys = np.zeros((points.shape[1] + 1, len(points)), np.uint64)
    for end in range(points.shape[1]):
        keys[end + 1] = keys[end] * _STEP + points[:, end] + np.uint64(1)
    return keys


def _short(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _KEY_BITS)


#: An arc ``(begin, words, piece ids)`` of an end; ids of None spell one character in bytes.
Arc = tuple[int, "np.ndarray | slice", "np.ndarray | None"]


class Lattice:
    """Forward and backward sums over the segmentations of many words at once.

    The words of a batch come by ascending length, so that those alive at an end are its tail.
    """

    def __init__(self, pieces: Pieces, log_weights: np.ndarray):
        self.pieces, self.log = pieces, log_weights
        self.spelled = np.full(0x110000, np.nan)  # by code point, filled when first met

    def _arcs(self, points: np.ndarray, lengths: np.ndarray) -> list[list[Arc]]:
        """The arcs of each end."""
        width = points.shape[1]
        prefix, columns = _prefix_keys(points), points.T.astype(np.int64)
        single = self.pieces.single[columns]
        powers = [np.uint64(pow(int(_STEP), n, 1 << 64)) for n in range(width + 1)]
        arcs: list[list[Arc]] = [[] for _ in range(width + 1)]
        for end in range(1, width + 1):
            first = int(np.searchsorted(lengths, end))
            arcs[end].append((end - 1, slice(first, None), None))
            words = np.flatnonzero(single[end - 1, first:] >= 0) + first
            if len(words):
                arcs[end].append((end - 1, words, single[end - 1, words]))
            for length, (keys, ids, spelled) in self.pieces.by_length.items():
                if length > end:
                    break  # lengths ascend
                key = prefix[end, first:] - prefix[end - length, first:] * powers[length]
                maybe = np.flatnonzero(self.pieces.present[_short(key)])
                if not len(maybe):
                    continue
                key = key[maybe]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = np.flatnonzero(keys[at] == key)
                words, at = maybe[same] + first, at[same]
                # keys of two code points are one to one, as no multiple of the step below 2**21 is
                # that near zero; longer ones are compared, one column at a time
                for n in range(length if length > 2 else 0):
                    hit = columns[end - length + n, words] == spelled[n, at]
                    if not hit.all():
                        words, at = words[hit], at[hit]
                if len(words):
                    arcs[end].append((end - length, words, ids[at]))
        return arcs

    def _byte_weight(self, points: np.ndarray) -> np.ndarray:
        """``[character, word]``: the weight of spelling it in bytes."""
        flat = points.T.astype(np.int64)
        found = self.spelled[flat]
        for point in np.unique(flat[np.isnan(found)]).tolist():
            self.spelled[point] = self.log[self.pieces.byte_ids[_utf8(point)]].sum()
            found[flat == point] = self.spelled[point]
        return found

    def _weight(self, arc: Arc, spelled: np.ndarray, end: int) -> np.ndarray:
        _, words, ids = arc
        return spelled[end - 1, words] if ids is None else self.log[ids]

    def _forward(self, points: np.ndarray, arcs: list[list[Arc]], spelled: np.ndarray) -> np.ndarray:
        sums = np.full((points.shape[1] + 1, len(points)), -np.inf)
        sums[0] = 0
        for end in range(1, points.shape[1] + 1):
            own = sums[end]
            for arc in arcs[end]:
                begin, words, ids = arc
                reached = sums[begin, words] + self._weight(arc, spelled, end)
                own[words] = reached if ids is None else np.logaddexp(own[words], reached)
        return sums

    def forward(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``[word, end]``: log of the summed weights of all segmentations of each prefix."""
        return self._forward(points, self._arcs(points, lengths), self._byte_weight(points)).T

    def expected(self, points: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The expected use of each piece over all segmentations, times each word's count."""
        arcs = self._arcs(points, lengths)
        spelled = self._byte_weight(points)
        ahead = self._forward(points, arcs, spelled)
        every = np.arange(len(points))
        behind = np.full(ahead.shape, -np.inf)
        whole = ahead[lengths, every]
        behind[lengths, every] = 0
        named, named_share, plain, plain_share = [], [], [], []
        for end in range(points.shape[1], 0, -1):
            for arc in arcs[end]:
                begin, words, ids = arc
                onward = behind[end, words] + self._weight(arc, spelled, end)
                share = np.exp(ahead[begin, words] + onward - whole[words]) * counts[words]
                behind[begin, words] = np.logaddexp(behind[begin, words], onward)
                if ids is None:
                    plain.append(points[words, end - 1].astype(np.int64))
                    plain_share.append(share)
                else:
                    named.append(ids)
                    named_share.append(share)
        used = np.zeros(self.pieces.size)
        if named:
            used += np.bincount(np.concatenate(named), weights=np.concatenate(named_share), minlength=self.pieces.size)
        amounts = np.bincount(np.concatenate(plain), weights=np.concatenate(plain_share))
        for point in np.flatnonzero(amounts).tolist():
            np.add.at(used, self.pieces.byte_ids[_utf8(point)], amounts[point])
        return used


def _utf8(point: int) -> list[int]:
    return list(chr(point).encode("utf-8", "surrogatepass"))


def batches_of(words: list[str], size: int = 4_096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(positions, code points, lengths)``: words of like length together, few where they are long."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    marked = MARK + MARK.join(words) if words else ""
    flat = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = min(at + size, len(order))
        # a padded batch holds at most so many characters
        while stop - at > 1 and (stop - at) * lengths[order[stop - 1]] > 16 * size:
            stop = at + (stop - at) // 2
        own = order[at:stop]
        column = np.arange(lengths[own[-1]])
        inside = column < lengths[own][:, None]
        points = np.zeros(inside.shape, np.uint64)
        points[inside] = flat[(starts[own][:, None] + column)[inside]]
        yield own, points, lengths[own]
        at = stop


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts hold about ``size`` bytes."""
    held, total = [], 0
    for batch in slices(batches, "text"):
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in gathered(batches, GATHER_BYTES):
        flat, bounds = words_of(pc.ascii_lower(part.column("text").fill_null("")))
        if not len(flat):
            continue
        ids, distinct = numbered(flat)
        training = ~part.column("held_out").to_numpy(zero_copy_only=False)[row_of_word(bounds)]
        yield pa.RecordBatch.from_arrays(
            [distinct, pa.array(np.bincount(ids, minlength=len(distinct))), pa.array(np.bincount(ids[training], minlength=len(distinct)))],
            ["word", "n", "known"],
        )


def fit(words: DataFrame, ends: int, pieces: Pieces) -> np.ndarray:
    """Natural log weights of all pieces, and last that of the end symbol."""
    spark = words.sparkSession
    weights = np.append(pieces.zipf, 1.0 / 100)
    log = _logs(weights / weights.sum())
    for _ in range(EM_ROUNDS if ends else 0):
        shared = spark.sparkContext.broadcast((pieces, log))

        def expect(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, log = shared.value
            lattice, used = Lattice(pieces, log), np.zeros(pieces.size)
            for batch in batches:
                counts = batch.column("known").to_numpy()
                for own, points, lengths in batches_of(batch.column("word").to_pylist()):
                    used += lattice.expected(points, lengths, counts[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(pieces.size)), pa.array(used)], ["piece", "used"])

        found = words.where("known > 0").select("word", "known").mapInArrow(expect, "piece bigint, used double")
        used = np.zeros(pieces.size)
        for row in found.groupBy("piece").agg(F.sum("used").alias("used")).collect():  # one row a piece
            used[row.piece] = row.used
        weights = np.append(used + PRIOR_COUNTS * pieces.zipf, ends)
        log = _logs(weights / weights.sum())
    return log


def _logs(weights: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(weights)


def score(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, counts, ``base_score`` and ``score`` of each row."""
    spark = documents.sparkSession
    pieces = Pieces(path or vocabulary_path())
    rows = documents.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False)).alias("held_out"),
        "text",
    )
    counted = written(
        rows.select("held_out", "text").mapInArrow(_counted, "word string, n bigint, known bigint")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("known").alias("known")),
        "words",
    )
    ends = rows.where("not held_out").count()
    log = fit(counted, ends, pieces)
    shared = spark.sparkContext.broadcast((pieces, log))

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for batch in batches:
            words = batch.column("word").to_pylist()
            found = np.zeros(len(words))
            for own, points, lengths in batches_of(words):
                found[own] = lattice.forward(points, lengths)[np.arange(len(own)), lengths]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "weight"])

    weighed = written(counted.mapInArrow(weigh, "word string, n bigint, known bigint, weight double"), "weighed-words")
    tokens = weighed.agg(F.sum("known").alias("n"), F.count_if(F.col("known") > 0).alias("v")).first()
    n_tokens, n_types = (tokens.n or 0) + ends, (tokens.v or 0) + (ends > 0)
    head = weighed.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    table = spark.sparkContext.broadcast(
        (head.column("word").combine_chunks(), head.column("known").to_numpy(), head.column("weight").to_numpy())
    )
    total = n_tokens + 0.5 * (n_types + 1)
    base_of = lambda known: F.log10((known + 0.5) / F.lit(total))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, weight = table.value
        logs = np.log10((known + 0.5) / total)
        for part in slices(batches, "text"):
            flat, bounds = words_of(pc.ascii_lower(part.column("text").fill_null("")))
            ids, distinct = numbered(flat)
            place = pc.index_in(distinct, value_set=words).fill_null(-1).to_numpy().astype(np.int64)[ids] if len(flat) else ids
            row, count = row_of_word(bounds), len(bounds) - 1
            near = place >= 0
            at, where = place[near], row[near]
            sums = [np.bincount(where, weights=w[at], minlength=count) for w in ((known > 0).astype(float), logs, weight)]
            # one row for the words settled here, one for each other distinct word of the text
            far = (row[~near] << 32) | ids[~near]
            pairs, times = np.unique(far, return_counts=True)
            key = part.column("key")
            yield pa.RecordBatch.from_arrays(
                [key, pa.nulls(count, pa.string()), pa.array(np.diff(bounds)), part.column("doc_id"), part.column("held_out"),
                 pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names,
            )
            empty = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(pairs >> 32)), distinct.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(times),
                 pa.nulls(empty, part.column("doc_id").type), pa.nulls(empty, pa.bool_()), pa.nulls(empty, pa.int64()),
                 pa.nulls(empty, pa.float64()), pa.nulls(empty, pa.float64())],
                names,
            )

    names = ["key", "word", "times", "doc_id", "held_out", "n_known", "base", "weight"]
    keyed = rows.withColumn("key", F.monotonically_increasing_id())
    schema = "key bigint, word string, times bigint, {0}, held_out boolean, n_known bigint, base double, weight double".format(
        f"doc_id {dict(documents.dtypes)['doc_id']}"
    )
    parts = keyed.mapInArrow(split, schema)
    settled = parts.where("word is null").select("key", "doc_id", "held_out", F.col("times").alias("n"), "n_known", "base", "weight")
    looked = weighed.select("word", F.col("known").alias("_known"), F.col("weight").alias("_weight"))
    other = parts.where("word is not null").select("key", "word", "times").join(looked, "word").select(
        "key", F.lit(None).cast(dict(documents.dtypes)["doc_id"]).alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
        F.lit(0).cast("bigint").alias("n"), F.when(F.col("_known") > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * base_of(F.col("_known"))).alias("base"), (F.col("times") * F.col("_weight")).alias("weight"),
    )
    end_known, end_base, end_weight = int(ends > 0), float(np.log10((ends + 0.5) / total)), float(log[-1])
    both = settled.unionByName(other).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n").alias("n"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("weight").alias("weight"),
    )
    return both.select(
        "doc_id",
        "held_out",
        (F.col("n") + 1).alias("n_tokens"),
        (F.col("n_known") + end_known).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        ((F.col("weight") + end_weight) / F.lit(float(np.log(10)))).alias("score"),
    )
