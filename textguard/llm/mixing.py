"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target number of words; its documents are permuted into blocks, whole blocks
are drawn until the target is met, and the quotas of blocks are split among output shards.

* Targets. Sources in code-point order, NULL last, weigh 1, 2, 3, 1, 2, 3 and so on and share all
  words of the table by weight. A target stops at ``most_repeats`` times its source's words and the
  excess is shared again among the others, until none is above.
* Blocks. A keyed hash of the row places each document in one of its source's blocks (about
  ``BLOCK_DOCUMENTS`` documents each, ``MOST_BLOCKS`` blocks at most, a power of two). A target of
  q whole passes and a rest takes every block q times and, of one more pass, the first blocks of a
  second keyed permutation, the last of them only up to the document that comes nearest to the
  target. So taken words miss the target by less than one document.
* Tree. The root holds each source's number of drawn blocks; a node splits its vector in two by a
  multivariate hypergeometric draw, half of the shards to each side, down to single shards. A shard
  then owns a disjoint run of the permuted draws of every source, and its rows are shuffled locally
  by a keyed hash.

All draws come from the seed, so that reruns agree. Per-source figures (one row a source, at most
``MOST_SOURCES``) pass through the driver; documents and blocks stay distributed.

A NULL text has no words; documents without words go along with their blocks. Repeated rows are
rows of their own and share one fate. Empty tables, or tables without words, give an empty mix:
every document is taken 0 times. Other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textguard.llm.columns import others
from textguard.llm.scratch import written
from textguard.llm.words import WORD_PATTERN

SEED = 20_240
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_DOCUMENTS = 64
MOST_BLOCKS = 1 << 16
MOST_SOURCES = 1_000_000
#: Words of a shard, and shards at most.
SHARD_WORDS = 4_000_000
MOST_SHARDS = 1_024
#: Figures (sources times shards) that go to all tasks at most: 16 MB.
BROADCAST_CELLS = 1 << 21
#: A prime above any number of draws of a source.
STRIDE = (1 << 31) - 1


def targets(sizes: list[int], weights: list[int], most_repeats: int = MOST_REPEATS) -> list[float]:
    """Shares of all words by weight, none above ``most_repeats`` times its source."""
    total, found, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(found[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / weight > most_repeats * sizes[i]}
        for i in over or free:
            found[i] = float(most_repeats * sizes[i]) if over else rest * weights[i] / weight
        free = free - over if over else set()
    return found


def hypergeometric(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` blocks, drawn without replacement, come from each source."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, have in enumerate(counts.tolist()):
        left -= have
        # numpy's sampler takes up to a thousand million of either kind
        out[i] = _one_split(rng, have, left, draws)
        draws -= int(out[i])
    return out


def _one_split(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if not draws or not good:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    mean = draws * good / (good + bad)
    spread = math.sqrt(mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1))
    return int(np.clip(round(rng.normal(mean, spread)), max(0, draws - bad), min(good, draws)))


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """``[shard, source]``: the quotas split down a binary tree, every shard's sum within one."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, counts: np.ndarray) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        draws = int(counts.sum()) * (middle - low) // (high - low)
        left = hypergeometric(rng, counts, draws)
        split(low, middle, left)
        split(middle, high, counts - left)

    split(0, shards, np.array(quotas, np.int64))
    return out


def _place(seed: int):
    """A keyed hash of the row, 0 to 2**62 - 1, that orders a block's documents."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id", "_size"), 2)


def _turn(seed: int):
    """The place of the row's block among its source's blocks: a permutation of 0 .. blocks - 1."""
    step = F.lit(2 * (seed % 10_000) + 1) + 2 * F.col("number")
    return (F.col("_place") % F.col("blocks") * step + F.col("number")) % F.col("blocks")


def _with_source(rows: DataFrame, sources: DataFrame, cells: int) -> DataFrame:
    """Per-source figures beside each row: broadcast while they are small by count, else a join
    whose hot keys Spark splits."""
    side = F.broadcast(sources) if cells <= BROADCAST_CELLS else sources
    return rows.join(side, rows["_source"].eqNullSafe(side["_name"]))


def last_draws(placed: DataFrame) -> DataFrame:
    """``(number, whole, stop)``: whole blocks of the last pass, and the last place taken in the
    block after them (NULL: none)."""
    by_turn = Window.partitionBy("number").orderBy("turn")
    so_far = placed.groupBy("number", "rest", "turn").agg(F.sum("_size").alias("block_words")).select(
        "number", "rest", "turn", F.sum("block_words").over(by_turn).alias("end")
    )
    whole = so_far.groupBy("number", "rest").agg(
        F.coalesce(F.max(F.when(F.col("end") <= F.col("rest"), F.col("turn") + 1)), F.lit(0)).alias("whole"),
        F.coalesce(F.max(F.when(F.col("end") <= F.col("rest"), F.col("end"))), F.lit(0)).alias("before"),
    )
    # a row a source: Spark broadcasts it by its size, or splits a hot source in the join
    whole = written(whole, "whole-blocks")
    by_place = Window.partitionBy("number").orderBy("_place")
    partial = (
        placed.drop("rest").join(whole, "number")
        .where("turn = whole and _size > 0")
        .groupBy("number", "rest", "whole", "before", "_place").agg(F.sum("_size").alias("_size"))
        .select("number", "_place", (F.abs(F.col("rest") - F.col("before") - F.sum("_size").over(by_place))).alias("off"), (F.col("rest") - F.col("before")).alias("none"))
    )
    stops = partial.where(F.col("off") < F.col("none")).groupBy("number").agg(F.min_by("_place", F.struct("off", "_place")).alias("stop"))
    return whole.join(stops, "number", "left").select("number", "whole", "stop")


def draws(documents: DataFrame, with_text: bool = True, seed: int = SEED) -> DataFrame:
    """Each row with ``size``, ``source_size``, ``target``, ``copies`` and ``shards``.

    ``copies`` is how often the mix takes the row and ``shards`` names the shard of each copy.
    """
    spark = documents.sparkSession
    own = ("size", "source_size", "target", "copies", "shards", *(() if with_text else ("text",)))
    sized = documents.select(
        F.struct(*others(documents, *own)).alias("_row"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint").alias("_size"),
        F.col("source").alias("_source"),
        F.col("doc_id").alias("_id"),
    )
    sized = sized.withColumn("_place", _place(seed))
    narrow = written(sized if not with_text else sized.drop("_row"), "sizes")
    found = (
        narrow.groupBy("_source").agg(F.sum("_size").alias("words"), F.count("*").alias("documents"))
        .limit(MOST_SOURCES + 1).collect()
    )
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    # Python orders strings by code point
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))]
    plan = []
    for i, (row, target) in enumerate(zip(found, targets([r.words for r in found], weights), strict=True)):
        passes = int(target // row.words) if row.words else 0
        plan.append(
            {
                "_name": row["_source"], "number": i, "words": row.words, "target": target, "passes": passes,
                "blocks": min(MOST_BLOCKS, 1 << (row.documents // BLOCK_DOCUMENTS).bit_length()),
                "rest": target - passes * row.words,
            }
        )
    schema = "_name string, number int, words bigint, target double, passes int, blocks bigint, rest double"
    sources = spark.createDataFrame([tuple(p.values()) for p in plan], schema)
    placed = _with_source(narrow, sources, len(plan)).withColumn("turn", _turn(seed))
    last = {r.number: r for r in last_draws(placed).toLocalIterator()}
    for i, p in enumerate(plan):
        p["whole"], p["stop"] = (last[i].whole, last[i].stop) if i in last and p["words"] else (0, None)
        p["quota"] = p["blocks"] * p["passes"] + p["whole"] + (p["stop"] is not None)
    shards = max(1, min(MOST_SHARDS, sum(p["words"] for p in plan) // SHARD_WORDS))
    ends = np.cumsum(split_quotas([p["quota"] for p in plan], shards, seed), axis=0).T.tolist() if plan else []
    for p, e in zip(plan, ends, strict=True):
        p["ends"] = e
    sources = spark.createDataFrame(
        [tuple(p.values()) for p in plan], f"{schema}, whole bigint, stop bigint, quota bigint, ends array<bigint>"
    )
    drawn = _with_source(sized if with_text else narrow, sources, len(plan) * shards).withColumn("turn", _turn(seed))
    partly = (F.col("turn") == F.col("whole")) & F.col("stop").isNotNull() & (F.col("_place") <= F.col("stop"))
    copies = F.col("passes") + F.coalesce((F.col("turn") < F.col("whole")) | partly, F.lit(False)).cast("int")
    drawn = drawn.withColumn("copies", copies)
    # draws of a source are numbered pass by pass; a prime stride permutes them
    spots = F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1),
        lambda c: (F.col("turn") + c * F.col("blocks")) * F.lit(STRIDE) % F.col("quota"),
    )
    shard_of = lambda spot: F.size(F.filter("ends", lambda end: end <= spot))
    named = F.when(F.col("copies") > 0, F.transform(spots, shard_of)).otherwise(F.array().cast("array<int>"))
    return drawn.select(
        "_row.*", F.col("_size").alias("size"), F.col("words").alias("source_size"), "target", "copies", named.alias("shards")
    )


def mixture(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: a row per copy with its own columns, by shard and shuffled inside it."""
    whole = documents.select("doc_id", "source", "text", F.struct("*").alias("_whole"))
    drawn = draws(whole, seed=seed).where("copies > 0")
    copies = drawn.select("_whole", F.posexplode("shards").alias("_copy", "_shard"))
    order = F.xxhash64(F.lit(seed), F.col("_whole.doc_id"), "_copy")
    return copies.repartition("_shard").sortWithinPartitions("_shard", order).select("_whole.*")
