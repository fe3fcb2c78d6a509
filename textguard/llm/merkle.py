"""A Merkle manifest of a table: one tree for each group of rows, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields, each ``-`` if NULL, else its UTF-8 byte count, ``:`` and
its value. Leaves of a group ascend by key; while a level has several nodes, every two consecutive
ones (the last alone where the number is odd) become the digest of their hex digests. The groups'
roots, ordered by group (NULL first, by bytes), are the leaves of the upper tree.

Checkpoint and recompute: of the levels only every tenth is stored (``STEP``).

1. Leaves get their place in the order of the whole table from a range shuffle: numbered inside
   each sorted task, moved on by the rows of the tasks before. A group's first place gives the
   place in its tree.
2. The 1,024 nodes of an aligned subtree meet in one task, which computes its ten levels and keeps
   the top one. Every stored level is a written table 1,024 times smaller than the one before.
3. Proofs go downwards: a task gets an aligned subtree's stored nodes and the siblings above it,
   computes the missing levels again, hands to each node its siblings and forgets the levels.

No task holds more than a subtree and its one proof, whatever the size of a group; a group with most
of the rows is spread over its subtrees. All stored tables are Parquet in shared storage.

A NULL key comes first. Rows that share a key are ordered by their leaf, and each is a leaf; rows
that are alike in all of that have different places and so different proofs. NULL groups are a group.
A table with one row has its leaf as root and empty proofs; an empty table has no root and gives an
empty table. Fields are told as they are, empty or very long; columns that are not named are not
read, so that their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.llm.columns import named
from textguard.llm.places import numbered
from textguard.llm.scratch import new_folder, written

#: Levels from one stored level to the next; a task holds twice two to this power digests.
STEP = 10
NODES = "tree bigint, pos bigint, size bigint, digest string"
PATHS = "tree bigint, pos bigint, path string, subroot string"


def told(value: Column) -> Column:
    """One field of a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column | str) -> Column:
    """The leaf's digest, 64 lower-case hex digits; fields are columns or their names."""
    return F.sha2(F.concat(*[told(named(f) if isinstance(f, str) else f) for f in fields]), 256)


def depth(size: int) -> int:
    """Levels above ``size`` nodes, up to the one node on top."""
    return (size - 1).bit_length()


def levels(digests: list[str], height: int) -> list[list[str]]:
    """The nodes and ``height`` levels above them."""
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([sha256("".join(below[i : i + 2]).encode()).hexdigest() for i in range(0, len(below), 2)])
    return out


def siblings(own: list[list[str]], at: int) -> list[str]:
    """The other node of the pair at each level on the way up, where there is one."""
    out = []
    for row in own[:-1]:
        other = at ^ 1
        if other < len(row):
            out.append(row[other])
        at >>= 1
    return out


def fold(digest: str, pos: int, size: int, path: list[str]) -> str:
    """The root that a node and its siblings give; takes the siblings it uses from ``path``."""
    while size > 1:
        if pos ^ 1 < size:
            other = path.pop(0)
            digest = other + digest if pos & 1 else digest + other
        digest = sha256(digest.encode()).hexdigest()
        pos, size = pos >> 1, (size + 1) >> 1
    return digest


def _block(step: int) -> list[Column]:
    return [F.col("tree"), F.shiftright("pos", step).alias("block")]


def _regrown(nodes: pa.Table, step: int) -> tuple[list[list[str]], int]:
    """The levels of one aligned subtree from its stored nodes, in order of place."""
    size = nodes.column("size")[0].as_py()
    return levels(nodes.column("digest").to_pylist(), min(step, depth(size))), size


def _next_level(nodes: DataFrame, step: int) -> DataFrame:
    """The stored level above: one node for each aligned subtree."""

    def top(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        grown, size = _regrown(part, step)
        first = part.column("pos")[0].as_py()
        return pa.table(
            {
                "tree": part.column("tree")[:1].combine_chunks(),
                "pos": pa.array([first >> step], pa.int64()),
                "size": pa.array([-(-size >> step)], pa.int64()),
                "digest": grown[-1],
            }
        )

    return nodes.select("tree", "pos", "size", "digest").groupBy(*_block(step)).applyInArrow(top, NODES)


def stored_levels(nodes: DataFrame, folder: str, step: int, build: bool) -> list[DataFrame]:
    """The given nodes and every ``step``-th level above, down to one node for each tree; written
    first where ``build``."""
    spark, kept = nodes.sparkSession, [nodes]
    while True:
        path = f"{folder}/level-{step * len(kept)}"
        if build:
            _next_level(kept[-1], step).write.mode("overwrite").parquet(path)
        kept.append(spark.read.parquet(path))
        if (kept[-1].agg(F.max("size")).first()[0] or 1) == 1:
            return kept


def paths_below(nodes: DataFrame, above: DataFrame, step: int) -> DataFrame:
    """``PATHS`` of a stored level: each node's siblings up to the root, its own subtree's first.

    ``above`` has those of the next stored level.
    """

    def hand_down(part: pa.Table, upper: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        grown, _ = _regrown(part, step)
        path, subroot = upper.column("path")[0].as_py(), upper.column("subroot")[0].as_py()
        count = part.num_rows
        return pa.table(
            {
                "tree": part.column("tree"),
                "pos": part.column("pos"),
                "path": ["".join(siblings(grown, i)) + path for i in range(count)],
                "subroot": [subroot] * count,
            }
        )

    upper = above.select("tree", F.col("pos").alias("block"), "path", "subroot")
    return (
        nodes.select("tree", "pos", "size", "digest").groupBy(*_block(step))
        .cogroup(upper.groupBy("tree", "block"))
        .applyInArrow(hand_down, PATHS)
    )


@dataclass(frozen=True)
class Manifest:
    """``leaves(key, leaf, shown, tree, pos, size, digest)``, the stored levels of the groups'
    trees and of the upper tree; the leaves are the first stored level."""

    leaves: DataFrame
    trees: list[DataFrame]
    upper: list[DataFrame]
    folder: str
    step: int

    def roots(self) -> DataFrame:
        """``(tree, group, leaves, subroot)``."""
        groups = self.leaves.sparkSession.read.parquet(f"{self.folder}/groups")
        tops = self.trees[-1].select("tree", F.col("digest").alias("subroot"))
        return groups.select("tree", "group", F.col("size").alias("leaves")).join(tops, "tree")

    def root(self) -> DataFrame:
        """One row, one value; no row for an empty table."""
        return self.upper[-1].select(F.col("digest").alias("root"))


def commit(
    rows: DataFrame,
    fields: Sequence[str],
    key: str,
    group: str,
    shown: Column | None = None,
    folder: str | None = None,
    step: int = STEP,
) -> Manifest:
    """Writes the manifest of ``rows`` to ``folder``, a new one in shared storage by default.

    ``shown`` is a leaf that someone else shows for the row, where it is not NULL; it has no part in
    the trees and is held against them by :func:`proofs`.
    """
    spark = rows.sparkSession
    folder = folder or new_folder(spark, "manifest")
    leaf = leaf_of(*fields)
    rows.select(
        named(group).cast("string").alias("group"), named(key).cast("bigint").alias("key"), leaf.alias("leaf"),
        (F.lit(None) if shown is None else shown).cast("string").alias("shown"),
        F.monotonically_increasing_id().alias("nth"),
    ).write.mode("overwrite").parquet(f"{folder}/digests")
    digests = spark.read.parquet(f"{folder}/digests")
    ordered = numbered(digests, ["group", "key", "leaf", "nth"], "place", f"{folder}/ordered")
    sizes = ordered.groupBy("group").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    numbered(sizes, ["group"], "tree", f"{folder}/sizes").write.mode("overwrite").parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups").withColumnRenamed("group", "_of")
    place = (F.col("place") - F.col("start")).alias("pos")
    ordered.join(groups, F.col("group").eqNullSafe(F.col("_of"))).select(
        "key", "leaf", "shown", "tree", place, "size"
    ).write.mode("overwrite").parquet(f"{folder}/leaves")
    return _manifest(spark, folder, step, True)


def open_manifest(spark: SparkSession, folder: str, step: int = STEP) -> Manifest:
    """A manifest that :func:`commit` wrote with the same ``step``, for proofs in a later job."""
    return _manifest(spark, folder, step, False)


def _manifest(spark: SparkSession, folder: str, step: int, build: bool) -> Manifest:
    leaves = spark.read.parquet(f"{folder}/leaves").withColumn("digest", F.col("leaf"))
    trees = stored_levels(leaves, f"{folder}/trees", step, build)
    count = spark.read.parquet(f"{folder}/groups").agg(F.count("*")).scalar()
    tops = trees[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), count.alias("size"), "digest")
    return Manifest(leaves, trees, stored_levels(tops, f"{folder}/upper", step, build), folder, step)


PROVED = "key bigint, leaf string, subroot string, proof_sha256 string, folded_root string, path string"


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf ``PROVED``, ``root`` and ``verified``; ``path`` is all its siblings in one string.

    ``folded_root`` is computed from the shown leaf, where there is one, else from the leaf, and
    from the siblings; ``verified`` says whether that is the root.
    """
    step, spark = manifest.step, manifest.leaves.sparkSession
    root = manifest.root()
    above = manifest.upper[-1].select(
        "tree", "pos", F.lit("").alias("path"), F.col("digest").alias("subroot")
    )
    for nodes in reversed(manifest.upper[:-1]):
        above = paths_below(nodes, above, step)
    # the upper tree's nodes are the trees' tops
    tops = manifest.trees[-1].select("tree", F.col("digest").alias("_top"))
    above = above.select(F.col("pos").alias("tree"), "path").join(tops, "tree").select(
        "tree", F.lit(0).cast("bigint").alias("pos"), "path", F.col("_top").alias("subroot")
    )
    for level, nodes in reversed(list(enumerate(manifest.trees[1:-1], 1))):
        above = written(paths_below(nodes, above, step), f"paths-{step * level}")

    trees = spark.read.parquet(f"{manifest.folder}/groups").agg(F.count("*"))

    def prove(part: pa.Table, upper: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        grown, size = _regrown(part, step)
        path, subroot = upper.column("path")[0].as_py(), upper.column("subroot")[0].as_py()
        high = [path[i : i + 64] for i in range(0, len(path), 64)]
        tree, count = part.column("tree")[0].as_py(), part.column("trees")[0].as_py()
        paths, hashes, folded = [], [], []
        first = part.column("pos")[0].as_py()
        for i, (leaf, shown) in enumerate(zip(part.column("leaf").to_pylist(), part.column("shown").to_pylist(), strict=True)):
            way = siblings(grown, i) + high
            whole = "".join(way)
            paths.append(whole)
            hashes.append(sha256(whole.encode()).hexdigest())
            folded.append(fold(fold(shown or leaf, first + i, size, way), tree, count, way))
        return pa.table(
            {
                "key": part.column("key"),
                "leaf": part.column("leaf"),
                "subroot": [subroot] * len(paths),
                "proof_sha256": hashes,
                "folded_root": folded,
                "path": paths,
            }
        )

    leaves = manifest.leaves.withColumn("trees", trees.scalar())
    upper = above.select("tree", F.col("pos").alias("block"), "path", "subroot")
    proved = (
        leaves.groupBy(*_block(step))
        .cogroup(upper.groupBy("tree", "block"))
        .applyInArrow(prove, PROVED)
    )
    return proved.withColumn("root", root.scalar()).select(
        "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "path",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
