"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the trees' roots.

A leaf is the hash of a row's fields; every ``fanout`` consecutive nodes become the hash
of their hexadecimal digests, level by level, until one is left. Rows are numbered within
their tree by ranges of the whole table, so a group of any size is spread over tasks, and cut into aligned
blocks of a power of the fanout: a block's levels need no other block. A block is a matrix of digests of 64
bytes; its levels are formed by reshaping rows by fanout, and the siblings of all leaves on all
levels are found by index arithmetic. The digests of blocks are the leaves of the next table of blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.plans.session import ship_package, written

FANOUT = 3
#: Leaves of a block, at most.
BLOCK = 3_000
PATH = "array<struct<before:string,after:string>>"
_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
#: Leaves whose paths are formed at once.
_SLICE = 2048


def field(value: Column) -> Column:
    """A value as a part of a leaf: ``-`` for null, else the length of its text in bytes, a colon and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def block_levels(fanout: int, block: int = BLOCK) -> int:
    """Levels of a block: the most for which it has no more leaves than ``block``, and one at least."""
    n = 1
    while fanout ** (n + 1) <= block:
        n += 1
    return n


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _levels(leaves: np.ndarray, fanout: int, most: int, whole: bool) -> list[np.ndarray]:
    """Matrices of a block from its leaves up: to a single node if it is the ``whole`` tree, else over ``most`` levels."""
    out = [leaves]
    while (len(out[-1]) > 1) if whole else (len(out) <= most):
        below = np.ascontiguousarray(out[-1])
        runs = below[: len(below) // fanout * fanout].reshape(-1, fanout * 64)
        digests = [sha256(r).hexdigest() for r in runs]
        if len(below) % fanout:
            digests.append(sha256(below[len(runs) * fanout :].tobytes()).hexdigest())
        out.append(np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64))
    return out


def _reducer(fanout: int, most: int):
    schema = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])
    size = fanout**most

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, block, n = (table.column(c)[0].as_py() for c in ("tree", "block", "n"))
        top = _levels(_matrix(table.column("digest")), fanout, most, n <= size)[-1]
        return pa.table([[tree], [block], [-(-n // size)], [top.tobytes().decode()]], schema=schema)

    return run


def _strings(nodes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each item the digests of ``counts`` nodes from ``starts`` on, joined."""
    ends = np.cumsum(counts)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)
    offsets = np.append(0, 64 * ends).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(nodes[at])])


def _prover(fanout: int, most: int, names: list[str], schema: pa.Schema):
    """Rows of a block with their paths: siblings before and after on each level, the nearest first, then those of the block."""
    size = fanout**most

    def run(rows: pa.Table, parent: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n_all = rows.column("n")[0].as_py()
        levels = _levels(_matrix(rows.column("digest")), fanout, most, n_all <= size)[:-1]
        above = parent.column("p_path")[0].as_py()
        upper = [s for step in above for s in (step["before"], step["after"])]
        nodes = np.concatenate([*levels, np.frombuffer("".join(upper).encode(), np.uint8).reshape(-1, 64)])
        base = np.cumsum([0, *map(len, levels)])
        n, depth = len(rows), len(levels) + len(above)
        before, n_before, after, n_after = np.zeros((4, n, depth), np.int64)
        for k, level in enumerate(levels):
            node = np.arange(n) // fanout**k
            first = node - node % fanout
            last = np.minimum(first + fanout, len(level))
            before[:, k], n_before[:, k] = base[k] + first, node - first
            after[:, k], n_after[:, k] = base[k] + node + 1, last - node - 1
        at = base[-1]
        for k, step in enumerate(above, len(levels)):
            before[:, k], n_before[:, k] = at, len(step["before"]) // 64
            at += len(step["before"]) // 64
            after[:, k], n_after[:, k] = at, len(step["after"]) // 64
            at += len(step["after"]) // 64
        paths = []
        for i in range(0, n, _SLICE):
            m = min(_SLICE, n - i)
            if depth == 0:
                paths.append(pa.array([[]] * m, _PATH))
                continue
            pair = [_strings(nodes, s[i : i + m].ravel(), c[i : i + m].ravel()) for s, c in ((before, n_before), (after, n_after))]
            steps = pa.StructArray.from_arrays(pair, ["before", "after"])
            paths.append(pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * depth), steps).cast(_PATH))
        subroot = pa.repeat(parent.column("p_subroot")[0], n)
        return pa.table([*(rows.column(c) for c in names), subroot, pa.chunked_array(paths, _PATH)], schema=schema)

    return run


def _placed(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Numbers rows within their ``tree`` by ``order``: adds block, at (within it) and n (rows of the tree).

    Rows are dealt by ranges of (tree, order); a range knows how many rows of its trees stand in earlier ranges.
    """
    keys = ["tree", *order]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # so that repeated rows are spread over ranges too
    dealt = written(tied.repartitionByRange(*keys, "tie").withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    counts = counts.select("tree", "part", (F.sum("here").over(tree.orderBy("part")) - F.col("here")).alias("base"), F.sum("here").over(tree).alias("n"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order, "tie")).cast("long") - 1
    position = F.col("base") + F.col("inside")
    out = dealt.withColumn("inside", inside).join(counts, ["tree", "part"])
    out = out.withColumn("block", F.floor(position / size).cast("long")).withColumn("at", position % size)
    return out.drop("part", "tie", "base", "inside")


@dataclass
class Forest:
    """Trees as tables of blocks, the leaves' first, and each tree's root (tree, digest)."""

    tables: list[DataFrame]
    roots: DataFrame
    fanout: int
    most: int

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves' rows with their paths up to the trees' roots and on by ``above`` (tree, subroot, path), and its subroot."""
        size = self.fanout**self.most
        found = None
        for table in reversed(self.tables):
            tops = table.where(F.col("n") <= size).select("tree").distinct().join(above, "tree").select("tree", F.lit(0).cast("long").alias("block"), "subroot", "path")
            parents = tops if found is None else tops.unionByName(found.select("tree", F.col("place").alias("block"), "subroot", "path"))
            rows = table.withColumn("place", F.col("block") * size + F.col("at"))
            names = [c for c in rows.columns if c not in ("block", "at", "n")]
            kinds = {c: rows.schema[c].dataType.simpleString() for c in names}
            shape = ", ".join([*(f"{c} {kind}" for c, kind in kinds.items()), "subroot string", f"path {PATH}"])
            schema = pa.schema([*((c, _ARROW[kind]) for c, kind in kinds.items()), ("subroot", pa.string()), ("path", _PATH)])
            parents = parents.select(*[F.col(c).alias(f"p_{c}") for c in parents.columns])
            both = rows.groupBy("tree", "block").cogroup(parents.groupBy("p_tree", "p_block"))
            found = both.applyInArrow(_prover(self.fanout, self.most, names, schema), shape)
        return found


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}


def grown(leaves: DataFrame, order: list[str], fanout: int = FANOUT, block: int = BLOCK) -> Forest:
    """The trees of ``leaves`` (tree, digest, ``order`` and more), in the order of their columns ``order``."""
    ship_package(leaves.sparkSession)
    most = block_levels(fanout, block)
    size = fanout**most
    tables = [written(_placed(leaves, order, size), "leaves")]
    roots = []
    while True:
        shape = "tree string, at long, n long, digest string"
        up = written(tables[-1].select("tree", "block", "at", "n", "digest").groupBy("tree", "block").applyInArrow(_reducer(fanout, most), shape), "nodes")
        roots.append(up.where("n = 1").select("tree", "digest"))
        rest = up.where("n > 1")
        if rest.isEmpty():
            return Forest(tables, reduce(DataFrame.unionByName, roots), fanout, most)
        tables.append(rest.select("tree", F.floor(F.col("at") / size).cast("long").alias("block"), (F.col("at") % size).alias("at"), "n", "digest"))


def manifest(docs: DataFrame, columns: list[str], tree: str = "source", key: str = "doc_id", also: dict[str, Column] | None = None, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """A row for every row of ``docs`` with its leaf, its tree's root, the root of all and its path to that.

    Returns ``key``, ``tree``, the columns ``also`` (expressions of ``docs``), leaf, subroot, root and path, an array of
    the siblings (before, after) on each level from the leaf's up; where a node stands alone, both are empty.
    A leaf is the hash of ``columns``; other columns are ignored. Trees stand in the order of
    ``tree``, null first; in a tree rows ascend by ``key``, null first, and rows of one key by leaf. A tree of one
    row is its leaf, a dataset of one tree that tree's root. An empty table gives no rows. Texts are
    hashed where they are read and are not shuffled.
    """
    also = also or {}
    rows = docs.select(
        F.when(F.col(tree).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(tree).cast("string"))).alias("tree"),
        F.col(key).alias("key"), leaf(*map(F.col, columns)).alias("digest"), *[c.alias(f"also_{n}") for n, c in also.items()],
    )
    trees = grown(written(rows, "hashes"), ["key", "digest"], fanout, block)
    top = grown(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], fanout, block)
    start = docs.sparkSession.createDataFrame([("", "", [])], f"tree string, subroot string, path {PATH}")
    above = written(top.paths(start).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"), "paths")
    root = top.roots.select(F.col("digest").alias("root"))  # one row
    out = trees.paths(above).crossJoin(F.broadcast(root))
    name = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias(tree)
    return out.select(F.col("key").alias(key), name, *[F.col(f"also_{n}").alias(n) for n in also], F.col("digest").alias("leaf"), "subroot", "root", "path")


def siblings(path: Column) -> Column:
    """The digests of a path, joined from the leaf up and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along ``path``."""
    return F.aggregate(path, digest, lambda held, s: F.sha2(F.concat(s["before"], held, s["after"]), 256))
