"""Exact top-k inner-product search by ball-tree branch and bound on every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators.ranking import running_total
from siltmark.plans.session import ship_package, written

LEAF = 128


class BallTree:
    """A ball tree over integer vectors, for searches by inner product.

    A ball is halved at the median of its widest direction until ``leaf`` rows are left;
    halves are cut by position, so that equal vectors can't stop it.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        #: Pairs of a query and a row whose product was computed, of all pairs asked for.
        self.scored = self.asked = 0
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        if len(ids):
            self._grow(np.arange(len(ids)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        points = self.vectors[rows]
        centre = points.mean(axis=0)
        away = np.sqrt(((points - centre) ** 2).sum(axis=1))
        at = len(self.nodes)
        self.nodes.append((centre, float(away.max()), None, -1, -1))
        if len(rows) <= leaf:
            self.nodes[at] = (centre, float(away.max()), rows, -1, -1)
            return at
        far = points[int(away.argmax())]
        axis = far - points[int(((points - far) ** 2).sum(axis=1).argmax())]
        half = np.argsort(points @ axis, kind="stable")
        left = self._grow(rows[half[: len(half) // 2]], leaf)
        right = self._grow(rows[half[len(half) // 2 :]], leaf)
        self.nodes[at] = (centre, float(away.max()), None, left, right)
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray):
        """The k best of this tree for every query, with those scores below ``floors`` left out.

        A node's bound is the inner product with its centre plus its radius times the
        length of the query. Nodes are opened in order of the best bound over the queries
        that still need them; a query drops out of a node whose bound is below its kth
        score so far. Bounds are loosened by a relative 1e-9, against rounding.
        """
        n = len(queries)
        best = np.full((n, k), -np.inf)
        found = np.full((n, k), np.iinfo(np.int64).max)
        kth = floors.astype(np.float64).copy()
        if not self.nodes or not n:
            return best, found
        self.asked += n * len(self.ids)
        length = np.sqrt((queries**2).sum(axis=1))

        def bound(at: int, who: np.ndarray) -> np.ndarray:
            centre, radius = self.nodes[at][:2]
            b = queries[who] @ centre + radius * length[who]
            return b + 1e-9 * (np.abs(b) + 1) + 1e-9 * length[who] * (radius + np.sqrt((centre**2).sum()))

        everyone = np.arange(n)
        b = bound(0, everyone)
        heap = [(-b.max(), 0, everyone, b)]
        while heap:
            _, at, who, b = heapq.heappop(heap)
            live = b >= kth[who]
            who = who[live]
            if not len(who):
                continue
            rows, left, right = self.nodes[at][2:]
            if rows is None:
                for child in (left, right):
                    c = bound(child, who)
                    if (keep := c >= kth[who]).any():
                        heapq.heappush(heap, (-c[keep].max(), child, who[keep], c[keep]))
                continue
            self.scored += len(who) * len(rows)
            scores = queries[who] @ self.vectors[rows].T
            ids = self.ids[rows]
            scores[query_ids[who][:, None] == ids[None, :]] = -np.inf
            all_s = np.concatenate([best[who], scores], axis=1)
            all_i = np.concatenate([found[who], np.broadcast_to(ids, scores.shape)], axis=1)
            top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
            best[who] = np.take_along_axis(all_s, top, axis=1)
            found[who] = np.take_along_axis(all_i, top, axis=1)
            kth[who] = np.maximum(kth[who], best[who, k - 1])
        best[best < floors[:, None]] = -np.inf
        return best, found


#: Integers up to this, on both sides, are multiplied and added up exactly in doubles, for vectors of up to 2 ** 13 components.
NARROW, MOST_WIDTH = 1 << 20, 1 << 13
_LONG = 1 << 63


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with components floor(scale * x) as doubles that are whole numbers, from vec_id and embedding.

    Rows whose id or vector is null, or that hold null or non-finite components (after scaling), are left out.
    """
    x = F.transform("embedding", lambda c: c.cast("double") * scale)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    # From 2 ** 52 on all doubles are whole, and a long might not hold them.
    whole = F.transform(x, lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, padded with zeros to the longest."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    run = np.repeat(np.arange(len(sizes)), sizes)
    out[run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten())
    return out


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all of ``b``, whole doubles of any size, as longs or Python's integers."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < _LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).dot(whole(b).T)


class Shard:
    """The rows of one shard: a ball tree of those with narrow components, and the others as they are."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int):
        narrow = np.abs(points).max(axis=1, initial=0) <= NARROW if points.shape[1] <= MOST_WIDTH else np.zeros(len(ids), bool)
        self.ids, self.points, self.wide = ids, points, ~narrow
        self.tree = BallTree(ids[narrow], points[narrow], leaf)

    def best(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[int, int, int]]:
        """(query, row, score) of the k best rows for each query, those below its floor left out."""
        width = max(self.points.shape[1], queries.shape[1])
        if width > self.points.shape[1]:
            self.points = _padded(self.points, width)
            self.tree = BallTree(self.ids[~self.wide], self.points[~self.wide], self.tree.leaf)
        queries = _padded(queries, width)
        narrow = np.abs(queries).max(axis=1, initial=0) <= NARROW if width <= MOST_WIDTH else np.zeros(len(ids), bool)
        out: list[tuple[int, int, int]] = []
        if narrow.any():
            best, found = self.tree.search(ids[narrow], queries[narrow], k, floors[narrow])
            q, j = np.nonzero(np.isfinite(best))
            out += zip(ids[narrow][q].tolist(), found[q, j].tolist(), best[q, j].astype(np.int64).tolist())
        # Whatever is too large for doubles is multiplied as it is, a few queries at a time.
        for who, rows in ((np.flatnonzero(narrow), np.flatnonzero(self.wide)), (np.flatnonzero(~narrow), np.arange(len(self.ids)))):
            for s in range(0, len(who) if len(rows) else 0, 16):
                some = who[s : s + 16]
                for i, scores in zip(some, exact_products(queries[some], self.points[rows])):
                    mine = sorted((-int(x), int(r)) for x, r in zip(scores, self.ids[rows]) if r != ids[i])[:k]
                    out += [(int(ids[i]), r, -x) for x, r in mine if -x >= floors[i]]
        return out


def _searcher(k: int, leaf: int, block_rows: int):
    """Builds a shard's tree from its rows, which come first, and then runs the queries that follow through it, block by block."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            shards, asks = np.asarray(batch.column("shard")), np.asarray(batch.column("asks").cast(pa.int8()))
            cut = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]), True]) if len(shards) else [0]
            for s, e in zip(cut[:-1], cut[1:]):
                if shards[s] != now:
                    now, held, shard = shards[s], [], None
                part = batch.slice(s, e - s)
                ids, points = np.asarray(part.column("vec_id")), _matrix(part.column("v"))
                if not asks[s]:
                    held.append((ids, points))
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    width = max(p.shape[1] for _, p in held)
                    shard = Shard(np.concatenate([i for i, _ in held]), np.concatenate([_padded(p, width) for _, p in held]), leaf)
                    held = []
                floors = np.asarray(part.column("least").fill_null(-np.inf))
                for a in range(0, e - s, block_rows):
                    rows = shard.best(ids[a : a + block_rows], points[a : a + block_rows], k, floors[a : a + block_rows])
                    if rows:
                        q, r, x = zip(*rows)
                        # Beyond a long the score is its bound; among the k best of a shard that can tie.
                        x = [min(max(v, -_LONG), _LONG - 1) for v in x]
                        yield pa.record_batch([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(x, pa.int64())], schema=schema)

    return run


def top_k(vectors: DataFrame, query_every: int = 50, k: int = 5, shard_rows: int = 16384, block_rows: int = 2048, leaf: int = LEAF) -> DataFrame:
    """The k best inner products of every query: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and embedding; other columns are ignored. Queries are the rows
    whose vec_id is divisible by ``query_every``; candidates are all rows but the query's
    own; where a query's vec_id is repeated, its least vector asks. Scores are exact integers (of the vectors times 256, rounded down); ties go to the
    smaller vec_id. Shorter vectors count as padded with zeros. Rows that are null, or hold
    null or non-finite components, take no part; repeated rows are candidates of their own. An
    empty table gives an empty result. Components too large for exact sums of doubles are
    multiplied as integers, outside the tree; a score that no long can hold is given as the largest or least long.

    Rows are cut into shards of ``shard_rows`` by their rank along the component that varies
    most, so that a shard is a slice of the data and a row that is repeated very often is spread over several. Each
    shard is one ball tree, built once; the queries follow it in blocks, so a task holds a
    shard and a block. A first search in the middle shard gives every query a kth score that all
    shards then share as the floor under which nodes and rows are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    base = written(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    longest = base.agg(F.max(F.size("v"))).first()[0] or 0
    spread = base.agg(*[F.var_pop(F.get("v", F.lit(i))).alias(f"c{i}") for i in range(min(longest, 256))]).first() if longest else []
    axis = max(range(len(spread)), key=lambda i: spread[i] or 0.0) if longest else 0
    along = F.coalesce(F.get("v", F.lit(axis)), F.lit(0.0))
    ranked = running_total(base.withColumn("one", F.lit(1)), [along, F.col("row")], "one", "before")
    shard = F.floor(F.col("before") / shard_rows).cast("int")
    rows = written(ranked.select(shard.alias("shard"), F.lit(False).alias("asks"), "vec_id", "v", F.lit(None).cast("double").alias("least")), "shards")
    shards = (rows.agg(F.max("shard")).first()[0] or 0) + 1
    asked = written(base.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    schema = "query_id long, vec_id long, score long"
    middle = shards // 2

    def searched(rows: DataFrame, asked: DataFrame, where: Column) -> DataFrame:
        sent = asked.select(F.explode(where).alias("shard"), F.lit(True).alias("asks"), "vec_id", "v", "least")
        both = rows.unionByName(sent).repartition("shard").sortWithinPartitions("shard", "asks")
        return both.mapInArrow(_searcher(k, leaf, block_rows), schema)

    first = searched(rows.where(F.col("shard") == middle), asked.withColumn("least", F.lit(None).cast("double")), F.array(F.lit(middle)))
    first = written(first, "first")
    found = first
    if shards > 1:
        least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        # A floor is a double just below the score, so that rounding never raises it.
        floor = F.col("least").cast("double") - F.abs(F.col("least")) * 2.0**-50 - 1
        floors = asked.join(least.select(F.col("query_id").alias("vec_id"), floor.alias("least")), "vec_id", "left")
        others = F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), middle)
        found = found.unionByName(searched(rows.where(F.col("shard") != middle), floors, others))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
