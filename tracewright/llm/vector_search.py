"""Exact top-k by inner product with KD-trees per shard.

A top tree, of median splits of a bounded sample, deals vectors to leaves, so
that shards are compact; each shard's own tree splits at medians and keeps a
tight box for every node. A query visits nodes best first by the largest inner
product that their box allows, and stops at the k-th score found so far. That
score starts from the query's own leaf; only leaves whose box can still reach
it see the query. The sample steers the work alone, never the result.

All sums are exact integers, in doubles below 2^53, in longs below 2^63, and
in Python's integers beyond."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_batch, written

#: Vectors of a shard and of a tree's leaf, and queries answered together.
SHARD, LEAF, QUERIES = 8_192, 64, 512
#: Bounds of the top tree: its leaves and the vectors sampled for it.
LEAVES, SAMPLE = 256, 16_384
FOUND = "query_id long, vec_id long, score decimal(38,0)"
SCORE = pa.decimal128(38, 0)


def exact(x: np.ndarray, largest: int) -> np.ndarray:
    """x in the type in which sums of absolute value up to `largest` are exact."""
    return x.astype(np.float64 if largest < 2**53 else np.int64 if largest < 2**63 else object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


class Tree:
    """A KD-tree over integer vectors, in arrays; a node's span ends in its first child, or -1."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        low, high, self.spans = [], [], []
        queue = [(0, len(ids))]
        while len(self.spans) < len(queue):
            a, b = queue[len(self.spans)]
            own = x[order[a:b]]
            low.append(own.min(0))
            high.append(own.max(0))
            split = b - a > leaf and bool((high[-1] > low[-1]).any())
            self.spans.append((a, b, len(queue) if split else -1))
            if split:
                axis, mid = int((high[-1].astype(float) - low[-1].astype(float)).argmax()), (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, axis], mid - a)]
                queue += [(a, mid), (mid, b)]
        self.low, self.high = np.array(low), np.array(high)
        self.ids, self.x, self.largest = ids[order], x[order], _largest(x)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: list[int | None]) -> Iterator[tuple[int, int, int]]:
        """(query, vec_id, score) of up to k best per query that reach least[query]; a vector with the query's own id is left out."""
        largest = max(1, queries.shape[1]) * self.largest * _largest(queries)
        queries, x, low, high = (exact(v, largest) for v in (queries, self.x, self.low, self.high))
        bounds = upper_bounds(queries, low, high)
        for q in range(len(queries)):
            best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
            reach = float("-inf") if least[q] is None else least[q]
            heap = [(-bounds[q, 0], 0)]
            while heap and -heap[0][0] >= reach:
                a, b, child = self.spans[heapq.heappop(heap)[1]]
                if child >= 0:
                    for c in (child, child + 1):
                        if bounds[q, c] >= reach:
                            heapq.heappush(heap, (-bounds[q, c], c))
                    continue
                scores = x[a:b] @ queries[q]
                for j in np.flatnonzero(scores >= reach) if best or least[q] is not None else range(b - a):
                    vec = int(self.ids[a + j])
                    if vec != own[q]:
                        heapq.heappush(best, (int(scores[j]), -vec))
                        if len(best) > k:
                            heapq.heappop(best)
                if len(best) == k:
                    reach = max(reach, best[0][0])
            yield from ((q, -v, s) for s, v in best)


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with any vector of each box, in exact arithmetic."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


class TopTree:
    """Median splits of a sample down to a number of leaves, as (axis, value, first child) for each node; leaves have axis -1."""

    def __init__(self, x: np.ndarray, leaves: int) -> None:
        self.nodes: list[tuple[int, int, int]] = []
        queue = [(x, leaves)]
        self.leaves = 0
        while len(self.nodes) < len(queue):
            own, n = queue[len(self.nodes)]
            spread = own.max(0).astype(float) - own.min(0).astype(float) if len(own) > 1 else np.zeros(1)
            if n < 2 or not spread.max():
                self.nodes.append((-1, self.leaves, -1))
                self.leaves += 1
                continue
            axis = int(spread.argmax())
            value = int(np.sort(own[:, axis])[len(own) // 2])
            if value == own[:, axis].min():
                value += 1
            self.nodes.append((axis, value, len(queue)))
            side = own[:, axis] >= value
            queue += [(own[~side], n // 2), (own[side], n - n // 2)]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            axis, value, child = self.nodes[node]
            if axis < 0:
                out[rows] = value
            else:
                side = x[rows, axis] >= value
                stack += [(child, rows[~side]), (child + 1, rows[side])]
        return out


def _rows(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _answered(rows: DataFrame, k: int) -> DataFrame:
    """Best matches from rows (task, kind, id, least, x), a task's vectors (kind 0) before its queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, vectors, tree, asked, out = None, [], [], None, [], []

        def answer() -> None:
            nonlocal tree
            if asked and ids:
                if tree is None:
                    tree = Tree(np.array(ids), np.array(vectors))
                own = np.array([a[0] for a in asked])
                found = tree.search(np.array([a[2] for a in asked]), own, k, [a[1] for a in asked])
                out.extend((int(own[q]), v, Decimal(s)) for q, v, s in found)
            asked.clear()

        def table() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), SCORE)
            made = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], ["query_id", "vec_id", "score"])
            out.clear()
            return made

        for batch in batches:
            values = batch.column(4)
            flat, offsets = np.asarray(values.flatten()), np.asarray(values.offsets) - values.offsets[0].as_py()
            for n, (t, kind, i, least) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True)):
                if t != task:
                    answer()
                    task, ids, vectors, tree = t, [], [], None
                x = flat[offsets[n] : offsets[n + 1]]
                if kind:
                    asked.append((i, None if least is None else int(least), x.copy()))
                    if len(asked) >= QUERIES:
                        answer()
                else:
                    ids.append(i)
                    vectors.append(x.copy())
            if out:
                yield table()
        answer()
        if out:
            yield table()

    ordered = rows.select("task", "kind", "id", "least", "x").repartition("task").sortWithinPartitions("task", "kind", "id")
    return ordered.mapInArrow(run, FOUND)


def _dealt(vectors: DataFrame, widths: dict[int, int]) -> DataFrame:
    """Rows (width, id, x) with leaf: that of the top tree of their width, made from a bounded sample."""
    tops: dict[int, TopTree] = {}
    total = max(1, sum(widths.values()))
    for width, n in widths.items():
        if n > SHARD:
            own = vectors.filter(F.col("width") == width)
            chosen = own.filter((F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2**31)) + 0.5) / 2**31 < SAMPLE / total).select("x").limit(2 * SAMPLE).toArrow()  # steers alone
            if chosen.num_rows:
                tops[width] = TopTree(_rows(chosen.column(0).combine_chunks()), min(LEAVES, -(-n // SHARD)))

    def make():
        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            width, x = np.asarray(batch.column(0)), batch.column(2)
            leaf = np.zeros(len(width), np.int64)
            for w in np.unique(width):
                if w in tops:
                    own = np.flatnonzero(width == w)
                    leaf[own] = tops[w].leaf(_rows(x.take(pa.array(own))))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["width", "id", "x", "leaf"])

        return place

    return by_batch(vectors.select("width", "id", "x"), "width int, id long, x array<long>, leaf long", make)


def _boxes(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """width -> leaves with their boxes (low, high): at most LEAVES rows for each width."""

    def make():
        def bound(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = np.stack([np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1))])
            found, inverse = np.unique(keys, axis=1, return_inverse=True)
            low, high = [], []
            for k in range(found.shape[1]):
                own = _rows(batch.column(2).take(pa.array(np.flatnonzero(inverse.reshape(-1) == k))))
                low.append(own.min(0))
                high.append(own.max(0))
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32)), pa.array(found[1]), pa.array(low, kind), pa.array(high, kind)], ["width", "leaf", "low", "high"])

        return bound

    parts = by_batch(vectors.select("width", "leaf", "x"), "width int, leaf long, low array<long>, high array<long>", make)
    each = parts.select("width", "leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "b")).groupBy("width", "leaf", "at").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    found = each.groupBy("width", "leaf").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("box")).orderBy("width", "leaf").collect()
    out = {}
    for width in {r["width"] for r in found}:
        own = [r for r in found if r["width"] == width]
        out[width] = (np.array([r["leaf"] for r in own]), *(np.array([[b[side] for b in r["box"]] for r in own], np.int64) for side in ("low", "high")))
    return out


def _reaching(queries: DataFrame, boxes: dict) -> DataFrame:
    """Rows (width, leaf, id, least, x) of queries for every other leaf whose box allows `least`."""

    def make():
        def reach(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, leaves = [], []
            width, home, least = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3).to_pylist()
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                names, low, high = boxes[int(w)]
                x = _rows(batch.column(4).take(pa.array(own)))
                largest = x.shape[1] * _largest(x) * max(_largest(low), _largest(high))
                bounds = upper_bounds(*(exact(v, largest) for v in (x, low, high)))
                for q, k in zip(own, range(len(own)), strict=True):
                    at = names if least[q] is None else names[np.flatnonzero(bounds[k] >= int(least[q]))]
                    at = at[at != home[q]]
                    rows += [q] * len(at)
                    leaves += at.tolist()
            taken = batch.take(pa.array(rows, pa.int64()))
            return taken.set_column(1, "leaf", pa.array(leaves, pa.int64()))

        return reach

    return by_batch(queries.select("width", "leaf", "id", "least", "x"), "width int, leaf long, id long, least decimal(38,0), x array<long>", make)


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest inner products of floor(scale * x).

    Queries are the rows whose vec_id is divisible by `every`. Null vectors,
    those with null or non-finite components, empty ones, null ids, and
    vectors whose inner product with themselves reaches 2^125 take no part;
    vectors of different lengths are not compared. Ranks follow the exact
    scores; a score that no long can hold is given as the nearest one. Ties go
    to the smaller vec_id; a row never matches rows of its own vec_id, and
    repeated rows of a vec_id count once, by the least of their vectors. Other
    columns are ignored; an empty table gives no rows."""
    fine = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))"
    y = F.transform(F.col("embedding"), lambda v: F.lit(float(scale)) * v.cast("double"))
    small = "aggregate(y, 0D, (s, v) -> s + floor(v) * floor(v)) < pow(2D, 125)"
    short = embeddings.filter(F.expr(fine)).select(F.col("vec_id").cast("long").alias("id"), y.alias("y"))
    whole = "forall(y, v -> abs(v) < pow(2D, 62.5D))"
    usable = short.filter(F.expr(whole)).filter(F.expr(small.replace("floor(v) * floor(v)", "cast(floor(v) as double) * cast(floor(v) as double)")))
    usable = usable.select("id", F.transform("y", lambda v: F.floor(v).cast("long")).alias("x")).withColumn("width", F.size("x"))
    usable = usable.groupBy("id").agg(F.min_by("x", F.struct("width", "x")).alias("x")).withColumn("width", F.size("x"))
    counted = written(usable)
    widths = {r["width"]: r["n"] for r in counted.groupBy("width").agg(F.count("*").alias("n")).collect()}
    placed = _dealt(counted, widths)
    sizes = placed.groupBy("width", "leaf").agg(F.count("*").alias("size"))
    vectors = written(placed.join(F.broadcast(sizes), ["width", "leaf"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / SHARD))))
    blocks = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("size") / (SHARD * every)))).alias("block")

    def asked(rows: DataFrame) -> DataFrame:
        """Queries (width, leaf, id, least, x) against their leaf: one task for each shard of it and block of queries."""
        shards = vectors.groupBy("width", "leaf").agg(F.max("shard").alias("last"), F.first("size").alias("size"))
        put = rows.join(F.broadcast(shards), ["width", "leaf"]).select("width", "leaf", blocks, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("shard"), "id", "least", "x")
        tasks = put.select("width", "leaf", "shard", "block").distinct()
        own = vectors.join(tasks, ["width", "leaf", "shard"]).select("width", "leaf", "shard", "block", F.lit(0).alias("kind"), "id", F.lit(None).cast("decimal(38,0)").alias("least"), "x")
        both = own.unionByName(put.select("width", "leaf", "shard", "block", F.lit(1).alias("kind"), "id", "least", "x"))
        return both.withColumn("task", F.xxhash64("width", "leaf", "shard", "block"))

    queries = vectors.filter(F.col("id") % every == 0).select("width", "leaf", "id", "x")
    home = written(_answered(asked(queries.withColumn("least", F.lit(None).cast("decimal(38,0)"))), k))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = home.withColumn("rank", order).filter(F.col("rank") <= k)
    reached = best.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    others = _reaching(queries.join(reached, "id", "left"), _boxes(vectors))
    every_one = home.unionByName(_answered(asked(others), k))
    ranked = every_one.withColumn("rank", order).filter(F.col("rank") <= k)
    held = F.greatest(F.least(F.col("score"), F.lit(Decimal(2**63 - 1))), F.lit(Decimal(-(2**63)))).cast("long")
    return ranked.select("query_id", "rank", "vec_id", held.alias("score"))
