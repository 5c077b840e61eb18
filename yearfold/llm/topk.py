"""Exact top-k search by inner product: a ball tree per shard, searched by branch and bound.

All rows are dealt to the leaves of a tree of cuts, fitted on a bounded sample, so that near vectors
share one, and each leaf gets a ball around its own; large leaves are several shards. A query first
meets the leaf with the highest inner-product upper bound; its kth score there is its floor. It then
goes to those leaves only whose bound reaches the floor: the others are skipped before anything is
shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, prepare, table

K, SCALE, EVERY = 10, 1024, 100
SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8192, 16384, 128
MOST_LEAVES, SAMPLE_ROWS, MODEL_BYTES = 4096, 1 << 15, 32 << 20  # of what the driver holds: balls, and vectors to fit the cuts on
LOW, NO_ID = np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max


class BallTree:
    """Balls over integer vectors: the rows of each node stand together, halved along the widest component."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, int]] = []  # from, to, centre, radius, second child (0: leaf)
        self._build(x, 0, len(x), leaf)

    def _build(self, x: np.ndarray, a: int, b: int, leaf: int) -> int:
        rows = x[self.order[a:b]]
        centre = rows.mean(axis=0) if b > a else np.zeros(x.shape[1])
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) if b > a else 0.0
        me = len(self.nodes)
        self.nodes.append((a, b, centre, radius, 0))
        if b - a > leaf and radius > 0:
            widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, widest], mid)]
            self._build(x, a, a + mid, leaf)
            second = self._build(x, a + mid, b, leaf)
            self.nodes[me] = (a, b, centre, radius, second)
        return me


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query, unfilled places LOW; what scores below a query's floor may be left out.

    A node is entered, by the queries it matters to, only while its inner-product upper bound
    reaches the query's current kth score; of two children each query goes to the one with the
    higher bound first. Equal scores matter (the smaller id wins), so only lower bounds prune.
    """
    exact = x.shape[1] * float(np.abs(x).max(initial=1)) * float(np.abs(q).max(initial=1)) < 2**53
    tree = BallTree(x.astype(np.float64))
    kind = np.float64 if exact else np.int64
    xs, ids = x[tree.order].astype(kind), ids[tree.order]
    qs, qf = q.astype(kind), q.astype(np.float64)
    norm = np.sqrt((qf**2).sum(axis=1))
    best = np.full((len(q), k), LOW, dtype=np.int64)
    best_id = np.full((len(q), k), NO_ID, dtype=np.int64)
    kth = floor.copy()

    def bound(node: int, at: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _ = tree.nodes[node]
        ub = qf[at] @ centre + norm[at] * radius
        return ub + 1 + 1e-9 * np.abs(ub)

    def enter(node: int, at: np.ndarray, ub: np.ndarray) -> None:
        at = at[ub >= kth[at]]
        if not len(at):
            return
        a, b, _, _, second = tree.nodes[node]
        if not second:
            s = np.rint(qs[at] @ xs[a:b].T).astype(np.int64) if exact else qs[at] @ xs[a:b].T
            s[ids[None, a:b] == query_ids[at, None]] = LOW
            every = np.concatenate([best[at], s], axis=1)
            every_id = np.concatenate([best_id[at], np.where(s == LOW, NO_ID, ids[None, a:b])], axis=1)
            top = np.lexsort((every_id, -every), axis=1)[:, :k]
            best[at], best_id[at] = np.take_along_axis(every, top, 1), np.take_along_axis(every_id, top, 1)
            kth[at] = np.maximum(kth[at], best[at, k - 1])
            return
        left, right = bound(node + 1, at), bound(second, at)
        first = left >= right
        enter(node + 1, at[first], left[first])
        enter(second, at[~first], right[~first])
        enter(second, at[first], right[first])
        enter(node + 1, at[~first], left[~first])

    every_query = np.arange(len(q))
    enter(0, every_query, bound(0, every_query))
    return best, best_id


class Cuts:
    """Halvings along the widest component, as a complete binary tree; a vector's leaf tells its shard."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.component = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.least = np.full((1 << depth) - 1, np.iinfo(np.int64).max)
        self.centre = np.zeros((1 << depth, sample.shape[1]))
        held = {0: sample}
        for node in range(len(self.component)):
            x = held.pop(node)
            if len(x) > 1:
                c = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
                self.component[node], self.least[node] = c, int(np.median(x[:, c])) + 1
            right = x[:, self.component[node]] >= self.least[node] if len(x) else np.zeros(0, dtype=bool)
            held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]
        for node, x in held.items():
            if len(x):
                self.centre[node - len(self.component)] = x.mean(axis=0)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.component[node]] >= self.least[node])
        return node - len(self.component)


def upper_bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Of the inner products of each query with what lies in each ball, a little above what rounding may lose."""
    norm = np.sqrt((q**2).sum(axis=1))
    ub = q @ centre.T + norm[:, None] * radius
    return ub + 1 + 1e-9 * (np.abs(ub) + norm[:, None] * np.sqrt((centre**2).sum(axis=1)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", vector: str = "vector", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k highest integer inner products of each query.

    Both tables hold ids and arrays of long. Equal scores go to the smaller id; rows with the
    query's own id are no candidates; fewer candidates give fewer rows. Rows with a null id or vector
    take no part. Vectors meet only vectors of their own length. Repeated candidate rows each count;
    repeated equal query rows count once. Shards hold about shard_rows rows; leaves that hold more are
    split by the hash of the row. Empty tables give an empty result.
    """
    prepare(vectors.sparkSession)
    take = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").withColumn("dim", F.size("v"))
    c, q = take(vectors), take(queries).distinct().withColumn("of", F.xxhash64("v")).checkpoint()
    # one search for each length of vectors: there is one, as a rule
    found = [_of_one_length(c.where(F.col("dim") == r.dim), q.where(F.col("dim") == r.dim), r.dim, r.n, k, shard_rows) for r in c.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()]
    best = vectors.sparkSession.createDataFrame([], "query_id long, of long, vec_id long, score long")
    for f in found:
        best = best.union(f)
    w = Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_one_length(c: DataFrame, q: DataFrame, dim: int, n: int, k: int, shard_rows: int) -> DataFrame:
    most = max(1, min(MOST_LEAVES, MODEL_BYTES // (8 * max(1, dim))))
    depth = int(np.log2(min(most, max(1, -(-n // shard_rows))))) if dim else 0
    # a documented bound, by the hash of the rows; only the cuts and centres depend on it
    share = min(1.0, min(SAMPLE_ROWS, MODEL_BYTES // (8 * max(1, dim))) / max(1, n))
    some = c.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(2 * SAMPLE_ROWS)
    cuts = Cuts(matrix(some.select("v").toArrow(), dim), depth)

    def dealt(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cuts.leaf(matrix(t, dim)).astype(np.int32))], names=[*b.schema.names, "leaf"])

    def measured(batches):
        n, radius = np.zeros(len(cuts.centre), dtype=np.int64), np.zeros(len(cuts.centre))
        for b in batches:
            x, leaf = matrix(pa.Table.from_batches([b]), dim), b.column(2).to_numpy()
            n += np.bincount(leaf, minlength=len(n))
            np.maximum.at(radius, leaf, np.sqrt(((x - cuts.centre[leaf]) ** 2).sum(axis=1)))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(radius[there])], names=["leaf", "n", "radius"])

    c = c.select("id", "v").mapInArrow(dealt, "id long, v array<long>, leaf int")
    balls = c.mapInArrow(measured, "leaf int, n long, radius double").groupBy("leaf").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).toArrow().sort_by("leaf")  # `most` rows
    leaves, radius = balls.column("leaf").to_numpy(), balls.column("radius").to_numpy() * (1 + 1e-9)
    parts = -(-balls.column("n").to_numpy() // (2 * shard_rows))
    first = np.cumsum(parts) - parts
    centre = cuts.centre[leaves]
    split = c.sparkSession.createDataFrame(list(zip(leaves.tolist(), first.tolist(), parts.tolist(), strict=True)), "leaf int, first long, parts long")
    c = c.join(F.broadcast(split), "leaf").select("id", "v", (F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))).alias("shard"))

    def kernel(left, right):
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        floor = right.column("floor").fill_null(LOW).to_numpy()
        ids, query_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        best, best_id = search(ids, matrix(left, dim), query_ids, matrix(right, dim), floor, k)
        row, place = np.nonzero(best > LOW)
        return pa.table({"query_id": query_ids[row], "of": right.column("of").to_numpy()[row], "vec_id": best_id[row, place], "score": best[row, place]}, schema=FOUND)

    def sent(pilot):
        """Queries with each shard they go to: those of the leaf with the highest bound, or of the others whose bound reaches the floor."""

        def run(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                ub = upper_bounds(matrix(t, dim).astype(np.float64), centre, radius)
                top = ub.argmax(axis=1)
                if pilot:
                    row, at = np.arange(len(ub)), top
                else:
                    ok = ub >= t.column("floor").fill_null(LOW).to_numpy()[:, None]
                    ok[np.arange(len(ub)), top] = False
                    row, at = np.nonzero(ok)
                row, shard = np.repeat(row, parts[at]), np.repeat(first[at], parts[at])
                shard = shard + np.arange(len(row)) - np.repeat(np.cumsum(parts[at]) - parts[at], parts[at])
                yield pa.RecordBatch.from_arrays([*(b.column(x).take(pa.array(row)) for x in ("id", "v", "of", "floor")), pa.array(shard.astype(np.int64))], names=["id", "v", "of", "floor", "shard"])

        return run

    def meet(qs: DataFrame) -> DataFrame:
        """Shards with the queries sent to them, these in blocks; a shard goes once to each of its blocks."""
        qs = qs.checkpoint()
        blocks = qs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("blocks")).checkpoint()
        qs = looked_up(qs, blocks, ["shard"], "inner").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")))
        cands = looked_up(c, blocks, ["shard"], "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["shard", "block"]
        return cands.select("id", "v", *keys).groupBy(*keys).cogroup(qs.select("id", "v", "of", "floor", *keys).groupBy(*keys)).applyInArrow(kernel, "query_id long, of long, vec_id long, score long")

    shape = "id long, v array<long>, of long, floor long, shard long"
    q = q.select("id", "v", "of", F.lit(None).cast("long").alias("floor"))
    pilot = meet(q.mapInArrow(sent(True), shape)).checkpoint()
    if len(leaves) < 2:
        return pilot
    best = pilot.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score")))).where(F.col("place") <= k)
    kth = best.groupBy("query_id", "of").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    floors = looked_up(q.drop("floor"), kth.select(F.col("query_id").alias("id"), "of", "floor").checkpoint(), ["id", "of"])
    return pilot.union(meet(floors.select("id", "v", "of", "floor").mapInArrow(sent(False), shape)))


FOUND = pa.schema([("query_id", pa.int64()), ("of", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def matrix(t: pa.Table, dim: int) -> np.ndarray:
    v = t.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(t.num_rows, dim)


def quantized(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component; vectors that are null or hold null or non-finite components go."""
    e = F.col(f"`{embedding}`")
    whole = df.where(e.isNotNull()).where(~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return whole.select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector"))


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """The highest inner products of every hundredth vector of embeddings with all others; see quantized and top_k."""
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {SCALE})) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
