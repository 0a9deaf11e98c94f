"""Nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts with few edges between
them. A small classifier learns the part of a vector; it files every vector of the table
under its most probable part and sends each query to several. Within a part, queries meet
vectors in blocks of bounded size and are ranked by the exact inner product. The sample is
filed like all others; what it has in the parts of a query bounds from below what a
neighbour out of these parts must score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut
from .common import batch_rows

K = 20
#: Vectors the index is fitted on, neighbours of each in the graph, and vectors of the table to a part (as long as the sample fills the parts).
SAMPLE = 6000
NEIGHBOURS = 10
PART_ROWS = 320
LEAST_SAMPLE = 40
#: Queries go to as many parts as this share of the neighbours needs among the one in HELD_BACK sample vectors that are not trained on.
RECALL = 0.97
HELD_BACK = 4
HIDDEN, EPOCHS, SEED = 96, 40, 3
#: Vectors and queries that meet in one task.
BLOCK, QUERIES = 4096, 1024


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k vectors of largest inner product with each, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 12) -> np.ndarray:
    """Cut the graph by repeated bisection: halves along the main direction, then swaps of equal numbers
    of vectors that have more neighbours on the other side."""
    n = len(x)
    linked = np.concatenate([np.c_[np.repeat(np.arange(n), graph.shape[1]), graph.ravel()], np.c_[graph.ravel(), np.repeat(np.arange(n), graph.shape[1])]])
    label = np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        side = np.zeros(n, bool)
        groups = [np.flatnonzero(label == p) for p in range(label.max() + 1)]
        for own in groups:
            y = x[own] - x[own].mean(axis=0)
            way = np.ones(x.shape[1]) if not len(own) else y[np.argmax((y * y).sum(axis=1))].copy()
            for _ in range(8):
                way = y.T @ (y @ way)
                way /= np.linalg.norm(way) + 1e-30
            side[own[np.argsort(y @ way, kind="stable")[len(own) // 2 :]]] = True
        same_group = linked[label[linked[:, 0]] == label[linked[:, 1]]]
        for _ in range(passes):
            cross = side[same_group[:, 0]] != side[same_group[:, 1]]
            gain = np.bincount(same_group[:, 0], np.where(cross, 1, -1), n)
            moved = 0
            for own in groups:
                a, b = own[~side[own] & (gain[own] > 0)], own[side[own] & (gain[own] > 0)]
                m = (min(len(a), len(b)) + 1) // 2  # half of them: neighbours that swap together gain nothing
                if min(len(a), len(b)):
                    swap = np.r_[a[np.argsort(-gain[a], kind="stable")[:m]], b[np.argsort(-gain[b], kind="stable")[:m]]]
                    side[swap] = ~side[swap]
                    moved += m
            if not moved:
                break
        label = label * 2 + side
    return label


def fit(x: np.ndarray, rows: int) -> Router:
    """Learn a router from sample vectors ``x``, in random order, for a table of ``rows`` distinct vectors."""
    held, x = x[::HELD_BACK], np.delete(x, np.s_[::HELD_BACK], axis=0) if len(x) > 1 else x
    n, dim = x.shape
    most = max(1, min(rows // PART_ROWS, n // LEAST_SAMPLE))
    parts = 1 << int(math.log2(most))
    if parts == 1:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    k = min(NEIGHBOURS, n - 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    # a vector should go where it and its neighbours are
    goal = np.zeros((n, parts))
    np.add.at(goal, (np.arange(n), label), 2.0)
    np.add.at(goal, (np.repeat(np.arange(n), k), label[graph].ravel()), 1.0)
    goal /= goal.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(SEED)
    scale = 1 / max(1e-12, float(np.sqrt((x * x).sum(axis=1).mean())))
    p = [rng.normal(0, 2.0, (dim, HIDDEN)) * scale, np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    rates = [0.01 * scale, 0.01, 0.01, 0.01]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - goal[i]) / len(i)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for j, g in enumerate((x[i].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.01 * (g * g - v[j])
                p[j] -= rates[j] * (1 - epoch / EPOCHS) * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-12)
    router = Router(*p, probes=parts)
    z = router.scores(held)
    filed = z.argmax(axis=1)
    ranked = np.argsort(-z, axis=1, kind="stable")
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.broadcast_to(np.arange(parts), ranked.shape), axis=1)
    k = min(NEIGHBOURS, len(held) - 1)
    found_at = place[np.repeat(np.arange(len(held)), k), filed[neighbour_graph(held, k)].ravel()]  # how many parts a neighbour needs
    router.probes = min(parts, int(np.quantile(found_at, RECALL, method="higher")) + 1)
    return router


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: finite components, not all zero, of the most common length."""
    v = F.col("v")
    flat = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    flat = flat.where(ok)
    sizes = flat.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    # equal vectors are equal keys: no negative zero
    return flat.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast("float")).alias("v"))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), dtype)
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """The ``k`` nearest rows of every query row: (query_id, rank, vec_id, score).

    ``is_query`` is a condition on vec_id. Nearness is the largest inner product, each rounded
    once from its exact value; ties go to the smaller vec_id; a row is not its own neighbour.
    Null, zero or non-finite vectors, rows without id and vectors of an unusual length take
    no part. A row that is repeated with its id counts once. With no usable vector there are no rows.

    Equal vectors are one entry of the index with their k + 1 smallest ids, which are all that
    can appear in a result; so a vector that a third of all rows share costs what one costs.
    """
    rows = cut(usable(vectors).distinct())
    first = W.partitionBy("v").orderBy("vec_id")
    entries = cut(
        rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.element_at("ids", 1))
    )
    asked = cut(rows.where(is_query).join(entries.select("v", "key"), "v").select(F.col("vec_id").alias("query_id"), "key"))
    total = entries.count()
    sample = entries.orderBy(F.xxhash64("v"), "key").limit(SAMPLE).toArrow().combine_chunks()
    seen = matrix(sample.column("v")) if len(sample) else np.zeros((0, 1))
    router = fit(seen, total) if len(sample) else Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)

    seen_part = router.scores(seen).argmax(axis=1) if router.parts > 1 else np.zeros(len(seen), np.int64)

    def file(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = router.scores(matrix(b.column(1))).argmax(axis=1) if router.parts > 1 else np.zeros(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32))], names=["key", "v", "ids", "part"])

    def bound(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The k + 1 best of the sample in the parts of a query are among what it meets: what scores below them is in no result."""
        if len(seen) <= k:
            return np.full(len(x), -np.inf)
        open_ = np.zeros((len(x), router.parts), bool)
        np.put_along_axis(open_, to, True, axis=1)
        scores = np.where(open_[:, seen_part], x @ seen.T, -np.inf)
        slack = 1e-9 * np.sqrt((x * x).sum(axis=1) * (seen * seen).sum(axis=1).max())
        return np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] - slack

    def route(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, x = router.probes, matrix(b.column(1))
            to = np.argsort(-router.scores(x), axis=1, kind="stable")[:, :p] if router.parts > 1 else np.zeros((len(b), 1), np.int64)
            least = bound(x, to)
            rows_ = np.repeat(np.arange(len(b)), to.shape[1])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(rows_)).columns, pa.array(to.ravel().astype(np.int32)), pa.array(least[rows_])], names=["key", "v", "part", "least"])

    filed = cut(entries.select("key", "v", "ids").mapInArrow(file, "key long, v array<float>, ids array<long>, part int"))
    queries = cut(entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v"))
    with batch_rows(vectors.sparkSession, QUERIES):
        routed = cut(queries.mapInArrow(route, "key long, v array<float>, part int, least double"))
    # one row for each part: how many blocks its vectors and queries make
    blocks = filed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    lots = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nq"))
    grid = F.broadcast(cut(blocks.join(lots, "part")))
    spread = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = filed.join(grid, "part").withColumn("block", spread(F.col("nb"))).withColumn("lot", every("nq")).select("part", "block", "lot", "key", "v", "ids")
    asking = routed.join(grid, "part").withColumn("lot", spread(F.col("nq"))).withColumn("block", every("nb")).select("part", "block", "lot", "key", "v", "least")

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        have, want = matrix(left.column("v")), matrix(right.column("v"))
        scores = want @ have.T
        m = min(len(have), k + 5)  # some more than can count, as these scores are rounded step by step
        top = np.argpartition(-scores, m - 1, axis=1)[:, :m]
        least = right.column("least").to_numpy()
        who, place = np.nonzero(np.take_along_axis(scores, top, axis=1) >= least[:, None])
        found = top[who, place]
        exact = [math.fsum(row) for row in (want[who] * have[found]).tolist()]
        ids = left.column("ids").combine_chunks().take(pa.array(found))
        keys = right.column("key").to_numpy()[who]
        return pa.table([pa.array(keys), pa.array(exact, pa.float64()), ids], schema=schema)

    on = ["part", "block", "lot"]
    met = base.groupBy(*on).cogroup(asking.groupBy(*on)).applyInArrow(rank, "key long, score double, ids array<long>")
    candidates = met.select("key", "score", F.explode("ids").alias("vec_id"))
    best = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = candidates.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    found = asked.join(best, "key").where("query_id <> vec_id")
    order = W.partitionBy("query_id").orderBy("r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
