"""Approximate nearest neighbours over learned partitions.

1. A bounded sample (the `sample` rows with the least hash of their id) gives a neighbour graph by inner product, which
   is cut into balanced parts: regions are grown from unassigned nodes to an equal size and refined by moves to the part
   that holds most neighbours, within a capacity.
2. A softmax classifier is fitted to predict, from a vector, in which parts its neighbours lie. The number of parts that
   a query visits is the least at which held-out sample queries find `wanted` of their true neighbours.
3. Every row is indexed in its most probable part; parts are packed into blocks of about BLOCK rows, so a part of any
   size (also one of equal vectors) is spread over tasks. A query meets all blocks of its most probable parts, each
   gives its nearest, and those are merged. It goes on through its parts until they hold `nearest` rows besides itself,
   so it gets `nearest` rows, or all others of the table if there are fewer.

Scores are sums over the dimensions in their order, in double precision, so equal vectors have equal scores; ties go
to the smaller id. Rows without id, and vectors that are null, zero, of another length than most rows of the table, or
that hold a null or non-finite number take no part; that length holds for the queries too. Rows that repeat an id count once (the least vector). An empty table gives
an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tideline.llm.common import written

SAMPLE, PART_ROWS, GRAPH_DEGREE = 8192, 800, 16
BLOCK, QUERY_BLOCK = 2048, 512
#: Found rows that a task merges before it passes on what it has.
MERGE_ROWS = 400_000
WANTED = 0.95


@dataclass
class Router:
    weights: np.ndarray  # (dimensions + 1) x parts
    visits: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts from the most probable on, for each row."""
        return np.argsort(-(unit(x) @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")

    def reach(self, order: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
        """How many parts each row visits: `visits`, or more until those hold `rows` rows."""
        short = np.cumsum(sizes[order], axis=1) < rows
        return np.minimum(np.maximum(short.sum(1) + 1, self.visits), order.shape[1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (the nearest of a query don't depend on its own length)."""
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(queries: np.ndarray, rows: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the k rows with the largest inner product, without the row that a query is itself."""
    out = []
    for at in range(0, len(queries), 128):  # a few rows of scores at a time
        score = -(queries[at : at + 128] @ rows.T)
        if own is not None:
            score[np.arange(len(score)), own[at : at + 128]] = np.inf
        out.append(np.argpartition(score, min(k, score.shape[1] - 1), axis=1)[:, :k].copy())
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 10) -> np.ndarray:
    """A part for each node: grown regions of equal size, then moves that keep to the capacity."""
    n = len(graph)
    target, part = -(-n // parts), np.full(n, -1)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    fresh = iter(range(n))
    for p in range(parts):
        size, queue = 0, []
        while size < target:
            if not queue:
                queue = [next((i for i in fresh if part[i] < 0), None)]
                if queue[0] is None:
                    break
            i = queue.pop(0)
            if part[i] >= 0:
                continue
            part[i], size = p, size + 1
            queue += [j for j in (*graph[i].tolist(), *back[i]) if part[j] < 0]
    part[part < 0] = parts - 1
    limit = int(slack * target) + 1
    for _ in range(rounds):
        affinity = np.zeros((n, parts))
        np.add.at(affinity, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(affinity, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = affinity.argmax(1)
        gain = affinity[np.arange(n), best] - affinity[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < limit:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, total: int, nearest: int, part_rows: int = PART_ROWS, wanted: float = WANTED) -> Router:
    """Cut the sample's neighbour graph and learn which parts hold the neighbours of a vector.

    Some 512 rows (an eighth of a small sample at most) are kept out of the graph and the fit; their recall sets the visits.
    """
    parts = int(np.clip(round(total / part_rows), 1, max(1, len(x) // 64)))
    if parts == 1:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    whole, check = x, np.arange(0, len(x), max(8, len(x) // 512))
    x = np.delete(whole, check, axis=0)
    degree = min(GRAPH_DEGREE, len(x) - 1)
    graph = neighbours(unit(x), x, degree, np.arange(len(x)))
    part = balanced_parts(graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), degree), part[graph].ravel()), 1 / degree)
    goal = 0.5 * goal + 0.5 * np.eye(parts)[part]
    z, w = np.hstack([unit(x), np.ones((len(x), 1))]), np.zeros((x.shape[1] + 1, parts))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 301):
        logit = z @ w
        p = np.exp(logit - logit.max(1, keepdims=True))
        grad = z.T @ (p / p.sum(1, keepdims=True) - goal) / len(z) + 1e-6 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    router = Router(w, parts)
    true = neighbours(whole[check], whole, min(nearest, len(whole) - 1), check)
    order = router.order(whole)
    home = order[:, 0]
    place = np.argsort(order[check], axis=1)  # at which visit each part comes
    seen = np.take_along_axis(place, home[true], 1)
    recall = np.array([(seen < m).mean() for m in range(1, parts + 1)])
    router.visits = int(np.argmax(recall >= min(wanted, recall[-1]))) + 1
    return router


def sound(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows with an id and a finite vector that is not zero."""
    v = F.col("v")
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return good.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def usable(rows: DataFrame, key: str, vector: str, length: int | None = None) -> DataFrame:
    """(id, v): one row for each id, with vectors that can take part: those of `length`, or of the most frequent length."""
    good = sound(rows, key, vector)
    if length is None:
        length = usual_length(good)
    return good.where(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v"))


def usual_length(good: DataFrame) -> int:
    """The most frequent length (the larger of two as frequent); 0 without rows."""
    first = good.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return first["n"] if first else 0


def search(rows: DataFrame, queries: DataFrame, nearest: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` found rows of each query, without the query's own."""
    spark = rows.sparkSession
    length = usual_length(sound(rows, key, vector))
    base = written(usable(rows, key, vector, length))
    asked = usable(queries, key, vector, length)
    total = base.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    held = base.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column(0).combine_chunks()
    shared = spark.sparkContext.broadcast(fit_router(np.asarray(held.flatten()).reshape(len(held), -1), total, nearest))

    def routed(df: DataFrame, sizes: np.ndarray | None = None) -> DataFrame:
        """Rows in their most probable part or, with the sizes of the parts, in all that they visit."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            router = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                order = router.order(x)
                visits = np.ones(len(x), int) if sizes is None else router.reach(order, sizes, nearest + 1)
                part = order[np.arange(order.shape[1]) < visits[:, None]].astype(np.int32)
                row = pa.array(np.repeat(np.arange(len(x)), visits))
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column(0).take(row), batch.column(1).take(row)], names=["part", "id", "v"])

        return df.mapInArrow(work, "part int, id long, v array<double>")

    def packed(df: DataFrame, size: int, name: str) -> DataFrame:
        count = df.groupBy("part").agg(F.ceil(F.count("*") / size).alias("blocks"))
        dealt = df.join(F.broadcast(count), "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))  # a row for each part
        return dealt.groupBy("part", "block").agg(F.collect_list(F.struct("id", "v")).alias(name)).drop("block")

    def nearest_in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def best() -> None:
            """Keep the nearest of each query among what the task has found so far."""
            order = np.lexsort((held[1], -held[2], held[0]))
            held[:] = [c[order] for c in held]
            first = np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1]])) if len(order) else order
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            held[:] = [c[place < nearest] for c in held]

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query_id", "vec_id", "score"])
            held[:] = [c[:0] for c in held]
            return out

        for batch in batches:
            for k in range(batch.num_rows):
                (qid, q), (rid, r) = (unpacked(batch.column(c)[k].values) for c in (0, 1))
                order = np.argsort(rid, kind="stable")
                rid, r = rid[order], r[order]
                score = np.zeros((len(qid), len(rid)))
                for d in range(q.shape[1]):
                    score += q[:, d : d + 1] * r[:, d]
                score[qid[:, None] == rid] = -np.inf
                top = np.argsort(-score, axis=1, kind="stable")[:, :nearest]
                value = np.take_along_axis(score, top, 1)
                real = value > -np.inf
                held[:] = [np.concatenate(c) for c in zip(held, (np.repeat(qid, real.sum(1)), rid[top][real], value[real]))]
                if len(held[0]) > MERGE_ROWS:
                    best()
                    if len(held[0]) > MERGE_ROWS // 2:
                        yield emit()
        best()
        yield emit()

    homes = written(routed(base))
    sizes = np.zeros(shared.value.weights.shape[1], np.int64)
    for part, n in homes.groupBy("part").count().collect():  # a row for each part
        sizes[part] = n
    index = packed(homes, BLOCK, "rows")
    probes = packed(written(routed(asked, sizes)), QUERY_BLOCK, "queries")
    pairs = probes.join(index, "part").select("queries", "rows").repartition(spark.sparkContext.defaultParallelism * 2)
    found = pairs.mapInArrow(nearest_in_block, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def unpacked(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = (rows.field(k) for k in (0, 1))
    return np.asarray(ids), np.asarray(vectors.flatten()).reshape(len(ids), -1)
