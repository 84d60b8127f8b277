"""Pairwise-ranking embeddings fitted in synchronous epochs of joins and aggregations.

The items of an entity meet once; the task that has them draws the negatives
of all epochs and packs whole entities into cells of at most CELL edges, so
neither an edge nor a draw is ever a row of a shuffle.  A cell gathers the
vector of each of its nodes once, takes its edges in one matrix step, and
returns one gradient for each node; so a popular node travels once for each
cell and not for each edge, and an entity with a third of all edges is spread
over as many cells.  Every epoch ends with its tables written to the
shared checkpoint folder.  A node's step is its mean gradient times ``edges /
(1 + edges / STEP_EDGES)``: like that many sequential updates, and bounded for
any degree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions.ordering import running_totals
from tideline.functions.scalar import stable_hex, stable_modulo
from tideline.session import cut

#: Edges at which a node's step reaches half of its limit; one rule for every degree.
STEP_EDGES = 32
#: Edges of a cell.
CELL = 1 << 16
#: Entities, consecutive by name, whose holders of an item are counted together.
RUN = 1 << 10


def _damped(n: Column) -> Column:
    """How many sequential updates a mean gradient over ``n`` edges stands for: n for few, levelling off smoothly."""
    return n / (1 + n / STEP_EDGES)


def sine_embedding(index: Column, dimension: int, salt: int) -> Column:
    """Deterministic start vector of a node from its zero-based position."""
    return F.array(*[0.05 * F.sin((index + 1) * F.lit((c + salt + 1) * 0.173)) for c in range(dimension)])


def hash_embedding(kind: str, key: Column, dimension: int) -> Column:
    """Deterministic start vector of a node from a hash per component."""

    def unit(c: int) -> Column:
        value = F.conv(stable_hex("initial", kind, key, c), 16, 10).cast("decimal(20,0)").cast("double")
        return 0.05 * (value / F.lit(2.0**64) * 2.0 - 1.0)

    return F.array(*[unit(c) for c in range(dimension)])


def vdot(a, b, d: int) -> Column:
    a, b = (F.col(a) if isinstance(a, str) else a), (F.col(b) if isinstance(b, str) else b)
    total = a[0] * b[0]
    for k in range(1, d):
        total = total + a[k] * b[k]
    return total


def vmap(d: int, fn) -> Column:
    return F.array(*[fn(k) for k in range(d)])


def vsum(name: str, d: int) -> Column:
    return F.array(*[F.sum(F.col(name)[k]) for k in range(d)])


def vavg(name: str, d: int) -> Column:
    return F.array(*[F.avg(F.col(name)[k]) for k in range(d)])


def _positions(nodes: DataFrame, name: str) -> DataFrame:
    """(q, name, idx): zero-based position of each node in name order, per fit."""
    placed = running_totals(nodes.select("q", name).distinct(), ["q"], [name], {"_n": F.lit(1)})
    return placed.select("q", name, (F.col("_n") - 1).cast("long").alias("idx"))


def _hashes(head: str, names: list[bytes], tail: str = "") -> np.ndarray:
    """`stable_hex` of head, name and tail as unsigned numbers."""
    first, last = head.encode(), tail.encode()
    return np.frombuffer(b"".join([hashlib.sha256(first + name + last).digest()[:8] for name in names]), ">u8").astype(np.uint64)


def _free_after(held: np.ndarray, size: int) -> np.ndarray:
    """For each of the held positions, in order: the first position after it, cyclically, that is not held; -1 if all are."""
    last = np.append(np.diff(held) > 1, True)
    ends = held[last][np.cumsum(last) - last]  # end of the run of consecutive positions
    wrap = ends[0] + 1 if held[0] == 0 else 0
    return np.where(ends + 1 < size, ends + 1, wrap if wrap < size else -1)


#: The negatives of an entity: (q, entity, item names, their positions in order, number of items) to one (items, draws) array for each epoch.
Draw = Callable[[object, str, list[bytes], np.ndarray, int], list[np.ndarray]]


def cyclic_draws(epochs: int, prefix: list[str]) -> Draw:
    """One negative for each edge and epoch: the first unheld item at or after a hashed position, cyclically."""
    lead = "".join(f"{p}|" for p in prefix)

    def draw(q: object, entity: str, names: list[bytes], held: np.ndarray, size: int) -> list[np.ndarray]:
        free, out = _free_after(held, size), []
        for epoch in range(epochs):
            start = (_hashes(f"{lead}{epoch}|{entity}|", names) % np.uint64(size)).astype(np.int64)
            at = np.minimum(np.searchsorted(held, start), len(held) - 1)
            out.append(np.where(held[at] == start, free[at], start)[:, None])
        return out

    return draw


def unheld_draws(epochs: int, negatives: int) -> Draw:
    """Hashed picks among the items that the entity does not hold: the pick plus the held positions before it."""

    def draw(q: object, entity: str, names: list[bytes], held: np.ndarray, size: int) -> list[np.ndarray]:
        pool, before, out = size - len(held), held - np.arange(len(held)), []
        for epoch in range(epochs):
            picks = np.full((len(held), negatives), -1)
            for sample in range(negatives if pool else 0):
                pick = (_hashes(f"graph-bpr-negative|{q}|{epoch}|{entity}|", names, f"|{sample}") % np.uint64(pool)).astype(np.int64)
                picks[:, sample] = pick + np.searchsorted(before, pick, side="right")
            out.append(picks)
        return out

    return draw


def in_cells(rows: DataFrame, order: list[str], name: str = "cell") -> DataFrame:
    """The rows with the number of their cell: runs of CELL rows in the given order, inside each q."""
    placed = running_totals(rows, ["q"], order, {"_at": F.lit(1).cast("long")})
    return placed.withColumn(name, F.floor((F.col("_at") - 1) / CELL).cast("long")).drop("_at")


def _gathered(need: DataFrame, vectors: DataFrame, name: str) -> DataFrame:
    """(q, cell, name): the (id, e) of the nodes that each cell needs; ``need`` has (q, cell, id), ``vectors`` (q, id, e)."""
    return need.distinct().join(vectors.select("q", "id", "e"), ["q", "id"]).groupBy("q", "cell").agg(F.collect_list(F.struct("id", "e")).alias(name))


def _table(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and their vectors."""
    rows = cell.values
    ids = rows.field("id").to_numpy()
    order = np.argsort(ids)
    return ids[order], rows.field("e").flatten().to_numpy().reshape(len(ids), -1)[order]


def _summed(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(place, weights=values[:, k], minlength=size) for k in range(values.shape[1])], axis=1)


def _node_rows(q: object, kind: pa.DataType, side: int, ids: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([pa.array([q] * len(ids), kind), pa.array(np.full(len(ids), side, np.int32)), pa.array(ids), lists, pa.array(n.astype(np.int64))], names=["q", "side", "id", "g", "n"])


def _cell_sums(cells: DataFrame, kernel: Callable[..., Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]], d: int) -> DataFrame:
    """(q, side, id, g, n): what ``kernel`` gives for each cell (its columns but q and cell), summed by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for side, ids, sums, n in kernel(*(batch.column(c)[k] for c in range(2, batch.num_columns))):
                    yield _node_rows(batch.column(0)[k].as_py(), batch.column(0).type, side, ids, sums, n)

    types = dict(cells.dtypes)
    found = cells.mapInArrow(run, f"q {types['q']}, side int, id long, g array<double>, n long")
    return found.groupBy("q", "side", "id").agg(vsum("g", d).alias("g"), F.sum("n").alias("n"))


ENTITY, ITEM = 0, 1


def _places(data: pa.Scalar, edges: int, width: int) -> np.ndarray:
    """(edges, width) places in the items of a cell, in as many bytes as they need."""
    raw = data.as_py()
    return np.frombuffer(raw, f"u{len(raw) // (edges * width)}").reshape(edges, width)


def _cell(rows: pa.ListScalar, counts: pa.ListScalar, items: pa.ListScalar, idx: pa.Scalar, nodes: pa.ListScalar):
    """Ids and vectors of a cell's entities and items, and the places of its edges among them."""
    entities, many, ids = rows.values.to_numpy(), counts.values.to_numpy(), items.values.to_numpy()
    side, order = nodes.values.field("side").to_numpy(), nodes.values.field("id").to_numpy()
    vectors = nodes.values.field("e").flatten().to_numpy().reshape(len(side), -1)
    order = np.lexsort((order, side))
    u, v = vectors[order[: len(entities)]], vectors[order[len(entities) :]]
    by_id = np.argsort(entities)
    back = np.empty_like(by_id)
    back[by_id] = np.arange(len(by_id))
    row = np.repeat(np.arange(len(entities)), many)
    return entities, ids, u[back], v, row, _places(idx, len(row), 1)[:, 0].astype(np.int64)


def _used(side: int, ids: np.ndarray, place: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    n = np.bincount(place, minlength=len(ids))
    used = n > 0
    return side, ids[used], _summed(place, values, len(ids))[used], n[used]


def _ranking_kernel(rows, counts, items, idx, neg: pa.Scalar, width: int, nodes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Gradients of the pairwise-ranking loss of a cell's edges and their negatives."""
    entities, ids, u, v, row, idx = _cell(rows, counts, items, idx, nodes)
    neg = _places(neg, len(row), width)
    drawn = neg != np.iinfo(neg.dtype).max
    row, idx = (np.broadcast_to(x[:, None], neg.shape)[drawn] for x in (row, idx))
    neg = neg[drawn].astype(np.int64)
    gap = v[idx] - v[neg]
    own = u[row]
    w = 1.0 / (1.0 + np.exp(np.clip((own * gap).sum(axis=1), -60.0, 60.0)))[:, None]
    yield _used(ENTITY, entities, row, w * gap)
    pull = w * own
    yield _used(ITEM, ids, np.concatenate([idx, neg]), np.concatenate([pull, -pull]))


def _mean_kernel(rows, counts, items, idx, nodes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Sums of the vectors at the other ends of a cell's edges."""
    entities, ids, u, v, row, idx = _cell(rows, counts, items, idx, nodes)
    yield _used(ENTITY, entities, row, v[idx])
    yield _used(ITEM, ids, idx, u[row])


@dataclass(frozen=True)
class Graph:
    """Items (q, item, idx) and entities (q, entity, row) by name, and the packed edges.

    ``cells``: (q, cell, rows, counts, items, idx, picks, n0, n1, ...): entities and how many edges each has, the items
    that occur, and for each edge the place of its item and of its ``width`` negatives in every epoch.
    """

    items: DataFrame
    entities: DataFrame
    cells: DataFrame
    width: int

    def _met(self, entities: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
        """The cells with the vectors of their nodes; (q, row, e) entities and (q, idx, e) items."""
        ends = ((ENTITY, "rows", entities, "row"), (ITEM, "items", items, "idx"))
        need = [self.cells.select("q", "cell", F.lit(side).alias("side"), F.explode(name).alias("id")) for side, name, _, _ in ends]
        known = [rows.select("q", F.lit(side).alias("side"), F.col(key).alias("id"), "e") for side, _, rows, key in ends]
        met = need[0].unionByName(need[1]).join(known[0].unionByName(known[1]), ["q", "side", "id"])
        nodes = met.groupBy("q", "cell").agg(F.collect_list(F.struct("side", "id", "e")).alias("nodes"))
        return self.cells.select("q", "cell", "rows", "counts", "items", "idx", *columns).join(nodes, ["q", "cell"])

    def gradients(self, epoch: int, entities: DataFrame, items: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
        """(q, row, g, n) of entities and (q, idx, g, n) of items: summed gradients of an epoch."""
        width = self.width
        kernel = lambda *cell: _ranking_kernel(*cell[:-1], width, cell[-1])
        return _sides(_cell_sums(self._met(entities, items, f"n{epoch}"), kernel, d).transform(cut))

    def means(self, entities: DataFrame, items: DataFrame, d: int) -> tuple[DataFrame, DataFrame]:
        """(q, row, m) of entities and (q, idx, m) of items: the mean vector at the other ends of a node's edges."""
        sums = _cell_sums(self._met(entities, items), _mean_kernel, d)
        return _sides(sums.select("q", "side", "id", vmap(d, lambda k: F.col("g")[k] / F.col("n")).alias("m")).transform(cut))


def _sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda no, name: nodes.filter(F.col("side") == no).drop("side").withColumnRenamed("id", name)
    return side(ENTITY, "row"), side(ITEM, "idx")


def _turn(prefix: str, name: str, degree: int, fanout: int) -> np.ndarray:
    """Places of up to ``fanout`` neighbours of a node: consecutive from a hashed start, cyclically."""
    if degree <= fanout:
        return np.arange(degree)
    start = int(_hashes(f"graphsage-neighbors|{prefix}:{name}", [b""])[0] % np.uint64(degree))
    return (start + np.arange(fanout)) % degree


def _graph(history: DataFrame, draw: Draw, epochs: int, width: int = 1, fanout: int = 0) -> Graph:
    """The edges of (q, entity, item) rows with their draws; ``fanout`` also picks neighbours of the entities."""
    items = cut(_positions(history.select("q", "item"), "item"))
    entities = cut(_positions(history.select("q", "entity"), "entity").withColumnRenamed("idx", "row"))
    sizes = items.groupBy("q").agg(F.count("*").alias("_n"))
    edge = F.struct(F.col("idx").cast("int").alias("idx"), F.col("item").cast("string").alias("item"))
    held = history.select("q", "entity", "item").join(items, ["q", "item"]).groupBy("q", "entity").agg(F.collect_list(edge).alias("held"))
    lists = held.join(entities, ["q", "entity"]).join(sizes, "q").select("q", F.col("entity").cast("string").alias("entity"), "row", "held", "_n")
    kind, most = lists.schema["q"].dataType, CELL
    names = [f"n{e}" for e in range(epochs)]
    types = {"q": kind.simpleString(), "cell": "long", "rows": "array<long>", "counts": "array<int>", "items": "array<long>", "idx": "binary", "picks": "array<array<int>>"}
    types |= dict.fromkeys(names, "binary")

    def packed(q: object, cell: int, parts: list[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]], arrow: pa.DataType) -> pa.RecordBatch:
        idx = np.concatenate([p[1] for p in parts])
        draws = [np.concatenate([p[2][e] for p in parts]) for e in range(epochs)]
        ids = np.unique(np.concatenate([idx, *(x[x >= 0] for x in draws)]))
        small = next(t for t in (np.uint16, np.uint32) if len(ids) < np.iinfo(t).max)
        place = lambda x: np.where(x < 0, np.iinfo(small).max, np.searchsorted(ids, x)).astype(small).tobytes()
        values = [[q], [cell], [[p[0] for p in parts]], [[len(p[1]) for p in parts]], [ids], [place(idx)], [[p[3] for p in parts]], *([place(x)] for x in draws)]
        kinds = [arrow, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.list_(pa.int32())), *[pa.binary()] * epochs]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=list(types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        cell = (context.partitionId() if context else 0) << 32
        waiting: dict[object, list] = {}
        arrow = pa.null()
        for batch in batches:
            arrow = batch.column(0).type
            for k in range(batch.num_rows):
                q, entity, row, size = (batch.column(c)[k].as_py() for c in (0, 1, 2, 4))
                edges = batch.column(3)[k].values
                idx = edges.field("idx").to_numpy().astype(np.int64)
                order = np.argsort(idx)
                idx = idx[order]
                draws = draw(q, entity, edges.field("item").take(pa.array(order)).cast(pa.binary()).to_pylist(), idx, size)
                picks = idx[_turn("p", entity, len(idx), fanout)] if fanout else idx[:0]
                for lo in range(0, len(idx), most):
                    part = (row, idx[lo : lo + most], [x[lo : lo + most] for x in draws], picks if lo == 0 else idx[:0])
                    if sum(len(p[1]) for p in waiting.get(q, ())) + len(part[1]) > most:
                        yield packed(q, cell, waiting.pop(q), arrow)
                        cell += 1
                    waiting.setdefault(q, []).append(part)
        for q, parts in waiting.items():
            yield packed(q, cell, parts, arrow)
            cell += 1

    return Graph(items, entities, cut(lists.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in types.items()))), width)


def _sum_kernel(links: pa.ListScalar, vectors: pa.ListScalar) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    ids, v = _table(vectors)
    other = np.searchsorted(ids, links.values.field("other").to_numpy())
    nodes, place = np.unique(links.values.field("node").to_numpy(), return_inverse=True)
    yield 0, nodes, _summed(place, v[other], len(nodes)), np.bincount(place, minlength=len(nodes))


def neighbour_means(links: DataFrame, vectors: DataFrame, d: int) -> DataFrame:
    """(q, id, m, n): mean vector of the other ends of each node's links; (q, cell, node, other) links, (q, id, e) vectors."""
    packed = links.groupBy("q", "cell").agg(F.collect_list(F.struct("node", "other")).alias("links"))
    cells = packed.join(_gathered(links.select("q", "cell", F.col("other").alias("id")), vectors, "v"), ["q", "cell"])
    return _cell_sums(cells, _sum_kernel, d).select("q", "id", vmap(d, lambda k: F.col("g")[k] / F.col("n")).alias("m"), "n")


def _step(nodes: DataFrame, gradients: DataFrame, keys: list[str], d: int, rate: float, decay: float) -> DataFrame:
    """nodes(keys, e) moved by gradients(keys, g, n)."""
    joined = nodes.join(gradients, keys, "left")
    n = _damped(F.coalesce(F.col("n"), F.lit(0)))
    pull = lambda k: F.coalesce(F.col("g")[k] / F.col("n"), F.lit(0.0))
    moved = vmap(d, lambda k: F.col("e")[k] + rate * n * (pull(k) - decay * F.col("e")[k]))
    return joined.select(*[c for c in nodes.columns if c != "e"], moved.alias("e"))


@dataclass
class Factors:
    """Final vectors: entities (q, entity, e) and items (q, item, e)."""

    entities: DataFrame
    items: DataFrame
    dimension: int

    def score(self, pairs: DataFrame, name: str = "score") -> DataFrame:
        """(q, entity, item, ...) plus the dot product; an unknown node scores 0."""
        left = self.entities.select("q", "entity", F.col("e").alias("_a"))
        right = self.items.select("q", "item", F.col("e").alias("_b"))
        joined = pairs.join(left, ["q", "entity"], "left").join(right, ["q", "item"], "left")
        value = F.coalesce(vdot("_a", "_b", self.dimension), F.lit(0.0))
        return joined.select(*pairs.columns, value.alias(name))


def fit_bpr(history: DataFrame, dimension: int = 8, epochs: int = 4, rate: float = 0.03, decay: float = 0.001) -> Factors:
    """Bipartite pairwise-ranking embeddings, then half own vector plus half mean neighbour.

    ``history``: distinct (q, entity, item); every ``q`` is an independent fit.
    """
    d = dimension
    graph = _graph(history, cyclic_draws(epochs, []), epochs)
    u = cut(graph.entities.select("q", "entity", "row", sine_embedding(F.col("row"), d, 1).alias("e")))
    v = cut(graph.items.select("q", "idx", "item", sine_embedding(F.col("idx"), d, 7).alias("e")))
    for epoch in range(epochs):
        gu, gv = graph.gradients(epoch, u, v, d)
        u, v = cut(_step(u, gu, ["q", "row"], d, rate, decay)), cut(_step(v, gv, ["q", "idx"], d, rate, decay))
    near_u, near_v = graph.means(u, v, d)
    mix = vmap(d, lambda k: 0.5 * F.col("e")[k] + 0.5 * F.col("m")[k]).alias("e")
    return Factors(
        cut(u.join(near_u, ["q", "row"]).select("q", "entity", mix)),
        cut(v.join(near_v, ["q", "idx"]).select("q", "item", mix)),
        d,
    )


def item_neighbours(history: DataFrame, graph: Graph, fanout: int) -> DataFrame:
    """(q, idx, row): up to ``fanout`` entities of each item, consecutive in name order from a hashed start, cyclically.

    Holders are counted by runs of RUN entities; only the runs that hold a wanted one give rows.
    """
    placed = history.select("q", "entity", "item").join(graph.items, ["q", "item"]).join(graph.entities, ["q", "entity"])
    placed = placed.select("q", "idx", "item", "row", F.floor(F.col("row") / RUN).cast("long").alias("run"))
    item, upto = W.partitionBy("q", "idx"), W.partitionBy("q", "idx").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("q", "idx", "item", "run").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"deg": F.sum("n").over(item), "before": F.coalesce(F.sum("n").over(upto), F.lit(0))})
    start = stable_modulo(F.col("deg"), "graphsage-neighbors", F.concat(F.lit("d:"), F.col("item")))
    wanted = F.when(F.col("deg") <= fanout, F.sequence(F.lit(0).cast("long"), F.col("deg") - 1)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda k: (F.col("_start") + k) % F.col("deg"))
    )
    here = F.filter("wanted", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    runs = counts.withColumn("_start", start).withColumn("wanted", wanted).withColumn("wanted", here).filter(F.size("wanted") > 0).select("q", "idx", "run", "before", "wanted").transform(cut)
    at = F.col("before") + F.row_number().over(W.partitionBy("q", "idx", "run").orderBy("row")) - 1
    return placed.join(runs, ["q", "idx", "run"]).withColumn("_at", at).filter(F.array_contains("wanted", F.col("_at"))).select("q", "idx", "row")


def _matrix(m, vector: Column, d: int, transpose: bool = False):
    """matrix x vector as d Columns; ``m`` is a column of d*d doubles."""

    def cell(i: int, k: int) -> Column:
        return m[k * d + i] if transpose else m[i * d + k]

    out = []
    for i in range(d):
        total = cell(i, 0) * vector[0]
        for k in range(1, d):
            total = total + cell(i, k) * vector[k]
        out.append(total)
    return out


def fit_graphsage(
    history: DataFrame, dimension: int = 8, epochs: int = 3, fanout: int = 8, rate: float = 0.02, decay: float = 0.0005
) -> Factors:
    """One-hop mean-neighbour message model with tanh units and the pairwise-ranking loss.

    The two transforms are shared by all nodes of a fit; their gradients are
    sums over nodes and come back as one row of d*d numbers per fit.
    """
    d = dimension
    graph = _graph(history, cyclic_draws(epochs, ["graphsage-negative"]), epochs, fanout=fanout)
    items, entities = graph.items, graph.entities
    item_id = lambda idx: -1 - F.col(idx)  # entities count up from 0, items down from -1
    picked = graph.cells.select("q", F.explode(F.arrays_zip("rows", "picks")).alias("p")).select("q", F.col("p.rows").alias("row"), F.explode("p.picks").alias("idx"))
    nodes = cut(
        entities.select("q", F.col("row").alias("id"), sine_embedding(F.col("row"), d, 11).alias("e"))
        .unionByName(items.select("q", item_id("idx").alias("id"), sine_embedding(F.col("idx"), d, 17).alias("e")))
    )
    links = cut(in_cells(
        picked.select("q", F.col("row").alias("node"), item_id("idx").cast("long").alias("other"))
        .unionByName(item_neighbours(history, graph, fanout).select("q", item_id("idx").alias("node"), F.col("row").alias("other"))), ["node", "other"]
    ))
    spark = history.sparkSession
    qs = [r["q"] for r in items.select("q").distinct().collect()]
    eye = [1.0 if i == k else 0.0 for i in range(d) for k in range(d)]
    own_w = {q: list(eye) for q in qs}
    near_w = {q: [0.25 * x for x in eye] for q in qs}
    qtype = dict(history.dtypes)["q"]

    def messages() -> DataFrame:
        """(q, id, e, m, n, s, r, h): inputs, neighbour mean, degree, transforms and hidden vector."""
        weights = spark.createDataFrame([(q, own_w[q], near_w[q]) for q in qs], f"q {qtype}, s array<double>, r array<double>")
        joined = nodes.join(neighbour_means(links, nodes, d), ["q", "id"]).join(F.broadcast(weights), "q")
        own, near = _matrix(F.col("s"), F.col("e"), d), _matrix(F.col("r"), F.col("m"), d)
        return joined.withColumn("h", F.array(*[F.tanh(a + b) for a, b in zip(own, near)]))

    for epoch in range(epochs):
        state = cut(messages())
        hu = state.filter("id >= 0").select("q", F.col("id").alias("row"), F.col("h").alias("e"))
        hv = state.filter("id < 0").select("q", (-1 - F.col("id")).alias("idx"), F.col("h").alias("e"))
        gu, gv = graph.gradients(epoch, hu, hv, d)
        hidden = gu.select("q", F.col("row").alias("id"), "g", F.col("n").alias("uses")).unionByName(gv.select("q", (-1 - F.col("idx")).alias("id"), "g", F.col("n").alias("uses")))
        scale = _damped(F.col("uses")) / F.col("uses")
        pre = cut(
            state.join(hidden, ["q", "id"]).withColumn(
                "pre", vmap(d, lambda k: scale * F.col("g")[k] * (1.0 - F.col("h")[k] * F.col("h")[k]))
            ).drop("g")
        )
        own_g = F.array(*_matrix(F.col("s"), F.col("pre"), d, transpose=True))
        near_g = F.array(*[x / F.col("n") for x in _matrix(F.col("r"), F.col("pre"), d, transpose=True)])
        direct = pre.select("q", "id", own_g.alias("g"))
        passed = pre.select("q", F.col("id").alias("node"), near_g.alias("g")).join(links, ["q", "node"]).select("q", F.col("other").alias("id"), "g")
        summed = direct.unionByName(passed).groupBy("q", "id").agg(vsum("g", d).alias("g"))
        outer = pre.groupBy("q").agg(
            F.array(*[F.avg(F.col("pre")[i] * F.col("e")[k]) for i in range(d) for k in range(d)]).alias("gs"),
            F.array(*[F.avg(F.col("pre")[i] * F.col("m")[k]) for i in range(d) for k in range(d)]).alias("gr"),
        )
        for row in outer.collect():
            q = row["q"]
            own_w[q] = [x + rate * (g - decay * x) for x, g in zip(own_w[q], row["gs"])]
            near_w[q] = [x + rate * (g - decay * x) for x, g in zip(near_w[q], row["gr"])]
        moved = nodes.join(summed, ["q", "id"], "left")
        # The summed gradient of a popular neighbour is bounded component-wise like its step count.
        bounded = lambda k: STEP_EDGES * F.tanh(F.coalesce(F.col("g")[k], F.lit(0.0)) / STEP_EDGES)
        nodes = cut(moved.select("q", "id", vmap(d, lambda k: F.col("e")[k] + rate * (bounded(k) - decay * F.col("e")[k])).alias("e")))
    final = cut(messages().select("q", "id", F.col("h").alias("e")))
    return Factors(
        cut(entities.join(final, (entities["q"] == final["q"]) & (entities["row"] == final["id"])).select(entities["q"], "entity", "e")),
        cut(items.join(final, (items["q"] == final["q"]) & (-1 - items["idx"] == final["id"])).select(items["q"], "item", "e")),
        d,
    )


def fit_specialty_bpr(
    history: DataFrame,
    specialties: DataFrame,
    dimension: int = 12,
    epochs: int = 5,
    negatives: int = 3,
    rate: float = 0.03,
    decay: float = 0.001,
    weight: float = 0.35,
) -> Factors:
    """Entity, item and specialty vectors under the pairwise-ranking loss.

    ``history``: distinct (q, entity, item); ``specialties``: (q, entity,
    specialty), NULL where unknown.  Scores use entity plus weighted specialty,
    so the returned entity vector already contains its specialty share.
    """
    d = dimension
    graph = _graph(history, unheld_draws(epochs, negatives), epochs, negatives)
    u = cut(
        graph.entities.join(specialties.select("q", "entity", "specialty"), ["q", "entity"], "left")
        .select("q", "entity", "row", "specialty", hash_embedding("provider", F.col("entity"), d).alias("e"))
    )
    v = cut(graph.items.select("q", "idx", "item", hash_embedding("drug", F.col("item"), d).alias("e")))
    s = cut(
        specialties.filter("specialty is not null").select("q", "specialty").distinct().select(
            "q", "specialty", hash_embedding("specialty", F.col("specialty"), d).alias("e")
        )
    )

    def shared() -> DataFrame:
        """Entity vectors with their specialty's share."""
        joined = u.join(s.withColumnRenamed("e", "sp"), ["q", "specialty"], "left")
        return joined.select("q", "entity", "row", vmap(d, lambda k: F.col("e")[k] + F.coalesce(weight * F.col("sp")[k], F.lit(0.0))).alias("e"))

    for epoch in range(epochs):
        gu, gv = graph.gradients(epoch, shared(), v, d)
        own = gu.join(u.filter("specialty is not null").select("q", "row", "specialty"), ["q", "row"])
        gs = own.groupBy("q", "specialty").agg(F.array(*[weight * F.sum(F.col("g")[k]) for k in range(d)]).alias("g"), F.sum("n").alias("n"))
        u, v, s = (
            cut(_step(u, gu, ["q", "row"], d, rate, decay)),
            cut(_step(v, gv, ["q", "idx"], d, rate, decay)),
            cut(_step(s, gs, ["q", "specialty"], d, rate, decay)),
        )
    return Factors(cut(shared().select("q", "entity", "e")), v.select("q", "item", "e"), d)
