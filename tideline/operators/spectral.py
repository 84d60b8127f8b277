"""Spectral factors of the column-normalised incidence by power iteration with deflation.

The incidence is cut into cells, a block of entities by a block of items, and
the vectors into item blocks; both stay in the executors.  There is one path
for every size, and the driver holds some numbers for each cutoff only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.ordering import running_totals
from tideline.session import cut

RANK = 8
ITERATIONS = 18
#: Items of a block, and entries of a block of entities.
BLOCK = 1024
ENTRIES = 1 << 18


def item_positions(history: DataFrame) -> DataFrame:
    """(q, item, idx, degree): zero-based position in item order and number of holders."""
    degrees = history.groupBy("q", "item").agg(F.count("*").alias("degree"))
    placed = running_totals(degrees, ["q"], ["item"], {"_n": F.lit(1)})
    return placed.select("q", "item", (F.col("_n") - 1).cast("int").alias("idx"), "degree")


def _cells(history: DataFrame, items: DataFrame) -> DataFrame:
    """(q, eb, ib, rows, cols): the incidence cut into blocks of entities and blocks of items."""
    entities = running_totals(history.select("q", "entity").distinct(), ["q"], ["entity"], {"_n": F.lit(1).cast("long")}).transform(cut)
    edges, holders = history.count(), entities.count()
    size = max(1, ENTRIES * holders // max(1, edges))
    row = F.col("_n") - 1
    numbered = entities.select("q", "entity", F.floor(row / size).cast("long").alias("eb"), (row % size).cast("int").alias("row"))
    placed = history.join(numbered, ["q", "entity"]).join(items.select("q", "item", "ib", "at"), ["q", "item"])
    lists = placed.groupBy("q", "eb", "ib").agg(F.collect_list(F.struct("row", "at")).alias("x"))
    return lists.select("q", "eb", "ib", F.col("x.row").alias("rows"), F.col("x.at").alias("cols")).transform(cut)


def _ints(column: pa.ListScalar) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)


def _product(cells: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """(q, ib, y): transposed incidence x incidence x vector; ``vectors`` are (q, ib, x)."""
    types = dict(cells.dtypes)

    def through(group: pa.Table) -> pa.Table:
        rows, cols, x = (group.column(c) for c in ("rows", "cols", "x"))
        found = [(_ints(rows[k]), _ints(cols[k])) for k in range(group.num_rows)]
        total = np.zeros(1 + max(int(r.max()) for r, _ in found))
        for k, (r, c) in enumerate(found):
            total += np.bincount(r, weights=_ints(x[k])[c], minlength=len(total))
        out = [np.bincount(c, weights=total[r], minlength=block) for r, c in found]
        return pa.table({"q": group.column("q"), "ib": group.column("ib"), "y": pa.array(out, pa.list_(pa.float64()))})

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([_ints(x) for x in group.column("y")], axis=0)
        return pa.table({"q": group.column("q").slice(0, 1), "ib": group.column("ib").slice(0, 1), "y": pa.array([total], pa.list_(pa.float64()))})

    schema = f"q {types['q']}, ib long, y array<double>"
    partial = cells.join(vectors, ["q", "ib"]).groupBy("q", "eb").applyInArrow(through, schema)
    return partial.groupBy("q", "ib").applyInArrow(added, schema)


def _of_q(values: dict) -> Column:
    """The number that belongs to the row's cutoff."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("q"))


def _dot_products(table: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> dict:
    """{q: {name: sum of the products}}: one row for each cutoff."""
    each = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = table.groupBy("q").agg(*[F.sum(each(a, b)).alias(n) for n, (a, b) in pairs.items()]).collect()
    return {r["q"]: {n: r[n] for n in pairs} for r in rows}


def _norms(table: DataFrame) -> dict:
    return {q: s["n"] ** 0.5 for q, s in _dot_products(table, {"n": (F.col("x"), F.col("x"))}).items()}


def _less(x: Column, steps: dict, found: Column, k: int) -> Column:
    return F.zip_with(x, found[k], lambda a, b: a - _of_q({q: s[f"c{k}"] for q, s in steps.items()}) * b)


def fit_spectral(history: DataFrame, rank: int = RANK, iterations: int = ITERATIONS, block: int = BLOCK) -> DataFrame:
    """(q, item, weight, v array): item factors for every cutoff, fitted side by side.

    ``history``: distinct (q, entity, item).  A vector is a table of item blocks (q, ib, x).  A step joins the blocks of
    the incidence with it, goes to the entities and back inside each block of entities, and sums by item block; the
    driver sees one row of scalars for each cutoff.
    """
    items = item_positions(history)
    items = items.withColumns({"ib": F.floor(F.col("idx") / block).cast("long"), "at": (F.col("idx") % block).cast("int")}).transform(cut)
    cells = _cells(history, items)
    size = {r["q"]: r["n"] for r in items.groupBy("q").agg(F.count("*").alias("n")).collect()}
    lists = items.groupBy("q", "ib").agg(F.sort_array(F.collect_list(F.struct("at", "degree"))).alias("d"))
    weights = F.transform("d.degree", lambda n: F.lit(1.0) / F.sqrt(F.greatest(F.lit(1), n)))
    padded = F.slice(F.concat(weights, F.array_repeat(F.lit(0.0), block)), 1, block)  # blocks are of one length
    base = lists.select("q", "ib", padded.alias("w"), F.array().cast("array<array<double>>").alias("found")).transform(cut)
    live = set(size)
    for component in range(rank):
        live = {q for q in live if component < size[q]}
        if not live:
            break
        place = lambda k: F.col("ib") * block + k  # noqa: B023, E731
        start = lambda k: F.sin((place(k) + 1) * F.lit((component + 1) * 0.731)) + F.lit(0.1) / (place(k) + component + 1)  # noqa: B023, E731
        known = F.zip_with(F.transform(F.sequence(F.lit(0), F.lit(block - 1)), start), F.col("w"), lambda x, w: F.when(w > 0, x).otherwise(0.0))
        now = base.filter(F.col("q").isin(*live)).withColumn("x", known).transform(cut)
        norms = _norms(now)
        for _ in range(iterations):
            # Fixed value: shorter vectors count as zero.
            scale = _of_q({q: 0.0 if n <= 1e-12 else 1.0 / n for q, n in norms.items()})
            unit = now.select("q", "ib", F.zip_with("x", "w", lambda x, w: x * w * scale).alias("x"))  # noqa: B023
            now = _product(cells, unit, block).join(base, ["q", "ib"]).withColumn("x", F.zip_with("y", "w", lambda y, w: y * w)).drop("y").transform(cut)
            shares = {f"c{k}": (F.col("x"), F.col("found")[k]) for k in range(component)}
            steps = _dot_products(now, {**shares, "n": (F.col("x"), F.col("x"))})
            left = F.col("x")
            for k in range(component):
                left = _less(left, steps, F.col("found"), k)
            now = now.withColumn("x", left)
            # the found vectors are orthonormal, so the length that is left follows; if little is left, it is measured
            squares = {q: (s["n"], s["n"] - sum(s[f"c{k}"] ** 2 for k in range(component))) for q, s in steps.items()}
            little = any(rest < 1e-6 * whole for whole, rest in squares.values())
            norms = _norms(now) if little else {q: rest**0.5 for q, (_, rest) in squares.items()}
        norms = _norms(now)
        scale = _of_q({q: 0.0 if n <= 1e-12 else 1.0 / n for q, n in norms.items()})
        vector = now.select("q", "ib", F.transform("x", lambda x: x * scale).alias("v")).transform(cut)  # noqa: B023
        seen = vector.filter(F.exists("v", lambda x: F.abs(x) > 1e-9)).select("q").distinct().collect()
        live = {r["q"] for r in seen}
        grown = base.join(vector.filter(F.col("q").isin(*live)), ["q", "ib"], "left")
        base = grown.withColumn("found", F.when(F.col("v").isNotNull(), F.concat("found", F.array("v"))).otherwise(F.col("found"))).drop("v").transform(cut)
    own = items.join(base, ["q", "ib"])
    return own.select("q", "item", F.get("w", F.col("at")).alias("weight"), F.transform("found", lambda v: F.get(v, F.col("at"))).alias("v"))


def entity_factors(history: DataFrame, factors: DataFrame, rank: int = RANK) -> DataFrame:
    """(q, entity, p array): projection of an entity's items on every factor."""
    joined = history.join(factors, ["q", "item"])
    sums = [F.sum(F.col("weight") * F.coalesce(F.get("v", F.lit(k)), F.lit(0.0))).alias(f"_p{k}") for k in range(rank)]
    return joined.groupBy("q", "entity").agg(*sums).select("q", "entity", F.array(*[f"_p{k}" for k in range(rank)]).alias("p"))


def dot(a: str, b: str, width: int) -> Column:
    total = F.lit(0.0)
    for k in range(width):
        total = total + F.coalesce(F.get(a, F.lit(k)) * F.get(b, F.lit(k)), F.lit(0.0))
    return total
