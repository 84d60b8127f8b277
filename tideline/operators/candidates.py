"""Candidate generation: every known item the entity does not hold yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions.ordering import running_totals
from tideline.session import cut

WORD = 64
ITEM_TILE = 16 * WORD


def held_bits(placed: DataFrame, keys: list[str], widest: int) -> DataFrame:
    """(keys, _held): words of bits for the places ``_at`` that occur; ``widest`` places at most."""
    bit = F.expr(f"shiftleft(1L, cast(_at % {WORD} as int))")
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("_at") / WORD) == w, bit)), F.lit(0).cast("long")) for w in range(-(-widest // WORD))]
    return placed.groupBy(*keys).agg(F.array(*words).alias("_held"))


def tiled(rows: DataFrame, place: str, size: int) -> DataFrame:
    """Add ``_tile`` and the place in it, ``_at``, to rows with a place from 1."""
    at = F.col(place) - 1
    return rows.withColumns({"_tile": F.floor(at / size).cast("long"), "_at": (at % size).cast("int")})


def candidate_lists(targets: DataFrame, items: DataFrame, history: DataFrame, period: str, entity: str, item: str, tile_items: int = ITEM_TILE) -> DataFrame:
    """(targets' columns, _items): for each tile of the period's catalogue, the items that are not in ``history``.

    A period's items are numbered and cut into tiles; what an entity holds is a bit for each item of a tile, so neither
    the grid nor the history is ever dealt row by row: rows of the shuffles are (entity, tile).
    """
    places = tiled(running_totals(items, [period], [item], {"_place": F.lit(1)}), "_place", tile_items).drop("_place").transform(cut)
    widest = (places.agg(F.max("_at")).first()[0] or 0) + 1
    entry = F.struct("_at", F.struct(*[c for c in items.columns if c != period]).alias("x"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["x"])
    tiles = places.groupBy(period, "_tile").agg(entries.alias("_entries")).transform(cut)
    placed = history.select(period, entity, item).join(places.select(period, item, "_tile", "_at"), [period, item])
    held = held_bits(placed, [period, entity, "_tile"], widest)
    rows = targets.join(tiles.select(period, "_tile"), period).join(held, [period, entity, "_tile"], "left").join(tiles, [period, "_tile"])
    taken = lambda i: F.getbit(F.get("_held", F.shiftright(i, 6)), i % WORD)
    free = F.filter("_entries", lambda e, i: F.coalesce(taken(i), F.lit(0)) == 0)
    return rows.select(*targets.columns, free.alias("_items"))


def candidate_grid(
    targets: DataFrame,
    items: DataFrame,
    history: DataFrame,
    period: str,
    entity: str,
    item: str,
    tile_items: int = ITEM_TILE,
) -> DataFrame:
    """(targets' columns) with every item of the same period not in ``history``.

    The contract scores every candidate, so the result is as large as entities x items by definition; it is listed
    from `candidate_lists` in the task that reads it.
    """
    rest = [c for c in targets.columns if c not in (period, entity)]
    others = [c for c in items.columns if c not in (period, item)]
    lists = candidate_lists(targets, items, history, period, entity, item, tile_items)
    return lists.select(*targets.columns, F.inline("_items")).select(period, entity, item, *rest, *others)


def lowest_candidates(lists: DataFrame, period: str, entity: str, item: str, order, wanted: Column) -> DataFrame:
    """The ``wanted`` candidates of each (period, entity) that are lowest by (order, item); ``order`` takes an item.

    Each tile gives its lowest ones first, so only those meet.
    """
    own = [c for c in lists.columns if c != "_items"]
    keyed = F.transform("_items", lambda x: F.struct(order(x[item]).alias("_order"), x[item].alias("_item"), x.alias("x")))
    low = F.slice(F.array_sort(keyed), 1, F.least(wanted, F.lit(2**31 - 1)).cast("int"))
    rows = lists.select(*own, F.inline(low)).withColumn("_rn", F.row_number().over(W.partitionBy(period, entity).orderBy("_order", "_item")))
    return rows.filter(F.col("_rn") <= wanted).select(*own, "x.*")
