"""Total-order ranks and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.functions.ordering import running_totals
from tideline.functions.scalar import ratio
from tideline.operators.candidates import ITEM_TILE, WORD, held_bits, tiled
from tideline.session import cut

CUTOFFS = (5, 10, 20)


def full_ranks(scored: DataFrame, within: list[str], score: str, support: str, item: str, name: str = "rank"):
    """Rank every candidate row: score down, support down, item up."""
    order = W.partitionBy(*within).orderBy(F.desc(score), F.desc(support), F.asc(item))
    return scored.withColumn(name, F.row_number().over(order))


def catalogue_positions(catalogue: DataFrame) -> DataFrame:
    """(period, item, support, place): place 1 is the most supported item of the period; ``second``, if given, breaks ties."""
    keyed = catalogue.withColumn("_neg", -F.col("support")).withColumn("_second", -F.col("second") if "second" in catalogue.columns else F.lit(0))
    return running_totals(keyed, ["period"], ["_neg", "_second", "item"], {"place": F.lit(1)}).drop("_neg", "_second")


def catalogue_ranks(positives: DataFrame, history: DataFrame, catalogue: DataFrame, tile: int = ITEM_TILE) -> DataFrame:
    """`sparse_ranks` without scores: a place less the held places before it, counted from words of bits."""
    key = ["period", "entity", "item"]
    places = tiled(catalogue_positions(catalogue), "place", tile).transform(cut)
    widest = (places.agg(F.max("_at")).first()[0] or 0) + 1
    spot = ["period", "entity", "_tile"]
    held = held_bits(history.select(*key).join(places.select("period", "item", "_tile", "_at"), ["period", "item"]), spot, widest)
    asked = positives.select(*key).join(places.select("period", "item", "support", "place", "_tile", "_at"), ["period", "item"])
    asked = asked.groupBy(*spot).agg(F.collect_set(F.struct("item", "support", "place", "_at")).alias("asked"))
    whole = F.expr("aggregate(_held, 0L, (a, w) -> a + bit_count(w))")
    earlier = W.partitionBy("period", "entity").orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    rows = asked.join(held, spot, "full_outer").withColumn("_before", F.coalesce(F.sum(whole).over(earlier), F.lit(0)))
    rows = rows.filter("asked is not null").select("period", "entity", "_held", "_before", F.inline("asked"))
    word = f"cast(_at div {WORD} as int)"
    below = F.expr(
        f"aggregate(slice(_held, 1, {word}), 0L, (a, w) -> a + bit_count(w)) + bit_count(get(_held, {word}) & ~shiftleft(-1L, cast(_at % {WORD} as int)))"
    )
    rank = (F.col("place") - F.col("_before") - F.coalesce(below, F.lit(0))).cast("long")
    return rows.select(*key, F.lit(0.0).alias("score"), "support", rank.alias("rank"))


def sparse_ranks(
    positives: DataFrame,
    history: DataFrame,
    catalogue: DataFrame,
    scores: DataFrame | None = None,
) -> DataFrame:
    """Exact ranks of ``positives`` among all candidates without listing the candidates.

    Inputs share (period, entity, item); ``catalogue`` has (period, item,
    support) for every known item; ``scores`` holds the non-zero scores only.
    A candidate with no score ties at zero, where the order is the catalogue
    order, so its rank follows from its catalogue place less the rows that are
    already used (held items and scored items) before it.
    """
    if scores is None:
        return catalogue_ranks(positives, history, catalogue)
    key = ["period", "entity", "item"]
    heads = positives.select("period", "entity").distinct()
    held = history.join(heads, ["period", "entity"], "left_semi").select(
        *key, F.lit(0.0).alias("score"), F.lit(1).alias("held"), F.lit(0).alias("scored"), F.lit(0).alias("wanted")
    )
    rows = held.unionByName(
        positives.select(*key, F.lit(0.0).alias("score"), F.lit(0).alias("held"), F.lit(0).alias("scored"), F.lit(1).alias("wanted"))
    )
    rows = rows.unionByName(
        scores.join(heads, ["period", "entity"], "left_semi").select(
            *key, "score", F.lit(0).alias("held"), F.lit(1).alias("scored"), F.lit(0).alias("wanted")
        )
    )
    flat = rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("score", "held", "scored", "wanted")])
    placed = flat.join(catalogue_positions(catalogue), ["period", "item"])
    group = W.partitionBy("period", "entity")
    before = group.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.greatest("held", "scored")).over(before), F.lit(0))
    rank = F.col("place") - used
    by_score = group.orderBy(F.desc("scored"), F.desc("score"), F.asc("place"))
    rank = F.when(F.col("scored") == 1, F.row_number().over(by_score)).otherwise(F.sum("scored").over(group) + rank)
    ranked = placed.select(*key, "score", "support", "wanted", rank.cast("long").alias("rank"))
    return ranked.filter("wanted = 1").drop("wanted")


def entity_metrics(ranked: DataFrame, keys: list[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """Per-entity hits, recall and reciprocal rank from one row per ranked positive."""
    n = F.count("*")
    hits = {k: F.sum((F.col("rank") <= k).cast("long")) for k in CUTOFFS}
    return ranked.groupBy(*keys).agg(
        n.alias("positive_edges"),
        *[hits[k].alias(f"hits_at_{k}") for k in CUTOFFS],
        *[(hits[k] / n).alias(f"recall_at_{k}") for k in CUTOFFS],
        (1.0 / F.min("rank")).alias("mrr"),
        *[c.alias(name) for name, c in (carry or {}).items()],
    )


def pooled_metrics(entities: DataFrame, keys: list[str], undefined: float | None = None, extra=()) -> DataFrame:
    """Micro recall from sums, macro recall and MRR as plain entity averages."""

    def settle(c: Column) -> Column:
        return c if undefined is None else F.coalesce(c, F.lit(undefined))

    total = F.sum("positive_edges")
    return entities.groupBy(*keys).agg(
        F.coalesce(total, F.lit(0)).alias("positive_edges"),
        F.count("*").alias("entities"),
        *[F.coalesce(F.sum(f"hits_at_{k}"), F.lit(0)).alias(f"hits_at_{k}") for k in CUTOFFS],
        *[settle(ratio(F.sum(f"hits_at_{k}"), total)).alias(f"micro_recall_at_{k}") for k in CUTOFFS],
        *[settle(F.avg(f"recall_at_{k}")).alias(f"macro_recall_at_{k}") for k in CUTOFFS],
        settle(F.avg("mrr")).alias("mrr"),
        *extra,
    )
