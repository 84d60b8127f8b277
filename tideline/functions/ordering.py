"""Global ordered scans without a one-task window.

``Window.orderBy`` with no partition (or with one hot partition) sorts all its
rows in a single task.  Here the order is cut into slices first: a small,
deterministic hash sample of the order keys gives the slice bounds, every row
is placed in its slice, the scan runs per (group, slice), and the tiny
(group, slice) totals supply the offsets.  The sample is taken by hash rather
than at random so a recomputed task sees the same bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tideline.session import cut, order_buckets


def placed_in_slices(df: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """Add ``_slice``: the number of the row's slice in the global order of ``keys``."""
    n = slices or order_buckets(df.sparkSession)
    key = F.struct(*keys)
    bounds = (
        df.select(key.alias("k"), F.xxhash64(*keys).alias("h"))
        .orderBy("h")
        .limit(n - 1)
        .agg(F.sort_array(F.collect_set("k")).alias("bounds"))
    )
    placed = df.withColumn("_bounds", bounds.scalar())
    # binary search: the number of bounds below the key, by halving steps
    steps = [F.lit(1 << k) for k in reversed(range(n.bit_length()))]

    def halve(low: Column, step: Column) -> Column:
        inside = low + step <= F.size("_bounds")
        return F.when(inside & (F.get("_bounds", low + step - 1) < key), low + step).otherwise(low)

    slice_no = F.aggregate(F.array(*steps), F.lit(0), halve)
    return placed.withColumn("_slice", slice_no).drop("_bounds")


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """Add inclusive running totals named by ``totals`` over ascending ``order`` in each group.

    ``order`` must be a total order within the group (include an id) whenever
    the per-row value matters.
    """
    group = list(group)
    temp = not group
    if temp:
        df, group = df.withColumn("_all", F.lit(0)), ["_all"]
    df = df.transform(cut)  # read by the sample, the scan and the slice totals
    placed = placed_in_slices(df, [*group, *order], slices)
    inside = W.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.select("*", *[F.sum(c).over(inside).alias(f"_in_{k}") for k, c in totals.items()])
    source = placed_in_slices(df, [*group, *order], slices)
    sums = source.groupBy(*group, "_slice").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in totals.items()])
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in totals],
    )
    joined = placed.join(offsets, [*group, "_slice"])
    out = joined.select(
        *[c for c in df.columns if c != "_all"],
        *[(F.col(f"_in_{k}") + F.col(f"_o_{k}")).alias(k) for k in totals],
    )
    return out


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Zero-based position of each distinct ``key`` in ascending order."""
    ranked = running_totals(df.select(key).distinct(), [], [key], {"_n": F.lit(1)})
    return ranked.select(key, (F.col("_n") - 1).cast("long").alias(name))
