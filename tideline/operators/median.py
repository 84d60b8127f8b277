"""Exact median over the pooled values of several owners, from per-owner histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideline.session import cut

BUCKET = 64


def _bucket(value: Column) -> Column:
    return F.floor(value / BUCKET)


def packed_histogram(histogram: DataFrame, owner: list[str], value: str) -> DataFrame:
    """(owner, cells): one row per owner with its (value, n) cells."""
    cell = F.struct(F.col(value).cast("long").alias("v"), F.col("n").cast("long").alias("n"))
    return histogram.groupBy(*owner).agg(F.collect_list(cell).alias("cells"))


def in_buckets(cells: Column) -> Column:
    """The cells summed by bucket."""
    size = lambda b: F.aggregate(F.filter(cells, lambda c: _bucket(c["v"]) == b), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    return F.transform(F.array_distinct(F.transform(cells, lambda c: _bucket(c["v"]))), lambda b: F.struct(b.alias("v"), size(b).alias("n")))


def _at(cells: Column, rank: Column) -> Column:
    """The value that holds the place ``rank`` (from 0) in cells sorted by value."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("v"))
    step = lambda a, c: F.struct(
        (a["upto"] + c["n"]).alias("upto"),
        F.when((rank >= a["upto"]) & (rank < a["upto"] + c["n"]), c["v"]).otherwise(a["v"]).alias("v"),
    )
    return F.aggregate(cells, start, step, lambda a: a["v"])


def _total(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"])


def packed_median(members: DataFrame, packed: DataFrame, target: list[str], owner: list[str], name: str) -> DataFrame:
    """(target, median) from `packed_histogram` rows; ``members`` are read twice, so hand in a written table.

    An owner sends each of its targets one row with the sizes of its buckets of 64 values, and then one with the cells of
    the one or two buckets that hold the middle places: no cell is ever a row of a shuffle.
    """
    coarse = packed.select(*owner, in_buckets(F.col("cells")).alias("cells"))
    pooled = members.join(coarse, owner).groupBy(*target).agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells"))
    total = _total(F.col("cells"))
    placed = pooled.select(*target, "cells", F.floor((total - 1) / 2).alias("_low"), F.floor(total / 2).alias("_high"))
    placed = placed.select(*target, "cells", "_low", "_high", _at(F.col("cells"), F.col("_low")).alias("_from"), _at(F.col("cells"), F.col("_high")).alias("_upto"))
    before = _total(F.filter("cells", lambda c: c["v"] < F.col("_from")))
    middle = placed.select(*target, "_from", "_upto", (F.col("_low") - before).alias("_low"), (F.col("_high") - before).alias("_high")).transform(cut)
    asked = members.join(middle.select(*target, "_from", "_upto"), target).join(packed, owner)
    inside = F.filter("cells", lambda c: (_bucket(c["v"]) == F.col("_from")) | (_bucket(c["v"]) == F.col("_upto")))
    fine = asked.select(*target, inside.alias("cells")).filter(F.size("cells") > 0)
    fine = fine.groupBy(*target).agg(F.array_sort(F.flatten(F.collect_list("cells"))).alias("cells")).join(middle, target)
    return fine.select(*target, ((_at(F.col("cells"), F.col("_low")) + _at(F.col("cells"), F.col("_high"))) / 2).alias(name))


def pooled_median(members: DataFrame, histogram: DataFrame, target: list[str], owner: list[str], value: str, name: str):
    """(target, median) of all values of all owners a target is attached to.

    ``members``: (target, owner); ``histogram``: (owner, value, n) with integer values.
    """
    return packed_median(members, packed_histogram(histogram, owner, value), target, owner, name)
