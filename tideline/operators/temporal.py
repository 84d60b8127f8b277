"""As-of building blocks: first occurrence, accumulation to cutoffs, recent windows.

Membership in a history never reverts, so "held before period q" is simply
``first period < q``.  All cutoffs are therefore evaluated in one job with the
cutoff as a column, and the leakage rule is a visible predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_seen(rows: DataFrame, keys: list[str], period: str, name: str = "first") -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(period).alias(name))


def later_periods(period: Column, periods: list[int]) -> Column:
    """Array of the cutoffs strictly after ``period`` (the list of cutoffs is short)."""
    wanted = F.array(*[F.lit(int(p)) for p in periods])
    return F.filter(wanted, lambda p: p > period)


def accumulate(
    facts: DataFrame, keys: list[str], period: str, periods: list[int], totals: dict[str, Column]
) -> DataFrame:
    """Totals of everything strictly before each cutoff, one row per (keys, cutoff).

    ``facts`` should already be aggregated to (keys, period): each fact is
    repeated once per later cutoff and combined map-side.
    """
    spread = facts.withColumn("_q", F.explode(later_periods(F.col(period), periods)))
    return spread.groupBy(*keys, F.col("_q").alias("q")).agg(
        *[F.sum(c).alias(name) for name, c in totals.items()]
    )


def recent_distinct(
    occurrences: DataFrame, owner: str, member: str, period: str, width: int, periods: list[int], name: str, following: str | None = None
) -> DataFrame:
    """Distinct ``member`` per (owner, q) seen in the ``width`` periods before q.

    Each occurrence answers only for the cutoffs after it and up to the next
    occurrence of the same pair, so nobody is counted twice and no set is built.
    Distinct occurrences may bring the period of the next one as ``following``.
    """
    if following is None:
        pair = W.partitionBy(owner, member).orderBy(period)
        occurrences = occurrences.select(owner, member, period).distinct().withColumn("_next", F.lead(period).over(pair))
    upto = F.least(F.col(period) + width, F.coalesce(F.col(following or "_next"), F.lit(2**30)))
    spread = (
        occurrences.withColumn("_to", upto)
        .withColumn("q", F.explode(F.sequence(F.col(period) + 1, F.col("_to"))))
        .filter(F.col("q").isin([int(p) for p in periods]))
    )
    return spread.groupBy(owner, "q").agg(F.count("*").alias(name))


def recent_sum(facts: DataFrame, owner: str, period: str, value: str, width: int, periods: list[int], name: str):
    spread = facts.withColumn(
        "q", F.explode(F.sequence(F.col(period) + 1, F.col(period) + width))
    ).filter(F.col("q").isin([int(p) for p in periods]))
    return spread.groupBy(owner, "q").agg(F.sum(value).alias(name))
