"""Classification metrics over scored rows, optionally per group.

The global scans (AUC, average precision, top decile) run through
``running_totals`` so neither one hot group nor the ungrouped case lands in a
single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions.ordering import running_totals
from tideline.functions.scalar import ratio


def _grouped(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str], bool]:
    if group:
        return df, list(group), False
    return df.withColumn("_g", F.lit(0)), ["_g"], True


def roc_auc(df: DataFrame, group: list[str], label: str, score: str, name: str = "roc_auc") -> DataFrame:
    """Mann-Whitney AUC with half credit for ties; NULL with a single class."""
    df, g, temp = _grouped(df, group)
    per_score = df.groupBy(*g, score).agg(
        F.sum(label).cast("long").alias("_pos"), F.sum(1 - F.col(label)).cast("long").alias("_neg")
    )
    walked = running_totals(per_score, g, [score], {"_cneg": F.col("_neg")})
    below = F.col("_cneg") - F.col("_neg")
    wins = F.sum(F.col("_pos") * (below + 0.5 * F.col("_neg")))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    out = walked.groupBy(*g).agg(ratio(wins, pairs).alias(name))
    return out.drop("_g") if temp else out


def ranked_rows(df: DataFrame, group: list[str], label: str, score: str, ident: list[str]) -> DataFrame:
    """Add ``position`` and running ``hits`` in the order score down, id up."""
    keyed = df.withColumn("_neg", -F.col(score))
    order = ["_neg", *ident]
    return running_totals(keyed, group, order, {"position": F.lit(1), "hits": F.col(label)}).drop("_neg")


def average_precision(
    df: DataFrame, group: list[str], label: str, score: str, ident: list[str], name: str = "average_precision"
) -> DataFrame:
    df, g, temp = _grouped(df, group)
    walked = ranked_rows(df, g, label, score, ident)
    gain = F.sum(F.when(F.col(label) == 1, F.col("hits") / F.col("position")))
    out = walked.groupBy(*g).agg(ratio(gain, F.sum(label)).alias(name))
    return out.drop("_g") if temp else out


def classification_metrics(
    df: DataFrame, group: list[str], label: str, score: str, ident: list[str]
) -> DataFrame:
    """Rows, positives, prevalence, AUC, AP, Brier, log loss and top-decile precision/recall."""
    df, g, temp = _grouped(df, group)
    clipped = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), F.col(score)))
    other = F.greatest(F.lit(1e-12), F.least(F.lit(1.0 - 1e-12), 1.0 - F.col(score)))
    loss = -(F.col(label) * F.log(clipped) + (1 - F.col(label)) * F.log(other))
    sizes = df.groupBy(*g).agg(
        F.count("*").alias("n_rows"),
        F.sum(label).cast("long").alias("positives"),
        F.avg(F.col(label).cast("double")).alias("prevalence"),
        F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"),
        F.avg(loss).alias("log_loss"),
    )
    sizes = sizes.withColumn("top_n", F.greatest(F.lit(1), F.ceil(F.col("n_rows") * F.lit(0.1))).cast("long"))
    walked = ranked_rows(df.select(*g, label, score, *ident), g, label, score, ident)
    gain = F.sum(F.when(F.col(label) == 1, F.col("hits") / F.col("position")))
    ordered = (
        walked.join(sizes.select(*g, "top_n"), g)
        .groupBy(*g)
        .agg(
            ratio(gain, F.sum(label)).alias("average_precision"),
            F.sum(F.when(F.col("position") <= F.col("top_n"), F.col(label)).otherwise(0)).alias("_top"),
        )
    )
    out = (
        sizes.join(ordered, g)
        .join(roc_auc(df, g, label, score), g)
        .withColumn("top_decile_precision", F.col("_top") / F.col("top_n"))
        .withColumn("top_decile_recall", ratio(F.col("_top"), F.col("positives")))
        .drop("_top")
    )
    return out.drop("_g") if temp else out


def require_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail the job on a missing, NaN or infinite value instead of ranking it silently."""
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        df = df.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} must be finite"))).otherwise(F.col(c)))
    return df


def require_binary(df: DataFrame, label: str) -> DataFrame:
    bad = F.col(label).isNull() | ~F.col(label).isin(0, 1)
    message = F.raise_error(F.lit("labels must contain only 0 and 1"))
    return df.withColumn(label, F.when(bad, message).otherwise(F.col(label)))


def pairwise_auc_counts(df: DataFrame, cluster: str, label: str, scores: list[str]) -> DataFrame:
    """Per cluster: positive-negative pairs and wins (ties half) for each score column.

    Uses rank sums within the cluster through the sliced scan, so the pairs are
    counted and never listed.
    """
    sizes = df.groupBy(cluster).agg(
        F.sum(label).cast("long").alias("_p"), F.sum(1 - F.col(label)).cast("long").alias("_n")
    )
    out = sizes.select(cluster, (F.col("_p") * F.col("_n")).alias("pairs"))
    for s in scores:
        per = df.groupBy(cluster, s).agg(
            F.sum(label).cast("long").alias("_pos"), F.sum(1 - F.col(label)).cast("long").alias("_neg")
        )
        walked = running_totals(per, [cluster], [s], {"_cneg": F.col("_neg")})
        wins = F.sum(F.col("_pos") * (F.col("_cneg") - F.col("_neg") + 0.5 * F.col("_neg")))
        out = out.join(walked.groupBy(cluster).agg(wins.alias(f"wins_{s}")), cluster)
    return out
