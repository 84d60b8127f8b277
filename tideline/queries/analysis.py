"""Metric, bootstrap and cross-study queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tideline.functions.scalar import ratio
from tideline.operators import metrics as M
from tideline.operators.bootstrap import rank_metric_bootstrap
from tideline.operators.ranking import pooled_metrics
from tideline.plans import analysis as A
from tideline.plans.device import DeviceStudy
from tideline.plans.facility import FacilityStudy
from tideline.plans.prescriber import PrescriberStudy
from tideline.plans.trials import TrialStudy
from tideline.queries import prescriber as P
from tideline.queries.device import EVALUATION, WINDOW
from tideline.queries.prescriber import rounded
from tideline.sources import bindings

RESAMPLES = 200
SEED = 410


def scored_documents(spark, root):
    """(doc_id, cluster, lang, label, score_a, score_b) of the labelled documents."""
    docs = bindings.table(spark, root, "documents").select(
        "doc_id", "source", "lang", "n_chars",
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"),
    )
    labels = bindings.table(spark, root, "labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("source").alias("cluster"), "lang", "label",
        (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("score_a"),
        (F.col("spaces") / (F.col("spaces") + 200)).alias("score_b"),
    )


def roc_auc(spark, root):
    return rounded(M.roc_auc(scored_documents(spark, root), [], "label", "score_a"))


def average_precision(spark, root):
    return rounded(M.average_precision(scored_documents(spark, root), [], "label", "score_b", ["doc_id"]))


def classification_metrics(spark, root):
    rows = M.require_finite(M.require_binary(scored_documents(spark, root), "label"), ["score_a"])
    return rounded(M.classification_metrics(rows, [], "label", "score_a", ["doc_id"]))


def sliced_metrics(spark, root):
    return rounded(M.classification_metrics(scored_documents(spark, root), ["lang"], "label", "score_a", ["doc_id"]))


def recall_mrr_grouped(spark, root):
    """Recall at 1, 5, 10 and MRR of each source's list ranked by the first score."""
    order = W.partitionBy("cluster").orderBy(F.desc("score_a"), "doc_id")
    ranked = scored_documents(spark, root).withColumn("rank", F.row_number().over(order))
    hit = F.col("label") == 1
    n = F.count_if(hit)
    return rounded(
        ranked.groupBy("cluster").agg(
            *[ratio(F.count_if(hit & (F.col("rank") <= k)), n).alias(f"recall_at_{k}") for k in (1, 5, 10)],
            (1.0 / F.min(F.when(hit, F.col("rank")))).alias("mrr"),
        )
    )


def pair_predictions(spark, root):
    rows = scored_documents(spark, root)
    a = rows.select("doc_id", "cluster", "label", F.col("score_a").alias("score"))
    b = rows.filter("label = 1 or doc_id % 3 > 0").select("doc_id", "label", F.col("score_b").alias("score"))
    return rounded(A.pair_predictions(a, b, ["doc_id"], ["cluster"]))


def pairwise_auc_diff(spark, root):
    counts = M.pairwise_auc_counts(scored_documents(spark, root), "cluster", "label", ["score_a", "score_b"])
    return rounded(counts.withColumn("difference", ratio(F.col("wins_score_b") - F.col("wins_score_a"), F.col("pairs"))))


def paired_diff(spark, root):
    return rounded(A.paired_differences(scored_documents(spark, root), "cluster", ["doc_id"]))


def cluster_bootstrap(spark, root):
    return rounded(A.cluster_intervals(scored_documents(spark, root), "cluster", RESAMPLES, SEED))


def rank_bootstrap(spark, root):
    return rounded(rank_metric_bootstrap(scored_documents(spark, root), "cluster", ["doc_id"], RESAMPLES, SEED))


def _device_table(spark, root):
    s = DeviceStudy.bound(spark, root)
    entities = s.product_metrics(s.baseline_ranks(EVALUATION), EVALUATION).filter(
        (F.col("q") >= WINDOW.test) & (F.col("history_support") >= 1)
    )
    wide = pooled_metrics(entities, ["method"], undefined=0.0).withColumnsRenamed(
        {f"micro_recall_at_{k}": f"recall_at_{k}" for k in (5, 10, 20)}
    )
    names = {**{f"recall_at_{k}": "eligible positive edges" for k in (5, 10, 20)}, **{f"macro_recall_at_{k}": "eligible product-quarter macro average" for k in (5, 10, 20)}, "mrr": "eligible product-quarter observations"}
    return A.unified_table(wide, "maude", "test", "2000Q1-2001Q4; threshold=1", names, "device")


def _facility_table(spark, root):
    rows = FacilityStudy.bound(spark, root).prevalence_predictions().filter("year >= 2000")
    both = rows.select("ccn", "day", "label", F.lit("prevalence").alias("method"), "score").unionByName(
        rows.select("ccn", "day", "label", F.lit("prior_serious_rate").alias("method"), F.col("prior_serious_rate").alias("score"))
    )
    wide = M.classification_metrics(both, ["method"], "label", "score", ["day", "ccn"])
    names = {m: "all retained target inspection rows" for m in ("roc_auc", "average_precision", "top_decile_precision", "top_decile_recall", "brier")}
    return A.unified_table(wide, "cms_nursing", "test", "2000-2001 pooled", names, "facility")


def _prescriber_table(spark, root):
    s = PrescriberStudy.bound(spark, root)
    entities = s.provider_metrics(P._ranked(s, "generic", [2001], P.MODEL_HEURISTICS))
    wide = pooled_metrics(entities, ["method"]).withColumnsRenamed(
        {f"macro_recall_at_{k}": f"provider_macro_recall_at_{k}" for k in (5, 10, 20)}
    )
    names = {**{f"micro_recall_at_{k}": "micro positives" for k in (5, 10, 20)}, **{f"provider_macro_recall_at_{k}": "provider macro average" for k in (5, 10, 20)}, "mrr": "first relevant rank"}
    return A.unified_table(wide, "partd_prescriber_drug", "test", "2001 held-out; generic", names, "prescriber")


def _unified(spark, root):
    return _device_table(spark, root).unionByName(_facility_table(spark, root)).unionByName(_prescriber_table(spark, root))


def unified_metrics(spark, root):
    return rounded(_unified(spark, root))


def family_value(spark, root):
    primary = {
        "maude": ("recall_at_10", "global_popularity"),
        "cms_nursing": ("roc_auc", "prior_serious_rate"),
        "partd_prescriber_drug": ("micro_recall_at_10", None),
    }
    return rounded(A.family_values(_unified(spark, root), primary))


def split_counts(spark, root):
    """Rows per study and temporal split."""
    d = DeviceStudy.bound(spark, root).eligible.select(
        F.lit("device").alias("study"),
        F.when(F.col("q") < WINDOW.validation, "train").when(F.col("q") < WINDOW.test, "validation").otherwise("test").alias("split"),
    )
    f = FacilityStudy.bound(spark, root).base_rows.select(
        F.lit("facility").alias("study"),
        F.when(F.col("year") <= 1998, "train").when(F.col("year") == 1999, "validation").otherwise("test").alias("split"),
    )
    p = PrescriberStudy.bound(spark, root).edges.select(
        F.lit("prescriber").alias("study"),
        F.when(F.col("year") <= 1999, "train").when(F.col("year") == 2000, "validation").otherwise("test").alias("split"),
    )
    return d.unionByName(f).unionByName(p).groupBy("study", "split").agg(F.count("*").alias("n"))


def task_cardinalities(spark, root):
    d, f = DeviceStudy.bound(spark, root), FacilityStudy.bound(spark, root)
    rows = [
        ("device_unique_edges", d.edge_first.agg(F.count("*").alias("v"))),
        ("device_quarters", d.product_quarter.agg(F.countDistinct("quarter").alias("v"))),
        ("facility_episodes", f.inspections.agg(F.count("*").alias("v"))),
        ("facility_serious", f.inspections.agg(F.sum("serious").cast("long").alias("v"))),
        ("facility_rows", f.base_rows.agg(F.count("*").alias("v"))),
        ("facility_positives", f.base_rows.agg(F.sum("label").alias("v"))),
    ]
    out = None
    for name, df in rows:
        row = df.select(F.lit(name).alias("measure"), F.col("v").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def support_decision(spark, root):
    """REVIEW_REQUIRED when every scored period has support, by study."""
    p = PrescriberStudy.bound(spark, root)
    counts = p.positives("variant", p.before("variant", p.score_years), p.score_years).groupBy("target").count()
    prescriber = counts.agg(F.lit("prescriber").alias("study"), (F.count_if(F.col("count") > 0) == len(p.score_years)).alias("ok"))
    audit = TrialStudy.bound(spark, root).label_audit().filter(F.col("origin") >= F.lit(bindings.TRIAL_VALIDATION).cast("date"))
    trials = audit.agg(F.lit("trials").alias("study"), F.bool_and((F.col("positive") > 0) & (F.col("negative") > 0)).alias("ok"))
    both = prescriber.unionByName(trials)
    return both.select("study", F.when(F.col("ok"), "REVIEW_REQUIRED").otherwise("INSUFFICIENT_OBSERVED_SUPPORT").alias("decision"))


QUERIES = {
    f.__name__: f
    for f in (
        roc_auc, average_precision, classification_metrics, sliced_metrics, recall_mrr_grouped, pair_predictions,
        pairwise_auc_diff, paired_diff, cluster_bootstrap, rank_bootstrap, unified_metrics, family_value, split_counts,
        task_cardinalities, support_decision,
    )
}
