"""Fitted-model queries: checked by tests, reported as rows."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tideline.functions.ordering import dense_index
from tideline.functions.scalar import history_band, quarter_label, support_band
from tideline.operators import latent, logistic, spectral
from tideline.operators.metrics import classification_metrics
from tideline.plans import analysis as A
from tideline.plans import stability
from tideline.plans.registry import load_task
from tideline.plans.trials import TrialStudy
from tideline.queries.prescriber import rounded
from tideline.session import cut
from tideline.sources import bindings, manifest
from tideline.streaming import first_seen as stream

RESAMPLES = 200
SEED = 410


def _vectors(df, d: int):
    return df.select(*[c for c in df.columns if c != "e"], *[F.col("e")[k].alias(f"e{k}") for k in range(d)])


def _both(f: latent.Factors):
    left = f.entities.select("q", F.lit("entity").alias("side"), F.col("entity").alias("node"), "e")
    right = f.items.select("q", F.lit("item").alias("side"), F.col("item").alias("node"), "e")
    return _vectors(left.unionByName(right), f.dimension)


def m_logistic(spark, root):
    return logistic.coefficients(spark, load_task("device", spark, root).logistic_models)


def m_stumps(spark, root):
    models = load_task("device", spark, root).stump_models
    rows = [(m.name, i, f, t, a, b, m.base) for m in models for i, (f, t, a, b) in enumerate(m.stumps)]
    return spark.createDataFrame(rows, "refit string, round int, feature string, threshold double, left double, right double, base double")


def m_spectral(spark, root):
    f = load_task("device", spark, root).spectral_factors
    return f.select("q", "item", "weight", *[F.get("v", F.lit(k)).alias(f"v{k}") for k in range(spectral.RANK)])


def m_bpr(spark, root):
    return _both(load_task("device", spark, root).bpr)


def m_graphsage(spark, root):
    return _both(load_task("device", spark, root).graphsage)


def m_rolling(spark, root):
    """All seven rankers over the evaluation quarters, with yearly refits."""
    task = load_task("device", spark, root)
    metrics = task.study.threshold_metrics(task.entities(), ["method", "q"])
    return rounded(metrics.withColumn("quarter", quarter_label(F.col("q"))).drop("q"))


def m_analysis(spark, root):
    """Intervals of the message model against neighbour frequency, and within-product AUC against the averaged embeddings."""
    task = load_task("device", spark, root)
    test = task.entities().filter(F.col("q") >= task.study.window.test).transform(cut)
    a, b = "neighbor_frequency", "graphsage_link_prediction"
    ranks = A.ranking_intervals(test, "product", a, b, RESAMPLES, SEED)
    wide = task.scored.filter(F.col("q") >= task.study.window.test)
    rows = task.study.prediction_rows(
        wide.select("q", "product", "problem", F.col("graph_message_passing_bpr").alias("score"), F.col(b).alias("score_b"))
    )
    pairs = rows.select(F.col("product").alias("cluster"), F.col("label").cast("long").alias("label"), F.col("score").alias("score_a"), "score_b").transform(cut)
    inside = A.cluster_intervals(pairs, "cluster", RESAMPLES, SEED + 3).filter("metric = 'pairwise_auc'")
    return rounded(ranks.unionByName(inside))


def m_support_slices(spark, root):
    """Classification metrics of the exported prediction rows by support band."""
    task = load_task("device", spark, root)
    out = None
    for method in ("neighbor_frequency", "graph_message_passing_bpr", "graphsage_link_prediction"):
        scored = task.scored.filter(F.col("q") >= task.study.window.test).select("q", "product", "problem", F.col(method).cast("double").alias("score"))
        rows = task.study.prediction_rows(scored).join(task.study.supports(task.study.window.evaluation), ["product", "q"])
        rows = rows.select(F.lit(method).alias("method"), support_band(F.col("history_support")).alias("band"), F.col("label").cast("long").alias("label"), "score", "q", "product", "problem", "copy")
        out = rows if out is None else out.unionByName(rows)
    return rounded(classification_metrics(out, ["method", "band"], "label", "score", ["q", "product", "problem", "copy"]))


def c_logistic(spark, root):
    return logistic.coefficients(spark, load_task("facility", spark, root).models)


def c_expanding(spark, root):
    """Annual and pooled-test metrics of the three facility methods."""
    task = load_task("facility", spark, root)
    scope = F.explode(F.array_compact(F.array(F.col("year").cast("string"), F.when(F.col("year") > min(task.years), F.lit("test")))))
    rows = task.predictions.withColumn("scope", scope)
    return rounded(classification_metrics(rows, ["method", "scope"], "label", "score", ["day", "ccn"]))


def c_analysis(spark, root):
    """Ownership minus history: AUC, AP and Brier intervals over facilities on the test years."""
    task = load_task("facility", spark, root)
    test = task.predictions.filter(F.col("year") > min(task.years))
    a, b = (test.filter(F.col("method") == m) for m in task.methods[1:])
    pairs = A.pair_predictions(a, b, ["year", "ccn", "day"], []).withColumnRenamed("ccn", "cluster").transform(cut)
    ranked = A.rank_intervals(pairs, "cluster", ["day", "cluster"], RESAMPLES, SEED + 4)
    brier = A.additive_bootstrap(
        A.brier_sums(pairs, "cluster").transform(cut), "cluster", {"brier": F.col("brier_gap") / F.col("n")}, RESAMPLES, SEED + 1
    )
    return rounded(ranked.unionByName(brier))


def c_history_slices(spark, root):
    task = load_task("facility", spark, root)
    rows = task.predictions.filter(F.col("year") > min(task.years)).withColumn("band", history_band(F.col("prior_inspections")))
    return rounded(classification_metrics(rows, ["method", "band"], "label", "score", ["day", "ccn"]))


def p_logistic(spark, root):
    return logistic.coefficients(spark, load_task("prescriber", spark, root).logistic_models)


def p_graph_bpr(spark, root):
    return _both(load_task("prescriber", spark, root).factors)


def p_model_metrics(spark, root):
    """All four prescriber methods: positive-containing metrics by year and pooled."""
    task = load_task("prescriber", spark, root)
    return rounded(task.study.pooled(task.study.provider_metrics(task.predictions), ["method"]))


def p_model_load(spark, root):
    return rounded(load_task("prescriber", spark, root).load())


def t_logistic(spark, root):
    return stability.coefficient_table(spark, root)


def t_stability(spark, root):
    return rounded(stability.origin_metrics(spark, root))


def t_stability_intervals(spark, root):
    return rounded(stability.intervals(spark, root, RESAMPLES))


def t_gate(spark, root):
    """The trial gate: three nested models on the validation, test and pooled rows."""
    study = TrialStudy.bound(spark, root)
    return rounded(stability.gate(study, *(date.fromisoformat(d) for d in (bindings.TRIAL_VALIDATION, bindings.TRIAL_TEST))))


def registry_predictions(spark, root):
    """Test ranks of one heuristic and one learned prescriber method through the common interface."""
    task = load_task("partd", spark, root)
    sets = [task.test_scores(m) for m in ("specialty_popularity", "tabular_logistic")]
    out = task.evaluate(sets[0]).unionByName(task.evaluate(sets[1]))
    return rounded(out)


def init_embedding(spark, root):
    """Sine start vectors by position and hash start vectors by name of every brand."""
    names = bindings.table(spark, root, "part").select(F.col("p_brand").alias("item"))
    placed = dense_index(names, "item")
    return placed.select(
        "item", "idx",
        *[latent.sine_embedding(F.col("idx"), 8, 7)[k].alias(f"s{k}") for k in range(8)],
        *[latent.hash_embedding("drug", F.col("item"), 12)[k].alias(f"h{k}") for k in range(12)],
    )


def manifest_drift(spark, root):
    """Files of the data folder against a manifest with one wrong size and one missing file."""
    listed = manifest.describe(spark, f"{root}/*.parquet").transform(cut)
    expected = listed.withColumn("bytes", F.when(F.col("name") == "region.parquet", F.col("bytes") + 1).otherwise(F.col("bytes")))
    absent = expected.filter("name = 'nation.parquet'").withColumn("name", F.lit("absent.parquet"))
    return manifest.drift(expected.unionByName(absent), listed).select("name", "problem")


#: Columns that the manifest of a table covers.
COVERED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
}


def _described(tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [manifest.describe_rows(df, name, COVERED[name]) for name, df in tables.items()])


def source_manifest(spark, root):
    """Rows and checksum of every source table."""
    return _described({name: bindings.table(spark, root, name) for name in COVERED})


def manifest_check(spark, root):
    """Tables against a manifest that was recorded before one lost rows, one changed values and one was added."""
    tables = {name: bindings.table(spark, root, name) for name in COVERED}
    recorded = _described({name: df for name, df in tables.items() if name != "nation"})
    changed = F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus"))
    now = {**tables, "lineitem": tables["lineitem"].filter("l_linenumber < 7"), "orders": tables["orders"].withColumn("o_orderstatus", changed)}
    return manifest.row_drift(recorded, _described(now))


def first_seen_stream(spark, root):
    return stream.run_first_seen(spark, root)


QUERIES = {
    f.__name__: f
    for f in (
        m_logistic, m_stumps, m_spectral, m_bpr, m_graphsage, m_rolling, m_analysis, m_support_slices, c_logistic, c_expanding,
        c_analysis, c_history_slices, p_logistic, p_graph_bpr, p_model_metrics, p_model_load, t_logistic, t_stability,
        t_stability_intervals, t_gate, registry_predictions, init_embedding, manifest_drift, source_manifest, manifest_check, first_seen_stream,
    )
}
