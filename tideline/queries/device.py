"""Device-report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions.scalar import quarter_from_text, quarter_label, support_band
from tideline.plans.device import DeviceStudy
from tideline.sources import bindings, reports
from tideline.sources.bindings import DeviceWindow

WINDOW = DeviceWindow()
EVALUATION = WINDOW.evaluation
ALL_QUARTERS = list(range(WINDOW.first + 1, WINDOW.last + 1))


def _study(spark: SparkSession, root: str) -> DeviceStudy:
    return DeviceStudy.bound(spark, root)


def _labelled(df: DataFrame, name: str = "q") -> DataFrame:
    return df.withColumn("quarter", quarter_label(F.col(name))).drop(*([name] if name != "quarter" else []))


def m_device_rows(spark, root):
    rows = reports.classify_device_lines(bindings.raw_device_lines(spark, root), "1995Q1", "2001Q4")
    valid = rows.filter("status = 'valid'").select("key", "quarter", "product", "manufacturer")
    return _labelled(valid, "quarter")


def m_parse_audit(spark, root):
    return reports.parse_audit(
        reports.classify_device_lines(bindings.raw_device_lines(spark, root), "1995Q1", "2001Q4")
    )


def m_key_inversions(spark, root):
    rows = reports.classify_device_lines(bindings.raw_device_lines(spark, root), "1995Q1", "2001Q4")
    keyed = rows.filter(~F.col("status").isin("blank", "non_numeric_key", "wrong_width"))
    return reports.key_inversions(keyed)


def m_problem_rows(spark, root):
    rows = reports.classify_problem_lines(bindings.raw_problem_lines(spark, root))
    return rows.filter("status = 'valid'").select("key", "problem").distinct()


def quarter_bucket(spark, root):
    days = bindings.table(spark, root, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    text = F.when(F.day("d") == 1, F.date_format("d", "MM/dd/yyyy")).otherwise(F.date_format("d", "yyyy/MM/dd"))


    q = days.select(quarter_from_text(text, "1996Q1", "2000Q4").alias("q"))
    return q.select(quarter_label(F.col("q")).alias("quarter")).groupBy("quarter").agg(F.count("*").alias("n"))


def nearest_prefix_parent(spark, root):
    return reports.nearest_prefix_parent(_problem_codes(spark, root))


def _problem_codes(spark, root):
    """Code map over the part table: brand-size codes whose target code nests by prefix."""
    part = bindings.table(spark, root, "part")
    rows = part.select(
        F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("fda_code"),
        F.concat(
            F.lit("B"), F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 2, "0"),
            F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_size").cast("string")),
        ).alias("imdrf_code"),
        F.col("p_partkey").alias("row_no"),
    )
    return reports.code_map(rows)


def m_hierarchy_coverage(spark, root):
    study = _study(spark, root)
    observed = study.edge_first.select(F.col("problem").alias("code")).distinct()
    codes = _problem_codes(spark, root)
    parents = reports.nearest_prefix_parent(codes)
    return observed.join(codes, "code", "left").join(parents, "code", "left").agg(
        F.count("*").alias("observed_codes"),
        F.count("imdrf").alias("codes_with_mapping"),
        F.count("parent").alias("codes_with_parent"),
    )


def m_edges(spark, root):
    return _labelled(_study(spark, root).edge_quarter, "quarter")


def m_match_audit(spark, root):
    return _study(spark, root).match_audit()


def m_snapshot(spark, root):
    return _labelled(_study(spark, root).snapshot(), "quarter")


def m_multiplicity_audit(spark, root):
    return _study(spark, root).multiplicity_audit()


def m_first_edges(spark, root):
    return _study(spark, root).first_edge_counts()


def m_eligible(spark, root):
    return _labelled(_study(spark, root).eligible)


def m_history(spark, root):
    s = _study(spark, root)
    return _labelled(
        s.problem_history(ALL_QUARTERS).select(
            "q", "problem", "problem_reports", "prevalence", "parent_prevalence", "problem_first"
        ).withColumn("problem_first", F.col("problem_first").cast("long"))
    )


def m_recent_activity(spark, root):
    s = _study(spark, root)
    known = s.catalogue(ALL_QUARTERS).select("q", "problem")
    return _labelled(known.join(s.recent_products(ALL_QUARTERS), ["problem", "q"], "left").fillna(0, ["recent_products"]).select("q", "problem", "recent_products"))


def m_manufacturer_activity(spark, root):
    return _labelled(_study(spark, root).manufacturer_activity(ALL_QUARTERS))


def m_candidates(spark, root):
    return _labelled(_study(spark, root).candidates(EVALUATION))


def m_rank_popularity(spark, root):
    return _labelled(_study(spark, root).popularity_ranks(EVALUATION))


def m_neighbor_frequency(spark, root):
    return _labelled(_study(spark, root).neighbor_scores(EVALUATION))


def m_features(spark, root):
    s = _study(spark, root)
    rows = s.with_features(s.eligible.filter(F.col("q").isin(EVALUATION)), EVALUATION).drop("prevalence")
    names = [c for c in rows.columns if c not in ("q", "product", "problem")]
    return _labelled(rows.select("q", "product", "problem", *[F.round(c, 6).alias(c) for c in names]))


def m_training_rows(spark, root):
    s = _study(spark, root)
    return _labelled(s.training_rows([q for q in ALL_QUARTERS if q < WINDOW.validation]))


def _entities(s: DeviceStudy):
    return s.product_metrics(s.baseline_ranks(EVALUATION), EVALUATION)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def m_entity_metrics(spark, root):
    return _rounded(_labelled(_entities(_study(spark, root))))


def m_rank_metrics(spark, root):
    s = _study(spark, root)
    return _rounded(_labelled(s.threshold_metrics(_entities(s), ["method", "q"])))


def _split(q):
    return F.when(q < WINDOW.test, "validation").otherwise("test")


def m_split_metrics(spark, root):
    s = _study(spark, root)
    rows = _entities(s).withColumn("split", _split(F.col("q")))
    return _rounded(s.threshold_metrics(rows, ["method", "split"]))


def gate_decision(by_quarter: DataFrame, low_support: DataFrame, learned: list[str], quarters: int) -> DataFrame:
    """Which learned methods win at least half the quarters against both baselines.

    ``by_quarter``: (method, q, recall); ``low_support``: (method, recall).
    """
    base = ["global_popularity", "neighbor_frequency"]
    pivot = by_quarter.groupBy("q").pivot("method", [*base, *learned]).agg(F.max("recall"))
    low = low_support.groupBy().pivot("method", [*base, *learned]).agg(F.max("recall"))
    long = pivot.select(
        "q",
        *[F.col(b) for b in base],
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("recall")) for m in learned])
        ).alias("m"),
    )
    wins = long.groupBy(F.col("m.method").alias("method")).agg(
        F.count_if(F.col("m.recall") > F.col(base[0])).alias("wins_over_global"),
        F.count_if(F.col("m.recall") > F.col(base[1])).alias("wins_over_neighbor"),
    )
    lows = low.select(
        F.coalesce(F.greatest(*base), F.lit(0.0)).alias("best_baseline_low_support"),
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("method"), F.coalesce(F.col(m), F.lit(0.0)).alias("low")) for m in learned])
        ).alias("m"),
    ).select(F.col("m.method").alias("method"), F.col("m.low").alias("low_support"), "best_baseline_low_support")
    half = -(-quarters // 2)
    return wins.join(lows, "method").withColumn(
        "qualifies",
        (F.col("wins_over_global") >= half)
        & (F.col("wins_over_neighbor") >= half)
        & (F.col("low_support") >= F.col("best_baseline_low_support")),
    )


def m_gate(spark, root):
    """Gate rule applied with a support-weighted popularity variant in the learned role.

    The learned rankers have no SQL form, so the rule itself is checked on a
    candidate scorer that both engines can express: recent prevalence.
    """
    s = _study(spark, root)
    recent = s.problem_state(EVALUATION).select("q", "problem", F.col("recent_products").cast("double").alias("score"))
    ranks = s.baseline_ranks(EVALUATION).unionByName(s.problem_score_ranks(recent, "recent_prevalence", EVALUATION))
    entities = s.product_metrics(ranks, EVALUATION).filter(F.col("q") >= WINDOW.test)
    by_q = s.threshold_metrics(entities, ["method", "q"]).filter("slice = '>=1'")
    low = s.threshold_metrics(entities, ["method"]).filter("slice = '1-9'")
    return _rounded(
        gate_decision(
            by_q.select("method", "q", F.col("micro_recall_at_10").alias("recall")),
            low.select("method", F.col("micro_recall_at_10").alias("recall")),
            ["recent_prevalence"],
            8,
        )
    )


def m_prediction_rows(spark, root):
    s = _study(spark, root)
    near = s.neighbor_scores(EVALUATION)
    scored = (
        s.candidates(EVALUATION)
        .join(near, ["q", "product", "problem"], "left")
        .select("q", "product", "problem", F.coalesce("neighbor_count", F.lit(0)).alias("score"))
    )
    rows = s.prediction_rows(scored).join(s.supports(EVALUATION), ["product", "q"])
    return _labelled(
        rows.select(
            "q", "product", "problem", F.col("label").cast("long").alias("label"), "score",
            F.col("copy").cast("long").alias("copy"), "history_support", "candidate_count",
        )
    )


def bands(spark, root):
    s = _study(spark, root)
    reports_per_product = s.product_quarter.groupBy("product").agg(F.sum("n_reports").alias("n"))
    return reports_per_product.groupBy(support_band(F.col("n")).alias("band")).agg(F.count("*").alias("products"))


QUERIES = {
    name: fn
    for name, fn in globals().items()
    if callable(fn) and (name.startswith("m_") or name in ("quarter_bucket", "nearest_prefix_parent", "bands"))
}
