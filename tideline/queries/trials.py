"""Trial-result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.encode import fit_encoder, moments
from tideline.operators.metrics import average_precision
from tideline.plans.trials import CATEGORICAL, COHORT, ENTITY_TYPES, HISTORY, NUMERIC, TrialStudy
from tideline.queries.prescriber import rounded
from tideline.sources import bindings


def _study(spark, root) -> TrialStudy:
    return TrialStudy.bound(spark, root)


def t_sources(spark, root):
    s = _study(spark, root)
    return s.raw.groupBy("snapshot").agg(F.count("*").alias("studies"), F.count_if(F.col("results_date") != "").alias("with_results"))


def t_studies(spark, root):
    return _study(spark, root).at_origins.select("origin", "nct_id", "completion", "result", "enrollment", F.col("age").cast("long").alias("age"))


def _flawed(spark, root) -> TrialStudy:
    s = TrialStudy.bound(spark, root)
    return TrialStudy(bindings.flawed_trial_studies(spark, root), s.raw_designs, s.raw_relations, s.snapshots, strict=False)


def t_quarantine(spark, root):
    """Broken values and repeated ids of flawed study rows."""
    s = _flawed(spark, root)
    repeated = s.repeated_studies().select(F.lit("repeated_id").alias("problem"), "nct_id")
    return s.quarantine().select("problem", "nct_id").unionByName(repeated).groupBy("problem").agg(
        F.count("*").alias("n"), F.countDistinct("nct_id").alias("studies")
    )


def t_flawed_studies(spark, root):
    """What stays of the flawed rows when broken ones are left out."""
    return _flawed(spark, root).studies.select("nct_id", "completion", "result", "enrollment", "number_of_arms", "is_fda_regulated_drug", F.col("age").cast("long").alias("age"))


def t_eligible(spark, root):
    return _study(spark, root).eligible.select("origin", "nct_id")


def t_cohort(spark, root):
    return TrialStudy.bound(spark, root, COHORT).cohort.select("origin", "nct_id")


def t_design_conflicts(spark, root):
    """Conflicts among the amended design rows that can be read at each origin."""
    s = _study(spark, root)
    amended = TrialStudy(s.raw, bindings.amended_trial_designs(spark, root), s.raw_relations, s.snapshots)
    return amended.design_conflicts()


def t_relations(spark, root):
    return _study(spark, root).relation_counts()


def t_entity_history(spark, root):
    rows = _study(spark, root).target_history
    return rounded(rows.select("origin", "nct_id", "entity_type", *HISTORY))


def t_context(spark, root):
    return rounded(_study(spark, root).context())


def t_coverage(spark, root):
    return rounded(_study(spark, root).coverage())


def t_labels(spark, root):
    return _study(spark, root).labelled().select("origin", "nct_id", "posted", "status", "label")


def t_label_audit(spark, root):
    return _study(spark, root).label_audit()


def t_local_features(spark, root):
    return rounded(_study(spark, root).local_features())


def t_examples(spark, root):
    s = _study(spark, root)
    return rounded(s.examples.select("origin", "nct_id", "label", *[f"{e}_{h}" for e in ENTITY_TYPES for h in HISTORY]))


def t_encode(spark, root):
    """All encoded entries (categories, z-scores, missing flags) of held-out rows under the encoder of the earlier origins."""
    s = _study(spark, root)
    at = F.lit(bindings.TRIAL_VALIDATION).cast("date")
    rows = s.examples.select("origin", "nct_id", *CATEGORICAL, *NUMERIC)
    train = rows.filter(F.col("origin") < at)
    encoder = fit_encoder(train, CATEGORICAL, NUMERIC)
    encoded = encoder.encode(rows.filter(F.col("origin") == at), ["nct_id"], [])
    return rounded(encoder.table(encoded, ["nct_id"], moments(train, NUMERIC)))


def _history_scores(spark, root):
    """Labelled targets scored by three timely shares (undefined shares score 0)."""
    s = _study(spark, root)
    return s.examples.select(
        "origin", "nct_id", "label",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.coalesce(F.col(c), F.lit(0.0)).alias("score"))
                    for m, c in (("sponsor", "sponsor_timely_fraction"), ("facility", "facility_timely_fraction"), ("condition", "condition_timely_fraction"))
                ]
            )
        ).alias("m"),
    ).select("origin", "nct_id", "label", "m.*")


def metric_deltas(ap, base: str):
    """(origin, model, delta): each model's metric minus the base model's; NULL if either is undefined."""
    left = ap.filter(F.col("model") == base).select("origin", F.col("average_precision").alias("b"))
    return ap.filter(F.col("model") != base).join(left, "origin").select(
        "origin", "model", (F.col("average_precision") - F.col("b")).alias("delta")
    )


def stability_summary(deltas):
    """Across origins: how many deltas are defined, positive, non-negative, and their spread."""
    d = F.col("delta")
    return deltas.groupBy("model").agg(
        F.count("*").alias("origins"),
        F.count(d).alias("defined_origins"),
        F.count_if(d > 0).alias("positive_origins"),
        F.count_if(d >= 0).alias("nonnegative_origins"),
        F.coalesce((F.count(d) == F.count("*")) & F.bool_and(d > 0), F.lit(False)).alias("strictly_positive_all"),
        F.avg(d).alias("mean_delta"),
        F.median(d).alias("median_delta"),
        F.min(d).alias("minimum_delta"),
        F.max(d).alias("maximum_delta"),
    )


def t_metric_deltas(spark, root):
    ap = average_precision(_history_scores(spark, root), ["origin", "model"], "label", "score", ["nct_id"])
    return rounded(metric_deltas(ap, "sponsor"))


def t_stability_summary(spark, root):
    ap = average_precision(_history_scores(spark, root), ["origin", "model"], "label", "score", ["nct_id"])
    return rounded(stability_summary(metric_deltas(ap, "sponsor")))


QUERIES = {n: f for n, f in globals().items() if callable(f) and n.startswith("t_")}
