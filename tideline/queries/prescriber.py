"""Prescriber-drug queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.functions.scalar import claims_error, cost_error, flag_error, npi_error, number_error
from tideline.plans.prescriber import COHORT, FEATURES, PrescriberStudy, hash_cohort
from tideline.session import cut
from tideline.sources import bindings, sinks

MODEL_TARGETS = [2000, 2001]
HEURISTICS = ["global_popularity", "specialty_popularity", "history_overlap"]
MODEL_HEURISTICS = HEURISTICS[1:]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _flat(df: DataFrame) -> DataFrame:
    """Replace the drug struct by its fields."""
    names = df.schema["drug"].dataType.names
    return df.select(*[c for c in df.columns if c != "drug"], *[F.col(f"drug.{n}").alias(n) for n in names])


def _study(spark, root) -> PrescriberStudy:
    return PrescriberStudy.bound(spark, root)


def p_edges(spark, root):
    return _study(spark, root).edges


def _from_files(spark, root) -> PrescriberStudy:
    """The study read back from annual CSV files, checked against the counts recorded when they were written."""
    paths, audit = bindings.prescriber_files(spark, root)
    s = PrescriberStudy.from_files(spark, paths)
    sinks.require_counts(s.rows, audit, "year")
    return s


def p_edge_export(spark, root):
    return _from_files(spark, root).export()


def p_edge_audit(spark, root):
    """Recorded and found edges of every year; a year of which the last row is lost, and one that was not recorded."""
    paths, audit = bindings.prescriber_files(spark, root)
    rows = PrescriberStudy.from_files(spark, paths).rows
    last = rows.filter("year = 1999").agg(F.max("source_row")).first()[0]
    damaged = rows.filter((F.col("year") != 1999) | (F.col("source_row") < last))
    return sinks.count_mismatches(damaged, audit.filter("year <> 2000"), "year").unionByName(sinks.count_mismatches(rows, audit, "year"))


def p_edge_constraints(spark, root):
    """Counts of every violated edge rule; all zero on sound edges."""
    s = _study(spark, root)
    return sinks.edge_violations(s.export(), s.cohort)


def dup_keys(spark, root):
    """Duplicate (order, line) keys of the raw item table, the driver data's own duplicates."""
    rows = bindings.table(spark, root, "lineitem")
    return sinks.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


def p_rankings_read(spark, root):
    """Nested ranking records written as JSON text, read back and flattened."""
    s = _study(spark, root)
    records = sinks.nested_rankings(s, "generic", MODEL_TARGETS, MODEL_HEURISTICS)
    return sinks.read_rankings(records).select("year", "npi", "method", "generic", "rank")


def p_rankings_nested(spark, root):
    return sinks.nested_rankings(_study(spark, root), "generic", MODEL_TARGETS, MODEL_HEURISTICS)


def hash_cohort_query(spark, root):
    ids = bindings.table(spark, root, "orders").select(F.col("o_custkey").cast("string").alias("id"))
    return hash_cohort(ids, "id", 100)


def p_dynamic_cohort(spark, root):
    return PrescriberStudy.bound(spark, root, COHORT).cohorts


def p_union_cohort(spark, root):
    return PrescriberStudy.bound(spark, root, COHORT).cohort


def cohort_disappeared(spark, root):
    """(year, npi): cohort members with no row in a year (set difference per year)."""
    s = _study(spark, root)
    years = F.explode(F.array(*[F.lit(y).cast("long") for y in s.years]))
    every = s.cohort.select(years.alias("year"), "npi")
    return every.join(s.edges.select("year", "npi").distinct(), ["year", "npi"], "left_anti")


def _projection(spark, root, kind):
    rows = _study(spark, root).projected(kind)
    return _flat(rows.withColumn("specialties", F.array_join("specialties", ",")))


def p_project_generic(spark, root):
    return _projection(spark, root, "generic")


def p_project_variant(spark, root):
    return _projection(spark, root, "variant")


def p_history(spark, root):
    s = _study(spark, root)
    return _flat(s.drug_state(s.before("variant", s.score_years)))


def p_latest_specialty(spark, root):
    s = _study(spark, root)
    return s.provider_state(s.before("variant", s.score_years))


def p_specialty_support(spark, root):
    s = _study(spark, root)
    return _flat(s.specialty_support(s.before("variant", s.score_years)))


def p_candidates(spark, root):
    s = _study(spark, root)
    return _flat(s.candidates(s.before("variant", s.score_years)).select("target", "npi", "drug"))


def p_positives(spark, root):
    s = _study(spark, root)
    return _flat(s.positives("variant", s.before("variant", s.score_years), s.score_years))


def p_history_overlap(spark, root):
    s = _study(spark, root)
    return rounded(_flat(s.overlap_scores(s.before("generic", MODEL_TARGETS))))


def _ranked(s: PrescriberStudy, kind: str, targets: list[int], methods: list[str]):
    history = s.before(kind, targets)
    return s.heuristic_ranks(history, s.positives(kind, history, targets), methods)


def p_rank_specialty(spark, root):
    s = _study(spark, root)
    return _flat(_ranked(s, "generic", MODEL_TARGETS, ["specialty_popularity"]))


def p_rank_metrics(spark, root):
    s = _study(spark, root)
    entities = s.provider_metrics(_ranked(s, "variant", s.score_years, HEURISTICS), banded=True)
    return rounded(s.pooled(entities, ["method", "band"]))


def p_paired_recall(spark, root):
    s = _study(spark, root)
    entities = s.provider_metrics(_ranked(s, "variant", s.score_years, HEURISTICS))
    return rounded(s.paired_recall(entities, "global_popularity"))


def p_identity_sensitivity(spark, root):
    """Variant minus generic for every pooled metric, by method and scope."""
    s = _study(spark, root)
    names = ["micro_recall_at_5", "micro_recall_at_10", "micro_recall_at_20", "mrr"]
    both = {
        kind: s.pooled(s.provider_metrics(_ranked(s, kind, MODEL_TARGETS, MODEL_HEURISTICS)), ["method"])
        for kind in ("generic", "variant")
    }
    left = both["generic"].select("method", "scope", *[F.col(n).alias(f"g_{n}") for n in names])
    return rounded(
        both["variant"].join(left, ["method", "scope"]).select(
            "method", "scope", *[(F.col(n) - F.col(f"g_{n}")).alias(n) for n in names]
        )
    )


def p_top20(spark, root):
    s = _study(spark, root)
    scored = s.heuristic_scores(s.before("generic", MODEL_TARGETS))
    top = s.top_recommendations(scored, MODEL_HEURISTICS)
    return rounded(_flat(top.select("method", "target", "npi", "drug", "score", F.col("rank").cast("long").alias("rank"))))


def p_high_score_threshold(spark, root):
    s = _study(spark, root)
    scored = s.heuristic_scores(s.before("generic", MODEL_TARGETS))
    return rounded(s.high_score_thresholds(scored, MODEL_HEURISTICS))


def p_all_provider_metrics(spark, root):
    s = _study(spark, root)
    history = s.before("generic", MODEL_TARGETS)
    scored = s.heuristic_scores(history).transform(cut)
    return rounded(
        s.load_metrics(
            s.top_recommendations(scored, MODEL_HEURISTICS),
            s.positives("generic", history, MODEL_TARGETS),
            history,
            scored.select("target", "npi", "drug"),
            s.high_score_thresholds(scored, MODEL_HEURISTICS),
            MODEL_TARGETS,
        )
    )


def p_training_rows(spark, root):
    s = _study(spark, root)
    rows = s.training_rows(s.before("generic", MODEL_TARGETS))
    return _flat(rows.select("target", "npi", "drug", F.col("label").cast("long").alias("label")))


def p_features(spark, root):
    s = _study(spark, root)
    rows = s.features(s.training_rows(s.before("generic", MODEL_TARGETS)))
    return rounded(_flat(rows.select("target", "npi", "drug", *FEATURES)))


def p_annual_audit(spark, root):
    return _study(spark, root).annual_audit()


def p_claim_bands(spark, root):
    s = _study(spark, root)
    return s.claim_bands(s.positives("variant", s.before("variant", s.score_years), s.score_years))


def p_year_jaccard(spark, root):
    return rounded(_study(spark, root).year_overlap())


def p_coverage(spark, root):
    return _study(spark, root).coverage()


def p_identity_diag(spark, root):
    return _study(spark, root).identity_diagnostics()


def typed_validation(spark, root):
    """How many values of deliberately damaged text columns each typed rule rejects."""
    li = bindings.table(spark, root, "lineitem")
    n = F.col("l_linenumber")
    key = F.lpad(F.col("l_orderkey").cast("string"), 10, "0")
    text = li.select(
        F.when(n == 1, F.concat(F.lit("X"), F.substring(key, 2, 9))).when(n == 2, F.substring(key, 1, 9)).otherwise(key).alias("npi"),
        F.when(n == 3, F.lit("-5")).otherwise(F.col("l_quantity").cast("long").cast("string")).alias("claims"),
        F.when(n == 4, F.lit("NaN")).when(n == 5, F.lit("")).when(n == 6, F.lit("-1.5")).otherwise(F.lit("12.50")).alias("cost"),
        F.when(n == 1, F.lit("1,234.5")).when(n == 2, F.lit("abc")).when(n == 3, F.lit(" ")).otherwise(F.lit("7")).alias("number"),
        F.when(n == 1, F.lit("T")).when(n == 2, F.lit("maybe")).when(n == 3, F.lit("")).otherwise(F.lit("No")).alias("flag"),
    )
    return text.agg(
        F.count_if(npi_error(F.col("npi"))).alias("bad_npi"),
        F.count_if(claims_error(F.col("claims"))).alias("bad_claims"),
        F.count_if(cost_error(F.col("cost"))).alias("bad_cost"),
        F.count_if(number_error(F.col("number"))).alias("bad_number"),
        F.count_if(flag_error(F.col("flag"))).alias("bad_flag"),
    )


QUERIES = {n: f for n, f in globals().items() if callable(f) and n.startswith("p_")}
QUERIES |= {
    "dup_keys": dup_keys,
    "hash_cohort": hash_cohort_query,
    "cohort_disappeared": cohort_disappeared,
    "typed_validation": typed_validation,
}
