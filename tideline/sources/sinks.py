"""Edge constraints, canonical JSON records and write-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def edge_violations(edges: DataFrame, cohort: DataFrame) -> DataFrame:
    """(rule, violations) for duplicate keys, blank drugs, low claims, bad ids, bad cost, foreign providers."""
    duplicates = duplicate_keys(edges, ["npi", "brand_name", "generic_name", "year"]).agg(
        F.lit("duplicate_key").alias("rule"), F.count("*").alias("violations")
    )
    cost = F.col("cost").try_cast("decimal(20,2)")
    rules = {
        "blank_drug": (F.col("brand_name") == "") & (F.col("generic_name") == ""),
        "low_claims": F.col("claims") < 11,
        "bad_npi": ~F.col("npi").rlike("^[0-9]{10}$"),
        "bad_cost": (F.col("cost") != "") & (cost.isNull() | (cost < 0)),
        "bad_validity": F.add_months("valid_from", 12) != F.col("valid_to"),
    }
    scan = edges.agg(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.count_if(c).alias("violations")) for r, c in rules.items()]).alias("r")
    )
    foreign = edges.join(cohort, "npi", "left_anti").agg(
        F.lit("outside_cohort").alias("rule"), F.count("*").alias("violations")
    )
    return duplicates.unionByName(scan.select(F.inline("r"))).unionByName(foreign)


def count_audit(rows: DataFrame, by: str) -> DataFrame:
    """(by, recorded): the counts that a later read is held against."""
    return rows.groupBy(by).agg(F.count("*").alias("recorded"))


def count_mismatches(rows: DataFrame, audit: DataFrame, by: str) -> DataFrame:
    """(by, recorded, found) where a recorded count and the rows differ; a side without the key counts 0."""
    found = rows.groupBy(by).agg(F.count("*").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return audit.join(found, by, "full_outer").select(by, zero("recorded"), zero("found")).filter("recorded <> found")


def require_counts(rows: DataFrame, audit: DataFrame, by: str) -> None:
    """Raise unless every recorded count is met; reads a few of the differing rows."""
    bad = count_mismatches(rows, audit, by).orderBy(by).limit(3).collect()
    if bad:
        raise ValueError(f"row counts differ from the audit: {[tuple(r) for r in bad]}")


def require_no_violations(violations: DataFrame) -> None:
    """Raise with the violated rules; reads one row per rule."""
    bad = {r["rule"]: r["violations"] for r in violations.filter("violations > 0").collect()}
    if bad:
        raise ValueError(f"edge constraints violated: {bad}")


def check_header(found: list[str], expected: list[str], required: list[str], source: str) -> None:
    missing = [c for c in required if c not in found]
    if missing or list(found) != list(expected):
        raise ValueError(f"unexpected header in {source}: missing {missing}, found {found}")


def canonical_json(df: DataFrame, column: str = "value") -> DataFrame:
    """One JSON text per row with keys in name order; nulls kept, no spaces."""
    fields = sorted(df.columns)
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(column))


def write_once_json(df: DataFrame, path: str, order: list[str]) -> None:
    """Ordered canonical JSON lines; an existing path is an error."""
    ordered = df.orderBy(*order)
    canonical_json(ordered).write.mode("errorifexists").text(path)


def write_once_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("errorifexists").option("header", "true").csv(path)


def nested_rankings(study, kind: str, targets: list[int], methods: list[str]) -> DataFrame:
    """One record per (year, npi): positives with their ranks and the top recommendations per method."""
    history = study.before(kind, targets)
    scored = study.heuristic_scores(history)
    positives = study.positives(kind, history, targets)
    ranked = study.ranked_positives(scored, positives, methods)
    return nest(ranked, study.top_recommendations(scored, methods), kind)


def nest(ranked: DataFrame, top: DataFrame, kind: str) -> DataFrame:
    """Nest ranked positives and top recommendations under (representation, year, npi)."""
    per_drug = ranked.groupBy("target", "npi", "drug").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "rank")))).alias("ranks")
    )
    pos = per_drug.groupBy("target", "npi").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("drug", F.to_json("ranks").alias("ranks"))))).alias("positives")
    )
    best = top.groupBy("target", "npi", "method").agg(
        F.sort_array(F.collect_list(F.struct("rank", "drug", F.round("score", 12).alias("score")))).alias("best")
    )
    recs = best.groupBy("target", "npi").agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", F.to_json("best").alias("best")))))).alias("recommendations")
    )
    return recs.join(pos, ["target", "npi"], "left").select(
        F.lit(kind).alias("representation"), F.col("target").alias("year"), "npi", "positives", "recommendations"
    )


def read_rankings(records: DataFrame, kind: str = "generic") -> DataFrame:
    """Flatten nested records to (year, npi, method, generic, rank) of the recommendations."""
    lists = records.filter(F.col("representation") == kind).select(
        "year", "npi", F.explode(F.from_json("recommendations", "map<string,string>")).alias("method", "best")
    )
    item = "array<struct<rank:bigint,drug:struct<generic:string>,score:double>>"
    return lists.select("year", "npi", "method", F.explode(F.from_json("best", item)).alias("r")).select(
        "year", "npi", "method", F.col("r.drug.generic").alias("generic"), F.col("r.rank").alias("rank"), F.col("r.score").alias("score")
    )
