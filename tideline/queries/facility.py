"""Facility-inspection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalar import SERIOUS_CODES, flexible_date, normalize_name, owner_token, stable_hex, stable_modulo60
from tideline.operators.metrics import classification_metrics
from tideline.plans.facility import BASE_FEATURES, GRAPH_FEATURES, FacilityStudy, neighbor_mean, standard_episodes
from tideline.queries.prescriber import rounded
from tideline.sources import bindings, records


def _study(spark, root) -> FacilityStudy:
    return FacilityStudy.bound(spark, root)


def c_sources(spark, root):
    """Row counts and distinct facilities of the six study inputs."""
    s = _study(spark, root)
    inputs = {
        "inspections": s.inspections.select("ccn"),
        "providers": s.providers.select("ccn"),
        "owners": s.owner_records.select("ccn"),
        "filings": s.filings.select("ccn"),
        "filing_owners": s.filing_owners.select(F.col("enrollment").alias("ccn")),
        "serious": s.inspections.filter("serious = 1").select("ccn"),
    }
    out = None
    for name, df in inputs.items():
        row = df.agg(F.lit(name).alias("source"), F.count("*").alias("n_rows"), F.countDistinct("ccn").alias("keys"))
        out = row if out is None else out.unionByName(row)
    return out


def json_records(spark, root):
    """Order records wrapped as JSON text in each accepted shape, one document per order day, read back."""
    orders = bindings.table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("ccn"), F.to_date("o_orderdate").alias("d")
    )
    docs = orders.groupBy("d").agg(F.to_json(F.collect_list(F.struct("id", "ccn"))).alias("a"))
    shape = F.day("d") % 4
    value = (
        F.when(shape == 0, F.col("a"))
        .when(shape == 1, F.concat(F.lit('{"data":'), "a", F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"results":'), "a", F.lit("}")))
        .otherwise(F.concat(F.lit('{"records":'), "a", F.lit("}")))
    )
    return records.json_records(docs.select(value.alias("value")), "struct<id:bigint,ccn:string>")


def c_episodes(spark, root):
    """Standard inspections with the serious flag from severity letters."""
    rows = bindings.table(spark, root, "orders").select(
        F.col("o_custkey").cast("string").alias("ccn"),
        F.to_date("o_orderdate").alias("day"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "G").when(F.col("o_orderpriority") == "2-HIGH", "F").otherwise("D").alias("severity"),
    )
    return rows.groupBy("ccn", "day").agg(F.max(F.col("severity").isin(*SERIOUS_CODES).cast("long")).alias("serious"))


def c_survey_episodes(spark, root):
    """Standard inspections and their serious citations from raw survey and citation rows."""
    orders = bindings.table(spark, root, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("ccn"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("date"), "o_orderstatus")
    kind = F.when(F.col("o_orderstatus") == "P", "Fire Safety").when(F.col("o_orderkey") % 3 == 0, "Health Complaint").otherwise(" Health Standard ")
    date = F.when(F.col("o_orderkey") % 41 == 0, "soon").otherwise(F.col("date"))
    surveys = orders.select(F.when(F.col("o_orderkey") % 37 == 0, " ").otherwise(F.col("ccn")).alias("ccn"), date.alias("date"), kind.alias("survey_type"))
    lines = bindings.table(spark, root, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    citations = lines.select(
        "ccn", "date", F.when(F.col("l_linenumber") % 3 == 0, "Fire Safety").otherwise("Health").alias("survey_type"),
        F.when(F.col("l_returnflag") == "N", "Y").otherwise("N").alias("standard"), F.substring(F.lit("ABCDEFGHIJKL"), (F.col("l_quantity") % 12).cast("int") + 1, F.lit(1)).alias("severity"),
    )
    return standard_episodes(surveys, citations)


def date_parse(spark, root):
    """Association dates rendered in several text forms and parsed back."""
    days = bindings.table(spark, root, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_linenumber")
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, F.date_format("d", "'since 'MM/dd/yyyy"))
        .when(n == 2, F.date_format("d", "M/d/yyyy"))
        .when(n == 3, F.date_format("d", "yyyy-MM-dd"))
        .when(n == 4, F.concat(F.lit("13/45/"), F.year("d").cast("string")))
        .when(n == 5, F.lit(""))
        .when(n == 6, F.lit("unknown"))
        .otherwise(F.date_format("d", "' 'MM/dd/yyyy' '"))
    )
    return days.select(flexible_date(text).alias("parsed")).groupBy("parsed").agg(F.count("*").alias("n"))


def owner_token_query(spark, root):
    rows = bindings.table(spark, root, "supplier")
    kind = F.when(F.col("s_suppkey") % 2 == 0, F.lit("Individual")).otherwise(F.lit("Organization"))
    return rows.select(F.col("s_suppkey"), owner_token(kind, F.col("s_name")).alias("token"))


def normalize_entity(spark, root):
    docs = bindings.table(spark, root, "part")
    text = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t "), F.col("p_type"), F.lit(" "))
    return docs.select(normalize_name(text).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def stable_hash(spark, root):
    rows = bindings.table(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    return rows.select(
        "o_orderkey",
        stable_hex("2000Q1", F.col("o_orderkey"), F.col("o_orderstatus")).alias("hex"),
        stable_modulo60(F.lit(997), "2000Q1", F.col("o_orderkey"), F.col("o_orderstatus")).alias("slot"),
    )


def c_owner_assoc(spark, root):
    return _study(spark, root).current_owners


def c_first_assoc(spark, root):
    return _study(spark, root).attachments


def c_chow_owners(spark, root):
    return _study(spark, root).change_owners.distinct()


def c_combined_owners(spark, root):
    return _study(spark, root).combined_owners.distinct()


def c_history(spark, root):
    return _study(spark, root).histories.drop("dn", "serious")


def c_chow_counts(spark, root):
    return _study(spark, root).change_counts()


def c_peer_stats(spark, root):
    return _study(spark, root).peer_stats()


def c_features(spark, root):
    s = _study(spark, root)
    rows = s.features(s.local_rows, graph=False).select("ccn", "day", "state", "label", *BASE_FEATURES)
    return rounded(rows)


def c_graph_features(spark, root):
    s = _study(spark, root)
    return rounded(s.features(s.model_rows).select("ccn", "day", *GRAPH_FEATURES))


def c_prevalence(spark, root):
    rows = _study(spark, root).prevalence_predictions()
    return rounded(rows.select("year", "ccn", "day", "label", "score"))


def c_baseline_metrics(spark, root):
    """Annual metrics of the prevalence and last-serious-rate scores, ties by date then facility."""
    s = _study(spark, root)
    base = s.prevalence_predictions()
    both = base.select("year", "ccn", "day", "label", F.lit("prevalence").alias("method"), "score").unionByName(
        base.select("year", "ccn", "day", "label", F.lit("prior_rate").alias("method"), F.col("prior_serious_rate").alias("score"))
    )
    return rounded(classification_metrics(both, ["method", "year"], "label", "score", ["day", "ccn"]))


def owner_projection(spark, root):
    return _study(spark, root).topology("1996-01-01")


def neighbor_mean_query(spark, root):
    """Neighbour mean of the customer balance, standardised on facilities with an even number."""
    values = bindings.table(spark, root, "customer").select(
        F.col("c_custkey").cast("string").alias("entity"), F.col("c_acctbal").alias("x")
    )
    pairs = _study(spark, root).topology("1996-01-01", values)
    return rounded(neighbor_mean(pairs, F.col("entity").cast("long") % 2 == 0), 5)


QUERIES = {n: f for n, f in globals().items() if callable(f) and n.startswith("c_")}
QUERIES |= {
    "json_records": json_records,
    "date_parse": date_parse,
    "owner_token": owner_token_query,
    "normalize_entity": normalize_entity,
    "stable_hash": stable_hash,
    "owner_projection": owner_projection,
    "neighbor_mean": neighbor_mean_query,
}
