"""Bindings from the relational tables to the inputs of the four study pipelines.

* device reports: order = report, supplier = product, part brand|size = problem
* facilities: customer = facility, order day = inspection, supplier = owner
* prescribers: customer = prescriber, brand = generic name, type = brand name
* trials: order = trial, order date = completion, last ship date = result posting
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions.scalar import quarter_of_date
from tideline.session import checkpoint_root, cut
from tideline.sources import sinks


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def _day(name: str):
    return F.col(name).cast("date")


# ---------------------------------------------------------------- device reports


@dataclass(frozen=True)
class DeviceWindow:
    """Quarter ordinals of the retained window and its temporal split."""

    first: int = 1995 * 4
    last: int = 2001 * 4 + 3
    validation: int = 1999 * 4
    test: int = 2000 * 4
    refits: tuple[int, ...] = (1999 * 4, 2000 * 4, 2001 * 4)

    @property
    def evaluation(self) -> list[int]:
        return list(range(self.validation, self.last + 1))


def device_rows(spark: SparkSession, root: str) -> DataFrame:
    """(key, quarter, product, manufacturer), one row per reported device."""
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    makers = (
        table(spark, root, "orders")
        .select("o_orderkey", "o_custkey")
        .join(
            table(spark, root, "customer").select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        .select("o_orderkey", F.col("c_nationkey").cast("string").alias("manufacturer"))
    )
    quarter = quarter_of_date(_day("l_shipdate"))
    window = DeviceWindow()
    return (
        lines.withColumn("quarter", quarter.cast("int"))
        .filter(F.col("quarter").between(window.first, window.last))
        .join(makers, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("l_orderkey").alias("key"),
            "quarter",
            F.col("l_suppkey").cast("string").alias("product"),
            F.coalesce("manufacturer", F.lit("")).alias("manufacturer"),
        )
    )


def problem_rows(spark: SparkSession, root: str) -> DataFrame:
    """(key, problem), one row per coded problem."""
    parts = table(spark, root, "part").select(
        "p_partkey",
        F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("problem"),
    )
    return (
        table(spark, root, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("key"), "problem")
    )


def problem_parents(spark: SparkSession, root: str) -> DataFrame:
    """(problem, parent): the brand part of the problem code."""
    return (
        table(spark, root, "part")
        .select(
            F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("problem"),
            F.col("p_brand").alias("parent"),
        )
        .distinct()
    )


def raw_device_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, line_no, value): pipe-delimited device lines derived from the item table.

    A fixed share of lines is damaged by rule so every parse status occurs:
    blank line, non-digit key, wrong width, date out of window, sentinel product.
    """
    lines = table(spark, root, "lineitem")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, root, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    key = F.col("l_orderkey").cast("string")
    day = F.date_format(_day("l_shipdate"), "yyyy/MM/dd")
    date_text = F.when(F.col("l_discount") == 0.01, F.lit("2031/01/01")).otherwise(day)
    product = F.when(F.col("l_tax") == 0.08, F.lit(" NA ")).otherwise(F.col("l_suppkey").cast("string"))
    maker = F.concat(F.lit(" "), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("")))
    fields = [F.lit("x")] * 34
    fields[0] = F.when(F.col("l_quantity") == 1, F.concat(F.lit("K"), key)).otherwise(key)
    fields[8], fields[11], fields[28] = date_text, maker, product
    full = F.concat_ws("|", *fields)
    value = F.when(F.col("l_quantity") == 2, F.lit("")).when(
        F.col("l_quantity") == 3, F.concat(full, F.lit("|extra"))
    ).otherwise(full)
    return joined.select(
        F.year(_day("l_shipdate")).cast("string").alias("file"),
        F.col("l_linenumber").cast("long").alias("split"),
        F.struct("l_partkey", "l_orderkey").alias("position"),
        value.alias("value"),
    )


def raw_problem_lines(spark: SparkSession, root: str) -> DataFrame:
    parts = table(spark, root, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("code")
    )
    joined = table(spark, root, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    code = F.when(F.col("l_tax") == 0.08, F.lit(" UNK")).when(F.col("l_tax") == 0.07, F.lit(" ")).otherwise(
        F.concat(F.lit(" "), F.col("code"))
    )
    key = F.col("l_orderkey").cast("string")
    value = (
        F.when(F.col("l_quantity") == 1, F.lit(""))
        .when(F.col("l_quantity") == 2, F.concat(F.lit("x"), key, F.lit("|"), code))
        .when(F.col("l_quantity") == 3, F.concat(key, F.lit("|"), code, F.lit("|z")))
        .otherwise(F.concat(key, F.lit("|"), code))
    )
    return joined.select(value.alias("value"))


# ---------------------------------------------------------------- prescribers


def prescriber_rows(spark: SparkSession, root: str) -> DataFrame:
    """(year, npi, brand, generic, claims, cost, specialty, state), one row per annual pair."""
    orders = table(spark, root, "orders").select(
        "o_orderkey", "o_custkey", F.year(_day("o_orderdate")).alias("year")
    )
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    parts = table(spark, root, "part").select("p_partkey", "p_brand", "p_type")
    sales = (
        lines.join(orders.filter(F.col("year").between(1996, 2001)), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey", "year", "p_brand", "p_type")
        .agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("cost"))
    )
    people = (
        table(spark, root, "customer")
        .join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(""))
            .otherwise(F.col("c_mktsegment"))
            .alias("specialty"),
            F.col("n_name").alias("state"),
        )
    )
    return sales.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("year").cast("long").alias("year"),
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("npi"),
        F.col("p_type").alias("brand"),
        F.col("p_brand").alias("generic"),
        (F.col("n") + 10).alias("claims"),
        F.round("cost", 2).alias("cost"),
        "specialty",
        "state",
    )


def prescriber_files(spark: SparkSession, root: str) -> tuple[dict[int, str], DataFrame]:
    """The annual rows as CSV files sorted by key, one folder for each year, and the audit (year, recorded) of what was written."""
    rows = cut(prescriber_rows(spark, root))
    folder = f"{checkpoint_root(spark)}/annual-{uuid.uuid4().hex}"
    keys = ["npi", "brand", "generic"]
    paths = {}
    for year in range(1996, 2002):
        paths[year] = f"{folder}/year={year}"
        text = rows.filter(F.col("year") == year).repartitionByRange(*keys).sortWithinPartitions(*keys)
        text.select(*keys, *[F.col(c).cast("string").alias(c) for c in ("claims", "cost", "specialty", "state")]).write.csv(paths[year], header=True, emptyValue="", escape='"')
    return paths, sinks.count_audit(rows, "year")


# ---------------------------------------------------------------- facilities


def inspections(spark: SparkSession, root: str) -> DataFrame:
    """(ccn, day, serious): one row per distinct standard inspection."""
    return (
        table(spark, root, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("ccn"), _day("o_orderdate").alias("day"))
        .agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("serious"))
    )


def providers(spark: SparkSession, root: str) -> DataFrame:
    """(ccn, state, approval, provider_type)."""
    return table(spark, root, "customer").select(
        F.col("c_custkey").cast("string").alias("ccn"),
        F.col("c_nationkey").cast("string").alias("state"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 1000).cast("int")).alias("approval"),
        F.col("c_mktsegment").alias("provider_type"),
    )


def current_owner_records(spark: SparkSession, root: str) -> DataFrame:
    """(ccn, owner_type, owner_name, role, association) before role filtering."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return (
        table(spark, root, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("role"))
        .agg(F.min(_day("l_shipdate")).alias("association"))
        .select(
            F.col("o_custkey").cast("string").alias("ccn"),
            F.when(F.col("l_suppkey") % 2 == 0, F.lit("Individual"))
            .otherwise(F.lit("Organization"))
            .alias("owner_type"),
            F.concat(F.lit("Owner #"), F.col("l_suppkey").cast("string")).alias("owner_name"),
            "role",
            "association",
        )
    )


# Role of the bound data that plays the excluded-role part.
BOUND_EXCLUDED_ROLES = ("NF",)
# Roles of the bound data that play the change-of-ownership part.
BOUND_CHANGE_ROLES = ("RO", "RF", "AO")


def change_events(spark: SparkSession, root: str) -> DataFrame:
    """(enrollment, ccn, effective, row_no) change-of-ownership filings."""
    return (
        table(spark, root, "orders")
        .filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW"))
        .select(
            F.concat(F.lit("E"), F.floor(F.col("o_orderkey") / 2).cast("long").cast("string")).alias("enrollment"),
            F.col("o_custkey").cast("string").alias("ccn"),
            _day("o_orderdate").alias("effective"),
            F.col("o_orderkey").alias("row_no"),
        )
    )


def change_owner_records(spark: SparkSession, root: str) -> DataFrame:
    """(enrollment, associate, role, association) owners named in filings."""
    return table(spark, root, "lineitem").select(
        F.concat(F.lit("E"), F.floor(F.col("l_orderkey") / 2).cast("long").cast("string")).alias("enrollment"),
        F.col("l_suppkey").cast("string").alias("associate"),
        F.concat("l_returnflag", "l_linestatus").alias("role"),
        _day("l_shipdate").alias("association"),
    )


# ---------------------------------------------------------------- trials

TRIAL_SNAPSHOTS = (
    "1996-01-01",
    "1997-01-01",
    "1998-01-01",
    "1999-01-01",
    "2000-01-01",
    "2001-01-01",
    "2002-01-01",
)
TRIAL_VALIDATION = "2000-01-01"
TRIAL_TEST = "2001-01-01"


def _nct(column: str):
    return F.concat(F.lit("NCT"), F.lpad(F.col(column).cast("string"), 8, "0"))


def trial_studies(spark: SparkSession, root: str) -> DataFrame:
    """Raw study rows per snapshot, all text except the snapshot date.

    A study appears in every snapshot on or after its completion; its result
    date appears only in snapshots on or after that date.
    """
    posted = (
        table(spark, root, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.max(_day("l_shipdate")).alias("last_ship"), F.count("*").alias("arms"))
    )
    base = (
        table(spark, root, "orders")
        .join(posted, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("completion", _day("o_orderdate"))
        .withColumn("result", F.when(F.col("last_ship") >= F.col("completion"), F.col("last_ship")))
        .withColumn("snapshot", F.explode(F.array(*[F.lit(s).cast("date") for s in TRIAL_SNAPSHOTS])))
    )
    key = F.col("o_orderkey")
    return base.select(
        "snapshot",
        _nct("o_orderkey").alias("nct_id"),
        F.when(key % 50 == 0, "Observational").otherwise("Interventional").alias("study_type"),
        F.when(key % 40 == 0, "Estimated").otherwise("Actual").alias("completion_type"),
        F.col("completion").cast("string").alias("completion_date"),
        F.when(F.col("result") <= F.col("snapshot"), F.col("result").cast("string"))
        .otherwise("")
        .alias("results_date"),
        F.when(key % 7 == 0, "")
        .otherwise(F.date_add("completion", (-(key % 900)).cast("int")).cast("string"))
        .alias("start_date"),
        F.when(key % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("phase"),
        F.when(key % 13 == 0, "")
        .otherwise(F.floor("o_totalprice").cast("long").cast("string"))
        .alias("enrollment"),
        F.coalesce(F.col("arms").cast("string"), F.lit("")).alias("number_of_arms"),
        F.lit("").alias("number_of_groups"),
        F.when(key % 3 == 0, "t").when(key % 3 == 1, "f").otherwise("").alias("fda_drug"),
        F.when(key % 5 == 0, "yes").otherwise("no").alias("fda_device"),
    )


def flawed_trial_studies(spark: SparkSession, root: str) -> DataFrame:
    """The study rows of the first snapshot with values that break rules: some ids, dates, numbers and flags, and repeated ids."""
    rows = trial_studies(spark, root).filter(F.col("snapshot") == F.lit(TRIAL_SNAPSHOTS[0]).cast("date"))
    key = F.regexp_extract("nct_id", "([0-9]{8})$", 1).cast("long")
    broken = rows.withColumns(
        {
            "nct_id": F.when(key % 97 == 0, F.concat(F.lit("N"), F.col("nct_id"))).otherwise(F.col("nct_id")),
            "completion_date": F.when(key % 59 == 0, "1995-13-45").otherwise(F.col("completion_date")),
            "enrollment": F.when(key % 61 == 0, "about 12").otherwise(F.col("enrollment")),
            "number_of_arms": F.when(key % 67 == 0, "inf").otherwise(F.col("number_of_arms")),
            "fda_drug": F.when(key % 71 == 0, "maybe").otherwise(F.col("fda_drug")),
        }
    )
    return broken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(key % 89 == 0, 2).otherwise(1)))).drop("_copy")


def trial_designs(spark: SparkSession, root: str) -> DataFrame:
    """(nct_id, allocation, intervention_model, masking, primary_purpose, time_perspective, valid_from, valid_to)."""
    customers = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    return (
        table(spark, root, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            _nct("o_orderkey").alias("nct_id"),
            F.col("o_orderstatus").alias("allocation"),
            F.col("c_mktsegment").alias("intervention_model"),
            F.concat(F.lit("M"), (key % 5).cast("string")).alias("masking"),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("P"), (key % 4).cast("string"))).alias("primary_purpose"),
            F.lit("").alias("time_perspective"),
            _day("o_orderdate").alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
        )
    )


def amended_trial_designs(spark: SparkSession, root: str) -> DataFrame:
    """Design rows of every line of an order, valid for a year from its shipping date; lines of one order may disagree."""
    return table(spark, root, "lineitem").select(
        _nct("l_orderkey").alias("nct_id"),
        F.col("l_returnflag").alias("allocation"),
        F.lit("same").alias("intervention_model"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linestatus")).alias("masking"),
        F.lit("").alias("primary_purpose"),
        (F.col("l_suppkey") % 3).cast("string").alias("time_perspective"),
        _day("l_shipdate").alias("valid_from"),
        F.date_add(_day("l_shipdate"), 365).alias("valid_to"),
    )


def trial_relations(spark: SparkSession, root: str) -> DataFrame:
    """(source, role, nct_id, name, valid_from, valid_to): relation records as of the days on which they can be read.

    Only sponsor records have a role.  A line's relations are known from its shipping date on.
    """
    orders = table(spark, root, "orders")
    none = F.lit(None).cast("string")
    open_end = F.lit(None).cast("date").alias("valid_to")
    leads = orders.select(
        F.lit("sponsors").alias("source"),
        F.lit("Lead").alias("role"),
        _nct("o_orderkey").alias("nct_id"),
        F.concat(F.lit("Sponsor  "), F.col("o_custkey").cast("string")).alias("name"),
        _day("o_orderdate").alias("valid_from"),
        open_end,
    )
    parts = table(spark, root, "part").select("p_partkey", "p_brand", "p_type")
    suppliers = table(spark, root, "supplier").select("s_suppkey", "s_nationkey")
    lines = (
        table(spark, root, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", _day("l_shipdate").alias("valid_from"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    record = lambda source, role, name: F.struct(F.lit(source).alias("source"), role.alias("role"), name.alias("name"))
    return leads.unionByName(
        lines.select(
            _nct("l_orderkey").alias("nct_id"),
            "valid_from",
            F.explode(
                F.array(
                    record("facilities", none, F.concat(F.lit("Site "), F.col("l_suppkey").cast("string"))),
                    record("conditions", none, F.col("p_brand")),
                    record("interventions", none, F.col("p_type")),
                    record("sponsors", F.lit("collaborator"), F.concat(F.lit("Collab "), F.col("s_nationkey").cast("string"))),
                )
            ).alias("r"),
        ).select("r.source", "r.role", "nct_id", "r.name", "valid_from", open_end)
    )
