"""Facility study: will an inspection find a serious deficiency, from history and shared owners."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tideline.functions.ordering import dense_index
from tideline.functions.scalar import flexible_date, is_serious_citation, is_standard_survey, log1p, owner_token, ratio, strip_owner_kind
from tideline.operators.peers import STATS, peer_statistics
from tideline.session import cut
from tideline.sources import bindings

TARGET_YEARS = (1995, 2001)
# Names that the results carry, in their order.
BASE_FEATURES = (
    "log_prior_inspections",
    "log_prior_serious",
    "prior_serious_rate",
    "log_recent365_inspections",
    "log_recent365_serious",
    "log_recent730_inspections",
    "log_recent730_serious",
    "days_since_last_years",
    "facility_age_years",
    "log_chow_prior",
    "log_chow_recent365",
)
GRAPH_FEATURES = (
    "log_owner_count",
    "log_peer_count",
    "log_peer_prior_facilities",
    "log_peer_prior_inspections",
    "log_peer_prior_serious",
    "peer_prior_serious_rate",
    "log_peer_recent365_inspections",
    "log_peer_recent365_serious",
    "peer_recent365_serious_rate",
    "log_peer_recent730_serious",
    "peer_any_serious365_count",
    "peer_any_serious730_count",
)


def day_number(day) -> F.Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


#: Entities of a part of an owner.
PART = 1000


def owner_projection(attachments: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Distinct (entity, peer) pairs, both directions, of entities sharing an owner token; with ``values`` (entity, x)
    also the peer's x, for the peers that have one.

    A pair is listed by the first of the owners that it shares only: each entity brings, to every owner, the places of
    its owners before that one, and pairs that share one of those are left to it.  So no pair is shuffled; rows of the
    shuffles are attachments.
    """
    members = attachments.select("owner", "entity").distinct().transform(cut)
    sizes = members.groupBy("owner").agg(F.count("*").alias("n")).filter("n > 1")
    sized = members.join(sizes.join(dense_index(sizes.select("owner"), "owner", "place"), "owner"), "owner").select("entity", "place", "n")
    owned = sized.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("_own"))
    earlier = F.transform("_own", lambda o, i: F.struct(o["place"].alias("place"), o["n"].alias("n"), F.slice(F.transform("_own", lambda x: x["place"]), F.lit(1), i).alias("before")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / PART)).cast("long")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    listed = owned.select("entity", F.inline(earlier)).withColumn("parts", parts).transform(cut)
    mine = F.pmod(F.xxhash64("entity"), F.col("parts"))
    left = listed.select("place", "entity", "before", mine.alias("a"), every.alias("b"))
    peers, rest = (listed, []) if values is None else (listed.join(values, "entity"), ["x"])
    right = peers.select("place", F.col("entity").alias("peer"), F.col("before").alias("_before"), *rest, mine.alias("b"), every.alias("a"))
    first = ~F.arrays_overlap("before", "_before")
    return left.join(right, ["place", "a", "b"]).filter((F.col("entity") != F.col("peer")) & first).select("entity", "peer", *rest)


def standard_episodes(surveys: DataFrame, citations: DataFrame) -> DataFrame:
    """(ccn, day, serious) of standard inspections: raw survey and citation rows, dates as text.

    A row without a facility or a readable date is no episode; a serious citation counts for the inspection of its day.
    """
    day = flexible_date(F.col("date"))
    known = (F.coalesce(F.trim("ccn"), F.lit("")) != "") & day.isNotNull()
    held = surveys.filter(is_standard_survey(F.col("survey_type")) & known).select(F.trim("ccn").alias("ccn"), day.alias("day")).distinct()
    serious = is_serious_citation(F.col("survey_type"), F.col("standard"), F.col("severity"))
    cited = citations.filter(serious & known).select(F.trim("ccn").alias("ccn"), day.alias("day")).distinct().withColumn("serious", F.lit(1).cast("long"))
    return held.join(cited, ["ccn", "day"], "left").fillna(0, ["serious"])


@dataclass
class FacilityStudy:
    """Inputs: inspections (ccn, day, serious), providers, owner records and change-of-ownership filings."""

    inspections: DataFrame
    providers: DataFrame
    owner_records: DataFrame
    filings: DataFrame
    filing_owners: DataFrame
    excluded_roles: tuple[str, ...]
    change_roles: tuple[str, ...]
    first_year: int = TARGET_YEARS[0]
    last_year: int = TARGET_YEARS[1]
    validation_year: int = 1999

    @classmethod
    def bound(cls, spark: SparkSession, root: str) -> "FacilityStudy":
        return cls(
            bindings.inspections(spark, root),
            bindings.providers(spark, root),
            bindings.current_owner_records(spark, root),
            bindings.change_events(spark, root),
            bindings.change_owner_records(spark, root),
            bindings.BOUND_EXCLUDED_ROLES,
            bindings.BOUND_CHANGE_ROLES,
        )

    # ------------------------------------------------------------ episodes and history

    @cached_property
    def provider_static(self) -> DataFrame:
        """One row for each facility: the first record with an approval date."""
        usable = self.providers.filter("ccn <> '' and approval is not null")
        rest = F.struct(*[c for c in usable.columns if c != "ccn"])
        order = F.col("row_no") if "row_no" in usable.columns else F.struct("approval", rest)
        return usable.groupBy("ccn").agg(F.min_by(rest, order).alias("_r")).select("ccn", "_r.*")

    @cached_property
    def histories(self) -> DataFrame:
        """Every inspection with what was known strictly before it."""
        days = self.inspections.withColumn("dn", day_number(F.col("day")))
        order = W.partitionBy("ccn").orderBy("dn")
        before = order.rowsBetween(W.unboundedPreceding, -1)

        def span(n: int):
            return order.rangeBetween(-n, -1)

        def total(c: str, w) -> F.Column:
            return F.coalesce(F.sum(c).over(w), F.lit(0))

        return days.select(
            "ccn", "day", "dn", "serious",
            F.count("*").over(before).alias("prior_inspections"),
            total("serious", before).alias("prior_serious"),
            F.count("*").over(span(365)).alias("recent365_inspections"),
            total("serious", span(365)).alias("recent365_serious"),
            F.count("*").over(span(730)).alias("recent730_inspections"),
            total("serious", span(730)).alias("recent730_serious"),
            (F.col("dn") - F.lag("dn").over(order)).cast("long").alias("days_since_last"),
        )

    # ------------------------------------------------------------ owners

    @cached_property
    def current_owners(self) -> DataFrame:
        """(ccn, owner, association, role) of kept roles."""
        return self.owner_records.filter(
            (F.trim("owner_type") != "") & (F.trim("owner_name") != "") & F.col("association").isNotNull()
            & ~F.col("role").isin(*self.excluded_roles)
        ).select("ccn", owner_token(F.col("owner_type"), F.col("owner_name")).alias("owner"), "association", "role")

    @cached_property
    def filing_ccns(self) -> DataFrame:
        """(enrollment, ccn): the last filing of an enrollment wins."""
        return self.filings.filter("enrollment <> '' and ccn <> ''").groupBy("enrollment").agg(
            F.max_by("ccn", "row_no").alias("ccn")
        )

    @cached_property
    def change_owners(self) -> DataFrame:
        return (
            self.filing_owners.filter(F.col("role").isin(*self.change_roles) & F.col("association").isNotNull() & (F.trim("associate") != ""))
            .join(self.filing_ccns, "enrollment")
            .join(self.provider_static, "ccn", "left_semi")
            .select("ccn", F.concat(F.lit("PAC:"), "associate").alias("owner"), "association", "role")
        )

    @cached_property
    def combined_owners(self) -> DataFrame:
        """Filing owners where a facility has any, otherwise its current owners."""
        covered = self.change_owners.select("ccn").distinct()
        return self.change_owners.unionByName(self.current_owners.join(covered, "ccn", "left_anti"))

    @cached_property
    def attachments(self) -> DataFrame:
        """(owner, ccn, first): first association of each pair."""
        return self.combined_owners.groupBy("owner", "ccn").agg(F.min("association").alias("first")).transform(cut)

    # ------------------------------------------------------------ model rows

    @cached_property
    def base_rows(self) -> DataFrame:
        """Inspections with at least one earlier inspection and a known provider."""
        year = F.year("day")
        kept = self.histories.filter(
            year.between(self.first_year, self.last_year) & (F.col("prior_inspections") > 0)
        ).join(self.provider_static, "ccn")
        age = F.greatest(F.lit(0.0), F.datediff("day", "approval") / F.lit(365.25))
        return kept.select(
            "ccn", "day", "dn",
            year.cast("long").alias("year"),
            F.col("serious").cast("long").alias("label"),
            "state", "provider_type",
            age.alias("age_years"),
            "prior_inspections", "prior_serious",
            (F.col("prior_serious") / F.col("prior_inspections")).alias("prior_serious_rate"),
            "recent365_inspections", "recent365_serious", "recent730_inspections", "recent730_serious",
            "days_since_last",
        )

    def change_counts(self) -> DataFrame:
        """(ccn, day, chow_prior, chow_recent365) per model row.

        Filings and targets of a facility are walked once in date order, so a
        facility with many filings never multiplies its inspections.
        """
        events = self.filings.groupBy("ccn", F.col("effective").alias("day")).agg(F.count("*").alias("n"))
        marked = (
            self.base_rows.select("ccn", "day", F.lit(0).cast("long").alias("n"), F.lit(1).alias("target"))
            .unionByName(events.select("ccn", "day", "n", F.lit(0).alias("target")))
            .withColumn("dn", day_number(F.col("day")))
        )
        order = W.partitionBy("ccn").orderBy("dn")
        prior = order.rangeBetween(W.unboundedPreceding, -1)
        recent = order.rangeBetween(-365, -1)
        return marked.select(
            "ccn", "day", "target",
            F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("chow_prior"),
            F.coalesce(F.sum("n").over(recent), F.lit(0)).alias("chow_recent365"),
        ).filter("target = 1").drop("target")

    def owner_counts(self) -> DataFrame:
        """(ccn, day, owner_count): distinct owners attached on or before the target day."""
        starts = self.attachments.groupBy("ccn", F.col("first").alias("day")).agg(F.count("*").alias("n"))
        marked = (
            self.base_rows.select("ccn", "day", F.lit(0).cast("long").alias("n"), F.lit(1).alias("target"))
            .unionByName(starts.select("ccn", "day", "n", F.lit(0).alias("target")))
            .withColumn("dn", day_number(F.col("day")))
        )
        upto = W.partitionBy("ccn").orderBy("dn").rangeBetween(W.unboundedPreceding, 0)
        return marked.select("ccn", "day", "target", F.sum("n").over(upto).alias("owner_count")).filter(
            "target = 1"
        ).drop("target")

    def peer_stats(self) -> DataFrame:
        """(ccn, day, owner_count, nine peer statistics) per model row."""
        targets = self.base_rows.select(F.col("ccn").alias("entity"), F.col("dn").alias("day"))
        links = self.attachments.select(
            F.col("ccn").alias("entity"), "owner", day_number(F.col("first")).alias("since")
        )
        events = self.inspections.select(
            F.col("ccn").alias("entity"), day_number(F.col("day")).alias("day"), F.col("serious").cast("int").alias("serious")
        )
        stats = peer_statistics(targets, links, events).select(
            F.col("entity").alias("ccn"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("day"), *STATS
        )
        return self.owner_counts().join(stats, ["ccn", "day"], "left").fillna(0, list(STATS))

    @cached_property
    def model_rows(self) -> DataFrame:
        return (
            self.base_rows.join(self.change_counts(), ["ccn", "day"]).join(self.peer_stats(), ["ccn", "day"]).transform(cut)
        )

    @cached_property
    def local_rows(self) -> DataFrame:
        return self.base_rows.join(self.change_counts(), ["ccn", "day"])

    def features(self, rows: DataFrame, graph: bool = True) -> DataFrame:
        """Attach the local features, and the ownership features when ``graph``."""
        c = F.col

        def rate(a: str, b: str) -> F.Column:
            return F.coalesce(ratio(c(a), c(b)), F.lit(0.0))

        values = {
            "log_prior_inspections": log1p(c("prior_inspections")),
            "log_prior_serious": log1p(c("prior_serious")),
            "prior_serious_rate": c("prior_serious_rate"),
            "log_recent365_inspections": log1p(c("recent365_inspections")),
            "log_recent365_serious": log1p(c("recent365_serious")),
            "log_recent730_inspections": log1p(c("recent730_inspections")),
            "log_recent730_serious": log1p(c("recent730_serious")),
            "days_since_last_years": F.least(c("days_since_last"), F.lit(1460)) / F.lit(365.25),
            "facility_age_years": F.least(c("age_years"), F.lit(100.0)),
            "log_chow_prior": log1p(c("chow_prior")),
            "log_chow_recent365": log1p(c("chow_recent365")),
        }
        if graph:
            values |= {
                "log_owner_count": log1p(c("owner_count")),
                "log_peer_count": log1p(c("peer_count")),
                "log_peer_prior_facilities": log1p(c("peer_prior_facilities")),
                "log_peer_prior_inspections": log1p(c("peer_prior_inspections")),
                "log_peer_prior_serious": log1p(c("peer_prior_serious")),
                "peer_prior_serious_rate": rate("peer_prior_serious", "peer_prior_inspections"),
                "log_peer_recent365_inspections": log1p(c("peer_recent365_inspections")),
                "log_peer_recent365_serious": log1p(c("peer_recent365_serious")),
                "peer_recent365_serious_rate": rate("peer_recent365_serious", "peer_recent365_inspections"),
                "log_peer_recent730_serious": log1p(c("peer_recent730_serious")),
                "peer_any_serious365_count": log1p(c("peer_any_serious365")),
                "peer_any_serious730_count": log1p(c("peer_any_serious730")),
            }
        keep = [x for x in rows.columns if x not in values]
        return rows.select(*keep, *[v.alias(k) for k, v in values.items()])

    def prevalence_predictions(self) -> DataFrame:
        """(year, ccn, day, label, score): base rate of all strictly earlier model years."""
        per_year = self.base_rows.groupBy("year").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
        years = F.explode(F.sequence(F.col("year") + 1, F.lit(self.last_year).cast("long")))
        rates = per_year.filter(F.col("year") < self.last_year).withColumn("t", years).groupBy(F.col("t").alias("year")).agg(
            (F.sum("p") / F.sum("n")).alias("score")
        )
        return self.local_rows.filter(F.col("year") >= self.validation_year).join(rates, "year")

    # ------------------------------------------------------------ topology

    def topology(self, cutoff: str, values: DataFrame | None = None) -> DataFrame:
        """(entity, peer) among current owners attached strictly before ``cutoff``; with ``values`` (entity, x) the peer's x."""
        active = self.current_owners.filter(F.col("association") < F.lit(cutoff).cast("date")).select(
            strip_owner_kind(F.col("owner")).alias("owner"), F.col("ccn").alias("entity")
        )
        return owner_projection(active, values)


def neighbor_mean(pairs: DataFrame, train: F.Column) -> DataFrame:
    """Mean neighbour covariate, standardised by the training entities' mean and deviation.

    ``pairs``: (entity, peer, x) with the peer's covariate.  The two training moments come from one scalar row.
    """
    raw = pairs.groupBy("entity").agg(F.avg("x").alias("raw")).transform(cut)
    stats = raw.filter(train).agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"))
    scale = F.when(F.col("v") > 1e-12, F.sqrt("v")).otherwise(1.0)
    moments = stats.select(F.struct(F.col("m"), scale.alias("s")).alias("z")).scalar()
    return raw.withColumn("_z", moments).select(
        "entity", "raw", ((F.col("raw") - F.col("_z.m")) / F.col("_z.s")).alias("standardised")
    )
