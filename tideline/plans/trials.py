"""Trial study: will a completed trial post results within a year of an origin snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tideline.functions.scalar import (
    flag_error,
    number_error,
    normalize_name,
    parse_flag,
    parse_number,
    ratio,
)
from tideline.operators.median import packed_median
from tideline.session import cut
from tideline.sources import bindings

HORIZON = 365
MAX_LAG = 90
#: Size of the bounded cohort that `t_cohort` shows; studies score all eligible trials unless told otherwise.
COHORT = 2000
ENTITY_TYPES = ("sponsor", "condition", "intervention", "facility", "collaborator")
CONTEXT_TYPES = ("facility", "condition", "intervention", "collaborator")
# Names that the results carry, in their order.
CATEGORICAL = ("phase", "allocation", "intervention_model", "masking", "primary_purpose", "time_perspective")
NUMERIC = (
    "enrollment",
    "number_of_arms",
    "number_of_groups",
    "start_to_completion_days",
    "completion_lag_days",
    "is_fda_regulated_drug",
    "is_fda_regulated_device",
)
DESIGN = ("allocation", "intervention_model", "masking", "primary_purpose", "time_perspective")
#: Relation files without roles, and the entity type that they name.
RELATION_SOURCES = {"facilities": "facility", "conditions": "condition", "interventions": "intervention"}
HISTORY = ("prior_trial_count", "timely_fraction", "median_delay_days", "entity_count", "history_entity_count")
LOCAL = "trial_local_logistic"
SPONSOR = "local_plus_sponsor_logistic"
# Entity groups of the ablation models; the first list is the local model.
GROUPS: dict[str, tuple[str, ...]] = {
    LOCAL: (),
    SPONSOR: ("sponsor",),
    "local_plus_sponsor_condition_logistic": ("sponsor", "condition"),
    "local_plus_sponsor_facility_logistic": ("sponsor", "facility"),
    "local_plus_sponsor_intervention_logistic": ("sponsor", "intervention"),
    "local_plus_sponsor_collaborator_logistic": ("sponsor", "collaborator"),
    "heterogeneous_context_by_entity_logistic": ("sponsor", "condition", "facility", "intervention", "collaborator"),
}


def _readable() -> Column:
    """The version could be read at the row's origin."""
    return (F.col("valid_from") <= F.col("origin")) & F.coalesce(F.col("origin") <= F.col("valid_to"), F.lit(True))


def group_numeric(group: str) -> list[str]:
    """Numeric feature columns of an ablation group."""
    return [*NUMERIC, *[f"{e}_{h}" for e in GROUPS[group] for h in HISTORY]]


@dataclass
class TrialStudy:
    """Study rows (text columns) by snapshot, versioned designs and relations, and the snapshot dates.

    A version says from which day to which day a record could be read; a plan sees the versions of its own snapshot,
    so what is added later can't reach an earlier origin.  Values that break a typed rule stop the run; with
    ``strict`` off they are left out, and `quarantine` lists them.
    """

    raw: DataFrame
    raw_designs: DataFrame
    raw_relations: DataFrame
    snapshots: tuple[str, ...]
    cohort_size: int | None = None
    strict: bool = True

    def __post_init__(self) -> None:
        days = [_date(s) for s in self.snapshots]
        short = [(str(a), str(b)) for a, b in zip(days, days[1:]) if (b - a).days < HORIZON]
        if short:
            raise ValueError(f"snapshots do not cover the {HORIZON}-day horizon of their origins: {short}")

    @classmethod
    def bound(cls, spark: SparkSession, root: str, cohort_size: int | None = None) -> "TrialStudy":
        return cls(
            bindings.trial_studies(spark, root),
            bindings.trial_designs(spark, root),
            bindings.trial_relations(spark, root),
            bindings.TRIAL_SNAPSHOTS,
            cohort_size=cohort_size,
        )

    @property
    def origins(self) -> tuple[str, ...]:
        return self.snapshots[:-1]

    # ------------------------------------------------------------ studies

    def _problems(self) -> Column:
        """Names of the columns of a raw row that break a typed rule."""
        in_study = (F.lower(F.trim("study_type")) == "interventional") & (F.lower(F.trim("completion_type")) == "actual")
        blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
        bad_date = lambda c: F.substring(F.trim(c), 1, 10).try_cast("date").isNull()
        checks = {
            "nct_id": ~F.coalesce(F.trim("nct_id"), F.lit("")).rlike("(?i)^NCT[0-9]{8}$"),
            "completion_date": in_study & bad_date("completion_date"),
            "results_date": ~blank("results_date") & bad_date("results_date"),
            "start_date": ~blank("start_date") & bad_date("start_date"),
            "enrollment": number_error(F.col("enrollment")),
            "number_of_arms": number_error(F.col("number_of_arms")),
            "number_of_groups": number_error(F.col("number_of_groups")),
            "fda_drug": flag_error(F.col("fda_drug")),
            "fda_device": flag_error(F.col("fda_device")),
        }
        return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))

    def quarantine(self) -> DataFrame:
        """(snapshot, nct_id, problem) of every study value that breaks a typed rule."""
        return self.raw.select("snapshot", "nct_id", F.explode(self._problems()).alias("problem"))

    def repeated_studies(self) -> DataFrame:
        """(snapshot, nct_id, n): ids with more than one row in a snapshot."""
        return self.raw.groupBy("snapshot", F.trim("nct_id").alias("nct_id")).agg(F.count("*").alias("n")).filter("n > 1")

    @cached_property
    def sound(self) -> DataFrame:
        """The raw rows without a broken rule; a row with one stops the run unless ``strict`` is off."""
        problems = self._problems()
        what = F.concat(F.lit("malformed study row "), F.col("nct_id"), F.lit(": "), F.array_join(problems, ", "))
        stop = F.raise_error(what).cast("boolean") if self.strict else F.lit(False)
        return self.raw.filter(F.when(F.size(problems) > 0, stop).otherwise(True))

    @cached_property
    def studies(self) -> DataFrame:
        """Typed interventional studies with an actual completion on or before the snapshot."""

        def day(name: str) -> Column:
            return F.substring(F.trim(name), 1, 10).try_cast("date")

        typed = (
            self.sound.filter(
                (F.lower(F.trim("study_type")) == "interventional") & (F.lower(F.trim("completion_type")) == "actual")
            )
            .select(
                "snapshot",
                F.trim("nct_id").alias("nct_id"),
                day("completion_date").alias("completion"),
                day("results_date").alias("result"),
                day("start_date").alias("start"),
                F.when(F.trim("phase") != "", F.trim("phase")).alias("phase"),
                parse_number(F.col("enrollment")).alias("enrollment"),
                parse_number(F.col("number_of_arms")).alias("number_of_arms"),
                parse_number(F.col("number_of_groups")).alias("number_of_groups"),
                parse_flag(F.col("fda_drug")).alias("is_fda_regulated_drug"),
                parse_flag(F.col("fda_device")).alias("is_fda_regulated_device"),
            )
        )
        return typed.filter(F.col("completion") <= F.col("snapshot")).withColumn("age", F.datediff("snapshot", "completion"))

    def require_unique(self) -> None:
        """Raise when a snapshot has two rows of one study; reads a few of them."""
        repeated = self.repeated_studies().orderBy("snapshot", "nct_id").limit(3).collect()
        if repeated:
            raise ValueError(f"repeated studies: {[(str(r['snapshot']), r['nct_id'], r['n']) for r in repeated]}")

    @cached_property
    def at_origins(self) -> DataFrame:
        return self.studies.filter(F.col("snapshot").isin([_date(o) for o in self.origins])).withColumnRenamed(
            "snapshot", "origin"
        )

    @cached_property
    def known(self) -> DataFrame:
        """(origin, nct_id, timely, delay): trials completed at least a year before the origin."""
        return self.at_origins.filter(F.col("age") >= HORIZON).select(
            "origin",
            "nct_id",
            F.coalesce(F.col("result") <= F.date_add("completion", HORIZON), F.lit(False)).cast("long").alias("timely"),
            F.datediff("result", "completion").cast("long").alias("delay"),
        ).transform(cut)

    @cached_property
    def eligible(self) -> DataFrame:
        """Target pool: completed within 90 days of the origin and without a result."""
        return self.at_origins.filter(F.col("age").between(0, MAX_LAG) & F.col("result").isNull())

    @cached_property
    def cohort(self) -> DataFrame:
        """Eligible trials; with a size, per origin the ones with the smallest (SHA-256, id), limited below the shuffle."""
        if self.cohort_size is None:
            return self.eligible.transform(cut)
        order = W.partitionBy("origin").orderBy(F.sha2("nct_id", 256), "nct_id")
        ranked = self.eligible.withColumn("_rn", F.row_number().over(order))
        return ranked.filter(F.col("_rn") <= self.cohort_size).drop("_rn").transform(cut)

    # ------------------------------------------------------------ relations and history

    @cached_property
    def related(self) -> DataFrame:
        """(nct_id, known, targets, names): a row for each target or known trial with relations.

        ``known`` are its (origin, timely, delay), ``targets`` the origins at which it is a target, ``names`` the distinct
        (origin, entity_type, name) of the origins' versions.  The role of a sponsor record says whether it names a sponsor
        or a collaborator; any other role stops the run.
        """
        role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
        kind = F.when(F.col("source") == "sponsors", F.when(role.contains("lead"), "sponsor").when(role.contains("collabor"), "collaborator"))
        for source, name in RELATION_SOURCES.items():
            kind = kind.when(F.col("source") == source, F.lit(name))
        unknown = F.when((F.col("source") == "sponsors") & kind.isNull(), role)
        record = F.struct(kind.alias("kind"), unknown.alias("unknown"), "name", "valid_from", "valid_to")
        named = self.raw_relations.select("nct_id", "source", "role", "valid_from", "valid_to", normalize_name(F.col("name")).alias("name"))
        records = named.filter("name is not null").select("nct_id", record.alias("r")).groupBy("nct_id").agg(F.collect_list("r").alias("_records"))
        known = self.known.select("nct_id", F.struct("origin", "timely", "delay").alias("k"), F.lit(None).cast("date").alias("t"))
        cohort = self.cohort.select("nct_id", F.lit(None).cast(known.schema["k"].dataType).alias("k"), F.col("origin").alias("t"))
        retained = known.unionByName(cohort).groupBy("nct_id").agg(F.collect_list("k").alias("known"), F.collect_set("t").alias("targets"))

        what = lambda r: F.raise_error(F.concat(F.lit("unknown sponsor relation "), r["unknown"], F.lit(" of "), F.col("nct_id")))
        typed = lambda r: F.when(r["unknown"].isNotNull(), what(r).cast("string")).otherwise(r["kind"])
        readable = lambda r, o: (r["valid_from"] <= o) & F.coalesce(o <= r["valid_to"], F.lit(True))
        at = lambda o: F.transform(
            F.filter("_records", lambda r: readable(r, o)), lambda r: F.struct(o.alias("origin"), typed(r).alias("entity_type"), r["name"].alias("name"))
        )
        origins = F.array_distinct(F.concat(F.transform("known", lambda k: k["origin"]), F.col("targets")))
        names = F.flatten(F.transform(origins, lambda o: F.array_distinct(at(o))))
        return retained.join(records, "nct_id").select("nct_id", "known", "targets", names.alias("names")).transform(cut)

    @cached_property
    def relations(self) -> DataFrame:
        """(origin, entity_type, nct_id, name) of target and known trials, distinct normalised names of the origin's versions."""
        return self.related.select("nct_id", F.inline("names")).select("origin", "entity_type", "nct_id", "name")

    def relation_counts(self) -> DataFrame:
        """(origin, entity_type, relations, trials, names); a trial's relations are in one row, so only names are dealt."""
        names = self.relations.groupBy("origin", "entity_type", "name").agg(F.count("*").alias("n"))
        names = names.groupBy("origin", "entity_type").agg(F.sum("n").alias("relations"), F.count("*").alias("names"))
        kinds = F.array_distinct(F.transform("names", lambda x: F.struct(x["origin"].alias("origin"), x["entity_type"].alias("entity_type"))))
        trials = self.related.select(F.inline(kinds)).groupBy("origin", "entity_type").agg(F.count("*").alias("trials"))
        same = (names["origin"] == trials["origin"]) & names["entity_type"].eqNullSafe(trials["entity_type"])
        return names.join(trials, same).select(names["origin"], names["entity_type"], "relations", "trials", "names")

    @cached_property
    def entity_history(self) -> DataFrame:
        """(origin, entity_type, name, trials, timely, cells) over known trials; ``cells`` are its (delay, n).

        Counted for all origins at once, as most of an entity's trials are known at several.
        """
        rows = self.related.select("names", F.explode("known").alias("k"))
        mine = F.filter("names", lambda x: x["origin"] == F.col("k.origin"))
        rows = rows.select(F.col("k.origin").alias("at"), "k.timely", "k.delay", F.inline(mine)).drop("origin")
        days = [_date(o) for o in self.origins]
        sums = [f(k, d) for k, d in enumerate(days) for f in (
            lambda k, d: F.count_if(F.col("at") == d).alias(f"n{k}"), lambda k, d: F.sum(F.when(F.col("at") == d, F.col("timely")).otherwise(0)).alias(f"t{k}"),
        )]
        delays = rows.groupBy("entity_type", "name", "delay").agg(*sums)
        counts = F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.col(f"t{k}").alias("t")) for k in range(len(days))])
        packed = delays.groupBy("entity_type", "name").agg(F.collect_list(F.struct("delay", counts.alias("c"))).alias("cells"))
        at = F.posexplode(F.array(*[F.lit(d) for d in days])).alias("k", "origin")
        cells = F.filter(F.transform("cells", lambda x: F.struct(x["delay"].alias("v"), F.get(x["c"], F.col("k")).alias("c"))), lambda x: x["c"]["n"] > 0)
        total = lambda f: F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x["c"][f])
        delayed = F.transform(F.filter("cells", lambda x: x["v"].isNotNull()), lambda x: F.struct(x["v"].alias("v"), x["c"]["n"].alias("n")))
        spread = packed.select("entity_type", "name", "cells", at).select("origin", "entity_type", "name", cells.alias("cells")).filter(F.size("cells") > 0)
        return spread.select("origin", "entity_type", "name", total("n").alias("trials"), total("t").alias("timely"), delayed.alias("cells")).transform(cut)

    @cached_property
    def target_history(self) -> DataFrame:
        """(origin, nct_id, entity_type) with pooled counts, timely share and exact pooled median delay.

        Targets with equal entities have equal histories, so each set of entities is counted once.
        """
        mine = F.filter("names", lambda x: x["origin"] == F.col("origin"))
        targets = self.related.select("nct_id", "names", F.explode("targets").alias("origin")).select("origin", "nct_id", mine.alias("_mine"))
        kinds = F.explode(F.array_distinct(F.transform("_mine", lambda x: x["entity_type"])))
        names = F.array_sort(F.transform(F.filter("_mine", lambda x: x["entity_type"].eqNullSafe(F.col("entity_type"))), lambda x: x["name"]))
        targets = targets.select("origin", "nct_id", "_mine", kinds.alias("entity_type")).select("origin", "nct_id", "entity_type", names.alias("names"))
        sets = targets.groupBy("origin", "entity_type", "names").agg(F.lit(1).alias("_one"))
        sets = sets.select(F.monotonically_increasing_id().alias("_set"), "origin", "entity_type", "names").transform(cut)
        members = sets.select("_set", "origin", "entity_type", F.explode("names").alias("name")).transform(cut)
        keys = ["origin", "entity_type", "name"]
        counts = (
            members.join(self.entity_history.drop("cells"), keys, "left")
            .groupBy("_set")
            .agg(
                F.count("*").alias("entity_count"),
                F.count("trials").alias("history_entity_count"),
                F.coalesce(F.sum("trials"), F.lit(0)).alias("prior_trial_count"),
                F.coalesce(F.sum("timely"), F.lit(0)).alias("timely"),
            )
        )
        histories = self.entity_history.select(*keys, "cells").filter(F.size("cells") > 0)
        pooled = packed_median(members, histories, ["_set"], keys, "median_delay_days")
        found = sets.join(counts, "_set").join(pooled, "_set", "left").withColumnsRenamed({"origin": "_o", "entity_type": "_e", "names": "_n"})
        same = (F.col("origin") == F.col("_o")) & F.col("entity_type").eqNullSafe(F.col("_e")) & (F.col("names") == F.col("_n"))
        return targets.join(found, same).select(
            "origin", "nct_id", "entity_type", "entity_count", "history_entity_count", "prior_trial_count", "timely", "median_delay_days"
        ).withColumn("timely_fraction", ratio(F.col("timely"), F.col("prior_trial_count"))).transform(cut)

    def context(self) -> DataFrame:
        """(origin, nct_id) context over the four non-sponsor types: summed counts, weighted share, mean of medians."""
        rows = self.cohort.select("origin", "nct_id").join(
            self.target_history.filter(F.col("entity_type").isin(*CONTEXT_TYPES)), ["origin", "nct_id"], "left"
        )
        prior = F.coalesce(F.sum("prior_trial_count"), F.lit(0))
        return rows.groupBy("origin", "nct_id").agg(
            prior.alias("prior_trial_count"),
            ratio(F.sum("timely"), prior).alias("timely_fraction"),
            F.avg("median_delay_days").alias("median_delay_days"),
            F.coalesce(F.sum("entity_count"), F.lit(0)).alias("entity_count"),
            F.coalesce(F.sum("history_entity_count"), F.lit(0)).alias("history_entity_count"),
        )

    def coverage(self) -> DataFrame:
        """(origin, entity_type) relation and history presence, plus isolated targets per origin."""
        types = F.explode(F.array(*[F.lit(t) for t in ENTITY_TYPES]))
        grid = self.cohort.select("origin", "nct_id", types.alias("entity_type")).join(
            self.target_history, ["origin", "nct_id", "entity_type"], "left"
        )
        per_type = grid.groupBy("origin", "entity_type").agg(
            F.count("*").alias("targets"),
            F.count_if(F.coalesce("entity_count", F.lit(0)) > 0).alias("relation_present"),
            F.count_if(F.coalesce("history_entity_count", F.lit(0)) > 0).alias("history_present"),
        )
        isolated = grid.groupBy("origin", "nct_id").agg(F.sum("history_entity_count").alias("h")).groupBy("origin").agg(
            F.count_if(F.coalesce("h", F.lit(0)) == 0).alias("isolated")
        )
        return per_type.join(isolated, "origin").withColumns(
            {
                "relation_fraction": F.col("relation_present") / F.col("targets"),
                "history_fraction": F.col("history_present") / F.col("targets"),
            }
        )

    # ------------------------------------------------------------ labels

    def labelled(self) -> DataFrame:
        """Every target with its status at the next snapshot: missing, inconsistent, or a 0/1 label."""
        following = [F.struct(F.lit(a).cast("date").alias("origin"), F.lit(b).cast("date").alias("next"))
                     for a, b in zip(self.snapshots, self.snapshots[1:])]
        nexts = F.explode(F.filter(F.array(*following), lambda s: s["origin"] == F.col("origin")))
        targets = self.cohort.select("origin", "nct_id", nexts.alias("_n")).select("origin", "nct_id", F.col("_n.next").alias("next"))
        future = self.raw.select(
            F.col("snapshot").alias("next"),
            F.trim("nct_id").alias("nct_id"),
            F.substring(F.trim("results_date"), 1, 10).try_cast("date").alias("posted"),
            F.lit(1).alias("seen"),
        )
        late = F.raise_error(F.lit("future row exposes a result date after its snapshot"))
        posted = F.when(F.col("posted") > F.col("next"), late.cast("date")).otherwise(F.col("posted"))
        joined = targets.join(future, ["next", "nct_id"], "left").withColumn("posted", posted)
        status = (
            F.when(F.col("seen").isNull(), "missing")
            .when(F.col("posted") <= F.col("origin"), "inconsistent")
            .when(F.col("posted") <= F.date_add("origin", HORIZON), "positive")
            .otherwise("negative")
        )
        return joined.select("origin", "nct_id", "posted", status.alias("status")).withColumn(
            "label", F.when(F.col("status") == "positive", 1).when(F.col("status") == "negative", 0).cast("long")
        )

    def label_audit(self) -> DataFrame:
        return self.labelled().groupBy("origin").agg(
            F.count("*").alias("selected"),
            *[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "inconsistent", "positive", "negative")],
        )

    # ------------------------------------------------------------ features

    def _design_values(self) -> DataFrame:
        """(origin, nct_id, field, v): the distinct non-blank values that the origin's versions give for a target."""
        fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.trim(f).alias("v")) for f in DESIGN]))
        targets = self.cohort.select("origin", "nct_id")
        rows = self.raw_designs.join(targets, "nct_id").filter(_readable()).select("origin", "nct_id", fields.alias("x"))
        return rows.select("origin", "nct_id", "x.*").filter("v <> ''").distinct()

    def designs(self) -> DataFrame:
        """(origin, nct_id, design fields) of the targets; two values of a field stop the run."""
        what = F.concat(F.lit("conflicting design of "), F.col("nct_id"))
        one = lambda f: F.when(F.count(F.when(F.col("field") == f, 1)) > 1, F.raise_error(what)).otherwise(F.max(F.when(F.col("field") == f, F.col("v"))))
        return self._design_values().groupBy("origin", "nct_id").agg(*[one(f).alias(f) for f in DESIGN])

    def design_conflicts(self) -> DataFrame:
        """(origin, nct_id, field, values): more than one non-blank value among an origin's versions."""
        return self._design_values().groupBy("origin", "nct_id", "field").agg(F.count("*").alias("values")).filter(F.col("values") > 1)

    def local_features(self) -> DataFrame:
        return self.cohort.join(self.designs(), ["origin", "nct_id"], "left").select(
            "origin",
            "nct_id",
            *CATEGORICAL,
            "enrollment",
            "number_of_arms",
            "number_of_groups",
            F.datediff("completion", "start").cast("double").alias("start_to_completion_days"),
            F.col("age").cast("double").alias("completion_lag_days"),
            "is_fda_regulated_drug",
            "is_fda_regulated_device",
        )

    @cached_property
    def examples(self) -> DataFrame:
        """Labelled targets with local features and per-type history features."""
        tall = self.target_history.groupBy("origin", "nct_id").pivot("entity_type", list(ENTITY_TYPES)).agg(
            *[F.first(h).cast("double").alias(h) for h in HISTORY]
        )
        rows = (
            self.local_features()
            .join(self.labelled().filter("label is not null").select("origin", "nct_id", "label"), ["origin", "nct_id"])
            .join(tall, ["origin", "nct_id"], "left")
        )
        zero = [f"{e}_{h}" for e in ENTITY_TYPES for h in ("prior_trial_count", "entity_count", "history_entity_count")]
        return rows.fillna(0.0, zero).transform(cut)


def _date(text: str):
    from datetime import date

    return date.fromisoformat(text)
