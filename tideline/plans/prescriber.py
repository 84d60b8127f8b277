"""Prescriber-drug study: annual ranking of first-observed prescriber-drug relations.

Rows are (year, npi, brand, generic, claims, cost, specialty, state).  A drug is
identified by a struct whose field order is the sort order, so the generic
identity is ``struct<generic>`` and the variant identity ``struct<brand, generic>``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tideline.functions.ordering import running_totals
from tideline.functions.scalar import claim_band, claims_error, cost_error, log1p, normalize_name, npi_error, ratio, stable_hex
from tideline.operators.candidates import candidate_grid, candidate_lists, lowest_candidates
from tideline.operators.ranking import CUTOFFS, entity_metrics, full_ranks, pooled_metrics, sparse_ranks
from tideline.operators.temporal import first_seen
from tideline.operators.twohop import two_hop_ranks, two_hop_scores, two_hop_sets
from tideline.session import cut
from tideline.sources import bindings, records

YEARS = (1996, 1997, 1998, 1999, 2000, 2001)
#: Columns of an annual source file.
ANNUAL = ("npi", "brand", "generic", "claims", "cost", "specialty", "state")
#: Size of the bounded cohorts that the cohort queries show; studies score all entities unless told otherwise.
COHORT = 2000
# Names that the results carry, in their order.
FEATURES = (
    "log_global_provider_support",
    "log_global_claim_total",
    "log_global_claim_mean",
    "log_provider_history_size",
    "log_provider_claim_total",
    "log_drug_history_year_count",
    "log_drug_age_years",
    "log_specialty_provider_support",
    "specialty_provider_fraction",
    "target_specialty_available",
)
HIGH_SCORE_QUANTILE = 0.95
TRANSFORMATION = "prescriber_drug_edge_v1"


def hash_cohort(ids: DataFrame, column: str, size: int | None) -> DataFrame:
    """The ``size`` distinct ids with the smallest (SHA-256, id): a bounded top-k, no full sort; all ids without a size."""
    distinct = ids.select(column).distinct()
    if size is None:
        return distinct
    return distinct.withColumn("_h", F.sha2(F.col(column), 256)).orderBy("_h", column).limit(size).drop("_h")


def dynamic_cohorts(first_years: DataFrame, targets: list[int], size: int | None) -> DataFrame:
    """(target, npi): per target year, the hash cohort of ids first seen strictly earlier."""
    if size is None:
        later = F.filter(F.array(*[F.lit(t).cast("long") for t in targets]), lambda t: t > F.col("first"))
        return first_years.select(F.explode(later).alias("target"), "npi")
    parts = [
        hash_cohort(first_years.filter(F.col("first") < t), "npi", size).select(
            F.lit(t).cast("long").alias("target"), "npi"
        )
        for t in targets
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class PrescriberStudy:
    rows: DataFrame
    years: tuple[int, ...] = YEARS
    cohort_size: int | None = None
    _drugs: dict = field(default_factory=dict)
    _made: dict = field(default_factory=dict)

    @classmethod
    def bound(cls, spark: SparkSession, root: str, cohort_size: int | None = None) -> "PrescriberStudy":
        return cls(bindings.prescriber_rows(spark, root), cohort_size=cohort_size)

    @classmethod
    def from_files(cls, spark: SparkSession, paths: dict[int, str], cohort_size: int | None = None) -> "PrescriberStudy":
        """The study of annual CSV sources, by year; rows keep the name of their source and their place in it."""
        parts = [records.read_annual(spark, path, list(ANNUAL), year=year, source_path=path.rstrip("/").rsplit("/", 1)[-1]) for year, path in sorted(paths.items())]
        text = reduce(DataFrame.unionByName, parts)
        problems = F.array_compact(
            F.array(*[F.when(c, F.lit(n)) for n, c in (("npi", npi_error(F.col("npi"))), ("claims", claims_error(F.col("claims"))), ("cost", cost_error(F.col("cost"))))])
        )
        what = F.concat(F.lit("malformed "), F.array_join(problems, ", "), F.lit(" in "), F.col("source_path"), F.lit(" row "), F.col("source_row").cast("string"))
        sound = text.filter(F.when(F.size(problems) > 0, F.raise_error(what).cast("boolean")).otherwise(True))
        rows = sound.select(
            F.col("year").cast("long").alias("year"), "npi", F.trim("brand").alias("brand"), F.trim("generic").alias("generic"), F.trim("claims").cast("long").alias("claims"),
            F.trim("cost").try_cast("double").alias("cost"), F.trim("specialty").alias("specialty"), F.trim("state").alias("state"), "source_path", "source_row",
        )
        return cls(rows.transform(cut), years=tuple(sorted(paths)), cohort_size=cohort_size)

    @property
    def score_years(self) -> list[int]:
        return list(self.years[max(1, len(self.years) - 3) :])

    # ------------------------------------------------------------ cohort and edges

    @cached_property
    def cohorts(self) -> DataFrame:
        """(target, npi) for every scored year; one fixed cohort when three years or fewer exist."""
        if len(self.years) > 3:
            seen = first_seen(self.rows.filter(F.col("year") < max(self.score_years)), ["npi"], "year")
            return dynamic_cohorts(seen, self.score_years, self.cohort_size).transform(cut)
        fixed = hash_cohort(self.rows.filter(F.col("year") == self.years[0]), "npi", self.cohort_size)
        targets = F.explode(F.array(*[F.lit(t).cast("long") for t in self.score_years]))
        return fixed.select(targets.alias("target"), "npi").transform(cut)

    @cached_property
    def cohort(self) -> DataFrame:
        return self.cohorts.select("npi").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """Rows of the union cohort."""
        return self.rows.join(self.cohort, "npi", "left_semi").transform(cut)

    def export(self) -> DataFrame:
        """The fifteen-column edge table with half-open yearly validity; edges read from files name their source row."""
        lineage = "source_row" in self.rows.columns
        return self.edges.select(
            "npi",
            F.col("brand").alias("brand_name"),
            F.col("generic").alias("generic_name"),
            "year",
            "claims",
            F.format_string("%.2f", "cost").alias("cost"),
            "specialty",
            "state",
            F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)).alias("valid_from"),
            F.make_date((F.col("year") + 1).cast("int"), F.lit(1), F.lit(1)).alias("valid_to"),
            F.lit("bound").alias("observed_at"),
            F.col("source_path") if lineage else F.concat(F.lit("year="), F.col("year").cast("string")).alias("source_path"),
            F.col("source_row") if lineage else F.lit(None).cast("long").alias("source_row"),
            F.sha2(F.concat_ws("|", "npi", "brand", "generic"), 256).alias("source_sha256"),
            F.lit(TRANSFORMATION).alias("transformation"),
        )

    # ------------------------------------------------------------ identity projection

    def projected(self, kind: str) -> DataFrame:
        """(year, npi, drug, claims, specialties): claims summed, specialties united per key."""
        if kind not in self._drugs:
            rows = self.edges
            if kind == "generic":
                rows = rows.filter("generic <> ''")
                drug = F.struct(F.col("generic").alias("generic"))
            elif kind == "variant":
                drug = F.struct(F.col("brand").alias("brand"), F.col("generic").alias("generic"))
            else:
                raise ValueError(f"unsupported drug identity {kind!r}")
            self._drugs[kind] = (
                rows.groupBy("year", "npi", drug.alias("drug"))
                .agg(
                    F.sum("claims").alias("claims"),
                    F.array_sort(F.collect_set(F.when(F.col("specialty") != "", F.col("specialty")))).alias("specialties"),
                )
                .transform(cut)
            )
        return self._drugs[kind]

    # ------------------------------------------------------------ history at a target year

    def before(self, kind: str, targets: list[int]) -> DataFrame:
        """Projected rows of each target's own cohort in the years before it."""
        return (
            self.projected(kind)
            .join(self.cohorts.filter(F.col("target").isin(targets)), "npi")
            .filter(F.col("year") < F.col("target"))
            .transform(cut)
        )

    def _once(self, name: str, history: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of a history, written when first asked for."""
        key = (name, id(history))
        if key not in self._made:
            self._made[key] = (history, make().transform(cut))
        return self._made[key][1]

    def holdings(self, history: DataFrame) -> DataFrame:
        """(target, npi, drug, own_claims)."""
        return self._once("holdings", history, lambda: history.groupBy("target", "npi", "drug").agg(F.sum("claims").alias("own_claims")))

    def drug_state(self, history: DataFrame) -> DataFrame:
        """Per (target, drug): providers, claims, distinct years, last year."""

        def make() -> DataFrame:
            held = self.holdings(history).groupBy("target", "drug").agg(F.count("*").alias("support"), F.sum("own_claims").alias("drug_claims"))
            years = history.groupBy("target", "drug", "year").agg(F.lit(1).alias("_one")).groupBy("target", "drug").agg(
                F.count("*").alias("drug_years"), F.max("year").alias("last_year")
            )
            return held.join(years, ["target", "drug"])

        return self._once("drug_state", history, make)

    def provider_state(self, history: DataFrame) -> DataFrame:
        state = self.holdings(history).groupBy("target", "npi").agg(F.count("*").alias("own_drugs"), F.sum("own_claims").alias("provider_claims"))
        return state.join(self.latest_specialty(history), ["target", "npi"])

    def latest_specialty(self, history: DataFrame) -> DataFrame:
        """(target, npi, latest_specialty): of the last observed year, NULL unless it is unique."""

        def make() -> DataFrame:
            yearly = history.groupBy("target", "npi", "year").agg(
                F.array_distinct(F.flatten(F.collect_set("specialties"))).alias("s")
            )
            last = yearly.groupBy("target", "npi").agg(F.max_by("s", "year").alias("s"))
            return last.select("target", "npi", F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("latest_specialty"))

        return self._once("latest_specialty", history, make)

    def specialty_support(self, history: DataFrame) -> DataFrame:
        """(target, latest_specialty, drug, specialty_support)."""

        def make() -> DataFrame:
            known = self.latest_specialty(history).filter("latest_specialty is not null")
            return self.holdings(history).join(known, ["target", "npi"]).groupBy("target", "latest_specialty", "drug").agg(
                F.count("*").alias("specialty_support")
            )

        return self._once("specialty_support", history, make)

    # ------------------------------------------------------------ candidates, positives, scores

    def positives(self, kind: str, history: DataFrame, targets: list[int]) -> DataFrame:
        """(target, npi, drug, claims): current relations new to the provider, known globally, provider known."""
        held = self.holdings(history)
        current = (
            self.projected(kind)
            .withColumnRenamed("year", "target")
            .filter(F.col("target").isin(targets))
            .join(self.cohorts, ["target", "npi"], "left_semi")
        )
        return (
            current.join(held, ["target", "npi", "drug"], "left_anti")
            .join(self.drug_state(history), ["target", "drug"], "left_semi")
            .select("target", "npi", "drug", "claims")
            .transform(cut)
        )

    def candidates(self, history: DataFrame) -> DataFrame:
        """(target, npi, drug, support, own state): every prior cohort drug the provider never held."""
        heads = self.provider_state(history)
        items = self.drug_state(history)
        return candidate_grid(heads, items, self.holdings(history), "target", "npi", "drug")

    def overlap_scores(self, history: DataFrame) -> DataFrame:
        """(target, npi, drug, overlap): Jaccard sums over peers holding the drug."""
        held = self.holdings(history).select(F.col("target").alias("period"), F.col("npi").alias("entity"), F.col("drug").alias("item"))
        return two_hop_scores(held, kind="jaccard").select(
            F.col("period").alias("target"), F.col("entity").alias("npi"), F.col("item").alias("drug"), F.round("score", 12).alias("overlap")
        )

    def heuristic_scores(self, history: DataFrame) -> DataFrame:
        """All candidates with the global, specialty and overlap scores and the fallback flag."""
        names = {"target": "period", "npi": "entity", "drug": "item"}
        of = two_hop_sets(self.holdings(history).withColumnsRenamed(names).select("period", "entity", "item"), kind="jaccard")
        entry = F.struct(F.col("item").alias("key"), F.round("score", 12).alias("value"))
        near = of.found.join(of.ids, "id").groupBy("period", "no").agg(F.map_from_entries(F.collect_list(entry)).alias("_near"))
        near = of.members.join(near, ["period", "no"], "left").select(F.col("period").alias("target"), F.col("entity").alias("npi"), "_near")
        heads = self.provider_state(history).join(near, ["target", "npi"], "left")
        grid = candidate_grid(heads, self.drug_state(history), self.holdings(history), "target", "npi", "drug")
        grid = grid.withColumn("overlap", F.element_at("_near", F.col("drug"))).drop("_near")
        return (
            grid.join(self.specialty_support(history), ["target", "latest_specialty", "drug"], "left")
            .select(
                *[c for c in grid.columns if c != "overlap"],
                F.coalesce("specialty_support", F.lit(0)).alias("specialty_support"),
                F.col("support").cast("double").alias("global_popularity"),
                F.when(F.col("latest_specialty").isNull(), F.col("support"))
                .otherwise(F.coalesce("specialty_support", F.lit(0)))
                .cast("double")
                .alias("specialty_popularity"),
                F.coalesce("overlap", F.lit(0.0)).alias("history_overlap"),
            )
        )

    def features(self, pairs: DataFrame) -> DataFrame:
        """Ten features with the provider's own contribution left out.

        ``pairs`` carries drug_state, provider_state, ``specialty_support`` and
        ``own_claims`` (NULL where the provider does not hold the drug).
        """
        own = F.col("own_claims").isNotNull().cast("int")
        support = F.col("support") - own
        claims = F.col("drug_claims") - F.coalesce("own_claims", F.lit(0))
        known = F.col("latest_specialty").isNotNull()
        spec = F.when(known, F.coalesce("specialty_support", F.lit(0)) - own).otherwise(0)
        values = {
            "log_global_provider_support": log1p(F.greatest(F.lit(0), support)),
            "log_global_claim_total": log1p(F.greatest(F.lit(0), claims)),
            "log_global_claim_mean": log1p(F.greatest(F.lit(0.0), claims / F.greatest(F.lit(1), support))),
            "log_provider_history_size": log1p(F.col("own_drugs")),
            "log_provider_claim_total": log1p(F.col("provider_claims")),
            "log_drug_history_year_count": log1p(F.col("drug_years")),
            "log_drug_age_years": log1p(F.greatest(F.lit(0), F.col("target") - F.col("last_year"))),
            "log_specialty_provider_support": log1p(F.greatest(F.lit(0), spec)),
            "specialty_provider_fraction": F.when(known, spec / F.greatest(F.lit(1), support)).otherwise(0.0),
            "target_specialty_available": known.cast("double"),
        }
        return pairs.select("*", *[values[name].alias(name) for name in FEATURES])

    def training_rows(self, history: DataFrame, negative_ratio: int = 5) -> DataFrame:
        """Held drugs as positives, the hash-lowest candidates as negatives, with feature inputs."""
        state = self.provider_state(history)
        support = self.specialty_support(history)
        keys = ["target", "npi", "drug"]
        positives = (
            self.holdings(history)
            .join(state, ["target", "npi"])
            .join(self.drug_state(history), ["target", "drug"])
            .withColumn("label", F.lit(1))
        )
        token = lambda drug: F.array_join(F.array(*[drug[f] for f in _fields(history)]), "\x1f")
        order = lambda drug: stable_hex("tabular-negative", F.col("target"), F.col("npi"), token(drug))
        lists = candidate_lists(state, self.drug_state(history), self.holdings(history), "target", "npi", "drug")
        negatives = (
            lowest_candidates(lists, "target", "npi", "drug", order, negative_ratio * F.col("own_drugs"))
            .withColumn("own_claims", F.lit(None).cast("long"))
            .withColumn("label", F.lit(0))
        )
        rows = positives.unionByName(negatives.select(*positives.columns))
        return rows.join(support, ["target", "latest_specialty", "drug"], "left").select(
            *keys, *[c for c in rows.columns if c not in keys], "specialty_support"
        )

    # ------------------------------------------------------------ evaluation

    def ranked_positives(self, scored: DataFrame, positives: DataFrame, methods: list[str]) -> DataFrame:
        """(method, target, npi, drug, claims, rank)."""
        tall = scored.select(
            "target", "npi", "drug", "support",
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])
            ).alias("m"),
        ).select("target", "npi", "drug", "support", "m.*")
        ranked = full_ranks(tall, ["method", "target", "npi"], "score", "support", "drug")
        return ranked.join(positives, ["target", "npi", "drug"]).select(
            "method", "target", "npi", "drug", "claims", F.col("rank").cast("long").alias("rank")
        )

    def heuristic_ranks(self, history: DataFrame, positives: DataFrame, methods: list[str]) -> DataFrame:
        """(method, target, npi, drug, claims, rank) without the candidate grid.

        Every heuristic orders all candidates by a catalogue, one for each target year, or one for each year and
        specialty; only the overlap has scores of its own.  A positive's rank is its place less what the provider
        already holds before it.
        """
        names = {"npi": "entity", "drug": "item"}
        support = self.drug_state(history).select("target", F.col("drug").alias("item"), "support")
        held = self.holdings(history).withColumnsRenamed(names).select("target", "entity", "item")
        wanted = positives.withColumnsRenamed(names).select("target", "entity", "item")
        out = None
        for method in methods:
            if method == "specialty_popularity":
                own = self.latest_specialty(history).select("target", F.col("npi").alias("entity"), "latest_specialty")
                period = F.to_json(F.struct("target", "latest_specialty"))
                kinds = own.join(wanted, ["target", "entity"], "left_semi").select("target", "latest_specialty").distinct()
                known = self.specialty_support(history).select("target", "latest_specialty", F.col("drug").alias("item"), "specialty_support")
                catalogue = kinds.join(support.withColumnRenamed("support", "second"), "target").join(known, ["target", "latest_specialty", "item"], "left")
                score = F.when(F.col("latest_specialty").isNull(), F.col("second")).otherwise(F.coalesce("specialty_support", F.lit(0)))
                catalogue = catalogue.select(period.alias("period"), "item", score.alias("support"), "second")
                place = lambda rows: rows.join(own, ["target", "entity"]).select(period.alias("period"), "target", "entity", "item")  # noqa: B023, E731
                ranks = sparse_ranks(place(wanted).drop("target"), place(held).drop("target"), catalogue)
                ranks = ranks.withColumn("target", F.get_json_object("period", "$.target").cast("long"))
            else:
                at_target = lambda rows: rows.withColumnRenamed("target", "period")
                ranker = two_hop_ranks if method == "history_overlap" else lambda held, wanted, catalogue: sparse_ranks(wanted, held, catalogue)
                ranks = ranker(at_target(held), at_target(wanted), at_target(support)).withColumnRenamed("period", "target")
            rows = ranks.select(F.lit(method).alias("method"), "target", F.col("entity").alias("npi"), F.col("item").alias("drug"), "rank")
            out = rows if out is None else out.unionByName(rows)
        return out.join(positives, ["target", "npi", "drug"]).select("method", "target", "npi", "drug", "claims", "rank")

    def top_recommendations(self, scored: DataFrame, methods: list[str], k: int = CUTOFFS[-1]) -> DataFrame:
        """(method, target, npi, drug, score, rank) of the best ``k`` candidates."""
        tall = scored.select(
            "target", "npi", "drug", "support",
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])
            ).alias("m"),
        ).select("target", "npi", "drug", "support", "m.*")
        return full_ranks(tall, ["method", "target", "npi"], "score", "support", "drug").filter(F.col("rank") <= k)

    def provider_metrics(self, ranked: DataFrame, banded: bool = False) -> DataFrame:
        """Per (method, target, npi) metrics, optionally also per claim band."""
        if banded:
            band = F.explode(F.array(F.lit("all"), claim_band(F.col("claims"))))
            return entity_metrics(ranked.withColumn("band", band), ["method", "target", "npi", "band"])
        return entity_metrics(ranked, ["method", "target", "npi"])

    def pooled(self, entities: DataFrame, keys: list[str]) -> DataFrame:
        """By-year and pooled rows (``scope``) in one aggregation."""
        scope = F.explode(F.array(F.col("target").cast("string"), F.lit("pooled")))
        rows = entities.withColumn("scope", scope)
        return pooled_metrics(rows, [*keys, "scope"], extra=[F.countDistinct("npi").alias("providers")])

    def paired_recall(self, entities: DataFrame, baseline: str) -> DataFrame:
        """Mean provider-year Recall@10 difference of every other method against ``baseline``."""
        base = entities.filter(F.col("method") == baseline).select(
            "target", "npi", F.col("recall_at_10").alias("base_recall")
        )
        pairs = entities.filter(F.col("method") != baseline).join(base, ["target", "npi"])
        scope = F.explode(F.array(F.col("target").cast("string"), F.lit("pooled")))
        return pairs.withColumn("scope", scope).groupBy("method", "scope").agg(
            F.avg(F.col("recall_at_10") - F.col("base_recall")).alias("mean_difference"),
            F.count("*").alias("provider_years"),
        )

    def high_score_thresholds(self, scored: DataFrame, methods: list[str], quantile: float = HIGH_SCORE_QUANTILE):
        """(method, target, threshold): the candidate score at position ceil(q*(n-1)) of the ascending order.

        Candidates are collapsed to distinct scores first; the order statistic
        is then read off the running counts.
        """
        tall = scored.select(
            "target",
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in methods])
            ).alias("m"),
        ).select("target", "m.*")
        counts = tall.groupBy("method", "target", "score").agg(F.count("*").alias("n"))
        sizes = counts.groupBy("method", "target").agg(F.sum("n").alias("total"))
        walked = running_totals(counts, ["method", "target"], ["score"], {"upto": F.col("n")})
        place = F.ceil(F.lit(quantile) * (F.col("total") - 1))
        return (
            walked.join(sizes, ["method", "target"])
            .filter(F.col("upto") > place)
            .groupBy("method", "target")
            .agg(F.min("score").alias("threshold"))
        )

    def load_metrics(
        self, top: DataFrame, positives: DataFrame, history: DataFrame, grid: DataFrame, thresholds: DataFrame, targets: list[int]
    ) -> DataFrame:
        """Recommendation load over the whole cohort, by year: slots, hits, precision, burden, zero-positive counts."""
        cohort = self.cohorts.filter(F.col("target").isin(targets))
        known = self.holdings(history).select("target", "npi").distinct().withColumn("eligible", F.lit(1))
        n_pos = positives.groupBy("target", "npi").agg(F.count("*").alias("n_pos"))
        n_cand = grid.groupBy("target", "npi").agg(F.count("*").alias("n_cand"))
        people = (
            cohort.join(known, ["target", "npi"], "left")
            .join(n_pos, ["target", "npi"], "left")
            .join(n_cand, ["target", "npi"], "left")
            .fillna(0, ["eligible", "n_pos", "n_cand"])
        )
        base = people.groupBy("target").agg(
            F.count("*").alias("target_provider_years"),
            F.sum("eligible").alias("eligible_provider_years"),
            F.sum(1 - F.col("eligible")).alias("ineligible_provider_years"),
            F.count_if((F.col("eligible") == 1) & (F.col("n_cand") == 0)).alias("candidate_empty_provider_years"),
            F.count_if((F.col("eligible") == 1) & (F.col("n_pos") == 0)).alias("positive_empty_provider_years"),
        )
        hit = positives.select("target", "npi", "drug", F.lit(1).alias("hit"))
        marked = top.join(hit, ["target", "npi", "drug"], "left").join(thresholds, ["method", "target"])
        per = marked.groupBy("method", "target", "npi").agg(
            *[F.count_if(F.col("rank") <= k).alias(f"slots_{k}") for k in CUTOFFS],
            *[F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias(f"hits_{k}") for k in CUTOFFS],
            *[F.max(((F.col("rank") <= k) & (F.col("score") >= F.col("threshold"))).cast("int")).alias(f"high_{k}") for k in CUTOFFS],
        ).join(people.select("target", "npi", "n_pos"), ["target", "npi"])
        zero = F.col("n_pos") == 0
        sums = per.groupBy("method", "target").agg(
            *[F.sum(f"slots_{k}").alias(f"slots_at_{k}") for k in CUTOFFS],
            *[F.sum(f"hits_{k}").alias(f"hits_at_{k}") for k in CUTOFFS],
            *[F.count_if(zero & (F.col(f"slots_{k}") > 0)).alias(f"zero_positive_at_{k}") for k in CUTOFFS],
            *[F.count_if(zero & (F.col(f"high_{k}") == 1)).alias(f"zero_positive_high_at_{k}") for k in CUTOFFS],
        )
        return sums.join(base, "target").select(
            "*",
            *[ratio(F.col(f"hits_at_{k}"), F.col(f"slots_at_{k}")).alias(f"precision_at_{k}") for k in CUTOFFS],
            *[ratio(F.col(f"slots_at_{k}"), F.col("target_provider_years")).alias(f"burden_target_at_{k}") for k in CUTOFFS],
            *[ratio(F.col(f"slots_at_{k}"), F.col("eligible_provider_years")).alias(f"burden_eligible_at_{k}") for k in CUTOFFS],
            *[ratio(F.col(f"zero_positive_at_{k}"), F.col("positive_empty_provider_years")).alias(f"zero_fraction_at_{k}") for k in CUTOFFS],
            *[ratio(F.col(f"zero_positive_high_at_{k}"), F.col("positive_empty_provider_years")).alias(f"zero_high_fraction_at_{k}") for k in CUTOFFS],
        )

    # ------------------------------------------------------------ audits and diagnostics

    def annual_audit(self) -> DataFrame:
        """One row per year over exact (brand, generic) identities of the retained rows."""
        rows = self.projected("variant").select("year", "npi", "drug")
        pair = first_seen(rows, ["npi", "drug"], "year", "pair_first")
        drug = first_seen(rows, ["drug"], "year", "drug_first")
        previous = W.partitionBy("npi", "drug").orderBy("year")
        marked = (
            rows.withColumn("last", F.lag("year").over(previous))
            .join(pair, ["npi", "drug"])
            .join(drug, "drug")
        )
        new_pair = F.col("pair_first") == F.col("year")
        new_drug = new_pair & (F.col("drug_first") == F.col("year"))
        gap = ~new_pair & (F.col("last") < F.col("year") - 1)
        size = self.cohort.agg(F.count("*").alias("cohort_size"))
        per_year = marked.groupBy("year").agg(
            F.countDistinct("npi").alias("observed_npis"),
            F.countDistinct("drug").alias("retained_drugs"),
            F.count("*").alias("retained_edges"),
            F.count_if(new_pair).alias("first_observed_edges"),
            F.count_if(new_drug).alias("globally_new_edges"),
            F.countDistinct(F.when(new_drug, F.col("drug"))).alias("globally_new_drugs"),
            F.count_if(gap).alias("recurrent_after_gap"),
        )
        return per_year.withColumn("cohort_size", size.scalar()).withColumn(
            "disappeared_npis", F.col("cohort_size") - F.col("observed_npis")
        )

    def claim_bands(self, positives: DataFrame) -> DataFrame:
        """(year, band, all_rows, eligible_positives)."""
        rows = self.edges.groupBy("year", claim_band(F.col("claims")).alias("band")).agg(F.count("*").alias("all_rows"))
        good = positives.groupBy(F.col("target").alias("year"), claim_band(F.col("claims")).alias("band")).agg(
            F.count("*").alias("eligible_positives")
        )
        return rows.join(good, ["year", "band"], "left").fillna(0, ["eligible_positives"])

    def year_overlap(self) -> DataFrame:
        """(year_a, year_b, intersection, union, jaccard) of the yearly drug sets."""
        drugs = self.edges.select("year", "brand", "generic").distinct()
        sizes = drugs.groupBy("year").agg(F.count("*").alias("n"))
        spans = drugs.groupBy("brand", "generic").agg(F.collect_set("year").alias("ys"))
        both = spans.select(F.explode("ys").alias("year_a"), "ys").select(
            "year_a", F.explode("ys").alias("year_b")
        ).filter("year_a < year_b")
        shared = both.groupBy("year_a", "year_b").agg(F.count("*").alias("intersection_count"))
        later = F.filter(F.array(*[F.lit(y).cast("long") for y in self.years]), lambda y: y > F.col("year_a"))
        a = sizes.withColumnsRenamed({"year": "year_a", "n": "na"}).withColumn("year_b", F.explode(later))
        b = sizes.withColumnsRenamed({"year": "year_b", "n": "nb"})
        union = F.col("na") + F.col("nb") - F.coalesce("intersection_count", F.lit(0))
        years = a.join(b, "year_b").join(shared, ["year_a", "year_b"], "left")
        return years.select(
            "year_a", "year_b",
            F.coalesce("intersection_count", F.lit(0)).alias("intersection_count"),
            union.alias("union_count"),
            ratio(F.coalesce("intersection_count", F.lit(0)), union).alias("jaccard"),
        )

    def coverage(self) -> DataFrame:
        """Specialty consistency of provider-years and state counts, as (measure, value) rows."""
        spec = F.when(F.col("specialty") != "", F.col("specialty"))
        per = self.edges.groupBy("year", "npi").agg(F.countDistinct(spec).alias("k"))
        people = per.agg(
            F.count("*").alias("provider_years"),
            F.count_if(F.col("k") == 1).alias("provider_years_consistent"),
            F.count_if(F.col("k") > 1).alias("provider_years_conflicting"),
            F.count_if(F.col("k") == 0).alias("provider_years_all_blank"),
        )
        rows = self.edges.agg(
            F.count("*").alias("rows"),
            F.count(spec).alias("specialty_nonblank_rows"),
            F.countDistinct(spec).alias("specialty_values"),
            F.count_if(F.col("state") != "").alias("state_nonblank_rows"),
        )
        wide = [(people, people.columns), (rows, rows.columns)]
        parts = [
            df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in cols])).alias("m")).select("m.*")
            for df, cols in wide
        ]
        states = self.edges.filter("state <> ''").groupBy(F.concat(F.lit("state:"), "state").alias("measure")).agg(
            F.count("*").alias("value")
        )
        return parts[0].unionByName(parts[1]).unionByName(states)

    def identity_diagnostics(self) -> DataFrame:
        """Counts of name instability under case-folded, whitespace-collapsed tokens."""
        rows = self.edges.select("npi", "year", "brand", "generic").withColumns(
            {"brand_token": normalize_name(F.col("brand")), "generic_token": normalize_name(F.col("generic"))}
        )
        named = rows.filter("generic <> ''")
        branded = rows.filter("brand <> ''")

        def many(df: DataFrame, key: str, value: Column) -> DataFrame:
            return df.groupBy(key).agg(F.countDistinct(value).alias("k")).agg(
                F.count("*").alias("total"), F.count_if(F.col("k") > 1).alias("many")
            )

        parts = {
            "brands_with_multiple_generics": many(branded, "brand", F.col("generic")),
            "generics_with_multiple_brands": many(named, "generic", F.col("brand")),
            "generic_tokens_with_multiple_spellings": many(named, "generic_token", F.col("generic")),
            "brand_tokens_with_multiple_spellings": many(branded, "brand_token", F.col("brand")),
            "generic_tokens_with_multiple_signatures": many(named, "generic_token", F.struct("brand", "generic")),
        }
        out = None
        for name, df in parts.items():
            row = df.select(F.lit(name).alias("measure"), F.col("total"), F.col("many").alias("value"))
            out = row if out is None else out.unionByName(row)
        years = rows.groupBy("brand", "generic").agg(F.countDistinct("year").alias("k")).agg(
            F.lit("signatures_in_multiple_years").alias("measure"),
            F.count("*").alias("total"),
            F.count_if(F.col("k") > 1).alias("value"),
        )
        collapsed = rows.agg(
            F.lit("edges_collapsed_by_generic").alias("measure"),
            F.countDistinct(F.struct("npi", "brand", "generic")).alias("total"),
            (
                F.countDistinct(F.struct("npi", "brand", "generic"))
                - F.countDistinct(F.when(F.col("generic") != "", F.struct("npi", "generic")))
            ).alias("value"),
        )
        return out.unionByName(years).unionByName(collapsed)


def _fields(history: DataFrame) -> list[str]:
    return history.schema["drug"].dataType.names
