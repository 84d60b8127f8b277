"""Device-report study: quarterly ranking of first-observed product-problem edges."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tideline.functions.scalar import log1p, quarter_label, stable_hex, support_band
from tideline.operators.candidates import candidate_grid, candidate_lists, lowest_candidates
from tideline.operators.ranking import entity_metrics, full_ranks, pooled_metrics, sparse_ranks
from tideline.operators.temporal import accumulate, first_seen, recent_distinct, recent_sum
from tideline.operators.twohop import two_hop_ranks, two_hop_scores
from tideline.session import cut, dealt
from tideline.sources import bindings
from tideline.sources.bindings import DeviceWindow

# Names that the results carry, in their order.
FEATURES = (
    "product_log_prior_reports",
    "problem_log_prior_reports",
    "problem_log_product_prevalence",
    "neighbor_log_product_count",
    "recent_problem_log_product_count",
    "recent_problem_prevalence_fraction",
    "product_log_manufacturer_count",
    "manufacturer_log_product_activity",
    "product_age_quarters",
    "problem_age_quarters",
    "parent_log_product_prevalence",
    "product_recent_report_fraction",
)
RECENT = 4
THRESHOLDS = (1, 10, 50)
BANDS = ("1-9", "10-49", "50-199", "200+")


@dataclass
class DeviceStudy:
    """Tables of the study over (key, quarter, product, manufacturer) and (key, problem) rows."""

    devices: DataFrame
    problems: DataFrame
    parents: DataFrame
    window: DeviceWindow = field(default_factory=DeviceWindow)

    @classmethod
    def bound(cls, spark: SparkSession, root: str, window: DeviceWindow | None = None) -> "DeviceStudy":
        return cls(
            bindings.device_rows(spark, root),
            bindings.problem_rows(spark, root),
            bindings.problem_parents(spark, root),
            window or DeviceWindow(),
        )

    # ------------------------------------------------------------ snapshots

    @cached_property
    def keyed(self) -> DataFrame:
        """(key, reports, problems): each reported key with its distinct (product, quarter) and its distinct codes."""
        reports = self.devices.groupBy("key").agg(F.collect_set(F.struct("product", "quarter")).alias("reports"))
        codes = self.problems.groupBy("key").agg(F.collect_set("problem").alias("problems"))
        return reports.join(codes, "key", "left").transform(cut)

    @cached_property
    def reports(self) -> DataFrame:
        """Distinct (key, quarter, product)."""
        return self.keyed.select("key", F.explode("reports").alias("r")).select("key", "r.quarter", "r.product")

    @cached_property
    def edges(self) -> DataFrame:
        """(product, problem, quarter, n_reports, first, following): the edges by quarter, their first and their next quarter.

        The pairs are dealt once, by edge, to as many tasks as their number asks for; all that is needed of an edge's
        other quarters is written beside each row.
        """
        pairs = self.keyed.filter("problems is not null")
        n = pairs.agg(F.sum((F.size("reports") * F.size("problems")).cast("long"))).first()[0] or 0
        rows = pairs.select(F.explode("reports").alias("r"), "problems").select("r.product", F.explode("problems").alias("problem"), "r.quarter")
        edge = W.partitionBy("product", "problem")
        return (
            dealt(rows, n, "product", "problem")
            .groupBy("product", "problem", "quarter")
            .agg(F.count("*").alias("n_reports"))
            .withColumns({"following": F.lead("quarter").over(edge.orderBy("quarter")), "first": F.min("quarter").over(edge.orderBy("quarter"))})
            .transform(cut)
        )

    @cached_property
    def edge_quarter(self) -> DataFrame:
        """(product, problem, quarter, n_reports): distinct reports naming both."""
        return self.edges.select("product", "problem", "quarter", "n_reports")

    @cached_property
    def product_quarter(self) -> DataFrame:
        return self.reports.groupBy("product", "quarter").agg(F.count("*").alias("n_reports"))

    @cached_property
    def quarter_reports(self) -> DataFrame:
        quarters = F.array_distinct(F.transform("reports", lambda r: r["quarter"]))
        return self.keyed.select(F.explode(quarters).alias("quarter")).groupBy("quarter").agg(F.count("*").alias("n_reports"))

    @cached_property
    def product_quarter_manufacturer(self) -> DataFrame:
        return self.devices.filter("manufacturer <> ''").select("product", "quarter", "manufacturer").distinct()

    def snapshot(self) -> DataFrame:
        """One row per quarter: reports, products, makers, edges and edge reports."""
        q = self.quarter_reports
        p = self.product_quarter.groupBy("quarter").agg(
            F.count("*").alias("products"), F.sum("n_reports").alias("product_reports")
        )
        m = self.product_quarter_manufacturer.groupBy("quarter").agg(F.count("*").alias("product_makers"))
        e = self.edge_quarter.groupBy("quarter").agg(
            F.count("*").alias("edges"), F.sum("n_reports").alias("edge_reports")
        )
        return q.join(p, "quarter", "left").join(m, "quarter", "left").join(e, "quarter", "left")

    def match_audit(self) -> DataFrame:
        d = self.devices.select("key").distinct().withColumn("d", F.lit(1))
        p = self.problems.select("key").distinct().withColumn("p", F.lit(1))
        both = d.join(p, "key", "full_outer")
        return both.agg(
            F.count("d").alias("device_keys"),
            F.count_if(F.col("d").isNotNull() & F.col("p").isNotNull()).alias("matched_keys"),
            F.count_if(F.col("d").isNull()).alias("problem_only_keys"),
        )

    def multiplicity_audit(self) -> DataFrame:
        per_key = self.devices.groupBy("key").agg(F.count("*").alias("n_rows"), F.size(F.collect_set("product")).alias("n_products"))
        devices = per_key.agg(
            F.count("*").alias("device_keys"),
            F.sum("n_rows").alias("device_rows"),
            F.count_if(F.col("n_rows") > 1).alias("keys_multiple_rows"),
            F.sum(F.col("n_rows") - F.col("n_products")).alias("duplicate_rows"),
            F.count_if(F.col("n_products") > 1).alias("keys_multiple_products"),
            F.max("n_rows").alias("max_rows_per_key"),
            F.max("n_products").cast("long").alias("max_products_per_key"),
        )
        codes = self.problems.groupBy("key").agg(F.size(F.collect_set("problem")).cast("long").alias("count"))
        problems = codes.agg(
            F.count_if(F.col("count") > 1).alias("problem_keys_multiple_codes"),
            F.max("count").alias("max_codes_per_key"),
        )
        edges = self.edge_first.agg(
            F.count("*").alias("unique_edges"),
            F.countDistinct("product").alias("edge_products"),
            F.countDistinct("problem").alias("edge_problems"),
        )
        one = F.lit(1).alias("one")
        return (
            devices.select("*", one).join(problems.select("*", one), "one").join(edges.select("*", one), "one").drop("one")
        )

    # ------------------------------------------------------------ first occurrence

    @cached_property
    def edge_first(self) -> DataFrame:
        """(product, problem, first): when the edge was first observed."""
        return self.edges.filter("quarter = first").select("product", "problem", "first")

    @cached_property
    def product_first(self) -> DataFrame:
        """(product, first) from reports, with or without a problem code."""
        return first_seen(self.devices, ["product"], "quarter", "product_first").transform(cut)

    @cached_property
    def problem_first(self) -> DataFrame:
        return first_seen(self.edge_first, ["problem"], "first", "problem_first").transform(cut)

    @cached_property
    def eligible(self) -> DataFrame:
        """(q, product, problem): first-observed edges whose two ends were known before q."""
        return (
            self.edge_first.join(self.product_first, "product")
            .join(self.problem_first, "problem")
            .filter((F.col("product_first") < F.col("first")) & (F.col("problem_first") < F.col("first")))
            .select(F.col("first").alias("q"), "product", "problem")
        )

    def first_edge_counts(self) -> DataFrame:
        first = self.edge_first.groupBy(F.col("first").alias("q")).agg(F.count("*").alias("first_edges"))
        good = self.eligible.groupBy("q").agg(F.count("*").alias("eligible_edges"))
        return first.join(good, "q", "left").select(
            quarter_label(F.col("q")).alias("quarter"),
            "first_edges",
            F.coalesce("eligible_edges", F.lit(0)).alias("eligible_edges"),
        )

    # ------------------------------------------------------------ as-of tables

    def history_at(self, quarters: list[int]) -> DataFrame:
        """(q, product, problem) held strictly before each cutoff; dealt by product before it grows by the cutoffs."""
        wanted = F.array(*[F.lit(int(q)) for q in quarters])
        return dealt(self.edge_first, self.edge_first.count(), "product").select(
            F.explode(F.filter(wanted, lambda q: q > F.col("first"))).alias("q"), "product", "problem"
        )

    def product_state(self, quarters: list[int]) -> DataFrame:
        """Per (product, q): prior and recent reports, makers, their activity, first quarter."""
        reports = accumulate(
            self.product_quarter, ["product"], "quarter", quarters, {"product_reports": F.col("n_reports")}
        )
        recent = recent_sum(self.product_quarter, "product", "quarter", "n_reports", RECENT, quarters, "recent_reports")
        return (
            reports.join(self.product_first, "product")
            .join(recent, ["product", "q"], "left")
            .join(self.manufacturer_activity(quarters), ["product", "q"], "left")
            .fillna(0, ["recent_reports", "n_makers", "maker_activity"])
        )

    def manufacturer_activity(self, quarters: list[int]) -> DataFrame:
        """(product, q): its makers so far and the sum of those makers' product counts."""
        pairs = first_seen(self.product_quarter_manufacturer, ["product", "manufacturer"], "quarter")
        per_maker = accumulate(
            pairs.groupBy("manufacturer", "first").agg(F.count("*").alias("n")),
            ["manufacturer"],
            "first",
            quarters,
            {"maker_products": F.col("n")},
        )
        wanted = F.array(*[F.lit(int(q)) for q in quarters])
        held = pairs.select(
            "product", "manufacturer", F.explode(F.filter(wanted, lambda q: q > F.col("first"))).alias("q")
        )
        return held.join(per_maker, ["manufacturer", "q"]).groupBy("product", "q").agg(
            F.count("*").alias("n_makers"), F.sum("maker_products").alias("maker_activity")
        )

    def recent_products(self, quarters: list[int]) -> DataFrame:
        """(problem, q, recent_products): products that reported the problem in the quarters before q."""
        return recent_distinct(self.edges, "problem", "product", "quarter", RECENT, quarters, "recent_products", "following")

    def problem_history(self, quarters: list[int]) -> DataFrame:
        """Per (problem, q): reports, prevalence, parent prevalence, first quarter."""
        reports = accumulate(
            self.edge_quarter.groupBy("problem", "quarter").agg(F.sum("n_reports").alias("n")),
            ["problem"],
            "quarter",
            quarters,
            {"problem_reports": F.col("n")},
        )
        by_parent = first_seen(self.edge_first.join(self.parents, "problem"), ["parent", "product"], "first", "pf")
        parent = accumulate(
            by_parent.groupBy("parent", "pf").agg(F.count("*").alias("n")),
            ["parent"],
            "pf",
            quarters,
            {"parent_prevalence": F.col("n")},
        )
        return (
            reports.join(self.catalogue(quarters), ["problem", "q"])
            .join(self.problem_first, "problem")
            .join(self.parents, "problem", "left")
            .join(parent, ["parent", "q"], "left")
            .fillna(0, ["parent_prevalence"])
        )

    def problem_state(self, quarters: list[int]) -> DataFrame:
        """`problem_history` with the recent prevalence."""
        recent = self.recent_products(quarters)
        return self.problem_history(quarters).join(recent, ["problem", "q"], "left").fillna(0, ["recent_products"])

    def neighbor_scores(self, quarters: list[int], wanted: DataFrame | None = None) -> DataFrame:
        """(q, product, problem, neighbor_count): neighbours of the product holding the problem."""
        rename = {"q": "period", "product": "entity", "problem": "item"}
        incidence = self.history_at(quarters).withColumnsRenamed(rename)
        heads = self.eligible.filter(F.col("q").isin(quarters)).withColumnsRenamed(rename)
        want = None if wanted is None else wanted.select("q", "product", "problem").withColumnsRenamed(rename)
        scores = two_hop_scores(incidence, None if want is not None else heads, want, "count")
        return scores.select(
            F.col("period").alias("q"),
            F.col("entity").alias("product"),
            F.col("item").alias("problem"),
            F.col("score").cast("long").alias("neighbor_count"),
        )

    # ------------------------------------------------------------ candidates and features

    def catalogue(self, quarters: list[int]) -> DataFrame:
        """(q, problem, prevalence): every problem known before q."""
        return accumulate(
            self.edge_first.groupBy("problem", "first").agg(F.count("*").alias("n")),
            ["problem"],
            "first",
            quarters,
            {"prevalence": F.col("n")},
        )

    def candidates(self, quarters: list[int]) -> DataFrame:
        """(q, product, problem) of every candidate of every product with a positive in q."""
        heads = self.eligible.filter(F.col("q").isin(quarters)).select("q", "product").distinct()
        return candidate_grid(
            heads, self.catalogue(quarters).select("q", "problem"), self.history_at(quarters), "q", "product", "problem"
        )

    def with_features(self, pairs: DataFrame, quarters: list[int], neighbors: DataFrame | None = None) -> DataFrame:
        """Attach the twelve features to (q, product, problem) rows."""
        near = neighbors if neighbors is not None else self.neighbor_scores(quarters, pairs)
        wide = (
            pairs.join(self.product_state(quarters), ["product", "q"], "left")
            .join(self.problem_state(quarters), ["problem", "q"], "left")
            .join(near, ["q", "product", "problem"], "left")
            .fillna(
                0,
                [
                    "product_reports", "recent_reports", "n_makers", "maker_activity",
                    "problem_reports", "prevalence", "recent_products", "parent_prevalence", "neighbor_count",
                ],
            )
        )
        values = {
            "product_log_prior_reports": log1p(F.col("product_reports")),
            "problem_log_prior_reports": log1p(F.col("problem_reports")),
            "problem_log_product_prevalence": log1p(F.col("prevalence")),
            "neighbor_log_product_count": log1p(F.col("neighbor_count")),
            "recent_problem_log_product_count": log1p(F.col("recent_products")),
            "recent_problem_prevalence_fraction": F.col("recent_products") / F.greatest(F.lit(1), "prevalence"),
            "product_log_manufacturer_count": log1p(F.col("n_makers")),
            "manufacturer_log_product_activity": log1p(F.col("maker_activity")),
            "product_age_quarters": (F.col("q") - F.coalesce("product_first", "q")).cast("double"),
            "problem_age_quarters": (F.col("q") - F.coalesce("problem_first", "q")).cast("double"),
            "parent_log_product_prevalence": log1p(F.col("parent_prevalence")),
            "product_recent_report_fraction": F.col("recent_reports") / F.greatest(F.lit(1), "product_reports"),
        }
        return wide.select(
            *[c for c in pairs.columns], "prevalence", *[values[name].alias(name) for name in FEATURES]
        )

    def training_rows(self, quarters: list[int], negative_ratio: int = 1) -> DataFrame:
        """(q, product, problem, label): positives and the hash-lowest negatives of each product."""
        positives = self.eligible.filter(F.col("q").isin(quarters))
        counts = positives.groupBy("q", "product").agg(F.count("*").alias("n_pos"))
        used = self.history_at(quarters).unionByName(positives)
        lists = candidate_lists(counts, self.catalogue(quarters).select("q", "problem"), used, "q", "product", "problem")
        order = lambda problem: stable_hex(quarter_label(F.col("q")), F.col("product"), problem)
        negatives = lowest_candidates(lists, "q", "product", "problem", order, negative_ratio * F.col("n_pos")).select(
            "q", "product", "problem", F.lit(0).alias("label")
        )
        return positives.withColumn("label", F.lit(1)).unionByName(negatives)

    # ------------------------------------------------------------ ranking and evaluation

    def supports(self, quarters: list[int]) -> DataFrame:
        return accumulate(
            self.product_quarter, ["product"], "quarter", quarters, {"history_support": F.col("n_reports")}
        )

    def baseline_ranks(self, quarters: list[int]) -> DataFrame:
        """(method, q, product, problem, rank) of every positive for the two baselines; no score leaves its tile."""
        rename = {"q": "period", "product": "entity", "problem": "item"}
        positives = self.eligible.filter(F.col("q").isin(quarters)).withColumnsRenamed(rename).transform(cut)
        history = self.history_at(quarters).withColumnsRenamed(rename)
        catalogue = self.catalogue(quarters).withColumnsRenamed({"q": "period", "problem": "item", "prevalence": "support"})
        found = {
            "global_popularity": sparse_ranks(positives, history, catalogue),
            "neighbor_frequency": two_hop_ranks(history, positives, catalogue, "count"),
        }
        rows = [ranks.select(F.lit(m).alias("method"), F.col("period").alias("q"), F.col("entity").alias("product"), F.col("item").alias("problem"), "rank") for m, ranks in found.items()]
        return rows[0].unionByName(rows[1])

    def problem_score_ranks(self, scores: DataFrame, method: str, quarters: list[int]) -> DataFrame:
        """`score_ranks` for (q, problem, score): a score that all products share is an order of the catalogue, so no candidate is listed."""
        rename = {"q": "period", "product": "entity", "problem": "item"}
        catalogue = self.catalogue(quarters).join(scores, ["q", "problem"]).withColumnsRenamed({**rename, "score": "support", "prevalence": "second"})
        positives = self.eligible.filter(F.col("q").isin(quarters)).withColumnsRenamed(rename)
        ranks = sparse_ranks(positives, self.history_at(quarters).withColumnsRenamed(rename), catalogue)
        return ranks.select(F.lit(method).alias("method"), F.col("period").alias("q"), F.col("entity").alias("product"), F.col("item").alias("problem"), "rank")

    def popularity_ranks(self, quarters: list[int]) -> DataFrame:
        return self.popularity_only(quarters).select("q", "product", "problem", "prevalence", "rank")

    def popularity_only(self, quarters: list[int]) -> DataFrame:
        rename = {"q": "period", "product": "entity", "problem": "item"}
        ranked = sparse_ranks(
            self.eligible.filter(F.col("q").isin(quarters)).withColumnsRenamed(rename),
            self.history_at(quarters).withColumnsRenamed(rename),
            self.catalogue(quarters).withColumnsRenamed({"q": "period", "problem": "item", "prevalence": "support"}),
        )
        return ranked.withColumnsRenamed(
            {"period": "q", "entity": "product", "item": "problem", "support": "prevalence"}
        )

    def score_ranks(self, scored: DataFrame, method: str) -> DataFrame:
        """Ranks of the positives for a method that scored every candidate (q, product, problem, prevalence, score)."""
        ranked = full_ranks(scored, ["q", "product"], "score", "prevalence", "problem")
        return ranked.join(self.eligible, ["q", "product", "problem"], "left_semi").select(
            F.lit(method).alias("method"), "q", "product", "problem", F.col("rank").cast("long").alias("rank")
        )

    def product_metrics(self, ranks: DataFrame, quarters: list[int]) -> DataFrame:
        """One row per (method, q, product): support, hits, recall and reciprocal rank."""
        per = entity_metrics(ranks, ["method", "q", "product"])
        return per.join(self.supports(quarters), ["product", "q"])

    def threshold_metrics(self, entities: DataFrame, keys: list[str]) -> DataFrame:
        """Pooled metrics for support thresholds and support bands; undefined values are 0 here."""
        support = F.col("history_support")
        slices = [F.when(support >= t, F.lit(f">={t}")) for t in THRESHOLDS]
        sliced = entities.withColumn("slice", F.explode(F.array_compact(F.array(*slices, support_band(support)))))
        return pooled_metrics(sliced, [*keys, "slice"], undefined=0.0)

    def prediction_rows(self, scored: DataFrame) -> DataFrame:
        """Positives, and as many negatives taken in problem order, cycling when they run out.

        ``scored``: all candidates (q, product, problem, score).
        """
        marked = scored.join(
            self.eligible.withColumn("label", F.lit(1)), ["q", "product", "problem"], "left"
        ).fillna(0, ["label"])
        group = W.partitionBy("q", "product")
        numbered = marked.select(
            "*",
            F.sum("label").over(group).alias("n_pos"),
            F.count("*").over(group).alias("candidate_count"),
            F.row_number().over(W.partitionBy("q", "product", "label").orderBy("problem")).alias("i"),
        )
        n_neg = F.col("candidate_count") - F.col("n_pos")
        # Negative number i is used once per full cycle plus once more if the remainder reaches it.
        uses = F.floor(F.col("n_pos") / n_neg) + F.when(F.col("i") <= F.col("n_pos") % n_neg, 1).otherwise(0)
        copies = F.when(F.col("label") == 1, F.lit(1)).otherwise(uses).cast("int")
        return (
            numbered.withColumn("_copies", copies)
            .filter("_copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .drop("_copies", "i", "n_pos")
        )
