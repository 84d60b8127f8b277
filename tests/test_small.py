"""Hand-computed cases, boundary rules, leakage and skew."""

import collections
import datetime as dt
import hashlib
import itertools
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import scalar as S
from tideline.functions.ordering import dense_index, running_totals
from tideline.operators import bootstrap, latent, logistic, metrics, spectral
from tideline.operators.blocks import pack
from tideline.operators.candidates import candidate_grid
from tideline.operators.median import pooled_median
from tideline.operators.peers import peer_statistics
from tideline.operators.ranking import full_ranks, sparse_ranks
from tideline.operators.temporal import recent_distinct
from tideline.operators.twohop import two_hop_scores
from tideline.plans import stability
from tideline.plans.device import DeviceStudy
from tideline.plans.prescriber import PrescriberStudy
from tideline.plans.registry import load_task
from tideline.sources import manifest, records, reports, sinks


def one(df):
    return df.collect()[0][0]


# ------------------------------------------------------------ scalars


def test_quarter_text_rules(spark):
    rows = [("2019/01/31",), ("2019/12/01",), ("2019/13/01",), ("01/31/2019",), ("2018/12/31",), ("x",), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(S.quarter_label(S.quarter_from_text(F.col("t"), "2019Q1", "2025Q4"))).collect()]
    assert got == ["2019Q1", "2019Q4", None, None, None, None, None]


def test_flexible_dates(spark):
    df = spark.createDataFrame([("since 01/02/2010",), ("2010-01-02",), ("13/45/2010",), ("",), ("no",)], "t string")
    got = [r[0] for r in df.select(S.flexible_date(F.col("t"))).collect()]
    assert got == [dt.date(2010, 1, 2), dt.date(2010, 1, 2), None, None, None]


def test_stable_hash_is_the_unsigned_leading_bits(spark):
    df = spark.range(1)
    assert one(df.select(S.stable_hex("a", "b"))) == format(1057090313966889972, "016x")
    assert one(df.select(S.stable_modulo(F.lit(1000), "a", "b"))) == 1057090313966889972 % 1000


def test_case_folding_handles_sharp_s(spark):
    assert one(spark.createDataFrame([("  Straße \t X ",)], "t string").select(S.normalize_name(F.col("t")))) == "strasse x"


# ------------------------------------------------------------ ordered scans and metrics


def test_running_totals_survive_one_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.col("id"), (F.col("id") % 7).alias("v"),
    )
    got = running_totals(rows, ["g"], ["id"], {"c": F.col("v")}, slices=16).toPandas().sort_values("id")
    assert (got.groupby("g")["v"].cumsum() == got["c"]).all()


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in "cabbd"], "k string")
    assert {r["k"]: r["idx"] for r in dense_index(df, "k").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


@pytest.mark.parametrize("scores,expected", [((0.1, 0.9), 1.0), ((0.9, 0.1), 0.0), ((0.5, 0.5), 0.5)])
def test_auc(spark, scores, expected):
    df = spark.createDataFrame([(0, scores[0]), (1, scores[1])], "label int, score double")
    assert one(metrics.roc_auc(df, [], "label", "score")) == expected


def test_average_precision_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 0, 1.0), (3, 1, 1.0), (4, 0, 1.0)], "id int, label int, score double")
    assert one(metrics.average_precision(df, [], "label", "score", ["id"])) == pytest.approx(5 / 6)


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 0.5)], "id int, label int, score double")
    row = metrics.classification_metrics(df, [], "label", "score", ["id"]).first()
    assert row["roc_auc"] is None and row["average_precision"] is None and row["top_decile_recall"] is None


def test_bad_scores_and_labels_fail(spark):
    df = spark.createDataFrame([(2, float("nan"))], "label int, score double")
    with pytest.raises(Exception, match="finite"):
        metrics.require_finite(df, ["score"]).collect()
    with pytest.raises(Exception, match="0 and 1"):
        metrics.require_binary(df, "label").collect()


def test_weighted_metrics_equal_copied_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 1), float(rng.randint(0, 4)), rng.randint(1, 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label long, score double, w long").withColumn("g", F.lit(0))
    got = bootstrap.weighted_rank_metrics(df, ["g"], "score", ["id"]).first()
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("w"))))
    assert got["roc_auc"] == pytest.approx(one(metrics.roc_auc(copies, [], "label", "score")))
    assert got["average_precision"] == pytest.approx(one(metrics.average_precision(copies, [], "label", "score", ["id", "copy"])))


def test_bootstrap_draws_are_repeatable_and_complete(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "cluster string")
    first = sorted(map(tuple, bootstrap.multiplicities(df, "cluster", 32, 7).collect()))
    assert first == sorted(map(tuple, bootstrap.multiplicities(df, "cluster", 32, 7).collect()))
    total = {}
    for r, _, m in first:
        total[r] = total.get(r, 0) + m
    assert set(total.values()) == {3} and len(total) == 32


def test_undefined_resamples_are_counted_not_zeroed(spark):
    rows = [(str(i), int(i == 0), 0.5, 0.4) for i in range(3)]
    df = spark.createDataFrame(rows, "cluster string, label long, score_a double, score_b double")
    got = {r["metric"]: r for r in bootstrap.rank_metric_bootstrap(df, "cluster", ["cluster"], 25, 1).collect()}
    assert got["average_precision"]["valid_resamples"] < 25


def _drawn_by_hand(clusters, resamples, seed):
    names = sorted(set(clusters))
    out = []
    for r in range(resamples):
        draws = [int(hashlib.sha256(f"{seed}|{r}|{slot}".encode()).hexdigest()[:15], 16) % len(names) for slot in range(len(names))]
        out.append(collections.Counter(names[d] for d in draws))
    return out


def _metrics_by_hand(rows, score):
    pos, neg = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    if not pos or not neg:
        return None, None
    wins = sum((a[score] > b[score]) + 0.5 * (a[score] == b[score]) for a in rows if a[2] for b in rows if not b[2])
    hits = total = 0
    for place, row in enumerate(sorted(rows, key=lambda r: (-r[score], r[0])), 1):
        hits += row[2]
        total += row[2] * hits / place
    return wins / pos / neg, total / pos


@pytest.mark.parametrize("slices,block", [(2, 4096), (7, 2)])
def test_resamples_equal_copied_rows(spark, monkeypatch, slices, block):
    """Every resample recomputed on copied rows; ties run over slices, and draws are counted in several blocks."""
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    monkeypatch.setattr(bootstrap, "RESAMPLES_PER_ROW", 3)
    rng = random.Random(9)
    rows = [(i, f"c{rng.randint(0, 8)}", rng.randint(0, 1), float(rng.randint(0, 2)), rng.random()) for i in range(70)]
    df = spark.createDataFrame(rows, "id int, cluster string, label long, score_a double, score_b double").withColumn("k", F.lit("x"))
    weights = bootstrap.packed_multiplicities(df, "cluster", 8, 5)
    drawn = _drawn_by_hand([r[1] for r in rows], 8, 5)
    assert {r["cluster"]: list(r["w"]) for r in weights.collect()} == {c: [d[c] for d in drawn] for c in {r[1] for r in rows}}
    for score in (3, 4):
        got = bootstrap.rank_metric_arrays(df.join(weights, "cluster"), ["k"], ("score_a", "score_b")[score - 3], ["id"], slices).first()
        for r, draw in enumerate(drawn):
            auc, ap = _metrics_by_hand([x for x in rows for _ in range(draw[x[1]])], score)
            assert got["auc"][r] == pytest.approx(auc) and got["ap"][r] == pytest.approx(ap)


def test_additive_resamples_equal_sums_by_hand(spark):
    rng = random.Random(2)
    rows = [(f"c{i}", rng.random(), rng.randint(1, 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "cluster string, v double, n long")
    got = {r["metric"]: r for r in bootstrap.additive_bootstrap(df, "cluster", {"m": F.col("v") / F.col("n"), "s": F.col("n") * 1.0}, 40, 3, squared=("n",)).collect()}
    sums = [(sum(d[c] * v for c, v, _ in rows), sum(d[c] ** 2 * n for c, _, n in rows)) for d in _drawn_by_hand([r[0] for r in rows], 40, 3)]
    assert got["s"]["lower"] == pytest.approx(np.percentile([n for _, n in sums], 2.5)) and got["m"]["upper"] == pytest.approx(np.percentile([v / n for v, n in sums], 97.5))
    assert got["m"]["estimate"] == pytest.approx(sum(r[1] for r in rows) / sum(r[2] for r in rows)) and got["m"]["valid_resamples"] == 40


# ------------------------------------------------------------ candidates, two-hop, ranks


def _random_history(seed=1, entities=17, items=23, periods=(5, 6)):
    rng = random.Random(seed)
    return [(q, f"e{e}", f"i{i:02d}") for q in periods for e in range(entities) for i in range(items) if rng.random() < 0.25]


def _brute_scores(rows, kind):
    out = {}
    for q in {r[0] for r in rows}:
        held = {}
        for p, e, i in rows:
            if p == q:
                held.setdefault(e, set()).add(i)
        for e, own in held.items():
            for peer, theirs in held.items():
                common = len(own & theirs)
                if peer == e or not common:
                    continue
                w = 1.0 if kind == "count" else common / len(own | theirs)
                for i in theirs - own:
                    out[q, e, i] = out.get((q, e, i), 0.0) + w
    return out


@pytest.mark.parametrize("kind", ["count", "jaccard"])
@pytest.mark.parametrize("tile", [3, 64])
def test_two_hop_equals_brute_force(spark, kind, tile):
    rows = _random_history()
    df = spark.createDataFrame(rows, "period int, entity string, item string")
    got = {(r[0], r[1], r[2]): r[3] for r in two_hop_scores(df, kind=kind, tile=tile).collect()}
    want = _brute_scores(rows, kind)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_two_hop_wanted_rows_only(spark):
    rows = _random_history(2)
    df = spark.createDataFrame(rows, "period int, entity string, item string")
    want = {k: v for k, v in _brute_scores(rows, "count").items() if k[1] in ("e1", "e2") and k[2] < "i10"}
    wanted = spark.createDataFrame([(*k,) for k in want] + [(5, "e1", "i99")], "period int, entity string, item string")
    got = {(r[0], r[1], r[2]): r[3] for r in two_hop_scores(df, wanted=wanted).collect()}
    assert got == want


def test_sparse_ranks_equal_full_ranking(spark):
    rows = _random_history(4)
    history = spark.createDataFrame(rows, "period int, entity string, item string")
    scores = two_hop_scores(history)
    catalogue = history.groupBy("period", "item").agg(F.count("*").alias("support"))
    heads = history.select("period", "entity").distinct()
    grid = candidate_grid(heads, catalogue, history, "period", "entity", "item", tile_items=5)
    full = full_ranks(
        grid.join(scores, ["period", "entity", "item"], "left").fillna(0.0, ["score"]), ["period", "entity"], "score", "support", "item"
    )
    positives = grid.filter(F.xxhash64("item", "entity") % 3 == 0).select("period", "entity", "item")
    key = ["period", "entity", "item"]
    want = {tuple(r) for r in full.join(positives, key).select(*key, F.col("rank").cast("long")).collect()}
    got = {tuple(r) for r in sparse_ranks(positives, history, catalogue, scores).select(*key, "rank").collect()}
    assert got == want and len(got) > 20


def test_recent_distinct_counts_each_member_once(spark):
    rows = [("d", "a", 1), ("d", "a", 3), ("d", "b", 2), ("d", "c", 9)]
    df = spark.createDataFrame(rows, "owner string, member string, period int")
    got = {r["q"]: r["n"] for r in recent_distinct(df, "owner", "member", "period", 4, list(range(1, 15)), "n").collect()}
    want = {q: len({m for _, m, p in rows if q - 4 <= p < q}) for q in range(1, 15)}
    assert got == {q: n for q, n in want.items() if n}


def test_pooled_median(spark):
    rng = random.Random(5)
    values = {o: [rng.randint(-100, 900) for _ in range(rng.randint(1, 60))] for o in "abcd"}
    hist = spark.createDataFrame([(o, v) for o, vs in values.items() for v in vs], "owner string, value long").groupBy("owner", "value").agg(F.count("*").alias("n"))
    sets = {f"t{i}": c for i, c in enumerate(itertools.chain(itertools.combinations("abcd", 1), itertools.combinations("abcd", 3)))}
    members = spark.createDataFrame([(t, o) for t, c in sets.items() for o in c], "target string, owner string")
    got = {r[0]: r[1] for r in pooled_median(members, hist, ["target"], ["owner"], "value", "m").collect()}
    assert got == {t: float(np.median(sum((values[o] for o in c), []))) for t, c in sets.items()}


def test_peer_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    names = [f"f{i}" for i in range(14)]
    events = sorted({(n, rng.randint(0, 1500)) for n in names for _ in range(6)})
    events = [(n, d, rng.randint(0, 1)) for n, d in events]
    links = [(n, f"o{o}", rng.randint(0, 1500)) for n in names for o in range(6) if rng.random() < 0.3]
    targets = [(n, d) for n, d, _ in events]
    got = peer_statistics(
        spark.createDataFrame(targets, "entity string, day int"), spark.createDataFrame(links, "entity string, owner string, since int"),
        spark.createDataFrame(events, "entity string, day int, serious int"), tile=4,
    )
    got = {(r["entity"], r["day"]): (r["peer_count"], r["peer_prior_facilities"], r["peer_prior_inspections"], r["peer_recent365_serious"], r["peer_any_serious730"]) for r in got.collect()}
    want = {}
    for n, t in targets:
        mine = {o for e, o, s in links if e == n and s <= t}
        peers = {e for e, o, s in links if e != n and o in mine and s <= t}
        past = {p: [(d, b) for e, d, b in events if e == p and d < t] for p in peers}
        recent = lambda p, w: sum(b for d, b in past[p] if d >= t - w)
        if peers:
            want[n, t] = (
                len(peers), sum(bool(v) for v in past.values()), sum(len(v) for v in past.values()),
                sum(recent(p, 365) for p in peers), sum(recent(p, 730) > 0 for p in peers),
            )
    assert got == want


# ------------------------------------------------------------ studies


def _device_study(spark, extra=()):
    devices = [(1, 0, "A", "M"), (2, 0, "A", "M"), (3, 0, "B", "N"), (4, 1, "A", "M"), *extra]
    problems = [(1, "1"), (2, "1"), (3, "2"), (4, "2"), (4, "3"), *[(d[0], "1") for d in extra]]
    return DeviceStudy(
        spark.createDataFrame(devices, "key long, quarter int, product string, manufacturer string"),
        spark.createDataFrame(problems, "key long, problem string"),
        spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "y")], "problem string, parent string"),
    )


def test_first_and_eligible_edges(spark):
    study = _device_study(spark)
    first = {(r["product"], r["problem"]): r["first"] for r in study.edge_first.collect()}
    assert first == {("A", "1"): 0, ("B", "2"): 0, ("A", "2"): 1, ("A", "3"): 1}
    assert [tuple(r) for r in study.eligible.collect()] == [(1, "A", "2")]


def test_future_reports_do_not_change_earlier_rows(spark):
    before = _device_study(spark)
    after = _device_study(spark, extra=[(9, 2, "B", "Z"), (10, 2, "C", "Z")])
    for table in ("product_state", "problem_state"):
        assert sorted(map(str, getattr(before, table)([1]).collect())) == sorted(map(str, getattr(after, table)([1]).collect()))
    assert sorted(map(tuple, before.eligible.collect())) == sorted(tuple(r) for r in after.eligible.collect() if r["q"] <= 1)


def _prescriber(spark, rows):
    schema = "year long, npi string, brand string, generic string, claims long, cost double, specialty string, state string"
    return PrescriberStudy(spark.createDataFrame(rows, schema), years=(2021, 2022, 2023))


PRESCRIBER_ROWS = [
    (2021, "1000000001", "A", "A", 12, 1.0, "X", "CA"), (2021, "1000000002", "B", "B", 12, 1.0, "X", "CA"),
    (2021, "1000000002", "C", "C", 12, 1.0, "X", "CA"), (2021, "1000000003", "B", "B", 12, 1.0, "Y", "CA"),
    (2022, "1000000001", "C", "C", 12, 1.0, "X", "CA"), (2022, "1000000001", "D", "D", 30, 1.0, "X", "CA"),
    (2023, "1000000001", "A", "A", 12, 1.0, "X", "CA"), (2023, "1000000002", "D", "D", 12, 1.0, "X", "CA"),
]


def test_prescriber_candidates_positives_and_gap(spark):
    study = _prescriber(spark, PRESCRIBER_ROWS)
    history = study.before("variant", [2022])
    mine = study.candidates(history).filter("npi = '1000000001'").select("drug.generic").collect()
    assert sorted(r[0] for r in mine) == ["B", "C"]
    positives = study.positives("variant", history, [2022])
    assert [(r["npi"], r["drug"]["generic"]) for r in positives.collect()] == [("1000000001", "C")]
    ranked = study.ranked_positives(study.heuristic_scores(history), positives, ["global_popularity", "specialty_popularity"])
    assert {r["method"]: r["rank"] for r in ranked.collect()} == {"global_popularity": 2, "specialty_popularity": 2}
    sparse = study.heuristic_ranks(history, positives, ["global_popularity", "specialty_popularity"])
    assert {r["method"]: r["rank"] for r in sparse.collect()} == {"global_popularity": 2, "specialty_popularity": 2}
    audit = {r["year"]: r for r in study.annual_audit().collect()}
    assert audit[2023]["recurrent_after_gap"] == 1 and audit[2022]["globally_new_drugs"] == 1


def test_ranks_without_the_grid_equal_ranks_on_it(spark):
    rng = random.Random(8)
    rows = [
        (y, f"10000000{p:02d}", f"b{d}", f"g{d % 9}", 11 + rng.randint(0, 40), 1.0, rng.choice(["X", "Y", ""]), "CA")
        for y in (2021, 2022, 2023) for p in range(18) for d in sorted(rng.sample(range(14), rng.randint(1, 7)))
    ]
    study = _prescriber(spark, rows)
    for kind in ("generic", "variant"):
        history = study.before(kind, [2022, 2023])
        positives = study.positives(kind, history, [2022, 2023])
        methods = ["global_popularity", "specialty_popularity", "history_overlap"]
        grid = study.ranked_positives(study.heuristic_scores(history), positives, methods)
        sparse = study.heuristic_ranks(history, positives, methods)
        assert sorted(map(str, grid.collect())) == sorted(map(str, sparse.collect())) and positives.count() > 20


def test_prescriber_future_rows_do_not_leak(spark):
    def ranks(rows):
        study = _prescriber(spark, rows)
        history = study.before("generic", [2022])
        got = study.heuristic_ranks(history, study.positives("generic", history, [2022]), ["history_overlap", "specialty_popularity"])
        return sorted(map(str, got.collect()))

    changed = [r for r in PRESCRIBER_ROWS if r[0] < 2023] + [(2023, "1000000003", "Z", "Z", 99, 9.0, "Q", "NY")]
    assert ranks(PRESCRIBER_ROWS) == ranks(changed)


def test_registry_rejects_unknown_names(spark, root):
    task = load_task("MAUDE", spark, root)
    with pytest.raises(ValueError):
        task.period("future")
    assert task.period(" Test ")["split"] == "test"
    with pytest.raises(ValueError):
        task.test_scores("no_such_method")
    with pytest.raises(ValueError):
        load_task("other", spark, root)


# ------------------------------------------------------------ models


def test_logistic_separates_and_repeats(spark):
    rows = [(0, 0.0, 0.0, 0), (1, 1.0, 1.0, 1), (2, 2.0, 2.0, 1)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int").withColumn("t", F.lit(0))
    spec = [logistic.Spec("m", 0, 1, (0, 1), 40, 0.15, 0.01)]
    fits = [logistic.fit(pack(df, ["a", "b"], "label", "t", ["id"]), ["a", "b"], spec)[0] for _ in range(2)]
    assert fits[0] == fits[1]
    scores = {r["id"]: r["s"] for r in df.select("id", fits[0].margin().alias("s")).collect()}
    assert scores[2] > scores[0]


def _planted(spark):
    rows = [(1, f"e{e:02d}", f"i{i:02d}") for e in range(20) for i in range(20) if (e % 2 == i % 2) and (e * 7 + i * 3) % 5 > 0]
    return spark.createDataFrame(rows, "q int, entity string, item string"), {(e, i) for _, e, i in rows}


def _power_iteration(held, entities, items, rank, iterations):
    m = np.array([[float((e, i) in held) for i in items] for e in entities])
    a = m / np.sqrt(np.maximum(1, m.sum(axis=0)))
    unit = lambda v: v * 0 if np.linalg.norm(v) <= 1e-12 else v / np.linalg.norm(v)
    found = []
    for c in range(min(rank, len(items))):
        i = np.arange(len(items))
        v = unit(np.sin((i + 1) * (c + 1) * 0.731) + 0.1 / (i + c + 1))
        for _ in range(iterations):
            v = a.T @ (a @ v)
            for p in found:
                v = v - (v @ p) * p
            v = unit(v)
        if not np.any(np.abs(v) > 1e-9):
            break
        found.append(v)
    return dict(zip(items, np.array(found).T))


@pytest.mark.parametrize("block,entries", [(1024, 1 << 18), (6, 30)])
def test_spectral_equals_dense_iteration(spark, monkeypatch, block, entries):
    monkeypatch.setattr(spectral, "ENTRIES", entries)
    history, held = _planted(spark)
    other = [(2, f"e{k}", f"i{k % 3:02d}") for k in range(9)] + [(2, "e0", "i01")]  # three items: fewer vectors than asked for
    both = history.unionByName(spark.createDataFrame(other, "q int, entity string, item string"))
    got = {(r["q"], r["item"]): r["v"] for r in spectral.fit_spectral(both, rank=4, iterations=6, block=block).collect()}
    want = {(1, i): v for i, v in _power_iteration(held, sorted({e for e, _ in held}), sorted({i for _, i in held}), 4, 6).items()}
    pairs = {(e, i) for _, e, i in other}
    want |= {(2, i): v for i, v in _power_iteration(pairs, sorted({e for e, _ in pairs}), sorted({i for _, i in pairs}), 4, 6).items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


@pytest.mark.parametrize("fit", ["bpr", "graphsage", "specialty"])
def test_embeddings_beat_chance_and_score_unknown_zero(spark, fit):
    history, held = _planted(spark)
    if fit == "bpr":
        factors = latent.fit_bpr(history, epochs=8, rate=0.3)
    elif fit == "graphsage":
        factors = latent.fit_graphsage(history, epochs=4)
    else:
        special = history.select("q", "entity").distinct().withColumn(
            "specialty", F.when(F.substring("entity", 2, 2).cast("int") % 2 == 0, "even").otherwise("odd")
        )
        factors = latent.fit_specialty_bpr(history, special)
    pairs = [(1, f"e{e:02d}", f"i{i:02d}", int(e % 2 == i % 2)) for e in range(20) for i in range(20) if (f"e{e:02d}", f"i{i:02d}") not in held]
    df = spark.createDataFrame(pairs + [(1, "nobody", "i00", 0)], "q int, entity string, item string, label int")
    rows = factors.score(df).collect()
    assert all(np.isfinite(r["score"]) for r in rows)
    assert [r["score"] for r in rows if r["entity"] == "nobody"] == [0.0]
    scored = spark.createDataFrame([(r["label"], r["score"]) for r in rows if r["entity"] != "nobody"], "label int, score double")
    assert one(metrics.roc_auc(scored, [], "label", "score")) > 0.55


# ------------------------------------------------------------ sources and sinks


def test_report_text_files(spark, tmp_path):
    def line(key, date="2019/02/03", product="ABC", width=34):
        fields = [""] * width
        fields[0], fields[8], fields[11] = key, date, " Makeré "
        if width > 28:
            fields[28] = product
        return "|".join(fields)

    text = "\n".join(["|".join(f"FIELD_{k}" for k in range(34)), line("5"), "", line("x"), line("4"), line("6", product=" UNK "), line("7", date="1999/01/01"), line("8", width=20)]) + "\n"
    path = tmp_path / "device2019.txt"
    path.write_bytes(text.encode("latin1"))
    rows = reports.classify_device_lines(reports.read_lines(spark, [str(path)], header=True), "2019Q1", "2025Q4")
    got = {r["status"]: r["n_lines"] for r in reports.parse_audit(rows).collect()}
    assert got["blank"] == 1 and got["valid"] == 2 and got["non_numeric_key"] == 1 and got["wrong_width"] == 1 and got["outside_window"] == 1 and got["blank_product"] == 1
    assert {r["manufacturer"] for r in rows.filter("status = 'valid'").collect()} == {"Makeré"}
    assert one(reports.key_inversions(rows.filter("key is not null")).select("key_inversions")) == 1


def test_json_record_shapes(spark):
    texts = ['[{"a":1}]', '{"data":[{"a":2}]}', '{"results":[{"a":3}]}', '{"records":[{"a":4},{"a":5}]}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r[0] for r in records.json_records(df, "struct<a:int>").collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(Exception, match="record list"):
        records.json_records(spark.createDataFrame([('{"other":[]}',)], "value string"), "struct<a:int>").collect()


def test_csv_header_and_ragged_rows(spark, tmp_path):
    good, bad, ragged = tmp_path / "g.csv", tmp_path / "b.csv", tmp_path / "r.csv"
    good.write_text("﻿a,b\n1,2\n", encoding="utf-8")
    bad.write_text("a,c\n1,2\n")
    ragged.write_text("a,b\n1,2,3\n")
    assert [tuple(r) for r in records.read_csv_text(spark, str(good), ["a", "b"]).collect()] == [("1", "2")]
    for path in (bad, ragged):
        with pytest.raises(Exception):
            records.read_csv_text(spark, str(path), ["a", "b"]).collect()


def test_byte_repair_keeps_utf8_and_maps_stray_bytes(spark):
    df = spark.createDataFrame([(bytearray("café".encode()),), (bytearray(b"caf\xe9"),)], "b binary")
    assert {r[0] for r in df.select(records.repair_bytes(F.col("b"))).collect()} == {"café"}


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "x"), (1, 1.5, "y")], "b int, a double, c string")
    path = str(tmp_path / "out")
    sinks.write_once_json(df, path, ["b"])
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"a":1.5,"b":1,"c":"y"}', '{"a":null,"b":2,"c":"x"}']
    with pytest.raises(Exception):
        sinks.write_once_json(df, path, ["b"])


def test_edge_rules_raise(spark):
    study = _prescriber(spark, [*PRESCRIBER_ROWS, (2022, "1000000001", "C", "C", 5, 1.0, "X", "CA")])
    bad = sinks.edge_violations(study.export(), study.cohort)
    got = {r["rule"]: r["violations"] for r in bad.collect()}
    assert got["duplicate_key"] == 1 and got["low_claims"] == 1 and got["bad_npi"] == 0
    with pytest.raises(ValueError, match="duplicate_key"):
        sinks.require_no_violations(bad)


def test_manifest_rules_and_drift(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    found = manifest.describe(spark, str(tmp_path / "*.csv"))
    assert manifest.drift(found, found).count() == 0
    wrong = found.withColumn("sha256", F.lit("0" * 64))
    assert [r["problem"] for r in manifest.drift(wrong, found).collect()] == ["hash"]
    entry = {"path": "a.csv", "year": 2019, "sha256": "0" * 64}
    manifest.require_sound([entry, {**entry, "path": "b.csv", "year": 2020}])
    for broken in ({**entry, "path": "../a.csv", "year": 2020}, {**entry, "year": 2020}, {**entry, "path": "b", "year": 2022}):
        with pytest.raises(ValueError):
            manifest.require_sound([entry, broken])


def test_stream_equals_batch(spark, root):
    from tideline.streaming.first_seen import first_seen_batch, run_first_seen

    want = {tuple(r) for r in first_seen_batch(spark.read.parquet(f"{root}/events.parquet")).collect()}
    assert {tuple(r) for r in run_first_seen(spark, root).collect()} == want


# ------------------------------------------------------------ facility task


def test_facility_has_one_provider_row_and_no_blank_owner(spark):
    from tideline.plans.facility import FacilityStudy

    providers = spark.createDataFrame(
        [("A", "TX", "2010-01-01", "x"), ("A", "NY", "2009-01-01", "y"), ("B", "TX", None, "x"), ("", "TX", "2010-01-01", "x")],
        "ccn string, state string, approval string, provider_type string",
    ).withColumn("approval", F.col("approval").cast("date"))
    owners = spark.createDataFrame([("E1", " ", "r", "2011-01-01"), ("E1", "7", "r", "2011-01-01")], "enrollment string, associate string, role string, association string")
    filings = spark.createDataFrame([("E1", "A", 1)], "enrollment string, ccn string, row_no long")
    empty = spark.createDataFrame([], "ccn string, owner_type string, owner_name string, role string, association date")
    days = spark.createDataFrame([], "ccn string, day date, serious int")
    study = FacilityStudy(days, providers, empty, filings, owners.withColumn("association", F.col("association").cast("date")), (), ("r",))
    assert [(r.ccn, r.state) for r in study.provider_static.collect()] == [("A", "NY")]
    assert [r.owner for r in study.change_owners.collect()] == ["PAC:7"]


def test_facility_task_predicts(spark, root):
    task = load_task("facility", spark, root)
    counts = {r["method"]: r["n"] for r in task.predictions.groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == set(task.methods) and len(set(counts.values())) == 1


def test_stability_covers_every_origin_and_group(spark, monkeypatch):
    days = [dt.date(1997, 1, 1), dt.date(1998, 1, 1)]
    rows = [
        (o, m, f"N{i}", i % 2, ((i * 7 + k * 5 + o.year) % 11) / 11)
        for o in days for k, m in enumerate(stability.GROUPS) for i in range(8 if o.year == 1997 else 11)
    ]
    predicted = spark.createDataFrame(rows, "origin date, model string, nct_id string, label int, score double")
    monkeypatch.setattr(stability, "TrialStudy", SimpleNamespace(bound=lambda *a: None))
    monkeypatch.setattr(stability, "rolling_predictions", lambda s: predicted)
    got = {(r["origin"], r["comparison"]): r for r in stability.intervals(spark, "", 20).collect()}
    assert set(got) == {(o, f"{b}_minus_{a}") for o in days for b, a in stability.comparisons()}
    for day in days:  # a key draws as its comparison does alone
        b, a = stability.comparisons()[3]
        one = {r[2]: [r[3], r[4]] for r in rows if r[:2] == (day, a)}
        alone = spark.createDataFrame([(n, *one[n], r[4]) for r in rows if r[:2] == (day, b) for n in [r[2]]], "nct_id string, label int, score_a double, score_b double")
        seed = bootstrap.comparison_seed(stability.VERSION, day.isoformat(), f"{b}_minus_{a}")
        want = bootstrap.rank_metric_bootstrap(alone, "nct_id", ["nct_id"], 20, seed).filter("metric = 'average_precision'").first()
        for c in ("estimate", "lower", "upper", "valid_resamples"):
            assert got[day, f"{b}_minus_{a}"][c] == pytest.approx(want[c])


# ------------------------------------------------------------ encoder and stacked models


def _coded(spark, rows):
    return spark.createDataFrame(rows, "id int, t int, y int, kind string, a double, b double")


def _coded_rows(n=240):
    rng = random.Random(4)
    out = []
    for i in range(n):
        a, b, kind = rng.gauss(3, 2), rng.gauss(0, 1) if rng.random() < 0.8 else None, rng.choice(["x", "y", "z", None])
        t = i % 4
        kind = "late" if t == 3 and i % 7 == 0 else kind
        y = int(rng.random() < 1 / (1 + np.exp(-(0.8 * (a - 3) - (b or 0) + (kind == "x")))))
        out.append((i, t, y, kind, a, b))
    return out


def test_stacked_newton_meets_the_optimum_of_each_model(spark):
    from tideline.operators import encode, newton

    rows = _coded_rows()
    df = _coded(spark, rows)
    encoder = encode.fit_encoder(df.filter("t < 3"), ["kind"], ["a", "b"])
    assert {r["name"] for r in encoder.names().collect()} == {"kind=x", "kind=y", "kind=z", "kind=__MISSING__", "kind=__UNK__", "a", "a__missing", "b", "b__missing"}
    coded = encoder.encode(df, ["id"], ["y", "t"])
    numbers = [encoder.places(c) for c in ("a", "b")]
    jobs = [newton.Job(f"{name}{t}", t, cols) for t in (1, 3) for name, cols in (("all", tuple(range(encoder.size))), ("few", (*range(encoder.width), *encoder.places("a"))))]
    models = newton.fit(coded, ["id"], "y", "t", encoder.size, numbers, jobs, 0.01)
    place = {r["name"]: r["id"] for r in encoder.names().collect()}
    for m in models:
        own = [r for r in rows if r[1] < m.job.before]
        x = np.zeros((len(own), encoder.size))
        for k, (_, _, _, kind, a, b) in enumerate(own):
            x[k, place[f"kind={kind or '__MISSING__'}"]] = 1
            for c, v in (("a", a), ("b", b)):
                known = [r[4 if c == "a" else 5] for r in own if r[4 if c == "a" else 5] is not None]
                if v is None:
                    x[k, place[f"{c}__missing"]] = 1
                else:
                    x[k, place[c]] = (v - np.mean(known)) / np.std(known)
        x = x[:, list(m.job.columns)]
        p = 1 / (1 + np.exp(-(x @ m.weights + m.intercept)))
        error = p - np.array([r[2] for r in own])
        assert np.abs(x.T @ error / len(own) + 0.01 * m.weights).max() < 1e-8 and abs(error.mean()) < 1e-8
    late = {r["id"]: r["score"] for r in newton.predict(coded.filter("t = 3"), ["id"], encoder.size, numbers, "t", models).filter("model = 'all3'").collect()}
    assert set(late) == {r[0] for r in rows if r[1] == 3} and all(0 < s < 1 for s in late.values())


def test_one_class_and_no_rows(spark):
    from tideline.operators import newton

    df = spark.createDataFrame([(1, 0, 1, [0], [1.0]), (2, 0, 1, [0], [2.0]), (3, 1, 0, [0], [1.0])], "id int, t int, y int, ids array<int>, values array<double>")
    one = newton.fit(df, ["id"], "y", "t", 1, [], [newton.Job("m", 1, (0,))], 0.1)[0]
    assert one.intercept == np.inf and list(one.weights) == [0.0]
    assert [r["score"] for r in newton.predict(df.filter("t = 1"), ["id"], 1, [], "t", [one]).collect()] == [1.0]
    with pytest.raises(ValueError, match="no training rows"):
        newton.fit(df, ["id"], "y", "t", 1, [], [newton.Job("m", 0, (0,))], 0.1)


def test_a_column_of_many_values_encodes(spark):
    from tideline.operators import encode

    df = spark.range(50_000).select("id", F.concat(F.lit("v"), "id").alias("name"), F.lit(1.0).alias("x"))
    encoder = encode.fit_encoder(df, ["name"], ["x"])
    rows = encoder.encode(df.unionByName(spark.createDataFrame([(-1, "new", None), (-2, " ", 2.0)], "id long, name string, x double")), ["id"], [])
    assert encoder.size == 50_003 and rows.count() == 50_002
    unknown = [r["id"] for r in encoder.dictionary.filter(F.col("value") == encode.UNKNOWN).collect()]
    got = {r["id"]: (r["ids"], r["values"]) for r in rows.filter("id < 1").collect()}
    assert got[-1] == ([*unknown, 50_002], [1.0, 1.0]) and got[-2] == ([*unknown, 50_001], [1.0, 2.0]) and got[0][0][0] not in unknown


def test_a_line_is_parsed_once_however_it_is_filtered(spark):
    """A filter on the status must not take the parsing with it: each mention of a field would split the line again."""
    lines = spark.createDataFrame([("a", "|".join(["7"] + ["x"] * 7 + ["2020/02/03"] + ["x"] * 2 + [" m "] + ["x"] * 16 + [" p "] + ["x"] * 5)), ("a", ""), ("a", "K1|x")], "file string, value string")
    joined = lines.withColumn("value", F.concat_ws("|", F.col("value")))
    valid = reports.classify_device_lines(joined, "2019Q1", "2025Q4").filter("status = 'valid'").select("key", "product", "manufacturer")
    assert [tuple(r) for r in valid.collect()] == [(7, "p", "m")]
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("split(value") + valid._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") <= 2
    codes = spark.createDataFrame([("5| c",), ("x|c",), ("",)], "value string").withColumn("value", F.concat_ws("|", F.col("value")))
    assert [tuple(r) for r in reports.classify_problem_lines(codes).filter("status = 'valid'").select("key", "problem").collect()] == [(5, "c")]


def test_owner_pairs_are_listed_once_without_shuffling_them(spark, monkeypatch):
    """Entities that share several owners are one pair, also in parts; no pair is dealt again to be made distinct."""
    from tideline.plans import facility

    monkeypatch.setattr(facility, "PART", 3)
    rng = random.Random(5)
    own = [(f"o{rng.randrange(12)}", f"e{rng.randrange(25)}") for _ in range(150)] + [("alone", "e1"), ("x", None), ("y", "lonely")]
    rows = spark.createDataFrame(own, "owner string, entity string")
    held = [(o, e) for o, e in set(own) if e]
    want = {(a, b) for o, a in held for p, b in held if o == p and a != b}
    got = [tuple(r) for r in facility.owner_projection(rows).collect()]
    assert len(got) == len(want) and set(got) == want
    values = spark.createDataFrame([(f"e{k}", float(k)) for k in range(20)], "entity string, x double")
    pairs = facility.owner_projection(rows, values)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((a, b, float(b[1:])) for a, b in want if int(b[1:]) < 20)
    means = {r["entity"]: r["raw"] for r in facility.neighbor_mean(pairs, F.lit(True)).collect()}
    for e in {a for a, b in want if int(b[1:]) < 20}:
        assert means[e] == pytest.approx(np.mean([float(b[1:]) for a, b in want if a == e and int(b[1:]) < 20]))
    plan = facility.owner_projection(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith(("Aggregate", "Distinct"))
