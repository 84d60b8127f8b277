"""Steps that hold at every size: dealt once, no pairs in shuffles, places that filters do not move."""

from datetime import date

import duckdb
from pyspark.sql import functions as F

from tideline import catalog
from tideline.operators.candidates import candidate_grid, candidate_lists, lowest_candidates
from tideline.operators.median import pooled_median
from tideline.operators import twohop
from tideline.operators.ranking import catalogue_ranks, sparse_ranks
from tideline.plans.prescriber import PrescriberStudy
from test_small import _device_study


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_edges_carry_first_and_next_quarter_and_need_no_second_shuffle(spark):
    study = _device_study(spark, extra=[(9, 2, "B", "Z"), (10, 4, "A", "Z")])
    rows = {(r["product"], r["problem"], r["quarter"]): (r["first"], r["following"]) for r in study.edges.collect()}
    quarters = {}
    for product, problem, q in rows:
        quarters.setdefault((product, problem), []).append(q)
    for (product, problem, q), got in rows.items():
        mine = sorted(quarters[product, problem])
        assert got == (mine[0], next((x for x in mine if x > q), None))
    assert exchanges(study.edge_first) == 0
    assert exchanges(study.recent_products([1, 2, 3])) <= 1


def test_edges_are_dealt_to_more_tasks_as_their_number_grows(spark, monkeypatch):
    from tideline import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 2)
    assert session.dealt(spark.range(9), 9, "id").rdd.getNumPartitions() >= 5


def test_source_row_is_the_place_in_the_file_not_among_the_cohort(spark, tmp_path):
    """A prescriber first seen in the last year is in its file, but in no cohort; later rows keep their numbers."""
    tables = {
        "lineitem": "(1,1,5.0),(2,1,5.0),(3,1,5.0)) t(l_orderkey,l_partkey,l_extendedprice)",
        "orders": "(1,2,DATE '1998-01-01'),(2,1,DATE '2001-02-01'),(3,2,DATE '2001-03-01')) t(o_orderkey,o_custkey,o_orderdate)",
        "part": "(1,'B','T')) t(p_partkey,p_brand,p_type)",
        "customer": "(1,1,'X'),(2,1,'X')) t(c_custkey,c_nationkey,c_mktsegment)",
        "nation": "(1,'N')) t(n_nationkey,n_name)",
    }
    con = duckdb.connect()
    for name, rows in tables.items():
        con.sql(f"create table {name} as select * from (values {rows}")
    got = con.sql(catalog.oracles()["p_edge_export"]).df().sort_values("year")
    assert got[["year", "source_row"]].values.tolist() == [[1998, 1], [2001, 2]]


def test_ranks_and_lowest_candidates_over_several_tiles_equal_the_grid(spark):
    rows = [(p, f"e{e}", f"i{(e * 7 + k * k) % 150:03d}") for p in (1, 2) for e in range(6) for k in range(30 + p)]
    history = spark.createDataFrame(sorted(set(rows)), "period int, entity string, item string").cache()
    catalogue = history.groupBy("period", "item").agg(F.count("*").alias("support"))
    heads = history.select("period", "entity").distinct().withColumn("k", F.lit(9))
    held = {tuple(r) for r in history.collect()}
    items = {}
    for p, i, n in catalogue.collect():
        items.setdefault(p, []).append((-n, i))
    free = {(p, e): [i for _, i in sorted(items[p]) if (p, e, i) not in held] for p, e in {x[:2] for x in held}}
    grid = candidate_grid(heads, catalogue, history, "period", "entity", "item", tile_items=70)
    assert {(r["period"], r["entity"], r["item"]) for r in grid.collect()} == {(p, e, i) for (p, e), found in free.items() for i in found}
    assert grid.count() == sum(map(len, free.values()))
    ranks = catalogue_ranks(grid.select("period", "entity", "item"), history, catalogue, tile=70)
    assert {(r["period"], r["entity"], r["item"]): r["rank"] for r in ranks.collect()} == {(p, e, i): k for (p, e), found in free.items() for k, i in enumerate(found, 1)}
    lists = candidate_lists(heads, catalogue, history, "period", "entity", "item", tile_items=70)
    low = lowest_candidates(lists, "period", "entity", "item", lambda i: F.reverse(i), F.col("k"))
    want = {(p, e, i) for (p, e), found in free.items() for i in sorted(found, key=lambda i: (i[::-1], i))[:9]}
    assert {(r["period"], r["entity"], r["item"]) for r in low.collect()} == want


def test_the_grid_is_not_dealt_row_by_row(spark):
    """No exchange lies above the generator that lists the candidates."""
    history = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "period int, entity string, item string")
    heads = history.select("period", "entity").distinct()
    grid = candidate_grid(heads, history.select("period", "item").distinct(), history, "period", "entity", "item")
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" in plan and "Exchange" not in plan[: plan.index("Generate inline")]


def test_pooled_median_sends_packed_cells(spark):
    """An owner's cells travel as one array, so no row of a shuffle is a (target, value) and nothing is windowed."""
    hist = spark.createDataFrame([(o, v, 1 + v % 3) for o in "ab" for v in range(-200, 900, 7)], "owner string, value long, n long")
    members = spark.createDataFrame([(t, o) for t in range(4) for o in "ab"], "target int, owner string")
    got = pooled_median(members, hist, ["target"], ["owner"], "value", "m")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(value" not in plan and "_b#" not in plan
    flat = sorted(v for _, v, n in map(tuple, hist.collect()) for _ in range(n))
    want = (flat[(len(flat) - 1) // 2] + flat[len(flat) // 2]) / 2
    assert {tuple(r) for r in got.collect()} == {(t, want) for t in range(4)}


def test_trials_with_equal_entities_share_one_history(spark, monkeypatch):
    """Two targets at one site and a third at two: the histories of the first two are one set."""
    from tideline.plans import trials

    study = lambda at, nct, done, result: (date.fromisoformat(at), nct, "Interventional", "Actual", done, result, "", "", "1", "", "", "t", "no")
    rows = [study(at, f"NCT0000000{k}", "1998-06-01", f"1998-06-{10 + k}") for k in range(3) for at in ("2000-01-01", "2001-01-01")]
    rows += [study(at, f"NCT0000010{k}", "1999-12-01", "") for k in range(3) for at in ("2000-01-01", "2001-01-01")]
    names = "snapshot date, nct_id string, study_type string, completion_type string, completion_date string, results_date string, start_date string, phase string, enrollment string, number_of_arms string, number_of_groups string, fda_drug string, fda_device string"
    sites = [(0, "A"), (1, "A"), (2, "B"), (100, " a "), (101, "A"), (102, "A"), (102, "B")]
    relations = [("facilities", None, f"NCT{k:08d}", n, date(1998, 1, 1), None) for k, n in sites]
    relations = spark.createDataFrame(relations, "source string, role string, nct_id string, name string, valid_from date, valid_to date")
    s = trials.TrialStudy(spark.createDataFrame(rows, names), None, relations, ("2000-01-01", "2001-01-01"))
    seen = []
    whole = trials.packed_median
    monkeypatch.setattr(trials, "packed_median", lambda members, *rest: seen.append(members.count()) or whole(members, *rest))
    got = {r["nct_id"][-3:]: (r["entity_count"], r["history_entity_count"], r["prior_trial_count"], r["timely"], r["median_delay_days"]) for r in s.target_history.collect()}
    assert got == {"100": (1, 1, 2, 2, 9.5), "101": (1, 1, 2, 2, 9.5), "102": (2, 2, 3, 3, 10.0)}
    assert seen == [3]  # (A), (A, B)
    assert [tuple(r)[1:] for r in s.relation_counts().collect()] == [("facility", 7, 6, 2)]


def test_overlap_ranks_by_set_equal_the_ranks_from_score_rows(spark, monkeypatch):
    """Ranks leave the tile that holds the scores, for the wanted items only; also without items, and over several tiles."""
    monkeypatch.setattr(twohop, "LARGEST", 4)
    monkeypatch.setattr(twohop, "SMALLEST", 4)
    rows = {(p, f"e{e:02d}", f"i{(e // 2 * 5 + k * k) % 23:02d}") for p in (1, 2) for e in range(24) for k in range(3 + e % 5 + p)}
    history = spark.createDataFrame(sorted(rows), "period int, entity string, item string").cache()
    catalogue = history.groupBy("period", "item").agg(F.count("*").alias("support")).cache()
    asked = {(p, f"e{e:02d}", f"i{i:02d}") for p in (1, 2) for e in (*range(0, 24, 3), 99) for i in range(0, 23, 4)} - rows
    wanted = spark.createDataFrame(sorted(asked), "period int, entity string, item string").join(catalogue, ["period", "item"]).select("period", "entity", "item")
    scores = twohop.two_hop_scores(history, kind="jaccard").withColumn("score", F.round("score", 12)).filter("score > 0")
    want = {tuple(r) for r in sparse_ranks(wanted, history, catalogue, scores).select("period", "entity", "item", "rank").collect()}
    found = twohop.two_hop_ranks(history, wanted, catalogue)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "score" not in plan


def test_tables_of_a_prescriber_history_are_made_once(spark):
    rows = [(1998 + k % 4, f"{n:010d}", "B", f"G{(n + k) % 5}", 11 + k, 1.0, "S", "N") for n in range(6) for k in range(4)]
    study = PrescriberStudy(spark.createDataFrame(rows, "year long, npi string, brand string, generic string, claims long, cost double, specialty string, state string"), years=(1998, 1999, 2000, 2001))
    history = study.before("generic", [2001])
    for part in (study.holdings, study.drug_state, study.latest_specialty, study.specialty_support):
        assert part(history) is part(history)
    assert exchanges(study.holdings(history)) == 0


def test_peer_sums_need_no_copy_of_a_tile_for_each_entity(spark, monkeypatch):
    """Dates and links are taken a few cells at a time, owners travel as numbers, and the sums are those of one step."""
    from tideline.operators import peers

    targets = spark.createDataFrame([(f"f{n}", 10 * k + n % 3) for n in range(9) for k in range(1, 5)], "entity string, day int")
    links = spark.createDataFrame([(f"f{n}", f"o{n % k}", 5 * k) for n in range(9) for k in (2, 3, 4)], "entity string, owner string, since int").distinct()
    events = targets.withColumn("serious", F.col("day") % 2)
    whole = {tuple(r) for r in peers.peer_statistics(targets, links, events).collect()}
    monkeypatch.setattr(peers, "CELLS", 8)
    found = peers.peer_statistics(targets, links, events, tile=4)
    assert {tuple(r) for r in found.collect()} == whole and len(whole) == 36
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow" in plan and "owners: array<string>" not in plan


def test_neighbour_scores_leave_their_task_with_the_entity_and_tiles_travel_as_bits(spark):
    """Scores are not dealt out again to find their entities, and many near peers count like few."""
    import numpy as np

    for items, size in ((40, 12), (4000, 3)):
        sets = [sorted({(7 * n + k * k) % items for k in range(size)}) for n in range(20)]
        entries = np.repeat(np.arange(20), [len(x) for x in sets]), np.concatenate(sets)
        bits, data = twohop._bytes(entries, 20, items)
        assert bits == (items == 40) and all((a == b).all() for a, b in zip(twohop._entries(bits, data, 20, items), entries))
        assert len(data) < 4 * (len(entries[0]) + 20) or not bits
    for common in (True, False):
        rows = sorted({(1, f"e{n}", f"i{(n * n + k) % 19}") for n in range(12) for k in range(2)} | ({(1, f"e{n}", "all") for n in range(11)} if common else set()))
        held = {}
        for _, e, i in rows:
            held.setdefault(e, set()).add(i)
        want = {}
        for e, own in held.items():
            for p, theirs in held.items():
                for i in theirs - own if p != e and own & theirs else ():
                    want[e, i] = want.get((e, i), 0) + 1
        found = twohop.two_hop_scores(spark.createDataFrame(rows, "period int, entity string, item string"))
        assert {(r["entity"], r["item"]): r["score"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("MapInArrow")].count("Join") == 1  # the names of the items only
