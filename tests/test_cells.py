"""Steps that neither list nor deal what they can count in place."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import latent


def _number(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16], 16)


def _held():
    return {(q, f"e{e:02d}", f"i{(e * 7 + k * k) % 17:02d}") for q in (1, 2) for e in range(9) for k in range(2 + e)} | {(2, "all", f"i{i:02d}") for i in range(17)}


@pytest.mark.parametrize("cell", [1 << 16, 4])
@pytest.mark.parametrize("kind", ["cyclic", "unheld"])
def test_draws_are_packed_by_entity_and_equal_their_definition(spark, monkeypatch, kind, cell):
    """Every edge keeps its item and its hashed negatives; no table has a row for an edge or a draw."""
    monkeypatch.setattr(latent, "CELL", cell)
    written = []
    monkeypatch.setattr(latent, "cut", lambda df, real=latent.cut: written.append(real(df)) or written[-1])
    rows = _held()
    draw, width = (latent.cyclic_draws(2, ["x"]), 1) if kind == "cyclic" else (latent.unheld_draws(2, 2), 2)
    graph = latent._graph(spark.createDataFrame(sorted(rows), "q int, entity string, item string"), draw, 2, width)
    names = {(r["q"], r["row"]): r["entity"] for r in graph.entities.collect()}
    items = {(r["q"], r["idx"]): r["item"] for r in graph.items.collect()}
    got = {}
    for c in graph.cells.collect():
        row = np.repeat(c["rows"], c["counts"])
        assert len(row) <= cell
        kinds = f"u{len(c['idx']) // len(row)}"
        idx, *draws = (np.frombuffer(x, kinds).reshape(len(row), -1) for x in (c["idx"], c["n0"], c["n1"]))
        for k, r in enumerate(row):
            left = lambda x: [None if p == np.iinfo(kinds).max else items[c["q"], c["items"][p]] for p in x[k]]  # noqa: B023, E731
            got[c["q"], names[c["q"], r], left(idx)[0]] = [left(x) for x in draws]
    want = {}
    for q, e, i in rows:
        every = sorted(n for (at, _), n in items.items() if at == q)
        free = [n for n in every if (q, e, n) not in rows]
        want[q, e, i] = []
        for epoch in range(2):
            if kind == "cyclic":
                start = _number("x", epoch, e, i) % len(every)
                turned = every[start:] + every[:start]
                picks = [next((n for n in turned if n in free), None)]
            else:
                picks = [free[_number("graph-bpr-negative", q, epoch, e, i, s) % len(free)] if free else None for s in range(2)]
            want[q, e, i].append(picks)
    assert got == want
    assert max(t.count() for t in written) < len(rows)


@pytest.mark.parametrize("run", [1 << 10, 3])
def test_neighbours_of_items_are_found_in_runs_of_entities(spark, monkeypatch, run):
    """Consecutive holders from a hashed start, without the place of every holder."""
    monkeypatch.setattr(latent, "RUN", run)
    rows = _held()
    history = spark.createDataFrame(sorted(rows), "q int, entity string, item string")
    graph = latent._graph(history, latent.cyclic_draws(1, []), 1, fanout=2)
    names = {(r["q"], r["row"]): r["entity"] for r in graph.entities.collect()}
    items = {(r["q"], r["idx"]): r["item"] for r in graph.items.collect()}

    def turned(q, known, prefix, name):
        start = 0 if len(known) <= 2 else _number("graphsage-neighbors", f"{prefix}:{name}") % len(known)
        return {(q, name, n) for n in (known[start:] + known[:start])[:2]}

    found = {(r["q"], items[r["q"], r["idx"]], names[r["q"], r["row"]]) for r in latent.item_neighbours(history, graph, 2).collect()}
    assert found == set().union(*(turned(q, sorted(e for p, e, j in rows if (p, j) == (q, i)), "d", i) for q, _, i in rows))
    picked = graph.cells.select("q", F.explode(F.arrays_zip("rows", "picks")).alias("p")).select("q", "p.rows", F.explode("p.picks").alias("idx"))
    found = {(r["q"], names[r["q"], r["rows"]], items[r["q"], r["idx"]]) for r in picked.collect()}
    assert found == set().union(*(turned(q, sorted(i for p, f, i in rows if (p, f) == (q, e)), "p", e) for q, e, _ in rows))


def test_device_ranks_need_no_row_for_a_candidate(spark, monkeypatch):
    """Both baselines and a score by problem rank as on the listed candidates, and no score leaves its tile."""
    from tideline.plans import device

    rows = [(k, k // 30, f"p{k * k % 11}", "m") for k in range(360)]
    codes = [(k, f"c{(k * k // 7 + 3 * j) % (5 + k // 15)}") for k in range(360) for j in range(1 + k % 3)]
    study = device.DeviceStudy(
        spark.createDataFrame(rows, "key long, quarter int, product string, manufacturer string"),
        spark.createDataFrame(codes, "key long, problem string"),
        spark.createDataFrame([(f"c{k}", "B") for k in range(30)], "problem string, parent string"),
    )
    quarters = list(range(1, 12))
    shared = study.recent_products(quarters).select("q", "problem", F.col("recent_products").cast("double").alias("score"))
    shared = study.catalogue(quarters).select("q", "problem").join(shared, ["q", "problem"], "left").fillna(0.0)
    grid = study.candidates(quarters).join(study.catalogue(quarters), ["q", "problem"])
    near = study.neighbor_scores(quarters).select("q", "product", "problem", F.col("neighbor_count").cast("double").alias("score"))
    listed = study.score_ranks(grid.withColumn("score", F.lit(0.0)), "global_popularity")
    listed = listed.unionByName(study.score_ranks(grid.join(near, ["q", "product", "problem"], "left").fillna(0.0, ["score"]), "neighbor_frequency"))
    listed = listed.unionByName(study.score_ranks(grid.join(shared, ["q", "problem"]), "recent"))
    want = {tuple(r) for r in listed.collect()}
    for lister in ("two_hop_scores", "candidate_grid", "full_ranks"):
        monkeypatch.setattr(device, lister, None)
    found = study.baseline_ranks(quarters).unionByName(study.problem_score_ranks(shared, "recent", quarters))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 30


def test_epochs_of_the_logistic_fit_read_blocks_that_are_kept(spark, monkeypatch):
    """Each epoch is a step by the whole gradient, over several tasks, and plans no pass of its own."""
    from tideline.operators import blocks, logistic

    monkeypatch.setattr(blocks, "ROWS_PER_PARTITION", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    y, t = (x[:, 0] + rng.normal(size=90) > 0).astype(float), np.arange(90) % 3
    rows = spark.createDataFrame([(k, *map(float, x[k]), float(y[k]), int(t[k])) for k in range(90)], "id int, a double, b double, y double, t int")
    passes = []
    monkeypatch.setattr(logistic, "block_sum", lambda *args, real=logistic.block_sum: passes.append(1) or real(*args))
    packed = blocks.pack(rows, ["a", "b"], "y", "t", ["id"])
    specs = [logistic.Spec("all", 0, 3, (0, 1), 25, 0.3, 0.02), logistic.Spec("early", 0, 2, (1,), 7, 0.2, 0.1, balanced=True)]
    for model, spec in zip(logistic.fit(packed, ["a", "b"], specs), specs):
        own = t < spec.before
        z, target = x[own], y[own]
        z = ((z - z.mean(axis=0)) / z.std(axis=0))[:, list(spec.features)]
        lift = np.where(target == 1, (target == 0).sum() / target.sum() if spec.balanced else 1.0, 1.0)
        w, b = np.zeros(z.shape[1]), 0.0
        for _ in range(spec.epochs):
            error = lift * (1 / (1 + np.exp(-(z @ w + b))) - target)
            w, b = w - spec.rate * (error @ z / lift.sum() + spec.l2 * w), b - spec.rate * error.sum() / lift.sum()
        assert np.allclose(model.weights, w, atol=1e-12) and abs(model.intercept - b) < 1e-12
    assert packed.partitions > 1 and len(passes) == 2


def test_peer_sums_of_a_target_stay_in_one_task(spark, monkeypatch):
    """Tiles stream by the targets of several tiles; no partial sum is shuffled, and the sums are those of one tile."""
    from tideline.operators import peers

    monkeypatch.setattr(peers, "TASKS", 1)
    names = [f"f{n}" for n in range(40)]
    targets = spark.createDataFrame([(e, 100 * k + 7 * n % 90) for n, e in enumerate(names[:-3]) for k in range(1, 9)], "entity string, day int")
    links = spark.createDataFrame([(e, f"o{(n * n + j * 11) % 23}", 40 * j + n) for n, e in enumerate(names) for j in range(n % 4)], "entity string, owner string, since int").groupBy("entity", "owner").agg(F.min("since").alias("since"))
    events = targets.withColumn("serious", F.col("day") % 2)
    whole = {tuple(r) for r in peers.peer_statistics(targets, links, events).collect()}
    found = peers.peer_statistics(targets, links, events, tile=1)
    rows = found.collect()
    assert {tuple(r) for r in rows} == whole and len(rows) == len(whole) > 100
    assert found._jdf.queryExecution().analyzed().toString().startswith("FlatMapGroupsInArrow")


@pytest.mark.parametrize("items", [9, 70])
def test_similarities_are_held_a_few_rows_at_a_time(monkeypatch, items):
    """Scores of a tile equal the sums by hand in any steps, and no array has a cell for every pair of a step."""
    import pyarrow as pa

    from tideline.operators import twohop

    monkeypatch.setattr(twohop, "PAIRS", 24)
    monkeypatch.setattr(twohop, "COLUMN_CHUNK", 16)
    rng = np.random.default_rng(5)
    mine, theirs = ([sorted(rng.choice(items, 1 + k % 5, replace=False)) for k in range(n)] for n in (13, 11))
    many = np.arange(1.0, 12.0)
    flat = lambda sets: (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets))
    tile = twohop._Tile(pa.array([1]), np.arange(13), flat(mine), pa.array([None] * 13, pa.list_(pa.int32())), "jaccard", items)
    seen = []
    monkeypatch.setattr(twohop.np, "add", type("Add", (), {"outer": staticmethod(lambda a, b, real=np.add.outer: seen.append((len(a), len(b))) or real(a, b))}))
    tile.meet(many, flat(theirs))
    want = np.zeros((13, items))
    for a, own in enumerate(mine):
        for b, other in enumerate(theirs):
            want[a, other] += many[b] * len({*own} & {*other}) / len({*own} | {*other})
    assert np.allclose(tile.scores, want, atol=1e-13) and want.any()
    assert max(a * b for a, b in seen) <= 24
