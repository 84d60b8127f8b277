"""Collocations, the prefix trie and the source mix against plain recomputation, on odd rows and planted shapes."""

import collections
import hashlib
import math
import random
import re
import sys
import time
import zlib
from fractions import Fraction
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import difference, oracle_frame  # noqa: E402

from tideline.llm import collocation, mixing, prefix_trie, queries  # noqa: E402


# ------------------------------------------------------------------- phrases


def phrases_by_scan(rows, longest, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, every in counts.items():
        found = {p: a for p, a in every.items() if a >= least and len(p) > 1}
        inner = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if every[p[i : i + k]] <= a}
        scored = []
        for p, a in found.items():
            if p not in inner:
                cuts = [(1000 * a * totals[lang] // (every[p[:k]] * every[p[k:]]), k, every[p[:k]], every[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def odd_texts():
    rng = random.Random(3)
    words = ["ab", "b", "Cé", "d-d", "the", "x\x1cy", " q"]
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ",", " .", "\t", "\n"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(300)]
    passage = " ".join(f"p{k}" for k in range(90))  # a path without branches
    rows += [("say " + passage + " end", "en")] * 12 + [(passage, "en")] * 2
    rows += [("la " * 400, "fr")] * 3  # a path that runs in a circle
    rows += [(None, "en"), ("", None), (" \t\n.", "xx"), ("zz yy zz yy " * 50, None)]
    return rows


@pytest.mark.parametrize("least,longest", [(8, 5), (3, 4), (1000, 5)])
def test_collocations_equal_brute_force(spark, least, longest):
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocation.collocations(docs, longest, least, 40).collect())
    assert got == phrases_by_scan(rows, longest, least, 40)


def test_collocations_of_nothing(spark):
    assert collocation.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_paths_hold_every_edge_once(spark):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, "text string, lang string")
    paths, _, _, _ = collocation.graph(docs, 5, 3)
    edges = collections.Counter()
    for r in paths.collect():
        words = r.words.split(" ")
        assert len(words) == r.n_edges + 4
        for i in range(r.n_edges):
            edges[r.lang, tuple(words[i : i + 5])] += r.weight
    want = collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").replace("C", "c")):
            words = re.findall("[^ \t]+", piece)
            want.update((lang or "und", tuple(words[i : i + 5])) for i in range(len(words) - 4))
    assert all(edges[k] == c for k, c in want.items() if c >= 3) and all(want[k] == c for k, c in edges.items())
    assert paths.agg(F.max("n_edges")).first()[0] >= 80


def test_scores_pass_64_bits(spark):
    big = 9 * 10**15
    counts = spark.createDataFrame([("en", 2, "a b", big), ("en", 1, "a", big + 1), ("en", 1, "b", big + 2)], "lang string, n int, phrase string, c long")
    totals = spark.createDataFrame([("en", 5 * big)], "lang string, n long")
    row = collocation.scored(counts.where("n = 2"), counts, totals).first()
    assert row.score == 1000 * big * 5 * big // ((big + 1) * (big + 2)) and (row.l, row.r) == (big + 1, big + 2)


# ---------------------------------------------------------------------- trie


def rebuilt_by_hand(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.md5((str(len(role.encode())) + ":" + role + text).encode()).digest()
            convs[conv].append(((turn is not None, turn or 0), role, order, text))
    convs = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes_by_hand(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(totals[k][0] for k in kids[p]) if kids[p] else 1, own + sum(totals[k][1] for k in kids[p]))
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn int, role string, text string, depth string, digest int"


def conversations(kind):
    rng = random.Random(5)
    if kind == "odd":
        rows = [(c, t, rng.choice(["u", "a", None]), rng.choice(["x", "y", "é", "", None])) for c in range(60) for t in range(rng.randint(1, 9))]
        return rows + [(None, 1, "u", "x"), (3, None, None, None), (3, None, None, None), (4, 1, "u", "x"), (4, 1, "u", "x"), (1003, 0, "u", "alone")]
    if kind == "long":  # one chain of many turns, and conversations that leave it at every place
        main = [(5, t, "u", f"t{t}") for t in range(150)]
        return main + [(5000 + 5 * k, t, "u", f"t{t}") for k in range(30) for t in range(5 * k + 1)] + [(9000, 0, "u", "t0"), (9000, 1, "u", "z" * 50_000)]
    return [(c, t, "u", "same") for c in range(0, 500, 5) for t in range(6)]  # copies


@pytest.mark.parametrize("kind", ["odd", "long", "copies"])
def test_trie_equals_brute_force(spark, kind):
    rows = conversations(kind)
    df = spark.createDataFrame([(*r, "n", 0) for r in rows], SCHEMA)
    turns, members = prefix_trie.shared_heads(prefix_trie.ordered_turns(df))
    got = [tuple(r) for r in prefix_trie.trie(turns, members).select(*COLUMNS).collect()]
    want = nodes_by_hand(rebuilt_by_hand(rows))
    assert len(got) == len(want) and set(got) == want


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yes"), (2, 0, "u", "hi"), (2, 1, "a", "no"), (3, 0, "u", "hi")]
    got = {(r.conv_id, r.depth): (r.text, r.n_convs, r.n_leaves) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {(1, 0): (None, 3, 2), (1, 1): ("hi", 3, 2), (1, 2): ("yes", 1, 1), (2, 2): ("no", 1, 1)}


def test_trie_of_nothing(spark):
    turns, members = prefix_trie.shared_heads(prefix_trie.ordered_turns(spark.createDataFrame([], SCHEMA)))
    assert prefix_trie.trie(turns, members).count() == 0


def test_ends_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    ends = spark.range(1000).selectExpr("1L as s1", "2L as s2", "3L as s3", "id % 2 as s4", "id as conv_id")
    got = {r.s4: r.ends_sha256 for r in prefix_trie.ends_hashes(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(x) for x in range(k, 1000, 2)).encode()).hexdigest() for k in (0, 1)}


# ----------------------------------------------------------------------- mix


def targets_by_rounds(sizes):
    """Share, stop what is above, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    done, total = {}, sum(sizes.values())
    while True:
        left = [s for s in names if s not in done]
        rest, all_weight = total - sum(done.values()), sum(weight[s] for s in left)
        share = {s: Fraction(rest * weight[s], all_weight) for s in left}
        above = [s for s in left if share[s] > 3 * sizes[s]]
        if not above:
            return done | share
        done |= {s: Fraction(3 * sizes[s]) for s in above}


def mixed_docs(spark, big):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", "é", None, "Z"]) if k % 3 else "hot", " ".join(["w"] * rng.randint(0, 40))) for k in range(400)]
    rows += [(None, "a", "one two"), (7, "a", "dup dup"), (7, "a", "dup dup"), (901, "b", None), (902, "void", ""), (903, "long", "x " * big)]
    return spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, source string, text string, size int, rank string")


@pytest.mark.parametrize("big", [10, 30_000])
def test_mix_meets_its_targets(spark, big):
    docs = mixed_docs(spark, big)
    plan = mixing.planned(docs, mixing.word_count(F.col("text"))).select("row.source", "id", "size", "source_size", "target", "taken", "parts").toPandas()
    assert len(plan) == 406
    sizes = plan.groupby("source", dropna=False)["size"].sum()
    want = targets_by_rounds({None if s != s or s is None else s: int(n) for s, n in sizes.items()})
    for source, rows in plan.groupby("source", dropna=False):
        goal = float(want[None if source != source else source])
        assert (abs(rows.target - goal) < 1e-6 * max(goal, 1)).all() and abs(rows.taken.sum() - goal) <= 1
        assert (rows.taken <= 3 * rows["size"]).all() and (rows.parts.map(lambda p: sum(x["words"] for x in p)) == rows.taken).all()
        assert all(0 <= x["position"] <= 1 for p in rows.parts for x in p)


def test_curriculum_changes_over_time(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}", "w " * 10) for k in range(3000)], "doc_id long, source string, text string")
    out = mixing.curriculum(docs, mixing.word_count(F.col("text"))).toPandas()
    assert out.mix_position.is_monotonic_increasing and list(out.columns[:3]) == docs.columns
    share = {s: [((out.source == s) & (out.mix_position // 0.25 == q)).sum() for q in range(4)] for s in ("s0", "s1", "s2")}
    assert share["s0"] == sorted(share["s0"]) and share["s2"] == sorted(share["s2"], reverse=True) and max(share["s1"]) - min(share["s1"]) <= 3
    # the share of the demand that is met by each time is the integral of the schedule
    met = [(out[out.source == "s0"].mix_position <= t).mean() for t in (0.6, 1.0)]
    assert abs(met[0] - 0.45 / 0.95) < 0.01 and met[1] == 1


def test_mix_of_nothing_and_reruns(spark):
    docs = mixed_docs(spark, 50)
    size = mixing.word_count(F.col("text"))
    assert mixing.curriculum(docs.limit(0), size).count() == 0 and mixing.curriculum(docs.where("source = 'void'"), size).count() == 0
    one, two = (mixing.planned(d, size).select("id", "size", "taken", F.to_json("parts")).toPandas().astype(str) for d in (docs, docs.repartition(7)))
    assert sorted(one.itertuples(index=False)) == sorted(two.itertuples(index=False))


def test_schedules_are_checked():
    for bad in (((0.0, 1.0), (0.9, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, -1.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            mixing.segments(bad)


@pytest.mark.parametrize("name", ["op11_de_bruijn_collocations", "op12_contracted_prefix_trie", "op13_curriculum_mix"])
def test_queries_equal_sql(spark, root, name):
    assert difference(queries.QUERIES[name](spark, root).toPandas(), oracle_frame(queries.ORACLES[name], root)) is None


# ------------------------------------------------------- earlier operators recomputed plainly


def test_quality_posteriors_equal_plain_recomputation(spark, root):
    """Site rates and posteriors of all documents from their evidence, by loops over plain dictionaries."""
    from tideline.llm import quality

    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs.select("doc_id", "text", "source", "lang"), labels).select("source", "lang", "evidence", "site_rate", "quality", "accepted").collect()
    total, hosts, paths = len(rows), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        hosts[r["source"]].append(r["evidence"])
        paths[r["source"], r["lang"]].append(r["evidence"])
    mean = (sum(r["evidence"] for r in rows) + 0.5) / (total + 1)
    rate = {h: sum(x) / len(x) for h, x in hosts.items()}

    def strength(spread, sites):
        variance = mean * (1 - mean)
        return max(1.0, variance / max(spread / total - variance * sites / total, variance / quality.MAX_STRENGTH) - 1)

    strong = strength(sum(len(x) * (rate[h] - mean) ** 2 for h, x in hosts.items()), len(hosts))
    within = strength(sum(len(x) * (sum(x) / len(x) - rate[h]) ** 2 for (h, _), x in paths.items()), len(paths))
    for r in rows:
        own, here = hosts[r["source"]], paths[r["source"], r["lang"]]
        host = (sum(own) + strong * mean) / (len(own) + strong)
        site = (sum(here) + within * host) / (len(here) + within)
        assert r["site_rate"] == pytest.approx(site)
        if r["evidence"] > 0:
            odds = lambda p: math.log(p / (1 - p))
            shift = max(-quality.MAX_SHIFT, min(quality.MAX_SHIFT, odds(site) - odds(mean)))
            assert r["quality"] == pytest.approx(1 / (1 + math.exp(-(odds(r["evidence"]) + shift))))
        assert r["accepted"] == (r["quality"] >= 0.5)


def test_lm_scores_follow_the_quantised_counts(spark, root):
    """The model's score against exact quantised counts; the filter may overrate a few unseen grams."""
    from tideline.llm import ngram_lm

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    words = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").split(" ")]
    split = lambda t: re.findall(r"[^ \t-\r]+", " ".join(words(t)))
    one, two, texts = collections.Counter(), collections.Counter(), 0
    for doc, text in rows:
        if zlib.crc32(str(doc).encode()) % 5 != 1:
            tokens = split(text) + [None]
            one.update(tokens)
            two.update(zip([0, *tokens], tokens))
            texts += 1
    n, v = sum(one.values()), len(one)
    quantised = lambda c: 0 if c == 0 else 1 if c == 1 else 1.5 * 2 ** (c.bit_length() - 1)
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op6_bloom_lm"](spark, root).collect()}
    off = []
    for doc, text in rows:
        tokens, score, before, last = split(text) + [None], 0.0, texts, 0
        for t in tokens:
            own, pair = quantised(one[t]), quantised(two[last, t])
            p = (own + 0.5) / (n + 0.5 * (v + 1))
            score += math.log10((min(pair, before) + ngram_lm.MU * p) / (before + ngram_lm.MU))
            before, last = own, t
        off.append(abs(got[doc] - score) / abs(score))
    off.sort()
    assert off[len(off) // 2] < 0.01 and off[int(0.95 * len(off))] < 0.1  # one overrated gram weighs much in a text of a few words


def test_secrets_of_a_long_dump_are_linear_enough(spark):
    """A text of a megabyte with 50,000 secrets: right places, right redaction, in seconds."""
    from tideline.llm import secrets

    text = "é" + "".join(f"{k:016x} \u65e5" for k in range(50_000)) + " password=" + "a" * 16 + " end"
    df = spark.createDataFrame([(1, text), (2, "AKIA" + "Z" * 16 + " token: abcdefghijkl AKIA" + "Y" * 20)], "doc_id long, text string")
    start = time.time()
    found = {r["doc_id"]: r["secret_spans"] for r in secrets.with_spans(df).collect()}
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert time.time() - start < 60
    assert [(s["start"], s["end"]) for s in found[1][:3]] == [(1, 17), (19, 35), (37, 53)] and len(found[1]) == 50_002
    assert masked[1] == "é" + "[SECRET] \u65e5" * 50_000 + " [SECRET] end" and masked[2] == "[SECRET] [SECRET] [SECRET]"
