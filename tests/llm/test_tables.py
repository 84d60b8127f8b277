"""The operators as Spark jobs: odd rows, and plain recomputation on the smallest tables."""

import collections
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import difference, oracle_frame  # noqa: E402

import corpus_pipeline  # noqa: E402
from tideline.llm import ann, bpe, decontaminate, near_dedup, ngram_lm, quality, queries, secrets, token_counts, toxicity, url_filter  # noqa: E402

LONG = "lorem ipsum dolor " * 20000
TEXT = "The quick brown fox jumps over the lazy dog and then runs far away from the noisy town"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like those that operators use."""
    rows = [
        (1, TEXT, "a", "en"), (1, TEXT, "a", "en"), (2, TEXT.upper(), "a", "en"), (3, None, "a", None), (4, "", None, "en"), (5, " \n\t", "b", "en"),
        (6, LONG, "b", "en"), (None, TEXT, "b", "en"), (None, "password = 'abcdefghijkl0123' and ghp_" + "a" * 36, "b", "en"), (7, "token: deadbeefdeadbeef00 é", "b", "fr"), (8, "one", "b", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.selectExpr("*", *(f"'x' as {c}" for c in ("features", "evidence", "bands", "label", "bucket", "rep", "part", "levels", "host", "data", "n_hit", "grams", "kinds", "token_ids", "severity", "row", "word")))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 1), (None, 1, 1), (3, None, None), (8, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(docs, labels):
    out = quality.judged(docs, labels).toPandas()
    assert len(out) == 11 and out.accepted.notna().all() and {"bucket", "evidence"} <= set(out.columns)
    assert not out[out.text.fillna("").str.strip() == ""].accepted.any()
    assert (quality.judged(docs, labels.limit(0)).toPandas().evidence.isin([0.0, 0.5])).all()


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "p", 1.0)] * 400 + [("big", "q", 0.0)] * 400 + [("small", "p", 0.0)]
    rates = {(r.h, r.q): r.site_rate for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double"), "host", "path").collect()}
    assert rates["big", "p"] > 0.9 and rates["big", "q"] < 0.1 < rates["small", "p"]


def test_near_duplicates(docs):
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2).collect()}
    assert {(1, 17, 1, True), (2, 17, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (8, 1, 8, True), (None, 17, None, True)} <= out
    assert near_dedup.without_near_duplicates(docs).count() == 9


def test_near_duplicates_of_many_variants_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(400):  # a group of variants, many of them around the limit
        words = list(base) if k < 330 else [f"u{k % 7}_{j}" for j in range(40)]
        for at in rng.integers(0, len(words), rng.integers(0, 9)):
            words[at] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(words))
    sets = [set(zip(w, w[1:])) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == {k: find(k) for k in range(len(texts))}


def test_toxicity(docs, labels):
    model = toxicity.trained(docs, labels, grade="toxic")
    assert toxicity.scored(docs, model).count() == 11
    none = toxicity.scored(docs, toxicity.trained(docs, labels.limit(0), grade="toxic")).toPandas()
    assert (none.severity == 0).all() and (none.grade == 0).all()


def test_bpe_keeps_columns(docs):
    out = bpe.encode(docs, queries.vocabulary_path(), decode=True)
    rows = out.toPandas()
    assert len(rows) == 11 and out.columns[:4] == docs.columns[:4] and (rows[rows.text.isna()].token_ids.map(len) == 0).all()
    again = bpe.decode(out.drop("decoded_text"), queries.vocabulary_path()).toPandas()
    assert sorted(again.decoded_text) == sorted(rows.decoded_text)


def test_secrets(docs):
    rows = secrets.with_spans(docs).selectExpr("doc_id", "text", "secret_spans").toPandas()
    assert len(rows) == 11
    spans = {t: [(s.kind, s.start, s.end) for s in x] for t, x in zip(rows.text, rows.secret_spans)}
    assert spans["token: deadbeefdeadbeef00 é"] == [("assign", 0, 25), ("hex", 7, 25)]
    assert [s[0] for s in next(v for k, v in spans.items() if k and k.startswith("password"))] == ["assign", "github", "hex"]
    masked = {t for (t,) in secrets.redacted(docs).select("text").collect()}
    assert "[SECRET] é" in masked and None in masked and LONG in masked


def test_lm(docs):
    from pyspark.sql import functions as F

    one = ngram_lm.score(docs, F.col("doc_id") != 8).toPandas()
    many = ngram_lm.score(docs, F.col("doc_id") != 8, slice_mb=0).toPandas()
    assert len(one) == 11 and set(one[one.held_out].doc_id) == {8.0} and one.score.notna().all()
    key = ["doc_id", "n_tokens", "base_score"]
    assert np.allclose(one.sort_values(key).score, many.sort_values(key).score)
    assert ngram_lm.score(docs.limit(0), F.lit(True)).count() == 0 and (ngram_lm.score(docs, F.lit(False)).toPandas().n_known == 0).all()


def test_lm_base_score_is_exact(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").toPandas()
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in zip(docs.doc_id, docs.text)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = collections.Counter(w for i, x in words.items() if not held[i] for w in x)
    total, distinct = sum(counts.values()), len(counts)
    for r in queries.op6_bloom_lm(spark, root).collect():
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), rel_tol=1e-9)


def test_token_counts(docs):
    import public_tokenizers

    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = token_counts.section_counts(docs, *args).toPandas()
    assert (rows[rows.doc_id == 3][["char_end", "n_tokens"]].to_numpy() == 0).all() and len(rows[rows.doc_id == 5]) == 2
    assert token_counts.section_counts(docs.limit(0), *args).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "JUMPS over, the lazy dog and then runs far away"), (1, "nothing here"), (None, "quick brown"), (2, None), (3, "")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).toPandas()
    hit = rows[rows.text == TEXT].iloc[0]
    assert (hit.n_words, hit.n_hit, hit.n_items, list(hit.item_ids), list(hit.hit_spans)) == (18, 12, 2, ["1"], [1, 3, 4, 14])
    assert (decontaminate.contaminated(docs, bench.limit(0)).toPandas().n_hit == 0).all()


def test_url_filter(spark):
    rows = [
        (1, "http://a.com/x?q", "<a href='//Friend.org/'>"), (2, "x://B.example.com/en/1#t", '<a href="https://a.com/">'), (3, "http://bad.net/fr/1", None), (4, "ftp://linker.org/de", "<a href=http://bad.net/y>"),
        (5, None, None), (6, "nothing", ""), (7, "://www.example.com/en/", ""), (8, "http://friend.org/de/", ""), (8, "http://friend.org/de/", ""), (9, "http://bad.net/de", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "'y' as src")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(df).collect()}
    assert out[1] == ("a.com", "/x", "com/", "allow") and out[2] == ("b.example.com", "/en/1", "example.com/en/", "block") and out[3][2:] == ("net/fr/", "block")
    assert out[4] == ("linker.org", "/de", None, "block") and out[5] == out[6] == ("", "", None, "allow") and out[7][2:] == ("www.example.com/en/", "allow")
    assert out[8] == ("friend.org", "/de/", None, "allow") and out[9][3] == "block"
    assert url_filter.filtered(df.limit(0)).count() == 0


def test_ranks_equal_power_iteration(spark):
    edges = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "c", 1), ("d", "a", 3)]
    seeds = spark.createDataFrame([("a", 2, 0), ("d", 0, 1)], "host string, good long, bad long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagated(seeds, spark.createDataFrame(edges, "src string, dst string, n long"), rounds=8, tolerance=0).collect()}
    names = "abcd"
    flow = np.zeros((4, 4))
    for s, d, n in edges:
        flow[names.index(s), names.index(d)] = n
    for k, (matrix, seed) in enumerate(((flow, [1, 0, 0, 0]), (flow.T, [0, 0, 0, 1]))):
        seed = np.array(seed, float)
        sums = matrix.sum(1)
        step = np.divide(matrix, sums[:, None], out=np.zeros_like(matrix), where=sums[:, None] > 0)
        rank = seed.copy()
        for _ in range(8):
            rank = 0.85 * rank @ step + (0.15 + 0.85 * rank[sums == 0].sum()) * seed
        assert np.allclose([got[x][k] for x in names], rank)


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[100]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5, x[5].tolist()), (400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (None, [1.0] * 8), (404, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    for q, rows in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(300), -np.round(s, 9)))[:20]
        assert rows.sort_values("rank").vec_id.tolist() == order.tolist()
    assert sorted(found.query_id.unique()) == list(range(0, 300, 20))
    assert ann.search(df.limit(0), df, 20).count() == 0


def test_count_buckets_follow_the_corpus(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    few = ngram_lm.score(docs, F.col("doc_id") != 8).toPandas()
    used, filters = [], ngram_lm.filters
    monkeypatch.setattr(ngram_lm, "filters", lambda partial, buckets: used.append(buckets) or filters(partial, buckets))
    monkeypatch.setattr(ngram_lm, "BUCKET_BYTES", 1024)
    many = ngram_lm.score(docs, F.col("doc_id") != 8).toPandas()
    assert used[0] >= len(LONG) / 1024 > max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    exact = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    assert difference(few[exact], many[exact]) is None


def test_an_overlong_vector_drops_no_other(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(60, [1.0] * 9), (7, [-9.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, df.where("vec_id IN (0, 7, 60)"), 20).toPandas()
    assert found.groupby("query_id").size().to_dict() == {0: 20, 7: 20} and found.vec_id.max() < 60
    alone = ann.search(df.where("vec_id < 60"), df.where("vec_id = 60"), 20)
    assert alone.count() == 0


def test_neighbours_of_outliers_in_a_skewed_table(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile(rng.normal(size=16), (2390, 1)), rng.normal(size=(10, 16))])[rng.permutation(2400)]
    out = np.flatnonzero((x != np.median(x, axis=0)).any(1)).tolist()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, df.where(df["vec_id"].isin([*out, 0, 1])), 20).toPandas()
    count = found.groupby("query_id").size()
    assert sorted(count.index) == sorted({*out, 0, 1}) and (count == 20).all()
    hit = 0
    for q, rows in found.groupby("query_id"):
        score = (x * x[q]).sum(1)
        assert q not in set(rows.vec_id) and rows.vec_id.is_unique and np.allclose(rows.score, score[rows.vec_id])
        score[q] = -np.inf
        hit += (rows.score >= np.sort(score)[-20] - 1e-9).sum()
    assert hit >= 0.9 * len(found)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_its_sql(spark, root, name):
    assert difference(queries.QUERIES[name](spark, root).toPandas(), oracle_frame(queries.ORACLES[name], root)) is None


def test_pipeline_stages(spark, docs, root):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, root)
        if name != "encode":
            assert kept.columns == docs.columns
    rows = kept.toPandas()
    assert "token_ids" in rows.columns and not rows.text.fillna("").str.contains("deadbeef").any() and 0 < len(rows) <= 11
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), root).count() == 0
