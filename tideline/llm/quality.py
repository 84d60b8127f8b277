"""Quality by hierarchical empirical Bayes: a document classifier combined with host and path posteriors.

1. A logistic classifier over the make-up of the text (shares of symbols, bars, exclamation marks, capitals and digits,
   overall and in the worst line; word lengths; repetition) gives each document the evidence p. It is fitted on at most
   `max_labelled` labelled documents, those with the least hash of their id; the bound is a parameter.
2. Grouped sums of p give every host and every path of a host its number of documents and expected good ones. The
   global prior is a beta distribution whose strength comes from the spread of the hosts' rates (method of moments), a
   host's from the spread of its paths; a host's posterior mean shrinks towards the global mean, a path's towards its
   host, and sparse sites shrink most.
3. The classifier's odds are multiplied by the ratio of the path's prior odds to the global odds; a document is
   accepted if the result is at least `threshold`.

The site may move the log odds by at most MAX_SHIFT, so that a clear document of a poor site is judged by itself.

Defined cases: null or empty text has empty features and is judged as such (it is rejected: nothing in it can be good);
a null host or path is a site of its own; repeated rows are each judged; no labels or labels of one kind give p = 0.5
for every document that isn't empty; an empty table gives an empty result. Other columns pass unchanged; columns named
like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import appended, written

MAX_LABELLED = 20_000
SLICE_BYTES = 4 << 20
MAX_SHIFT = 1.0
MAX_STRENGTH = 1e6
_TYPES = {"symbol": b"#$%&*+<=>@\\^_`{}~", "bar": b"|", "mark": b"!?", "upper": bytes(range(65, 91)), "digit": b"0123456789"}
_MASKS = np.array([np.isin(np.arange(256), list(x)) for x in _TYPES.values()])
WIDTH = 2 * len(_TYPES) + 7


def features(text: bytes) -> np.ndarray:
    """The make-up of one text; all zero for an empty one."""
    out = np.zeros(WIDTH)
    words = text.split()
    if not words:
        return out
    raw = np.frombuffer(text, np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = _MASKS @ np.bincount(raw, minlength=256)
    n = len(_TYPES)
    out[:n] = counts / len(raw)
    block = b"\n".join(lines)
    row = np.frombuffer(block, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(row == 10) + 1])
    size = np.diff(np.append(starts, len(row)))
    for k in range(n):
        out[n + k] = ((np.add.reduceat(_MASKS[k][row].astype(np.int64), starts)) / (size + 20)).max()
    out[2 * n :] = (
        np.log1p(len(words)), sum(map(len, words)) / len(words) / 10, max(map(len, words)) ** 0.5 / 10, len(set(lines)) / len(lines),
        len(set(words)) / len(words), np.log1p(len(words) / len(lines)), 1.0,
    )
    return out


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    def prepare() -> Callable[[list], list]:
        def work(texts: list) -> list:
            block = np.array([features(x) for x in texts])
            return [pa.FixedSizeListArray.from_arrays(pa.array(block.ravel()), WIDTH).cast(pa.list_(pa.float64()))]

        return work

    return appended(docs, prepare, "features array<double>", SLICE_BYTES, text)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a penalised logistic regression (Newton steps) over standardised columns; the last column is constant."""
    centre, scale = x.mean(0), x.std(0)
    centre[-1], scale[-1] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (x - centre) / scale
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = w / scale
    out[-1] = w[-1] - (out[:-1] * centre[:-1]).sum()
    return out


def fit(scored: DataFrame, labels: DataFrame, key: str, label: str, max_labelled: int) -> list[float] | None:
    """Classifier weights from at most `max_labelled` labelled documents; None without two kinds of labels."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("good"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(max_labelled)
    rows = scored.select(key, "features").where(f"features[{WIDTH - 1}] > 0").join(chosen, key).select("features", "good").toPandas()
    y = (rows["good"] > 0).to_numpy(float)
    if len(np.unique(y)) < 2:
        return None
    return fit_logistic(np.stack(rows["features"].to_list()), y, np.ones(len(y))).tolist()


def site_rates(scored: DataFrame, host: str, path: str) -> DataFrame:
    """(host, path, site_rate, base_rate): shrunken rates from grouped sums of the evidence."""
    paths = written(scored.groupBy(F.col(host).alias("h"), F.col(path).alias("q")).agg(F.count("*").alias("n"), F.sum("evidence").alias("good")))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")).withColumnRenamed("h", "hh")
    total = hosts.agg(F.sum("hn"), F.sum("hgood")).first()
    mean = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.5
    own = F.col("hgood") / F.col("hn")
    strong = strength(hosts.agg(F.sum(F.col("hn") * F.pow(own - mean, 2)), F.sum(own * 0 + 1), F.sum("hn")).first(), mean)
    both = paths.join(hosts, F.col("h").eqNullSafe(F.col("hh")))
    within = strength(both.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - own, 2)), F.count("*"), F.sum("n")).first(), mean)
    host_rate = (F.col("hgood") + strong * mean) / (F.col("hn") + strong)
    return both.select("h", "q", ((F.col("good") + within * host_rate) / (F.col("n") + within)).alias("site_rate"), F.lit(mean).alias("base_rate"))


def strength(sums: tuple, mean: float) -> float:
    """How many documents a prior counts: the method of moments over (weighted squared deviations, sites, documents)."""
    if not sums[2]:
        return 1.0
    variance = mean * (1 - mean)
    spread = max(sums[0] / sums[2] - variance * sums[1] / sums[2], variance / MAX_STRENGTH)
    return max(1.0, variance / spread - 1)


def judged(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", key: str = "doc_id", label: str = "quality",
    text: str = "text", threshold: float = 0.5, max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """`docs` with evidence, site_rate, quality (posterior probability of a good document) and accepted."""
    docs = docs.drop("features", "evidence", "site_rate", "quality", "accepted")
    narrow = written(with_features(docs.select(F.col(key).alias("k"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text"))).drop("text"))
    weights = fit(narrow.withColumnRenamed("k", key), labels, key, label, max_labelled)

    def evidence(full):
        if weights is None:
            return F.lit(0.5) * full
        terms = sum((F.col("features")[k] * w for k, w in enumerate(weights)), F.lit(0.0))
        return F.when(full > 0, 1 / (1 + F.exp(-F.least(F.greatest(terms, F.lit(-30.0)), F.lit(30.0))))).otherwise(0.0)

    full = F.col("features")[WIDTH - 1]
    rates = site_rates(narrow.select("host", "path", evidence(full).alias("evidence")), "host", "path")
    scored = with_features(docs, text).withColumn("evidence", evidence(full)).drop("features")
    joined = scored.join(F.broadcast(rates) if rates_fit(rates) else rates, scored[host].eqNullSafe(rates["h"]) & scored[path].eqNullSafe(rates["q"]), "left")
    odds = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    shift = F.greatest(F.lit(-MAX_SHIFT), F.least(F.lit(MAX_SHIFT), odds("site_rate") - odds("base_rate")))
    posterior = F.when(F.col("evidence") > 0, 1 / (1 + F.exp(-(odds("evidence") + shift)))).otherwise(0.0)
    return joined.withColumn("quality", posterior).withColumn("accepted", F.col("quality") >= threshold).drop("h", "q", "base_rate")


def rates_fit(rates: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sites has a size that may be sent to all tasks."""
    return rates.count() <= most
