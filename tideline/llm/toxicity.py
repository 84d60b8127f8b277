"""Toxicity by cumulative-link ordinal regression over sparse text features.

Severity grades 0 < 1 < ... < K - 1 share one weight vector w over hashed features (words and their first letters, each
present or not); the ordered thresholds t_1 < ... < t_{K-1} separate the grades:

    P(grade >= k | x) = sigmoid(w x - t_k),      expected severity = sum over k of P(grade >= k | x).

The model is fitted on at most `max_rows` labelled documents, those of each grade with the least hash of their key (so
rare grades are kept), and each is weighted by the share of its grade that was taken, so that the thresholds keep the
true frequencies. The bound is a parameter. All documents are scored whole.

Defined cases: null or empty text has no features and is judged by the thresholds alone; repeated rows are each scored;
repeated labels of a key count once, by the worst; labels of fewer than two grades give severity 0 (or the one grade) to
all; an empty table gives an empty result. Other columns pass unchanged; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import LOWER, appended, int_lists, starts_of

BUCKETS = 1 << 18
PREFIXES = (4, 5)
#: Features get a weight only if their share of graded documents is so many deviations from the usual one.
LEAST_DEVIATIONS = 4.0
MAX_ROWS = 12_000
SLICE_BYTES = 4 << 20
_STRIP = b".,;:!?\"'()[]{}<>*#$%&|"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, laid end to end, and how many each has."""
    words = [set(w.strip(_STRIP) for w in x.translate(LOWER).split()) - {b""} for x in texts]
    raw = [w.union(*({b"^" + v[:n] for v in w} for n in PREFIXES)) for w in words]
    lengths = np.array([len(x) for x in raw], np.int64)
    ids = (np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(raw)), np.uint64, int(lengths.sum())) % np.uint64(BUCKETS)).astype(np.int32)
    return ids, lengths


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., a row for each text."""
        total = np.zeros(len(lengths))
        full = lengths > 0
        if full.any():
            total[full] = np.add.reduceat(self.weights[ids].astype(np.float64), starts_of(lengths[full]))
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds, -30, 30)))


def telling_features(ids: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Whether each feature occurs in marked documents clearly more or less often than chance."""
    seen, hits, rate = np.bincount(ids, minlength=BUCKETS), np.bincount(ids[marked], minlength=BUCKETS), marked.mean() if len(marked) else 0.0
    spread = np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-12))
    return (np.abs(hits - seen * rate) >= LEAST_DEVIATIONS * spread) & (seen >= 3)


def fit(ids: np.ndarray, lengths: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, penalty: float = 0.1, steps: int = 300) -> Model:
    """Maximum likelihood of the cumulative-link model by Adam over the whole sample; thresholds stay ordered by their gaps."""
    telling = telling_features(ids, np.repeat(grade > 0, lengths))[ids]
    used, place = np.unique(ids[telling], return_inverse=True)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[telling]
    weight = weight / weight.sum()
    above = np.array([(weight * (grade >= k)).sum() for k in range(1, grades)]).clip(1e-6, 1 - 1e-6)
    first = np.log((1 - above) / above)
    gaps = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    params = np.concatenate([np.zeros(len(used)), gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    n, k = len(used), np.arange(len(lengths))
    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate([params[n : n + 1], np.exp(params[n + 1 :])]))
        total = np.bincount(row, params[place], len(lengths))
        s = 1 / (1 + np.exp(-np.clip(total[:, None] - thresholds, -30, 30)))
        edge = np.hstack([np.ones((len(s), 1)), s, np.zeros((len(s), 1))])  # P(grade >= 0 ... K)
        slope = np.hstack([np.zeros((len(s), 1)), s * (1 - s), np.zeros((len(s), 1))])
        p = np.maximum(edge[k, grade] - edge[k, grade + 1], 1e-12)
        d_total = -weight * (slope[k, grade] - slope[k, grade + 1]) / p
        d_cut = np.zeros((len(s), grades + 1))
        d_cut[k, grade] += weight * slope[k, grade] / p
        d_cut[k, grade + 1] -= weight * slope[k, grade + 1] / p
        cuts = d_cut[:, 1:grades].sum(0)
        tails = np.cumsum(cuts[::-1])[::-1]
        grad = np.concatenate([np.bincount(place, d_total[row], n) + penalty * params[:n] / len(lengths), tails[:1], tails[1:] * np.exp(params[n + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = params[:n]
    return Model(weights, np.cumsum(np.concatenate([params[n : n + 1], np.exp(params[n + 1 :])])))


def split_top(ids: np.ndarray, lengths: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Grades with the top one split in two: documents with more telling features than the middle one are worse."""
    top = grade == grade.max()
    telling = telling_features(ids, np.repeat(top, lengths))[ids]
    hits = np.bincount(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[telling], minlength=len(lengths))
    return grade + (top & (hits > np.median(hits[top])))


def with_feature_ids(docs: DataFrame, text: str = "text") -> DataFrame:
    def prepare() -> Callable[[list], list]:
        return lambda texts: [int_lists(*features(texts), pa.int32())]

    return appended(docs, prepare, "feature_ids array<int>", SLICE_BYTES, text)


def trained(docs: DataFrame, grades: DataFrame, key: str = "doc_id", grade: str = "grade", text: str = "text", max_rows: int = MAX_ROWS, split: bool = False) -> Model | int:
    """The model of a bounded sample of graded documents, or the one grade that occurs.

    `split` is for labels that only say yes or no: the top grade is divided by the number of telling features.
    """
    known = grades.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(key).agg(F.max(grade).cast("int").alias("g"))
    totals = {r[0]: r[1] for r in known.groupBy("g").count().collect()}  # a row for each grade
    if len(totals) < 2:
        return max(totals, default=0)
    share = max_rows // len(totals)
    order = Window.partitionBy("g", "deal").orderBy(F.xxhash64(key), key)
    dealt = known.withColumn("deal", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(64)))  # each deal gives its least, the least of those stay
    least = dealt.withColumn("n", F.row_number().over(order)).where(F.col("n") <= share)
    chosen = least.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64(key), key))).where(F.col("n") <= share).select(key, "g")
    sample = docs.select(key, text).join(F.broadcast(chosen), key)  # at most max_rows keys
    rows = with_feature_ids(sample, text).select("g", "feature_ids").toArrow()
    lists = rows.column("feature_ids").combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    grade_of = rows.column("g").to_numpy().astype(np.int64)
    taken = np.bincount(grade_of, minlength=max(totals) + 1)
    weight = np.array([totals.get(g, 0) / max(1, taken[g]) for g in range(len(taken))])[grade_of]
    if split:
        grade_of = split_top(ids, lengths, grade_of)
    return fit(ids, lengths, grade_of, weight, int(grade_of.max()) + 1)


def scored(docs: DataFrame, model: Model | int, text: str = "text") -> DataFrame:
    """`docs` with at_least (P(grade >= k)), severity (expected grade) and grade (the most probable side of each threshold)."""
    if isinstance(model, int):
        base = docs.drop("at_least", "severity", "grade")
        return base.withColumns({"at_least": F.array().cast("array<double>"), "severity": F.lit(float(model)), "grade": F.lit(model)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare() -> Callable[[list], list]:
        def work(texts: list) -> list:
            p = shared.value.at_least(*features(texts))
            each = np.full(len(p), p.shape[1])
            return [int_lists(p.ravel(), each, pa.float64()), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1).astype(np.int32))]

        return work

    return appended(docs, prepare, "at_least array<double>, severity double, grade int", SLICE_BYTES, text)
