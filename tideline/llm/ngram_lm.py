"""LM scoring from a log-frequency Bloom filter of quantised n-gram counts.

Training n-grams (words and word pairs, each document closed by an end token) are hashed, counted in each task, packed
by hash bucket and summed bucket by bucket. A gram with count c has level 1 + floor(log2 c), and the pairs (gram, 1) ...
(gram, level) enter the filter of its bucket, sized for BITS bits an entry. The level is read back by probing 1, 2, ...
until a probe fails; a count of level l is taken as 2 ** (l - 1) * 1.5 (1 at level 1). The model is

    p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU),  p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

with the first word conditioned on the start of a document.

The filter is broadcast in slices of at most `slice_mb`: with several slices the texts are passed once for each, so
that the size sent to a task stays bounded however large the corpus is; levels found so far travel with the text.

Exact unigram counts serve the base score: the HEAD most frequent words are broadcast (a fixed size), all others are
joined by a shuffle.

Defined cases: null text is empty and scores its end token alone; a null key is training data; repeated rows are each
scored and each counted; without training rows N and V are 0 and every word is unknown; an empty table gives an empty
result. Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import LOWER, int_lists, scramble, slices, starts_of, written

SLICE_BYTES = 4 << 20
FLUSH = 4_000_000
BITS, PROBES = 8, 5
HEAD = 1 << 17
MU = 2.0
SLICE_MB = 256
#: Training text that a hash bucket stands for; its partial counts meet in one task.
BUCKET_BYTES = 4 << 20
END, START = (np.uint64(xxh3_64_intdigest(x)) for x in (b"", b" "))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end token, laid end to end, and their numbers."""
    rows = [x.translate(LOWER).split() for x in texts]
    lengths = np.array([len(x) + 1 for x in rows], np.int64)
    out = np.full(int(lengths.sum()), END)
    ends = np.cumsum(lengths) - 1
    words = np.ones(len(out), bool)
    words[ends] = False
    out[words] = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(rows)), np.uint64, int(words.sum()))
    return out, lengths


def pairs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each token with the one before it."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts_of(lengths)] = START
    return scramble(words ^ scramble(before, 3), 5)


def packed(keys: np.ndarray) -> bytes:
    """Sorted integers as differences, byte plane by byte plane: most planes are zero and vanish in the shuffle's compression."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def bucket_count(size: int, partitions: int) -> int:
    """Buckets for `size` bytes of training text, so that a bucket keeps its size however large the corpus is."""
    return max(64, 4 * partitions, -(-size // BUCKET_BYTES))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def positions(keys: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The PROBES bit numbers of (key, level) in a filter of `bits` bits."""
    with np.errstate(over="ignore"):
        first = scramble(keys ^ scramble(np.asarray(level, np.uint64), 11), 13)
        step = scramble(first, 17) | np.uint64(1)
        for k in range(PROBES):
            yield ((first + np.uint64(k) * step) >> np.uint64(8)) % np.asarray(bits, np.uint64)


def counted(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(part, keys, counts): packed partial counts; part is the bucket, plus `buckets` for pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for order, blocks in enumerate(held):
                if not blocks:
                    continue
                keys, counts = np.unique(np.concatenate(blocks), return_counts=True)
                edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                rows = [(order * buckets + b, packed(keys[x:y]), counts[x:y].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["part", "keys", "counts"])
                blocks.clear()

        for batch in batches:
            for part in slices(batch, batch.column(0), SLICE_BYTES):
                words, lengths = tokens(part.column(0).to_pylist())
                held[0].append(words)
                held[1].append(pairs(words, lengths))
                size += len(words)
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")).mapInArrow(run, "part int, keys binary, counts binary")


def filters(partial: DataFrame, buckets: int) -> DataFrame:
    """(part, bits, n, total, words, counts) for each bucket: its filter; for single words also the exact counts."""

    def merge(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        keys = np.concatenate([unpacked(x.as_py()) for x in group.column("keys")])
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in group.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[head], np.add.reduceat(counts, head)
        level = levels_of(counts)
        size = 64 * (1 + int(level.sum()) * BITS // 64)
        bits = np.zeros(size, bool)
        for k in range(1, int(level.max()) + 1):
            for at in positions(keys[level >= k], k, size):
                bits[at.astype(np.int64)] = True
        single = part < buckets
        lists = [pa.array([x.tolist() if single else []], pa.list_(pa.int64())) for x in (keys.view(np.int64), counts)]
        return pa.Table.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), *lists],
            names=["part", "bits", "n", "total", "words", "counts"],
        )

    return partial.groupBy("part").applyInArrow(merge, "part int, bits binary, n long, total long, words array<long>, counts array<long>")


class Filter:
    """The filters of some parts, laid end to end; the level of a gram in another part is 0."""

    def __init__(self, rows: list[tuple[int, bytes]], parts: int, buckets: int):
        self.buckets = buckets
        self.size, self.base = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
        at = 0
        for part, bits in rows:
            self.size[part], self.base[part] = 8 * len(bits), at
            at += 8 * len(bits)
        self.data = np.frombuffer(b"".join(bits for _, bits in rows), np.uint8)

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        part = bucket_of(keys, self.buckets) + order * self.buckets
        out = np.zeros(len(keys), np.uint8)
        live = np.flatnonzero(self.size[part] > 0)
        level = 0
        while len(live):
            level += 1
            base, held = self.base[part[live]], np.ones(len(live), bool)
            for at in positions(keys[live], level, self.size[part[live]]):
                where = at.astype(np.int64) + base
                held &= ((self.data[where >> 3] >> (where & 7).astype(np.uint8)) & 1).astype(bool)
            live = live[held]
            out[live] = level
        return out


def found_levels(one: Filter, words: np.ndarray, lengths: np.ndarray, known: list[bytes | None]) -> np.ndarray:
    """Levels of each token and of its pair with the one before, and those that earlier slices have found."""
    found = np.zeros((len(words), 2), np.uint8)
    for order, grams in enumerate((words, pairs(words, lengths))):
        names, place = np.unique(grams, return_inverse=True)
        found[:, order] = one.levels(names, order)[place]
    if any(known):
        found = np.maximum(found, np.frombuffer(b"".join(known), np.uint8).reshape(-1, 2))
    return found


def count_at(level: np.ndarray) -> np.ndarray:
    return np.where(level > 1, 1.5 * 2.0 ** (level.astype(np.float64) - 1), level)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", slice_mb: int = SLICE_MB) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    texts, size = base.where("train").agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()
    buckets = bucket_count(int(size or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = written(filters(counted(base.where("train"), "text", buckets), buckets))
    single = model.where(F.col("part") < buckets)
    total, distinct = (int(x or 0) for x in single.agg(F.sum("total"), F.sum("n")).first())
    counts = single.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    counts = written(counts)
    top = counts.orderBy(F.col("c").desc(), "word").limit(HEAD).toPandas().sort_values("word")
    head = spark.sparkContext.broadcast((top["word"].to_numpy(np.int64), top["c"].to_numpy(np.int64)))
    log_base = np.log10(total + 0.5 * (distinct + 1)) if total else 0.0

    # parts by slice: one after the other until a slice is full
    sizes = model.select("part", F.octet_length("bits").alias("size")).orderBy("part").collect()  # a row for each bucket
    groups: list[list[int]] = [[]]
    filled = 0
    for part, size in sizes:
        if filled + size > slice_mb << 20 and groups[-1]:
            groups.append([])
            filled = 0
        groups[-1].append(part)
        filled += size

    def slice_of(chosen: list[int]):
        rows = [(r[0], bytes(r[1])) for r in model.where(F.col("part").isin(chosen)).select("part", "bits").collect()] if chosen else []
        return spark.sparkContext.broadcast(Filter(rows, 2 * buckets, buckets))

    def looked_up(df: DataFrame, chosen: list[int]) -> DataFrame:
        shared = slice_of(chosen)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, batch.column("data"), SLICE_BYTES):
                    words, lengths = tokens(part.column("data").to_pylist())
                    flat = found_levels(shared.value, words, lengths, part.column("levels").to_pylist()).tobytes()
                    ends = np.cumsum(lengths) * 2
                    levels = pa.array([flat[a:b] for a, b in zip((ends - 2 * lengths).tolist(), ends.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], levels], names=part.schema.names)

        return df.mapInArrow(run, "doc_id long, train boolean, data binary, levels binary")

    state = base.select("doc_id", "train", F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.lit(None).cast("binary").alias("levels"))
    for chosen in groups[:-1]:
        state = written(looked_up(state, chosen))
    last = slice_of(groups[-1])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, head_counts = head.value
        for batch in batches:
            for part in slices(batch, batch.column("data"), SLICE_BYTES):
                words, lengths = tokens(part.column("data").to_pylist())
                starts = starts_of(lengths)
                level = found_levels(last.value, words, lengths, part.column("levels").to_pylist())
                own, pair = count_at(level[:, 0]), count_at(level[:, 1])
                before = np.empty(len(own))
                before[1:] = own[:-1]
                before[starts] = texts
                p = (own + 0.5) / (total + 0.5 * (distinct + 1)) if total else np.ones(len(own))
                model_score = np.add.reduceat(np.log10((np.minimum(pair, before) + MU * p) / (before + MU)), starts)
                signed = words.view(np.int64)
                at = np.minimum(np.searchsorted(head_words, signed), max(0, len(head_words) - 1))
                hit = head_words[at] == signed if len(head_words) else np.zeros(len(words), bool)
                value = np.where(hit, np.log10(head_counts[at] + 0.5) if len(head_words) else 0.0, 0.0)
                owner = np.repeat(np.arange(len(lengths)), lengths)[~hit]
                tail = signed[~hit]
                order = np.lexsort((tail, owner))
                owner, tail = owner[order], tail[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (tail[1:] != tail[:-1])])) if len(tail) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(tail)))
                each = np.bincount(owner[first], minlength=len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("train"), pa.array(lengths), pa.array(np.add.reduceat(hit.astype(np.int64), starts)), pa.array(np.add.reduceat(value, starts)),
                     pa.array(model_score), int_lists(tail[first], each, pa.int64()), int_lists(times, each, pa.int64())],
                    names=["doc_id", "train", "n_tokens", "head_known", "head_sum", "score", "tail", "times"],
                )

    out = state.mapInArrow(finish, "doc_id long, train boolean, n_tokens long, head_known long, head_sum double, score double, tail array<long>, times array<long>")
    out = written(out.withColumn("row", F.monotonically_increasing_id()))
    rare = out.select("row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("known"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("sum")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.drop("tail", "times").join(rare, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + zero("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + zero("sum") - F.col("n_tokens") * F.lit(float(log_base))).alias("base_score"),
        "score",
    )
