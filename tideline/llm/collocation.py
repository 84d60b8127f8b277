"""Phrase collocation mining on a weighted de Bruijn graph.

Edges are the longest grams (`longest` words) with their counts, nodes the grams one word shorter at both ends of an
edge. A shorter gram is counted by flow: its occurrences are those of the grams one word longer that begin with it, plus
those that nothing follows, which are counted as ends. So every place of a text adds one gram only, the longest that
starts there, and

    f(x) = sum of f(x w) over all w + ends(x),   from longest - 1 words down to one.

Pieces end at marks, and a gram also ends early (a correction like that of a piece's end) where the next longer one is
too rare to be a candidate. The rare ones are found by 64-bit hashes, words and pairs first, then longer grams where all
pairs are frequent: counted in each task, packed by bucket, summed, and the frequent ones put in a Bloom filter of at
most FILTER_BYTES. A collision or a false positive only makes a gram longer than it need be, so all counts of candidates
and of their parts stay exact.

Unary paths (edges joined by nodes that have one edge in, one out, and no end) are compacted to one row of words and
weight; pointers along the paths double their reach in each join. A node inside a path occurs exactly as often as the
edges beside it, so it can't be a result and needs no comparison.

Scores are exact: products are decimals of 38 digits.

Defined cases: null text is empty, null lang is `und`; text without words adds nothing; repeated rows count again; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import LOWER, freeing, freeing_groups, scramble, slices, written
from tideline.llm.ngram_lm import bucket_count, bucket_of, packed, unpacked

LONGEST = 5
LEAST = 100
TOP = 2000
SLICE_BYTES = 1 << 20
FLUSH = 3_000_000
#: Distinct phrases that a task holds before it hands them on.
HELD = 200_000
FILTER_BYTES = 64 << 20
BITS, PROBES = 16, 4
ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, tab as space, ends of pieces as line feed.
_SPLIT = LOWER.translate(bytes(10 if c in ENDS else 32 if c == 9 else c for c in range(256)))
_END = np.uint64(0)
#: Parallel parts of the final ranking of one language.
RANK_PARTS = 32
PATH_EDGES = 1024


def words_of(text: bytes) -> list[bytes]:
    """The words, with b"\\n" between pieces."""
    return [w for w in text.translate(_SPLIT).replace(b"\n", b" \n ").split(b" ") if w]


def hashed(words: list[bytes], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and of each word with the next; 0 for ends of pieces and pairs across one."""
    one = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    stop = np.fromiter((w == b"\n" for w in words), bool, len(words))
    one = scramble(one ^ np.uint64(salt), 1)
    one[stop] = _END
    return one, extended(one, one)


def extended(grams: np.ndarray, one: np.ndarray) -> np.ndarray:
    """A hash of each gram with the word after it; 0 where there is none or the gram itself is 0."""
    width = len(one) - len(grams) + 1
    out = scramble(grams[: len(one) - width] ^ scramble(one[width:], 3), 5)
    out[(grams[: len(one) - width] == _END) | (one[width:] == _END)] = _END
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))


def by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The words of some texts of one language, slice by slice, with a break after each text."""
    for batch in batches:
        for part in slices(batch, batch.column(0), SLICE_BYTES):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                words = words_of(b"\n".join(t for t, x in zip(texts, langs) if x == lang))
                if words:
                    yield lang, words


def gram_hashes(docs: DataFrame, buckets: int, longest: int, linked: np.ndarray | None = None) -> DataFrame:
    """(part, keys, counts, lang, n): packed partial counts of hashed grams, and the words of each lang (part -1).

    Words and pairs; or, with the filter of the frequent ones, grams of three to `longest` words of frequent pairs.
    """
    sent = None if linked is None else docs.sparkSession.sparkContext.broadcast(linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = None if sent is None else Bloom(8 * len(sent.value), sent.value)
        held: dict[int, list[np.ndarray]] = {}
        size, totals = 0, {}
        names = ["part", "keys", "counts", "lang", "n"]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64()]

        def flush() -> Iterator[pa.RecordBatch]:
            for order, blocks in held.items():
                keys, counts = np.unique(np.concatenate(blocks), return_counts=True)
                edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                rows = [(order * buckets + b, packed(keys[x:y]), counts[x:y].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), None, None) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            held.clear()

        for lang, words in by_lang(batches):
            one, pair = hashed(words, xxh3_64_intdigest(lang))
            if often is None:
                grams = [one[one != _END], pair[pair != _END]]
                totals[lang] = totals.get(lang, 0) + len(grams[0])
            else:
                pair[~often.holds(pair)] = _END
                grams, now = [], pair
                for n in range(3, longest + 1):
                    now = extended(now, one)
                    now[pair[n - 2 :] == _END] = _END  # the pair at the gram's end is frequent too
                    grams.append(now[now != _END])
            for k, x in enumerate(grams):
                held.setdefault(k, []).append(x)
                size += len(x)
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()
        if totals:
            rows = [(-1, None, None, x, n) for x, n in totals.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.mapInArrow(freeing(run), "part int, keys binary, counts binary, lang string, n long")


def frequent(partial: DataFrame, least: int) -> DataFrame:
    """(n, keys): how many hashes of each bucket occur `least` times or more, and which."""

    def merge(group: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x.as_py()) for x in group.column("keys")])
        counts = np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for x in group.column("counts")])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        often = keys[head][np.add.reduceat(counts, head) >= least]
        return pa.table({"n": pa.array([len(often)], pa.int64()), "keys": pa.array([often.tobytes()], pa.binary())})

    return partial.where("part >= 0").groupBy("part").applyInArrow(freeing_groups(merge), "n long, keys binary")


class Bloom:
    """A Bloom filter over 64-bit hashes, of a power of two bits up to 8 * FILTER_BYTES."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data

    @staticmethod
    def size_for(n: int) -> int:
        return int(min(8 * FILTER_BYTES, 1 << max(10, int(n * BITS - 1).bit_length())))

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            step = scramble(keys, 17) | np.uint64(1)
            for k in range(PROBES):
                yield ((keys + np.uint64(k) * step) >> np.uint64(3)).astype(np.int64) & (self.bits - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.data, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = keys != _END
        for at in self.places(keys):
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bloom_of(hashes: DataFrame) -> np.ndarray:
    """The filter of all hashes: each task fills its own, the partial filters are united slice by slice."""
    bits = Bloom.size_for(int(hashes.agg(F.sum("n")).first()[0] or 0))
    step = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for batch in batches:
            for keys in batch.column(0).to_pylist():
                own.add(np.frombuffer(keys, np.uint64))
        for at in range(0, len(own.data), step):
            part = own.data[at : at + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "bits"])

    def unite(group: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_py(), np.uint8) for x in group.column("bits")]
        return pa.table({"at": group.column("at").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    parts = hashes.select("keys").mapInArrow(freeing(fill), "at long, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.groupBy("at").applyInArrow(freeing_groups(unite), "at long, bits binary").toLocalIterator():  # at most FILTER_BYTES in all
        out[row["at"] : row["at"] + step] = np.frombuffer(row["bits"], np.uint8)
    return out


def counted_grams(docs: DataFrame, known: np.ndarray, longest: int, buckets: int) -> DataFrame:
    """(lang, n, phrase, c): how often each gram is the longest one at its place.

    A task hands on its counts by bucket, packed, since all tasks meet the same frequent grams; a bucket is merged in one
    group, and there are as many as the corpus asks for.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = Bloom(8 * len(sent.value), sent.value)
        held: dict[bytes, dict[bytes, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            keys = [lang + x for lang, counts in held.items() for x in counts]
            if keys:
                counts = np.fromiter((c for x in held.values() for c in x.values()), np.int64, len(keys))
                part = (np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0]))
                lists = pa.array(np.append(starts, len(keys)).astype(np.int32))
                grams = pa.array(keys, pa.binary()).take(pa.array(order))
                yield pa.RecordBatch.from_arrays([pa.array(part[order][starts].astype(np.int32)), pa.ListArray.from_arrays(lists, grams), pa.ListArray.from_arrays(lists, pa.array(counts[order]))], names=["part", "keys", "counts"])
            held.clear()

        for lang, words in by_lang(batches):
            one, now = hashed(words, xxh3_64_intdigest(lang))
            length = often.holds(one).astype(np.int64)
            for n in range(2, longest + 1):
                now[~often.holds(now)] = _END
                length[: len(now)][now != _END] = n
                now = extended(now, one)
            counts = held.setdefault(lang.encode() + b"\n", {})
            for n in range(1, longest + 1):
                at = np.flatnonzero(length == n).tolist()
                for x in (words[i] for i in at) if n == 1 else (b" ".join(words[i : i + n]) for i in at):
                    counts[x] = counts.get(x, 0) + 1
            if sum(map(len, held.values())) > HELD:
                yield from flush()
        yield from flush()

    def merge(group: pa.Table) -> pa.Table:
        flat = pa.table({"key": pa.concat_arrays([x.values for x in group.column("keys")]), "c": pa.concat_arrays([x.values for x in group.column("counts")])})
        found = flat.group_by("key").aggregate([("c", "sum")])
        names = [x.rsplit(b"\n", 1) for x in found.column("key").to_pylist()]  # no word holds a line feed
        phrases = pa.array([x for _, x in names], pa.binary()).cast(pa.string())
        lengths = pa.array([x.count(b" ") + 1 for _, x in names], pa.int32())
        return pa.table({"lang": pa.array([x for x, _ in names], pa.binary()).cast(pa.string()), "n": lengths, "phrase": phrases, "c": found.column("c_sum")})

    packed_counts = docs.mapInArrow(freeing(run), "part int, keys array<binary>, counts array<long>")
    return packed_counts.groupBy("part").applyInArrow(freeing_groups(merge), "lang string, n int, phrase string, c long")


def _first(phrase: str, n: int) -> Column:
    return F.substring_index(F.col(phrase), " ", n)


def _span(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def flows(paths: DataFrame, grams: DataFrame, longest: int) -> DataFrame:
    """(lang, n, phrase, c) of all lengths: the edges of the paths, then ends plus the flow of the grams one word longer."""
    words = F.split("words", " ")
    starts = F.explode(F.transform(F.sequence(F.lit(1), F.col("n_edges").cast("int")), lambda i: _span(words, i, longest)))
    every = longer = paths.select("lang", F.lit(longest).alias("n"), starts.alias("phrase"), F.col("weight").alias("c"))
    for n in range(longest - 1, 0, -1):
        moved = longer.select("lang", F.lit(n).alias("n"), _first("phrase", n).alias("phrase"), "c")
        longer = written(moved.unionByName(grams.where(F.col("n") == n)).groupBy("lang", "n", "phrase").agg(F.sum("c").alias("c")))
        every = every.unionByName(longer)
    return every


def unary_paths(grams: DataFrame, longest: int) -> DataFrame:
    """(lang, edge, weight, last, place, inside, circular): each edge with the last one of its path and its distance to it.

    `inside`: the node behind it is inside the path. `circular`: the path has no end.
    """
    edges = grams.where(F.col("n") == longest).select("lang", F.col("phrase").alias("edge"), F.col("c").alias("weight"))
    edges = edges.withColumn("tail", _first("edge", longest - 1)).withColumn("head", F.substring_index("edge", " ", 1 - longest))
    out = edges.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("n_out"), F.min("edge").alias("next"))
    into = edges.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("n_in"), F.sum("weight").alias("w_in"))
    ends = grams.where(F.col("n") == longest - 1).select("lang", F.col("phrase").alias("node"))
    # a node with one edge in, one out, no end: its flow is the weight of both edges if no piece starts in it
    weights = edges.select("lang", F.col("edge").alias("next"), F.col("weight").alias("w_next"))
    unary = out.where("n_out = 1").join(into.where("n_in = 1"), ["lang", "node"]).join(ends, ["lang", "node"], "left_anti").join(weights, ["lang", "next"]).where("w_in = w_next")
    now = edges.join(unary.select("lang", F.col("node").alias("head"), "next"), ["lang", "head"], "left")
    now = written(now.withColumn("inside", F.col("next").isNotNull()).select(
        "lang", "edge", "weight", F.coalesce("next", "edge").alias("to"), F.col("inside").cast("long").alias("place"), "inside", F.col("inside").alias("open"))
    )
    closed = now.where("not open")
    left = None
    while True:
        count = now.where("open").count()
        if not count or count == left:  # nothing ended in the last step: what is left runs in a circle and has no end
            break
        left = count
        open_ = now.where("open")
        step = closed.unionByName(open_).select("lang", F.col("edge").alias("to"), F.col("to").alias("b_to"), F.col("place").alias("b_place"), F.col("open").alias("b_open"))
        jumped = open_.join(step, ["lang", "to"]).select("lang", "edge", "weight", F.col("b_to").alias("to"), (F.col("place") + F.col("b_place")).alias("place"), "inside", F.col("b_open").alias("open"))
        now = written(jumped)
        closed = closed.unionByName(now.where("not open"))
    return closed.unionByName(now.where("open")).select("lang", "edge", "weight", F.col("to").alias("last"), "place", "inside", F.col("open").alias("circular"))


def compacted(paths: DataFrame) -> DataFrame:
    """(lang, words, weight, n_edges): each unary path as one row; the edges of a circle stay single.

    A path is cut into pieces of PATH_EDGES edges, so that a row stays small however long a passage is.
    """
    piece = F.when(F.col("circular"), F.xxhash64("edge")).otherwise(F.floor(F.col("place") / PATH_EDGES))
    found = F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("at"), F.col("edge").alias("edge"))))
    rows = paths.groupBy("lang", F.when(F.col("circular"), F.col("edge")).otherwise(F.col("last")).alias("last"), "weight", piece.alias("piece")).agg(found.alias("found"))
    later = F.transform(F.slice("found", 2, F.size("found")), lambda x: F.substring_index(x["edge"], " ", -1))
    words = F.array_join(F.concat(F.array(F.col("found")[0]["edge"]), later), " ")
    return rows.select("lang", words.alias("words"), "weight", F.size("found").cast("long").alias("n_edges"))


def maximal(counts: DataFrame, inside: DataFrame) -> DataFrame:
    """Candidates that no longer one with the same count contains: it is enough to look one word further."""
    words = F.split("phrase", " ")
    longer = counts.where("n > 2")
    sides = [longer.select("lang", _span(words, at, F.col("n") - 1).alias("phrase"), "c") for at in (1, 2)]
    around = sides[0].unionByName(sides[1]).groupBy("lang", "phrase").agg(F.max("c").alias("around"))
    live = counts.where("n > 1").join(inside, ["lang", "phrase"], "left_anti")
    return live.join(around, ["lang", "phrase"], "left").where("around is null or around < c").drop("around")


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score: each candidate at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), _span(words, 1, k).alias("one"), _span(words, k + 1, F.col("n") - k).alias("two"))
    rows = candidates.select("lang", "phrase", F.col("c").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), cut)).alias("cut"))
    rows = rows.select("lang", "phrase", "a", "cut.*")
    for part, name in (("one", "l"), ("two", "r")):
        rows = rows.join(counts.select("lang", F.col("phrase").alias(part), F.col("c").alias(name)), ["lang", part])
    a, n, l, r = (F.col(c).cast("decimal(17,0)") for c in ("a", "n", "l", "r"))
    rows = rows.join(totals, "lang").withColumn("above", (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", l * r)
    rows = rows.withColumn("score", F.expr("above div below"))
    best = rows.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first `top` of each lang, with their rank; each part of a language is cut before the parts meet."""
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    part = phrases.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = part.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def graph(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The de Bruijn graph of the grams that can occur `least` times, all tables written.

    Unary paths (lang, words, weight, n_edges); shorter grams that end at their place (lang, n, phrase, c); the nodes inside the
    paths (lang, phrase); the words of each lang (lang, n).
    """
    texts = texts_of(docs)
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0]
    buckets = bucket_count(int(size or 0), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    partial = written(gram_hashes(texts, buckets, longest))
    totals = written(partial.where("part = -1").groupBy("lang").agg(F.sum("n").alias("n")))
    short = written(frequent(partial, least))
    long = written(frequent(gram_hashes(texts, buckets, longest, bloom_of(short)), least))
    grams = written(counted_grams(texts, bloom_of(short.unionByName(long)), longest, buckets))
    paths = written(unary_paths(grams, longest))
    inside = paths.where("inside").select("lang", F.substring_index("edge", " ", 1 - longest).alias("phrase"))
    return written(compacted(paths)), grams.where(F.col("n") < longest), inside, totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of two to `longest` words of each lang."""
    paths, ends, inside, totals = graph(docs, longest, least)
    counts = written(flows(paths, ends, longest).where(F.col("c") >= least))
    return ranked(scored(maximal(counts, inside), counts, totals), top)
