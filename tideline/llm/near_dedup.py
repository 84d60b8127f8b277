"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find grouping.

SuperMinHash gives element e a random permutation of the m signature slots and m random values: the j-th slot of the
permutation gets the rank j + r, r in [0, 1), and a slot keeps its least rank. The ranks of one element are correlated
(each slot number once), which lowers the variance for sets that are small against m. A rank of round j is never less
than j, so a slot that was reached in round j can't be improved by a later round: when all slots of a document are
reached, its remaining rounds are skipped (early stopping). Here the rounds run over all elements of a slice of
documents at once.

Candidates share a band of ROWS slots. At a similarity of 0.8 a pair misses all BANDS bands with probability 3e-6.
Candidate pairs are confirmed on the full shingle sets.

Groups of thousands of copies are not expanded to pairs. Copies with equal sets fold to one representative (partial
aggregation). Each bucket compares its members to the member with most bucket mates. What is still in another component
than that member is then compared on: with components of BIG or more members block against block (both sides packed,
each block read once for BLOCK texts), with members of smaller components pair by pair, unless their signatures differ
in more slots than five deviations allow at the wanted similarity (a pair is lost so with probability below 1e-6). Two
documents of one component need no further check, so no link that would change a component is lost.

Defined cases: null text is empty; a text without words is alone in its component; repeated rows are all returned; a
doc_id with several texts is one node with the links of all; a null doc_id gets a null component and stays
(kept true). An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import LOWER, identified_bytes, in_slices, int_lists, scramble, starts_of, written

BANDS, ROWS = 32, 5
SLICE_BYTES = 1 << 20
#: Components from this size are compared in blocks of about so many texts.
BIG, BLOCK = 64, 64
#: Most ids (8 bytes each) that are sent to all tasks.
MAX_SENT = 1 << 20
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of `width`-word shingles; fewer words make one shingle, none make none."""
    words = np.fromiter(map(xxh3_64_intdigest, data.translate(LOWER).split()), np.uint64)
    if not len(words):
        return words
    size = min(width, len(words))
    out = scramble(words[: len(words) - size + 1], size)
    with np.errstate(over="ignore"):
        for k in range(1, size):
            out = scramble(out ^ words[k : len(words) - size + 1 + k], size + k)
    return np.unique(out)


def signatures(values: np.ndarray, lengths: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash of each set (laid end to end in `values`): one row of m ranks, (round << 32) + fraction."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64) * m, lengths)
    sig = np.full(len(lengths) * m, _FREE)
    state = scramble(values, 1)
    slot = ((state & _LOW) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, owner + slot, state >> np.uint64(32))
    open_sets = (sig.reshape(-1, m) == _FREE).any(1)
    left = np.flatnonzero(open_sets[owner // m])
    perm = np.empty((len(left), m), np.uint8 if m <= 256 else np.uint16)
    perm[:] = np.arange(m)
    first = slot[left]
    perm[np.arange(len(left)), first] = 0
    perm[:, 0] = first
    owner, values = owner[left], values[left]
    for j in range(1, m):
        if not len(owner):
            break
        state = scramble(values, j + 1)
        at = j + ((state & _LOW) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(owner))
        slot = perm[rows, at]
        perm[rows, at] = perm[:, j]
        perm[:, j] = slot
        np.minimum.at(sig, owner + slot, (np.uint64(j) << np.uint64(32)) + (state >> np.uint64(32)))
        keep = (sig.reshape(-1, m) == _FREE).any(1)[owner // m]
        if keep.sum() < 0.8 * len(keep):
            owner, values, perm = owner[keep], values[keep], perm[keep]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(scramble(np.arange(bands, dtype=np.uint64), 7), (len(sig), bands))
    for k in range(rows):
        key = scramble(key ^ parts[:, :, k], k)
    return key.view(np.int64)


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of each slot, sixteen slots to a word."""
    low = (scramble(sig, 99) & np.uint64(15)).reshape(len(sig), -1, 16)
    return np.bitwise_or.reduce(low << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def differing(a: Column, b: Column, words: int) -> Column:
    """In how many slots two rows of nibbles differ."""
    total = F.lit(0)
    for k in range(words):
        x = a[k].bitwiseXOR(b[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def variance_factor(m: int, union: float) -> float:
    """How much less SuperMinHash estimates vary than independent slots, for a union of so many elements (Ertl 2017)."""
    u, l = max(2.0, union), np.arange(1, m)
    full = m * (m - 1)
    terms = (l * (l + 1) / full) ** u + (l * (l - 1) / full) ** u - 2 * (l * l / full) ** u
    return float(np.clip(1 - (m - 1) / (u - 1) * terms.sum(), 0.0, 1.0))


def most_differing(m: int, percent: int) -> list[int]:
    """By half octaves of the larger set: slots of four bits that may differ at the wanted similarity, with five deviations."""
    j = percent / 100
    out = []
    for k in range(64):
        factor = variance_factor(m, 2 ** ((k + 1) / 2) / j)
        spread = (15 / 16) ** 2 * factor * j * (1 - j) + (1 - j) * 15 / 256
        out.append(int(m * (1 - j) * 15 / 16 + 5 * (m * spread) ** 0.5))
    return out


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set (d1, d2), its band keys and four bits of each slot."""

    def work(keys: list, texts: list) -> pa.RecordBatch:
        sets = [shingle_set(x, width) for x in texts]
        lengths = np.array([len(s) for s in sets], np.int64)
        full = lengths > 0
        values = np.concatenate(sets)
        digest = np.zeros((2, len(sets)), np.uint64)
        keys_of, slots_of = np.zeros((0, bands), np.int64), np.zeros((0, bands * rows // 16), np.int64)
        if full.any():
            at = starts_of(lengths[full])
            with np.errstate(over="ignore"):
                for k in (0, 1):
                    digest[k, full] = np.add.reduceat(scramble(values, 1001 + k), at)
            sig = signatures(values, lengths[full], bands * rows)
            keys_of, slots_of = band_keys(sig, bands, rows), nibbles(sig)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(lengths), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
             int_lists(keys_of.ravel(), full * bands, pa.int64()), int_lists(slots_of.ravel(), full * (bands * rows // 16), pa.int64())],
            names=["doc_id", "n_shingles", "d1", "d2", "bands", "slots"],
        )

    return identified_bytes(docs).mapInArrow(in_slices(work, SLICE_BYTES), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, slots array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full shingle sets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, None
        for batch in batches:
            found = []
            a, b, left, right = batch.columns
            for k in range(len(a)):
                if (text := right[k].as_py()) != known:
                    known, held = text, shingle_set(text, width)
                own = shingle_set(left[k].as_py(), width)
                both = len(np.intersect1d(own, held, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(held) - both):
                    found.append(k)
            take = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(take), b.take(take)], names=["a", "b"])

    sides = pairs.join(texts.toDF("a", "left"), "a").join(texts.toDF("b", "right"), "b").select("a", "b", "left", "right")
    return sides.mapInArrow(work, "a long, b long")


def block_links(left: DataFrame, right: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """One link (a, b) for each a of `left` (a, label) and each block of `right` (b, label) of its label that holds one.

    Both sides are packed into blocks of about BLOCK texts, dealt by hash, so that a label of any size is spread over
    many rows and a text is read once for each block of the other side.
    """

    def packed(side: DataFrame, id_: str, name: str) -> DataFrame:
        count = side.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        rows = side.join(count, "label").withColumn("block", F.pmod(F.xxhash64(id_), "blocks")).join(texts.toDF(id_, "data"), id_)
        return rows.groupBy("label", "block").agg(F.collect_list(F.struct(F.col(id_).alias("id"), "data")).alias(name)).drop("block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.to_pylist():
                own, held = ([(x["id"], shingle_set(x["data"], width)) for x in row[c]] for c in ("left", "right"))
                size = np.array([len(s) for _, s in held])
                names, place = np.unique(np.concatenate([s for _, s in held]), return_inverse=True)
                for a, s in own:
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    mask = np.zeros(len(names), np.int64)
                    mask[at[names[at] == s]] = 1
                    both = np.add.reduceat(mask[place], starts_of(size))
                    linked = np.flatnonzero(100 * both >= percent * (size + len(s) - both))
                    if len(linked):
                        found.append((a, held[linked[0]][0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = packed(left, "a", "left").join(packed(right, "b", "right"), "label").select("left", "right")
    return both.repartition(both.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(work, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every node that isn't the least of its component, by alternating large-star and small-star rounds."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        last = state


def sent_if_small(ids: DataFrame) -> DataFrame:
    """Ids marked for broadcast if there are at most MAX_SENT; otherwise the join shuffles as usual."""
    return F.broadcast(ids) if ids.count() <= MAX_SENT else ids


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the group) and kept, for every row of `docs`."""
    sketch = written(sketches(docs, width, bands, rows))
    named = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = written(named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").cast("int").alias("n"), F.any_value("bands").alias("bands"), F.any_value("slots").alias("slots")))
    spread = sets.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(spread.join(shared, "bucket"))
    degree = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    degree = written(degree)
    members = written(members.join(degree, "rep"))
    texts = identified_bytes(docs).join(sent_if_small(degree.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    texts = written(texts.select("doc_id", "data").distinct())
    centre = written(members.groupBy("bucket").agg(F.max_by("rep", F.struct("degree", "rep")).alias("centre")))
    several = named.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y").select("doc_id")
    copies = named.join(several, "doc_id", "left_semi").join(sets, ["d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # every bucket against its centre
    near = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")
    middle = centre.join(members.select("bucket", F.col("rep").alias("centre"), F.col("n").alias("nc")), ["bucket", "centre"])
    pairs = members.join(middle, "bucket").where("rep <> centre").where(near("n", "nc")).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    edges = written(copies.union(confirmed(pairs, texts, width, percent)))
    root = components(edges)
    labels = degree.select("rep").join(root.withColumnRenamed("v", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("label"))
    labels = written(labels)
    # what is left outside of its bucket's component
    big = labels.groupBy("label").agg(F.count("*").alias("many")).where(f"many >= {BIG}").select("label")
    placed = members.join(labels.join(big.withColumn("big", F.lit(True)), "label", "left"), "rep").select("bucket", "rep", "n", "label", F.coalesce("big", F.lit(False)).alias("big"))
    home = centre.join(labels, F.col("centre") == F.col("rep")).select("bucket", F.col("label").alias("home"))
    outside = written(placed.join(home, "bucket").where("label <> home").select("bucket", "rep", "n", "label"))
    if not outside.isEmpty():
        slots = sets.select("rep", "n", "slots")
        at = written(placed.join(outside.select("bucket").distinct(), "bucket", "left_semi").join(slots, ["rep", "n"]))
        outside = outside.join(slots, ["rep", "n"]).select("bucket", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("slots").alias("sa"), F.col("label").alias("la"))
        touched = at.where("big").select("bucket", "label").distinct()
        left = outside.join(touched, "bucket").where("la <> label").select("a", "label").distinct()
        right = labels.join(big, "label", "left_semi").select(F.col("rep").alias("b"), "label")
        blocks = block_links(left, right, texts, width, percent)
        m = bands * rows
        limits = F.array(*[F.lit(x) for x in most_differing(m, percent)])
        most = F.get(limits, F.least(F.lit(63), F.floor(2 * F.log2(F.greatest("na", "nb")))).cast("int"))
        other = at.where("NOT big").select("bucket", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("slots").alias("sb"), F.col("label").alias("lb"))
        alike = (F.col("la") != F.col("lb")) & near("na", "nb") & (differing(F.col("sa"), F.col("sb"), m // 16) <= most)
        small = outside.join(other, (outside["bucket"] == other["bucket"]) & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = written(edges.union(blocks).union(confirmed(small, texts, width, percent)))
        root = components(edges)
    named_root = sets.join(root.withColumnRenamed("v", "rep"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles", F.when(F.expr("doc_id IS NOT NULL AND n_shingles > 0"), F.col("d1")).alias("d1"), "d2")
    out = out.join(named_root, ["d1", "d2"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group with all its columns; of rows with equal id and text one stays."""
    groups = written(near_duplicates(docs, width, percent))
    dropped = written(groups.where("NOT kept").select("doc_id").distinct())
    out = docs.join(sent_if_small(dropped), "doc_id", "left_anti")  # rows without id have no match and stay
    repeated = written(groups.groupBy(F.col("doc_id").alias("_id_")).agg(F.count("*").alias("n")).where("n > 1").select("_id_"))
    if repeated.isEmpty():
        return out
    same = F.col("doc_id").eqNullSafe(F.col("_id_"))
    return out.join(repeated, same, "left_anti").union(out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
