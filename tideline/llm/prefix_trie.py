"""Conversation prefix trie: nodes by prefix fingerprints, subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. The fingerprint of a prefix is the sum, over its turns, of a 4 x 32 bit
hash of place and turn; sums run along each conversation slice by slice, so a conversation may be of any length. Nodes
are the groups of equal sums; a node is named by its smallest member and its depth.

Subtree totals come from contraction, one round being

* rake: every leaf hands its total to its parent and leaves the tree;
* compress: nodes with one child left, in unbroken chains, leave too. Pointers jump along a chain, doubling their reach
  in each join; then the node under the chain hangs below the parent of the chain's top, and the edge carries the sum.

A tree of n nodes is gone after about log2(n) rounds, a chain of length k takes log2(k) joins. The rounds are then
expanded again from the last to the first: total of a chain node = its sum down the chain + the total at the chain's
end. No join of rake and compress has a repeated key; where many nodes look up one parent or one chain end, the join
has a single row on the other side, so that adaptive execution can split it.

The ids of the conversations that end in a node are range-sorted by (node, id), packed into chunks of at most CHUNK
bytes, and the chunks are hashed in order, so a node where most conversations end takes few rows of bounded size.

Defined cases: rows of a null conversation take no part; turns are ordered by turn (null first), then role, then the
MD5 of the text, and repeated rows are turns of their own; null role or text is empty. An empty table gives no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tideline.functions.ordering import running_totals
from tideline.llm.common import written

SUMS = ["s1", "s2", "s3", "s4"]
CHUNK = 1 << 20
NODE = ["conv_id", "depth"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, digest, bytes): every turn's place from 0, a digest of its role and text, the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    seen = running_totals(turns, ["conv_id"], ["turn", "role", "digest"], {"seen": F.lit(1)})
    return written(seen.select("conv_id", (F.col("seen") - 1).cast("long").alias("idx"), "digest", "bytes"))


def members_of(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg((F.max("idx") + 1).alias("n_turns"))


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that they branch: the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9.

    Returns the turns and the members (conv_id, n_turns) of the rebuilt conversations.
    """
    own = written(members_of(turns))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % 5
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_n"))
    convs = own.withColumn("h", head).withColumn("base", base).join(sizes, "base", "left")
    convs = written(convs.select("conv_id", "base", "h", "n_turns", F.least("h", F.coalesce("base_n", F.lit(0))).alias("given")))
    heads = turns.where("idx < 8").select(F.col("conv_id").alias("base"), "idx", "digest", "bytes")
    first = convs.join(heads, "base").where("idx < h").select("conv_id", "idx", "digest", "bytes")
    rest = turns.where(F.col("idx") >= head).join(convs.select("conv_id", "h", "given"), "conv_id")
    rest = rest.select("conv_id", (F.col("idx") - F.col("h") + F.col("given")).alias("idx"), "digest", "bytes")
    members = convs.select("conv_id", (F.col("given") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))
    return first.unionByName(rest), members


def _named(prefix: str, *names: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in names]


def prefix_nodes(turns: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (sums, conv_id, depth, parent_conv_id, n_convs, bytes) and ends (sums, conv_id) of the trie."""
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    a, b = F.xxhash64("idx", "digest"), F.xxhash64("digest", F.lit(7), "idx")
    marks = [low(a), F.shiftrightunsigned(a, 32), low(b), F.shiftrightunsigned(b, 32)]
    marked = turns.select("conv_id", "idx", "bytes", *(m.alias(f"m_{s}") for m, s in zip(marks, SUMS)))
    places = running_totals(marked, ["conv_id"], ["idx"], {s: F.col(f"m_{s}") for s in SUMS})
    places = written(places.select("conv_id", (F.col("idx") + 1).alias("depth"), "bytes", *SUMS, *((F.col(s) - F.col(f"m_{s}")).alias(f"p_{s}") for s in SUMS)))
    at_root = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), *(F.lit(0).cast("long").alias(s) for s in SUMS))
    rows = places.unionByName(at_root, allowMissingColumns=True)
    nodes = rows.groupBy(*SUMS, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), *(F.max(f"p_{s}").alias(f"p_{s}") for s in SUMS)
    )
    nodes = written(nodes)
    parents = nodes.select(*_named("p_", *SUMS), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    named = nodes.join(parents, [*(f"p_{s}" for s in SUMS), "depth"], "left")
    ends = rows.join(members.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"], "left_semi").select(*SUMS, "conv_id")
    return written(named.select(*SUMS, *NODE, "parent_conv_id", "n_convs", "bytes")), ends


def _raked(live: DataFrame) -> DataFrame:
    """What stays after the leaves are gone: with their totals, the number of children left, and a child if there is one."""
    leaf = F.col("stay") == 0
    given = live.groupBy(F.col("up_conv_id").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
        F.sum(F.when(leaf, F.col("leaves") + F.col("edge_leaves")).otherwise(0)).alias("more_leaves"),
        F.sum(F.when(leaf, F.col("saved") + F.col("edge_saved")).otherwise(0)).alias("more_saved"),
        F.count(F.when(~leaf, 1)).alias("left"),
        F.max(F.when(~leaf, F.struct(*NODE, "edge_leaves", "edge_saved"))).alias("child"),
    )
    return live.where(~leaf).drop("stay", "child").join(given, NODE).select(
        *NODE, "up_conv_id", "up_depth", (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"),
        "edge_leaves", "edge_saved", F.col("left").alias("stay"), "child",
    )


def _chains(live: DataFrame) -> DataFrame | None:
    """(node, up, to_conv_id, to_depth, x_leaves, x_saved, edges, top): each chain node with the first node under its chain and the sum down to it."""
    chain = live.where((F.col("stay") == 1) & F.col("up_conv_id").isNotNull()).select(
        *NODE, "up_conv_id", "up_depth", "edge_leaves", "edge_saved", F.col("child.conv_id").alias("to_conv_id"), F.col("child.depth").alias("to_depth"),
        (F.col("leaves") + F.col("child.edge_leaves")).alias("x_leaves"), (F.col("saved") + F.col("child.edge_saved")).alias("x_saved"),
    )
    here = chain.select(F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), F.lit(True).alias("open"))
    above = chain.select(F.col("to_conv_id").alias("conv_id"), F.col("to_depth").alias("depth"), F.lit(False).alias("top"))
    first = chain.join(here, ["to_conv_id", "to_depth"], "left").join(above, NODE, "left")
    now = written(first.withColumn("open", F.coalesce("open", F.lit(False))).withColumn("top", F.coalesce("top", F.lit(True))))
    if now.isEmpty():
        return None
    closed = now.where("not open")
    while not now.where("open").isEmpty():
        step = closed.unionByName(now.where("open")).select(
            F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), *_named("b_", "to_conv_id", "to_depth", "x_leaves", "x_saved", "open")
        )
        jumped = now.where("open").drop("open").join(step, ["to_conv_id", "to_depth"])
        jumped = jumped.withColumn("x_leaves", F.col("x_leaves") + F.col("b_x_leaves")).withColumn("x_saved", F.col("x_saved") + F.col("b_x_saved"))
        jumped = jumped.drop("to_conv_id", "to_depth").withColumnsRenamed({"b_to_conv_id": "to_conv_id", "b_to_depth": "to_depth", "b_open": "open"})
        now = written(jumped.select(*closed.columns))
        closed = closed.unionByName(now.where("not open"))
    return closed


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node, from (conv_id, depth, parent_conv_id, n_children, n_convs, bytes)."""
    zero = F.lit(0).cast("long")
    parent = F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1)
    live = written(nodes.select(
        *NODE, F.col("parent_conv_id").alias("up_conv_id"), parent.alias("up_depth"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), zero.alias("edge_leaves"), zero.alias("edge_saved"), F.col("n_children").alias("stay"),
        F.lit(None).cast("struct<conv_id long, depth long, edge_leaves long, edge_saved long>").alias("child"),
    ))
    rounds: list[tuple[DataFrame, DataFrame | None]] = []
    while not live.isEmpty():
        leaves = live.where("stay = 0").select(*NODE, "leaves", "saved")
        live = written(_raked(live))
        chain = _chains(live)
        rounds.append((leaves, chain))
        if chain is not None:
            tops = chain.where("top").select(
                F.col("to_conv_id").alias("conv_id"), F.col("to_depth").alias("depth"), *_named("t_", "up_conv_id", "up_depth"),
                (F.col("x_leaves") + F.col("edge_leaves")).alias("t_leaves"), (F.col("x_saved") + F.col("edge_saved")).alias("t_saved"),
            )
            moved = F.col("t_leaves").isNotNull()
            pick = lambda new, old: F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old)
            kept = live.where((F.col("stay") != 1) | F.col("up_conv_id").isNull()).join(tops, NODE, "left")
            live = written(kept.select(
                *NODE, pick("t_up_conv_id", "up_conv_id"), pick("t_up_depth", "up_depth"), "leaves", "saved",
                pick("t_leaves", "edge_leaves"), pick("t_saved", "edge_saved"), "stay", "child",
            ))
    totals: DataFrame | None = None
    for leaves, chain in reversed(rounds):
        if chain is not None:
            ends = totals.select(F.col("conv_id").alias("to_conv_id"), F.col("depth").alias("to_depth"), *_named("e_", "leaves", "saved"))
            found = chain.join(ends, ["to_conv_id", "to_depth"])
            found = found.select(*NODE, (F.col("x_leaves") + F.col("e_leaves")).alias("leaves"), (F.col("x_saved") + F.col("e_saved")).alias("saved"))
            totals = totals.unionByName(written(found))
        totals = leaves if totals is None else totals.unionByName(leaves)
    if totals is None:
        totals = live.select(*NODE, "leaves", "saved")
    return totals.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, comma-joined, in chunks."""
    names = [*SUMS, "first", "ids"]
    key, first, held, size = None, None, [], 0

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ids" else pa.int64()) for c, n in zip(columns, names)], names=names)

    for batch in batches:
        out, waiting = [], 0
        for *sums, conv in zip(*(batch.column(c).to_pylist() for c in [*SUMS, "conv_id"])):
            text = str(conv)
            if sums != key or size + len(text) >= CHUNK:
                if held:
                    out.append((*key, first, ",".join(held)))
                    waiting += size
                key, first, held, size = sums, conv, [], 0
            held.append(text)
            size += len(text) + 1
            if waiting >= CHUNK:
                yield chunk(out)
                out, waiting = [], 0
        if out:
            yield chunk(out)
    if held:
        yield chunk([(*key, first, ",".join(held))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*SUMS, "ends_sha256"]
    key, state = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for c, n in zip(zip(*done), names)], names=names)

    for batch in batches:
        done = []
        for *sums, ids in zip(*(batch.column(c).to_pylist() for c in [*SUMS, "ids"])):
            if sums != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = sums, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield rows(done)
    if key is not None:
        yield rows([(*key, state.hexdigest())])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(sums, ends_sha256) of each node in which conversations end."""
    longs = ", ".join(f"{s} long" for s in SUMS)
    spread = ends.repartitionByRange(*SUMS, "conv_id").sortWithinPartitions(*SUMS, "conv_id")
    chunks = spread.mapInArrow(_packed, f"{longs}, first long, ids string")
    placed = chunks.repartition(*SUMS).sortWithinPartitions(*SUMS, "first")
    return placed.mapInArrow(_hashed, f"{longs}, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    `turns` are (conv_id, idx, digest, bytes) with places from 0, `members` (conv_id, n_turns) all conversations.
    """
    members = written(members)
    nodes, ends = prefix_nodes(turns, members)
    children = nodes.where("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    out = nodes.join(subtree_totals(nodes), NODE).join(ends_hashes(ends), SUMS, "left")
    nothing = hashlib.sha256().hexdigest()
    return out.select(*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are, with role and text of each node's last turn (null at the root)."""
    turns = ordered_turns(conversations)
    nodes = trie(turns, members_of(turns))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    said = conversations.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).distinct().withColumn("digest", digest)
    last = turns.select("conv_id", (F.col("idx") + 1).alias("depth"), "digest").join(nodes.select(*NODE), NODE, "left_semi").join(said, "digest")
    return nodes.join(last.select(*NODE, "role", "text"), NODE, "left")
