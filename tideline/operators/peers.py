"""Statistics over the peers of an entity as of each of its target dates.

Two entities are peers at date t when some owner was attached to both by t.
Listing all (entity, peer) pairs of a common owner is quadratic in the owner's
size, so entities are cut into tiles, and link dates and sums are small
matrices.  Entities are sorted by an owner first, so that the tiles keep owners
together.  A task holds the targets of some consecutive tiles with their sums;
the tiles that the postings of the owners connect to any of them stream by
once, so a tile is shuffled once for each task and no partial sum is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.functions.ordering import dense_index, running_totals
from tideline.operators.tiles import meeting_tiles
from tideline.session import cut

TILE = 512
FAR = np.iinfo(np.int32).max
#: Groups of left tiles for each core.
TASKS = 4
#: Cells of the arrays that a step holds.
CELLS = 1 << 21
# Names that the results carry, in their order.
STATS = (
    "peer_count",
    "peer_prior_facilities",
    "peer_prior_inspections",
    "peer_prior_serious",
    "peer_recent365_inspections",
    "peer_recent365_serious",
    "peer_recent730_serious",
    "peer_any_serious365",
    "peer_any_serious730",
)


def _sparse(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry of some lists."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass(frozen=True)
class _Peers:
    """Entities of one tile by number: their attachments in the order of owners, and their events."""

    no: np.ndarray
    owner: tuple[np.ndarray, np.ndarray, np.ndarray]  # entity, owner, day
    events: tuple[np.ndarray, np.ndarray, np.ndarray]  # entity, day, serious

    @classmethod
    def of(cls, rows: pa.StructArray) -> "_Peers":
        holder, owner = _sparse(rows.field("owners"))
        order = np.argsort(owner, kind="stable")
        attached = holder[order], owner[order], _sparse(rows.field("owner_days"))[1][order]
        return cls(rows.field("no").to_numpy(), attached, (*_sparse(rows.field("days")), _sparse(rows.field("serious"))[1]))

    def values(self, dates: np.ndarray) -> np.ndarray:
        """(date, peer, statistic) of what was known strictly before each date. Whole numbers far below 2 ** 24."""
        entity, day, serious = self.events
        shape = len(dates) + 1, len(self.no)

        def before(shift: int, weights: np.ndarray | None = None) -> np.ndarray:
            at = np.searchsorted(dates - shift, day, side="right") * shape[1] + entity
            return np.cumsum(np.bincount(at, weights, shape[0] * shape[1]).reshape(shape)[:-1], axis=0, dtype=np.float32)

        seen, bad = before(0), before(0, serious)
        near, worse, worse2 = seen - before(365), bad - before(365, serious), bad - before(730, serious)
        return np.stack([np.ones_like(near), seen > 0, seen, bad, near, worse, worse2, worse > 0, worse2 > 0], axis=2, dtype=np.float32, casting="unsafe")


class _Targets:
    """The targets of some tiles and the sums that they have gathered."""

    def __init__(self, tiles: list[pa.StructArray]):
        rows = pa.concat_arrays(tiles)
        self.names, self.no = rows.field("entity"), rows.field("no").to_numpy()
        self.owner = (*_sparse(rows.field("owners")), _sparse(rows.field("owner_days"))[1])
        entity, day = _sparse(rows.field("targets"))
        order = np.argsort(day, kind="stable")
        self.entity, self.day = entity[order], day[order]
        self.dates, first = np.unique(self.day, return_index=True)
        self.first = np.append(first, len(day))
        self.sums = np.zeros((len(day), len(STATS)))

    def links(self, peers: _Peers) -> np.ndarray | None:
        """Earliest day on which each entity shares an attached owner with each peer; None if no owner is shared."""
        holder, owner, since = peers.owner
        low = np.searchsorted(owner, self.owner[1])
        many = np.searchsorted(owner, self.owner[1], side="right") - low
        if not many.any():
            return None
        out = np.full(len(self.no) * len(peers.no), FAR, np.int32)
        steps = np.cumsum(many) // CELLS
        for step in np.unique(steps[many > 0]):
            mine = np.flatnonzero((steps == step) & (many > 0))
            n = many[mine]
            at = np.repeat(low[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(self.owner[0][mine], n) * len(peers.no) + holder[at]
            np.minimum.at(out, cell, np.maximum(np.repeat(self.owner[2][mine], n), since[at]).astype(np.int32))
        out = out.reshape(len(self.no), len(peers.no))
        _, own, itself = np.intersect1d(self.no, peers.no, return_indices=True)
        out[own, itself] = FAR
        return out

    def meet(self, peers: _Peers) -> None:
        link = self.links(peers)
        if link is None:
            return
        dates = self.dates[np.searchsorted(self.dates, link.min()) :]
        skipped = len(self.dates) - len(dates)
        step = max(1, CELLS // (len(STATS) * max(1, len(peers.no))))
        for lo in range(0, len(dates), step):
            values = peers.values(dates[lo : lo + step])
            for d in range(len(values)):
                at = slice(self.first[skipped + lo + d], self.first[skipped + lo + d + 1])
                self.sums[at] += (link[self.entity[at]] <= dates[lo + d]).astype(np.float32) @ values[d]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        kept = np.flatnonzero(self.sums[:, 0] > 0)
        sums = np.rint(self.sums[kept]).astype(np.int64)
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.entity[kept])), pa.array(self.day[kept].astype(np.int32)), *map(pa.array, sums.T.copy())], schema=schema)


def peer_statistics(targets: DataFrame, attachments: DataFrame, events: DataFrame, tile: int = TILE) -> DataFrame:
    """(entity, day, peer statistics) for every target with at least one peer.

    ``targets``: distinct (entity, day INT); ``attachments``: (entity, owner, since INT),
    one row per pair; ``events``: distinct (entity, day INT, serious INT).  Days
    are day numbers.
    """
    numbers = dense_index(attachments, "owner", "_owner").transform(cut)  # only a number of an owner travels
    attachments = attachments.join(numbers, "owner").select("entity", F.col("_owner").cast("int").alias("owner"), "since")
    owners = attachments.groupBy("entity").agg(F.collect_list(F.struct("owner", "since")).alias("o"), F.min("owner").alias("first"))
    history = events.groupBy("entity").agg(F.collect_list(F.struct("day", "serious")).alias("e"))
    wanted = targets.groupBy("entity").agg(F.collect_list("day").alias("targets"))
    packed = (
        owners.join(history, "entity", "left")
        .join(wanted, "entity", "left")
        .select(
            "entity",
            "first",
            F.col("o.owner").alias("owners"),
            F.col("o.since").alias("owner_days"),
            F.col("e.day").alias("days"),
            F.col("e.serious").alias("serious"),
            "targets",
        )
    )
    numbered = running_totals(packed, [], ["first", "entity"], {"no": F.lit(1).cast("long")})
    packed = numbered.withColumn("tile", F.floor((F.col("no") - 1) / tile).cast("long")).drop("first").transform(cut)
    held = lambda rows: rows.select("tile", F.explode("owners").alias("item")).distinct()
    left = packed.filter("targets is not null")
    tiles = packed.agg(F.max("tile")).first()[0]
    together = -(-((tiles or 0) + 1) // (TASKS * max(1, packed.sparkSession.sparkContext.defaultParallelism)))
    group = lambda name: F.floor(F.col(name) / together).cast("long").alias("group")
    pairs = meeting_tiles(held(left), held(packed), []).select(group("ti"), "tj").distinct().transform(cut)
    members = ("no", "entity", "owners", "owner_days", "days", "serious", "targets")
    none = lambda rows, *names: rows.withColumns({n: F.lit(None).cast(rows.schema[n].dataType) for n in names})
    blob = lambda rows: rows.groupBy("tile").agg(F.collect_list(F.struct(*members)).alias("members"))
    mine = blob(none(left, "days", "serious")).select(group("tile"), (-1 - F.col("tile")).alias("tj"), "members")
    peers = blob(none(packed, "entity", "targets")).withColumnRenamed("tile", "tj").join(pairs, "tj").select("group", "tj", "members")
    kind = dict(targets.dtypes)["entity"]
    schema = f"entity {kind}, day int, " + ", ".join(f"{s} long" for s in STATS)
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], None
        for batch in batches:
            at, rows = (batch.column(batch.schema.get_field_index(n)) for n in ("tj", "members"))
            for k in range(batch.num_rows):
                if at[k].as_py() < 0:  # sorted first
                    waiting.append(rows[k].values)
                    continue
                held = held or _Targets(waiting)
                held.meet(_Peers.of(rows[k].values))
        if held:
            yield held.rows(out)

    both = mine.unionByName(peers)
    groups = -(-((tiles or 0) + 1) // together)
    dealt = both.repartition(min(4 * groups, 1 << 13), "group").sortWithinPartitions("group", "tj")
    return dealt.groupBy("group").applyInArrow(stats, schema)
