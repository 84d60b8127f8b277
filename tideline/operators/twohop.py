"""Two-hop neighbour scores by tiled incidence products.

Entities sharing an item are neighbours; a candidate's score sums a weight over
the neighbours that hold it.  Joining item lists to themselves would emit
every pair of holders of a popular item.

Items get dense ids, and entities with equal item sets fold into one set with a
multiplicity: what an entity adds to its own score are items it holds, which
are no candidates, so the scores of a set serve all its entities.  Sets are
sorted by their items and cut into tiles, which keeps similar ones together.
Postings of the items say which tiles meet; each left tile is read once, and
the tiles it meets stream by while their products add up, so a task holds two
tiles and one block of scores, and no pair of entities is ever a row.  A tile
travels as bits where that is shorter than lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideline.functions.ordering import dense_index, running_totals
from tideline.operators.ranking import catalogue_positions
from tideline.operators.tiles import meeting_tiles
from tideline.session import cut

LARGEST, SMALLEST = 4096, 64
CELLS_PER_TASK = 1 << 22
COLUMN_CHUNK = 4096
#: Peers that a product takes at a time, columns of its first step, and rows of an output batch.
PEERS, FIRST_COLUMNS, ROWS_OUT = 1024, 128, 1 << 18
#: Pairs of sets whose similarities are held at a time, so that they stay in the cache.
PAIRS = 1 << 17


def _sparse(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry of some lists."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def _bytes(entries: tuple[np.ndarray, np.ndarray], rows: int, items: int) -> tuple[bool, bytes]:
    """Sets as rows of bits or as lengths and ids, whichever is shorter."""
    row, value = entries
    if 4 * (len(value) + rows) > rows * -(-items // 8):
        out = np.zeros((rows, items), bool)
        out[row, value] = True
        return True, np.packbits(out, axis=1).tobytes()
    return False, np.concatenate([np.bincount(row, minlength=rows), value]).astype(np.int32).tobytes()


def _entries(bits: bool, data: bytes, rows: int, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry, in order."""
    if bits:
        return np.nonzero(np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1, count=items))
    numbers = np.frombuffer(data, np.int32)
    return np.repeat(np.arange(rows), numbers[:rows]), numbers[rows:].astype(np.int64)


def _packed(items: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(period, tile, sets) to (period, tile, no, m, bits, data, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sets = batch.column(2)[k].values
                bits, data = _bytes(_sparse(sets.field("items")), len(sets), items)
                own = [pa.ListArray.from_arrays(pa.array([0, len(sets)], pa.int32()), sets.field(c)) for c in ("no", "m", "wanted")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), *own[:2], pa.array([bits]), pa.array([data], pa.binary()), own[2]],
                    names=["period", "tile", "no", "m", "bits", "data", "wanted"],
                )

    return run


def _dense(entries: tuple[np.ndarray, np.ndarray], rows: int, lo: int, hi: int, dtype) -> np.ndarray:
    row, value = entries
    inside = (value >= lo) & (value < hi)
    out = np.zeros((rows, hi - lo), dtype)
    out[row[inside], value[inside] - lo] = 1
    return out


class _Tile:
    """The sets of one left tile and the scores that they have gathered."""

    def __init__(self, period: pa.Array, numbers: np.ndarray, own: tuple[np.ndarray, np.ndarray], wanted: pa.ListArray, kind: str, items: int, extra: pa.ListScalar | None = None):
        self.period, self.kind, self.items, self.extra = period, kind, items, extra
        self.numbers, self.own = numbers, own
        self.sizes = np.bincount(own[0], minlength=len(numbers))
        self.wanted = None if wanted.null_count == len(wanted) else _sparse(wanted)
        self.scores = np.zeros((len(numbers), items))
        held = np.bincount(own[1], minlength=items)
        order = np.argsort(-held, kind="stable")
        self.width = int((held > 0).sum())  # only what the tile holds can be shared; popular items first
        self.place = np.full(items, items)
        self.place[order[: self.width]] = np.arange(self.width)
        self.placed = own[0], self.place[own[1]]
        self.held: list[np.ndarray] | None = None

    def _steps(self, first: int) -> Iterator[tuple[int, int]]:
        lo = 0
        while lo < self.width:
            hi = min(self.width, lo + first)
            yield lo, hi
            lo, first = hi, min(2 * first, COLUMN_CHUNK)

    def _similar(self, many: np.ndarray, peer: tuple[np.ndarray, np.ndarray]) -> None:
        """Add the Jaccard similarities, some rows at a time."""
        placed, columns = (peer[0], self.place[peer[1]]), range(0, self.items, COLUMN_CHUNK)
        if self.held is None:
            self.held = [_dense(self.placed, len(self.numbers), lo, hi, np.float32) for lo, hi in self._steps(COLUMN_CHUNK)]
        theirs = [_dense(placed, len(many), lo, hi, np.float32).T for lo, hi in self._steps(COLUMN_CHUNK)]
        whole = [_dense(peer, len(many), lo, min(self.items, lo + COLUMN_CHUNK), np.float64) for lo in columns]
        sizes = np.bincount(peer[0], minlength=len(many)).astype(np.float64)
        step = max(1, PAIRS // len(many))
        for k in range(0, len(self.numbers), step):
            shared = sum(mine[k : k + step] @ other for mine, other in zip(self.held, theirs))
            near = shared.any(axis=0)
            if not near.any():
                continue
            some = slice(None) if 2 * np.count_nonzero(near) > len(near) else np.flatnonzero(near)
            weight = shared[:, some].astype(np.float64)
            union = np.add.outer(self.sizes[k : k + step].astype(np.float64), sizes[some])
            union -= weight
            weight /= union
            weight *= many[some]
            for lo, items in zip(columns, whole):
                self.scores[k : k + step, lo : lo + COLUMN_CHUNK] += weight @ items[some]

    def _near(self, peer: tuple[np.ndarray, np.ndarray], many: int) -> np.ndarray:
        """Which peers share an item; pairs that the popular items settle are left out of the later steps."""
        near = np.zeros((len(self.numbers), many), bool)
        for lo, hi in self._steps(FIRST_COLUMNS):
            rows, peers = np.flatnonzero(~near.all(axis=1)), np.flatnonzero(~near.all(axis=0))
            if not len(rows):
                break
            left, right = _dense(self.placed, len(self.numbers), lo, hi, np.float32)[rows], _dense(peer, many, lo, hi, np.float32)[peers]
            near[np.ix_(rows, peers)] |= left @ right.T > 0
        return near

    def _add(self, weight: np.ndarray, peer: tuple[np.ndarray, np.ndarray]) -> None:
        rows, peers = np.flatnonzero(weight.any(axis=1)), np.flatnonzero(weight.any(axis=0))
        if not len(rows):
            return
        weight = weight[np.ix_(rows, peers)]
        for lo in range(0, self.items, COLUMN_CHUNK):
            hi = min(self.items, lo + COLUMN_CHUNK)
            self.scores[rows, lo:hi] += weight @ _dense(peer, len(self._many), lo, hi, np.float64)[peers]

    def meet(self, many: np.ndarray, peers: tuple[np.ndarray, np.ndarray]) -> None:
        for k in range(0, len(many), PEERS):
            a, b = np.searchsorted(peers[0], [k, k + PEERS])
            self._meet(many[k : k + PEERS], (peers[0][a:b] - k, peers[1][a:b]))

    def _meet(self, many: np.ndarray, peer: tuple[np.ndarray, np.ndarray]) -> None:
        self._many = many
        if self.kind == "jaccard":
            return self._similar(many, peer)
        near = self._near((peer[0], self.place[peer[1]]), len(many))
        if 2 * np.count_nonzero(near) <= near.size:
            return self._add(near * many, peer)
        # Most peers are near: all of them less the few others. Whole numbers, so the difference is exact.
        self.scores += np.bincount(peer[1], weights=many[peer[0]], minlength=self.items)
        self._add(~near * -many, peer)

    def by_entity(self) -> Iterator[pa.RecordBatch]:
        """(period, entity, id, score) of the sets' entities, some sets at a time."""
        members = self.extra.values
        at = np.searchsorted(self.numbers, members.field("no").to_numpy())
        asked = None
        if self.wanted is not None:
            asked = np.zeros(self.scores.shape, bool)
            asked[self.wanted] = True
        self.scores[self.own] = 0
        step = max(1, ROWS_OUT // max(1, self.items))
        for k in range(0, len(at), step):
            some = self.scores[at[k : k + step]]
            row, item = np.nonzero(some > 0 if asked is None else (some > 0) & asked[at[k : k + step]])
            if len(row):
                period = self.period.take(pa.array(np.zeros(len(row), np.int64)))
                yield pa.RecordBatch.from_arrays([period, members.field("entity").take(pa.array(row + k)), pa.array(item), pa.array(some[row, item])], names=["period", "entity", "id", "score"])

    def rows(self) -> pa.RecordBatch:
        keep = self.scores > 0
        keep[self.own] = False
        if self.wanted is not None:
            asked = np.zeros_like(keep)
            asked[self.wanted] = True
            keep &= asked
        row, item = np.nonzero(keep)
        period = self.period.take(pa.array(np.zeros(len(row), np.int64)))
        return pa.RecordBatch.from_arrays([period, pa.array(self.numbers[row]), pa.array(item), pa.array(self.scores[row, item])], names=["period", "no", "id", "score"])

    def ranks(self, digits: int) -> pa.RecordBatch:
        """Places of the wanted items among all that a set lacks: score down, catalogue place up."""
        place = np.full(self.items, np.iinfo(np.int64).max)
        ids, at = (self.extra.values.field(k).to_numpy() for k in ("id", "place"))
        place[ids] = at
        order = np.argsort(place, kind="stable")
        scores = np.round(self.scores, digits)
        scores[self.own] = -np.inf
        scores[:, place == np.iinfo(np.int64).max] = -np.inf
        rows, items = self.wanted
        out = np.zeros(len(rows), np.int64)
        for k in range(0, len(self.numbers), SMALLEST):
            upto = np.argsort(-scores[k : k + SMALLEST][:, order], axis=1, kind="stable")
            rank = np.empty_like(upto)
            np.put_along_axis(rank, upto, np.broadcast_to(np.arange(1, self.items + 1), upto.shape), axis=1)
            back = np.empty_like(rank)
            back[:, order] = rank
            mine = (rows >= k) & (rows < k + SMALLEST)
            out[mine] = back[rows[mine] - k, items[mine]]
        fits = np.isfinite(scores[rows, items])
        rows, items, out = rows[fits], items[fits], out[fits]
        period = self.period.take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.RecordBatch.from_arrays([period, pa.array(self.numbers[rows]), pa.array(items.astype(np.int64)), pa.array(out)], names=["period", "no", "id", "rank"])


def _products(kind: str, items: int, done: Callable[[_Tile], Iterator[pa.RecordBatch]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        for batch in batches:
            periods, tj, no, many, bits, data, wanted = (batch.column(k) for k in range(7))
            for k in range(batch.num_rows):
                numbers = no[k].values.to_numpy()
                entries = _entries(bits[k].as_py(), data[k].as_py(), len(numbers), items)
                if tj[k].as_py() < 0:
                    if tile is not None:
                        yield from done(tile)
                    tile = _Tile(periods.slice(k, 1), numbers, entries, wanted[k].values, kind, items, batch.column(7)[k] if batch.num_columns > 7 else None)
                else:
                    tile.meet(many[k].values.to_numpy().astype(np.float64), entries)
        if tile is not None:
            yield from done(tile)

    return run


@dataclass(frozen=True)
class SetScores:
    """Scores of sets: ``found`` is (period, no, id, score), (period, entity, id, score), or (period, no, id, rank) of the wanted items."""

    found: DataFrame
    members: DataFrame
    ids: DataFrame


def two_hop_sets(
    incidence: DataFrame,
    targets: DataFrame | None = None,
    wanted: DataFrame | None = None,
    kind: str = "count",
    tile: int | None = None,
    places: DataFrame | None = None,
    digits: int = 12,
    by_entity: bool = False,
) -> SetScores:
    """The scores of `two_hop_scores` by set, with ``members`` (period, entity, no) and ``ids`` (item, id).

    With ``places`` (period, item, place), ranks of the wanted items take the place of the scores, which are rounded to
    ``digits`` first: no score leaves its task.  With ``by_entity`` the rows have the entities of the sets in place of
    ``no``, which saves dealing the scores out again.
    """
    ids = dense_index(incidence.select("item").distinct(), "item", "id").withColumn("id", F.col("id").cast("int")).transform(cut)
    items = ids.count()
    edge = tile or max(SMALLEST, min(LARGEST, CELLS_PER_TASK // max(1, items)))
    packed = incidence.join(ids, "item").groupBy("period", "entity").agg(F.sort_array(F.collect_list("id")).alias("items")).transform(cut)
    sets = packed.groupBy("period", "items").agg(F.count("*").alias("m"))
    sets = running_totals(sets, ["period"], ["items"], {"no": F.lit(1).cast("long")})
    sets = sets.withColumn("tile", F.floor((F.col("no") - 1) / edge).cast("long")).transform(cut)
    members = packed.join(sets.select("period", "items", "no"), ["period", "items"]).select("period", "entity", "no")
    asked = F.lit(None).cast("array<int>")
    if wanted is not None:
        members = members.join(wanted.select("period", "entity").distinct(), ["period", "entity"], "left_semi").transform(cut)
        lists = wanted.join(members, ["period", "entity"]).join(ids, "item").groupBy("period", "no").agg(F.collect_set("id").alias("wanted"))
        heads = sets.join(lists, ["period", "no"])
    else:
        if targets is not None:
            members = members.join(targets.select("period", "entity").distinct(), ["period", "entity"], "left_semi")
        members = members.transform(cut)
        heads = sets.join(members.select("period", "no").distinct(), ["period", "no"], "left_semi").withColumn("wanted", asked)
    heads = heads.transform(cut)

    types = dict(incidence.dtypes)  # an item may be of any ordered type: only its dense id travels

    def blobs(rows: DataFrame) -> DataFrame:
        tiles = rows.groupBy("period", "tile").agg(F.sort_array(F.collect_list(F.struct("no", "m", "items", "wanted"))).alias("sets"))
        return tiles.mapInArrow(_packed(items), f"period {types['period']}, tile long, no array<long>, m array<long>, bits boolean, data binary, wanted array<array<int>>").transform(cut)

    spread = lambda rows: rows.select("period", "tile", F.explode("items").alias("item")).distinct()
    pairs = meeting_tiles(spread(heads), spread(sets), ["period"])
    peers = blobs(sets.withColumn("wanted", asked)).withColumnRenamed("tile", "tj")
    left = blobs(heads).withColumnRenamed("tile", "ti").withColumn("tj", F.lit(-1).cast("long"))
    columns = ["period", "tj", "no", "m", "bits", "data", "wanted"]
    if places is not None:
        order = places.join(ids, "item").groupBy("period").agg(F.collect_list(F.struct("id", F.col("place").cast("long").alias("place"))).alias("extra"))
        left = left.join(order, "period")
    elif by_entity:
        tile_of = F.floor((F.col("no") - 1) / edge).cast("long").alias("ti")
        left = left.join(members.groupBy("period", tile_of).agg(F.sort_array(F.collect_list(F.struct("no", "entity"))).alias("extra")), ["period", "ti"])
    if "extra" in left.columns:
        columns.append("extra")
        peers = peers.withColumn("extra", F.lit(None).cast(left.schema["extra"].dataType))
    rows = left.select("ti", *columns).unionByName(pairs.join(peers, ["period", "tj"]).select("ti", *columns))
    tiles = heads.select("period", "tile").distinct().count()
    dealt = rows.repartition(max(1, min(4 * tiles, 1 << 13)), "period", "ti").sortWithinPartitions("period", "ti", "tj")
    if places is not None:
        done, schema = lambda tile: iter([tile.ranks(digits)]), f"period {types['period']}, no long, id long, rank long"
    elif by_entity:
        done, schema = _Tile.by_entity, f"period {types['period']}, entity {types['entity']}, id long, score double"
    else:
        done, schema = lambda tile: iter([tile.rows()]), f"period {types['period']}, no long, id long, score double"
    return SetScores(dealt.select(*columns).mapInArrow(_products(kind, items, done), schema), members, ids)


def two_hop_scores(
    incidence: DataFrame,
    targets: DataFrame | None = None,
    wanted: DataFrame | None = None,
    kind: str = "count",
    tile: int | None = None,
) -> DataFrame:
    """Non-zero scores (period, entity, item, score) of items the entity does not hold.

    ``incidence``: distinct (period, entity, item).  ``targets``: the (period,
    entity) rows to score; ``wanted``: or the exact (period, entity, item) rows.
    ``kind``: ``count`` counts neighbours, ``jaccard`` sums their similarity.
    """
    of = two_hop_sets(incidence, targets, wanted, kind, tile, by_entity=True)
    scores = of.found.join(of.ids, "id").select("period", "entity", "item", "score")
    if wanted is not None:
        scores = scores.join(wanted.select("period", "entity", "item").distinct(), ["period", "entity", "item"], "left_semi")
    return scores


def two_hop_ranks(incidence: DataFrame, wanted: DataFrame, catalogue: DataFrame, kind: str = "jaccard") -> DataFrame:
    """(period, entity, item, rank) of the wanted rows among all items the entity does not hold: score down, then `catalogue_positions`.

    Equal sets rank alike, so a set's ranks are found in the task that holds its scores, and only the wanted ones are rows.
    An entity without items ranks by the catalogue alone.
    """
    places = catalogue_positions(catalogue).select("period", "item", "place").transform(cut)
    of = two_hop_sets(incidence, None, wanted, kind, places=places)
    asked = wanted.select("period", "entity", "item").join(of.members, ["period", "entity"], "left").join(of.ids, "item").join(places, ["period", "item"])
    ranked = asked.join(of.found.withColumn("id", F.col("id").cast("int")), ["period", "no", "id"], "left")
    rank = F.when(F.col("no").isNull(), F.col("place").cast("long")).otherwise(F.col("rank"))
    return ranked.select("period", "entity", "item", rank.alias("rank"))
