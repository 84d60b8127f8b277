"""Training matrices as packed blocks, and sums of per-block arrays.

A block row holds many examples as raw doubles, so an epoch moves bytes instead
of rows.  Each task reduces its blocks to one small array; the arrays have the
size of the model, never of the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tideline.session import cut

ROWS_PER_PARTITION = 20_000
#: Numbers of the result that one row carries.
PIECE = 1 << 14


@dataclass(frozen=True)
class Blocks:
    """A written table of block rows and how many tasks read it."""

    table: DataFrame
    partitions: int


def pack(rows: DataFrame, features: list[str], label: str, period: str, keys: list[str]) -> Blocks:
    """(x, y, t) blocks of the rows, placed and ordered by ``keys`` so a rerun sums in the same order."""
    data = rows.select(
        *keys, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
        F.col(label).cast("double").alias("_y"), F.col(period).cast("double").alias("_t"),
    ).transform(cut)
    spark = rows.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), data.count() // ROWS_PER_PARTITION + 1))
    placed = data.repartition(parts, *keys).sortWithinPartitions(*keys).select("_x", "_y", "_t")

    def build(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["_x"].to_numpy()).astype(np.float64)
                yield pd.DataFrame({"x": [x.tobytes()], "y": [f["_y"].to_numpy().tobytes()], "t": [f["_t"].to_numpy().tobytes()]})

    return Blocks(placed.mapInPandas(build, "x binary, y binary, t binary").transform(cut), parts)


def block_sum(blocks: Blocks, size: int, reduce: Callable[..., np.ndarray]) -> np.ndarray:
    """Sum ``reduce(columns of one block row)`` over all blocks; ``size`` is the flat result length.

    The sums of the tasks meet piece by piece in the executors; the driver gets one array of the model's size.
    """

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                total += reduce(*row)
        for k in range(0, size, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([total[k : k + PIECE]], pa.list_(pa.float64()))], names=["k", "g"])

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in group.column("g")], axis=0)
        return pa.table({"k": group.column("k").slice(0, 1), "g": pa.array([total], pa.list_(pa.float64()))})

    out = np.zeros(size)
    pieces = blocks.table.mapInArrow(run, "k long, g array<double>").groupBy("k").applyInArrow(added, "k long, g array<double>")
    for row in pieces.toArrow().to_batches():
        for k, g in zip(row.column(0).to_pylist(), row.column(1)):
            out[k : k + PIECE] = g.values.to_numpy()
    return out


def block_descent(blocks: Blocks, start: np.ndarray, epochs: int, gradient: Callable[..., np.ndarray], step: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The state after ``epochs`` times ``state = step(epoch, state, sum of gradient(state, *block))``.

    The executors keep the blocks, in memory as far as it goes, so an epoch reads no table, plans no query and shuffles
    nothing: each task returns one array of the model's size, and they are summed in the order of the tasks.
    """
    spark = blocks.table.sparkSession
    rows = blocks.table.rdd.map(lambda row: tuple(bytes(v) for v in row))
    held = rows.coalesce(max(1, spark.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)
    state = start
    try:
        for epoch in range(epochs):
            sums = held.mapPartitions(lambda part: [sum((gradient(state, *block) for block in part), np.zeros(len(start)))]).collect()  # noqa: B023
            state = step(epoch, state, np.sum(sums, axis=0))
    finally:
        held.unpersist()
    return state


def unpack(x: bytes, y: bytes, t: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    labels = np.frombuffer(y)
    return np.frombuffer(x).reshape(len(labels), -1), labels, np.frombuffer(t)
