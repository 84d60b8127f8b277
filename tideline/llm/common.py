"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideline.session import checkpoint_root

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GOLDEN, _MIX_A, _MIX_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key as long and text as UTF-8 bytes (null: empty); other columns stay behind, so none can clash."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once, and safe from lost executors."""
    path = f"{checkpoint_root(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over whole arrays of unsigned integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(salt) * _GOLDEN + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each of some runs laid end to end begins."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def int_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Rows of `lengths` values each, as one Arrow list column."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def slices(batch: pa.RecordBatch, texts: pa.Array, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of whole rows of about `max_bytes` of text, so that memory follows the run, not the batch."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // max_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def in_slices(work: Callable[[list, list], pa.RecordBatch], max_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that hands (keys, byte strings) to `work`, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(1), max_bytes):
                yield work(part.column(0).to_pylist(), part.column(1).to_pylist())
        returned()

    return run


def appended(docs: DataFrame, prepare: Callable[[], Callable[[list], list]], new: str, max_bytes: int, text: str = "text") -> DataFrame:
    """`docs` with columns computed from the UTF-8 bytes of its text (null: empty).

    `prepare` runs once a task and gives a function from a list of byte strings to a list of Arrow arrays, one for each
    column of the DDL string `new`. Columns of `docs` with those names are replaced; all others pass unchanged.
    """
    names = [x.split()[0] for x in new.split(", ")]
    base = docs.drop(*names)
    schema = T.StructType([*base.schema.fields, *T._parse_datatype_string(new).fields])
    place = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepare()
        for batch in batches:
            for part in slices(batch, batch.column(place), max_bytes):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(bytes_of(part.column(place)))], names=[*part.schema.names, *names])
        del work
        returned()

    return base.mapInArrow(run, schema)


def bytes_of(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text (null: empty); the column is read as it is, so no second copy travels."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return [x or b"" for x in texts.cast(kind).to_pylist()]


def returned() -> None:
    """Give freed memory back at the end of a task: the worker is kept, and what it holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freeing(task: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back when it has ended and its own data is gone."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        returned()

    return run


def freeing_groups(merge: Callable) -> Callable:
    """An applyInArrow function that gives back what the group before it has left."""

    @wraps(merge)
    def run(group: pa.Table) -> pa.Table:
        returned()
        return merge(group)

    return run
