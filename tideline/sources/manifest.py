"""Source manifests: describe files, compare with expectations, check the manifest's own rules."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = 8 << 20


def describe(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, bytes, sha256) of the files matching ``pattern``.

    Listing comes from the file source; contents are hashed in chunks by the
    tasks, so a file of any size never has to fit a row.
    """
    listed = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))

    def digest(frames):
        from pyarrow import fs

        for f in frames:
            hashes = []
            for path in f["path"]:
                system, inner = fs.FileSystem.from_uri(path)
                state = hashlib.sha256()
                with system.open_input_stream(inner) as handle:
                    while chunk := handle.read(CHUNK):
                        state.update(chunk)
                hashes.append(state.hexdigest())
            yield pd.DataFrame({"name": f["path"].str.rsplit("/", n=1).str[-1], "bytes": f["bytes"], "sha256": hashes})

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(width, "path").mapInPandas(digest, "name string, bytes long, sha256 string")


def drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the manifest whose file is missing or differs in size or hash, and files it does not list."""
    e = expected.select("name", F.col("bytes").alias("eb"), F.col("sha256").alias("eh"))
    f = found.select("name", F.col("bytes").alias("fb"), F.col("sha256").alias("fh"))
    problem = (
        F.when(F.col("fb").isNull(), "missing")
        .when(F.col("eb").isNull(), "unlisted")
        .when(F.col("eb") != F.col("fb"), "size")
        .when(F.col("eh") != F.col("fh"), "hash")
    )
    return e.join(f, "name", "full_outer").withColumn("problem", problem).filter("problem is not null")


def require_sound(entries: list[dict]) -> None:
    """Years distinct and contiguous; paths relative, inside the root and unique; hashes well formed."""
    years = sorted(int(e["year"]) for e in entries)
    if years != list(range(years[0], years[0] + len(years))):
        raise ValueError(f"manifest years must be distinct and contiguous: {years}")
    paths = [e["path"] for e in entries]
    if len(set(paths)) != len(paths):
        raise ValueError("manifest paths must be unique")
    for e in entries:
        parts = str(e["path"]).split("/")
        if not e["path"] or e["path"].startswith("/") or ".." in parts:
            raise ValueError(f"manifest path must stay inside the root: {e['path']!r}")
        if len(e["sha256"]) != 64 or set(e["sha256"].lower()) - set("0123456789abcdef"):
            raise ValueError(f"manifest hash is malformed for {e['path']!r}")


def describe_rows(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """(name, rows, checksum) of a table: the sum of a 60-bit hash of every row, whatever their order."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    mark = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    total = F.coalesce(F.sum(mark), F.lit(0)).cast("decimal(38,0)").cast("string")
    return rows.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), total.alias("checksum"))


def row_drift(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(name, problem) of the tables that are missing, unlisted, or differ in rows or in content."""
    e = expected.select("name", F.col("rows").alias("er"), F.col("checksum").alias("ec"))
    f = found.select("name", F.col("rows").alias("fr"), F.col("checksum").alias("fc"))
    problem = (
        F.when(F.col("fr").isNull(), "missing").when(F.col("er").isNull(), "unlisted")
        .when(F.col("er") != F.col("fr"), "rows").when(F.col("ec") != F.col("fc"), "content")
    )
    return e.join(f, "name", "full_outer").select("name", problem.alias("problem")).filter("problem is not null")
