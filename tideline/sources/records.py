"""CSV and JSON record readers with pinned text schemas, and lines numbered across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions.ordering import running_totals
from tideline.session import cut

RECORD_KEYS = ("data", "results", "records")


def read_csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header checked against ``columns``; every field stays text.

    A ragged row fails the job.  The byte-order mark of UTF-8 files is dropped
    by the reader.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(
        path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", multiLine=True, quote='"', escape='"'
    )


def read_piped(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", sep="|", quote='"')


# The well-formed byte sequences of UTF-8.
UTF8 = (
    r"[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
)


def repair_bytes(column: F.Column) -> F.Column:
    """Text of raw bytes: valid UTF-8 as is, otherwise every undecodable byte as its own code point.

    Broken values are cut into runs of well-formed sequences and single stray bytes by a pattern over their Latin-1 form.
    """
    single = F.decode(column, "ISO-8859-1")
    pieces = F.regexp_extract_all(single, F.lit(f"(?s)((?:{UTF8}){{1,500}}+|.)"), F.lit(1))
    whole = F.transform(pieces, lambda x: F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), x))
    utf8 = F.try_validate_utf8(column.cast("string"))
    return F.when(utf8.isNotNull() | column.isNull(), utf8).otherwise(F.array_join(whole, ""))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, first, value): the lines of the text files under ``path``, numbered from 1 through the files in name order.

    ``first`` marks the first line of a file; ``value`` holds raw bytes.  Splits count their lines by themselves, and
    running sums of the counts give each split its offset, so no task reads a file whole.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("position"), F.col("value").cast("binary").alias("value"),
    ).transform(cut)
    splits = lines.groupBy("file", "split").agg(F.min("position").alias("start"), F.count("*").alias("n"))
    offsets = running_totals(splits, [], ["file", "split"], {"upto": F.col("n")})
    heads = splits.groupBy("file").agg(F.min("split").alias("head"))
    placed = lines.join(offsets, ["file", "split"]).join(heads, "file")
    place = F.col("position") - F.col("start")
    return placed.select("file", (F.col("upto") - F.col("n") + place + 1).alias("line"), ((F.col("split") == F.col("head")) & (place == 0)).alias("first"), "value")


def read_annual(spark: SparkSession, path: str, header: list[str], **constants) -> DataFrame:
    """(constants, source_row, header columns as text) of the CSV files under ``path``, one year's source.

    Every file begins with exactly this header, and every record has exactly these fields on one line; anything else
    stops the run.  ``source_row`` counts the records from 1 through the files in name order.
    """
    numbered = numbered_lines(spark, path)
    text = repair_bytes(F.col("value"))
    found = F.regexp_replace(text, "^\ufeff", "")
    wrong = F.raise_error(F.concat(F.lit("unexpected header in "), F.col("file"), F.lit(": "), found))
    heads = numbered.filter("first").select("file", F.col("line").alias("at"))
    rows = numbered.filter(F.when(F.col("first"), F.when(found == ",".join(header), False).otherwise(wrong.cast("boolean"))).otherwise(True))
    # headers of earlier files are no records
    before = running_totals(heads, [], ["at"], {"skipped": F.lit(1)}).select("file", "skipped")
    schema = ", ".join(f"`{c}` string" for c in header)
    fields = F.from_csv(text, schema, {"mode": "FAILFAST", "quote": '"', "escape": '"'})
    fixed = [F.lit(v).alias(k) for k, v in constants.items()]
    return rows.join(before, "file").select(*fixed, (F.col("line") - F.col("skipped")).alias("source_row"), fields.alias("r")).select(*constants, "source_row", *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in header])


def json_records(texts: DataFrame, record_type: str, column: str = "value") -> DataFrame:
    """Records of JSON documents: a bare array, or the first list under data / results / records."""
    body = F.col(column)
    wrapped = F.from_json(body, "struct<" + ",".join(f"{k}:array<{record_type}>" for k in RECORD_KEYS) + ">")
    bare = F.from_json(body, f"array<{record_type}>")
    listed = F.when(F.ltrim(body).startswith("["), bare).otherwise(
        F.coalesce(*[wrapped[k] for k in RECORD_KEYS])
    )
    bad = F.raise_error(F.lit("expected a JSON record list"))
    return texts.select(F.explode(F.when(listed.isNull(), bad).otherwise(listed)).alias("r")).select("r.*")
