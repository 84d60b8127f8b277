"""Pipe-delimited report files: scan, classify, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tideline.functions.scalar import is_real_code, quarter_from_text

DEVICE_WIDTH = 34


def read_lines(spark: SparkSession, paths: list[str], header: bool = False) -> DataFrame:
    """(file, split, position, value) of Latin-1 text files, keeping file order and blank lines.

    With ``header`` the first line of every file is set aside.

    ``split`` and ``position`` together order the lines of a file without one
    task reading it whole: splits are ordered by offset and lines within a
    split by the increasing id.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("position"),
        F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("value"),
    )
    if not header:
        return lines
    first = lines.groupBy("file").agg(F.min(F.struct("split", "position")).alias("_first"))
    return lines.join(first, "file").filter(F.struct("split", "position") != F.col("_first")).drop("_first")


def _parsed(rows: DataFrame, **fields: Column) -> DataFrame:
    """The rows with new columns, each computed once for each line.

    They leave through a generator, which a filter on them can't be pushed through; pushed down, it would parse the line
    again for every mention of a field.
    """
    row = rows.withColumn("_row", F.struct(*[value.alias(name) for name, value in fields.items()]))
    return row.select(*rows.columns, F.inline(F.array("_row")))


def classify_device_lines(lines: DataFrame, first: str, last: str) -> DataFrame:
    """Give every line one status and, where valid, its typed fields."""
    rest = [c for c in lines.columns if c != "value"]
    cells = lines.withColumn("_f", F.split("value", r"\|"))
    cell = lambda k: F.get("_f", F.lit(k))
    row = _parsed(
        cells, _blank=F.coalesce(F.col("value"), F.lit("")) == "", _id=cell(0), _width=F.size("_f"), _day=cell(8), _maker=cell(11), _product=F.trim(cell(28))
    ).select(*rest, "_blank", "_id", "_width", "_day", "_maker", "_product")
    row = _parsed(row, _q=quarter_from_text(F.col("_day"), first, last))
    product = F.col("_product")
    status = (
        F.when(F.col("_blank"), "blank")
        .when(~F.col("_id").rlike("^[0-9]+$"), "non_numeric_key")
        .when(F.col("_width") != DEVICE_WIDTH, "wrong_width")
        .when(F.col("_q").isNull(), "outside_window")
        .when(~is_real_code(product), "blank_product")
        .otherwise("valid")
    )
    return row.select(
        *rest,
        status.alias("status"),
        F.col("_id").try_cast("long").alias("key"),
        F.col("_q").alias("quarter"),
        product.alias("product"),
        F.trim("_maker").alias("manufacturer"),
    )


def parse_audit(classified: DataFrame) -> DataFrame:
    return classified.groupBy("file", "status").agg(F.count("*").alias("n_lines"))


def classify_problem_lines(lines: DataFrame) -> DataFrame:
    rest = [c for c in lines.columns if c != "value"]
    cells = lines.withColumn("_f", F.split("value", r"\|"))
    row = _parsed(cells, _blank=F.coalesce(F.col("value"), F.lit("")) == "", _width=F.size("_f"), _id=F.get("_f", F.lit(0)), _code=F.trim(F.get("_f", F.lit(1))))
    status = (
        F.when(F.col("_blank"), "blank")
        .when((F.col("_width") != 2) | ~F.col("_id").rlike("^[0-9]+$"), "malformed")
        .when(~is_real_code(F.col("_code")), "blank_code")
        .otherwise("valid")
    )
    return row.select(
        *rest,
        status.alias("status"),
        F.col("_id").try_cast("long").alias("key"),
        F.col("_code").alias("problem"),
    )


def key_inversions(rows: DataFrame) -> DataFrame:
    """Keys smaller than the previous key, per file, over (file, split, position, key).

    Splits are scanned in parallel; the last key of a split is then compared
    with the first key of the next, a table of one row per split.
    """
    inside = W.partitionBy("file", "split").orderBy("position")
    walked = rows.withColumn("_prev", F.lag("key").over(inside))
    local = walked.groupBy("file", "split").agg(
        F.count_if(F.col("key") < F.col("_prev")).alias("n"),
        F.min_by("key", "position").alias("head"),
        F.max_by("key", "position").alias("tail"),
    )
    across = W.partitionBy("file").orderBy("split")
    seams = local.withColumn("_seam", (F.col("head") < F.lag("tail").over(across)).cast("long"))
    return seams.groupBy("file").agg((F.sum("n") + F.sum(F.coalesce("_seam", F.lit(0)))).alias("key_inversions"))


def nearest_prefix_parent(codes: DataFrame) -> DataFrame:
    """(code, imdrf) -> (code, parent): longest strictly shorter mapped prefix.

    Prefixes are exploded and looked up by equality, so no prefix scan is needed.
    """
    known = codes.select(F.col("imdrf").alias("prefix")).distinct()
    spread = codes.filter(F.length("imdrf") > 1).select(
        "code",
        F.explode(
            F.expr("transform(sequence(1, length(imdrf) - 1), n -> substring(imdrf, 1, n))")
        ).alias("prefix"),
    )
    return spread.join(known, "prefix").groupBy("code").agg(
        F.concat(F.lit("IMDRF:"), F.max_by("prefix", F.length("prefix"))).alias("parent")
    )


def code_map(rows: DataFrame) -> DataFrame:
    """(fda_code, imdrf_code, row_no) -> (code, imdrf): the last row of a code wins, blanks dropped."""
    kept = rows.filter((F.coalesce(F.trim("imdrf_code"), F.lit("")) != "") & (F.coalesce("fda_code", F.lit("")) != ""))
    return kept.groupBy(F.trim("fda_code").alias("code")).agg(
        F.max_by(F.trim("imdrf_code"), "row_no").alias("imdrf")
    )
