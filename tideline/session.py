"""Session helpers shared by every plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 2_000_000


def build_session(app: str = "tideline", cores: str = "8", memory: str = "10g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def order_buckets(spark: SparkSession) -> int:
    """How many ordered slices a global running total is cut into."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` dealt by the keys to enough tasks that each gets about ROWS_PER_TASK of its ``rows``."""
    return df.repartition(max(order_buckets(df.sparkSession), -(-rows // ROWS_PER_TASK)), *keys)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a single-process session may do without; it gets a folder for its lifetime."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the table to the shared checkpoint folder (used between epochs).

    The written table survives executor loss, is computed once, and its known
    size lets the optimiser decide on broadcasts by itself.
    """
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
