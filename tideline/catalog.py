"""The query catalogue: names, plans and checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from tideline.functions.scalar import quarter_label
from tideline.plans.device import DeviceStudy
from tideline.sources.bindings import DeviceWindow

STUDIES = ("device", "prescriber", "facility", "trials", "analysis", "models")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for study in STUDIES:
        out.update(import_module(f"tideline.queries.{study}").QUERIES)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for study in STUDIES:
        out.update(import_module(f"tideline.oracles.{study}").ORACLES)
    known = queries()
    return {name: sql for name, sql in out.items() if name in known}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    """Support-sliced ranking metrics of the baselines over the quarters of 1995-1996."""
    quarters = list(range(1995 * 4 + 1, 1996 * 4 + 4))
    study = DeviceStudy.bound(spark, root, DeviceWindow())
    entities = study.product_metrics(study.baseline_ranks(quarters), quarters)
    metrics = study.threshold_metrics(entities, ["method", "q"])
    return metrics.withColumn("quarter", quarter_label(F.col("q"))).drop("q")
