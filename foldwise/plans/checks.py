"""Physical-plan inspection helpers (used by tests and when tuning)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as ``explain(mode)`` prints it."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def exchanges(df: DataFrame) -> list[str]:
    """Exchange nodes of the (pre-AQE) physical plan."""
    txt = plan_text(df, "simple")
    return re.findall(r"Exchange (\w+\(?[^\n]*)", txt)


def single_partition_exchanges(df: DataFrame) -> int:
    return sum(1 for e in exchanges(df) if e.startswith("SinglePartition"))


def python_row_udfs(df: DataFrame) -> int:
    """Row-at-a-time Python UDF evaluations (BatchEvalPython) in the plan."""
    return plan_text(df, "simple").count("BatchEvalPython")


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"(?:PushedFilters|PartitionFilters): \[([^\]]*)\]", plan_text(df, "formatted"))
