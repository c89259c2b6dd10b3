"""Files in and out: required and optional tables, tolerant JSON, text."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def required_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; an error if it isn't there."""
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is required; run the pipeline first") from e


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, empty if it isn't there."""
    try:
        return spark.read.csv(path, header=True, schema=schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _inferred(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.csv(path, header=True, inferSchema=True)
    except AnalysisException:
        return None


#: The tables behind the dashboard, those without which there is none first.
REQUIRED, OPTIONAL = ("panel", "metrics_summary"), ("forecast", "scenarios", "backtest", "permutation_importance")


def dashboard(spark: SparkSession, out: str) -> dict[str, DataFrame | None]:
    """The six tables of a finished run; an error if one of ``REQUIRED`` isn't there, None for another one."""
    tables = {name: _inferred(spark, f"{out}/{name}") for name in (*REQUIRED, *OPTIONAL)}
    for name in REQUIRED:
        if tables[name] is None:
            raise FileNotFoundError(f"{out}/{name} is required; run the pipeline first")
    return tables


def report_inputs(spark: SparkSession, out: str) -> dict[str, DataFrame | None]:
    """The tables that the report shows, None for each that isn't there."""
    return {name: _inferred(spark, f"{out}/{name}") for name in ("panel", "metrics_summary", "backtest_by_year", "timing_summary")}


def text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    try:
        return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    except AnalysisException:
        return ""


def tolerant_json(spark: SparkSession, path: str) -> dict:
    """A small JSON object; {} if it is missing or broken."""
    try:
        return json.loads(text(spark, path))
    except ValueError:
        return {}


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """Overwrite. ``single``: one file, for tables of a row a year, feature or group."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_text(spark: SparkSession, content: str, path: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, content: dict, path: str) -> None:
    write_text(spark, json.dumps(content, indent=1, default=str), path)
