"""Preparing features for models: imputation, scaling, one-hot, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def imputed(frame: DataFrame, names: list[str], value: float = 0.0) -> DataFrame:
    """Nulls become ``value``, with <name>_missing (0 or 1) beside each column."""
    return frame.withColumns({f"{n}_missing": F.col(f"`{n}`").isNull().cast("int") for n in names} | {n: F.coalesce(F.col(f"`{n}`"), F.lit(value)) for n in names})


def scaled(frame: DataFrame, names: list[str]) -> DataFrame:
    """Columns with mean 0 and population deviation 1; a constant column becomes 0."""
    stats = frame.agg(*(f(F.col(f"`{n}`")).alias(f"{n}__{s}") for n in names for s, f in (("mean", F.avg), ("std", F.stddev_pop))))
    z = {n: (F.col(f"`{n}`") - F.col(f"`{n}__mean`")) / F.when(F.col(f"`{n}__std`") > 0, F.col(f"`{n}__std`")).otherwise(1.0) for n in names}
    return frame.crossJoin(F.broadcast(stats)).withColumns(z).drop(*stats.columns)  # one row


def mode_filled(frame: DataFrame, names: list[str]) -> DataFrame:
    """Nulls become the column's most frequent value, the smallest on ties."""
    modes = frame.agg(*(F.mode(n, True).alias(f"{n}__mode") for n in names))
    return frame.crossJoin(F.broadcast(modes)).withColumns({n: F.coalesce(n, f"{n}__mode") for n in names}).drop(*modes.columns)  # one row


def one_hot(frame: DataFrame, column: str, levels: list) -> DataFrame:
    """<column>_<level> per known level; an unknown or null value has zeros throughout."""
    return frame.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in levels})


def levels(frame: DataFrame, column: str, most: int = 10_000) -> list:
    """Sorted distinct values, for columns of few values; refuses more than ``most``."""
    found = [r[0] for r in frame.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return found
