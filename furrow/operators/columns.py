"""Column selection: by name, by statistics, and row masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.scalars import canonical, number
from furrow.operators.lags import LAG_NAME

#: Parts of names of aerosol and weather columns; blanks count.
AEROSOL = ("aod", "ch4", "pm2.5", "ozone", "o3 ", " o3", "so2", "co ", "co_", "co sfc", "co day", "co night", "co avg", "co ppbv", "net downward shortwave", "net dw sw", "net sw land", "shortwave radiation", " radiation")
WEATHER, WEATHER_NAMES = ("temp", "skin", "precip", "mm/day"), ("day", "night", "avg")
NEVER = ("year", "yield", "sheet", "region", "crop", "yield_class")


def is_aerosol(name: str) -> bool:
    return any(part in name.lower() for part in AEROSOL)


def is_weather(name: str) -> bool:
    low = name.lower()
    return any(part in low for part in WEATHER) or low.strip() in WEATHER_NAMES


def feature_groups(names: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(aerosol, weather, sorted union); lags and unmatched columns are in none."""
    own = [n for n in names if n not in NEVER and not LAG_NAME.match(n)]
    aerosol, weather = [n for n in own if is_aerosol(n)], [n for n in own if is_weather(n)]
    return aerosol, weather, sorted({*aerosol, *weather})


def by_canonical_name(names: list[str]) -> dict[str, str]:
    """Canonical name -> the first column of that name."""
    out: dict[str, str] = {}
    for n in names:
        out.setdefault(canonical(n), n)
    return out


def resolved(names: list[str], wanted: list[str]) -> list[str]:
    """The distinct columns that the wanted names mean."""
    known = by_canonical_name(names)
    return list(dict.fromkeys(known[canonical(w)] for w in wanted if canonical(w) in known))


def project(frame: DataFrame, names: list[str], kind: str = "double") -> DataFrame:
    """Exactly these columns; one that is missing is null."""
    return frame.select(*(F.col(f"`{n}`") if n in frame.columns else F.lit(None).cast(kind).alias(n) for n in names))


def numeric(frame: DataFrame, names: list[str]) -> DataFrame:
    """These columns as doubles, null where they aren't numbers; other columns stay."""
    types = dict(frame.dtypes)
    cast = lambda n: number(F.col(f"`{n}`")) if types[n] == "string" else F.col(f"`{n}`").cast("double")
    return frame.withColumns({n: cast(n) for n in names if n in types})


def merged_duplicates(frame: DataFrame) -> DataFrame:
    """Columns of one canonical name become one: the first that isn't null, left to right."""
    inner = frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))
    places: dict[str, list[str]] = {}
    for i, n in enumerate(frame.columns):
        places.setdefault(canonical(n), []).append(f"c{i}")
    return inner.select(*(F.coalesce(*cols).alias(n) for n, cols in places.items()))


def missing_profile(frame: DataFrame, names: list[str], exact: bool = True) -> DataFrame:
    """feature, missing share, known values, distinct values (null as one), from one pass.

    Exact distinct counts take each row once a column; without ``exact`` 2 stands for two values or more,
    which minima and maxima tell, and no row is taken twice."""
    null = lambda c: F.max(c.isNull().cast("int"))
    some = lambda c: F.when(F.count(c) == 0, 0).when(F.min(c) < F.max(c), 2).otherwise(1)
    distinct = lambda c: (F.count_distinct(c) if exact else some(c)) + null(c)
    stats = [F.struct(
        F.avg(F.col(f"`{n}`").isNull().cast("double")).alias("missing"),
        F.count(F.col(f"`{n}`")).alias("known"),
        distinct(F.col(f"`{n}`")).alias("distinct"),
    ).alias(f"s{i}") for i, n in enumerate(names)]
    row = frame.agg(*stats)
    each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"s{i}").alias("s")) for i, n in enumerate(names)))
    return row.select(F.explode(each).alias("x")).select("x.feature", "x.s.*")


def kept_by_threshold(profile: DataFrame, most_missing: float) -> DataFrame:
    return profile.where(F.coalesce(F.col("missing"), F.lit(1.0)) <= most_missing).select("feature")


def varying(profile: DataFrame, always: tuple[str, ...] = ("year",)) -> DataFrame:
    """Features with a known value that aren't constant, null counting as a value."""
    return profile.where(((F.col("known") > 0) & (F.col("distinct") > 1)) | F.col("feature").isin(*always)).select("feature")


def with_any(names: list[str]) -> Column:
    return F.coalesce(*(F.col(f"`{n}`").cast("double") for n in names), F.lit(None).cast("double")).isNotNull() if names else F.lit(False)


def task_mask(features: list[str], task: str) -> Column:
    """Rows to learn from: keys and target present and some feature that isn't a lag."""
    keys = F.col("region").isNotNull() & F.col("crop").isNotNull() & F.col("year").isNotNull()
    target = F.col("yield").isNotNull()
    if task == "classification":
        target = target & F.col("yield_class").isNotNull()
    return keys & target & with_any([f for f in features if not LAG_NAME.match(f)])


def train_mask(features: list[str]) -> Column:
    """As the mask of a regression task, but lags count as features."""
    return F.col("region").isNotNull() & F.col("crop").isNotNull() & F.col("yield").isNotNull() & with_any(features)


def melted(frame: DataFrame, ids: list[str], values: list[str], series: str = "series", value: str = "value") -> DataFrame:
    return frame.unpivot(ids, values, series, value)
