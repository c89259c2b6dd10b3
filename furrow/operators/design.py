"""From panel rows to the numbers that learners take: derived columns, and one array a row."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.classes import add_target_means
from furrow.operators.lags import add_interactions, add_lag_statistics

#: Columns derived from lags.
STATISTICS = [
    "yield_lag_last",
    "yield_lag_count_nonnull",
    "yield_lag_mean_2",
    "yield_lag_mean_3",
    "yield_lag_std_3",
    "yield_lag_min_3",
    "yield_lag_max_3",
    "yield_lag_slope_3",
    "yield_lag_mean_5",
    "yield_lag_std_5",
    "yield_lag_min_5",
    "yield_lag_max_5",
    "yield_lag_slope_5",
    "yield_lag_momentum_1",
    "yield_lag_momentum_2",
    "yield_lag_momentum_4",
    "yield_lag_ratio_last_mean3",
]
#: Target means.
TE = ["te_crop", "te_region", "te_region_crop"]
#: The last lag against target means.
INTERACTIONS = [
    "lag_last_minus_te_crop",
    "lag_last_minus_te_region",
    "lag_last_minus_te_region_crop",
    "lag_last_div_te_crop",
    "lag_last_div_te_region_crop",
]


def derived_names(use_te: bool = True) -> list[str]:
    """Columns a model gets beside its features: lag statistics always, target means and interactions with ``use_te``."""
    return [*STATISTICS, *TE, *INTERACTIONS] if use_te else STATISTICS


def derived(rows: DataFrame, means: dict[str, DataFrame] | None, by: list[str] = []) -> DataFrame:
    """``rows`` with what is derived from their lags and from ``means`` (of training rows alone)."""
    rows = add_lag_statistics(rows)
    return rows if means is None else add_interactions(add_target_means(rows, means, by))


@dataclass(frozen=True)
class Layout:
    """What stands where in a row's array: numbers, 1 for those of ``unknown`` that are null, and the categories."""

    numeric: tuple[str, ...]
    unknown: tuple[str, ...]
    categories: tuple[tuple[str, tuple], ...]

    @property
    def scaled(self) -> int:
        """The first columns, which learners may scale."""
        return len(self.numeric) + len(self.unknown)

    @property
    def width(self) -> int:
        return self.scaled + sum(len(v) for _, v in self.categories)

    def array(self) -> Column:
        known = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in self.numeric]
        nulls = [F.col(f"`{c}`").isNull().cast("double") for c in self.unknown]
        hot = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for c, values in self.categories for v in values]
        return F.array(*known, *nulls, *hot)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def of(cls, d: dict) -> Layout:
        return cls(tuple(d["numeric"]), tuple(d["unknown"]), tuple((c, tuple(v)) for c, v in d["categories"]))


def layout(rows: DataFrame, numeric: list[str], categories: tuple[str, ...] = ("region", "crop"), most: int = 10_000) -> Layout:
    """The layout for ``rows``: one aggregate tells which columns have nulls, one the values of the
    categories, of which each may have ``most``."""
    found = rows.agg(*(F.max(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(numeric))).first()
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in categories)))
    values = rows.select(pairs.alias("p")).select("p.*").where("value is not null").distinct().limit(most * len(categories) + 1).collect()
    levels = {c: sorted(r.value for r in values if r.name == c) for c in categories}
    if any(len(v) > most for v in levels.values()):
        raise ValueError(f"a category has more than {most} values")
    return Layout(tuple(numeric), tuple(c for i, c in enumerate(numeric) if found[f"n{i}"]), tuple((c, tuple(levels[c])) for c in categories))
