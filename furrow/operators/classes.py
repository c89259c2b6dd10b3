"""Yield classes, target means, baselines and class metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.quantiles import exact_quantiles

THIRDS = [1 / 3, 2 / 3]


def thresholds(panel: DataFrame, group: list[str] = ["crop"], split: bool = False) -> DataFrame:
    """q1, q2 per crop for labels, exact; the median alone (q2 null) below 3 known yields.

    ``percentile`` keeps a crop's distinct yields in one task; with ``split`` no task does (``quantiles``)."""
    if split:
        got = exact_quantiles(panel, group, "yield", [*THIRDS, 0.5]).select(*group, "n", "q", F.get("q", 2).alias("m"))
    else:
        got = panel.groupBy(*group).agg(F.percentile("yield", THIRDS).alias("q"), F.median("yield").alias("m"), F.count("yield").alias("n"))
    few = F.col("n") < 3
    return got.select(*group, F.when(few, F.col("m")).otherwise(F.col("q")[0]).alias("q1"), F.when(~few, F.col("q")[1]).alias("q2"))


def add_classes(panel: DataFrame, split: bool = False) -> DataFrame:
    """yield_class: 0 below q1, 1 below q2, else 2; with few yields 0 below the median, else 1. ``split``: see ``thresholds``."""
    y = F.col("yield")
    label = F.when(y.isNull() | F.col("q1").isNull(), None).when(y < F.col("q1"), 0).when(F.col("q2").isNull() | (y < F.col("q2")), 1).otherwise(2)
    return panel.join(thresholds(panel, split=split), "crop", "left").withColumn("yield_class", label.cast("int")).drop("q1", "q2")


def predictor_thresholds(rows: DataFrame, target: str = "yield", least: int = 6, by: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """(crop, t1, t2 where a crop has ``least`` rows; one row o1, o2 over all), each for every value of ``by``."""
    q = F.percentile(target, THIRDS)
    crops = rows.groupBy(*by, "crop").agg(q.alias("q"), F.count(target).alias("n")).where(F.col("n") >= least)
    whole = rows.groupBy(*by).agg(q.alias("q"))
    return crops.select(*by, "crop", F.col("q")[0].alias("t1"), F.col("q")[1].alias("t2")), whole.select(*by, F.col("q")[0].alias("o1"), F.col("q")[1].alias("o2"))


def to_class(predicted: DataFrame, train: DataFrame, column: str = "yield_pred", by: list[str] = []) -> DataFrame:
    """pred_class by the thresholds of ``train``: 0 up to t1, 1 up to t2, else 2. With ``by`` (such as
    the fold) each of its values has thresholds of its own rows."""
    return to_class_by(predicted, *predictor_thresholds(train, by=by), column, by)


def to_class_by(predicted: DataFrame, crops: DataFrame, whole: DataFrame, column: str = "yield_pred", by: list[str] = []) -> DataFrame:
    """``to_class`` with the tables of ``predictor_thresholds``."""
    y, t1, t2 = F.col(column), F.coalesce("t1", "o1"), F.coalesce("t2", "o2")
    label = F.when(y.isNull() | t1.isNull(), None).when(y <= t1, 0).when(y <= t2, 1).otherwise(2)
    joined = predicted.join(crops, [*by, "crop"], "left")
    joined = joined.join(F.broadcast(whole), by, "left") if by else joined.crossJoin(F.broadcast(whole))  # one row, or one a fold
    return joined.withColumn("pred_class", label.cast("int")).drop("t1", "t2", "o1", "o2")


def probabilities(classed: DataFrame) -> DataFrame:
    return classed.withColumns({f"p{k}": (F.col("pred_class") == k).cast("double") for k in range(3)})


def target_means(train: DataFrame, smoothing: float = 10.0, by: list[str] = [], written: Callable[[DataFrame], DataFrame] = lambda table: table) -> dict[str, DataFrame]:
    """Smoothed mean yields by crop, region and both, and the global mean, from one pass; with ``by``
    (such as the fold) for each of its values. ``written``: takes the one table behind them all.

    (n mean + m global) / (n + m); a group that ``train`` lacks gets the global mean at the join."""
    sets = [[*by, "crop"], [*by, "region"], [*by, "region", "crop"], [*by]]
    found = train.groupingSets(sets, *by, "crop", "region").agg(
        F.grouping("crop").alias("gc"), F.grouping("region").alias("gr"), F.avg("yield").alias("mean"), F.count("yield").alias("n")
    )
    whole = found.where("gc = 1 and gr = 1").select(*by, F.col("mean").alias("te_global"))
    smooth = (F.coalesce(F.col("n") * F.col("mean"), F.lit(0.0)) + smoothing * F.col("te_global")) / (F.col("n") + smoothing)
    parts = found.join(F.broadcast(whole), by) if by else found.crossJoin(F.broadcast(whole))  # one row, or one a fold
    parts = written(parts.withColumn("te", smooth))
    return {
        "te_crop": parts.where("gc = 0 and gr = 1").select(*by, "crop", F.col("te").alias("te_crop")),
        "te_region": parts.where("gc = 1 and gr = 0").select(*by, "region", F.col("te").alias("te_region")),
        "te_region_crop": parts.where("gc = 0 and gr = 0").select(*by, "region", "crop", F.col("te").alias("te_region_crop")),
        "te_global": parts.where("gc = 1 and gr = 1").select(*by, "te_global"),
    }


def add_target_means(frame: DataFrame, means: dict[str, DataFrame], by: list[str] = []) -> DataFrame:
    keys = {"te_crop": ["crop"], "te_region": ["region"], "te_region_crop": ["region", "crop"]}
    whole = F.broadcast(means["te_global"])  # one row, or one a fold
    out = frame.join(whole, by, "left") if by else frame.crossJoin(whole)
    for name, key in keys.items():
        out = out.join(means[name], [*by, *key], "left").withColumn(name, F.coalesce(name, "te_global"))
    return out.drop("te_global")


def baselines(panel: DataFrame) -> DataFrame:
    """One row: macro-F1 of the most frequent class (the smallest on ties), RMSE and R2 of the mean."""
    counts = panel.where("yield_class is not null").groupBy("yield_class").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("labels"))
    f1 = total.select((2 * F.col("top") / (F.col("total") + F.col("top")) / F.col("labels")).alias("baseline_clf_macro_f1"))
    reg = panel.agg(F.stddev_pop("yield").alias("baseline_reg_rmse"), F.when(F.count("yield") > 0, F.lit(0.0)).alias("baseline_reg_r2"))
    return f1.crossJoin(F.broadcast(reg))  # one row each


def confusion(rows: DataFrame, truth: str = "yield_class", pred: str = "pred_class", by: list[str] = []) -> DataFrame:
    return rows.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame, truth: str = "yield_class", pred: str = "pred_class", by: list[str] = []) -> DataFrame:
    """f1_macro, precision_macro, recall_macro, accuracy, n; labels are those of truth or
    prediction, and 0/0 counts as 0. Counts by label pair are all that is kept of the rows."""
    c = confusion(rows, truth, pred, by)
    sides = c.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("pred")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("pred")),
    )).alias("x")).select(*by, "x.*")
    labels = sides.groupBy(*by, "label").agg(*(F.sum(s).alias(s) for s in ("tp", "truth", "pred")))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, t, p = F.col("tp"), F.col("truth"), F.col("pred")
    return labels.groupBy(*by).agg(
        F.avg(zero(2 * tp, t + p)).alias("f1_macro"),
        F.avg(zero(tp, p)).alias("precision_macro"),
        F.avg(zero(tp, t)).alias("recall_macro"),
        F.try_divide(F.sum(tp), F.sum(t)).alias("accuracy"),
        F.sum(t).alias("n"),
    )


def class_weights(rows: DataFrame, label: str = "yield_class", power: float = 1.0) -> DataFrame:
    """label, weight = (n / (k n_label)) ** power, from the label counts alone."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, F.pow(F.col("total") / (F.col("k") * F.col("n")), F.lit(power)).alias("weight"))  # one row


def mode(rows: DataFrame, column: str) -> Column:
    """The most frequent value, the smallest on ties: an aggregate."""
    return F.mode(column, True)


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
