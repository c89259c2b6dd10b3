"""Model search over year-forward folds, out-of-fold scores, and permutation importance.

The rows of all folds are derived and written once, whatever the number of candidates. Where a fold's
rows are few (``HELD_BYTES``, measured), all fits of all candidates and folds are groups of one job;
beyond that each fit sums over the written rows, and a bounded number of fits run at a time."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.learners import catalogue
from furrow.learners.blocks import Block, Held, Spread
from furrow.learners.catalogue import BY_REGRESSION, CLASSIFIERS, REGRESSORS, Candidate, candidates
from furrow.operators.classes import class_metrics, target_means, to_class
from furrow.operators.columns import kept_by_threshold, missing_profile, task_mask, varying
from furrow.operators.design import INTERACTIONS, STATISTICS, TE, Layout, derived, derived_names, layout
from furrow.operators.folds import folded, year_folds
from furrow.operators.metrics import regression_metrics
from furrow.operators.numbering import row_numbers
from furrow.session import scratch, stored
from furrow.sources.files import tolerant_json, write_json

__all__ = ["Candidate", "INTERACTIONS", "STATISTICS", "TE", "derived_names"]

#: Missing shares up to which features are kept, by name; in full mode more are compared.
MISSING = {"core": 0.35, "mid": 0.60, "full": 0.85}
MISSING_FULL = (0.25, 0.35, 0.50, 0.60, 0.70, 0.85)
#: Bytes of one fold's rows up to which a fit may hold them in one group.
HELD_BYTES = 32_000_000
#: Fits over larger folds that run at a time.
AT_ONCE = 4


def signature(frame: DataFrame, columns: list[str]) -> str:
    """A hash of the rows, whatever their order: it keys cached models. Rows count by the MD5 digest of
    their values as text, a null as a letter that no quoted value is."""
    values = F.concat_ws(",", *(F.coalesce(F.concat(F.lit("'"), F.col(f"`{c}`").cast("string"), F.lit("'")), F.lit("N")) for c in columns))
    digest = F.md5(values)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10)  # noqa: E731  sixty bits
    rows = frame.select(part(1).cast("decimal(38,0)").alias("h"), part(16).cast("long").alias("x"))
    got = rows.agg(F.md5(F.concat_ws(":", F.coalesce(F.sum("h"), F.lit(0)), F.coalesce(F.bit_xor("x"), F.lit(0)), F.count("*"), F.lit(",".join(columns)))).alias("s"))
    return got.first().s


@dataclass
class Fitted:
    """A fitted model: it derives its further columns itself, from lags and its training rows' target means."""

    kind: str
    task: str
    layout: Layout
    arrays: dict[str, np.ndarray]
    means: dict[str, DataFrame] | None

    @property
    def numeric(self) -> list[str]:
        return list(self.layout.numeric)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with yield_pred or pred_class; their own columns stay."""
        name = "yield_pred" if self.task == "regression" else "pred_class"
        done = derived(rows, self.means).withColumn(name, predicted(rows.sparkSession, self.task, self.kind, self.layout, self.arrays))
        return done.select(*(F.col(f"`{c}`") for c in rows.columns if c != name), name)

    def save(self, path: str, signature: str = "") -> None:
        """Model and means beside each other; what is read from the path before is not touched."""
        spark = SparkSession.active()
        version = hashlib.md5(f"{signature}{self.kind}".encode() + catalogue.packed(self.arrays)).hexdigest()
        for name, table in (self.means or {}).items():
            table.coalesce(1).write.mode("ignore").parquet(f"{path}/{version}/means/{name}")
        spark.createDataFrame([(bytearray(catalogue.packed(self.arrays)),)], "model binary").coalesce(1).write.mode("ignore").parquet(f"{path}/{version}/model")
        meta = {"version": version, "kind": self.kind, "task": self.task, "layout": self.layout.to_dict(), "means": sorted(self.means or {}), "signature": signature}
        write_json(spark, meta, f"{path}/meta")


def load(path: str, signature: str) -> Fitted | None:
    """A saved model, if there is one and it is of rows of this signature."""
    spark = SparkSession.active()
    meta = tolerant_json(spark, f"{path}/meta")
    if not meta or meta["signature"] != signature:
        return None
    at = f"{path}/{meta['version']}"
    means = {n: spark.read.parquet(f"{at}/means/{n}") for n in meta["means"]} or None
    return Fitted(meta["kind"], meta["task"], Layout.of(meta["layout"]), catalogue.unpacked(bytes(spark.read.parquet(f"{at}/model").first().model)), means)


def predicted(spark: SparkSession, task: str, kind: str, own: Layout, arrays: dict[str, np.ndarray]) -> Column:
    """The prediction for rows that have the layout's columns; the model is broadcast."""
    given = spark.sparkContext.broadcast(arrays)

    def values(x: pd.Series) -> pd.Series:
        return pd.Series(catalogue.predict(task, kind, given.value, np.stack(x.to_list())).astype(float)) if len(x) else pd.Series([], dtype=float)

    done = F.pandas_udf(values, "double")(own.array())
    return done if task == "regression" else done.cast("int")


def designed(rows: DataFrame, numeric: list[str]) -> tuple[DataFrame, Layout]:
    """``rows`` with x (the array of ``numeric`` and categories), y_class, w and u, and the layout."""
    own = layout(rows, numeric)
    u = F.xxhash64(*(F.col(c) for c in ("region", "crop", "year", "yield"))).bitwiseAND((1 << 62) - 1)
    return rows.withColumns({"x": own.array(), "w": F.lit(1.0), "u": u}), own


def _target(task: str) -> str:
    return "yield" if task == "regression" else "yield_class"


def _block(rows: pd.DataFrame, task: str) -> Block:
    return Block(np.stack(rows["x"].to_list()), rows[_target(task)].to_numpy(dtype=float), rows["w"].to_numpy(dtype=float), rows["u"].to_numpy(dtype=np.int64))


def is_small(rows: int, width: int) -> bool:
    return 8 * rows * width <= HELD_BYTES


def fit(train: DataFrame, kind: str, task: str, features: list[str], params: dict | None = None, use_te: bool = True, smoothing: float = 10.0, power: float = 1.0, seed: int = 42) -> Fitted:
    """A model of ``kind`` on the features and what is derived from them and from ``train`` alone."""
    with scratch(train.sparkSession):
        train = stored(train.where(F.col(_target(task)).isNotNull()), "train")
        means = target_means(train, smoothing, written=lambda t: stored(t.coalesce(1), "means", keep=True)) if use_te else None
        own, arrays = fit_columns(derived(train, means), kind, task, [*features, *derived_names(use_te)], params, power, seed)
    return Fitted(kind, task, own, arrays, means)


def fit_columns(rows: DataFrame, kind: str, task: str, names: list[str], params: dict | None = None, power: float = 1.0, seed: int = 42) -> tuple[Layout, dict[str, np.ndarray]]:
    """(layout, arrays) of a model of ``kind`` on these columns, the region and the crop."""
    target, params = _target(task), dict(params or {})
    with scratch(rows.sparkSession):
        rows, own = designed(rows.where(F.col(target).isNotNull()), names)
        table = stored(rows.select("x", F.col(target).cast("double").alias("y"), "w", "u", F.lit(0).alias("unit")), "design")
        if is_small(table.count(), own.width):
            job = {"task": task, "kind": kind, "params": params, "numeric": own.scaled, "seed": seed, "power": power}

            def one(rows: pd.DataFrame) -> pd.DataFrame:
                block = Block(np.stack(rows["x"].to_list()), *(rows[c].to_numpy() for c in ("y", "w", "u")))
                return pd.DataFrame({"model": [catalogue.packed(catalogue.fit(Held(block), **job))]})

            arrays = catalogue.unpacked(bytes(table.groupBy("unit").applyInPandas(one, "model binary").first().model))
        else:
            arrays = catalogue.fit(Spread(table.drop("unit")), task, kind, params, own.scaled, seed, power)
    return own, arrays


def fold_design(rows: DataFrame, folds: DataFrame, features: list[str], use_te: bool = True, smoothing: float = 10.0) -> tuple[DataFrame, Layout]:
    """The rows of all folds, derived from each fold's own training rows in one plan, written once:
    fold, is_train, region, crop, year, yield, yield_class, x, w, u."""
    every = folded(rows, folds)
    means = target_means(every.where("is_train"), smoothing, ["fold"], lambda t: stored(t.coalesce(1), "means")) if use_te else None
    table, own = designed(derived(every, means, ["fold"]), [*features, *derived_names(use_te)])
    classed = F.col("yield_class").cast("int") if "yield_class" in table.columns else F.lit(None).cast("int")
    return stored(table.select("fold", "is_train", "region", "crop", "year", "yield", classed.alias("yield_class"), "x", "w", "u"), "folds"), own


PREDICTED = "position int, fold int, region string, crop string, year int, yield double, yield_class int, predicted double, error string"


def out_of_fold(design: DataFrame, own: Layout, tried: list[tuple[Candidate, str]], seed: int = 42, power: float = 1.0) -> DataFrame:
    """Predictions of every fold's test rows by each candidate, fitted to the fold's training rows: columns of
    ``PREDICTED``; ``position`` counts in ``tried``, whose members are (candidate, task). A fit that fails gives a row with its error."""
    spark = design.sparkSession
    sizes = {r.fold: r.n for r in design.where("is_train").groupBy("fold").agg(F.count("*").alias("n")).collect()}  # a row a fold
    jobs = [{"task": task, "kind": c.kind, "params": dict(c.params), "numeric": own.scaled, "seed": seed, "power": power} for c, task in tried]
    if is_small(2 * max(sizes.values(), default=0), own.width):
        keyed = spark.createDataFrame([(i,) for i in range(len(jobs))], "position int")
        every = design.crossJoin(F.broadcast(keyed)).withColumn("unit", F.col("position") * 1000 + F.col("fold"))  # a row a candidate

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            job = jobs[int(rows["position"].iloc[0])]
            train, test = rows[rows["is_train"] & rows[_target(job["task"])].notna()], rows[~rows["is_train"]]
            out, error = test[["position", "fold", "region", "crop", "year", "yield", "yield_class"]].assign(predicted=np.nan, error=None), None
            try:
                arrays = catalogue.fit(Held(_block(train, job["task"])), **job)
                out["predicted"] = catalogue.predict(job["task"], job["kind"], arrays, np.stack(test["x"].to_list())).astype(float)
            except Exception as e:  # noqa: BLE001  a candidate that can't be fitted is a result too
                error = f"{type(e).__name__}: {e}"[:200]
            return out.assign(error=error)

        # a partition a fit: sizes say nothing of how long a fit takes
        return every.repartition(max(1, len(jobs) * len(sizes)), "unit").groupBy("unit").applyInPandas(one, PREDICTED)

    def spread(at: tuple[int, int]) -> DataFrame:
        position, fold = at
        job = jobs[position]
        rows = design.where(F.col("fold") == fold)
        target = F.col(_target(job["task"]))
        model = catalogue.fit(Spread(rows.where(F.col("is_train") & target.isNotNull()).select("x", target.cast("double").alias("y"), "w", "u")), **job)
        given = spark.sparkContext.broadcast(model)
        values = F.pandas_udf(lambda x: pd.Series(catalogue.predict(job["task"], job["kind"], given.value, np.stack(x.to_list())).astype(float)), "double")
        test = rows.where("not is_train").withColumns({"position": F.lit(position), "predicted": values("x"), "error": F.lit(None).cast("string")})
        return stored(test.select(*(c.split()[0] for c in PREDICTED.split(", "))), "predicted", keep=True)

    def caught(at: tuple[int, int]) -> DataFrame:
        try:
            return spread(at)
        except Exception as e:  # noqa: BLE001
            return spark.createDataFrame([(at[0], at[1], *[None] * 6, f"{type(e).__name__}: {e}"[:200])], PREDICTED)

    with ThreadPoolExecutor(AT_ONCE) as pool:  # in the context of the caller, whose scratch owns the tables
        running = [pool.submit(copy_context().run, caught, (i, f)) for i in range(len(jobs)) for f in sorted(sizes)]
    done = [r.result() for r in running]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fold_scores(predicted: DataFrame, task: str) -> DataFrame:
    """position, fold, score: R2 or macro-F1 (the higher the better)."""
    by = ["position", "fold"]
    if task == "regression":
        return regression_metrics(predicted, by, "yield", "yield_pred").select(*by, F.col("r2").alias("score"))
    return class_metrics(predicted, by=by).select(*by, F.col("f1_macro").alias("score"))


def scored(design: DataFrame, own: Layout, tried: list[tuple[Candidate, str]], task: str, tertiles: str = "fixed", seed: int = 42, power: float = 1.0) -> DataFrame:
    """The predictions of ``tried`` as yield_pred (regressions) or pred_class; where a regressor stands in a
    classification its predictions become classes by the tertiles of all rows, or with "refit" of
    each fold's training rows. Written once."""
    done = stored(out_of_fold(design, own, tried, seed, power), "predicted", keep=True)
    if task == "regression":
        return done.withColumnRenamed("predicted", "yield_pred")
    by_value = [i for i, (_, t) in enumerate(tried) if t == "regression"]
    direct = done.where(~F.col("position").isin(by_value)).withColumn("pred_class", F.col("predicted").cast("int"))
    valued = done.where(F.col("position").isin(by_value)).withColumnRenamed("predicted", "yield_pred")
    last = design.where(F.col("fold") == design.agg(F.max("fold")).first()[0])  # all rows up to the last year
    classed = to_class(valued, design.where("is_train"), by=["fold"]) if tertiles == "refit" else to_class(valued, last)
    return direct.drop("predicted").unionByName(classed.drop("yield_pred"))


def best_threshold(rows: DataFrame, folds: DataFrame, features: list[str], task: str, use_te: bool = True, smoothing: float = 10.0, tertiles: str = "fixed", feature_set: str = "auto", mode: str = "fast", seed: int = 42) -> tuple[float, list[str], list[dict]]:
    """(missing share, the features kept by it, what was compared): the share whose features score best with
    boosting of default settings, the first on ties; or the one that ``feature_set`` names."""
    profile = stored(missing_profile(rows, features, exact=False).coalesce(1), "profile")
    some = {r.feature for r in varying(profile).collect()}  # column names
    kept = {s: sorted(r.feature for r in kept_by_threshold(profile, s).collect() if r.feature in some) for s in {*MISSING.values(), *MISSING_FULL}}
    if feature_set != "auto":
        return MISSING[feature_set], kept[MISSING[feature_set]], []
    default, found, known = Candidate("Boosting", ()), [], {}
    for share in MISSING_FULL if mode == "full" else MISSING.values():
        names = tuple(kept[share])
        if not names:
            continue
        if names not in known:  # equal sets have equal scores
            design, own = fold_design(rows, folds, list(names), use_te, smoothing)
            done = scored(design, own, [(default, "regression")], task, tertiles, seed)
            known[names] = fold_scores(done, task).agg(F.avg("score")).first()[0]
        found.append({"share": share, "score": known[names], "features": len(names)})
    usable = [f for f in found if f["score"] is not None]
    if not usable:
        raise ValueError("no feature is known often enough")
    best = max(usable, key=lambda f: f["score"])
    return best["share"], kept[best["share"]], found


def default_kinds(task: str, mode: str) -> list[str]:
    """The kinds that a mode tries at all."""
    at = catalogue.MODES.index(mode)
    return [k for k, v in (REGRESSORS if task == "regression" else CLASSIFIERS).items() if v.tries[at] and k != "Ridge"]


def search(panel: DataFrame, features: list[str], task: str = "regression", kinds: list[str] | None = None, mode: str = "fast", n_splits: int = 4, seed: int = 42, use_te: bool = True, smoothing: float = 10.0, tertiles: str = "fixed", feature_set: str = "auto", min_train: int = 8, min_test: int = 4, power: float = 1.0, most: int | None = None, by_regression: list[str] | None = None) -> tuple[Fitted, dict, DataFrame]:
    """(model refitted on all rows, info, scores by candidate and fold).

    ``kinds``: learners of the catalogue, those of the mode by default; ``most`` candidates of each. Candidates
    that fail are recorded and skipped; if all fail that is an error. A classifier is searched directly and by
    way of the tertile classes of regressors (``by_regression``). The year is a feature too."""
    spark = panel.sparkSession
    with scratch(spark):
        rows = stored(panel.where(task_mask(features, task)), "rows")
        folds = stored(year_folds(rows, n_splits, min_train, min_test).coalesce(1), "folds")
        share, names, compared = best_threshold(rows, folds, [*dict.fromkeys([*features, "year"])], task, use_te, smoothing, tertiles, feature_set, mode, seed)
        own_kinds = REGRESSORS if task == "regression" else CLASSIFIERS
        tried = [(c, task) for c in candidates(own_kinds, kinds or default_kinds(task, mode), mode, seed, most)]
        if task != "regression":
            routes = [k for k in BY_REGRESSION if REGRESSORS[k].tries[catalogue.MODES.index(mode)]] if by_regression is None else by_regression
            tried += [(c, "regression") for c in candidates(REGRESSORS, routes, mode, seed, most)]
        design, own = fold_design(rows, folds, names, use_te, smoothing)
        done = scored(design, own, tried, task, tertiles, seed, power)
        label = [("" if t == task else "Reg2Tertile ") + str(c) for c, t in tried]
        shown = spark.createDataFrame([(i, n) for i, n in enumerate(label)], "position int, candidate string")  # a row a candidate
        table = stored(fold_scores(done, task).join(shown, "position").coalesce(1), "scores", keep=True)
        means = {r.position: r.score for r in table.groupBy("position").agg(F.avg("score").alias("score")).collect()}
        errors = {r.position: r.error for r in done.where("error is not null").groupBy("position").agg(F.first("error").alias("error")).collect()}
        usable = [i for i in range(len(tried)) if means.get(i) is not None and i not in errors]
        if not usable:
            raise ValueError(f"no candidate could be fitted: {errors}")
        best = max(usable, key=lambda i: means[i])  # the first on ties
        mine = done.where(F.col("position") == best)
        oof = (regression_metrics(mine, [], "yield", "yield_pred") if task == "regression" else class_metrics(mine)).first().asDict()
    candidate, route = tried[best]
    model = fit(panel.where(task_mask(features, task)), candidate.kind, route, names, dict(candidate.params), use_te, smoothing, power, seed)
    known = panel.where(task_mask(features, task))
    fitted = model.predict(known)
    if task == "regression":
        train = regression_metrics(fitted, [], "yield", "yield_pred").select("rmse", "r2").first().asDict()
    else:
        train = class_metrics(to_class(fitted, known) if route != task else fitted).select("f1_macro", "accuracy").first().asDict()
    outcome = [{"candidate": n} | ({"error": errors[i]} if i in errors else {"score": means.get(i)}) for i, n in enumerate(label)]
    info = {"task": task, "best": str(candidate), "kind": candidate.kind, "params": dict(candidate.params), "via_regression": route != task, "missing_share": share, "compared": compared, "features": names, "derived": derived_names(use_te), "cv": means[best], "oof": oof, "train": train, "tried": outcome, "signature": signature(known, [*dict.fromkeys([*names, "region", "crop", "year", "yield"])])}
    return model, info, table


def step_of(n: int, seed: int) -> tuple[int, int]:
    """(a, b) of the permutation i -> (a * i + b) mod n, from the seed's MD5 digest: a is the first
    number from the digest's on, over a quarter of n if it can be, that has no divisor in common with n."""
    digest = hashlib.md5(str(seed).encode()).hexdigest()
    a = n // 4 + 1 + int(digest[:8], 16) % max(n - n // 4 - 1, 1)
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a, int(digest[8:16], 16) % n


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, written once, with ``_n``: numbers from 0 in the order of their keys' digests, which is no order of the values."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("region", "crop", "year"))))
    own = stored(rows.withColumns({"_key": digest, "_row": F.monotonically_increasing_id()}), "rows")
    return row_numbers(own, ["_key", "_row"], "numbered", "_n").drop("_key", "_row")


def shuffled(rows: DataFrame, column: str, steps: list[tuple[int, int]], n: int) -> DataFrame:
    """A copy of ``rows`` (``numbered``, ``n`` of them) for each of ``steps`` with ``repeat``, its
    number, in which the values of one column are permuted."""
    copies = F.inline(F.array(*(F.struct(F.lit(r).alias("repeat"), ((F.lit(a).cast("decimal(20,0)") * F.col("_n") + b) % n).cast("long").alias("_from")) for r, (a, b) in enumerate(steps))))
    values = rows.select(F.col("_n").alias("_from"), F.col(f"`{column}`").alias("_value"))
    every = rows.select("*", copies).join(values, "_from")
    return every.withColumn(column, F.col("_value")).drop("_from", "_value", "_n")


def permutation_importance(rows: DataFrame, features: list[str], predict: Callable[[DataFrame], DataFrame], task: str = "regression", repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance_mean, importance_std (population) of the score lost, largest first.

    Rows are written and numbered once; all repeats of a feature are one plan."""
    spark, lost = rows.sparkSession, []

    def scores(r: DataFrame, by: list[str]) -> list[float]:
        done = predict(r)
        if task == "regression":
            return [x["r2"] for x in regression_metrics(done, by, "yield", "yield_pred").collect()]
        return [x["f1_macro"] for x in class_metrics(done, by=by).collect()] if by else [class_metrics(done).first()["f1_macro"]]

    with scratch(spark):
        every = numbered(rows)
        n = every.count()
        (whole,) = scores(rows, [])
        for i, f in enumerate(features):
            steps = [step_of(n, seed + 1000 * i + r) for r in range(repeats)]
            lost += [(f, float(whole - s)) for s in scores(shuffled(every, f, steps, n), ["repeat"])]  # a row a repeat
    table = spark.createDataFrame(lost, "feature string, lost double")  # a row a feature and repeat
    return table.groupBy("feature").agg(F.avg("lost").alias("importance_mean"), F.stddev_pop("lost").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")


def cached_search(path: str, panel: DataFrame, features: list[str], task: str = "regression", force: bool = False, **options) -> tuple[Fitted, dict]:
    """``search``, or the model and info saved under ``path`` if they are of the same rows and options."""
    spark = panel.sparkSession
    key = signature(panel, [*features, "region", "crop", "year", "yield"]) + json.dumps([task, options], sort_keys=True, default=str)
    info = tolerant_json(spark, f"{path}/info")
    if not force and info and (model := load(path, key)) is not None:
        return model, info
    model, info, _ = search(panel, features, task, **options)
    model.save(path, key)
    write_json(spark, info, f"{path}/info")
    return model, info


feature_importance = permutation_importance  # its older name
