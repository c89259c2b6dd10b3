"""The panel's feature and model steps as ``pyspark.ml`` stages, for pipelines that are fitted, saved and loaded."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.learners import catalogue
from furrow.operators.classes import add_target_means, predictor_thresholds, target_means, to_class_by
from furrow.operators.design import Layout
from furrow.operators.lags import add_interactions, add_lag_statistics
from furrow.operators.search import fit_columns, predicted
from furrow.session import stored


class LagStatistics(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Statistics over the lag columns that are there."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_lag_statistics(dataset)


class LagInteractions(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The last lag against the target means."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_interactions(dataset)


class Saved(Model, MLWritable, MLReadable):
    """A model whose state is named tables beside its params; subclasses say what the tables are."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = tables or {}

    def write(self) -> MLWriter:
        return SavedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return SavedReader(cls)


class SavedWriter(MLWriter):
    def __init__(self, instance: Saved):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata={"tables": sorted(self.instance.tables)})
        for name, table in self.instance.tables.items():
            table.write.parquet(f"{path}/tables/{name}")


class SavedReader(MLReader):
    def __init__(self, cls: type[Saved]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Saved:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls({n: self.sparkSession.read.parquet(f"{path}/tables/{n}") for n in metadata["tables"]})
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _Smoothing(Params):
    smoothing = Param(Params._dummy(), "smoothing", "rows by which a group's mean is drawn to the global one", TypeConverters.toFloat)


class TargetMeans(Estimator, _Smoothing, DefaultParamsReadable, DefaultParamsWritable):
    """Smoothed mean yields of the training rows by crop, region and both."""

    @keyword_only
    def __init__(self, *, smoothing: float = 10.0):
        super().__init__()
        self._setDefault(smoothing=10.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TargetMeansModel:
        keep = lambda t: stored(t.coalesce(1), "means", keep=True)
        return TargetMeansModel(target_means(dataset, self.getOrDefault(self.smoothing), written=keep))


class TargetMeansModel(Saved):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_target_means(dataset, self.tables)


class _Learner(Params):
    kind = Param(Params._dummy(), "kind", "a learner of the catalogue", TypeConverters.toString)
    task = Param(Params._dummy(), "task", "regression or classification", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "numeric columns", TypeConverters.toListString)
    settings = Param(Params._dummy(), "settings", "the learner's settings, as JSON", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)


class PanelLearner(Estimator, _Learner, DefaultParamsReadable, DefaultParamsWritable):
    """A learner on the given columns, the region and the crop: adds yield_pred or pred_class."""

    @keyword_only
    def __init__(self, *, kind: str = "Boosting", task: str = "regression", features: list[str] = [], settings: str = "{}", seed: int = 42):
        super().__init__()
        self._setDefault(kind="Boosting", task="regression", features=[], settings="{}", seed=42)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PanelLearnerModel:
        of = self.getOrDefault
        own, arrays = fit_columns(dataset, of(self.kind), of(self.task), of(self.features), json.loads(of(self.settings)), seed=of(self.seed))
        row = (bytearray(catalogue.packed(arrays)), json.dumps(own.to_dict()))
        model = PanelLearnerModel({"model": dataset.sparkSession.createDataFrame([row], "arrays binary, layout string").coalesce(1)})
        return self._copyValues(model)


class PanelLearnerModel(Saved, _Learner):
    def __init__(self, tables: dict[str, DataFrame] | None = None):
        super().__init__(tables)
        self._setDefault(kind="Boosting", task="regression", features=[], settings="{}", seed=42)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        (row,) = self.tables["model"].collect()
        task = self.getOrDefault(self.task)
        done = predicted(SparkSession.active(), task, self.getOrDefault(self.kind), Layout.of(json.loads(row.layout)), catalogue.unpacked(bytes(row.arrays)))
        return dataset.withColumn("yield_pred" if task == "regression" else "pred_class", done)


class TertileClasses(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Classes of yield_pred by the tertiles of the training rows' yields, by crop and over all."""

    def _fit(self, dataset: DataFrame) -> TertileClassesModel:
        crops, whole = predictor_thresholds(dataset.where(F.col("yield").isNotNull()))
        return TertileClassesModel({"crops": stored(crops.coalesce(1), "crops", keep=True), "whole": stored(whole.coalesce(1), "whole", keep=True)})


class TertileClassesModel(Saved):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return to_class_by(dataset, self.tables["crops"], self.tables["whole"])
