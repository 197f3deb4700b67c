"""``pyspark.ml`` Estimator/Model wrappers around the training loop, so the
trainer sits in a ``Pipeline`` next to ``VectorAssembler`` and is saved,
loaded and applied with the standard ML persistence API."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.training import WINDOW_WORK, TrainConfig, evaluate, predict_column, standardize_input, train


class _TrainerParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasSeed):
    modelConfig = Param(Params._dummy(), "modelConfig", "JSON model spec (kind: linear|mlp|cnn)",
                        typeConverter=TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "stable row key used by seeded split/shard/batch",
                  typeConverter=TypeConverters.toString)


class MinibatchTrainer(Estimator, _TrainerParams, MLReadable, MLWritable):
    """Distributed synchronous minibatch training (SGD/Adam) of a numpy
    model; ``partitions``/``miniBatch``/``iters`` mirror the knobs of the
    original benchmark scripts."""

    iters = Param(Params._dummy(), "iters", "training steps", typeConverter=TypeConverters.toInt)
    minEpochs = Param(Params._dummy(), "minEpochs", "passes over the largest shard that every round makes at least",
                      typeConverter=TypeConverters.toInt)
    miniBatch = Param(Params._dummy(), "miniBatch", "rows per shard per step", typeConverter=TypeConverters.toInt)
    partitions = Param(Params._dummy(), "partitions", "number of data shards", typeConverter=TypeConverters.toInt)
    lr = Param(Params._dummy(), "lr", "learning rate", typeConverter=TypeConverters.toFloat)
    optimizer = Param(Params._dummy(), "optimizer", "sgd|adam", typeConverter=TypeConverters.toString)
    validationPct = Param(Params._dummy(), "validationPct", "held-out share", typeConverter=TypeConverters.toFloat)
    shardBy = Param(Params._dummy(), "shardBy", "hash|balanced|label", typeConverter=TypeConverters.toString)
    partitionShuffles = Param(Params._dummy(), "partitionShuffles", "re-deal rounds",
                              typeConverter=TypeConverters.toInt)
    fullBatch = Param(Params._dummy(), "fullBatch", "use all rows each step", typeConverter=TypeConverters.toBoolean)
    storage = Param(Params._dummy(), "storage", "table|cache", typeConverter=TypeConverters.toString)
    localSteps = Param(Params._dummy(), "localSteps", "minibatches per shard per job (local SGD); 1 = synchronous",
                       typeConverter=TypeConverters.toInt)

    dropLast = Param(Params._dummy(), "dropLast", "leave the incomplete last batch of a shard out of an epoch",
                     typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, modelConfig=None, featuresCol="features", labelCol="label",
                 predictionCol="prediction", idCol="id", iters=10, miniBatch=64, partitions=4, lr=0.001,
                 optimizer="sgd", validationPct=0.0, shardBy="hash", partitionShuffles=1,
                 fullBatch=False, storage="table", localSteps=1, dropLast=False, minEpochs=0, seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", idCol="id",
                         iters=10, miniBatch=64, partitions=4, lr=0.001, optimizer="sgd", validationPct=0.0,
                         shardBy="hash", partitionShuffles=1, fullBatch=False, storage="table", localSteps=1,
                         dropLast=False, minEpochs=0, seed=42)
        self._set(**self._input_kwargs)

    def config(self) -> TrainConfig:
        g = self.getOrDefault
        return TrainConfig(window_work=WINDOW_WORK, iters=g(self.iters), batch_size=g(self.miniBatch), partitions=g(self.partitions),
                           lr=g(self.lr), optimizer=g(self.optimizer), validation_pct=g(self.validationPct),
                           seed=g(self.seed), shard_by=g(self.shardBy),
                           partition_shuffles=g(self.partitionShuffles), full_batch=g(self.fullBatch),
                           storage=g(self.storage), local_steps=g(self.localSteps),
                           drop_last=g(self.dropLast), min_epochs=g(self.minEpochs))

    def _fit(self, dataset: DataFrame) -> "MinibatchModel":
        id_col = self.getOrDefault(self.idCol)
        if id_col not in dataset.columns:
            raise ValueError(f"input needs a stable row key column {id_col!r}")
        res = train(dataset, json.loads(self.getOrDefault(self.modelConfig)), self.config(), id_col=id_col,
                    label_col=self.getLabelCol(), features_col=self.getFeaturesCol())
        model = MinibatchModel(modelConfig=self.getOrDefault(self.modelConfig),
                               featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                               predictionCol=self.getPredictionCol(), idCol=id_col, seed=self.getSeed())
        model.weights = res.params
        model.result = res
        return model

    def write(self) -> MLWriter:
        return _ParamsOnlyWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class MinibatchModel(Model, _TrainerParams, MLReadable, MLWritable):
    @keyword_only
    def __init__(self, *, modelConfig=None, featuresCol="features", labelCol="label",
                 predictionCol="prediction", idCol="id", seed=42):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction", idCol="id", seed=42)
        self._set(**self._input_kwargs)
        self.weights: np.ndarray | None = None
        self.result = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.linalg import VectorUDT

        spark = dataset.sparkSession
        fcol = self.getFeaturesCol()
        feats = F.col(fcol)
        if isinstance(dataset.schema[fcol].dataType, VectorUDT):
            feats = vector_to_array(feats, "float64")
        staged = dataset.withColumn("__kiln_features", feats.cast("array<double>"))
        app = spark.sparkContext.applicationId
        if getattr(self, "_scorer", None) is None or self._scorer[0] != app:
            # one weights broadcast per model and application, reused by every transform
            pred_fn, _ = predict_column(spark, json.loads(self.getOrDefault(self.modelConfig)), self.weights,
                                        "__kiln_features")
            self._scorer = (app, pred_fn)
        return staged.withColumn(self.getPredictionCol(), self._scorer[1]).drop("__kiln_features")

    def evaluate(self, dataset: DataFrame) -> dict:
        df = standardize_input(dataset, self.getOrDefault(self.idCol), self.getLabelCol(), self.getFeaturesCol())
        return evaluate(df, json.loads(self.getOrDefault(self.modelConfig)), self.weights)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ParamsOnlyWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)


class _ModelWriter(_ParamsOnlyWriter):
    """Params as ML metadata JSON; weights as a one-row parquet file (its
    size is the model's parameter count)."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        w = np.asarray(self.instance.weights, dtype=np.float64)
        # one Arrow row: no per-element conversion or schema check in Python
        tbl = pa.table({"weights": pa.array([w], type=pa.list_(pa.float64()))})
        self.sparkSession.createDataFrame(tbl).coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        DefaultParamsReader.getAndSetParams(instance, metadata)
        tbl = self.sparkSession.read.parquet(f"{path}/weights").toArrow()
        instance.weights = tbl.column("weights")[0].values.to_numpy().astype(np.float64)
        return instance
