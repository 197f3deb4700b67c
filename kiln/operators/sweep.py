"""Training sweeps: the benchmark's copies of one script that differ in
batch size, iteration count or partition count, expressed as one grid."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kiln.operators.training import TrainConfig, standardize_input, train

SWEEP_SCHEMA = T.StructType([
    T.StructField("run", T.IntegerType()), T.StructField("iters", T.IntegerType()),
    T.StructField("batch", T.IntegerType()), T.StructField("partitions", T.IntegerType()),
    T.StructField("shard_by", T.StringType()), T.StructField("train_loss", T.DoubleType()),
    T.StructField("train_acc", T.DoubleType()), T.StructField("val_loss", T.DoubleType()),
    T.StructField("val_acc", T.DoubleType()), T.StructField("rows_seen", T.LongType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("fit_seconds", T.DoubleType()), T.StructField("rows_per_second", T.DoubleType()),
])


def _tail_mean(values, k=5):
    vals = [v for v in values if v is not None][-k:]
    return sum(vals) / len(vals) if vals else None


def sweep(df: DataFrame, model_config: dict, grid: list[dict], base: TrainConfig, **cols) -> DataFrame:
    """One training run per grid point (runs are sequential; each is a
    distributed job).  Reports train loss/accuracy (mean of the last steps),
    validation metrics and fit seconds (B5: fit only, not load or test)."""
    # the input is read and standardised once and kept for every run (each
    # run would otherwise scan and persist it again)
    std = standardize_input(df, cols.get("id_col", "id"), cols.get("label_col", "label"),
                            cols.get("features_col", "features"), base.feature_dtype)
    std = std.persist(StorageLevel.MEMORY_AND_DISK)
    rows = []
    try:
        for i, point in enumerate(grid):
            cfg = replace(base, **{"materialize_input": False, **point})
            res = train(std, model_config, cfg)
            tr = [h for h in res.history if h["split"] == "train"]
            seen = sum(int(h["n"]) for h in tr)
            v = res.validation or {}
            rows.append((i, res.steps, cfg.batch_size, cfg.partitions, cfg.shard_by,
                         _tail_mean([h["loss"] for h in tr]), _tail_mean([h["acc"] for h in tr]),
                         v.get("loss"), v.get("accuracy"), seen, res.train_rows, res.seconds,
                         seen / res.seconds if res.seconds else None))
    finally:
        std.unpersist()
    return df.sparkSession.createDataFrame(rows, SWEEP_SCHEMA)


def sweep_iterations(df: DataFrame, model_config: dict, cuts: list[int], base: TrainConfig, **cols) -> DataFrame:
    """Iteration sweep as ONE run to ``max(cuts)`` with a validation pass at
    every cut (the 25/50/.../300-iteration scripts share their prefix).  A
    run that ``min_epochs`` takes beyond the last cut has its end as one more
    row."""
    spark: SparkSession = df.sparkSession
    cfg = replace(base, iters=max(cuts), eval_at=tuple(cuts))
    res = train(df, model_config, cfg, **cols)
    tr = [h for h in res.history if h["split"] == "train"]
    rows = []
    ends = sorted({*cuts, res.steps})
    for i, cut in enumerate(ends):
        upto = [h for h in tr if h["iter"] < cut]
        val = [h for h in res.history if h["split"] == "validation" and h["iter"] == cut - 1]
        seen = sum(int(h["n"]) for h in upto)
        secs = val[0]["seconds"] if val else sum(h["seconds"] for h in upto)
        v = (val[0]["loss"], val[0]["acc"]) if val else (None, None)
        if cut == res.steps and res.validation:
            v = (res.validation["loss"], res.validation["accuracy"])
        rows.append((i, cut, cfg.batch_size, cfg.partitions, cfg.shard_by,
                     _tail_mean([h["loss"] for h in upto]), _tail_mean([h["acc"] for h in upto]),
                     *v, seen, res.train_rows, secs,
                     seen / secs if secs else None))
    return spark.createDataFrame(rows, SWEEP_SCHEMA)
