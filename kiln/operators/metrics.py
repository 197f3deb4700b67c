"""Losses and quality metrics as DataFrame aggregates.

All of them are single-pass aggregates: Spark computes partial aggregates
per task and merges fixed-size buffers, so the cost is one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def accuracy_expr(label, pred) -> Column:
    return F.avg((_c(label).cast("double") == _c(pred).cast("double")).cast("double"))


def accuracy(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(accuracy_expr(label, pred).alias("accuracy"),
                               F.count(F.lit(1)).alias("n"))


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE and r2 = 1 - SSE/SST in one pass."""
    err2 = F.pow(_c(label).cast("double") - _c(pred).cast("double"), 2)
    agg = df.groupBy(*by).agg(F.avg(err2).alias("mse"),
                              F.var_pop(_c(label).cast("double")).alias("_var"),
                              F.count(F.lit(1)).alias("n"))
    return (agg.withColumn("rmse", F.sqrt("mse"))
            .withColumn("r2", 1 - F.col("mse") / F.col("_var"))
            .drop("_var"))


def residuals(df: DataFrame, label: str, pred: str, out: str = "residual") -> DataFrame:
    return df.withColumn(out, _c(label).cast("double") - _c(pred).cast("double"))


def cross_entropy_expr(logp, label) -> Column:
    """-log p[y] for a log-probability array and a 0-based class label."""
    return -F.element_at(_c(logp), _c(label).cast("int") + 1)


def mse_expr(pred, label) -> Column:
    return F.pow(_c(pred).cast("double") - _c(label).cast("double"), 2)


def hinge_expr(score, y01) -> Column:
    """max(0, 1 - y s) with y in {0,1} recoded to {-1,+1}."""
    y = _c(y01).cast("double") * 2 - 1
    return F.greatest(F.lit(0.0), 1 - y * _c(score))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    return (df.groupBy(_c(label).cast("bigint").alias("label"),
                       _c(pred).cast("bigint").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def feature_stats(df: DataFrame, col: str) -> DataFrame:
    """Per-position mean and sample stddev of an array column."""
    return (df.select(F.posexplode(col).alias("pos", "v"))
            .groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("mean"),
                                F.stddev_samp(F.col("v").cast("double")).alias("std"),
                                F.count(F.lit(1)).alias("n")))


def epoch_metrics(history: DataFrame, by: Sequence[str] = ("epoch", "split")) -> DataFrame:
    """``log_dict(on_epoch=True)``: batch metrics averaged per epoch and
    split, weighted by batch size."""
    return (history.groupBy(*by)
            .agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"),
                 (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("acc"),
                 F.sum("n").cast("bigint").alias("n")))
