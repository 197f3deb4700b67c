"""Array maths and metric expressions."""

import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from kiln.functions import arrays
from kiln.operators import metrics
from kiln.sources import image_table


def test_log_softmax_sums_to_one_and_is_idempotent(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([-50.0, 0.0, 50.0],), ([0.0, 0.0, 0.0],)], "s array<double>")
    once = df.select(arrays.log_softmax("s").alias("l"))
    twice = once.select("l", arrays.log_softmax("l").alias("l2")).collect()
    for r in twice:
        assert math.isclose(sum(math.exp(v) for v in r["l"]), 1.0, rel_tol=1e-12)
        assert np.allclose(r["l"], r["l2"], atol=1e-12)


def test_argmax_takes_the_first_maximum(spark):
    r = spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>").select(arrays.argmax("s")).first()[0]
    assert r == 1


def test_accuracy_is_invariant_under_row_order(spark):
    df = image_table(spark, SF01).select("id", "label", (F.col("id") % 10).alias("p"))
    a = metrics.accuracy(df, "label", "p").first()["accuracy"]
    b = metrics.accuracy(df.orderBy(F.rand(3)).repartition(7), "label", "p").first()["accuracy"]
    assert a == b


def test_regression_metrics_match_numpy(spark):
    rows = [(float(i), float(i) * 1.5 + (i % 3)) for i in range(20)]
    df = spark.createDataFrame(rows, "y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    y, p = np.array(rows).T
    mse = ((y - p) ** 2).mean()
    assert math.isclose(m["mse"], mse) and math.isclose(m["r2"], 1 - mse / y.var())
