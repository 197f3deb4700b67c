"""Elastic net and SVM: optimality conditions, Spark ML, edge cases."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression

from kiln.operators import gram, svm


def table(spark, n=400, seed=1, far=1e6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 3] + [5, 0, far, 2]
    y = x @ [1.0, 0.0, 4.0, -0.5] + rng.normal(size=n)
    rows = [tuple(float(v) for v in (*r, t)) for r, t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(7)


def test_moments_and_merges(spark, monkeypatch):
    x, y, df = table(spark)
    want = np.column_stack([x, y])
    for above in (32, 2):
        monkeypatch.setattr(gram, "MERGE_ABOVE", above)
        n, mean, products = gram.moments(df, ["a", "b", "c", "d"], "y")
        centred = want - want.mean(axis=0)
        assert n == 400 and np.allclose(mean, want.mean(axis=0), rtol=1e-12)
        assert np.allclose(products, centred.T @ centred, rtol=1e-9, atol=1e-7)
    more = df.unionByName(spark.createDataFrame([(1.0, None, 1.0, 1.0, 1.0)], df.schema))
    assert gram.moments(more, ["a", "b", "c", "d"], "y")[0] == 400
    assert gram.moments(df.limit(0), ["a"], "y")[0] == 0
    with pytest.raises(ValueError, match="finite"):
        gram.moments(spark.createDataFrame([(float("nan"), 1.0), (1.0, 2.0)], "a double, y double"), ["a"], "y")


@pytest.mark.parametrize("reg,mix", [(0.3, 0.2), (0.05, 1.0), (0.5, 0.0), (0.0, 0.0), (50.0, 1.0)])
def test_elastic_net_is_optimal_and_equals_spark_ml(spark, reg, mix):
    x, y, df = table(spark, far=1.0)  # Spark ML's solver loses digits on far means
    fit = gram.elastic_net(gram.moments(df, ["a", "b", "c", "d"], "y"), reg, mix)
    assert fit.kkt < 1e-9 and all(b <= a + 1e-12 for a, b in zip(fit.objective, fit.objective[1:]))
    data = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df)
    ml = LinearRegression(labelCol="y", regParam=reg, elasticNetParam=mix, maxIter=1000, tol=1e-12).fit(data)
    assert np.allclose(fit.coefficients, ml.coefficients.toArray(), rtol=1e-3, atol=1e-4)
    if reg == 50.0:
        assert (fit.coefficients == 0).all() and np.isclose(fit.intercept, y.mean())


def test_elastic_net_of_constants():
    rows = np.array([[1.0, 2.0, 5.0], [1.0, 3.0, 7.0], [1.0, 4.0, 9.0]])
    fit = gram.elastic_net(gram.part_of(rows), 0.0, 0.0)
    assert fit.coefficients[0] == 0 and np.isclose(fit.coefficients[1], 2.0) and np.isclose(fit.intercept, 1.0)
    flat = gram.elastic_net(gram.part_of(np.array([[1.0, 4.0], [2.0, 4.0]])), 0.1, 0.5)
    assert (flat.coefficients == 0).all() and flat.intercept == 4.0
    assert gram.elastic_net((0.0, np.zeros(3), np.zeros((3, 3))), 0.1, 0.5).intercept == 0.0


def points(spark, n=300, flip=0.1):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = np.where((x @ [2.0, -1.0, 0.5] + 0.3 > 0) ^ (rng.random(n) < flip), 1, 0)
    return x, y, spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(x, y)],
                                       "label int, features array<double>").repartition(3)


def hinge(x, y, w, reg):
    s = np.where(y > 0, 1, -1)
    return reg / 2 * w @ w + np.maximum(0, 1 - s * (x @ w[:-1] + w[-1])).mean()


@pytest.mark.parametrize("reg", [0.1, 0.01])
def test_svm_gap_holds_against_other_points(spark, reg):
    """No point found by a long descent lies below the proved bound."""
    x, y, df = points(spark)
    fit = svm.fit_svm(df, reg, 1e-4)
    w = np.append(fit.weights, fit.intercept)
    assert 0 <= fit.gap <= 1e-4 and np.isclose(fit.primal, hinge(x, y, w, reg), rtol=1e-12)
    best, v = np.inf, np.zeros(4)
    data, s = np.column_stack([x, np.ones(len(x))]), np.where(y > 0, 1, -1)
    for t in range(1, 20001):
        on = s * (data @ v) < 1
        v = v - (reg * v - (s[on] @ data[on]) / len(x)) / (reg * t)
        best = min(best, hinge(x, y, v, reg))
    assert fit.bound <= best + 1e-12 and fit.primal <= best + 1e-4
    bounds = [b for _, _, b in fit.history]
    assert bounds == sorted(bounds)
    row = svm.objective(df, fit.weights, fit.intercept, reg).first()
    assert np.isclose(row["objective"], fit.primal, rtol=1e-12) and row["n"] == 300 and row["accuracy"] > 0.8


def test_svm_edges(spark):
    _, _, df = points(spark, 30)
    with pytest.raises(ValueError, match="no rows"):
        svm.fit_svm(df.limit(0))
    with pytest.raises(RuntimeError, match="gap"):
        svm.fit_svm(df, 1e-4, 1e-9, max_rounds=2)
    one = svm.fit_svm(df.filter("label = 1"), 0.1)
    assert one.primal <= hinge(np.zeros((1, 3)), np.ones(1), np.zeros(4), 0.1) and one.intercept > 0
    mixed = spark.createDataFrame([(1, [1.0]), (0, [1.0, 2.0])], "label int, features array<double>")
    with pytest.raises(ValueError, match="lengths"):
        svm.fit_svm(mixed)
