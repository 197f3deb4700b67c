"""Tensor maths on ``ARRAY<FLOAT|DOUBLE>`` columns with higher-order
functions.  They stay in the JVM, but Spark interprets the lambdas element by
element (no code generation): right for small fixed models, while trained
models score in Arrow batches (``predict_column``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def array_sum(arr) -> Column:
    return F.aggregate(_col(arr), F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def dot(x, w) -> Column:
    """Inner product of two equally long arrays."""
    return array_sum(F.zip_with(_col(x), _col(w), lambda a, b: a.cast("double") * b.cast("double")))


def affine(x, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """``W @ x + b`` for a small, fixed weight matrix given as literals."""
    return F.array(*[dot(x, lit_array(row)) + F.lit(float(b)) for row, b in zip(weights, bias)])


def relu(arr) -> Column:
    return F.transform(_col(arr), lambda v: F.greatest(v, F.lit(0.0)))


def argmax(arr) -> Column:
    """Index of the first maximum (0-based), as BIGINT."""
    a = _col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def log_softmax(arr) -> Column:
    a = _col(arr)
    m = F.array_max(a)
    lse = m + F.log(array_sum(F.transform(a, lambda v: F.exp(v - m))))
    return F.transform(a, lambda v: v - lse)


def scale(arr, divisor: float) -> Column:
    """ToTensor-style constant scaling, e.g. bytes / 255."""
    return F.transform(_col(arr), lambda v: v.cast("double") / F.lit(float(divisor)))


def normalize(arr, mean: float, std: float) -> Column:
    return F.transform(_col(arr), lambda v: (v.cast("double") - F.lit(float(mean))) / F.lit(float(std)))


def to_float32(arr) -> Column:
    return _col(arr).cast("array<float>")
