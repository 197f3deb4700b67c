"""Linear models from one pass: moments, then coordinate descent.

Every task reduces its rows to their number, means and centred products of
features and target; the partial moments are merged pairwise (Chan's update),
through one more level when there are many.  What follows works on numbers of
the model's size squared and never reads the rows again, so a path of
penalties costs one scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE_ABOVE = 32   # partial moments that come to the driver at most (or the square root of the tasks)
CHUNK = 8192
_SCHEMA = "n double, mean array<double>, products array<double>"


def merge(a, b):
    """(n, mean, centred products) of two parts together."""
    if a is None or not a[0]:
        return b
    if b is None or not b[0]:
        return a
    n = a[0] + b[0]
    shift = b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def part_of(rows: np.ndarray):
    mean = rows.mean(axis=0)
    centred = rows - mean
    return float(len(rows)), mean, centred.T @ centred


def _row(part):
    if part is None:
        return
    one = lambda v: pa.array([v.ravel()], pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array([part[0]]), one(part[1]), one(part[2])], names=["n", "mean", "products"])


def _parts(batches):
    total = None
    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(lo, CHUNK)
            flat = piece.column(0).flatten().to_numpy(zero_copy_only=False)
            total = merge(total, part_of(flat.reshape(piece.num_rows, -1)))
    yield from _row(total)


def _read(table):
    total = None
    for r in table.to_pylist():
        k = len(r["mean"])
        total = merge(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    return total


def _merged(batches):
    total = None
    for batch in batches:
        total = merge(total, _read(batch))
    yield from _row(total)


def moments(df: DataFrame, features: list[str], target: str):
    """(n, means, centred products) of the features and, last, the target.
    Rows with a null anywhere are left out; a NaN or infinity raises."""
    columns = [F.col(c).cast("double") for c in (*features, target)]
    rows = df.select(F.array(*columns).alias("v")).filter(~F.exists("v", lambda x: x.isNull()))
    parts = rows.mapInArrow(_parts, _SCHEMA)
    tasks = parts.rdd.getNumPartitions()
    if tasks > MERGE_ABOVE:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(_merged, _SCHEMA)
    total = _read(parts.toArrow())
    k = len(columns)
    if total is None:
        return 0.0, np.zeros(k), np.zeros((k, k))
    if not np.isfinite(total[2]).all():
        raise ValueError("a feature or the target is not a finite number")
    return total


@dataclass
class ElasticNet:
    """``kkt``: the largest violation of the optimality conditions, in the
    scaled problem; ``objective`` after every sweep."""
    coefficients: np.ndarray
    intercept: float
    scaled: np.ndarray
    sweeps: int
    kkt: float
    objective: list = field(default_factory=list)


def _shrink(x: float, by: float) -> float:
    return math.copysign(max(abs(x) - by, 0.0), x)


def elastic_net(total, reg: float, mix: float, tolerance: float = 1e-12, max_sweeps: int = 100_000) -> ElasticNet:
    """Minimise ``sum (y - x w - b)^2 / 2n + reg (mix |w|_1 + (1 - mix) / 2
    |w|^2)`` with features and target scaled to a deviation of one (``reg``
    is then divided by the target's), as ``pyspark.ml`` does by default.

    A constant feature has coefficient 0; a constant target, or fewer than
    two rows, has all 0 and the mean as intercept."""
    n, mean, products = total
    d = len(mean) - 1
    deviation = np.sqrt(np.maximum(np.diag(products), 0) / (n - 1)) if n > 1 else np.zeros(d + 1)
    w = np.zeros(d)
    if n < 2 or not deviation[-1]:
        return ElasticNet(w, float(mean[-1]), w, 0, 0.0, [])
    use = deviation[:-1] > 0
    scale = np.where(use, deviation[:-1], 1.0)
    G = products[:-1, :-1] / np.outer(scale, scale) / n
    r = products[:-1, -1] / scale / deviation[-1] / n
    yy = products[-1, -1] / deviation[-1] ** 2 / n
    reg = reg / deviation[-1]
    lasso, ridge = reg * mix, reg * (1 - mix)

    def value():
        return float(yy / 2 - r @ w + w @ G @ w / 2 + lasso * np.abs(w).sum() + ridge / 2 * (w @ w))
    objective, sweeps = [value()], 0
    for sweeps in range(1, max_sweeps + 1):
        moved = 0.0
        for j in np.flatnonzero(use):
            new = _shrink(r[j] - G[j] @ w + G[j, j] * w[j], lasso) / (G[j, j] + ridge)
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        objective.append(value())
        if moved <= tolerance:
            break
    slope = (r - G @ w - ridge * w)[use]
    on = w[use] != 0
    gap = np.where(on, np.abs(slope - lasso * np.sign(w[use])), np.maximum(np.abs(slope) - lasso, 0))
    coefficients = w * deviation[-1] / scale
    return ElasticNet(coefficients, float(mean[-1] - coefficients @ mean[:-1]), w, sweeps,
                      float(gap.max()) if len(gap) else 0.0, objective)
