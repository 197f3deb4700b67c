"""Linear support vector machine by cutting planes, with a certificate.

Minimise ``reg / 2 |w|^2 + mean(max(0, 1 - y w.x))``, the last entry of ``w``
belonging to a constant feature of one.  A round is one pass: the loss at
``w`` and its subgradient, partial sums of the model's size per task.  Each
pass adds a plane that lies below the loss; minimising the planes' maximum is
a quadratic problem with one unknown per round.  Its value is below the true
minimum and the best loss seen above it, so the distance of the two bounds
the error of the returned weights, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "slope array<double>, loss double, active long, n long"


def sums_at(X: np.ndarray, y: np.ndarray, w: np.ndarray):
    """(subgradient sum, loss sum, rows inside the margin); y is -1 or 1."""
    short = 1 - y * (X @ w[:-1] + w[-1])
    on = short > 0
    weight = np.where(on, y, 0.0)
    return np.append(weight @ X, weight.sum()), float(short[on].sum()), int(on.sum())


def _pass(shared, d: int):
    def run(batches):
        w = shared.value
        slope, loss, active, n = np.zeros(d + 1), 0.0, 0, 0
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            X = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            s, l_, a = sums_at(X, y, w)
            slope, loss, active, n = slope + s, loss + l_, active + a, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([slope], pa.list_(pa.float64())), pa.array([loss]), pa.array([active]), pa.array([n])],
                names=["slope", "loss", "active", "n"])
    return run


def lowest(planes: np.ndarray, heights: np.ndarray, reg: float, start: np.ndarray, tolerance: float):
    """Weights of the planes (a point of the simplex) that maximise ``h.b -
    |A'b|^2 / (2 reg)``: pairs of planes exchange weight by exact steps until
    no exchange gains ``tolerance``."""
    gram = planes @ planes.T / reg
    b = start.copy()
    slope = heights - gram @ b
    for _ in range(200_000):
        up = int(np.argmax(slope))
        held = np.where(b > 0, slope, np.inf)
        down = int(np.argmin(held))
        gain = slope[up] - slope[down]
        if gain <= tolerance:
            break
        curve = gram[up, up] + gram[down, down] - 2 * gram[up, down]
        step = b[down] if curve <= 0 else min(b[down], gain / curve)
        b[up] += step
        b[down] = 0.0 if step == b[down] else b[down] - step
        slope -= step * (gram[:, up] - gram[:, down])
    return b


@dataclass
class CertifiedSVM:
    """``gap``: an upper bound of how far ``primal`` is above the minimum;
    ``history``: (round, best objective, lower bound)."""
    weights: np.ndarray
    intercept: float
    primal: float
    bound: float
    rounds: int
    n: int
    history: list = field(default_factory=list)

    @property
    def gap(self) -> float:
        return self.primal - self.bound


def objective(df: DataFrame, weights, intercept: float, reg: float, label_col: str = "label",
              features_col: str = "features") -> DataFrame:
    """``n, objective, accuracy`` of given weights as one JVM aggregate."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    score = F.aggregate(F.zip_with(F.col(features_col), w, lambda x, c: x.cast("double") * c), F.lit(float(intercept)),
                        lambda a, x: a + x)
    y = F.when(F.col(label_col) > 0, 1.0).otherwise(-1.0)
    norm = float(np.dot(weights, weights) + intercept ** 2)
    return df.select(score.alias("s"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(reg / 2 * norm) + F.avg(F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("s")))).alias("objective"),
        F.avg(((F.col("s") > 0) == (F.col("y") > 0)).cast("double")).alias("accuracy"))


def fit_svm(df: DataFrame, reg: float = 0.1, gap: float = 1e-4, max_rounds: int = 500, label_col: str = "label",
            features_col: str = "features") -> CertifiedSVM:
    """Weights whose objective is proved to be within ``gap`` of the least.

    ``label_col`` above 0 is the positive class, ``features_col`` an array of
    numbers of one length.  Rows are kept (memory, then disk) between the
    passes; a lost part is read again.  An empty table raises; reaching
    ``max_rounds`` first raises with the gap so far."""
    spark = df.sparkSession
    rows = df.select(F.when(F.col(label_col) > 0, 1.0).otherwise(-1.0).alias("y"),
                     F.col(features_col).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
        if not shape["n"]:
            raise ValueError("no rows")
        if shape["lo"] != shape["hi"]:
            raise ValueError("features have different lengths")
        d, n = int(shape["hi"]), int(shape["n"])
        w, best = np.zeros(d + 1), (np.inf, None)
        planes, heights, share = np.zeros((1, d + 1)), np.zeros(1), np.ones(1)  # the loss is not negative
        history, bound = [], -np.inf
        for number in range(1, max_rounds + 1):
            shared = spark.sparkContext.broadcast(w)
            table = rows.mapInArrow(_pass(shared, d), _SCHEMA).agg(
                F.sum("loss").alias("loss"), F.sum("active").alias("active"),
                F.array(*[F.sum(F.col("slope")[i]) for i in range(d + 1)]).alias("slope")).first()
            shared.destroy()
            loss, slope, active = table["loss"] / n, np.array(table["slope"]) / n, table["active"] / n
            here = reg / 2 * float(w @ w) + loss
            if here < best[0]:
                best = (here, w.copy())
            history.append((number, best[0], bound))
            if best[0] - bound <= gap:
                return CertifiedSVM(best[1][:-1], float(best[1][-1]), best[0], bound, number, n, history)
            # loss(v) >= active - v.slope for every v, equal at w
            planes, heights = np.vstack([planes, slope]), np.append(heights, active)
            share = lowest(planes, heights, reg, np.append(share, 0.0), gap * 1e-3)
            w = planes.T @ share / reg
            bound = max(bound, float(heights @ share - reg / 2 * (w @ w)))
            keep = share > 0  # planes that carry nothing can go: the bound is of those that stay
            if len(share) > 200:
                planes, heights, share = planes[keep], heights[keep], share[keep]
        raise RuntimeError(f"gap {best[0] - bound:.3g} after {max_rounds} rounds, wanted {gap}")
    finally:
        rows.unpersist()
