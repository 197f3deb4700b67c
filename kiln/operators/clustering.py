"""Centroid models over array features: class centroids, nearest-centroid
assignment, Spark ML k-means, and the streaming k-means update rule."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_centroids(df: DataFrame, group_col: str, features: str = "features") -> DataFrame:
    """Mean vector per group as ``(group, pos, mean)`` rows: exploded so the
    aggregation buffer per group is one number, not a whole array."""
    return (df.select(group_col, F.posexplode(features).alias("pos", "v"))
            .groupBy(group_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean")))


def collect_centroids(centroids: DataFrame, group_col: str) -> tuple[list, np.ndarray]:
    """k x d centroid matrix on the driver (k and d are model sizes)."""
    rows = centroids.orderBy(group_col, "pos").collect()
    keys = sorted({r[group_col] for r in rows})
    d = 1 + max(r["pos"] for r in rows)
    mat = np.zeros((len(keys), d))
    index = {k: i for i, k in enumerate(keys)}
    for r in rows:
        mat[index[r[group_col]], r["pos"]] = r["mean"]
    return keys, mat


ROWS_AT_ONCE = 256  # rows x centres x dimensions held by a task


def assign_nearest(df: DataFrame, centres: np.ndarray, features: str = "features", names: Sequence | None = None,
                   out: str = "cluster", dist_out: str | None = "distance") -> DataFrame:
    """Nearest centre by squared Euclidean distance (first centre wins ties).
    The centres travel as a broadcast and batches are scored as Arrow
    buffers, so the plan does not grow with them."""
    names = list(names) if names is not None else list(range(len(centres)))
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))
    kind = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("d2", T.DoubleType())])

    @F.arrow_udf(kind)
    def nearest(col: pa.Array) -> pa.Array:
        c, n = shared.value, len(col)
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, c.shape[1])
        at, d2 = np.zeros(n, np.int32), np.zeros(n)
        for lo in range(0, n, ROWS_AT_ONCE):
            d = ((x[lo:lo + ROWS_AT_ONCE, None, :] - c) ** 2).sum(axis=2)
            at[lo:lo + ROWS_AT_ONCE] = d.argmin(axis=1)
            d2[lo:lo + ROWS_AT_ONCE] = d.min(axis=1)
        return pa.StructArray.from_arrays([pa.array(at), pa.array(d2)], names=["at", "d2"])

    res = df.withColumn("_k_near", nearest(F.col(features)))
    res = res.withColumn(out, F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k_near.at") + 1))
    if dist_out:
        res = res.withColumn(dist_out, F.sqrt("_k_near.d2"))
    return res.drop("_k_near")


def lloyd(df: DataFrame, centres: np.ndarray, names: Sequence, rounds: int, features: str = "features"):
    """``rounds`` of assign and average from given centres; a centre without
    points goes.  Returns (names, centres): k x d numbers a round."""
    names = list(names)
    for _ in range(rounds):
        assigned = assign_nearest(df, centres, features, names=names, dist_out=None)
        names, centres = collect_centroids(group_centroids(assigned, "cluster", features), "cluster")
    return names, centres


def kmeans_fit(df: DataFrame, k: int, features: str = "features", seed: int = 42, max_iter: int = 20):
    """Spark ML k-means (k-means|| init) on an array column."""
    data = df.withColumn("_k_vec", array_to_vector(features))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_k_vec").fit(data)


def streaming_update(centres: np.ndarray, counts: np.ndarray, batch_sums: np.ndarray,
                     batch_counts: np.ndarray, decay: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Mini-batch k-means with forgetting: ``c' = (c n a + s) / (n a + m)``,
    ``n' = n a + m`` per centre; a centre with no points keeps its place."""
    w_old = counts * decay
    w_new = w_old + batch_counts
    safe = np.where(w_new > 0, w_new, 1.0)
    upd = (centres * w_old[:, None] + batch_sums) / safe[:, None]
    return np.where((w_new > 0)[:, None], upd, centres), w_new
