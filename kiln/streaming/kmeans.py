"""Streaming (mini-batch) k-means over points arriving as files.

Per micro-batch: points are assigned to the current centres JVM-side,
summed per (centre, position) by Spark, and the k x d sums come to the
driver (model-sized) for the decayed update.  The centres after every batch
are written to ``state/batch_id=<id>``; a restarted query resumes from the
latest state and a replayed batch is skipped.  A new checkpoint numbers its
batches from 0 again, so state ids are the query's batch ids plus a base: a
run that resumes old state with a new checkpoint counts on from there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.clustering import assign_nearest, streaming_update


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and len(fs.listStatus(path)) > 0


class StreamingKMeans:
    def __init__(self, centres: np.ndarray, decay: float = 1.0):
        self.centres = np.asarray(centres, dtype=np.float64)
        self.counts = np.zeros(len(self.centres))
        self.decay = decay
        self.last_batch = -1
        self.base = 0
        self.batches: list[dict] = []

    def _load_state(self, spark: SparkSession, state_dir: str, checkpoint_dir: str) -> None:
        if not _has_files(spark, state_dir):
            return  # nothing written yet; any other failure to read it rises
        st = spark.read.parquet(state_dir)
        last = st.agg(F.max("batch_id")).first()[0]
        if last is None:
            return
        rows = st.filter(F.col("batch_id") == last).orderBy("cluster").collect()
        self.centres = np.array([r["centre"] for r in rows], dtype=np.float64)
        self.counts = np.array([r["weight"] for r in rows], dtype=np.float64)
        self.last_batch = int(last)
        resumed = _has_files(spark, f"{checkpoint_dir}/offsets")
        self.base = int(rows[0]["base"]) if resumed else self.last_batch + 1

    def update(self, batch: DataFrame, batch_id: int, features: str, state_dir: str,
               id_col: str = "id") -> None:
        batch_id += self.base
        if batch_id <= self.last_batch:
            return  # replay of a batch already folded into the state
        k, d = self.centres.shape
        assigned = assign_nearest(batch, self.centres, features, out="cluster", dist_out=None)
        has_id = id_col in batch.columns
        ids = [F.col(id_col).alias("_id")] if has_id else [F.lit(None).cast("long").alias("_id")]
        # one pass: per (centre, position) the sum, the points (the same for
        # every position of a centre) and the id span; partially aggregated,
        # k x d rows reach the driver
        cells = (assigned.select("cluster", *ids, F.posexplode(features).alias("pos", "v"))
                 .groupBy("cluster", "pos")
                 .agg(F.sum(F.col("v").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"),
                      F.min("_id").alias("lo"), F.max("_id").alias("hi"))
                 .collect())
        S, M = np.zeros((k, d)), np.zeros(k)
        los, his = [], []
        for r in cells:
            S[r["cluster"], r["pos"]] = r["s"]
            M[r["cluster"]] = r["n"]
            if r["lo"] is not None:
                los.append(r["lo"])
                his.append(r["hi"])
        span = (min(los), max(his)) if los else (None, None)
        self.centres, self.counts = streaming_update(self.centres, self.counts, S, M, self.decay)
        spark = batch.sparkSession
        rows = [(i, float(self.counts[i]), [float(v) for v in self.centres[i]], self.base) for i in range(k)]
        (spark.createDataFrame(rows, "cluster int, weight double, centre array<double>, base long")
         .write.mode("overwrite").parquet(f"{state_dir}/batch_id={batch_id}"))
        self.last_batch = batch_id
        self.batches.append({"batch_id": batch_id, "rows": int(M.sum()), "min_id": span[0], "max_id": span[1]})

    def run(self, spark: SparkSession, source_dir: str, schema, state_dir: str, checkpoint_dir: str,
            features: str = "features", files_per_trigger: int = 1) -> DataFrame:
        self._load_state(spark, state_dir, checkpoint_dir)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
        q = (stream.writeStream
             .foreachBatch(lambda df, bid: self.update(df, bid, features, state_dir))
             .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        q.awaitTermination()
        rows = [(i, float(self.counts[i]), [float(v) for v in self.centres[i]]) for i in range(len(self.centres))]
        return spark.createDataFrame(rows, "cluster int, weight double, centre array<double>")
