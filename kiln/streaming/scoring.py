"""Labelled test points, ``(y), [x, ...]`` lines arriving as files, scored
against the newest centres that a training stream has left.

Every micro-batch reads the centres once, assigns its points and writes its
confusion table, with the number of the centres it used, under its own batch
id.  A batch that is run again after a failure finds its table written and
keeps it, so a restart neither repeats a batch nor scores it with centres that
came later."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.clustering import assign_nearest

POINT = r"^\s*\(\s*([^()\[\],]+?)\s*\)\s*,\s*\[([^\[\]]*)\]\s*$"
TABLE = "label double, cluster int, n long, centres_batch long, batch_id long"


def write_points(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Append labelled points as lines."""
    numbers = F.array_join(F.transform(features, lambda x: x.cast("double").cast("string")), ", ")
    (df.select(F.concat(F.lit("("), F.col(label).cast("double").cast("string"), F.lit("), ["), numbers, F.lit("]"))
               .alias("value")).write.mode("append").text(path))


def parse_points(lines: DataFrame, dim: int) -> DataFrame:
    """``label, features`` of ``(y), [x, ...]`` lines; a line of another
    form, or without ``dim`` finite numbers, has a null label and features."""
    label = F.expr("try_cast(nullif(y, '') as double)")
    numbers = F.expr(r"transform(split(trim(xs), '\\s*,\\s*'), x -> try_cast(x as double))")
    parts = lines.select(F.regexp_extract("value", POINT, 1).alias("y"), F.regexp_extract("value", POINT, 2).alias("xs"))
    rows = parts.select(label.alias("label"), numbers.alias("features"))
    good = (F.col("label").isNotNull() & ~F.isnan("label") & (F.size("features") == dim)
            & F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.select(*[F.when(good, F.col(c)).alias(c) for c in ("label", "features")])


def newest_centres(spark: SparkSession, state_dir: str) -> tuple[int, np.ndarray]:
    """(number, k x d matrix) of the last centres of a training stream."""
    state = spark.read.parquet(state_dir)
    last = state.agg(F.max("batch_id")).first()[0]
    if last is None:
        raise ValueError(f"no centres in {state_dir}")
    rows = state.filter(F.col("batch_id") == last).orderBy("cluster").collect()
    return int(last), np.array([r["centre"] for r in rows], dtype=np.float64)


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run_point_stream(spark: SparkSession, source_dir: str, state_dir: str, sink_dir: str, checkpoint_dir: str,
                     files_per_trigger: int = 1_000_000) -> DataFrame:
    """Score the lines that ``source_dir`` has now and return the confusion
    tables of all batches so far: ``batch_id, label, cluster, n,
    centres_batch``.  Lines that are no labelled point of the centres' width
    are counted under a null label and cluster."""
    def score(lines: DataFrame, batch_id: int) -> None:
        folder = f"{sink_dir}/batch={batch_id}"
        if _written(spark, folder):
            return
        number, centres = newest_centres(spark, state_dir)
        points = parse_points(lines, centres.shape[1])
        good = assign_nearest(points.filter(F.col("label").isNotNull()), centres, out="cluster", dist_out=None)
        found = good.select("label", F.col("cluster").cast("int").alias("cluster")).unionByName(
            points.filter(F.col("label").isNull()).select("label", F.lit(None).cast("int").alias("cluster")))
        (found.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n"))
         .withColumn("centres_batch", F.lit(number).cast("long")).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").parquet(folder))

    query = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(source_dir)
             .writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(TABLE).option("recursiveFileLookup", "true").parquet(sink_dir)
