"""Shuffle partitions that follow the size of the data."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_ROWS = 1_000_000  # narrow rows (ids and a number or two) that one task sorts or groups
GRAPH_ROWS = 2_000_000  # edges of a partition of Spark's graphs, which hold each both ways


def partitions_for(spark: SparkSession, rows: int) -> int:
    """A partition for each PARTITION_ROWS, not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // PARTITION_ROWS))


def dealt(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """``df`` (of about ``rows`` rows) dealt by ``columns`` ahead of a distinct
    or a grouping by them: where nearly every row is its own group, sums made
    in the scan only hold a whole file split in memory."""
    return df.repartition(partitions_for(df.sparkSession, rows), *columns)


def graph_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of a graph of ``rows`` edges: one for each GRAPH_ROWS, filled
    up to whole rounds of the cores, two at least, and odd, as Spark's graphs
    deal a vertex by its id modulo that number and ids of a kind may be even."""
    cores = spark.sparkContext.defaultParallelism
    parts = cores * max(2, -(-int(rows) // (GRAPH_ROWS * cores)))
    return parts - 1 + parts % 2


def dealt_by_one(df: DataFrame, key: str, other: str, buckets: int = 64) -> tuple[DataFrame, list[str]]:
    """Edges ``df`` with those of a ``key`` in one of ``graph_partitions``,
    ahead of a grouping by ``key``, ``other`` and the columns named in the
    list returned.

    Keys are counted in hashed buckets, ``buckets`` a partition, which costs
    a few numbers a task.  A bucket beyond a partition's share (one of a very
    frequent key; fewer than there are partitions) is dealt over several by a
    hash of ``other``."""
    spark = df.sparkSession
    rows = df.count()
    parts = graph_partitions(spark, rows)
    share = -(-rows // parts)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets * parts))
    heavy = (df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)
             .select("bucket", F.ceil(F.col("n") / F.lit(share)).alias("n_salts")).collect())
    if not heavy:
        return df.repartition(parts, key), []
    heavy = F.broadcast(spark.createDataFrame(heavy, "bucket long, n_salts long"))
    salt = F.coalesce(F.pmod(F.xxhash64(other), F.col("n_salts")), F.lit(0)).alias("salt")
    return (df.withColumn("bucket", bucket).join(heavy, "bucket", "left").select(*df.columns, salt)
            .repartition(parts, key, "salt")), ["salt"]


@contextmanager
def whole_files(spark: SparkSession):
    """Inside, a scan reads each file as a partition of its own, so rows that
    a writer laid out together stay so and are not packed with others."""
    key = "spark.sql.files.openCostInBytes"
    own = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(key, own)


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int):
    """Inside, jobs over ``rows`` narrow rows shuffle to ``partitions_for``
    partitions, so a task's share does not grow with the input.  Beyond the
    session's own number they are not coalesced, which would undo it."""
    want = partitions_for(spark, rows)
    sized = {"spark.sql.shuffle.partitions": str(want), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    own = {key: spark.conf.get(key) for key in sized}
    if want > int(own["spark.sql.shuffle.partitions"]):
        for key, value in sized.items():
            spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in own.items():
            spark.conf.set(key, value)


@contextmanager
def joins_by_some_keys(spark: SparkSession):
    """Inside, a side that is laid out by some of the keys of a join stays,
    and the other side is dealt the same way."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    own = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, own)
