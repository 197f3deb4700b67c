"""Row numbering without a single-task window.

``row_number() OVER (ORDER BY k)`` with no PARTITION BY, or partitioned by a
key that holds a third of the table, makes Spark sort that whole group inside
one task.  ``row_number_distributed`` computes the same numbers with one
range shuffle:

1. range-partition and sort by (group, order) - a hot group is spread over
   many range partitions;
2. ``monotonically_increasing_id`` gives each row its position inside its
   partition (upper 31 bits = partition index, lower 33 bits = position);
3. a small aggregate counts rows per (partition, group) segment and a
   window over those segments (at most #partitions per group) turns the
   counts into offsets;
4. the offsets are joined back.  The offsets table has one row per
   (partition, group) segment; when the caller states that groups are few it
   is broadcast, otherwise AQE decides at runtime from its measured size.

The order must be total inside a group (end it with a unique key).

Both the counting branch and the numbering branch must see the *same*
positions.  Two independent range exchanges are not guaranteed to agree (the
range partitioner samples with a seed derived from the RDD id), so the
positioned rows are materialised once: a reliable ``checkpoint()`` into
``spark.checkpoint.dir`` (default; also cuts lineage), or ``persist`` when
the caller writes the result right away and releases it.  A recomputation
after executor loss reuses the same partitioner, so positions are stable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.session import ensure_checkpoint_dir

_POS_BITS = 33
_POS_MASK = (1 << _POS_BITS) - 1


def _cols(cs) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def row_number_distributed(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                           out: str = "rn", group_size: str | None = None,
                           num_partitions: int | None = None,
                           few_groups: bool = False, materialize: str = "checkpoint",
                           keep: list | None = None) -> DataFrame:
    """Add ``out`` = row_number() over (partition by ``partition_by`` order by ``order_by``)
    as BIGINT (1-based); optionally ``group_size`` = rows in the row's group.

    ``materialize="persist"`` caches the positioned rows instead of writing
    them and appends the cached DataFrame to ``keep`` for the caller to
    ``unpersist()`` once the result has been written."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = list(partition_by)
    keys = part + list(order_by)
    positioned = (df.repartitionByRange(n, *_cols(keys))
                  .sortWithinPartitions(*_cols(keys))
                  .withColumn("_k_mid", F.monotonically_increasing_id())
                  .withColumn("_k_pid", F.shiftright(F.col("_k_mid"), _POS_BITS))
                  .withColumn("_k_pos", F.col("_k_mid").bitwiseAND(F.lit(_POS_MASK)))
                  .drop("_k_mid"))
    if materialize == "persist":
        positioned = positioned.persist(StorageLevel.MEMORY_AND_DISK)
        if keep is not None:
            keep.append(positioned)
    else:
        ensure_checkpoint_dir(spark)
        positioned = positioned.checkpoint(eager=True)
    segments = positioned.groupBy("_k_pid", *part).agg(
        F.count(F.lit(1)).alias("_k_cnt"), F.min("_k_pos").alias("_k_first"))
    w = Window.partitionBy(*part).orderBy("_k_pid") if part else Window.orderBy("_k_pid")
    segments = segments.withColumn(
        "_k_off",
        F.coalesce(F.sum("_k_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if group_size:
        gw = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(1))
        segments = segments.withColumn(group_size, F.sum("_k_cnt").over(gw).cast("bigint"))
    if few_groups:
        # at most (#range partitions + #groups) rows: bounded by the plan, not the data
        segments = F.broadcast(segments)
    joined = positioned.join(segments, ["_k_pid", *part], "inner")
    return (joined
            .withColumn(out, (F.col("_k_off") + F.col("_k_pos") - F.col("_k_first") + 1).cast("bigint"))
            .drop("_k_pid", "_k_pos", "_k_cnt", "_k_first", "_k_off"))


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per physical partition: ``(partition, n)``; empty partitions are absent."""
    return (df.groupBy(F.spark_partition_id().alias("partition"))
            .agg(F.count(F.lit(1)).alias("n")))
