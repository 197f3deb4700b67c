"""Intermediate tables under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kiln.session import delete_scratch, scratch_path


def store(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back: lineage is cut and a lost
    executor costs a re-read.  ``drop`` deletes it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``store`` made and nothing reads any more."""
    for t in tables:
        delete_scratch(t.sparkSession, t.scratch)
