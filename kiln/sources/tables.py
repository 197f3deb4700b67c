"""Readers for the parquet tables the engine runs on.

Only a lazy ``spark.read.parquet`` is issued here; projections and filters
written later by the caller are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Expose every table as a temp view so SQL text can be used too."""
    for name in TABLES:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled image stand-in: ``(id, label, features ARRAY<FLOAT>)``.

    The 64-float ``embeddings`` rows play the role of 8x8 single-channel
    images, the same shape contract as the 28x28 pictures in the original
    workload (side is a model parameter).
    """
    return (read_table(spark, sf_dir, "embeddings")
            .selectExpr("vec_id AS id", "label", "embedding AS features"))
