"""File sources and sinks: headerless CSV, libsvm, partitioned binary files.

Reads take an explicit schema where one is known (inference costs an extra
pass over the data); ``infer=True`` reproduces ``inferSchema``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, header: bool = False) -> str:
    df.write.mode("overwrite").option("header", str(header).lower()).csv(path)
    return path


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Headerless CSV with type inference: columns ``_c0, _c1, ...``."""
    return spark.read.option("header", "false").option("inferSchema", "true").csv(path)


def read_csv_named(spark: SparkSession, path: str, names: Sequence[str],
                   types: Sequence[T.DataType] | None = None) -> DataFrame:
    """Headerless CSV with assigned names (and types, when given: no
    inference pass)."""
    if types is None:
        return read_csv_inferred(spark, path).toDF(*names)
    schema = T.StructType([T.StructField(n, t, True) for n, t in zip(names, types)])
    return spark.read.schema(schema).option("header", "false").csv(path)


def csv_to_array(df: DataFrame, cols: Sequence[str], out: str = "features", dtype: str = "float") -> DataFrame:
    """Numeric columns -> one ``ARRAY<FLOAT>`` column (float32 matrix rows)."""
    return df.withColumn(out, F.array(*[F.col(c) for c in cols]).cast(f"array<{dtype}>"))


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> str:
    """Write ``label`` + an array or vector column as libsvm text (1-based indices)."""
    f = F.col(features)
    if not _is_vector(df, features):
        f = array_to_vector(f)
    (df.select(F.col(label).cast("double").alias("label"), f.alias("features"))
     .write.mode("overwrite").format("libsvm").save(path))
    return path


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """libsvm -> ``(label DOUBLE, features VECTOR)``; giving ``num_features``
    avoids the pass that finds the largest index."""
    r = spark.read.format("libsvm")
    if num_features:
        r = r.option("numFeatures", str(num_features))
    return r.load(path)


def libsvm_dense(df: DataFrame, features: str = "features", out: str = "features",
                 dtype: str = "float32") -> DataFrame:
    """Sparse vector -> dense ``ARRAY<FLOAT>`` (zeros filled), JVM-side."""
    return df.withColumn(out, vector_to_array(F.col(features), dtype))


def _is_vector(df: DataFrame, col: str) -> bool:
    from pyspark.ml.linalg import VectorUDT
    return isinstance(df.schema[col].dataType, VectorUDT)


def write_partitioned_text(df: DataFrame, path: str, value: str, partition_cols: Sequence[str]) -> str:
    (df.select(F.col(value).alias("value"), *partition_cols)
     .write.mode("overwrite").partitionBy(*partition_cols).text(path))
    return path


def list_binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``binaryFile`` listing with partition discovery (``key=value`` folders
    become columns).  Selecting no ``content`` keeps file bodies unread."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def read_images(spark: SparkSession, path: str, drop_invalid: bool = True) -> DataFrame:
    """The ``image`` source; undecodable files are dropped when asked."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)
