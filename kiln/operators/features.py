"""Projections that turn table columns into model inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions import arrays


def project_slice(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """``df.columns[start:stop]`` - positional projection (pruned at the scan)."""
    return df.select(*df.columns[start:stop])


def assemble(df: DataFrame, input_cols: Sequence[str], out: str = "features",
             as_vector: bool = True, handle_invalid: str = "error") -> DataFrame:
    """Concatenate numeric columns, order kept.  ``as_vector`` gives an ML
    ``VectorUDT`` (VectorAssembler); otherwise an ``ARRAY<DOUBLE>`` built
    JVM-side (nulls follow ``handle_invalid``: error/skip/keep)."""
    if as_vector:
        return VectorAssembler(inputCols=list(input_cols), outputCol=out,
                               handleInvalid=handle_invalid).transform(df)
    cols = [F.col(c).cast("double") for c in input_cols]
    any_null = None
    for c in input_cols:
        cond = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        any_null = cond if any_null is None else (any_null | cond)
    if handle_invalid == "skip":
        df = df.filter(~any_null)
    elif handle_invalid == "error":
        cols = [F.when(any_null, F.raise_error(F.lit("null or NaN in assembled column")))
                .otherwise(c) for c in cols]
    return df.withColumn(out, F.array(*cols))


def vector_as_array(col: str | Column, dtype: str = "float64") -> Column:
    """ML vector -> ARRAY<DOUBLE|FLOAT> (densifies sparse vectors)."""
    return vector_to_array(F.col(col) if isinstance(col, str) else col, dtype)


def reshape_grid(arr: str | Column, side: int) -> Column:
    """Flat row-major array of side*side values -> array of ``side`` rows."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)),
                       lambda r: F.slice(a, r * side + 1, side))


def flatten_grid(grid: str | Column) -> Column:
    return F.flatten(F.col(grid) if isinstance(grid, str) else grid)


def scale_constant(df: DataFrame, col: str, divisor: float = 255.0, out: str | None = None) -> DataFrame:
    """ToTensor: divide by a constant (byte images -> [0, 1])."""
    return df.withColumn(out or col, arrays.scale(col, divisor))


def normalize(df: DataFrame, col: str, mean: float = 0.5, std: float = 0.5,
              out: str | None = None) -> DataFrame:
    """``(x - mean) / std`` element-wise."""
    return df.withColumn(out or col, arrays.normalize(col, mean, std))


def feature_extents(df: DataFrame, col: str) -> DataFrame:
    """Per-position min and max of an array column: ``(pos, fmin, fmax)``.
    Partial aggregation on the map side; output has one row per position."""
    return (df.select(F.posexplode(col).alias("pos", "v"))
            .groupBy("pos").agg(F.min("v").cast("double").alias("fmin"),
                                F.max("v").cast("double").alias("fmax")))


def fit_minmax(df: DataFrame, col: str) -> tuple[list[float], list[float]]:
    """Fit step of a min-max scaler.  The result has one entry per feature
    position (bounded by the vector width, not by the row count)."""
    rows = feature_extents(df, col).orderBy("pos").collect()
    return [r["fmin"] for r in rows], [r["fmax"] for r in rows]


def apply_minmax(df: DataFrame, col: str, mins: Sequence[float], maxs: Sequence[float],
                 out: str | None = None) -> DataFrame:
    """``(x - min) / (max - min)`` per position; a constant feature maps to 0.5
    (the Spark ML MinMaxScaler convention)."""
    lo = arrays.lit_array(mins)
    span = arrays.lit_array([(b - a) for a, b in zip(mins, maxs)])
    scaled = F.zip_with(F.zip_with(F.col(col), lo, lambda x, a: x.cast("double") - a), span,
                        lambda d, s: F.when(s == 0, F.lit(0.5)).otherwise(d / s))
    return df.withColumn(out or col, scaled)


def recode_binary(df: DataFrame, label_col: str, out: str | None = None) -> DataFrame:
    """Two distinct labels, in sorted order, recoded to 0.0 and 1.0 (one
    aggregate finds them); any other number of labels raises.  A null label
    stays null."""
    r = df.agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).first()
    between = (F.col(label_col) != F.lit(r["lo"])) & (F.col(label_col) != F.lit(r["hi"]))
    if r["lo"] is None or r["lo"] == r["hi"] or not df.filter(between).isEmpty():
        raise ValueError(f"{label_col} does not have exactly two labels")
    return df.withColumn(out or label_col, (F.col(label_col) == F.lit(r["hi"])).cast("double"))
