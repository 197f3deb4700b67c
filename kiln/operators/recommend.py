"""Ratings tables and ALS recommendation."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.ranking import row_number_distributed


def interaction_counts(df: DataFrame, user: str, item: str, out: str = "rating") -> DataFrame:
    """Implicit ratings: number of interactions per (user, item)."""
    return df.groupBy(user, item).agg(F.count(F.lit(1)).alias(out))


def write_ratings_text(df: DataFrame, path: str, cols=("user", "item", "rating", "ts"), sep: str = "::") -> str:
    """``user::item::rating[::ts]`` lines, the sample-ratings file format."""
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cols]).alias("value")) \
        .write.mode("overwrite").text(path)
    return path


def read_ratings_text(spark: SparkSession, path: str, sep: str = "::", with_ts: bool = True) -> DataFrame:
    """Parse ``u::i::r[::ts]`` (or ``u,i,r`` with ``sep=','``) lines."""
    parts = F.split(F.col("value"), sep)
    cols = [parts[0].cast("bigint").alias("user"), parts[1].cast("bigint").alias("item"),
            parts[2].cast("float").alias("rating")]
    if with_ts:
        cols.append(parts[3].cast("bigint").alias("ts"))
    return spark.read.text(path).select(*cols)


def index_ids(df: DataFrame, col: str, out: str) -> DataFrame:
    """Dense 32-bit numbers for arbitrary ids, in id order."""
    ids = row_number_distributed(df.select(col).distinct(), [col], out=out)
    return df.join(ids.withColumn(out, (F.col(out) - 1).cast("int")), col)


def als_fit(ratings: DataFrame, user: str = "user", item: str = "item", rating: str = "rating",
            rank: int = 8, max_iter: int = 5, reg: float = 0.1, implicit: bool = False, seed: int = 42):
    # the fit takes 32-bit ids; a cast would wrap larger ones
    span = ratings.agg(*[f(c) for c in (user, item) for f in (F.max, F.min)]).first()
    for c, top in ((user, span[:2]), (item, span[2:])):
        if top[0] is not None and (top[0] >= 2**31 or top[1] < -2**31):
            raise ValueError(f"{c} ids exceed 32 bits: number them first (index_ids)")
    return ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, userCol=user, itemCol=item,
               ratingCol=rating, coldStartStrategy="drop", seed=seed).fit(ratings)


def evaluate_fit(model, ratings: DataFrame, user: str = "user", item: str = "item",
                 rating: str = "rating") -> DataFrame:
    """Per user: the purchased item with the highest predicted score
    (``max_by``: a bounded buffer per group, partial aggregation) and the
    squared error on the user's observed ratings.  Scoring is restricted to
    observed pairs: no user x item product is formed."""
    pred = model.transform(ratings)
    return (pred.groupBy(user)
            .agg(F.max_by(item, "prediction").alias("best_item"), F.max("prediction").alias("best_score"),
                 F.sum(F.pow(F.col(rating) - F.col("prediction"), 2)).alias("sse"),
                 F.count(F.lit(1)).alias("n")))
