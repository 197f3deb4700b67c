"""Seeded order, splits, shards and minibatches."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import sampling
from kiln.operators.ranking import partition_sizes
from kiln.plans.constants import SEED
from kiln.plans.registry import register
from kiln.plans.sqltext import sql_seeded_hash32, sql_seeded_uniform
from kiln.sources import image_table

KEY = sql_seeded_hash32(SEED, "vec_id")
SHARD4 = f"({sql_seeded_hash32(SEED, repr('shard'), 'vec_id')} % 4)"
U_SPLIT = sql_seeded_uniform(SEED, repr("split"), "vec_id")
HOLDOUT = 100


@register("shuffle_rank", f"""
SELECT vec_id AS id, CAST(row_number() OVER (ORDER BY {KEY}, vec_id) AS BIGINT) AS rank FROM embeddings
""")
def q_shuffle_rank(spark, sf_dir):
    return sampling.shuffle_rank(image_table(spark, sf_dir).select("id"), SEED, "id")


@register("split_fraction", f"""
SELECT vec_id AS id, CASE WHEN {U_SPLIT} < 0.7 THEN 'train' ELSE 'test' END AS split FROM embeddings
""")
def q_split_fraction(spark, sf_dir):
    df = image_table(spark, sf_dir).select("id")
    return sampling.split_fraction(df, SEED, "id", [0.7, 0.3], ["train", "test"])


@register("dataset_split_counts", f"""
SELECT CASE WHEN {U_SPLIT} < 0.8 THEN 'train' ELSE 'test' END AS split, CAST(label AS BIGINT) AS label,
       count(*) AS n
FROM embeddings GROUP BY 1, 2
""")
def q_dataset_split_counts(spark, sf_dir):
    df = sampling.split_fraction(image_table(spark, sf_dir), SEED, "id", [0.8, 0.2], ["train", "test"])
    return df.groupBy("split", F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("split_exact", f"""
SELECT vec_id AS id,
       CASE WHEN row_number() OVER (ORDER BY {sql_seeded_hash32(SEED, repr('split'), 'vec_id')}, vec_id) <= {HOLDOUT}
            THEN 'validation' ELSE 'train' END AS split
FROM embeddings
""")
def q_split_exact(spark, sf_dir):
    return sampling.split_exact(image_table(spark, sf_dir).select("id"), SEED, "id", HOLDOUT)


@register("minibatch_assign", f"""
WITH k AS (SELECT vec_id, {KEY} AS key, {SHARD4} AS shard FROM embeddings),
     r AS (SELECT vec_id, shard, row_number() OVER (PARTITION BY shard ORDER BY key, vec_id) AS rn,
                  count(*) OVER (PARTITION BY shard) AS n FROM k)
SELECT vec_id AS id, CAST(shard AS BIGINT) AS shard, CAST((rn - 1) // 16 AS BIGINT) AS batch
FROM r WHERE (rn - 1) // 16 < n // 16
""")
def q_minibatch_assign(spark, sf_dir):
    df = image_table(spark, sf_dir).select("id")
    df = sampling.hash_shard(sampling.with_shuffle_key(df, SEED, "id", "key"), SEED, "id", 4)
    out = sampling.assign_minibatches(df, 16, ["key", "id"], "shard", drop_last=True)
    return out.select("id", F.col("shard").cast("bigint").alias("shard"), "batch")


@register("batch_sequential", f"""
WITH v AS (
  SELECT vec_id FROM embeddings
  QUALIFY row_number() OVER (ORDER BY {sql_seeded_hash32(SEED, repr('split'), 'vec_id')}, vec_id) <= {HOLDOUT}
), r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n FROM v)
SELECT vec_id AS id, CAST((rn - 1) // 16 AS BIGINT) AS batch FROM r WHERE (rn - 1) // 16 < n // 16
""")
def q_batch_sequential(spark, sf_dir):
    df = sampling.split_exact(image_table(spark, sf_dir).select("id"), SEED, "id", HOLDOUT)
    val = df.filter(F.col("split") == "validation").select("id")
    return sampling.assign_minibatches(val, 16, ["id"], None, drop_last=True).select("id", "batch")


@register("reshuffle_rounds", f"""
SELECT vec_id AS id, CAST(round AS INTEGER) AS round,
       CAST({sql_seeded_hash32(SEED, repr('shard'), 'round', 'vec_id')} % 4 AS BIGINT) AS shard
FROM (SELECT vec_id, unnest(range(4)) AS round FROM embeddings)
""")
def q_reshuffle_rounds(spark, sf_dir):
    df = image_table(spark, sf_dir).select("id")
    out = sampling.reshuffle_rounds(df, SEED, "id", 4, 4)
    return out.select("id", "round", F.col("shard").cast("bigint").alias("shard"))


@register("label_skew_buckets", """
SELECT CAST(label % 4 AS BIGINT) AS bucket, CAST(label AS BIGINT) AS label, count(*) AS n
FROM embeddings GROUP BY 1, 2
""")
def q_label_skew_buckets(spark, sf_dir):
    df = image_table(spark, sf_dir)
    return (df.groupBy(F.pmod("label", F.lit(4)).cast("bigint").alias("bucket"),
                       F.col("label").cast("bigint").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


# Spark's hash partitioner: partition = pmod(murmur3_x86_32(label, seed 42), n).
# fixed values: the public Murmur3 x86_32 constants (c1, c2, the h1 step
# addend, the two finaliser multipliers) and Spark's hash seed 42
LABEL_SKEW_SQL = """
WITH s0 AS (SELECT label, ((CAST(label AS HUGEINT) & 4294967295) * 3432918353) & 4294967295 AS k FROM embeddings),
     s1 AS (SELECT label, ((((k << 15) | (k >> 17)) & 4294967295) * 461845907) & 4294967295 AS k FROM s0),
     s2 AS (SELECT label, xor(CAST(42 AS HUGEINT), k) AS h FROM s1),
     s3 AS (SELECT label, ((((h << 13) | (h >> 19)) & 4294967295) * 5 + 3864292196) & 4294967295 AS h FROM s2),
     s4 AS (SELECT label, xor(h, CAST(4 AS HUGEINT)) AS h FROM s3),
     s5 AS (SELECT label, (xor(h, h >> 16) * 2246822507) & 4294967295 AS h FROM s4),
     s6 AS (SELECT label, (xor(h, h >> 13) * 3266489909) & 4294967295 AS h FROM s5),
     s7 AS (SELECT label, xor(h, h >> 16) AS h FROM s6),
     p AS (SELECT label, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS sh FROM s7)
SELECT CAST(((sh % 4) + 4) % 4 AS INTEGER) AS partition, label, count(*) AS n FROM p GROUP BY 1, 2
"""


@register("label_skew", LABEL_SKEW_SQL)
def q_label_skew(spark, sf_dir):
    """The reference's skewed layout, ``repartition(4, label)``: label
    histogram per physical partition (empty partitions are legal)."""
    df = image_table(spark, sf_dir).repartition(4, "label")
    return (df.groupBy(F.spark_partition_id().alias("partition"), "label")
            .agg(F.count(F.lit(1)).alias("n")))


@register("partition_balance")
def q_partition_balance(spark, sf_dir):
    """``repartition(8)``: rows per partition (round-robin, within one row)."""
    return partition_sizes(image_table(spark, sf_dir).repartition(8))


@register("partition_balance_bounds", """
SELECT 8 AS partitions, count(*) AS n, true AS even FROM embeddings
""")
def q_partition_balance_bounds(spark, sf_dir):
    """``repartition(8)``: partitions, rows, and whether sizes differ by at
    most one row for each input partition."""
    df = image_table(spark, sf_dir)
    inputs = df.select(F.spark_partition_id().alias("p")).distinct().count()
    sizes = partition_sizes(df.repartition(8))
    return sizes.agg(F.count(F.lit(1)).cast("int").alias("partitions"), F.sum("n").alias("n"),
                     (F.max("n") - F.min("n") <= inputs).alias("even"))


@register("skew_report", """
WITH h AS (SELECT label % 4 AS bucket, label, count(*) AS n FROM embeddings GROUP BY 1, 2)
SELECT CAST(bucket AS BIGINT) AS bucket, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_labels,
       round(max(n) / sum(n), 6) AS max_label_share
FROM h GROUP BY bucket
""")
def q_skew_report(spark, sf_dir):
    df = image_table(spark, sf_dir).withColumn("bucket", F.pmod("label", F.lit(4)).cast("bigint"))
    h = df.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("bucket").agg(F.sum("n").cast("bigint").alias("n_rows"),
                                   F.count(F.lit(1)).alias("n_labels"),
                                   F.round(F.max("n") / F.sum("n"), 6).alias("max_label_share"))


@register("batch_plan", f"""
WITH t AS (SELECT vec_id, {SHARD4} AS shard FROM embeddings WHERE {U_SPLIT} < 0.8),
     c AS (SELECT shard, count(*) AS n_rows FROM t GROUP BY shard)
SELECT CAST(shard AS BIGINT) AS shard, n_rows, CAST(n_rows // 64 AS BIGINT) AS n_batches,
       CAST((n_rows // 64) * 64 AS BIGINT) AS rows_used, CAST(n_rows - (n_rows // 64) * 64 AS BIGINT) AS rows_dropped
FROM c
""")
def q_batch_plan(spark, sf_dir):
    df = sampling.split_fraction(image_table(spark, sf_dir).select("id"), SEED, "id", [0.8, 0.2],
                                 ["train", "test"])
    train = sampling.hash_shard(df.filter(F.col("split") == "train"), SEED, "id", 4)
    out = sampling.batch_plan(train, 64)
    return out.withColumn("shard", F.col("shard").cast("bigint"))
