"""A1-A7 and the helper aggregates: metrics and losses as aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import arrays
from kiln.functions.hashing import seeded_hash32
from kiln.functions.text import token_count
from kiln.operators import metrics, sampling
from kiln.plans.constants import LIN_B, LIN_W, SEED, SVM_REG
from kiln.plans.projections import SQL_SCORES, with_class_scores
from kiln.plans.registry import register
from kiln.plans.sqltext import sql_argmax, sql_dot, sql_log_softmax, sql_seeded_hash32, sql_seeded_uniform
from kiln.sources import image_table, read_table

U_SPLIT = sql_seeded_uniform(SEED, repr("split"), "vec_id")
SQL_SPLIT80 = f"CASE WHEN {U_SPLIT} < 0.8 THEN 'train' ELSE 'test' END"

# documents as a small regression problem: words/1000 -> n_chars/10000
SQL_X = "(len(string_split(text, ' ')) / 1000.0)"
SQL_Y = "(n_chars / 10000.0)"
FIXED_SLOPE, FIXED_INTERCEPT = 0.6, 0.01


def doc_xy(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", (token_count("text", " ") / 1000.0).alias("x"),
                    (F.col("n_chars") / 10000.0).alias("y"))


def scored_images(spark, sf_dir):
    """Fixed-weight softmax classifier over the 80/20 split of embeddings."""
    df = sampling.split_fraction(image_table(spark, sf_dir), SEED, "id", [0.8, 0.2], ["train", "test"])
    df = with_class_scores(df)
    return df.select("id", "label", "split", arrays.argmax("scores").alias("prediction"),
                     arrays.log_softmax("scores").alias("logp"))


SQL_SCORED = f"""
WITH s AS (SELECT vec_id, label, {SQL_SPLIT80} AS split, {SQL_SCORES} AS scores FROM embeddings),
     p AS (SELECT vec_id, label, split, {sql_argmax('scores')} AS prediction,
                  {sql_log_softmax('scores')} AS logp FROM s)
"""


def _rollup_split(df, *aggs):
    return (df.rollup("split").agg(*aggs)
            .withColumn("split", F.coalesce(F.col("split"), F.lit("all"))))


@register("metric_accuracy", SQL_SCORED + """
SELECT coalesce(split, 'all') AS split, round(avg(CAST(prediction = label AS DOUBLE)), 6) AS accuracy,
       count(*) AS n
FROM p GROUP BY ROLLUP (split)
""")
def q_metric_accuracy(spark, sf_dir):
    p = scored_images(spark, sf_dir)
    return _rollup_split(p, F.round(metrics.accuracy_expr("label", "prediction"), 6).alias("accuracy"),
                         F.count(F.lit(1)).alias("n"))


@register("loss_cross_entropy", SQL_SCORED + """
SELECT coalesce(split, 'all') AS split, round(avg(-logp[label + 1]), 6) AS loss, count(*) AS n
FROM p GROUP BY ROLLUP (split)
""")
def q_loss_cross_entropy(spark, sf_dir):
    p = scored_images(spark, sf_dir)
    return _rollup_split(p, F.round(F.avg(metrics.cross_entropy_expr("logp", "label")), 6).alias("loss"),
                         F.count(F.lit(1)).alias("n"))


@register("confusion_matrix", SQL_SCORED + """
SELECT CAST(label AS BIGINT) AS label, prediction, count(*) AS n FROM p GROUP BY 1, 2
""")
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(scored_images(spark, sf_dir), "label", "prediction")


@register("feature_stats", """
SELECT CAST(pos AS BIGINT) AS pos, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n
FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
GROUP BY pos
""")
def q_feature_stats(spark, sf_dir):
    st = metrics.feature_stats(image_table(spark, sf_dir), "features")
    return st.select(F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"),
                     F.round("std", 6).alias("std"), "n")


@register("loss_hinge", f"""
SELECT round(avg(greatest(0.0, 1.0 - (CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END)
                 * ({sql_dot('embedding', LIN_W)} + {LIN_B!r})))
             + {SVM_REG / 2 * sum(w * w for w in LIN_W)!r}, 6) AS objective,
       count(*) AS n
FROM embeddings
""")
def q_loss_hinge(spark, sf_dir):
    df = image_table(spark, sf_dir)
    score = arrays.dot("features", arrays.lit_array(LIN_W)) + F.lit(LIN_B)
    y01 = (F.col("label") < 5).cast("int")
    penalty = SVM_REG / 2 * sum(w * w for w in LIN_W)
    return df.agg(F.round(F.avg(metrics.hinge_expr(score, y01)) + F.lit(penalty), 6).alias("objective"),
                  F.count(F.lit(1)).alias("n"))


@register("loss_mse", f"""
SELECT round(avg(pow({FIXED_SLOPE!r} * {SQL_X} + {FIXED_INTERCEPT!r} - {SQL_Y}, 2)), 6) AS mse, count(*) AS n
FROM documents
""")
def q_loss_mse(spark, sf_dir):
    d = doc_xy(spark, sf_dir)
    pred = F.lit(FIXED_SLOPE) * F.col("x") + F.lit(FIXED_INTERCEPT)
    return d.agg(F.round(F.avg(metrics.mse_expr(pred, "y")), 6).alias("mse"), F.count(F.lit(1)).alias("n"))


def fit_ols_1d(df, x="x", y="y"):
    """Closed-form simple regression; the model is two numbers."""
    r = df.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")).first()
    return float(r["a"]), float(r["b"])


SQL_OLS = f"""
WITH d AS (SELECT doc_id, {SQL_X} AS x, {SQL_Y} AS y FROM documents),
     m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d),
     p AS (SELECT d.doc_id, d.y, m.a * d.x + m.b AS pred FROM d, m)
"""


@register("metric_regression", SQL_OLS + """
SELECT round(avg(pow(y - pred, 2)), 6) AS mse, round(sqrt(avg(pow(y - pred, 2))), 6) AS rmse,
       round(1 - avg(pow(y - pred, 2)) / var_pop(y), 6) AS r2, count(*) AS n
FROM p
""")
def q_metric_regression(spark, sf_dir):
    d = doc_xy(spark, sf_dir)
    a, b = fit_ols_1d(d)
    p = d.withColumn("pred", F.lit(a) * F.col("x") + F.lit(b))
    m = metrics.regression_metrics(p, "y", "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in ("mse", "rmse", "r2")], "n")


@register("residuals", SQL_OLS + """
SELECT doc_id, round(y - pred, 6) AS residual FROM p
""")
def q_residuals(spark, sf_dir):
    d = doc_xy(spark, sf_dir)
    a, b = fit_ols_1d(d)
    p = metrics.residuals(d.withColumn("pred", F.lit(a) * F.col("x") + F.lit(b)), "y", "pred")
    return p.select("doc_id", F.round("residual", 6).alias("residual"))


EPOCHS, EPOCH_SHARDS, EPOCH_BATCH = 3, 4, 32


@register("epoch_metrics", f"""
WITH e AS (
  SELECT vec_id, label, round AS epoch,
         {sql_seeded_hash32(SEED, repr('shard'), 'round', 'vec_id')} % {EPOCH_SHARDS} AS shard,
         {sql_seeded_hash32(SEED, 'round', 'vec_id')} AS key,
         {SQL_SCORES} AS scores
  FROM (SELECT *, unnest(range({EPOCHS})) AS round FROM embeddings)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY epoch, shard ORDER BY key, vec_id) AS rn,
         count(*) OVER (PARTITION BY epoch, shard) AS cnt FROM e
), b AS (
  SELECT epoch, shard, (rn - 1) // {EPOCH_BATCH} AS batch,
         avg(-({sql_log_softmax('scores')})[label + 1]) AS loss,
         avg(CAST({sql_argmax('scores')} = label AS DOUBLE)) AS acc, count(*) AS n
  FROM r WHERE (rn - 1) // {EPOCH_BATCH} < cnt // {EPOCH_BATCH} GROUP BY 1, 2, 3
)
SELECT CAST(epoch AS INTEGER) AS epoch, 'train' AS split, round(sum(loss * n) / sum(n), 6) AS loss,
       round(sum(acc * n) / sum(n), 6) AS acc, CAST(sum(n) AS BIGINT) AS n
FROM b GROUP BY epoch
""")
def q_epoch_metrics(spark, sf_dir):
    """Per-step (batch) loss/accuracy of a fixed model over reshuffled
    epochs with drop_last, reduced to per-epoch means."""
    # score every row once, before the epoch expansion: only two scalars
    # per row travel through the shuffle, not the feature array
    df = with_class_scores(image_table(spark, sf_dir))
    df = df.select("id", metrics.cross_entropy_expr(arrays.log_softmax("scores"), "label").alias("l"),
                   (arrays.argmax("scores") == F.col("label")).cast("double").alias("c"))
    r = sampling.reshuffle_rounds(df, SEED, "id", EPOCHS, EPOCH_SHARDS, round_col="epoch")
    r = r.withColumn("key", seeded_hash32(SEED, "epoch", "id"))
    b = sampling.assign_minibatches(r, EPOCH_BATCH, ["key", "id"], ["epoch", "shard"], drop_last=True)
    steps = (b.groupBy("epoch", "shard", "batch")
             .agg(F.avg("l").alias("loss"), F.avg("c").alias("acc"), F.count(F.lit(1)).alias("n"))
             .withColumn("split", F.lit("train")))
    out = metrics.epoch_metrics(steps)
    return out.select("epoch", "split", F.round("loss", 6).alias("loss"), F.round("acc", 6).alias("acc"), "n")
