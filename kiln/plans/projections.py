"""Projections, reshapes, scaling and fixed-weight scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import arrays
from kiln.operators import features
from kiln.plans.constants import CLS_B, CLS_W, IMAGE_SIDE, LIN_B, LIN_W
from kiln.plans.registry import register
from kiln.plans.sqltext import sql_affine, sql_argmax, sql_dot, sql_log_softmax
from kiln.sources import image_table, read_table


def class_scores(df, col="features"):
    return arrays.affine(col, CLS_W, CLS_B)


def with_class_scores(df, col="features", out="scores"):
    """Scores as their own projected column: expressions that use the score
    array several times (argmax, log-softmax) then reference it instead of
    re-evaluating the affine map (Catalyst keeps the projections apart when
    collapsing them would duplicate non-cheap work)."""
    return df.withColumn(out, arrays.affine(col, CLS_W, CLS_B))


SQL_SCORES = sql_affine("embedding", CLS_W, CLS_B)


@register("project_slice", """
SELECT l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
""")
def q_project_slice(spark, sf_dir):
    # lineitem.columns[1:5]
    return features.project_slice(read_table(spark, sf_dir, "lineitem"), 1, 5)


@register("assemble_features", """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS f0, p_retailprice AS f1 FROM part
""")
def q_assemble_features(spark, sf_dir):
    df = features.assemble(read_table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    arr = features.vector_as_array("features")
    return df.select("p_partkey", arr[0].alias("f0"), arr[1].alias("f1"))


@register("reshape_grid", f"""
WITH g AS (
  SELECT vec_id, r, list_slice(embedding, r * {IMAGE_SIDE} + 1, r * {IMAGE_SIDE} + {IMAGE_SIDE}) AS row_vals
  FROM embeddings, (SELECT unnest(range({IMAGE_SIDE})) AS r) rr
)
SELECT vec_id AS id, CAST(r AS BIGINT) AS r,
       round(list_sum(CAST(row_vals AS DOUBLE[])), 6) AS row_sum,
       CAST(list_max(row_vals) AS DOUBLE) AS row_max,
       true AS roundtrip_ok
FROM g
""")
def q_reshape_grid(spark, sf_dir):
    df = image_table(spark, sf_dir)
    grid = df.select("id", "features", features.reshape_grid("features", IMAGE_SIDE).alias("grid"))
    ok = features.flatten_grid("grid") == F.col("features")
    return (grid.select("id", ok.alias("roundtrip_ok"), F.posexplode("grid").alias("r", "row_vals"))
            .select("id", F.col("r").cast("bigint").alias("r"),
                    F.round(arrays.array_sum("row_vals"), 6).alias("row_sum"),
                    F.array_max("row_vals").cast("double").alias("row_max"),
                    "roundtrip_ok"))


@register("scale_minmax", """
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v,
                  unnest(range(len(embedding))) AS pos FROM embeddings),
     s AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM e GROUP BY pos)
SELECT e.vec_id AS id, CAST(e.pos AS BIGINT) AS pos, round(e.v / 255.0, 9) AS scaled,
       round(CASE WHEN s.hi = s.lo THEN 0.5 ELSE (e.v - s.lo) / (s.hi - s.lo) END, 6) AS minmax
FROM e JOIN s USING (pos)
""")
def q_scale_minmax(spark, sf_dir):
    df = image_table(spark, sf_dir)
    mins, maxs = features.fit_minmax(df, "features")
    out = features.scale_constant(df, "features", 255.0, out="scaled")
    out = features.apply_minmax(out, "features", mins, maxs, out="minmax")
    z = F.arrays_zip(F.col("scaled").alias("scaled"), F.col("minmax").alias("minmax"))
    return (out.select("id", F.posexplode(z).alias("pos", "z"))
            .select("id", F.col("pos").cast("bigint").alias("pos"),
                    F.round("z.scaled", 9).alias("scaled"), F.round("z.minmax", 6).alias("minmax")))


@register("normalize_features", """
SELECT vec_id AS id, CAST(pos AS BIGINT) AS pos, round((CAST(v AS DOUBLE) - 0.5) / 0.5, 6) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
""")
def q_normalize_features(spark, sf_dir):
    df = features.normalize(image_table(spark, sf_dir), "features", 0.5, 0.5)
    return (df.select("id", F.posexplode("features").alias("pos", "v"))
            .select("id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("value")))


@register("score_linear", f"""
SELECT vec_id AS id, round({sql_dot('embedding', LIN_W)} + {LIN_B!r}, 6) AS score FROM embeddings
""")
def q_score_linear(spark, sf_dir):
    df = image_table(spark, sf_dir)
    return df.select("id", F.round(arrays.dot("features", arrays.lit_array(LIN_W)) + F.lit(LIN_B), 6)
                     .alias("score"))


@register("argmax_class", f"""
WITH s AS (SELECT vec_id, {SQL_SCORES} AS scores FROM embeddings)
SELECT vec_id AS id, {sql_argmax('scores')} AS prediction FROM s
""")
def q_argmax_class(spark, sf_dir):
    df = with_class_scores(image_table(spark, sf_dir))
    return df.select("id", arrays.argmax("scores").alias("prediction"))


@register("log_softmax_scores", f"""
WITH s AS (SELECT vec_id, {SQL_SCORES} AS scores FROM embeddings),
     l AS (SELECT vec_id, {sql_log_softmax('scores')} AS logp FROM s)
SELECT vec_id AS id, CAST(k AS BIGINT) AS class, round(lp, 6) AS logp
FROM (SELECT vec_id, unnest(logp) AS lp, unnest(range(len(logp))) AS k FROM l)
""")
def q_log_softmax_scores(spark, sf_dir):
    df = with_class_scores(image_table(spark, sf_dir))
    lp = arrays.log_softmax("scores")
    return (df.select("id", F.posexplode(lp).alias("class", "lp"))
            .select("id", F.col("class").cast("bigint").alias("class"), F.round("lp", 6).alias("logp")))


@register("relu_hidden", f"""
SELECT vec_id AS id, round(list_sum(list_transform({SQL_SCORES}, lambda v: greatest(v, 0.0))), 6) AS relu_sum
FROM embeddings
""")
def q_relu_hidden(spark, sf_dir):
    df = image_table(spark, sf_dir)
    return df.select("id", F.round(arrays.array_sum(arrays.relu(class_scores(df))), 6).alias("relu_sum"))
