"""streaming k-means with labelled test points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kiln.plans.registry import register
from kiln.session import scratch_path
from kiln.sources import image_table
from kiln.streaming.kmeans import StreamingKMeans
from kiln.streaming.scoring import run_point_stream, write_points

ARRIVALS = 4
DECAY = 0.9
TEST_EVERY = 5   # of the ids: a test point


def _confusion_sql() -> str:
    """The decayed updates, unrolled over the arrivals."""
    def nearest(name, rows, centres):
        return f"""{name} AS (SELECT vec_id, label, cluster FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS rn FROM (
        SELECT x.vec_id, x.label, c.cluster, sum(pow(x.v - c.m, 2)) AS d2
        FROM ({rows}) x JOIN {centres} c ON x.pos = c.pos GROUP BY ALL)) WHERE rn = 1)"""
    parts = [f"""x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos,
             vec_id * {ARRIVALS} // (SELECT max(vec_id) + 1 FROM embeddings) AS arrival, vec_id % {TEST_EVERY} = 0 AS test
      FROM embeddings)""",
             """c0 AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS cluster, pos, v AS m, CAST(0 AS DOUBLE) AS w FROM x
      WHERE vec_id IN (SELECT min(vec_id) FROM x WHERE NOT test GROUP BY label))"""]
    for i in range(ARRIVALS):
        parts.append(nearest(f"a{i}", f"SELECT * FROM x WHERE NOT test AND arrival = {i}", f"c{i}"))
        parts.append(f"""s{i} AS (SELECT cluster, pos, sum(v) AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id) GROUP BY 1, 2)""")
        parts.append(f"""c{i + 1} AS (SELECT c.cluster, c.pos, w * {DECAY} + coalesce(n, 0) AS w,
             CASE WHEN w * {DECAY} + coalesce(n, 0) > 0
                  THEN (m * (w * {DECAY}) + coalesce(s, 0)) / (w * {DECAY} + coalesce(n, 0)) ELSE m END AS m
      FROM c{i} c LEFT JOIN s{i} s ON s.cluster = c.cluster AND s.pos = c.pos)""")
        parts.append(nearest(f"t{i}", f"SELECT * FROM x WHERE test AND arrival = {i}", f"c{i + 1}"))
    union = "\nUNION ALL ".join(f"SELECT {i} AS batch_id, * FROM t{i}" for i in range(ARRIVALS))
    return ("WITH " + ",\n".join(parts) + f"""
SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(label AS DOUBLE) AS label, CAST(cluster AS INTEGER) AS cluster,
       count(*) AS n, CAST(batch_id AS BIGINT) AS centres_batch
FROM ({union}) GROUP BY ALL""")


@register("stream_kmeans_confusion", _confusion_sql())
def q_stream_kmeans_confusion(spark, sf_dir):
    """Centres trained by one stream, test points scored by another: per
    arrival the points of each label in each cluster.  Both streams are
    started anew for every arrival and go on from their state."""
    points = image_table(spark, sf_dir).select("id", "label", F.col("features").cast("array<double>").alias("features"))
    n = points.agg(F.max("id") + 1).first()[0] or 1
    points = points.withColumn("arrival", F.expr(f"id * {ARRIVALS} div {n}"))
    train = points.filter(F.col("id") % TEST_EVERY != 0).select("id", "label", "features", "arrival")
    # one point a label
    first = train.groupBy("label").agg(F.min_by("features", "id").alias("features")).orderBy("label").collect()
    source, lines, state, sink, c1, c2 = (scratch_path(spark, f"points{x}") for x in ("train", "test", "state", "sink", "c1", "c2"))
    out, schema = None, train.select("id", "features").schema
    for i in range(ARRIVALS):
        now = F.col("arrival") == i
        train.filter(now).select("id", "features").write.mode("append").parquet(source)
        StreamingKMeans(np.array([r["features"] for r in first]), decay=DECAY).run(
            spark, source, schema, state, c1, files_per_trigger=1_000_000)
        write_points(points.filter(now & (F.col("id") % TEST_EVERY == 0)), lines)
        out = run_point_stream(spark, lines, state, sink, c2)
    return out.select("batch_id", "label", "cluster", "n", "centres_batch")
