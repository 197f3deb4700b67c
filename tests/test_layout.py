"""Tasks keep their share when the input grows: shuffles sized by rows,
inputs of many readers written once, stream files sized by bytes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import graph, layout, pic
from kiln.plans import extras


def tables(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 3000
    lines = [(int(o), int(p), int(s), i % 4) for i, (o, p, s) in
             enumerate(zip(rng.integers(1, 400, n), rng.integers(1, 300, n), rng.integers(1, 40, n)))]
    (spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
     .withColumn("l_shipdate", F.lit("2020-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet"))
    (spark.createDataFrame([(o, o % 50) for o in range(1, 400)], "o_orderkey long, o_custkey long")
     .write.parquet(f"{tmp_path}/orders.parquet"))
    return str(tmp_path)


def test_shuffles_are_sized_by_rows_and_given_back(spark, monkeypatch):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    own = [spark.conf.get(k) for k in names]
    monkeypatch.setattr(layout, "PARTITION_ROWS", 10)
    with pytest.raises(KeyError):
        with layout.sized_shuffles(spark, 995):
            assert [spark.conf.get(k) for k in names] == ["100", "false"]
            assert spark.range(995).groupBy((F.col("id") % 500).alias("m")).count().rdd.getNumPartitions() == 100
            raise KeyError
    assert [spark.conf.get(k) for k in names] == own
    with layout.sized_shuffles(spark, 5):
        assert [spark.conf.get(k) for k in names] == own
    assert layout.dealt(spark.range(500), 500, "id").rdd.getNumPartitions() == 50


def test_graphs_lay_out_a_share_a_task_and_give_the_same(spark, tmp_path, monkeypatch):
    sf = tables(spark, tmp_path)
    queries = (extras.q_pagerank_k, extras.q_pic_steps)
    whole = [sorted(map(tuple, q(spark, sf).collect())) for q in queries]
    counts = []

    def hub_layout(edges, degrees, total, partitions):
        counts.append((partitions, total))
        return before(edges, degrees, total, partitions)
    before = graph.hub_layout
    monkeypatch.setattr(graph, "hub_layout", hub_layout)
    monkeypatch.setattr(pic, "hub_layout", hub_layout)
    monkeypatch.setattr(layout, "PARTITION_ROWS", 200)
    parts = [sorted(map(tuple, q(spark, sf).collect())) for q in queries]
    assert parts == whole
    assert len(counts) == 2 and all(total / partitions <= 200 for partitions, total in counts)
    w = extras.weighted_edges(spark.read.parquet(f"{sf}/lineitem.parquet"))
    assert w.agg(F.sum("weight")).first()[0] == 3000 and w.groupBy("src", "dst").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("name", ["als", "pic"])
def test_fits_read_written_tables(spark, tmp_path, monkeypatch, name):
    """The fit's input has no join or grouping left to run again."""
    sf, plans = tables(spark, tmp_path), []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
    if name == "als":
        fit = extras.recommend.als_fit
        monkeypatch.setattr(extras.recommend, "als_fit", lambda r, **k: (seen(r), fit(r, **k))[1])
        assert extras.q_als_recommend(spark, sf).count() == 50
    else:
        power = extras.PowerIterationClustering
        monkeypatch.setattr(power, "assignClusters", lambda self, w: (seen(w), w.selectExpr("src id", "0 cluster"))[1])
        extras.q_pic_clusters(spark, sf).count()
    assert len(plans) == 1 and "Join" not in plans[0] and "Aggregate" not in plans[0]


def test_stream_files_are_sized_by_bytes(spark, tmp_path, monkeypatch):
    from kiln.streaming import sentiment
    docs = [(i, f"good day {i}" if i % 2 else "bad day" if i % 3 else None) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    want = {r["doc_id"]: (r["score"], r["n_matched"]) for r in extras.q_sentiment_score(spark, str(tmp_path)).collect()}
    seen, run = [], sentiment.run_sentiment_stream

    def watched(spark, src, *rest, **more):
        files = [f for f in os.listdir(src.replace("file:", "")) if f.endswith(".parquet")]
        out = run(spark, src, *rest, **more)
        seen.append((len(files), more["files_per_trigger"], out.select("batch_id").distinct().count()))
        return out
    monkeypatch.setattr(sentiment, "run_sentiment_stream", watched)
    monkeypatch.setattr(extras, "STREAM_FILE_BYTES", 50)
    got = {r["doc_id"]: (r["score"], r["n_matched"]) for r in extras.q_sentiment_stream(spark, str(tmp_path)).collect()}
    assert got == want and any(s for s, _ in want.values())
    files, each, batches = seen[0]
    assert files > 12 and each >= 4 and batches <= 4
