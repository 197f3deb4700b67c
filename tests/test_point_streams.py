"""Labelled test points against a numpy replay, malformed lines, restarts."""

import numpy as np
import pytest

from kiln.operators.clustering import streaming_update
from kiln.session import scratch_path
from kiln.streaming.kmeans import StreamingKMeans
from kiln.streaming.scoring import newest_centres, parse_points, run_point_stream, write_points


def test_points_are_parsed_and_bad_lines_have_no_label(spark):
    # fixed values: the form of the sample file's lines
    good = ["(1.0), [1.7, 0.4, 0.9]", "(2.0), [2.2, 1.8, 0.0]", " ( -3e1 ) , [1,2,3 ] "]
    bad = ["", "1.0, [1, 2, 3]", "(1.0) [1, 2, 3]", "(x), [1, 2, 3]", "(1.0), [1, 2]", "(1.0), [1, 2, 3, 4]", "(1.0), []",
           "(1.0), [1, , 3]", "(NaN), [1, 2, 3]", "(1), [1, 2, Infinity]", "(1), [1, 2, 3] x", None]
    df = spark.createDataFrame([(v,) for v in good + bad], "value string")
    rows = [(r["label"], r["features"]) for r in parse_points(df, 3).collect()]
    assert rows[:3] == [(1.0, [1.7, 0.4, 0.9]), (2.0, [2.2, 1.8, 0.0]), (-30.0, [1.0, 2.0, 3.0])]
    assert rows[3:] == [(None, None)] * len(bad)


def nearest(x, c):
    return ((x[:, None, :] - c) ** 2).sum(axis=2).argmin(axis=1)


def test_confusion_equals_a_replay_over_restarts(spark):
    rng = np.random.default_rng(4)
    centres, weights = np.array([[0.0, 0.0], [4.0, 4.0], [9.0, 0.0]]), np.zeros(3)
    start = centres.copy()
    source, lines, state, sink, c1, c2 = (scratch_path(spark, f"t-points{i}") for i in range(6))
    want, schema = {}, "id long, features array<double>"
    for i in range(3):
        x = rng.normal(size=(80, 2)) + centres[rng.integers(0, 3, 80)]
        own = nearest(x, centres)
        sums = np.array([x[own == j].sum(axis=0) for j in range(3)])
        centres, weights = streaming_update(centres, weights, sums, np.bincount(own, minlength=3), 0.5)
        test = rng.normal(size=(40, 2)) * 3 + 4
        labels = rng.integers(0, 4, 40)
        for label, cluster in zip(labels, nearest(test, centres)):
            key = (i, float(label), int(cluster))
            want[key] = want.get(key, 0) + 1
        want[i, None, None] = 1
        spark.createDataFrame([(j, [float(v) for v in row]) for j, row in enumerate(x)], schema).write.mode("append").parquet(source)
        StreamingKMeans(start, decay=0.5).run(spark, source, spark.createDataFrame([], schema).schema, state, c1, files_per_trigger=10 ** 6)
        table = spark.createDataFrame([(int(a), [float(v) for v in row]) for a, row in zip(labels, test)],
                                      "label int, features array<double>").repartition(2)
        write_points(table, lines)
        spark.createDataFrame([("not a point",)], "value string").write.mode("append").text(lines)
        out = run_point_stream(spark, lines, state, sink, c2)
        assert np.allclose(newest_centres(spark, state)[1], centres)
    got = {(r["batch_id"], r["label"], r["cluster"]): r["n"] for r in out.collect()}
    assert got == want
    assert {(r["batch_id"], r["centres_batch"]) for r in out.collect()} == {(0, 0), (1, 1), (2, 2)}
    # a batch whose table is written but not committed is not scored again
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{c2}/commits/2")
    assert log.getFileSystem(spark._jsc.hadoopConfiguration()).delete(log, False)
    (spark.createDataFrame([(0, 1.0, [50.0, 50.0], 0)], "cluster int, weight double, centre array<double>, base long")
     .write.parquet(f"{state}/batch_id=7"))
    again = run_point_stream(spark, lines, state, sink, c2)
    assert {(r["batch_id"], r["label"], r["cluster"]): r["n"] for r in again.collect()} == want


def test_no_centres_is_an_error(spark):
    state = scratch_path(spark, "t-points-none")
    spark.createDataFrame([], "cluster int, weight double, centre array<double>, base long, batch_id int").write.parquet(state)
    with pytest.raises(ValueError, match="no centres"):
        newest_centres(spark, state)
