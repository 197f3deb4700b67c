"""Pipeline persistence, scoring and event-log reading."""

import json
import os

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from conftest import SF01
from kiln.models import LinearNet
from kiln.operators.estimators import MinibatchModel
from kiln.plans.training import image_pipeline
from kiln.session import scratch_path
from kiln.sources import eventlog, image_table


def test_pipeline_save_load_predicts_the_same(spark):
    df = image_table(spark, SF01)
    fitted = image_pipeline(partitions=2, iters=2, batch=32, model=LinearNet(64, 10, "classification").config(),
                            lr=0.5, storage="cache").fit(df)
    path = scratch_path(spark, "t-pipe")
    fitted.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert isinstance(loaded.stages[-1], MinibatchModel)
    assert np.allclose(loaded.stages[-1].weights, fitted.stages[-1].weights)
    a = fitted.transform(df).select("id", F.col("prediction").alias("a"))
    b = loaded.transform(df).select("id", F.col("prediction").alias("b"))
    assert a.join(b, "id").filter(F.col("a") != F.col("b")).count() == 0
    assert a.count() == df.count()


def test_scoring_matches_numpy(spark):
    df = image_table(spark, SF01)
    fitted = image_pipeline(partitions=2, iters=1, batch=32, model=LinearNet(64, 10, "classification").config(),
                            lr=0.5, storage="cache").fit(df)
    model = fitted.stages[-1]
    rows = fitted.transform(df).select("scaled", "prediction").collect()
    X = np.array([r["scaled"] for r in rows])
    net = LinearNet(64, 10, "classification")
    want = net.scores(model.weights, X).argmax(axis=1)
    assert np.array_equal(want, np.array([r["prediction"] for r in rows]))


def test_stage_summary_reads_listener_events(spark):
    path = scratch_path(spark, "t-events").replace("file:", "")
    os.makedirs(path)
    events = [
        {"Event": "SparkListenerLogStart", "Spark Version": "4.1.2"},
        {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 3, "Stage Attempt ID": 0,
                                                               "Stage Name": "collect at x.py:1",
                                                               "Number of Tasks": 4, "Submission Time": 1000,
                                                               "Completion Time": 1250}},
        {"Event": "SparkListenerJobStart", "Job ID": 1, "Submission Time": 990},
        {"Event": "SparkListenerJobEnd", "Job ID": 1, "Completion Time": 1300},
    ]
    with open(os.path.join(path, "events_1"), "w") as f:
        f.write("\n".join(json.dumps(e) for e in events))
    st = eventlog.stage_summary(spark, path).collect()
    assert [(r["stage_id"], r["operation"], r["tasks"], r["duration_ms"]) for r in st] == [(3, "collect", 4, 250)]
    assert [tuple(r) for r in eventlog.job_summary(spark, path).collect()] == [(1, 310)]
