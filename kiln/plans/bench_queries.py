"""Benchmark configurations of the canonical image job (BASELINE rows)."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC

from kiln.plans.training import REPORT_SCHEMA, run_image_benchmark, svm_input
from kiln.sources import image_table


def _svm_cluster(spark, sf_dir):
    """The cluster SVM configuration: 12 partitions, maxIter 20, regParam 0.1."""
    data = svm_input(spark, sf_dir).repartition(12)
    m = LinearSVC(maxIter=20, regParam=0.1).fit(data)
    s = m.summary()
    return spark.createDataFrame([(int(s.totalIterations), float(s.objectiveHistory[-1]))],
                                 "iterations int, objective double")


def _run(spark, sf_dir, **kw):
    row = run_image_benchmark(spark, image_table(spark, sf_dir), **kw)
    return spark.createDataFrame([row], REPORT_SCHEMA)


BENCH_QUERIES = {
    "svm_p12_itr20": _svm_cluster,
    # b64_itr25: batch 64, 25 iterations, 3 partitions
    "cnn_b64_itr25_p3": lambda spark, sf: _run(spark, sf, partitions=3, iters=25, batch=64),
    # b64_itr100 as local SGD: 100 minibatch steps per shard in 10 jobs
    "cnn_b64_itr100_p3_local10": lambda spark, sf: _run(spark, sf, partitions=3, iters=100, batch=64,
                                                        local_steps=10),
    # skew_p4_b256: label-hashed shards, 4 re-deal rounds, batch 256, 50 iterations
    "cnn_skew_b256_p4": lambda spark, sf: _run(spark, sf, partitions=4, iters=50, batch=256,
                                               shard_by="label", shuffles=4),
}
