"""Training sweeps; S11: run-log summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.models import LinearNet, SmallCNN
from kiln.operators.sweep import sweep, sweep_iterations
from kiln.operators.training import WINDOW_WORK, HISTORY_SCHEMA, TrainConfig, history_frame, train
from kiln.plans.constants import IMAGE_SIDE, SEED
from kiln.plans.registry import register
from kiln.session import scratch_path
from kiln.sources import image_table

CNN = SmallCNN(side=IMAGE_SIDE).config()
BASE = TrainConfig(iters=50, batch_size=64, partitions=4, lr=0.001, validation_pct=0.2, seed=SEED)


# fixed values: batch sizes, iteration and partition counts of the benchmark
BATCH_GRID = (1, 8, 16, 32, 256, 512, 1024, 2048)
ITER_GRID = (25, 50, 75, 100, 150, 200, 250, 300)
PARTITION_GRID = ((2, 300), (6, 300), (12, 300), (16, 50))  # (partitions, iterations)


@register("sweep_batch")
def q_sweep_batch(spark, sf_dir):
    """B1: the benchmark's batch sizes on 4 shards, 50 iterations each, ten
    minibatches a job.  A batch larger than a shard is the whole shard."""
    grid = [{"batch_size": b, "local_steps": 10} for b in BATCH_GRID]
    return sweep(image_table(spark, sf_dir), CNN, grid, BASE)


@register("sweep_iters")
def q_sweep_iters(spark, sf_dir):
    """B2: iteration sweep at batch 64 on 3 shards, one run cut at the
    benchmark's counts and ended after one epoch of the largest shard if that
    is later; 25 minibatches a job (local SGD), which divides all counts."""
    base = TrainConfig(batch_size=64, partitions=3, lr=0.001, validation_pct=0.2, seed=SEED, local_steps=25,
                       min_epochs=1)
    return sweep_iterations(image_table(spark, sf_dir), CNN, list(ITER_GRID), base)


@register("sweep_partitions")
def q_sweep_partitions(spark, sf_dir):
    """The benchmark's shard counts at batch 256 with its iteration
    counts, or one epoch of the largest shard if that is more, 25 minibatches
    a job."""
    grid = [{"partitions": p, "batch_size": 256, "iters": n, "local_steps": 25, "min_epochs": 1}
            for p, n in PARTITION_GRID]
    return sweep(image_table(spark, sf_dir), CNN, grid, BASE)


@register("run_log_summary")
def q_run_log_summary(spark, sf_dir):
    """The log of a training run over the given table (one JSON line a
    step and validation, as the run wrote them), read back and summarised:
    records, rows and milliseconds by operation.  (Event logs of whole
    applications: ``sources.eventlog``.)"""
    cfg = TrainConfig(epochs=2, batch_size=64, partitions=4, lr=0.1, validation_pct=0.2, seed=SEED,
                      eval_per_epoch=True, window_work=WINDOW_WORK)
    res = train(image_table(spark, sf_dir), LinearNet(IMAGE_SIDE * IMAGE_SIDE, 10, "classification").config(), cfg)
    path = scratch_path(spark, "runlog")
    history_frame(spark, res).write.json(path)
    log = spark.read.schema(HISTORY_SCHEMA).json(path)
    return log.groupBy(F.col("split").alias("operation")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("n").alias("rows"),
        F.round(F.sum("seconds") * 1000).cast("long").alias("duration_ms"))
