"""Gang-scheduled training: one barrier job per epoch.

All shards train at the same time.  A task holds one shard, streams its rows
in the order of the steps, and after each step the tasks exchange their
gradient sums (``exchange.gatherer``: files in the shared folder, or
``BarrierTaskContext.allGather`` at a second a step where tasks do not mount
it) and make the same update, so the number of jobs is the number of epochs
whatever the number of rows.  The arithmetic is that of ``operators.training.train``: sum of gradients over
rows of the step.

A barrier stage needs a slot for every shard at once; with fewer it is
refused before anything runs.  If a task is lost Spark runs the whole stage
again from the epoch's first weights.  With ``state_dir`` the weights and the
optimizer's state are written after every epoch, and a new call goes on from
the last one written.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.models import build_model, make_optimizer
from kiln.operators.exchange import mounted
from kiln.operators.training import (EPOCH_SCHEMA, PreparedRound, TrainConfig, TrainResult, _epoch_fn, _steps,  # noqa: F401
                                     assign_shards_and_batches, evaluate, optimizer_state, restore_optimizer,
                                     sized_layout, standardize_input, with_split)
from kiln.session import delete_scratch, scratch_path

STATE_SCHEMA = "epoch int, params array<double>, optimizer string, config string, history string"


def slots(spark: SparkSession) -> int:
    """Tasks that can run at once, as the session knows it."""
    return spark.sparkContext.defaultParallelism


def _resume(spark: SparkSession, state_dir: str | None, config: str):
    if state_dir is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", "true").parquet(state_dir)
    last = rows.orderBy(F.desc("epoch")).first()  # a row per epoch
    if last is not None and last["config"] != config:
        raise ValueError(f"{state_dir} belongs to a run with other settings")
    return last


def train_gang(df: DataFrame, model_config: dict, cfg: TrainConfig, id_col: str = "id", label_col: str = "label",
               features_col: str = "features", state_dir: str | None = None) -> TrainResult:
    """``cfg.epochs`` epochs of the largest shard in each of
    ``cfg.partition_shuffles`` rounds, one job an epoch.

    Rows, shards, batches and their order are those of ``train``; smaller
    shards start over within an epoch of the largest.  ``cfg.iters`` is not
    used.  An empty table, or a shard count above the session's slots,
    raises ValueError."""
    spark = df.sparkSession
    if cfg.epochs < 1 or cfg.full_batch or cfg.local_steps > 1:
        raise ValueError("gang training runs whole epochs of synchronous minibatches")
    have = slots(spark)
    if have < cfg.partitions:
        raise ValueError(f"{cfg.partitions} shards have to run at once and the session has {have} slots: "
                         "lower partitions, or use train, whose steps are ordinary jobs")
    model = build_model(model_config)
    opt = make_optimizer(cfg.optimizer, cfg.lr)
    params, done, history, steps = model.init(cfg.seed), 0, [], 0
    settings = asdict(replace(cfg, epochs=0, layout_partitions=0))
    del settings["window_work"]  # of the step-by-step trainer: states written without it stay good
    config = json.dumps([model.config(), settings], sort_keys=True)
    saved = _resume(spark, state_dir, config)
    if saved is not None:
        params, done, history = np.array(saved["params"]), saved["epoch"], json.loads(saved["history"])
        opt, steps = restore_optimizer(opt, saved["optimizer"]), len(history)
    base = standardize_input(df, id_col, label_col, features_col, cfg.feature_dtype).persist(StorageLevel.MEMORY_AND_DISK)
    start, count = time.time(), 0
    meeting = scratch_path(spark, "gang")
    path = spark._jvm.org.apache.hadoop.fs.Path(meeting)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    try:
        rows, held = base, None
        if cfg.validation_pct > 0:
            split = with_split(base, cfg.seed, cfg.validation_pct)
            rows, held = (split.filter(F.col("split") == s).drop("split") for s in ("train", "validation"))
        if not cfg.layout_partitions:
            cfg = replace(cfg, layout_partitions=sized_layout(rows, cfg))
        for rnd in range(max(1, cfg.partition_shuffles)):
            if done >= (rnd + 1) * cfg.epochs:
                continue
            keep: list = []
            prepared = PreparedRound(assign_shards_and_batches(rows, cfg, rnd, keep), cfg, f"gang-r{rnd}", keep)
            count = max(count, prepared.rows)
            per_epoch = max(prepared.shard_batches.values())
            try:
                for epoch in range(done - rnd * cfg.epochs, cfg.epochs):
                    first, t0 = epoch * per_epoch, time.time()
                    shared = spark.sparkContext.broadcast((params, optimizer_state(opt)))
                    shards = (prepared.window_rows(first, per_epoch).select("id", "label", "features", "batch", "shard")
                              .repartitionById(cfg.partitions, F.col("shard")).sortWithinPartitions("batch", "id")
                              .select("id", "label", "features", "batch"))
                    out = shards.mapInArrow(_epoch_fn(model.to_json(), shared, cfg.optimizer, cfg.lr, first, per_epoch,
                                                      steps, cfg.seed, folder=mounted(meeting)), EPOCH_SCHEMA,
                                            barrier=True).toArrow()
                    shared.destroy()
                    row = out.to_pylist()[0]
                    params, opt = np.array(row["params"]), restore_optimizer(opt, row["optimizer"])
                    each = (time.time() - t0) / per_epoch
                    for loss, right, n in zip(row["loss"], row["correct"], row["n"]):
                        history.append({"round": rnd, "iter": steps, "split": "train", "n": n, "loss": loss / max(n, 1),
                                        "acc": right / max(n, 1) if model.task == "classification" else None,
                                        "seconds": each})
                        steps += 1
                    done += 1
                    if state_dir is not None:
                        state = [(done, [float(p) for p in params], optimizer_state(opt), config, json.dumps(history))]
                        spark.createDataFrame(state, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
                            f"{state_dir}/epoch={done}")
            finally:
                prepared.release()
        seconds = time.time() - start
        validation = evaluate(held, model.config(), params) if held is not None else None
    finally:
        base.unpersist()
        delete_scratch(spark, meeting)
    return TrainResult(model.config(), params, history, validation, seconds, asdict(cfg), steps, count)
