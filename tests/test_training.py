"""The distributed loop against a single-process numpy replay of the same
batch plan, plus properties of the prepared batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from kiln.models import LinearNet, SmallCNN, build_model, make_optimizer
from kiln.operators.training import TrainConfig, assign_shards_and_batches, standardize_input, train
from kiln.sources import image_table


def _replay(spark, df, model_cfg, cfg):
    """Single-process replay: same rows per step, same update rule."""
    model = build_model(model_cfg)
    base = standardize_input(df, "id", "label", "features", cfg.feature_dtype)
    plan = assign_shards_and_batches(base, cfg, 0).toPandas()
    params = model.init(cfg.seed)
    opt = make_optimizer(cfg.optimizer, cfg.lr)
    losses = []
    for t in range(cfg.iters):
        rows = plan[plan.batch == (t % plan.n_batches)]
        X = np.stack(rows.features.to_numpy()).astype(np.float64)
        ids = rows.id.to_numpy().astype(np.int64)
        seeds = (np.int64(cfg.seed) * 1_000_003 + np.int64(t) * 7_919 + ids) & 0x7FFFFFFF
        loss, g, _ = model.loss_grad(params, X, rows.label.to_numpy(), True, seeds)
        params = opt.step(params, g / len(rows))
        losses.append(loss / len(rows))
    return params, losses


@pytest.mark.parametrize("partitions,shard_by,storage", [(1, "hash", "cache"), (3, "hash", "table"),
                                                        (4, "balanced", "cache"), (4, "balanced", "table")])
def test_distributed_equals_single_process(spark, partitions, shard_by, storage):
    df = image_table(spark, SF01)
    cfg = TrainConfig(iters=4, batch_size=16, partitions=partitions, lr=0.5, storage=storage, shard_by=shard_by)
    model = LinearNet(64, 10, "classification").config()
    res = train(df, model, cfg)
    params, losses = _replay(spark, df, model, cfg)
    assert np.allclose(res.params, params, atol=1e-10)
    assert np.allclose([h["loss"] for h in res.history], losses, atol=1e-10)


def test_cnn_with_dropout_is_partitioning_independent(spark):
    df = image_table(spark, SF01)
    model = SmallCNN(side=8, c1=4, c2=8).config()
    a = train(df, model, TrainConfig(iters=3, batch_size=8, partitions=2, lr=0.05, storage="table"))
    params, _ = _replay(spark, df, model, TrainConfig(iters=3, batch_size=8, partitions=2, lr=0.05))
    assert np.allclose(a.params, params, atol=1e-10)


@pytest.mark.parametrize("shard_by", ["hash", "balanced"])
def test_batches_are_full_and_disjoint(spark, shard_by):
    df = standardize_input(image_table(spark, SF01), "id", "label", "features")
    cfg = TrainConfig(batch_size=16, partitions=3, shard_by=shard_by, drop_last=True, redeal=False)
    plan = assign_shards_and_batches(df, cfg, 0)
    sizes = plan.groupBy("shard", "batch").count().select(F.min("count"), F.max("count")).first()
    assert sizes[0] == sizes[1] == 16
    assert plan.select("id").distinct().count() == plan.count()
    if shard_by == "balanced":  # round-robin: shard sizes within one row, minus the dropped tails
        shard_sizes = [r["count"] for r in plan.groupBy("shard").count().collect()]
        assert max(shard_sizes) - min(shard_sizes) <= 16


def test_label_sharding_reproduces_skew_and_empty_shards_are_legal(spark):
    df = image_table(spark, SF01)
    cfg = TrainConfig(iters=3, batch_size=16, partitions=4, lr=0.5, shard_by="label", storage="cache")
    res = train(df, LinearNet(64, 10, "classification").config(), cfg)
    assert all(h["n"] > 0 for h in res.history)
    plan = assign_shards_and_batches(standardize_input(df, "id", "label", "features"), cfg, 0)
    per_shard = {r["shard"]: r["labels"] for r in
                 plan.groupBy("shard").agg(F.collect_set("label").alias("labels")).collect()}
    labels = [lab for labs in per_shard.values() for lab in labs]
    assert len(labels) == len(set(labels))  # each label lives in exactly one shard


def test_loss_falls_below_log_k(spark):
    df = image_table(spark, SF01)
    cfg = TrainConfig(iters=8, batch_size=64, partitions=2, lr=5.0, storage="cache", validation_pct=0.2)
    res = train(df, LinearNet(64, 10, "classification", zero_init=True).config(), cfg)
    assert res.history[0]["loss"] == pytest.approx(np.log(10))
    assert np.mean([h["loss"] for h in res.history[-3:]]) < np.log(10)
    assert res.validation["n"] > 0


def test_chunked_model_calls_equal_one_call(spark, monkeypatch):
    import kiln.operators.training as tr
    df = image_table(spark, SF01)
    cfg = TrainConfig(iters=2, batch_size=32, partitions=2, lr=0.5, storage="cache")
    model = LinearNet(64, 10, "classification").config()
    a = train(df, model, cfg)
    monkeypatch.setattr(tr, "CHUNK_ROWS", 5)
    b = train(df, model, cfg)
    assert np.allclose(a.params, b.params, atol=1e-12)


def test_empty_partials_leave_the_update_unchanged(spark):
    from kiln.operators.training import PARTIAL_SCHEMA, _reduce_partials
    rows = [([1.0, 2.0], 3.0, 1, 2), ([0.5, 0.5], 1.0, 0, 1)]
    base = spark.createDataFrame(rows, PARTIAL_SCHEMA)
    with_empty = base.union(spark.createDataFrame([([0.0, 0.0], 0.0, 0, 0)], PARTIAL_SCHEMA))
    g1, l1, c1, n1 = _reduce_partials(base, TrainConfig())
    g2, l2, c2, n2 = _reduce_partials(with_empty, TrainConfig())
    assert np.allclose(g1, g2) and (l1, c1, n1) == (l2, c2, n2)
    g3, *_ = _reduce_partials(with_empty.repartition(40), TrainConfig(tree_reduce_above=4))
    assert np.allclose(g1, g3)


def _replay_local_sgd(spark, df, model_cfg, cfg):
    model = build_model(model_cfg)
    base = standardize_input(df, "id", "label", "features", cfg.feature_dtype)
    plan = assign_shards_and_batches(base, cfg, 0).toPandas()
    params = model.init(cfg.seed)
    for j in range(0, cfg.iters, cfg.local_steps):
        k = min(cfg.local_steps, cfg.iters - j)
        total, rows_all = np.zeros_like(params), 0
        for _, sh in plan.groupby("shard"):
            nb = int(sh.n_batches.iloc[0])
            w, m = params.copy(), 0
            for i in range(k):
                rows = sh[sh.batch == (j + i) % nb]
                X = np.stack(rows.features.to_numpy()).astype(np.float64)
                seeds = (np.int64(cfg.seed) * 1_000_003 + np.int64(j + i) * 7_919
                         + rows.id.to_numpy().astype(np.int64)) & 0x7FFFFFFF
                _, g, _ = model.loss_grad(w, X, rows.label.to_numpy(), True, seeds)
                w = w - cfg.lr * g / len(rows)
                m += len(rows)
            total += (w - params) * m
            rows_all += m
        params = params + total / rows_all
    return params


@pytest.mark.parametrize("local_steps", [2, 3])
def test_local_sgd_equals_replay_and_cuts_jobs(spark, local_steps):
    df = image_table(spark, SF01)
    cfg = TrainConfig(iters=6, batch_size=16, partitions=3, lr=0.5, storage="table", local_steps=local_steps)
    model = SmallCNN(side=8, c1=2, c2=4).config()
    res = train(df, model, cfg)
    assert len(res.history) == 6 // local_steps
    assert np.allclose(res.params, _replay_local_sgd(spark, df, model, cfg), atol=1e-10)


def test_one_local_step_is_synchronous_sgd(spark):
    from kiln.operators import training as tr
    df = image_table(spark, SF01)
    model = LinearNet(64, 10, "classification").config()
    cfg = TrainConfig(iters=1, batch_size=16, partitions=3, lr=0.5, storage="cache")
    sync = train(df, model, cfg)
    base = standardize_input(df, "id", "label", "features")
    keep = []
    prep = tr.PreparedRound(assign_shards_and_batches(base, cfg, 0, keep), cfg, "t-one", keep)
    m = build_model(model)
    bc = spark.sparkContext.broadcast(m.init(cfg.seed))
    parts = (prep.window_rows(0, 1).select("id", "label", "features", "shard", "batch", "n_batches")
             .groupBy("shard").applyInArrow(tr._local_sgd_fn(m.to_json(), bc, 0, 0, 1, cfg.lr, cfg.seed),
                                            tr.PARTIAL_SCHEMA))
    g, _, _, n = tr._reduce_partials(parts, cfg)
    prep.release()
    assert np.allclose(m.init(cfg.seed) + g / n, sync.params, atol=1e-12)


def test_no_row_is_lost_and_batches_change_every_epoch(spark):
    """Each epoch reads every row of every shard once, in batches of the same
    sizes; from epoch to epoch rows change batches."""
    from kiln.operators.training import PreparedRound
    df = standardize_input(image_table(spark, SF01), "id", "label", "features")
    cfg = TrainConfig(batch_size=16, partitions=3, batches_per_folder=4, layout_partitions=3)
    prep = PreparedRound(assign_shards_and_batches(df, cfg, 0), cfg, "t-epochs")
    nb = prep.shard_batches
    read = None
    for t in range(3 * max(nb.values())):
        one = prep.step_rows(t).select(F.lit(t).alias("t"), "shard", "id")
        read = one if read is None else read.unionByName(one)
    pdf = read.toPandas()
    prep.release()
    n = df.count()
    batches = {}
    for (shard, t), g in pdf.groupby(["shard", "t"]):
        batches.setdefault((shard, t // nb[shard]), []).append(frozenset(g.id))
    full = {k: b for k, b in batches.items() if len(b) == nb[k[0]]}
    for (shard, epoch), b in full.items():
        assert len(frozenset().union(*b)) == sum(map(len, b))
        assert sorted(map(len, b)) == sorted(map(len, full[(shard, 0)]))
        if epoch:
            assert set(b) != set(full[(shard, epoch - 1)])
    assert sum(len(x) for (s, e), b in full.items() if e == 0 for x in b) == n


def test_batch_larger_than_a_shard_trains_on_all_rows(spark):
    df = image_table(spark, SF01)
    cfg = TrainConfig(iters=2, batch_size=2048, partitions=4, lr=0.5)
    res = train(df, LinearNet(64, 10, "classification").config(), cfg)
    assert [h["n"] for h in res.history] == [df.count()] * 2


def test_training_without_rows_or_full_batches_raises(spark):
    df = image_table(spark, SF01)
    net = LinearNet(64, 10, "classification").config()
    with pytest.raises(ValueError, match="no training rows"):
        train(df.limit(0), net, TrainConfig(iters=1))
    with pytest.raises(ValueError, match="full batch"):
        train(df, net, TrainConfig(iters=1, batch_size=2048, drop_last=True))


def test_full_batch_tasks_follow_the_input_splits(spark):
    from kiln.operators.training import PreparedRound
    df = standardize_input(image_table(spark, SF01), "id", "label", "features").repartition(6).persist()
    cfg = TrainConfig(partitions=2, full_batch=True, storage="cache")
    prep = PreparedRound(assign_shards_and_batches(df, cfg, 0), cfg, "t-full")
    sizes = prep.step_rows(0).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) == 6 and sum(r["count"] for r in sizes) == df.count()
    assert "Exchange" not in prep.step_rows(0)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    prep.release()
    df.unpersist()


def test_batch_filter_is_pushed_down_with_many_shards(spark):
    from kiln.operators.training import PreparedRound
    df = standardize_input(image_table(spark, SF01), "id", "label", "features")
    cfg = TrainConfig(batch_size=2, partitions=80, redeal=False)
    prep = PreparedRound(assign_shards_and_batches(df, cfg, 0), cfg, "t-push")
    plan = prep.step_rows(7)._jdf.queryExecution().executedPlan().toString()
    prep.release()
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0]
    assert "batch" in pushed


def test_scratch_tables_of_a_fit_are_deleted(spark):
    import glob
    from kiln.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).replace("file:", "")
    before = set(glob.glob(f"{base}/kiln-train-*"))
    train(image_table(spark, SF01), LinearNet(64, 10, "classification").config(),
          TrainConfig(iters=4, partitions=2, partition_shuffles=2, lr=0.1))
    assert set(glob.glob(f"{base}/kiln-train-*")) == before


def test_recode_binary(spark):
    from kiln.operators.features import recode_binary
    df = spark.createDataFrame([(2,), (7,), (2,), (None,)], "label int")
    assert [r["label"] for r in recode_binary(df, "label").collect()] == [0.0, 1.0, 0.0, None]
    with pytest.raises(ValueError):
        recode_binary(df.filter("label = 2"), "label")
    with pytest.raises(ValueError):
        recode_binary(df.union(spark.createDataFrame([(3,)], "label int")), "label")


@pytest.mark.parametrize("shard_by,rounds,local_steps", [("hash", 1, 1), ("label", 3, 1), ("hash", 1, 4)])
def test_fit_runs_at_least_one_epoch_of_every_round(spark, monkeypatch, shard_by, rounds, local_steps):
    """Few iterations on a larger table: every training row enters a gradient
    in every round."""
    from kiln.operators import training as tr
    df = image_table(spark, SF01)
    rows = df.count()
    seen = []
    name = "window_rows" if local_steps > 1 else "step_rows"
    plain = getattr(tr.PreparedRound, name)

    def spied(self, *a):
        out = plain(self, *a)
        seen.append([r["id"] for r in out.select("id").collect()])
        return out

    monkeypatch.setattr(tr.PreparedRound, name, spied)
    cfg = TrainConfig(iters=3, batch_size=32, partitions=4, shard_by=shard_by, partition_shuffles=rounds, lr=0.1,
                      local_steps=local_steps, min_epochs=1)
    res = train(df, LinearNet(64, 10, "classification").config(), cfg)
    numbers = [h["round"] for h in res.history]
    assert set(numbers) == set(range(rounds)) and res.train_rows == rows
    for rnd in range(rounds):
        ids = {i for n, got in zip(numbers, seen) if n == rnd for i in got}
        assert len(ids) == rows
    assert sum(h["n"] for h in res.history) >= rounds * rows


@pytest.mark.parametrize("query", ["train_local_sgd", "sweep_partitions"])
def test_registered_fits_reach_every_training_row(spark, monkeypatch, query):
    from kiln.plans import QUERIES, reports, training
    few = image_table(spark, SF01)
    many = few.crossJoin(spark.range(30).withColumnRenamed("id", "_copy"))
    many = many.withColumn("id", F.col("id") * 30 + F.col("_copy")).drop("_copy")
    for module in (reports, training):
        monkeypatch.setattr(module, "image_table", lambda spark, sf_dir: many)
    monkeypatch.setattr(reports, "PARTITION_GRID", ((2, 10),))
    for r in QUERIES[query](spark, SF01).collect():
        assert r["train_rows"] > 11000 and r["rows_seen"] >= r["train_rows"]


@pytest.mark.parametrize("k", [7, 25])
def test_windows_read_what_the_steps_read(spark, k):
    """Local SGD over epoch ends: a window's rows are those of its steps, so
    every epoch reads every row once (k does not divide the batch counts)."""
    from kiln.operators import training as tr
    cfg = TrainConfig(batch_size=16, partitions=3, local_steps=k, layout_partitions=3)
    base = standardize_input(image_table(spark, SF01), "id", "label", "features")
    prep = tr.PreparedRound(assign_shards_and_batches(base, cfg, 0), cfg, "windows")
    try:
        steps = 25
        assert all(nb % k and nb < steps for nb in prep.shard_batches.values())
        want = sorted((t, r["shard"], r["id"]) for t in range(steps) for r in prep.step_rows(t).select("shard", "id").collect())
        got = sorted((r["batch"], r["shard"], r["id"]) for first in range(0, steps, k) for r in
                     prep.window_rows(first, min(k, steps - first)).select("batch", "shard", "id").collect())
        assert got == want
    finally:
        prep.release()


def test_model_calls_stay_below_their_memory():
    """Scoring and gradients of large pictures take bounded memory whatever
    the rows of an Arrow batch."""
    import tracemalloc

    import pyarrow as pa

    from kiln.operators import training as tr
    net, rng, n = SmallCNN(side=28), np.random.default_rng(0), 600

    class Shared:
        value = net.init(1)

    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64()), pa.array(rng.integers(0, 10, n).astype(float)),
         pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 784, pa.int32()), pa.array(rng.random(n * 784)))],
        names=["id", "label", "features"])
    tracemalloc.start()
    try:
        list(tr._eval_fn(net.to_json(), Shared)([batch]))
        list(tr._gradient_fn(net.to_json(), Shared, 0, 1)([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * tr.CHUNK_BYTES


@pytest.mark.parametrize("more", [
    {"epochs": 3, "optimizer": "adam", "partitions": 1}, {"epochs": 2, "partitions": 3, "drop_last": True},
    {"iters": 13, "partitions": 4, "shard_by": "label", "partition_shuffles": 2, "min_epochs": 1, "eval_every": 3},
    {"iters": 9, "partitions": 2, "redeal": False, "eval_at": (4, 7)}])
def test_windows_of_steps_equal_single_steps(spark, more):
    """Steps that share a job give the weights and the history of steps that
    are a job each: optimizers, epochs, rounds, evaluations, small shards."""
    df = image_table(spark, SF01)
    net = LinearNet(64, 10, "classification").config()
    cfg = {"batch_size": 16, "lr": 0.1, "validation_pct": 0.2, "eval_per_epoch": True, **more}
    a, b = train(df, net, TrainConfig(window_work=1 << 27, **cfg)), train(df, net, TrainConfig(**cfg))
    assert np.allclose(a.params, b.params, rtol=1e-9, atol=1e-12)
    assert (a.steps, a.train_rows) == (b.steps, b.train_rows) and np.isclose(a.validation["loss"], b.validation["loss"])
    keys = ("round", "iter", "split", "n")
    assert [[h[k] for k in keys] for h in a.history] == [[h[k] for k in keys] for h in b.history]
    assert np.allclose([h["loss"] for h in a.history], [h["loss"] for h in b.history])
    assert np.allclose([h["acc"] for h in a.history], [h["acc"] for h in b.history])


def test_jobs_do_not_grow_with_the_steps(spark, monkeypatch):
    """The steps of a small model share jobs, as many as their rows allow."""
    from kiln.operators import training as tr
    jobs = []
    real = tr._reduce_partials
    monkeypatch.setattr(tr, "_reduce_partials", lambda *a: jobs.append(1) or real(*a))
    df, net = image_table(spark, SF01), LinearNet(64, 10, "classification")
    cfg = TrainConfig(epochs=4, batch_size=8, partitions=1, lr=0.1, window_work=tr.WINDOW_WORK)
    assert train(df, net.config(), cfg).steps > 50 and not jobs
    assert tr.window_steps(SmallCNN(side=28), TrainConfig(batch_size=64, partitions=3, window_work=tr.WINDOW_WORK)) == 1
    assert tr.window_steps(net, cfg) * 8 * (64 * 4 + 48) <= tr.WINDOW_BYTES
