"""Gang-scheduled training equals the step-by-step trainer, restarts included."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kiln.models import MLP, make_optimizer
from kiln.operators import exchange, gang
from kiln.operators.training import TrainConfig, train
from kiln.session import scratch_path

NET = MLP([4, 6, 3]).config()


def rows(spark, n=157):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 4))
    y = (x @ rng.normal(size=(4, 3))).argmax(axis=1)
    return spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)],
                                 "id long, label int, features array<double>").repartition(3)


@pytest.mark.parametrize("more", [
    {"optimizer": "adam", "partitions": 3}, {"shard_by": "label", "partition_shuffles": 2, "partitions": 4}])
def test_gang_equals_the_trainer(spark, more):
    """Uneven shards (by label some are empty), re-dealt batches, rounds."""
    df = rows(spark)
    cfg = TrainConfig(epochs=2, batch_size=11, lr=0.05, feature_dtype="double", validation_pct=0.2, seed=5,
                      layout_partitions=4, **more)
    one = gang.train_gang(df, NET, cfg)
    rounds = more.get("partition_shuffles", 1)
    per_round = [len([h for h in one.history if h["round"] == r]) for r in range(rounds)]
    # the trainer names its steps: the same number in every round
    if rounds == 1:
        two = train(df, NET, cfg)
        assert one.steps == two.steps == per_round[0]
        assert np.allclose(one.params, two.params, rtol=1e-9, atol=1e-12)
        mine = [h for h in two.history if h["split"] == "train"]
        assert [h["n"] for h in one.history] == [h["n"] for h in mine]
        assert np.allclose([h["loss"] for h in one.history], [h["loss"] for h in mine])
        assert one.validation["n"] == two.validation["n"] and np.isclose(one.validation["loss"], two.validation["loss"])
    assert one.train_rows == two.train_rows if rounds == 1 else one.steps == sum(per_round)
    assert one.history[-1]["loss"] < one.history[0]["loss"]


def test_a_new_call_goes_on_from_the_last_epoch(spark):
    df = rows(spark, 60)
    state = scratch_path(spark, "t-gang")
    cfg = {"batch_size": 8, "partitions": 2, "lr": 0.05, "optimizer": "adam", "feature_dtype": "double"}
    whole = gang.train_gang(df, NET, TrainConfig(epochs=3, **cfg))
    first = gang.train_gang(df, NET, TrainConfig(epochs=1, **cfg), state_dir=state)
    rest = gang.train_gang(df, NET, TrainConfig(epochs=3, **cfg), state_dir=state)
    assert np.allclose(rest.params, whole.params, rtol=1e-12, atol=1e-15) and rest.steps == whole.steps
    assert rest.history[:first.steps] == first.history
    again = gang.train_gang(df, NET, TrainConfig(epochs=3, **cfg), state_dir=state)
    assert (again.params == rest.params).all()
    with pytest.raises(ValueError, match="other settings"):
        gang.train_gang(df, NET, TrainConfig(epochs=3, **{**cfg, "lr": 0.1}), state_dir=state)


def test_too_few_slots_and_bad_settings_are_refused(spark):
    df = rows(spark, 10)
    with pytest.raises(ValueError, match="slots"):
        gang.train_gang(df, NET, TrainConfig(epochs=1, partitions=gang.slots(spark) + 1))
    for bad in ({}, {"epochs": 1, "full_batch": True}, {"epochs": 1, "local_steps": 2}):
        with pytest.raises(ValueError):
            gang.train_gang(df, NET, TrainConfig(partitions=2, **bad))
    with pytest.raises(ValueError, match="no training rows"):
        gang.train_gang(df.filter(F.lit(False)), NET, TrainConfig(epochs=1, partitions=2))


def test_steps_are_cut_out_of_batches():
    table = pa.table({"id": list(range(10)), "batch": pa.array([3, 3, 4, 4, 4, 7, 7, 8, 8, 8], pa.int64())})
    for size in (1, 2, 3, 10):
        batches = [pa.RecordBatch.from_pylist([], schema=table.schema), *table.to_batches(max_chunksize=size)]
        got = [None if b is None else b.column("id").to_pylist() for b in gang._steps(batches, 3, 7)]
        assert got == [[0, 1], [2, 3, 4], None, None, [5, 6], [7, 8, 9], None]


def test_tasks_that_exchange_end_with_the_same_weights():
    """Two tasks as threads around a barrier, one of them without rows in
    some steps; the speaker's answer equals one task with all rows."""
    rng = np.random.default_rng(1)
    n = 24
    step = np.sort(rng.integers(0, 4, n))
    table = pa.table({"id": pa.array(np.arange(n)), "label": pa.array(rng.integers(0, 3, n).astype(float)),
                      "features": pa.array(rng.normal(size=(n, 4)).tolist()), "batch": pa.array(step)})
    mine = pa.array((step != 2) & (np.arange(n) % 3 == 0))
    parts = [table.filter(mine), table.filter(pa.array(~mine.to_numpy(zero_copy_only=False)))]
    model = MLP([4, 6, 3])

    class Shared:
        value = (model.init(1), gang.optimizer_state(make_optimizer("adam", 0.1)))

    def run(tables):
        barrier, board, answers = threading.Barrier(len(tables)), [None] * len(tables), []

        def task(i):
            def exchange(text):
                board[i] = text
                barrier.wait()
                got = list(board)
                barrier.wait()
                return got
            fn = gang._epoch_fn(model.to_json(), Shared, "adam", 0.1, 0, 4, 0, 7, gather=(exchange, True))
            answers.append(next(fn(tables[i].to_batches(max_chunksize=5))).to_pylist()[0])
        threads = [threading.Thread(target=task, args=(i,)) for i in range(len(tables))]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
        return answers
    two, one = run(parts), run([table])[0]
    assert two[0] == two[1] and two[0]["n"] == one["n"] and sum(one["n"]) == n
    assert np.allclose(two[0]["params"], one["params"], rtol=1e-9)


class Task:
    """A barrier task's context among threads, counting what it asks."""
    def __init__(self, i, barrier, board):
        self.i, self.barrier, self.board, self.asked = i, barrier, board, 0

    def partitionId(self):
        return self.i

    def taskAttemptId(self):
        return 40 + self.i

    def allGather(self, text):
        self.asked += 1
        self.board[self.i] = text
        self.barrier.wait(60)
        got = list(self.board)
        self.barrier.wait(60)
        return got


def gathered(folders, turns=50):
    barrier, board, answers = threading.Barrier(len(folders)), [None] * len(folders), [None] * len(folders)
    tasks = [Task(i, barrier, board) for i in range(len(folders))]

    def run(i):
        gather = exchange.gatherer(tasks[i], folders[i])
        answers[i] = [gather(f"{t}/{i}") for t in range(turns)]
    threads = [threading.Thread(target=run, args=(i,), daemon=True) for i in range(len(folders))]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    assert answers == [[[f"{t}/{i}" for i in range(len(folders))] for t in range(turns)]] * len(folders)
    return [t.asked for t in tasks]


def test_texts_pass_through_a_folder_that_all_tasks_see(tmp_path):
    """Two questions to the driver, then none however many turns; the files
    of all turns but the last are gone.  Without the folder, or with one that
    a task does not see, every turn asks."""
    assert gathered([str(tmp_path)] * 3) == [2, 2, 2]
    assert len(list(tmp_path.iterdir())) == 3 + 3
    assert gathered([str(tmp_path / "missing"), str(tmp_path), str(tmp_path)]) == [52, 52, 52]
    assert gathered([None, None]) == [50, 50]
    assert gathered([str(tmp_path / "missing")] * 2) == [52, 52]
    assert exchange.mounted("file:///a/b") == exchange.mounted("file:/a/b") == exchange.mounted("/a/b") == "/a/b"
    assert exchange.mounted("hdfs://n/a") is exchange.mounted("s3a://b/a") is None


def test_steps_of_a_gang_do_not_take_a_second_each(spark):
    """120 steps: at a second each the old exchange took two minutes."""
    res = gang.train_gang(rows(spark, 240), NET, TrainConfig(epochs=1, batch_size=1, partitions=2, lr=0.01))
    assert res.steps >= 120 and res.seconds < 60
