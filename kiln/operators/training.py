"""Data-parallel minibatch training as a sequence of Spark jobs.

Plan (one per training round):

1. **prepare** - seeded split, shard and batch numbers, computed with one
   range shuffle (``row_number_distributed``); the result is written as a
   parquet table under ``spark.checkpoint.dir``, laid out by
   ``(shard, batch)`` so each file holds one shard and its row groups hold
   consecutive batches.  The table cuts lineage: a lost executor re-reads
   files instead of recomputing the shuffle.
2. **step t** - read only the rows of batch ``t mod n_batches`` of every
   shard (the batch filter is pushed into the parquet scan), run the model's
   loss/gradient in ``mapInArrow`` with the current weights broadcast, and
   return one fixed-size partial sum per task.  Partial sums are reduced on
   the driver (or through one more tree level when there are many tasks);
   their size depends on the model, never on the data.
3. **update** - SGD/Adam on the driver, new broadcast, next step.

Steps 2 and 3 of a small model take far less time than the start of a job, so
``window_steps`` of them share one: a window's rows go to one task in the order
of the steps, and weights and optimizer state come back once a window.

Gradient rule: sum of per-row gradients / number of rows in the step, so an
empty or short shard contributes in proportion to its rows.
"""

from __future__ import annotations

import base64
import json
import math
import time
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.hashing import seeded_hash32, seeded_uniform
from kiln.models import build_model, make_optimizer
from kiln.models.nets import head_loss
from kiln.operators.exchange import gatherer
from kiln.operators.ranking import row_number_distributed
from kiln.session import delete_scratch, scratch_path

PARTIAL_SCHEMA = T.StructType([
    T.StructField("grad", T.ArrayType(T.DoubleType())),
    T.StructField("loss", T.DoubleType()),
    T.StructField("correct", T.LongType()),
    T.StructField("n", T.LongType()),
])
EVAL_SCHEMA = T.StructType([
    T.StructField("loss", T.DoubleType()),
    T.StructField("correct", T.LongType()),
    T.StructField("n", T.LongType()),
])

EPOCH_SCHEMA = T.StructType([
    T.StructField("params", T.ArrayType(T.DoubleType())), T.StructField("optimizer", T.StringType()),
    T.StructField("loss", T.ArrayType(T.DoubleType())), T.StructField("correct", T.ArrayType(T.LongType())),
    T.StructField("n", T.ArrayType(T.LongType()))])

@dataclass
class TrainConfig:
    iters: int = 10
    epochs: int = 0                   # > 0: iters = epochs x (largest shard's batch count)
    min_epochs: int = 0               # > 0: every round runs so many passes over its largest shard at least
    batch_size: int = 64
    partitions: int = 4
    lr: float = 0.001
    optimizer: str = "sgd"
    validation_pct: float = 0.0
    seed: int = 42
    shard_by: str = "hash"            # "hash" | "balanced" | "label" (hash of label, skewed)
    partition_shuffles: int = 1       # rounds; each round re-deals rows to shards
    full_batch: bool = False          # every step uses all rows of every shard
    drop_last: bool = False           # True: the tail of every shard stays out of an epoch
    redeal: bool = True               # rows change batches every epoch (within blocks of batches_per_folder)
    storage: str = "table"            # "table" (parquet in checkpoint dir) | "cache"
    feature_dtype: str = "float"      # "float" | "double"
    tree_reduce_above: int = 32
    eval_every: int = 0               # validation loss every k steps (0 = only at the end)
    keep_params: bool = False         # store the weights after every step in the history
    materialize_input: bool = True    # persist (id, label, features) while preparing and evaluating
    eval_at: tuple = ()               # also evaluate validation after these step counts
    eval_per_epoch: bool = False      # with ``epochs``: validate at the end of every epoch
    local_steps: int = 1              # > 1: local SGD, k minibatches per shard per job, deltas averaged
    layout_partitions: int = 0        # range partitions of the prepared table (0: max(P, shuffle partitions))
    batches_per_folder: int = 64      # prepared table folders: bgroup = batch div this
    window_work: int = 0              # multiplications of a step up to which many steps run in one job (WINDOW_WORK)


# fixed values: the largest primes below 2^31, multipliers of the re-deal
REDEAL_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543)


@dataclass
class TrainResult:
    model_config: dict
    params: np.ndarray
    history: list[dict] = field(default_factory=list)
    validation: dict | None = None
    seconds: float = 0.0
    config: dict | None = None
    steps: int = 0                    # minibatch steps that were run
    train_rows: int = 0               # rows to train on


def _features_matrix(col: pa.Array, n: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


CHUNK_ROWS = 2048           # rows per model call inside a task, fewer where
CHUNK_BYTES = 128 << 20     # im2col and activations of so many rows take more


def chunk_rows(model) -> int:
    return max(1, min(CHUNK_ROWS, CHUNK_BYTES // model.row_bytes))


def _chunks(m: int, model):
    rows = chunk_rows(model)
    for start in range(0, m, rows):
        yield slice(start, min(m, start + rows))


def _list_column(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.float64()))


def _gradient_fn(model_json: str, bc, step: int, seed: int):
    """mapInArrow body: one partial (grad, loss, correct, n) per task."""

    def run(batches):
        model = build_model(model_json)
        params = bc.value
        grad = np.zeros(model.n_params)
        loss, correct, n = 0.0, 0, 0
        for b in batches:
            m = b.num_rows
            if m == 0:
                continue
            X = _features_matrix(b.column("features"), m)
            y = b.column("label").to_numpy(zero_copy_only=False)
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            row_seeds = (np.int64(seed) * 1_000_003 + np.int64(step) * 7_919 + ids) & 0x7FFFFFFF
            for sl in _chunks(m, model):
                l_, g_, c_ = model.loss_grad(params, X[sl], y[sl], True, row_seeds[sl])
                grad += g_
                loss += l_
                correct += c_
            n += m
        if n == 0:
            return  # nothing read for this step: no partial row at all
        yield pa.RecordBatch.from_arrays(
            [_list_column(grad), pa.array([loss]), pa.array([correct], pa.int64()), pa.array([n], pa.int64())],
            schema=pa.schema([("grad", pa.list_(pa.float64())), ("loss", pa.float64()),
                              ("correct", pa.int64()), ("n", pa.int64())]))

    return run


def _local_sgd_fn(model_json: str, bc, first_local: int, first_step: int, k: int, lr: float, seed: int):
    """``groupBy(shard).applyInArrow`` body for ``local_steps = k``: the
    shard runs k SGD steps from the broadcast weights on its minibatches
    (``batch`` = ``first_local + i``) and returns its weight delta times
    its row count (``grad`` field); the driver divides the sum by all rows.
    With k = 1 this is one synchronous SGD step.  The group is k minibatches
    of one shard: bounded by k x B rows."""

    def run(tbl: pa.Table) -> pa.Table:
        model = build_model(model_json)
        params = bc.value
        w, loss, correct, m = params.copy(), 0.0, 0, 0
        if tbl.num_rows:
            X = _features_matrix(pa.concat_arrays(tbl.column("features").chunks), tbl.num_rows)
            y = tbl.column("label").to_numpy()
            ids = tbl.column("id").to_numpy().astype(np.int64)
            batch = tbl.column("batch").to_numpy()
            for i in range(k):
                sel = batch == first_local + i
                rows = int(sel.sum())
                if rows == 0:
                    continue
                step = first_step + i
                seeds = (np.int64(seed) * 1_000_003 + np.int64(step) * 7_919 + ids[sel]) & 0x7FFFFFFF
                l_, g_, c_ = model.loss_grad(w, X[sel], y[sel], True, seeds)
                w = w - lr * g_ / rows
                loss, correct, m = loss + l_, correct + c_, m + rows
        return pa.Table.from_arrays(
            [_list_column((w - params) * m), pa.array([loss]), pa.array([correct], pa.int64()),
             pa.array([m], pa.int64())],
            schema=pa.schema([("grad", pa.list_(pa.float64())), ("loss", pa.float64()),
                              ("correct", pa.int64()), ("n", pa.int64())]))

    return run


def _pack(values: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(values, np.float64)).decode()


def _unpack(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.float64)


def optimizer_state(opt) -> str:
    """An optimizer's numbers as text (vectors packed)."""
    return json.dumps({k: _pack(v) if isinstance(v, np.ndarray) else v for k, v in vars(opt).items()})


def restore_optimizer(opt, text: str):
    for k, v in json.loads(text).items():
        setattr(opt, k, _unpack(v).copy() if isinstance(v, str) else v)
    return opt


def _steps(batches, first: int, count: int):
    """The rows of each step, ``(ids, labels, features)``, out of Arrow
    batches sorted by step; a step without rows is None."""
    held, source = [], iter(batches)
    done = False
    for step in range(first, first + count):
        while not done and (not held or held[-1].column("batch")[-1].as_py() <= step):
            batch = next(source, None)
            if batch is None:
                done = True
            elif batch.num_rows:
                held.append(batch)
        own, rest = [], []
        for b in held:
            cut = int(np.searchsorted(b.column("batch").to_numpy(), step, side="right"))
            if cut:
                own.append(b.slice(0, cut))
            if cut < b.num_rows:
                rest.append(b.slice(cut))
        held = rest
        yield pa.Table.from_batches(own).combine_chunks().to_batches()[0] if own else None


def _epoch_fn(model_json: str, shared, optimizer: str, lr: float, first: int, count: int, first_step: int, seed: int,
              gather=None, folder: str | None = None):
    """``mapInArrow`` body over rows in the order of the steps: ``count`` steps
    of one shard in a barrier task, or of all shards where nothing is
    exchanged (``gather``).  ``folder``: where barrier tasks exchange files."""
    def run(batches):
        if gather is None:
            from pyspark import BarrierTaskContext
            context = BarrierTaskContext.get()
            exchange, speaker = gatherer(context, folder), context.partitionId() == 0
        else:
            exchange, speaker = gather
        model = build_model(model_json)
        params, state = shared.value
        params = params.copy()
        opt = restore_optimizer(make_optimizer(optimizer, lr), state)
        losses, rights, sizes = [], [], []
        for i, rows in enumerate(_steps(batches, first, count)):
            sums = np.zeros(model.n_params + 3)  # gradient, loss, correct, rows
            if rows is not None:
                m = rows.num_rows
                X = _features_matrix(rows.column("features"), m)
                y = rows.column("label").to_numpy(zero_copy_only=False)
                ids = rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
                seeds = (np.int64(seed) * 1_000_003 + np.int64(first_step + i) * 7_919 + ids) & 0x7FFFFFFF
                for sl in _chunks(m, model):
                    loss, grad, correct = model.loss_grad(params, X[sl], y[sl], True, seeds[sl])
                    sums[:-3] += grad
                    sums[-3:] += (loss, correct, len(y[sl]))
            # every task adds the same numbers in the same order
            total = sums if exchange is None else sum(_unpack(text) for text in exchange(_pack(sums)))
            n = total[-1]
            if n:
                params = opt.step(params, total[:-3] / n)
            losses.append(total[-3])
            rights.append(int(total[-2]))
            sizes.append(int(n))
        if speaker:
            one = lambda v, t: pa.array([v], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [one(params, pa.float64()), pa.array([optimizer_state(opt)]), one(losses, pa.float64()),
                 one(rights, pa.int64()), one(sizes, pa.int64())], names=EPOCH_SCHEMA.names)
    return run


def _sum_partials_fn():
    def run(batches):
        total, loss, correct, n = None, 0.0, 0, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            G = _features_matrix(b.column("grad"), b.num_rows)
            total = G.sum(axis=0) if total is None else total + G.sum(axis=0)
            loss += float(pc.sum(b.column("loss")).as_py() or 0.0)
            correct += int(pc.sum(b.column("correct")).as_py() or 0)
            n += int(pc.sum(b.column("n")).as_py() or 0)
        if total is None:
            return
        yield pa.RecordBatch.from_arrays(
            [_list_column(total), pa.array([loss]), pa.array([correct], pa.int64()), pa.array([n], pa.int64())],
            schema=pa.schema([("grad", pa.list_(pa.float64())), ("loss", pa.float64()),
                              ("correct", pa.int64()), ("n", pa.int64())]))
    return run


def _eval_fn(model_json: str, bc):
    def run(batches):
        model = build_model(model_json)
        params = bc.value
        loss, correct, n = 0.0, 0, 0
        for b in batches:
            m = b.num_rows
            if m == 0:
                continue
            X = _features_matrix(b.column("features"), m)
            y = b.column("label").to_numpy(zero_copy_only=False)
            for sl in _chunks(m, model):
                l_, _, c_ = head_loss(model.scores(params, X[sl]), y[sl], model.task)
                loss, correct = loss + l_, correct + c_
            n += m
        yield pa.RecordBatch.from_pydict({"loss": [loss], "correct": [correct], "n": [n]},
                                         schema=pa.schema([("loss", pa.float64()), ("correct", pa.int64()),
                                                           ("n", pa.int64())]))
    return run


def standardize_input(df: DataFrame, id_col: str, label_col: str, features_col: str,
                      dtype: str = "float") -> DataFrame:
    """``(id, label, features ARRAY<dtype>)``; ML vectors are densified JVM-side."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    fcol = F.col(features_col)
    if isinstance(df.schema[features_col].dataType, VectorUDT):
        fcol = vector_to_array(fcol, "float32" if dtype == "float" else "float64")
    return df.select(F.col(id_col).cast("bigint").alias("id"),
                     F.col(label_col).cast("double").alias("label"),
                     fcol.cast(f"array<{dtype}>").alias("features"))


def with_split(df: DataFrame, seed: int, validation_pct: float) -> DataFrame:
    u = seeded_uniform(seed, F.lit("split"), "id")
    return df.withColumn("split", F.when(u < F.lit(validation_pct), F.lit("validation")).otherwise(F.lit("train")))


def assign_shards_and_batches(train: DataFrame, cfg: TrainConfig, round_no: int,
                              keep: list | None = None) -> DataFrame:
    """Add ``shard``, ``batch`` and ``n_batches`` for one training round.

    * ``hash`` (default): shard = pmod(md5 key, P); one range shuffle over
      (shard, key) numbers the rows inside each shard *and* leaves them laid
      out by (shard, batch) in P partitions, ready to be written.
    * ``label``: shard = Spark's hash partition of the label (the skewed
      ``repartition(P, label)`` layout); a hot shard is spread over several
      range partitions by the same shuffle.  Later rounds re-deal by hash.
    * ``balanced``: round-robin over the seeded order (shard sizes within one
      row, like ``repartition(P)``); needs a global rank, so the layout costs
      a second shuffle.
    """
    P, B = cfg.partitions, cfg.batch_size
    M = layout_partitions(train.sparkSession, cfg)
    key = seeded_hash32(cfg.seed, F.lit(f"round{round_no}"), "id")
    if cfg.full_batch:
        return (train.withColumn("shard", F.pmod(key, F.lit(P)).cast("int"))
                .withColumn("batch", F.lit(0).cast("bigint"))
                .withColumn("n_batches", F.lit(1).cast("bigint"))
                .withColumn("pos", F.lit(0).cast("bigint"))
                .withColumn("n_rows", F.lit(1).cast("bigint")))
    keyed = train.withColumn("_k_key", key)
    if cfg.shard_by == "balanced":
        ranked = row_number_distributed(keyed, ["_k_key", "id"], out="_k_rn", group_size="_k_n", few_groups=True,
                                        materialize="persist" if keep is not None else "checkpoint", keep=keep)
        r0 = F.col("_k_rn") - 1
        ranked = ranked.withColumn("shard", F.pmod(r0, F.lit(P)).cast("int"))
        idx = F.floor(r0 / F.lit(P))
        n_s = F.floor((F.col("_k_n") - 1 - F.col("shard")) / F.lit(P)) + 1
    else:
        if cfg.shard_by == "label" and round_no == 0:
            shard = F.pmod(F.hash(F.col("label").cast("int")), F.lit(P))
        else:
            shard = F.pmod(seeded_hash32(cfg.seed, F.lit(f"shard{round_no}"), "id"), F.lit(P))
        keyed = keyed.withColumn("shard", shard.cast("int"))
        ranked = row_number_distributed(keyed, ["_k_key", "id"], ["shard"], out="_k_rn", group_size="_k_n",
                                        num_partitions=M, few_groups=True,  # P groups
                                        materialize="persist" if keep is not None else "checkpoint", keep=keep)
        idx, n_s = F.col("_k_rn") - 1, F.col("_k_n")
    out = (ranked.withColumn("batch", F.floor(idx / F.lit(B)).cast("bigint"))
           .withColumn("n_batches", (F.floor(n_s / F.lit(B)) if cfg.drop_last else F.ceil(n_s / F.lit(B)))
                       .cast("bigint"))
           .withColumn("pos", idx.cast("bigint")).withColumn("n_rows", n_s.cast("bigint")))
    if cfg.drop_last and not cfg.redeal:
        out = out.filter(F.col("batch") < F.col("n_batches"))
    return out.drop("_k_key", "_k_rn", "_k_n")


def redealt_batch(step: int, cfg: TrainConfig, epoch=None):
    """The batch a row is in at ``step`` (or in ``epoch``).  Epoch ``step div n_batches`` of a
    shard permutes the positions of each block of ``batches_per_folder``
    batches (``a r + c mod rows``, with a prime ``a``, so it is one to one):
    batches keep their sizes, a dropped tail changes, and the rows of a step
    stay in one folder of the layout."""
    if not cfg.redeal:
        return F.col("batch")
    block = cfg.batches_per_folder * cfg.batch_size
    if epoch is None:
        epoch = F.floor(F.lit(step) / F.col("n_batches"))
    base = F.floor(F.col("pos") / F.lit(block)) * F.lit(block)
    rows = F.least(F.lit(block), F.col("n_rows") - base)
    a = F.element_at(F.array(*[F.lit(p) for p in REDEAL_PRIMES]),
                     (F.pmod(epoch, F.lit(len(REDEAL_PRIMES))) + 1).cast("int"))
    c = F.xxhash64(F.lit(cfg.seed), epoch, base)
    moved = F.pmod(F.pmod(F.pmod(F.col("pos") - base, rows) * a, rows) + F.pmod(c, rows), rows)
    return F.when(epoch == 0, F.col("batch")).otherwise(
        F.floor((base + moved) / F.lit(cfg.batch_size)).cast("bigint"))


LAYOUT_TARGET_BYTES = 128 * 1024 * 1024


def layout_partitions(spark, cfg: TrainConfig) -> int:
    """Range partitions of the prepared table: at least one per shard
    (``train`` sizes it from the data: about 128 MB per file), so a shard of
    a large table spans several right-sized files and a small table keeps
    one file per shard."""
    if cfg.layout_partitions:
        return max(cfg.partitions, cfg.layout_partitions)
    return max(cfg.partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized_layout(train_rows: DataFrame, cfg: TrainConfig) -> int:
    """Files needed for ~128 MB each (rows x estimated row width), at least
    one per shard.  One aggregate over the persisted input."""
    r = train_rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    n = r["n"]
    width = 4 * (r["d"] or 1) * (2 if cfg.feature_dtype == "double" else 1) + 48
    want = int(math.ceil(n * width / LAYOUT_TARGET_BYTES))
    return max(cfg.partitions, want)


WINDOW_BYTES = 64 * 1024 * 1024
WINDOW_WORK = 1 << 27      # takes about as long as the start of a job


def window_steps(model, cfg: TrainConfig) -> int:
    """Steps that one job runs.  A step whose arithmetic takes less time than
    the start of a job shares its job with the next ones, as far as their
    rows stay below ``WINDOW_BYTES``; larger steps, and those whose weights
    are kept, are jobs of their own."""
    rows = cfg.batch_size * cfg.partitions
    if cfg.full_batch or cfg.local_steps > 1 or cfg.keep_params or rows * model.work > cfg.window_work:
        return 1
    width = model.inputs * (8 if cfg.feature_dtype == "double" else 4) + 48
    return max(1, WINDOW_BYTES // (rows * width))


def _run_window(prepared: PreparedRound, model, params, opt, cfg: TrainConfig, local: int, step: int, k: int):
    """``k`` synchronous steps in one job: the rows of the window go to one
    task in the order of the steps, which adds up each step's gradient over
    all shards and updates.  Returns (params, optimizer, losses, correct,
    rows), the last three per step."""
    spark = prepared.table.sparkSession
    shared = spark.sparkContext.broadcast((params, optimizer_state(opt)))
    try:
        rows = (prepared.window_rows(local, k).select("id", "label", "features", "batch")
                .repartition(1).sortWithinPartitions("batch", "id"))
        row = rows.mapInArrow(_epoch_fn(model.to_json(), shared, cfg.optimizer, cfg.lr, local, k, step, cfg.seed,
                                        gather=(None, True)), EPOCH_SCHEMA).toArrow().to_pylist()[0]
    finally:
        shared.destroy()
    return (np.array(row["params"]), restore_optimizer(opt, row["optimizer"]), row["loss"], row["correct"], row["n"])


def _already_laid_out(cfg: TrainConfig) -> bool:
    """The ranking shuffle of hash/label sharding already range-partitioned
    the rows by (shard, key): rows of a shard are contiguous and batches
    come in order, so no second shuffle is needed before writing."""
    return not cfg.full_batch and cfg.shard_by != "balanced"


class PreparedRound:
    """Batch-numbered training rows of one round, stored for repeated reads."""

    def __init__(self, df: DataFrame, cfg: TrainConfig, tag: str, intermediates: list | None = None):
        spark = df.sparkSession
        self.cfg = cfg
        self.per_folder = cfg.batches_per_folder
        self.n_tasks = None
        rows = df.select("id", "label", "features", "shard", "batch", "n_batches", "pos", "n_rows",
                         F.floor(F.col("batch") / F.lit(self.per_folder)).cast("bigint").alias("bgroup"))
        M = layout_partitions(spark, cfg)
        if cfg.full_batch or _already_laid_out(cfg):
            # full batch: every step reads every row where the input split
            # put it, no shuffle; else the ranking shuffle left them in order
            laid_out = rows
        else:
            laid_out = rows.repartitionByRange(M, "shard", "batch").sortWithinPartitions("shard", "batch", "id")
        self._cached = None
        if cfg.storage == "table":
            self.path = scratch_path(spark, tag)
            # folders by batch group (pruned while planning a step), files
            # sorted by (shard, batch) (row groups pruned by batch statistics)
            (laid_out.write.mode("overwrite").option("parquet.block.size", 8 * 1024 * 1024)
             .partitionBy("bgroup").parquet(self.path))
            self.table = spark.read.schema(rows.schema).parquet(self.path)
        else:
            self.path = None
            self._cached = laid_out.persist(StorageLevel.MEMORY_AND_DISK)
            self.table = self._cached
        self._intermediates = intermediates or []
        if self._cached is None:
            for cached in self._intermediates:  # written: the ranking intermediates can go
                cached.unpersist()
        # one row per shard: bounded by the partition count
        shards = self.table.groupBy("shard").agg(F.max("n_batches").alias("n_batches"),
                                                 F.count(F.lit(1)).alias("rows")).collect()
        self.shard_batches = {int(r["shard"]): int(r["n_batches"]) for r in shards}
        self.rows = sum(int(r["rows"]) for r in shards)
        if not any(self.shard_batches.values()):
            self.release()
            raise ValueError("no training rows" if not self.shard_batches else
                             f"no shard has a full batch of {cfg.batch_size} rows and drop_last is set")

    def _wanted(self, first: int, k: int) -> list[int]:
        """Batches of some shard among steps first .. first+k-1: at most one
        a step and distinct shard size."""
        return sorted({(first + i) % nb for nb in set(self.shard_batches.values()) if nb > 0 for i in range(k)})

    def window_rows(self, first: int, k: int) -> DataFrame:
        """Rows of steps ``first .. first+k-1``, ``batch`` being the step: a
        row comes once for each epoch of its shard that has it in the window,
        dealt as in that epoch."""
        sizes = [nb for nb in self.shard_batches.values() if nb > 0]
        rows = self.table
        if k < max(sizes):  # else every batch is wanted
            wanted = self._wanted(first, k)
            rows = rows.filter(F.col("bgroup").isin(sorted({w // self.per_folder for w in wanted})))
            if first + k <= min(sizes):
                rows = rows.filter(F.col("batch").isin(wanted))  # first epoch of all shards: pushed into the scan
        rows = rows.filter(F.col("n_batches") > 0)
        nb = F.greatest(F.col("n_batches"), F.lit(1))
        rows = rows.withColumn("_k_epoch", F.explode(F.sequence(F.floor(F.lit(first) / nb),
                                                                F.floor(F.lit(first + k - 1) / nb))))
        rows = rows.withColumn("batch", redealt_batch(first, self.cfg, F.col("_k_epoch")))
        rows = rows.filter(F.col("batch") < F.col("n_batches"))
        rows = rows.withColumn("batch", F.col("_k_epoch") * F.col("n_batches") + F.col("batch")).drop("_k_epoch")
        return rows.filter((F.col("batch") >= first) & (F.col("batch") < first + k))

    def step_rows(self, local_step: int) -> DataFrame:
        """Rows of one step.  The folder condition prunes at planning time;
        where all shards are in their first epoch, or rows keep their
        batches, the batch list is pushed into the parquet scan too."""
        wanted = self._wanted(local_step, 1)
        cond = redealt_batch(local_step, self.cfg) == F.pmod(F.lit(local_step), F.col("n_batches"))
        first_epoch = local_step < min(nb for nb in self.shard_batches.values() if nb > 0)
        if first_epoch or not self.cfg.redeal:
            cond = F.col("batch").isin(wanted) & (F.col("batch") == F.pmod(F.lit(local_step), F.col("n_batches")))
        return self.table.filter(F.col("bgroup").isin(sorted({w // self.per_folder for w in wanted})) & cond)

    def release(self):
        """Free what the round kept; its table is deleted."""
        if self._cached is not None:
            self._cached.unpersist()
            for cached in self._intermediates:
                cached.unpersist()
        if self.path is not None:
            delete_scratch(self.table.sparkSession, self.path)


def _reduce_partials(partials: DataFrame, cfg: TrainConfig, n_tasks: int | None = None):
    """Sum the per-task partial rows (model-sized each).  Up to
    ``tree_reduce_above`` tasks the rows come to the driver as Arrow; beyond
    that one more Spark level sums them in about sqrt(#tasks) groups first.
    ``n_tasks`` is the caller's known task count (planning it costs a
    physical plan of its own)."""
    if n_tasks is None:
        n_tasks = partials.rdd.getNumPartitions()
    if n_tasks > cfg.tree_reduce_above:
        partials = (partials.repartition(int(math.ceil(math.sqrt(n_tasks))))
                    .mapInArrow(_sum_partials_fn(), PARTIAL_SCHEMA))
    tbl = partials.toArrow()
    if tbl.num_rows == 0:
        return None, 0.0, 0, 0
    G = _features_matrix(pa.concat_arrays(tbl.column("grad").chunks), tbl.num_rows)
    return (G.sum(axis=0), float(pc.sum(tbl.column("loss")).as_py() or 0.0),
            int(pc.sum(tbl.column("correct")).as_py() or 0), int(pc.sum(tbl.column("n")).as_py() or 0))


def evaluate(df: DataFrame, model_config: dict, params: np.ndarray) -> dict:
    """Mean loss and accuracy of ``(id, label, features)`` rows; one
    fixed-size partial per task, summed by Spark."""
    spark = df.sparkSession
    model = build_model(model_config)
    bc = spark.sparkContext.broadcast(params)
    try:
        r = (df.select("id", "label", "features")
             .mapInArrow(_eval_fn(model.to_json(), bc), EVAL_SCHEMA)
             .agg(F.sum("loss").alias("loss"), F.sum("correct").alias("correct"), F.sum("n").alias("n"))
             .first())
    finally:
        bc.destroy()
    n = int(r["n"] or 0)
    return {"loss": (r["loss"] / n) if n else None,
            "accuracy": (r["correct"] / n) if n and model.task == "classification" else None, "n": n}


def train(df: DataFrame, model_config: dict, cfg: TrainConfig, id_col: str = "id",
          label_col: str = "label", features_col: str = "features", init_params=None,
          validation: DataFrame | None = None, eval_per_epoch: bool | None = None) -> TrainResult:
    """Synchronous data-parallel training; returns weights and history.
    ``validation``: rows to evaluate on (same columns) instead of a share of
    ``df``."""
    if eval_per_epoch is not None:
        cfg = replace(cfg, eval_per_epoch=eval_per_epoch)
    if validation is not None and cfg.validation_pct > 0:
        raise ValueError("give validation rows or validation_pct, not both")
    if cfg.local_steps > 1 and cfg.optimizer != "sgd":
        raise ValueError("local_steps > 1 averages plain SGD runs; use optimizer='sgd'")
    spark = df.sparkSession
    sc = spark.sparkContext
    model = build_model(model_config)
    params = np.asarray(init_params, dtype=np.float64) if init_params is not None else model.init(cfg.seed)
    opt = make_optimizer(cfg.optimizer, cfg.lr)
    base = standardize_input(df, id_col, label_col, features_col, cfg.feature_dtype)
    persisted = None
    if cfg.materialize_input:
        # feature expressions run once: range sampling, every round and the
        # validation pass read the persisted rows (as Spark ML persists its
        # training instances); the prepared table written per round is what
        # cuts lineage for the step jobs
        persisted = base = base.persist(StorageLevel.MEMORY_AND_DISK)
    if cfg.validation_pct > 0:
        base = with_split(base, cfg.seed, cfg.validation_pct)
        train_rows = base.filter(F.col("split") == "train").drop("split")
        val_rows = base.filter(F.col("split") == "validation").drop("split")
    else:
        train_rows, val_rows = base, None
        if validation is not None:
            val_rows = standardize_input(validation, id_col, label_col, features_col, cfg.feature_dtype)

    try:
        if not cfg.layout_partitions:
            cfg = replace(cfg, layout_partitions=sized_layout(train_rows, cfg))
        rounds = max(1, cfg.partition_shuffles)
        total_iters = cfg.iters
        eval_every = cfg.eval_every
        per_round = int(math.ceil(total_iters / rounds))
        history: list[dict] = []
        t_start = time.time()
        step = 0
        train_count = 0
        window = window_steps(model, cfg)

        def validate_if_due(rnd: int):
            due = (eval_every and step % eval_every == 0) or step in cfg.eval_at
            if due and val_rows is not None:
                v = evaluate(val_rows, model.config(), params)
                history.append({"round": rnd, "iter": step - 1, "split": "validation", "n": v["n"],
                                "loss": v["loss"], "acc": v["accuracy"], "seconds": time.time() - t_start})

        for rnd in range(rounds):
            if rnd * per_round >= total_iters:
                break
            keep: list = []
            prepared = PreparedRound(assign_shards_and_batches(train_rows, cfg, rnd, keep), cfg, f"train-r{rnd}", keep)
            train_count = max(train_count, prepared.rows)
            # an epoch = one pass over the largest shard's batches
            per_epoch = max([1] + list(prepared.shard_batches.values()))
            if cfg.epochs and rnd == 0:
                total_iters = cfg.epochs * per_epoch
                per_round = int(math.ceil(total_iters / rounds))
                if cfg.eval_per_epoch:
                    eval_every = per_epoch
            round_steps = max(min(per_round, total_iters - rnd * per_round), cfg.min_epochs * per_epoch)
            try:
                local = 0
                while local < round_steps:
                    t0 = time.time()
                    k = min(window, round_steps - local)
                    if eval_every:  # a window ends where the weights are evaluated
                        k = min(k, eval_every - step % eval_every)
                    k = min([k] + [at - step for at in cfg.eval_at if at > step])
                    if k > 1:
                        params, opt, losses, rights, sizes = _run_window(prepared, model, params, opt, cfg, local,
                                                                         step, k)
                        each = (time.time() - t0) / k
                        for i, (loss, correct, n) in enumerate(zip(losses, rights, sizes)):
                            if n == 0:
                                raise RuntimeError(f"step {step + i} of round {rnd} read no rows")
                            history.append({"round": rnd, "iter": step + i, "split": "train", "n": n,
                                            "loss": loss / n,
                                            "acc": correct / n if model.task == "classification" else None,
                                            "seconds": each})
                        step, local = step + k, local + k
                        validate_if_due(rnd)
                        continue
                    k = min(cfg.local_steps, round_steps - local)
                    bc = sc.broadcast(params)
                    try:
                        if cfg.local_steps > 1:
                            partials = (prepared.window_rows(local, k)
                                        .select("id", "label", "features", "shard", "batch", "n_batches")
                                        .groupBy("shard")
                                        .applyInArrow(_local_sgd_fn(model.to_json(), bc, local, step, k, cfg.lr,
                                                                    cfg.seed), PARTIAL_SCHEMA))
                        else:
                            partials = prepared.step_rows(local).select("id", "label", "features").mapInArrow(
                                _gradient_fn(model.to_json(), bc, step, cfg.seed), PARTIAL_SCHEMA)
                        if prepared.n_tasks is None:
                            # the layout is fixed for the round: every step plans
                            # the same number of scan tasks, counted once
                            prepared.n_tasks = partials.rdd.getNumPartitions()
                        g, loss, correct, n = _reduce_partials(partials, cfg, prepared.n_tasks)
                    finally:
                        bc.destroy()
                    if n == 0:
                        raise RuntimeError(f"step {step} of round {rnd} read no rows")
                    params = params + g / n if cfg.local_steps > 1 else opt.step(params, g / n)
                    rec = {"round": rnd, "iter": step, "split": "train", "n": n,
                           "loss": loss / n,
                           "acc": correct / n if model.task == "classification" else None,
                           "seconds": time.time() - t0}
                    if cfg.keep_params:
                        rec["params"] = params.copy()
                    history.append(rec)
                    step += k
                    local += k
                    validate_if_due(rnd)
            finally:
                prepared.release()
        seconds = time.time() - t_start
        validation = evaluate(val_rows, model.config(), params) if val_rows is not None else None
    finally:
        if persisted is not None:
            persisted.unpersist()
    return TrainResult(model.config(), params, history, validation, seconds, asdict(cfg), step, train_count)


HISTORY_SCHEMA = T.StructType([
    T.StructField("round", T.IntegerType()), T.StructField("iter", T.IntegerType()),
    T.StructField("split", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("loss", T.DoubleType()), T.StructField("acc", T.DoubleType()),
    T.StructField("seconds", T.DoubleType()),
])


def history_frame(spark, result: TrainResult) -> DataFrame:
    """The training history (one row per step; bounded by ``iters``)."""
    rows = [(int(h["round"]), int(h["iter"]), h["split"], int(h["n"]),
             None if h["loss"] is None else float(h["loss"]),
             None if h["acc"] is None else float(h["acc"]), float(h["seconds"])) for h in result.history]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def predict_column(spark, model_config: dict, params: np.ndarray, features_col: str = "features"):
    """A vectorised (Arrow-batched, ``arrow_udf``) scoring column: class
    index for classifiers, the output for regressors.  Weights travel as a
    broadcast."""
    model = build_model(model_config)
    model_json = model.to_json()
    bc = spark.sparkContext.broadcast(np.asarray(params, dtype=np.float64))

    @F.arrow_udf(T.DoubleType())
    def _predict(feats: pa.Array) -> pa.Array:
        # the batch's list column as one flat buffer: no per-row objects
        m = build_model(model_json)
        n = len(feats)
        if n == 0:
            return pa.array([], pa.float64())
        X = _features_matrix(feats, n)
        out = np.empty(n)
        for sl in _chunks(n, m):
            S = m.scores(bc.value, X[sl])
            out[sl] = S.argmax(axis=1) if m.task == "classification" else S[:, 0]
        return pa.array(out, pa.float64())

    return _predict(F.col(features_col)), bc
