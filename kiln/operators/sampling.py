"""Seeded ordering, splitting, sharding and minibatching.

Every operator is a pure function of (seed, row key), so the answer does not
depend on how the input happens to be partitioned, and a re-executed task
reproduces exactly the rows it produced before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.hashing import seeded_hash32, seeded_uniform
from kiln.operators.ranking import row_number_distributed


def with_shuffle_key(df: DataFrame, seed: int, id_col: str, out: str = "shuffle_key",
                     salt: str | int | None = None) -> DataFrame:
    """Replayable stand-in for ``orderBy(rand())``: a 32-bit md5 key per row."""
    parts = ([F.lit(str(salt))] if salt is not None else []) + [id_col]
    return df.withColumn(out, seeded_hash32(seed, *parts))


def shuffle_rank(df: DataFrame, seed: int, id_col: str, out: str = "rank") -> DataFrame:
    """Position of every row in the seeded random order (1-based)."""
    keyed = with_shuffle_key(df, seed, id_col, "_k_key")
    return row_number_distributed(keyed, ["_k_key", id_col], out=out).drop("_k_key")


def split_fraction(df: DataFrame, seed: int, id_col: str, weights: Sequence[float],
                   names: Sequence[str] = ("train", "test"), out: str = "split") -> DataFrame:
    """``randomSplit(weights)`` as a column: row goes to the bucket whose
    cumulative share contains u = uniform(seed, id).  One pass, no shuffle."""
    if len(weights) != len(names):
        raise ValueError("one name per weight")
    total = float(sum(weights))
    u = seeded_uniform(seed, F.lit("split"), id_col)
    acc = 0.0
    expr: Column | None = None
    for w, name in zip(weights[:-1], names[:-1]):
        acc += w / total
        cond = u < F.lit(acc)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return df.withColumn(out, expr)


SELECT_BITS = 16  # histogram of the top 16 of the 32 key bits: at most 65,536 rows


def kth_pair(keyed: DataFrame, key_col: str, id_col: str, k: int):
    """The ``k``-th smallest ``(key, id)`` pair (1-based) of 32-bit keys, or
    None if there are fewer rows.  Exact selection without sorting the
    table: a histogram of the top key bits (partially aggregated per task,
    at most 2^16 rows to the driver) finds the bucket holding rank ``k``;
    only that bucket's pairs (about N / 65,536 for hashed keys) are ranked."""
    bucket = F.shiftright(F.col(key_col), 32 - SELECT_BITS)
    pairs = keyed.select(key_col, id_col)
    hist = sorted((int(r["b"]), int(r["n"]))
                  for r in pairs.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = 0
    for b, n in hist:
        if before + n >= k:
            break
        before += n
    else:
        return None
    inside = pairs.filter(bucket == F.lit(b))
    ranked = row_number_distributed(inside, [key_col, id_col], out="_k_rn")
    t = ranked.filter(F.col("_k_rn") == k - before).select(key_col, id_col).first()
    return t[key_col], t[id_col]


def split_exact(df: DataFrame, seed: int, id_col: str, holdout: int,
                names: Sequence[str] = ("train", "validation"), out: str = "split") -> DataFrame:
    """``random_split(ds, [n - v, v])``: exactly ``holdout`` rows (the first in
    the seeded order) go to ``names[1]``.

    The ``holdout``-th (key, id) pair is found by ``kth_pair`` (two narrow
    scans of the keys, a shuffle of one histogram bucket); the split itself
    is then a projection of the original rows, so nothing wide is shuffled."""
    key = seeded_hash32(seed, F.lit("split"), id_col)
    keyed = df.withColumn("_k_key", key)
    if holdout <= 0:
        return df.withColumn(out, F.lit(names[0]))
    t = kth_pair(keyed, "_k_key", id_col, holdout)
    if t is None:  # fewer rows than the hold-out: every row is held out
        return df.withColumn(out, F.lit(names[1]))
    k, i = t
    held = (F.col("_k_key") < F.lit(k)) | ((F.col("_k_key") == F.lit(k)) & (F.col(id_col) <= F.lit(i)))
    return keyed.withColumn(out, F.when(held, F.lit(names[1])).otherwise(F.lit(names[0]))).drop("_k_key")


def hash_shard(df: DataFrame, seed: int, id_col: str, shards: int, out: str = "shard",
               round_col: str | int | None = None) -> DataFrame:
    """Shard = pmod(hash(seed, [round,] id), shards) (sizes are binomial)."""
    parts = [id_col]
    if round_col is not None:
        parts.insert(0, F.lit(str(round_col)) if isinstance(round_col, int) else round_col)
    return df.withColumn(out, F.pmod(seeded_hash32(seed, F.lit("shard"), *parts), F.lit(shards)))


def label_shard(df: DataFrame, label_col: str, shards: int, out: str = "shard") -> DataFrame:
    """The deliberate skew of ``repartition(n, label)``: the shard is the
    partition Spark's hash partitioner would pick for the label."""
    return df.withColumn(out, F.pmod(F.hash(F.col(label_col)), F.lit(shards)))


def balanced_shards(df: DataFrame, seed: int, id_col: str, shards: int,
                    shard_col: str = "shard", index_col: str = "shard_index") -> DataFrame:
    """Round-robin over the seeded order: shard = (rank-1) mod P and the
    row's position inside its shard = (rank-1) div P.  Shard sizes differ by
    at most one row, like ``repartition(P)``."""
    ranked = shuffle_rank(df, seed, id_col, out="_k_rank")
    r0 = F.col("_k_rank") - 1
    return (ranked.withColumn(shard_col, F.pmod(r0, F.lit(shards)).cast("int"))
            .withColumn(index_col, F.floor(r0 / F.lit(shards)).cast("bigint"))
            .drop("_k_rank"))


def assign_minibatches(df: DataFrame, batch_size: int, order_by: Sequence[str],
                       shard_col: str | Sequence[str] | None = None, drop_last: bool = True,
                       out: str = "batch", few_groups: bool = False) -> DataFrame:
    """DataLoader(batch_size, drop_last) per shard: number rows in
    ``order_by`` order inside each shard, ``batch = (rn-1) div B``; with
    ``drop_last`` the incomplete tail batch of every shard is removed.
    Adds ``batch`` and ``n_batches`` (full batches in the row's shard)."""
    part = [shard_col] if isinstance(shard_col, str) else list(shard_col or [])
    ranked = row_number_distributed(df, list(order_by), part, out="_k_rn",
                                    group_size="_k_n", few_groups=few_groups)
    res = (ranked.withColumn(out, F.floor((F.col("_k_rn") - 1) / F.lit(batch_size)).cast("bigint"))
           .withColumn("n_batches", F.floor(F.col("_k_n") / F.lit(batch_size)).cast("bigint")))
    if drop_last:
        res = res.filter(F.col(out) < F.col("n_batches"))
    else:
        res = res.withColumn("n_batches", F.ceil(F.col("_k_n") / F.lit(batch_size)).cast("bigint"))
    return res.drop("_k_rn", "_k_n")


def reshuffle_rounds(df: DataFrame, seed: int, id_col: str, rounds: int, shards: int,
                     round_col: str = "round", shard_col: str = "shard") -> DataFrame:
    """``partitionShuffles=k``: a fresh seeded shard per round.  One row per
    (row, round); the expansion factor is the ``rounds`` parameter."""
    expanded = df.withColumn(round_col, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return expanded.withColumn(
        shard_col, F.pmod(seeded_hash32(seed, F.lit("shard"), round_col, id_col), F.lit(shards)))


def batch_plan(df: DataFrame, batch_size: int, shard_col: str = "shard") -> DataFrame:
    """Per shard: rows, full batches, rows used and rows dropped by drop_last."""
    return (df.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("n_batches", F.floor(F.col("n_rows") / F.lit(batch_size)).cast("bigint"))
            .withColumn("rows_used", (F.col("n_batches") * F.lit(batch_size)).cast("bigint"))
            .withColumn("rows_dropped", (F.col("n_rows") - F.col("rows_used")).cast("bigint")))
