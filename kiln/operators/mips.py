"""Exact top-k by inner product among the items a user has not seen.

Items are numbered by falling norm and cut into blocks of bounded bytes.  One
round scores one block for the users that still need it.  By Cauchy-Schwarz no
item from there on beats ``|user| * largest norm``, and by Hoelder none beats
``largest entry of the user * largest sum of an item's entries`` (absolute
values; the tighter one where items have few entries); a user whose k-th score
is above either is finished with all later items.  Inside a task the
same bound skips parts of a block.  A user carries k candidates and nothing
else; the user x item product is neither formed nor shuffled, and what a user
has seen is joined block by block, so a user with very many items never brings
more than a block of them to a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.joins import BROADCAST_MAX_BYTES
from kiln.operators.ranking import row_number_distributed
from kiln.operators.scratch import drop, store

BLOCK_BYTES = 32 << 20   # of item vectors: broadcast, one block a round
PART = 2048              # items, and
USERS = 512              # users, that are scored at a time
SLACK = 1 + 1e-9         # rounding of norms and sums: a bound is never too small
_TOP = "array<struct<score:double,item:long>>"


def _norm(vec: str):
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _peak(vec: str):
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x.cast("double"))))


def _reach(vec: str):
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))


def block_rows(dim: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, block_bytes // (8 * dim + 24))


def _best(row, score, item, rows, k):
    """The first k of every row by (score falling, item rising):
    (row, score, item) in that order."""
    order = np.lexsort((item, -score, row))
    row, score, item = row[order], score[order], item[order]
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
    keep = nth < k
    return row[keep], score[keep], item[keep]


def merge_block(vecs, norms, top, seen, items, vectors, item_norms, k):
    """Candidates ``top`` = (row, score, item) of a batch of users after a
    block.  ``seen`` = (row, position in the block), sorted by row; ``items``
    are in falling order of ``item_norms``."""
    rows = len(vecs)
    peaks = np.abs(vecs).max(axis=1)
    # the largest sum of entries among an item and those after it
    reach = np.maximum.accumulate(np.abs(vectors).sum(axis=1)[::-1])[::-1]
    row, score, item = top
    seen_row, seen_at = seen
    for lo in range(0, len(items), PART):
        hi = min(lo + PART, len(items))
        count = np.bincount(row, minlength=rows)
        bar = np.full(rows, -np.inf)
        full = count == k
        ends = np.cumsum(count)
        bar[full] = score[ends[full] - 1]
        need = np.flatnonzero(np.minimum(norms * item_norms[lo], peaks * reach[lo]) * SLACK >= bar)
        if not len(need):
            break
        got = vecs[need] @ vectors[lo:hi].T
        inside = (seen_at >= lo) & (seen_at < hi)
        where = np.full(rows, -1)
        where[need] = np.arange(len(need))
        mine = where[seen_row[inside]]
        got[mine[mine >= 0], seen_at[inside][mine >= 0] - lo] = -np.inf
        # entries that can be among the k best, all ties of the last included
        if hi - lo > k:
            last = np.partition(got, hi - lo - k, axis=1)[:, hi - lo - k]
        else:
            last = np.full(len(need), -np.inf)
        limit = np.maximum(last, bar[need])
        r, c = np.nonzero((got >= limit[:, None]) & (got > -np.inf))
        row, score, item = _best(np.concatenate([row, need[r]]), np.concatenate([score, got[r, c]]),
                                 np.concatenate([item, items[lo:hi][c]]), rows, k)
    return row, score, item


def _lists(batch, column, fields):
    """(row, values of each field) of a list-of-structs (or list) column."""
    lists = batch.column(column)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = [flat.field(f) for f in fields] if fields else [flat]
    return [np.repeat(np.arange(len(size)), size), *[v.to_numpy(zero_copy_only=False) for v in values]]


def _score(block, k: int, dim: int):
    """``mapInArrow`` function over (user, vec, norm, top, seen)."""
    def run(batches):
        items, vectors, norms = block.value
        for whole in batches:
            for lo in range(0, whole.num_rows, USERS):
                batch = whole.slice(lo, USERS)
                n = batch.num_rows
                vecs = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
                row, score, item = merge_block(
                    vecs, batch.column(2).to_numpy(), _lists(batch, 3, ("score", "item")), _lists(batch, 4, ()),
                    items, vectors, norms, k)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                top = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                    [pa.array(score), pa.array(item.astype(np.int64))], names=["score", "item"]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], top], names=["user", "vec", "norm", "top"])
    return run


def top_unseen(users: DataFrame, items: DataFrame, seen: DataFrame, k: int = 10,
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(user, rank, item, score)``: per user of ``users (user, vec)`` the
    ``k`` items of ``items (item, vec)`` with the largest inner products that
    ``seen (user, item)`` does not hold; equal scores by item.

    Users and items are unique numbers; scores are float64 sums.  A user with
    fewer unseen items has fewer rows; pairs of unknown users or items in
    ``seen``, repeated ones and nulls change nothing; vectors of different
    lengths, or with a null or NaN, raise."""
    spark = users.sparkSession
    shape = items.select("vec").unionByName(users.select("vec")).agg(
        F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"),
        F.max(F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x.cast("double")))).alias("bad")).first()
    empty = spark.createDataFrame([], f"user {users.schema['user'].dataType.simpleString()}, rank int, item long, score double")
    if shape["bad"] is None:
        return empty
    if shape["bad"] or shape["lo"] != shape["hi"] or shape["lo"] < 1:
        raise ValueError("vectors must have one length and only numbers")
    dim = int(shape["hi"])
    per_block = block_rows(dim, block_bytes)
    placed = row_number_distributed(
        items.select(F.col("item").cast("long").alias("item"), "vec", _norm("vec").alias("norm"))
        .withColumn("falling", -F.col("norm")), ["falling", "item"], out="nth")
    placed = store(placed.select("item", "vec", "norm", ((F.col("nth") - 1) % per_block).cast("int").alias("at"),
                                 F.floor((F.col("nth") - 1) / per_block).cast("int").alias("block")),
                   "mips-items", partition_by="block")
    # a row per block: items / per_block
    blocks = {r["block"]: (r["norm"], r["reach"]) for r in placed.groupBy("block").agg(
        F.max("norm").alias("norm"), F.max(_reach("vec")).alias("reach")).collect()}
    where = placed.select("item", "at", "block")
    if where.count() * 24 <= BROADCAST_MAX_BYTES:
        where = F.broadcast(where)
    held = (seen.select("user", F.col("item").cast("long").alias("item")).distinct().join(where, "item")
            .groupBy("user", "block").agg(F.collect_list("at").alias("seen")))
    held = store(held, "mips-seen", partition_by="block")
    state = store(users.select("user", "vec", _norm("vec").alias("norm"),
                               F.expr(f"cast(array() as {_TOP})").alias("top")), "mips-users")
    schema = f"user {users.schema['user'].dataType.simpleString()}, vec {users.schema['vec'].dataType.simpleString()}, " \
             f"norm double, top {_TOP}"
    done = []
    for b in sorted(blocks):
        rows = placed.filter(F.col("block") == b).orderBy("at").select("item", "vec", "norm").toArrow()  # block_bytes at most
        block = spark.sparkContext.broadcast((
            rows.column("item").to_numpy(),
            rows.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim),
            rows.column("norm").to_numpy()))
        mine = held.filter(F.col("block") == b).select("user", "seen")
        scored = state.join(mine, "user", "left").select("user", "vec", "norm", "top", "seen") \
            .mapInArrow(_score(block, k, dim), schema)
        # the bound of the blocks to come decides who goes on
        beyond = [bound for later, bound in blocks.items() if later > b]
        if beyond:
            norm, reach = (max(v) for v in zip(*beyond))
            bound = F.least(F.col("norm") * F.lit(norm * SLACK), _peak("vec") * F.lit(reach * SLACK))
        scored = scored.withColumn("open", F.lit(False) if not beyond else (F.size("top") < k) | (
            bound >= F.expr("get(top, size(top) - 1).score")))
        after = store(scored, "mips-users")
        drop(state)
        done.append(after.filter(~F.col("open")).select("user", "top"))
        state = after.filter("open").drop("open")
        state.scratch = after.scratch
        if b + 1 in blocks:
            if state.isEmpty():
                break
            # rows that are finished stay readable: the open ones move on
            state = store(state, "mips-open")
        block.unpersist()
    if not done:
        return empty
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    drop(placed, held)
    return out.select("user", F.posexplode("top").alias("i", "t")).select(
        "user", (F.col("i") + 1).alias("rank"), F.col("t.item").alias("item"), F.col("t.score").alias("score"))
