"""Best-fit packing with conflicts.

Documents are cut into pieces of at most ``capacity`` words; full pieces are
bins of their own.  The rest is dealt evenly to shards of about SHARD_ROWS
pieces, and every shard packs its pieces, longest first: bins are ordered by
residual and carry bitmaps of their duplicate clusters and of the sources
that have reached their share.  The search starts at the successor of the
piece's length and goes on until the tightest compatible bin is found; a piece
that fits none opens a bin.

A shard is a bounded group whatever source or cluster is hot: pieces are dealt
by hash, so neither a source with a third of all rows nor thousands of copies
meet in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.registry import register
from kiln.llm.tables import SPACES, documents, text_of, written

CAPACITY = 2048     # words of a bin
PER_SOURCE = 4      # pieces of one source in a bin
SHARD_ROWS = 4000   # pieces packed together
COPIES_RUN = 4096  # copies of one row that a task puts out


def pack(lengths, sources, clusters, capacity=CAPACITY, per_source=PER_SOURCE) -> list[int]:
    """Bin number of each piece, in the order given.  ``sources`` and
    ``clusters`` are small integers (bits of the bitmaps); None conflicts
    with nothing."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ordered
    held: list[int] = []                   # cluster bitmap of each bin
    full: list[int] = []                   # bitmap of sources at their share
    count: list[dict[int, int]] = []
    placed = []
    for size, source, cluster in zip(lengths, sources, clusters):
        cbit = 0 if cluster is None else 1 << cluster
        sbit = 0 if source is None else 1 << source
        found = None
        for at in range(bisect_left(open_bins, (size, -1)), len(open_bins)):
            b = open_bins[at][1]
            if not (held[b] & cbit or full[b] & sbit):
                found = at
                break
        if found is None:
            residual, b = capacity, len(held)
            held.append(0), full.append(0), count.append({})
        else:
            residual, b = open_bins.pop(found)
        held[b] |= cbit
        if source is not None:
            count[b][source] = count[b].get(source, 0) + 1
            if count[b][source] >= per_source:
                full[b] |= sbit
        if residual > size:
            insort(open_bins, (residual - size, b))
        placed.append(b)
    return placed


def _codes(values) -> list:
    """Small integers for the values of one shard; null stays None."""
    seen: dict = {}
    return [None if pd.isna(v) else seen.setdefault(v, len(seen)) for v in values]


def _pack_shard(capacity, per_source):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "order_key", "copy"], ascending=[False, True, True], kind="stable")
        bins = pack(shard["length"].tolist(), _codes(shard["source"]), _codes(shard["cluster"]), capacity, per_source)
        shard = shard.assign(bin=[f"s{k}-{b}" for k, b in zip(shard["shard"], bins)])
        return shard[["doc_id", "piece", "start", "length", "bin"]]
    return run


def pieces(docs: DataFrame, id_col, text_col, source_col, cluster, capacity) -> DataFrame:
    """``(doc_id, source, cluster, order_key, copy, piece, start, length)``."""
    n = F.regexp_count(text_of(text_col), F.lit(f"[^{SPACES}]+")).cast("long")
    # rows with one key are alike in all that packing sees: they are counted,
    # and numbered among themselves, so no number depends on the file layout
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("-")),
                            F.coalesce(F.concat(F.lit("c"), cluster.cast("string")), F.lit("-")), text_of(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       cluster.alias("cluster"), key.alias("order_key"), n.alias("n")).filter("n > 0")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))
    run = COPIES_RUN  # many copies are dealt over tasks in runs
    few, many = rows.filter(f"rows <= {run}"), rows.filter(f"rows > {run}")
    many = (many.withColumn("run", F.explode(F.expr(f"sequence(0L, (rows - 1) div {run})"))).repartition("order_key", "run")
            .withColumn("copy", F.explode(F.expr(f"sequence(run * {run}, least(rows, (run + 1) * {run}) - 1)"))).drop("run"))
    rows = few.withColumn("copy", F.explode(F.expr("sequence(0L, rows - 1)"))).unionByName(many).drop("rows")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}")))
    return rows.withColumn("piece", at).select(
        "doc_id", "source", "cluster", "order_key", "copy", "piece", (F.col("piece") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("length"))


def best_fit(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cluster=None,
             capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, bin``.

    ``start`` and ``length`` are in words; a bin's lengths sum to at most
    ``capacity``; no bin holds two pieces of one duplicate cluster (default:
    the words, lower-cased; ``cluster`` may be any column) or more than
    ``per_source`` of one source.  Null text, empty text and text without
    words have no piece; a null source conflicts with nothing; repeated rows
    are pieces each (of one cluster, so in different bins); null ids are
    packed like others.  Only the columns named are read.  An empty table
    gives no rows.  The bins are a function of the rows alone: another file
    layout gives the same ones (rows alike in all columns are exchangeable)."""
    if cluster is None:
        cluster = F.md5(F.lower(F.regexp_replace(text_of(text_col), f"[{SPACES}]+", " ")))
    all_pieces = written(pieces(docs, id_col, text_col, source_col, cluster, capacity), "pieces")
    whole = all_pieces.filter(F.col("length") == capacity)
    rest = all_pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_rows))
    own = whole.select("doc_id", "piece", "start", "length", F.concat_ws("-", F.lit("w"), "order_key", "copy", "piece").alias("bin"))
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("order_key", "copy"), F.lit(shards)))
    kind = rest.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("shard").applyInPandas(
        _pack_shard(capacity, per_source), f"doc_id {kind}, piece long, start long, length long, bin string")
    return own.unionByName(packed)


@register("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    return best_fit(documents(spark, sf_dir))
