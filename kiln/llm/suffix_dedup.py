"""Suffix-array dedup: substrings of at least ``window`` bytes that occur
elsewhere, by longest-previous-factor arrays.

Contexts under repeated anchors (see ``repeats``) are dealt to tasks by
anchor.  A task concatenates the contexts of its anchors and sorts their
suffixes by prefix doubling (to the window's depth).  For every window start
in suffix order the nearest neighbours with a smaller place, the previous and
the next one, are the earlier suffixes that share most with it; the longer of
the two common prefixes is its longest previous factor.  A window whose
factor reaches its length is a later copy and goes; the first of its copies is
the one that an equal suffix follows in the order.  A context that occurs
several times enters twice, so its own copies match.  Factors are cut at the
window: longer matches are runs of windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm import repeats as R
from kiln.llm.registry import register
from kiln.llm.tables import documents, join_counted, packed, written

WINDOW = 400
GRAM = 32
CROWD = 1000  # contexts of an anchor that one task compares: under 1 MB
SHARD_BYTES = 64 << 10  # compared at a time: their sorted words stay in a cache


def _dense(high: np.ndarray, bits: int) -> np.ndarray:
    """Ranks from 1 of the values, equal values equal.  Value and position
    share one word where they fit, so that a plain sort orders both."""
    n = len(high)
    if int(high.max()) >> (64 - bits):
        return np.unique(high, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    both = np.sort((high << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    value = both >> np.uint64(bits)
    step = np.ones(n, np.uint64)
    step[1:] = value[1:] != value[:-1]
    rank = np.empty(n, np.uint64)
    rank[both & np.uint64((1 << bits) - 1)] = np.cumsum(step, dtype=np.uint64)
    return rank


def suffix_levels(data: np.ndarray, ends: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of every suffix by its first ``length`` bytes) of each
    doubling, up to ``depth``; equal ranks mean equal prefixes.  A suffix
    stops at ``ends`` (one per position) and then sorts before its
    extensions."""
    n = len(data)
    if n == 0:
        return [(depth, np.zeros(0, np.uint64))]
    bits = max(1, int(n).bit_length())
    left = ends - np.arange(n)
    have = min(4, depth)
    key = np.zeros(n, np.uint64)
    for i in range(have):  # the first bytes, and how many of them are there
        byte = np.zeros(n, np.uint64)
        byte[:n - i] = data[i:]
        key = (key << np.uint64(8)) | np.where(left > i, byte, np.uint64(0))
    rank = _dense((key << np.uint64(3)) | np.minimum(left, have).astype(np.uint64), bits)
    levels = [(have, rank)]
    while have < depth:
        step = min(have, depth - have)
        tail = np.zeros(n, np.uint64)
        tail[:max(0, n - step)] = rank[step:]
        tail[left <= step] = 0
        rank = _dense((rank << np.uint64(bits)) | tail, bits)
        have += step
        levels.append((have, rank))
    return levels


def suffix_ranks(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes."""
    return suffix_levels(data, ends, depth)[-1][1].astype(np.int64)


def common_prefix(data: np.ndarray, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, cut at
    the depth that both have.  Up the levels until one differs, which leaves
    few after the first; down again from there, beyond what is equal; then
    bytes."""
    depth = levels[-1][0]
    length = np.zeros(len(a), np.int64)
    up = np.zeros(len(a), np.int64)  # levels that are equal
    some = np.arange(len(a))
    for i, (size, rank) in enumerate(levels):
        some = some[rank[a[some]] == rank[b[some]]]
        length[some], up[some] = size, i + 1
    for i in range(len(levels) - 2, -1, -1):
        size, rank = levels[i]
        rest = np.flatnonzero((up > i) & (up < len(levels)))
        rest = rest[length[rest] + size < depth]
        rest = rest[rank[a[rest] + length[rest]] == rank[b[rest] + length[rest]]]
        length[rest] += size
    some = np.flatnonzero(up < len(levels))
    for _ in range(min(3, depth)):
        x, y = a[some] + length[some], b[some] + length[some]
        some = some[(length[some] < depth) & (data[np.minimum(x, len(data) - 1)] == data[np.minimum(y, len(data) - 1)])]
        length[some] += 1
    return length


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For every entry the nearest one before it that is smaller, or -1:
    links that are too large are followed until none is (values differ)."""
    link = np.arange(-1, len(values) - 1)
    open_ = np.arange(len(values))
    while len(open_):
        to = link[open_]
        open_ = open_[(to >= 0) & (values[to] > values[open_])]
        link[open_] = link[link[open_]]
    return link


def longest_previous_factors(data: np.ndarray, levels, start: np.ndarray, place: np.ndarray):
    """(order, factor): the suffixes at ``start`` in suffix order (equal ones
    by place), and for each the length of its longest match, up to the depth,
    with a suffix of smaller place.  All have ``depth`` bytes.

    In suffix order no earlier suffix shares more with one than the nearest
    ones of smaller place on its two sides."""
    depth, rank = levels[-1]
    order = np.lexsort((place, rank[start]))
    at, place = start[order], place[order]
    same = np.zeros(len(order), bool)
    same[1:] = rank[at[1:]] == rank[at[:-1]]
    factor = np.zeros(len(order), np.int64)
    factor[same] = depth  # an equal suffix of smaller place stands right before
    before = previous_smaller(place)
    after = len(place) - 1 - previous_smaller(place[::-1])[::-1]
    for side in (before, after):
        some = np.flatnonzero(~same & (side >= 0) & (side < len(place)))
        factor[some] = np.maximum(factor[some], common_prefix(data, levels, at[some], at[side[some]]))
    out = np.zeros(len(order), np.int64)
    out[order] = factor
    return order, out


def _compare(w):
    def compare(table):
        for part in R.pieces_of(table, SHARD_BYTES):
            # a row that occurs twice delivers its contexts twice: one each
            ids = np.stack([part.column(c).to_numpy() for c in R.CONTEXT], axis=1)
            part = part.take(pa.array(np.sort(np.unique(ids, axis=0, return_index=True)[1])))
            n = part.column("n").to_numpy()
            rank_of = R.place_order(part)
            twice = np.concatenate([np.arange(len(part)), np.flatnonzero(n > 1)])
            raw, off = R.content_arrays(part.take(pa.array(twice)), "bytes")
            size = np.diff(off)
            count = size - w + 1
            levels = suffix_levels(raw, np.repeat(off[1:], size), w)
            seg = np.repeat(np.arange(len(twice)), count)
            first = np.cumsum(count) - count
            j = np.arange(len(seg)) - first[seg]
            # places: first places in their order, windows within one by
            # position; the second copies after all of them
            place = (rank_of[twice][seg] + np.where(seg >= len(part), len(part), 0)) * np.int64(1 << 32) + j
            order, factor = longest_previous_factors(raw, levels, off[:-1][seg] + j, place)
            earlier = factor >= w
            # the first of a window's copies: the next in the order repeats it
            rank = levels[-1][1][(off[:-1][seg] + j)[order]]
            later = np.zeros(len(seg), bool)
            later[order[:-1]] = rank[1:] == rank[:-1]
            own = seg < len(part)
            woff = np.concatenate([[0], np.cumsum(count[:len(part)])])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).combine_chunks() for c in R.CONTEXT],
                 R.runs_of((earlier | later)[own], woff, w), R.runs_of(earlier[own], woff, w)],
                names=[*R.CONTEXT, "runs", "later"])
    return compare


def repeated_runs(contexts: DataFrame, rows: DataFrame, w: int) -> DataFrame:
    """``fp, ctx, at, runs, later``: the byte ranges of each context that are
    covered by windows occurring elsewhere, and by windows with an earlier
    occurrence than the context's first place."""
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = (R.with_content(contexts.filter(F.col("others") <= CROWD), rows, "bytes", w)
             .repartition(shards, "fp").sortWithinPartitions("fp")
             .select(*R.CONTEXT, "n", "first", "content")
             .mapInArrow(R.by_anchor(_compare(w)), f"fp long, ctx long, at int, runs {R.RUNS}, later {R.RUNS}"))
    crowded = contexts.filter(F.col("others") > CROWD)
    if crowded.isEmpty():
        return plain
    return plain.unionByName(R.crowded_runs(R.with_content(crowded, rows, "bytes", w, few=True), "bytes", w,
                                            CROWD, _compare(w), later=True))


def repeated_spans(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, gram=GRAM, keep_first=False):
    """(rows ``row_key, doc_id, text``, ``row_key, spans``): byte ranges of
    each row to remove, not yet merged."""
    rows = R.keyed(docs, id_col, text_col)
    places, contexts = R.repeated_contexts(rows, "bytes", window, gram)
    contexts = written(contexts, "contexts")
    runs = written(repeated_runs(contexts, rows, window).filter(F.size("runs") > 0)
                   .join(contexts.select(*R.CONTEXT, "n"), R.CONTEXT), "runs")
    marked = join_counted(places, runs, R.CONTEXT, "n", places.count())
    if keep_first:
        firsts = contexts.select(*R.CONTEXT, F.col("first.row_key").alias("fk"), F.col("first.start").alias("fs"))
        marked = marked.join(firsts, R.CONTEXT).withColumn(
            "runs", F.when((F.col("row_key") == F.col("fk")) & (F.col("start") == F.col("fs")), F.col("later"))
            .otherwise(F.col("runs")))
    spans = (marked.select("row_key", F.explode("runs").alias("r"), "start")
             .select("row_key", F.struct((F.col("start") + F.col("r.lo")).alias("lo"),
                                         (F.col("start") + F.col("r.hi")).alias("hi")).alias("span"))
             .groupBy("row_key").agg(F.collect_set("span").alias("spans")))
    return rows, spans


def _remove(with_text):
    def run(batches):
        for batch in batches:
            data, offs = G.unpacked(batch.column(1))
            spans = batch.column(2).to_pylist()
            removed, runs, sha, kept = [], [], [], []
            for i, own in enumerate(spans):
                raw = data[offs[i]:offs[i + 1]]
                gone = n = 0
                if own:
                    mask = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(mask, [s["lo"] for s in own], 1)
                    np.add.at(mask, [s["hi"] for s in own], -1)
                    drop = np.cumsum(mask)[:-1] > 0
                    gone = int(drop.sum())
                    n = int((drop[1:] & ~drop[:-1]).sum()) + int(len(drop) and drop[0])
                    raw = raw[~drop]
                removed.append(gone), runs.append(n)
                sha.append(hashlib.sha256(raw.tobytes()).hexdigest())
                kept.append(raw.tobytes() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offs).astype(np.int64)), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def suffix_dedup(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, gram=GRAM, keep_first=False,
                 with_text=True) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept`` (the remaining bytes; cut sequences of UTF-8 are
    possible, as matches are of bytes).

    A byte goes if a string of ``window`` bytes that covers it also starts
    elsewhere, judged on the input; with ``keep_first`` the occurrence of the
    smallest (id, position) stays.  Null text counts as empty; texts shorter
    than the window stay whole; repeated rows are copies of each other, but
    with equal id and text they are one place to ``keep_first`` and all stay.
    Only the id and text columns are read.  An empty table gives no rows."""
    rows, spans = repeated_spans(docs, id_col, text_col, window, gram, keep_first)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return packed(rows).join(spans, "row_key", "left").select("doc_id", "text", "spans").mapInArrow(
        _remove(with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir), with_text=False).drop("kept")
