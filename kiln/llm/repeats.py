"""Windows that repeat across a corpus, found through anchors.

A row is a sequence of symbols (bytes or words).  Every window of W symbols
owns one anchor: its smallest K-gram by hash (the rightmost of equal ones).
Equal windows own equal anchors at equal offsets, so only windows under a
repeated anchor can repeat, and only about 2 / (W - K + 2) of all positions
are anchors: one small row stands for many windows.

The run of windows that own one anchor is its context.  Contexts are counted
by (anchor, content, offset), so copies collapse before anything is compared,
and two places of a context prove all its windows repeated.  Where an anchor
has several contexts, an operator compares their windows in tasks dealt by
anchor.  An anchor with more than a bounded number (the operator's CROWD) of
contexts would be a hot group: its contexts are cut into blocks of windows,
and the long core that all windows of a block share becomes their anchor, so a
common phrase in otherwise different texts falls apart.  Where even a core is
crowded, windows are counted one by one by two 64-bit hashes, one modulo a prime,
which any number of tasks share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm.tables import forget, join_counted, packed, text_of, written

FILTER_BITS = 1 << 24
BROADCAST_CONTEXTS = 100_000
BLOCKS = 8
_U = np.uint64
_ANCHOR = "array<struct<fp:long,ctx:long,at:int,start:int,len:int>>"
RUNS = "array<struct<lo:int,hi:int>>"
CONTEXT = ["fp", "ctx", "at"]


def symbols_of(data, offs, kind):
    """(symbol hashes, row offsets) of a chunk."""
    if kind == "bytes":
        return G.BYTE_CODE[data], offs
    starts, ends, woff = G.word_spans(data, offs, G.SPACE)
    return G.word_hashes(data, starts, ends), woff


def _contexts(symbols, off, w, k, plain):
    """(row, fp, ctx, at, start, len) of the contexts of a chunk; ``plain``
    has what is compared, the bytes or the words."""
    spans = G.Spans(symbols)
    grams = spans.rolling(k)
    owner = G.window_minima(grams, w - k + 1)
    none = np.zeros(0, np.int64)
    if not len(owner):
        return [none] * 6
    row_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(np.arange(len(owner)) + w <= off[1:][row_of[:len(owner)]])
    if not len(start):
        return [none] * 6
    own = owner[start]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    s0, size = start[first], start[last] - start[first] + w
    row = row_of[s0]
    return [row, grams[own[first]], G.content_hashes(plain, s0, s0 + size), own[first] - s0, s0 - off[:-1][row], size]


def _scan(kind, w, k):
    def run(batches):
        for batch in batches:
            data, offs = G.text_buffer(batch.column(2))
            for lo, hi in G.chunks(offs):
                part = data[offs[lo]:offs[hi]]
                symbols, off = symbols_of(part, offs[lo:hi + 1] - offs[lo], kind)
                plain = part if kind == "bytes" else symbols
                row, fp, ctx, at, start, size = _contexts(symbols, off, w, k, plain)
                anchors = pa.StructArray.from_arrays(
                    [pa.array(G.as_long(fp), pa.int64()), pa.array(G.as_long(ctx), pa.int64()),
                     *[pa.array(x.astype(np.int32)) for x in (at, start, size)]],
                    names=["fp", "ctx", "at", "start", "len"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     G.row_lists(np.bincount(row, minlength=hi - lo), anchors)],
                    names=["row_key", "doc_id", "anchors"])
    return run


def _passing(bits):
    """Flat anchor rows of those that pass the filter."""
    def run(batches):
        table = bits.value
        for batch in batches:
            lists = batch.column(2)
            count = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            fp = flat.field("fp").to_numpy().view(_U)
            bit = fp & _U(FILTER_BITS - 1)
            ok = (table[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
            row = pa.array(np.repeat(np.arange(batch.num_rows), count)[ok])
            flat = flat.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), *[flat.field(c) for c in
                                                                       ("fp", "ctx", "at", "start", "len")]],
                names=["row_key", "doc_id", "fp", "ctx", "at", "start", "len"])
    return run


def keyed(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``(row_key, doc_id, text)``; the key is of id and text together."""
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), text_of(text_col))
                        .cast("binary")))
    return docs.select(key.alias("row_key"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def repeated_contexts(rows: DataFrame, kind: str, w: int, k: int):
    """(places, contexts), both written.

    ``places``: every occurrence ``row_key, doc_id, fp, ctx, at, start, len``
    under a possibly repeated anchor (a bit filter of fixed size drops the
    others before they shuffle).  ``contexts``: ``fp, ctx, at, len, n, first,
    others``: the occurrences of each, its first place (smallest id) and how
    many contexts its anchor has; anchors of one occurrence are gone."""
    spark = rows.sparkSession
    id_type = rows.schema["doc_id"].dataType.simpleString()
    anchors = written(rows.mapInArrow(_scan(kind, w, k), f"row_key binary, doc_id {id_type}, anchors {_ANCHOR}")
                      .filter(F.size("anchors") > 0), "anchors")
    again = (anchors.select(F.explode("anchors.fp").alias("fp"))
             .groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    words = (again.select(F.pmod("fp", F.lit(FILTER_BITS)).alias("bit")).distinct()
             .groupBy(F.expr("cast(bit div 64 as int)").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toPandas())
    table = np.zeros(FILTER_BITS // 64, _U)  # FILTER_BITS / 64 words at most reach the driver
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(_U)
    bits = spark.sparkContext.broadcast(table)
    places = written(anchors.mapInArrow(
        _passing(bits), f"row_key binary, doc_id {id_type}, fp long, ctx long, at int, start int, len int"), "places")
    # an id of null comes last
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_key", "start")
    counted = written(places.groupBy(*CONTEXT).agg(
        F.first("len").alias("len"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "contexts")
    of_anchor = (counted.groupBy("fp").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("others"))
                 .filter("total > 1").select("fp", "others"))
    of_anchor = written(of_anchor, "of_anchor")
    forget(anchors)
    return places, join_counted(counted, of_anchor, ["fp"], "others", counted.count())


def _cut(kind, w):
    """Rows with a list of contexts -> the contexts with their content (raw
    bytes, or word hashes as bytes)."""
    def run(batches):
        for batch in batches:
            data, offs = G.unpacked(batch.column(0))
            lists = batch.column(1)
            count = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), count)
            start = flat.field("start").to_numpy()
            size = flat.field("len").to_numpy()
            content = [None] * len(flat)
            for lo, hi in G.chunks(offs):
                part = data[offs[lo]:offs[hi]]
                if kind == "bytes":
                    symbols, off = part, offs[lo:hi + 1] - offs[lo]
                else:
                    symbols, off = symbols_of(part, offs[lo:hi + 1] - offs[lo], kind)
                for e in range(*np.searchsorted(row, [lo, hi])):
                    s = off[row[e] - lo] + start[e]
                    content[e] = symbols[s:s + size[e]].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*[flat.field(c) for c in ("fp", "ctx", "at", "n", "others", "first")], pa.array(content, pa.binary())],
                names=["fp", "ctx", "at", "n", "others", "first", "content"])
    return run


def with_content(contexts: DataFrame, rows: DataFrame, kind: str, w: int, few: bool = False) -> DataFrame:
    """Contexts with the content at their first place: the lists of contexts
    to cut meet the (packed) texts by row; with ``few`` they are broadcast if
    there are at most BROADCAST_CONTEXTS.  A row that occurs twice gives its
    contexts twice."""
    lists = contexts.groupBy(F.col("first.row_key").alias("row_key")).agg(F.collect_list(F.struct(
        *CONTEXT, "n", "others", "first", F.col("first.start").alias("start"), "len")).alias("cuts"))
    first = contexts.schema["first"].dataType.simpleString()
    texts = rows.select("row_key", "text")
    if few and contexts.count() <= BROADCAST_CONTEXTS:  # about 100 bytes each
        lists = F.broadcast(lists)
    else:
        texts = packed(texts)
    return (texts.join(lists, "row_key").select("text", "cuts")
            .mapInArrow(_cut(kind, w), f"fp long, ctx long, at int, n long, others long, first {first}, content binary"))


def runs_of(flags, off, w):
    """Per segment the ranges [lo, hi) of symbols covered by flagged windows;
    ``off`` are the offsets of the segments' windows."""
    if not len(flags):
        empty = np.zeros(0, np.int32)
        return G.row_lists(np.zeros(len(off) - 1, np.int64), pa.StructArray.from_arrays(
            [pa.array(empty), pa.array(empty)], names=["lo", "hi"]))
    start = flags.copy()
    inner = np.ones(len(flags), bool)
    inner[off[:-1][off[:-1] < len(flags)]] = False
    start[1:] &= ~(flags[:-1] & inner[1:])
    end = flags.copy()
    end[:-1] &= ~(flags[1:] & inner[1:])
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    seg = np.searchsorted(off, s, side="right") - 1
    return G.row_lists(np.bincount(seg, minlength=len(off) - 1), pa.StructArray.from_arrays(
        [pa.array((s - off[seg]).astype(np.int32)), pa.array((e - off[seg] + w).astype(np.int32))], names=["lo", "hi"]))


def by_anchor(compare):
    """``mapInArrow`` function over rows sorted by anchor: whole anchors at a
    time go to ``compare(table)``, which yields batches; what a batch cuts
    waits for its rest (a bounded number of contexts)."""
    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            fp = table.column("fp").to_numpy()
            cut = int(np.searchsorted(fp, fp[-1])) if len(fp) else 0
            held = table.slice(cut)
            if cut:
                yield from compare(table.slice(0, cut))
        if held is not None and len(held):
            yield from compare(held)
    return run


def pieces_of(table, limit):
    """Slices of a table sorted by anchor, whole anchors each, of about
    ``limit`` content bytes."""
    fp = table.column("fp").to_numpy()
    size = np.array([len(x) for x in table.column("content").to_pylist()])
    ends = np.concatenate([np.flatnonzero(fp[1:] != fp[:-1]) + 1, [len(fp)]])
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(fp):
        at = int(np.searchsorted(total[ends], total[lo] + limit))
        hi = int(ends[min(at, len(ends) - 1)])
        yield table.slice(lo, hi - lo)
        lo = hi


def content_arrays(table, kind):
    """(symbols, segment offsets) of a table's contents."""
    content = table.column("content").to_pylist()
    raw = np.frombuffer(b"".join(content), np.uint8 if kind == "bytes" else _U)
    size = np.array([len(x) for x in content]) // (1 if kind == "bytes" else 8)
    return raw, np.concatenate([[0], np.cumsum(size)])


def place_order(table):
    """Rank of each context's first place (equal places rank the same)."""
    first = table.column("first").to_pylist()
    keys = [(f["no_id"], f["doc_id"] if f["doc_id"] is not None else 0, f["row_key"], f["start"]) for f in first]
    return np.unique(np.array([*keys, None], dtype=object)[:-1], return_inverse=True)[1] if keys else np.zeros(0, int)


def _windows(kind, w):
    """Contexts with content -> one row a window: offset and two hashes."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lo in range(0, len(table), 256):
                part = table.slice(lo, 256)
                raw, off = content_arrays(part, kind)
                symbols = G.BYTE_CODE[raw] if kind == "bytes" else raw
                spans = G.Spans(symbols)
                count = np.diff(off) - w + 1
                seg = np.repeat(np.arange(len(part)), count)
                j = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
                s = off[:-1][seg] + j
                take = pa.array(seg)
                whole = part.combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*[whole.column(c).take(take).combine_chunks() for c in ("fp", "ctx", "at", "n", "first")],
                     pa.array(j.astype(np.int32)), pa.array(G.as_long(spans.hash(s, s + w)), pa.int64()),
                     pa.array(G.as_long(spans.hash64(s, s + w)), pa.int64())],
                    names=["fp", "ctx", "at", "n", "first", "j", "h1", "h2"])
    return run


def _blocks(kind, w):
    """Contexts with content -> their blocks of windows: with offsets a of
    the anchor in the window, block q has q b <= a < (q + 1) b, and all its
    windows share ``w - b + 1`` symbols, its core."""
    b = max(1, w // BLOCKS)
    unit = 1 if kind == "bytes" else 8

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw, off = content_arrays(table, kind)
            spans = G.Spans(G.BYTE_CODE[raw] if kind == "bytes" else raw)
            count = np.diff(off) - w + 1
            at = table.column("at").to_numpy().astype(np.int64)
            low, high = (at - count + 1) // b, at // b
            each = high - low + 1
            e = np.repeat(np.arange(len(table)), each)
            q = np.arange(len(e)) - np.repeat(np.cumsum(each) - each, each) + low[e]
            first, last = np.maximum(0, at[e] - (q + 1) * b + 1), np.minimum(count[e] - 1, at[e] - q * b)
            core = off[:-1][e] + at[e] - q * b
            start, end = off[:-1][e] + first, off[:-1][e] + last + w
            fp = table.column("fp").to_numpy().view(_U)
            fp2 = G.mix(spans.hash(core, core + w - b + 1) ^ G.mix(fp[e] + q.astype(_U) * _U(0x9E3779B97F4A7C15)))
            ctx2, at2 = G.content_hashes(raw, start, end), at[e] - q * b - first
            whole, data = table.combine_chunks(), raw.tobytes()
            take = pa.array(e)
            yield pa.RecordBatch.from_arrays(
                [*[whole.column(c).take(take).combine_chunks() for c in (*CONTEXT, "n", "first")],
                 pa.array(G.as_long(fp2), pa.int64()), pa.array(G.as_long(ctx2), pa.int64()),
                 pa.array(at2.astype(np.int32)), pa.array(first.astype(np.int32)),
                 pa.array([data[x * unit:y * unit] for x, y in zip(start.tolist(), end.tolist())], pa.binary())],
                names=[*CONTEXT, "n", "first", "fp2", "ctx2", "at2", "shift", "content"])
    return run


def crowded_runs(content: DataFrame, kind: str, w: int, crowd: int, compare, later: bool) -> DataFrame:
    """``fp, ctx, at, runs[, later]`` of contexts under crowded anchors, by
    blocks of their windows.  ``compare`` is the operator's, on blocks."""
    spark = content.sparkSession
    place = content.schema["first"].dataType.simpleString()
    blocks = content.dropDuplicates(CONTEXT).select(*CONTEXT, "n", "first", "content").mapInArrow(
        _blocks(kind, w), f"fp long, ctx long, at int, n long, first {place}, fp2 long, ctx2 long, at2 int, "
                          "shift int, content binary")
    blocks = written(blocks.withColumn("first", F.col("first").withField(
        "start", F.col("first.start") + F.col("shift"))), "blocks")
    segments = written(blocks.groupBy(F.col("fp2").alias("fp"), F.col("ctx2").alias("ctx"), F.col("at2").alias("at"))
                       .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.first("content").alias("content")),
                       "segments")
    total = segments.groupBy("fp").agg(F.count(F.lit(1)).alias("others"))
    segments = segments.join(total, "fp")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"fp long, ctx long, at int, runs {RUNS}" + (f", later {RUNS}" if later else "")
    found = (segments.filter(F.col("others") <= crowd).repartition(shards, "fp").sortWithinPartitions("fp")
             .select(*CONTEXT, "n", "first", "content").mapInArrow(by_anchor(compare), schema))
    rest = segments.filter(F.col("others") > crowd)
    if not rest.isEmpty():
        counted = window_runs(rest, kind, w)
        found = found.unionByName(counted if later else counted.drop("later"))
    found = found.join(segments.select(*CONTEXT, F.col("first").alias("least")), CONTEXT).withColumnsRenamed(
        {c: f"{c}2" for c in CONTEXT})
    back = blocks.select(*CONTEXT, "fp2", "ctx2", "at2", "shift", "first").join(found, ["fp2", "ctx2", "at2"])

    def moved(c):
        return F.transform(c, lambda r: F.struct((r["lo"] + F.col("shift")).alias("lo"),
                                                 (r["hi"] + F.col("shift")).alias("hi")))
    out = [F.flatten(F.collect_list(moved(F.col("runs")))).alias("runs")]
    if later:
        # of equal blocks only the one of the smallest place can be first
        own = F.when(F.col("first") == F.col("least"), F.col("later")).otherwise(F.col("runs"))
        out.append(F.flatten(F.collect_list(moved(own))).alias("later"))
    return back.groupBy(*CONTEXT).agg(*out)


def window_runs(content: DataFrame, kind: str, w: int) -> DataFrame:
    """``fp, ctx, at, runs, later`` of contexts whose windows are counted one
    by one."""
    first = content.schema["first"].dataType.simpleString()
    rows = content.select(*CONTEXT, "n", "first", "content").mapInArrow(
        _windows(kind, w), f"fp long, ctx long, at int, n long, first {first}, j int, h1 long, h2 long")
    rows = rows.withColumn("offset", F.col("at") - F.col("j")).withColumn("id", F.struct("ctx", "at"))
    rows = rows.withColumn("place", F.col("first").withField("start", F.col("first.start") + F.col("j")))
    window = ["fp", "offset", "h1", "h2"]
    found = rows.groupBy(*window).agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("n").alias("most"), F.min("place").alias("earliest")
    ).filter("lo <> hi or most > 1").select(*window, "earliest")
    hit = rows.join(found, window).groupBy(*CONTEXT).agg(
        F.array_sort(F.collect_set("j")).alias("js"),
        F.array_sort(F.collect_set(F.when(F.col("place") != F.col("earliest"), F.col("j")))).alias("ls"))

    def runs(c):
        starts = F.filter(c, lambda x: ~F.array_contains(c, x - 1))
        ends = F.filter(c, lambda x: ~F.array_contains(c, x + 1))
        return F.transform(F.arrays_zip(starts.alias("lo"), ends.alias("hi")), lambda r: F.struct(
            r["lo"].cast("int").alias("lo"), (r["hi"] + w).cast("int").alias("hi")))
    return hit.select(*CONTEXT, runs(F.col("js")).alias("runs"), runs(F.col("ls")).alias("later"))
