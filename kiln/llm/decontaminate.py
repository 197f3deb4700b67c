"""Benchmark decontamination by winnowing.

With ``k``-word grams and windows of ``w`` grams, ``k + w - 1 = span``: the
smallest gram hash of every window is kept (the rightmost of equal ones), on
the documents and on the benchmark alike.  Equal spans of ``span`` words keep
the same gram at the same place, so every shared span of that length shares a
fingerprint: joining the fingerprints and extending the hits misses none.

A document's fingerprints first pass a bit filter of the benchmark's (fixed
size, so its broadcast is bounded); the few that may match leave the scan with
the words around them, and the exact join and the extension see only those.
Items shorter than ``span`` words are one window each: their whole-item hash
is looked up at every document word, for each short length that occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm.registry import register
from kiln.llm.tables import documents, fresh, text_key, text_of, written

SPAN = 10
GRAM = 5
FILTER_BITS = 1 << 23  # 1 MB, broadcast whatever the benchmark's size

_MARK = "array<struct<pos:int,fp:long,at:int,words:array<long>>>"


def _marks(words, woff, span, gram, short, accept):
    """Marks of a chunk: (row, position, fingerprint, place of the gram in
    the kept words, first and end word) of winnowed grams and of windows as
    long as a short item, as far as ``accept`` lets them."""
    spans = G.Spans(words)
    lo_of, hi_of = woff[:-1], woff[1:]
    found = []
    grams = spans.rolling(gram)
    owner = G.window_minima(grams, span - gram + 1)
    row_of = np.repeat(np.arange(len(lo_of)), hi_of - lo_of)
    if len(owner):
        start = np.arange(len(owner))
        at = np.unique(owner[start + span <= hi_of[row_of[start]]])
        at = at[accept(grams[at])]
        row = row_of[at]
        lo = np.maximum(at - (span - gram), lo_of[row])
        found.append((row, at - lo_of[row], grams[at], at - lo, lo, np.minimum(at + span, hi_of[row])))
    for m in short:
        fp = spans.rolling(m)
        at = np.arange(len(fp))
        at = at[at + m <= hi_of[row_of[at]]] if len(at) else at
        at = at[accept(fp[at])]
        row = row_of[at]
        found.append((row, at - lo_of[row], fp[at], np.zeros(len(at), np.int64), at, at + m))
    if not found:
        return [np.zeros(0, np.int64)] * 6
    cols = [np.concatenate([f[i] for f in found]) for i in range(6)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def _mark_lists(words, cols, rows):
    row, pos, fp, at, lo, hi = cols
    width = hi - lo
    first = np.cumsum(width) - width
    flat = np.arange(width.sum()) - np.repeat(first - lo, width)
    kept = G.row_lists(width, pa.array(G.as_long(words[flat]), pa.int64()))
    mark = pa.StructArray.from_arrays(
        [pa.array(pos.astype(np.int32)), pa.array(G.as_long(fp), pa.int64()), pa.array(at.astype(np.int32)), kept],
        names=["pos", "fp", "at", "words"])
    return G.row_lists(np.bincount(row, minlength=rows), mark)


def _scan(span, gram, short_of, accept_of):
    """``mapInArrow`` function: (..., text) -> (..., n_words, marks)."""
    def run(batches):
        accept = accept_of()
        for batch in batches:
            data, offs = G.text_buffer(batch.column(batch.num_columns - 1))
            for lo, hi in G.chunks(offs):
                part = G.LOWER[data[offs[lo]:offs[hi]]]
                starts, ends, woff = G.word_spans(part, offs[lo:hi + 1] - offs[lo], G.NOT_ALNUM)
                words = G.word_hashes(part, starts, ends)
                short = short_of(np.diff(woff))
                lists = _mark_lists(words, _marks(words, woff, span, gram, short, accept), hi - lo)
                keep = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(np.diff(woff).astype(np.int64)), lists],
                    names=[*batch.schema.names[:-1], "n_words", "marks"])
    return run


def _item_scan(span, gram):
    """Marks of the benchmark: all winnowed grams of long items, and the one
    whole-item window of a short one."""
    def run(batches):
        for batch in batches:
            data, offs = G.text_buffer(batch.column(1))
            for i in range(batch.num_rows):  # items are short texts
                part = G.LOWER[data[offs[i]:offs[i + 1]]]
                starts, ends, woff = G.word_spans(part, np.array([0, len(part)]), G.NOT_ALNUM)
                words = G.word_hashes(part, starts, ends)
                n = len(words)
                if n == 0:
                    continue
                if n >= span:
                    cols = _marks(words, woff, span, gram, (), lambda fp: np.ones(len(fp), bool))
                else:
                    cols = [np.array([x]) for x in (0, 0, 0, 0, 0, n)]
                    cols[2] = G.Spans(words).rolling(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([n], pa.int64()), _mark_lists(words, cols, 1)],
                    names=["item_id", "n_words", "marks"])
    return run


def _bit_filter(items: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set where an item has a fingerprint: at most
    FILTER_BITS / 64 words reach the driver, whatever the benchmark."""
    bit = F.pmod(F.col("fp"), F.lit(FILTER_BITS))
    words = (items.select(bit.alias("bit")).distinct()
             .groupBy(F.expr("cast(bit div 64 as int)").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    for r in words:
        out[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return out


def benchmark_marks(benchmark: DataFrame, id_col="item_id", text_col="text", span=SPAN, gram=GRAM) -> DataFrame:
    """``(item_id, fp, at, words, whole)``: the benchmark's fingerprints with
    the words around each; ``whole`` marks an item shorter than ``span``."""
    source = benchmark.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("text"))
    kind = source.schema["item_id"].dataType.simpleString()
    marks = source.mapInArrow(_item_scan(span, gram), f"item_id {kind}, n_words long, marks {_MARK}")
    return written(marks.select("item_id", F.explode("marks").alias("m"), (F.col("n_words") < span).alias("whole"))
                   .select("item_id", "m.fp", "m.at", "m.words", "whole"), "items")


def find_spans(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text",
               item_id_col="item_id", item_text_col="text", span=SPAN, gram=GRAM):
    """(per-row table ``row_id, doc_id, text_key, n_words``, matches ``row_id,
    item_id, lo, hi``): word ranges [lo, hi) of each row that lie in an
    occurrence of an item's window."""
    spark = docs.sparkSession
    items = benchmark_marks(benchmark, item_id_col, item_text_col, span, gram)
    short = sorted(r["n"] for r in items.filter("whole").select(F.size("words").alias("n")).distinct().collect())
    bits = spark.sparkContext.broadcast(_bit_filter(items))

    def accept_of():
        table = bits.value

        def accept(fp):
            bit = fp & np.uint64(FILTER_BITS - 1)  # pmod of a power of two
            return (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return accept

    source = docs.select(F.expr("uuid()").alias("row_id"), F.col(id_col).alias("doc_id"),
                         text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    # written once: the row ids are drawn here and never again
    rows = written(source.mapInArrow(
        _scan(span, gram, lambda n: short, accept_of),
        f"row_id string, doc_id {kind}, text_key binary, n_words long, marks {_MARK}"), "marks")
    marks = rows.select("row_id", F.explode("marks").alias("m")).select(
        "row_id", "m.pos", "m.fp", F.col("m.at").alias("d_at"), F.col("m.words").alias("d"))
    both = marks.join(items.select("item_id", "fp", "at", "whole", F.col("words").alias("i")), "fp")
    # starts, relative to the gram, of the windows of `span` words that hold
    # it and are equal on both sides; they are consecutive
    starts = F.expr(f"""filter(sequence({gram - span}, 0), o ->
        d_at + o >= 0 and at + o >= 0 and d_at + o + {span} <= size(d) and at + o + {span} <= size(i)
        and slice(d, d_at + o + 1, {span}) = slice(i, at + o + 1, {span}))""")
    both = both.withColumn("o", F.when(F.col("whole"), F.when(F.expr("d = i"), F.array(F.lit(0)))).otherwise(starts))
    matches = both.filter("size(o) > 0").select(
        "row_id", "item_id", F.expr("pos + o[0]").alias("lo"),
        F.expr(f"pos + if(whole, size(i), element_at(o, -1) + {span})").alias("hi"))
    return rows.drop("marks"), matches


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated``.

    Null or empty text has no words and no hits; null item texts and items
    without words match nothing; repeated rows and repeated ids are separate
    rows, each with its own result; items that repeat a text all count.
    Only the id and text columns of either table are read.  An empty
    benchmark leaves every row clean; empty documents give no rows."""
    rows, matches = find_spans(docs, benchmark, **options)
    # distinct ranges and items of one document: bounded by its own length
    # and the items it holds
    hits = matches.groupBy("row_id").agg(
        F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.expr("""aggregate(ranges, named_struct('n', 0L, 'to', 0),
        (a, r) -> named_struct('n', a.n + greatest(0, r.hi - greatest(r.lo, a.to)), 'to', greatest(a.to, r.hi)),
        a -> a.n)""")
    hits = hits.select("row_id", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(hits, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a benchmark window, all their columns.  A row
    goes by its text, so copies go together."""
    rows, matches = find_spans(docs, benchmark, text_col=text_col, **options)
    key = fresh(docs, "text_key")
    bad = rows.join(matches.select("row_id").distinct(), "row_id").select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key(text_col)).join(bad, key, "left_anti").drop(key)


@register("op8_decontaminate", sql=r"""
WITH dw AS (
  SELECT rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rn FROM documents)),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM iw WHERE len(w) > 0)),
dg AS (
  SELECT rn, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT rn, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM dw, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)),
hit AS (SELECT rn, i, m, item_id FROM dg JOIN wins USING (m, g)),
cov AS (SELECT rn, count(DISTINCT p) AS n_hit
        FROM (SELECT rn, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rn, i, m FROM hit)) GROUP BY rn),
its AS (SELECT rn, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY rn)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (rn) LEFT JOIN its USING (rn)
""")
def op8_decontaminate(spark, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate(documents(spark, sf_dir), benchmark)
