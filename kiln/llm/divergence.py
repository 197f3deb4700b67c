"""Source divergence audit by count cells.

The counts of a term in a source and in its language fix its smoothed
frequencies, so terms with equal counts share every value.  They are grouped
into cells before anything is evaluated:

* ``term`` part: a cell is (group count, language count) with its number of
  terms.  The value is computed per cell, cells of equal value are merged,
  the values of a group are ranked by the terms above them, and only the
  cells that reach the wanted ranks are expanded into terms, in UTF-8 order.
* ``pair`` part: a cell is the vector of counts over the language's sources
  with its number of terms; differences are summed once per cell.

Terms are counted per scan task before the one shuffle that sums them, so a
source with a third of all documents, or a word on every page, is a row per
task.  Counts are exact decimals where a product could pass 64 bits.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.registry import register
from kiln.llm.tables import documents, text_of, written

# fixed values of the audit
SCALE = 1_000_000_000
SMOOTH = 5
MIN_DOCS = 30
TOP = 50

FLUSH_TERMS = 200_000  # distinct terms that a scan task holds before it emits them
SLICE = 1 << 22        # bytes of a text that are split at a time
TILE = 256             # sources on a side of a block of pair sums
BLOCKS = 32            # blocks of pair sums that a task holds before it emits them
BROADCAST_ROWS = 100_000

# every byte outside letters and multibyte characters separates; A-Z lowered
_TABLE = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _slices(raw: bytes, size: int):
    """Pieces of a translated text, cut at blanks."""
    lo = 0
    while lo < len(raw):
        hi = lo + size
        if hi < len(raw):
            cut = raw.rfind(b" ", lo, hi)
            # a term longer than a slice is taken whole
            hi = cut if cut > lo else (raw.find(b" ", hi) + 1 or len(raw) + 1) - 1
        yield raw[lo:hi]
        lo = hi


def _emit(lang: str, source: str, count: Counter, docs: Counter):
    terms = list(count)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
         pa.array(terms, pa.binary()).cast(pa.string()),
         pa.array([count[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())],
        names=["lang", "source", "term", "n", "docs"])


def _count_terms(flush: int = FLUSH_TERMS, piece: int = SLICE):
    """(lang, source, text) rows to partial counts.  A group that occurs has
    a row with a null term as well."""
    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                count, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(count)
                mine = set()
                for part in _slices(text.as_py().translate(_TABLE), piece):
                    terms = part.split()
                    count.update(terms)
                    mine.update(terms)
                docs.update(mine)
                size += len(count) - before
                if size > flush:
                    for key, (c, d) in held.items():
                        yield _emit(*key, c, d)
                        c.clear()
                        d.clear()
                    size = 0
        for key, (c, d) in held.items():
            yield _emit(*key, c, d)
        if held:
            langs, sources = zip(*held)
            none = [None] * len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(none, pa.string()),
                 pa.array(none, pa.int64()), pa.array(none, pa.int64())], names=["lang", "source", "term", "n", "docs"])
    return run


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every
    term of every group, and a row with a null term per group."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"),
                       text_of(text_col).cast("binary").alias("text"))
    return (rows.mapInArrow(_count_terms(), "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def smoothed(count: str, total: str, kept: str):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exact:
    the product is a decimal, its quotient at most SCALE."""
    return F.expr(f"1L + (cast(`{count}` + {SMOOTH} as decimal(19,0)) * cast({SCALE} as decimal(10,0))) "
                  f"div cast(`{total}` + {SMOOTH} * `{kept}` as decimal(19,0))")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of few short rows, known by counting it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _pair_sums(tile: int):
    """Per block of source pairs the sums over the cells of this task.

    Rows: lang, the two tiles, the cell's number of terms, and per tile its
    sources with the term: position, frequency, frequency of a missing term."""
    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for (lang, ta, tb), sums in held.items():
                at_a, at_b = np.nonzero(sums)
                a, b = at_a + ta * tile, at_b + tb * tile
                # a block beside the diagonal stands for its mirror image too
                for x, y in [(a, b)] + [(b, a)] * (ta != tb):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(a), pa.string()), pa.array(x), pa.array(y), pa.array(sums[at_a, at_b])],
                        names=["lang", "a", "b", "part"])
            held.clear()

        for batch in batches:
            langs, tiles_a, tiles_b, sizes = (batch.column(i).to_pylist() for i in range(4))
            for r in range(batch.num_rows):
                (at_a, p_a, zero_a), (at_b, p_b, zero_b) = (
                    [batch.column(c)[r].values.field(k).to_numpy(zero_copy_only=False) for k in range(3)] for c in (4, 5))
                if not len(at_a) or not len(at_b):
                    continue
                key = (langs[r], tiles_a[r], tiles_b[r])
                if key not in held:
                    if len(held) >= BLOCKS:
                        yield from flush()
                    held[key] = np.zeros((tile, tile), np.int64)
                # what the sums over single sources count wrongly for a term in both
                p_a, zero_a = p_a[:, None], zero_a[:, None]
                both = np.abs(p_a - p_b) - np.abs(p_a - zero_b) - np.abs(zero_a - p_b) + np.abs(zero_a - zero_b)
                held[key][np.ix_(at_a, at_b)] += both * sizes[r]
        yield from flush()
    return run


def _pairs(counts: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """``(lang, source, item, value)``: the summed differences of every two
    sources of a language.  A term in neither source differs by what their
    smoothing differs, a term in one by a function of its count, so those
    sums come from (group, count) cells; only terms in both need both counts."""
    side = groups.select("lang", "source", "idx", "zero", "kept", "terms")
    other = side.select("lang", F.col("source").alias("item"), F.col("idx").alias("b"), F.col("zero").alias("z_b"),
                        F.col("terms").alias("terms_b"))
    # every group meets its language's others: these rows are the answer's
    frame = (side.withColumnRenamed("idx", "a").join(other, "lang").filter("a <> b"))
    neither = frame.select("lang", "source", "item", "a", "b",
                           ((F.col("kept") - F.col("terms") - F.col("terms_b")) * F.abs(F.col("zero") - F.col("z_b")))
                           .alias("part"))
    cells = counts.groupBy("lang", "idx", "p").agg(F.count(F.lit(1)).alias("m"))
    one = (cells.withColumnRenamed("idx", "a").join(other.select("lang", "b", "z_b"), "lang").filter("a <> b")
           .groupBy("lang", "a", "b").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("z_b"))).alias("part")))
    entry = F.struct("idx", "p", "zero")
    vectors = (counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("v"))
               .groupBy("lang", "v").agg(F.count(F.lit(1)).alias("m")))
    widest = groups.agg(F.max("idx")).first()[0] or 0
    tiles = F.explode(F.sequence(F.lit(0), F.lit(widest // tile)))

    def within(t):
        return F.transform(F.filter("v", lambda x: F.floor(x["idx"] / tile) == F.col(t)),
                           lambda x: F.struct((x["idx"] % tile).cast("int").alias("at"), x["p"].alias("p"),
                                              x["zero"].alias("zero")))

    blocks = (vectors.filter(F.size("v") > 1).withColumn("ta", tiles).withColumn("tb", tiles)
              .filter("ta <= tb")
              .select("lang", "ta", "tb", "m", within("ta").alias("va"), within("tb").alias("vb")))
    both = (blocks.mapInArrow(_pair_sums(tile), "lang string, a long, b long, part long")
            .groupBy("lang", "a", "b").agg(F.sum("part").alias("part")).filter("a <> b"))
    sums = (one.unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
            .unionByName(both))
    value = (neither.select("lang", "a", "b", "part").unionByName(sums)
             .groupBy("lang", "a", "b").agg(F.sum("part").alias("value")))
    return frame.select("lang", "source", "item", "a", "b").join(value, ["lang", "a", "b"]) \
        .select("lang", "source", "item", "value")


def _terms(counts: DataFrame, top: int) -> DataFrame:
    """``(lang, source, item, value)``: candidates for the first ``top``
    terms of each group.  ``counts`` has per group and kept term its count,
    the language's and both totals."""
    cell = ["lang", "source", "n", "lang_n"]
    cells = counts.groupBy(*cell).agg(F.count(F.lit(1)).alias("m"), F.first("total").alias("total"),
                                      F.first("lang_total").alias("lang_total"), F.first("kept").alias("kept"))
    values = (cells.withColumn("p", smoothed("n", "total", "kept"))
              .withColumn("q", smoothed("lang_n", "lang_total", "kept"))
              .filter("p > q").select(*cell, "m", (F.col("p") - F.col("q")).alias("value")))
    merged = values.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # a value has one term at least, so later values cannot reach the top
    first = merged.withColumn("nth", F.row_number().over(falling)).filter(F.col("nth") <= top)
    ahead = (first.withColumn("ahead", F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
             .filter(F.col("ahead") < top))
    # the cells whose terms can be among the first, at most `top` values a group
    wanted = values.join(ahead.select("lang", "source", "value", "ahead"), ["lang", "source", "value"])
    return counts.join(wanted.select(*cell, "value"), cell).select("lang", "source", F.col("term").alias("item"), "value")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               min_docs: int = MIN_DOCS, top: int = TOP, tile: int = TILE) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Null text, lang and source count as empty; each (lang, source) that
    occurs is a group, with or without terms.  A term is kept when at least
    ``min_docs`` documents of its language have it.  Part ``pair`` ranks the
    language's other sources by the summed differences of smoothed
    frequencies (0 without kept terms), part ``term`` the first ``top`` terms
    that a source uses more than its language.  Ties go by UTF-8 order.  A
    repeated row counts each time; an empty table gives no rows; other
    columns are not read.

    The pair part returns a row per ordered pair of sources of a language, so
    the number of sources of one language has to be one whose square can be
    returned; nothing else grows with that square."""
    counts = written(term_counts(docs, lang_col, source_col, text_col), "divergence-counts")
    present = counts.filter(F.col("term").isNull()).select("lang", "source")
    kept = written(counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
                   .agg(F.sum("docs").alias("d"), F.sum("n").alias("lang_n")).filter(F.col("d") >= min_docs)
                   .drop("d"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    rows = counts.filter(F.col("term").isNotNull()).drop("docs").join(kept, ["lang", "term"])
    rows = written(rows, "divergence-rows")
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("terms"))
    idx = Window.partitionBy("lang").orderBy("source")
    groups = (present.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["total", "terms", "kept", "lang_total"])
              .withColumn("none", F.lit(0).cast("long"))
              .withColumn("zero", F.when(F.col("kept") > 0, smoothed("none", "total", "kept")).otherwise(F.lit(0)))
              .withColumn("idx", F.row_number().over(idx) - 1).drop("none"))
    groups = written(groups, "divergence-groups")
    full = rows.join(_small(groups), ["lang", "source"])
    pairs = _pairs(full.withColumn("p", smoothed("n", "total", "kept")).select("lang", "term", "idx", "p", "zero"),
                   groups, tile)
    terms = _terms(full.select("lang", "source", "term", "n", "lang_n", "total", "lang_total", "kept"), top)
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(place)).select(*out)
            .unionByName(terms.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(place))
                         .filter(F.col("rank") <= top).select(*out)))


@register("op13_source_divergence", sql=r"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT rn, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rn) >= 30),
v AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS nl FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source, coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0) AS ng
        FROM (SELECT DISTINCT lang, source FROM d) g),
f AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
             1 + (CAST(1000000000 AS HUGEINT) * (coalesce(o.n, 0) + 5)) // (CAST(g.ng AS HUGEINT) + 5 * v.v) AS p,
             1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // (v.nl + 5 * v.v) AS q
      FROM grp g JOIN kept k USING (lang) JOIN v USING (lang)
      LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
       FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pr.value, 0) AS BIGINT) AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM f WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM x)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
""")
def op13_source_divergence(spark, sf_dir):
    """Per source: the other sources of its language by divergence, and the
    terms it overuses."""
    return divergence(documents(spark, sf_dir).select("text", "lang", "source"))
