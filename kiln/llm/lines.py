"""Line dedup by site-relative frequency.

Rows are grouped by host.  A line's frequency is the number of the host's
pages that contain it over the host's page total; lines above ``ratio`` that
``min_count`` pages have are boilerplate and dropped from all the host's
pages.  A host has no least size: one of fewer than ``min_count`` pages has
no such line, one of 19 loses a footer like one of 19 million.

Lines are counted as 128-bit keys, once per page, with partial sums before
the shuffle, so neither a host with a third of all pages nor a line on every
page lands in one task.  Boilerplate lines are few by definition (a host has
at most mean distinct lines per page / ratio); they go back to the pages as
one array per host, broadcast when their measured size allows it and joined
by host (split by the adaptive skew join) beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.registry import register
from kiln.llm.tables import documents, fresh, text_of, written

RATIO = 0.08       # share of a host's pages beyond which a line is boilerplate
MIN_PAGES = 1      # pages of a host whose lines are judged: all hosts
MIN_COUNT = 5      # a line's support: it must be on so many pages at least
BROADCAST_BYTES = 32 << 20


def line_key(line):
    """128-bit key of a line without its surrounding blanks."""
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r")).cast("binary")))


def boilerplate(pages: DataFrame, host: str, text: str, ratio=RATIO, min_pages=MIN_PAGES,
                min_count=MIN_COUNT) -> DataFrame:
    """``(host, drop)``: per host the array of its boilerplate line keys."""
    blank = line_key(F.lit(""))
    keys = F.array_distinct(F.transform(F.split(F.col(text), "\n"), line_key))
    totals = pages.groupBy(host).agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    counts = (pages.select(host, F.explode(keys).alias("key")).filter(F.col("key") != blank)
              .groupBy(host, "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))
    return (counts.join(totals, host).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
            .groupBy(host).agg(F.collect_list("key").alias("drop")))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio=RATIO,
                     min_pages=MIN_PAGES, min_count=MIN_COUNT) -> DataFrame:
    """``docs`` with every column, the text without its boilerplate lines,
    and two more columns (see ``line_columns``): the numbers of lines and of
    lines removed.

    A line is what stands between newlines, compared without surrounding
    blanks, tabs and carriage returns; blank lines are never boilerplate.  A
    null host is a host of its own; null text stays null and has no lines;
    an empty text is one blank line.  Repeated rows count as pages each.  An
    empty table gives no rows."""
    lines, removed = line_columns(docs)
    host, text, drop = fresh(docs, "host_"), fresh(docs, "body_"), fresh(docs, "drop_")
    pages = docs.select(F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("n")).alias(host),
                        text_of(text_col).alias(text))
    table = written(boilerplate(pages, host, text, ratio, min_pages, min_count)
                    .withColumnRenamed("drop", drop), "boilerplate")
    size = table.agg(F.sum(F.size(drop) * 40 + 200).alias("b")).first()["b"] or 0
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    host_key = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("n"))
    all_lines = F.split(text_of(text_col), "\n")
    kept = F.filter(all_lines, lambda line: ~F.array_contains(F.col(drop), line_key(line)))
    joined = docs.withColumn(host, host_key).join(table, host, "left")
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(all_lines))
    out = joined.withColumn(lines, n_lines.cast("long"))
    out = out.withColumn(text, F.when(F.col(drop).isNull() | F.col(text_col).isNull(), F.col(text_col))
                         .otherwise(F.array_join(kept, "\n")))
    out = out.withColumn(removed, F.when(F.col(drop).isNull() | F.col(text_col).isNull(), F.lit(0))
                         .otherwise(F.size(all_lines) - F.size(kept)).cast("long"))
    columns = [F.col(text).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, lines, removed)


def line_columns(docs: DataFrame) -> tuple[str, str]:
    """Names of the two count columns that ``drop_boilerplate`` adds."""
    return fresh(docs, "n_lines"), fresh(docs, "n_removed")


@register("op7_line_dedup", sql=r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce('h' || source, 'n') AS host, text,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rn, doc_id, host, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM l),
pages AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
freq AS (SELECT host, body, count(DISTINCT rn) AS n FROM k WHERE body <> '' GROUP BY host, body),
bad AS (SELECT host, body FROM freq JOIN pages USING (host)
        WHERE n >= 5 AND n > CAST(0.08 AS DOUBLE) * pages),
f AS (SELECT k.*, bad.body IS NOT NULL AS gone FROM k LEFT JOIN bad ON k.host = bad.host AND k.body = bad.body)
SELECT doc_id, CASE WHEN bool_and(text IS NULL) THEN 0 ELSE count(*) END AS n_lines,
       count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f JOIN d USING (rn, doc_id) GROUP BY rn, doc_id
""")
def op7_line_dedup(spark, sf_dir):
    """Per document: lines, lines removed, SHA-256 of the remaining text."""
    out = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed",
                      F.sha2(text_of("text").cast("binary"), 256).alias("kept_sha256"))
