"""Exact dedup: two passes over a Bloom filter of text hashes.

Pass one drops every row's hash into two slot families and keeps the slots
hit at least twice: a Bloom filter of the possibly repeated hashes.  Pass two
probes it: a row that misses in either family has a text of its own and goes
straight through; only the hits shuffle, to be grouped by their SHA-256.

The filter has at most ``2 * MAX_SLOTS`` bits whatever the input, kept as
64-bit words (at most ``2 * MAX_SLOTS / 64`` rows), so broadcasting it has a
proven bound.  A fuller filter lets more unique rows into the shuffle and
never changes a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.registry import register
from kiln.llm.tables import SPACES, documents, join_counted, text_of, written

MAX_SLOTS = 1 << 26  # bits of a slot family: 2^20 words of 64 bits at most
SLOTS_PER_ROW = 16


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), f"[{SPACES}]+", " ")


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_sha256)`` of the whitespace-normalised texts."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256"))


def _slot(seed: int, slots: int):
    return F.pmod(F.xxhash64(F.lit(seed), "text_sha256"), F.lit(slots))


def repeated_filter(digests: DataFrame, slots: int) -> DataFrame:
    """The Bloom filter: ``(word, bits)`` of the slots hit twice or more.
    Family 1 follows family 0 in the numbering."""
    hits = (digests.select(F.explode(F.array(_slot(0, slots), _slot(1, slots) + slots)).alias("slot"))
            .groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return (hits.groupBy(F.expr("slot div 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``.

    Texts are equal when identical after each run of separators became one
    space.  Null text counts as empty; empty texts equal each other.  The
    smallest id of a group stays (a null id sorts last); of rows that repeat
    both id and text exactly one is kept.  Other columns of ``docs`` are not
    read, so their names cannot clash.  An empty table gives no rows."""
    digests = written(text_digests(docs, id_col, text_col), "digests")
    slots = 64
    total = digests.count()
    while slots < min(MAX_SLOTS, SLOTS_PER_ROW * total):
        slots *= 2
    # each at most 2 * MAX_SLOTS / 64 words: broadcast within a proven bound
    words = written(repeated_filter(digests, slots), "bloom")
    probe = digests
    for seed in (0, 1):
        slot = _slot(seed, slots) + seed * slots
        side = words.select(F.col("word").alias(f"w{seed}"), F.col("bits").alias(f"b{seed}"))
        probe = (probe.withColumn(f"s{seed}", slot)
                 .join(F.broadcast(side), F.expr(f"s{seed} div 64 = w{seed}"), "left"))
    hit = F.expr("coalesce(getbit(b0, cast(s0 % 64 as int)), 0) = 1 "
                 "and coalesce(getbit(b1, cast(s1 % 64 as int)), 0) = 1")
    probe = probe.select("doc_id", "text_sha256", hit.alias("hit"))
    through = probe.filter(~F.col("hit")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    # candidates: repeats of one (text, id) become a count before anything
    # is keyed by the text, and a hot text is one row per task in its sums
    rows = (probe.filter("hit").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("copies")))
    groups = (probe.filter("hit").groupBy("text_sha256")
              .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    first = F.expr("copy = 0 and doc_id <=> keep_id")
    shuffled = (join_counted(rows, written(groups, "groups"), ["text_sha256"], "group_size", total)
                .select("doc_id", "keep_id", "group_size", "text_sha256",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
                .select("doc_id", "keep_id", "group_size", first.alias("kept"), "text_sha256"))
    return through.unionByName(shuffled)


@register("op1_exact_dedup", sql=r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))
