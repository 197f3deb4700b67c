"""Lexicon sums per event-time window and user, as a batch and as a stream.

A row is an event with a time, a user and a text.  Its words are joined with
the lexicon (a static side, broadcast behind its measured bytes) and summed
per (window, user) by one partially aggregated exchange.

Rows come in arrivals (the files that one trigger finds).  The watermark is
the latest event time of the arrivals before, less ``delay``.  A row is late
when its window had ended by then: it is dropped, because its window has been
put out.  A window is put out once, when the watermark passes its end; those
still open at the end of the input stay in the state.  The batch job applies
the same rule to a table with an arrival number, so both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.operators.joins import BROADCAST_MAX_BYTES
from kiln.operators.text import PreparedLexicon, prepare_lexicon, tokens


def _hits(events: DataFrame, lexicon: PreparedLexicon) -> DataFrame:
    """``ts, user, pos, score``: a row per word of an event (one with null
    ``pos`` or 0 marks the event itself), the score null without an entry."""
    if lexicon.lengths not in ([], [1]):
        raise ValueError("windowed sums take a lexicon of single words")
    words = events.select("ts", "user", F.posexplode_outer(tokens("text")).alias("pos", "key"))
    entries = F.broadcast(lexicon.entries) if lexicon.size <= BROADCAST_MAX_BYTES else lexicon.entries
    return words.join(entries, "key", "left").select("ts", "user", "pos", "score")


def _sums(hits: DataFrame, length: str) -> DataFrame:
    out = hits.groupBy(F.window("ts", length).alias("w"), "user").agg(
        F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("n_events"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("long").alias("score"),
        F.count("score").alias("n_matched"))
    return out.select(F.unix_timestamp("w.start").alias("window_start"), F.unix_timestamp("w.end").alias("window_end"),
                      "user", "n_events", "score", "n_matched")


def windowed_scores(events: DataFrame, lexicon: DataFrame, length: str = "6 hours",
                    delay: str = "12 hours") -> DataFrame:
    """``window_start, window_end`` (epoch seconds)``, user, n_events, score,
    n_matched`` of ``events (ts, user, text, arrival)``, late rows left out,
    windows open at the end left out.

    Arrivals are numbers; rows of one arrival are never late to each other.
    A null text has no words; a row with a null time belongs to no window; a
    null user is a user; an event that occurs twice counts twice."""
    timed = events.filter(F.col("ts").isNotNull())
    # a row per arrival
    seen = timed.groupBy("arrival").agg(F.max("ts").alias("latest"))
    before = Window.orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    marks = seen.select("arrival", (F.max("latest").over(before) - F.expr(f"interval {delay}")).alias("mark"))
    ends = F.window("ts", length)["end"]
    # arrivals are triggers of a stream: few, but counted before they travel
    marks = F.broadcast(marks) if seen.count() * 32 <= BROADCAST_MAX_BYTES else marks
    in_time = timed.join(marks, "arrival").withColumn("ends", ends) \
        .filter(F.col("mark").isNull() | (F.col("ends") > F.col("mark"))).select("ts", "user", "text")
    last = timed.agg(F.unix_seconds(F.max("ts") - F.expr(f"interval {delay}")).alias("s"),
                     F.max("ts").alias("m")).first()
    out = _sums(_hits(in_time, prepare_lexicon(lexicon)), length)
    if last["m"] is None:
        return out
    return out.filter(F.col("window_end") <= F.lit(last["s"]))


def run_window_stream(spark: SparkSession, source_dir: str, schema, lexicon: DataFrame, sink_dir: str,
                      checkpoint_dir: str, length: str = "6 hours", delay: str = "12 hours",
                      select=None) -> DataFrame:
    """Run the stream over the files that ``source_dir`` has now and return
    all windows put out so far (this call's and earlier ones').

    All new files are one arrival.  State, watermark and the list of files
    read live in ``checkpoint_dir``: calling it again goes on where the last
    call, finished or not, left off, and the file sink's log keeps the output
    free of repeats.  ``select`` maps the files' rows to ``ts, user, text``."""
    prepared = prepare_lexicon(lexicon).persist()
    try:
        rows = spark.readStream.schema(schema).parquet(source_dir)
        rows = select(rows) if select else rows
        sums = _sums(_hits(rows.withWatermark("ts", delay), prepared), length)
        query = (sums.writeStream.outputMode("append").format("parquet").option("path", sink_dir)
                 .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        prepared.unpersist()
    return spark.read.schema(sums.schema).parquet(sink_dir)
