"""lexicon sums per event-time window and user."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.plans.registry import register
from kiln.session import scratch_path
from kiln.sources import read_table
from kiln.streaming import windows

ARRIVALS = 4
LENGTH, DELAY = "6 hours", "12 hours"
VALUE_MARK = 20   # an event above it counts for its kind, one below against it

WINDOW_SQL = f"""
WITH n AS (SELECT max(event_id) + 1 AS n FROM events),
     e AS (SELECT event_id, ts, user_id, event_type, time_bucket(INTERVAL {LENGTH}, ts) AS w,
                  least({ARRIVALS - 1}, event_id * {ARRIVALS} // n
                        + CASE WHEN event_id % 50 = 7 THEN 2 WHEN event_id % 10 = 3 THEN 1 ELSE 0 END) AS arrival
           FROM events, n),
     lexicon AS (SELECT event_type AS term,
                        CAST(10 * count(*) FILTER (value > {VALUE_MARK}) // count(*) - 5 AS BIGINT) AS score
                 FROM events GROUP BY 1),
     seen AS (SELECT arrival, max(ts) AS latest FROM e GROUP BY 1),
     marks AS (SELECT arrival, max(latest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                               - INTERVAL {DELAY} AS mark FROM seen),
     in_time AS (SELECT e.* FROM e JOIN marks USING (arrival) WHERE mark IS NULL OR w + INTERVAL {LENGTH} > mark)
SELECT CAST(epoch(w) AS BIGINT) AS window_start, CAST(epoch(w) AS BIGINT) + 6 * 3600 AS window_end, user_id AS "user",
       count(*) AS n_events, CAST(coalesce(sum(score), 0) AS BIGINT) AS score, count(score) AS n_matched
FROM in_time LEFT JOIN lexicon ON term = event_type
GROUP BY w, user_id HAVING w + INTERVAL {LENGTH} <= (SELECT max(ts) FROM e) - INTERVAL {DELAY}
"""


def event_rows(events, *more):
    """Events as (ts, user, text): the kind and the names of its properties
    are its words."""
    return events.select(*more, F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("user"),
                         F.concat_ws(" ", "event_type", "props").alias("text"))


def event_lexicon(events):
    """Whole scores of the kinds of event: -5 to 5 by the share of events
    above VALUE_MARK."""
    return events.groupBy(F.col("event_type").alias("term")).agg(F.expr(
        f"10 * count_if(value > {VALUE_MARK}) div count(*) - 5").alias("score"))


def with_arrival(events):
    """Every tenth event comes an arrival late, every fiftieth two."""
    n = events.agg(F.max("event_id") + 1).first()[0]
    late = F.when(F.col("event_id") % 50 == 7, 2).when(F.col("event_id") % 10 == 3, 1).otherwise(0)
    return events.withColumn("arrival", F.least(
        F.lit(ARRIVALS - 1), F.expr(f"event_id * {ARRIVALS} div {n or 1}") + late))


@register("event_window_scores", WINDOW_SQL)
def q_event_window_scores(spark, sf_dir):
    """Batch: per 6 hours and user the events, the lexicon sum and the words
    found; rows later than 12 hours of event time left out."""
    events = read_table(spark, sf_dir, "events")
    arriving = event_rows(with_arrival(events), "arrival")
    return windows.windowed_scores(arriving, event_lexicon(events), LENGTH, DELAY)


@register("event_window_stream", WINDOW_SQL)  # the stream must equal the batch job
def q_event_window_stream(spark, sf_dir):
    """The same as a stream in append mode: the arrivals are written one after
    the other, and the query is started anew for each."""
    events = read_table(spark, sf_dir, "events")
    arriving = with_arrival(events)
    lexicon = event_lexicon(events)
    source, sink, state = (scratch_path(spark, f"window{part}") for part in ("source", "sink", "state"))
    out = None
    for i in range(ARRIVALS):
        arriving.filter(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(source)
        out = windows.run_window_stream(spark, source, events.schema, lexicon, sink, state, LENGTH, DELAY, event_rows)
    return out
