"""Windowed lexicon sums: batch = stream = a plain replay, late rows included."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kiln.plans import event_windows as E
from kiln.session import scratch_path
from kiln.sources import read_table
from kiln.streaming import windows

LEXICON = [("good", 3), ("bad", -3), ("Fine", 1), ("nothing", 0)]
START = dt.datetime(2024, 3, 1)
SCHEMA = "ts timestamp, user long, text string, arrival int"


def events(seed):
    rng = random.Random(seed)
    out = []
    for arrival in range(3):
        for _ in range(80):
            minutes = arrival * 600 + rng.randrange(600) - (rng.randrange(1500) if rng.random() < 0.3 else 0)
            text = rng.choice([None, "", "good", "Good good, bad!", "fine nothing else", "unknown words", "gòod"])
            out.append((START + dt.timedelta(minutes=minutes), rng.choice([1, 2, None]), text, arrival))
    return out + [(None, 1, "good", 0), out[5], out[5]]


def replay(rows, hours, delay):
    """Late rows by their arrival, open windows left out."""
    score = {w.lower(): s for w, s in LEXICON}
    sums, n, found = Counter(), Counter(), Counter()
    mark, dropped = None, 0
    for arrival in range(3):
        mine = [r for r in rows if r[3] == arrival and r[0] is not None]
        for ts, user, text, _ in mine:
            start = START + dt.timedelta(hours=((ts - START).total_seconds() // 3600 // hours) * hours)
            end = start + dt.timedelta(hours=hours)
            if mark is not None and end <= mark:
                dropped += 1
                continue
            key = (int((start - dt.datetime(1970, 1, 1)).total_seconds()), int((end - dt.datetime(1970, 1, 1)).total_seconds()), user)
            n[key] += 1
            for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
                if word in score:
                    sums[key] += score[word]
                    found[key] += 1
        latest = max(r[0] for r in rows if r[0] is not None and r[3] <= arrival)
        mark = latest - dt.timedelta(hours=delay)
    close = (mark - dt.datetime(1970, 1, 1)).total_seconds()
    return sorted(((*k, n[k], sums[k], found[k]) for k in n if k[1] <= close), key=repr), dropped


def rows_of(df):
    return sorted((tuple(r[c] for c in ("window_start", "window_end", "user", "n_events", "score", "n_matched"))
                   for r in df.collect()), key=repr)


def test_batch_and_restarted_stream_equal_a_replay(spark):
    rows = events(1)
    want, dropped = replay(rows, 2, 3)
    assert dropped > 5 and len(want) > 10
    lexicon = spark.createDataFrame(LEXICON, "term string, score int")
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(windows.windowed_scores(table, lexicon, "2 hours", "3 hours")) == want
    source, sink, state = (scratch_path(spark, f"t-window{x}") for x in "abc")
    out, sizes = None, []
    for i in range(3):
        table.filter(F.col("arrival") == i).drop("arrival").repartition(2).write.mode("append").parquet(source)
        out = windows.run_window_stream(spark, source, table.drop("arrival").schema, lexicon, sink, state,
                                        "2 hours", "3 hours")
        sizes.append(out.count())
    assert rows_of(out) == want and sizes == sorted(sizes) and sizes[0] > 0
    # nothing new: nothing is put out again
    again = windows.run_window_stream(spark, source, table.drop("arrival").schema, lexicon, sink, state,
                                      "2 hours", "3 hours")
    assert rows_of(again) == want


def test_windows_of_no_rows_and_phrases(spark):
    lexicon = spark.createDataFrame(LEXICON, "term string, score int")
    assert windows.windowed_scores(spark.createDataFrame([], SCHEMA), lexicon).count() == 0
    assert windows.windowed_scores(spark.createDataFrame([(None, 1, "good", 0)], SCHEMA), lexicon).count() == 0
    phrases = spark.createDataFrame([("not good", -2)], "term string, score int")
    with pytest.raises(ValueError, match="single words"):
        windows.windowed_scores(spark.createDataFrame(events(2), SCHEMA), phrases)


def test_the_registered_query_has_late_and_open_rows(spark):
    got = E.q_event_window_scores(spark, SF001).agg(F.sum("n_events")).first()[0]
    table = read_table(spark, SF001, "events")
    closed = E.with_arrival(table)
    total = table.count()
    assert 0 < got < total
    last = table.agg(F.max("ts")).first()[0]
    still_open = closed.filter(F.col("ts") > F.lit(last - dt.timedelta(hours=12 + 6))).count()
    assert got < total - still_open  # late rows were dropped too
