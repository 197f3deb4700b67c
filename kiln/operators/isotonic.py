"""Isotonic regression as a lower convex hull, without pooling in one place.

With the points in order of x, the rising least-squares fit is the slope of
the greatest convex curve below the prefix sums (of weight, of weighted y).
Each range of x finds the hull of its own prefix sums; neighbouring hulls are
joined level by level by the one line that touches both from below, and what
lies above it goes.  Only the ends of those lines, a pair per range, are
looked at together; hull points stay where they are, so the number of
distinct x and of blocks is unbounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.scratch import drop, store

_POINT = "part int, w double, s double, x_end double, x_next double"


def lower_hull(w: np.ndarray, s: np.ndarray) -> list[int]:
    """Positions of the corners of the lower hull of points in order of w."""
    keep: list[int] = []
    for i in range(len(w)):
        while len(keep) > 1:
            a, b = keep[-2], keep[-1]
            if (s[b] - s[a]) * (w[i] - w[b]) < (s[i] - s[b]) * (w[b] - w[a]):
                break
            keep.pop()  # on or above the line past it
        keep.append(i)
    return keep


def _hull(table):
    """One range of x: rows (part, x, w, s, base_w, base_s, next_x, first)."""
    table = table.sort_by("x")
    x, w, s = (table.column(c).to_numpy() for c in ("x", "w", "s"))
    base_w, base_s, following, first = (table.column(c)[0].as_py() for c in ("base_w", "base_s", "next_x", "first"))
    w, s = base_w + np.cumsum(w), base_s + np.cumsum(s)
    end, after = list(x), [*x[1:], following]
    if first:  # the curve starts in the origin, before the first x
        w, s, end, after = np.append(0.0, w), np.append(0.0, s), [None, *end], [x[0], *after]
    keep = lower_hull(w, s)
    one = lambda v: pa.array([v[i] for i in keep], pa.float64())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(keep), pa.int32()), "w": one(w), "s": one(s),
                     "x_end": one(end), "x_next": one(after)})


def _joined(points: DataFrame, span: int, shared) -> DataFrame:
    """``points`` with their pair of neighbouring hulls and side in it."""
    pair = F.floor(F.col("part") / F.lit(2 * span)).cast("int")
    out = points.withColumn("pair", pair).withColumn("left", F.floor(F.col("part") / F.lit(span)) % 2 == 0)
    return out if shared is None else out.join(F.broadcast(shared), "pair")


def _touching_lines(points: DataFrame, span: int) -> DataFrame:
    """``pair, p_w, q_w``: where the line below both hulls of a pair touches
    them.  From an end of the left hull the tangent to the right one, from
    there back to the left, until neither moves; a row per pair of ranges."""
    spark = points.sparkSession
    ends = _joined(points, span, None).groupBy("pair").agg(
        F.max(F.when(F.col("left"), F.struct("w", "s"))).alias("p"), F.count(F.when(~F.col("left"), 1)).alias("right"))
    at = {r["pair"]: (r["p"]["w"], r["p"]["s"]) for r in ends.filter("p is not null and right > 0").collect()}
    if not at:
        return None
    found: dict = {}
    moving = set(at)
    while moving:
        shared = spark.createDataFrame([(g, *at[g]) for g in moving], "pair int, a_w double, a_s double")
        right = _joined(points, span, shared).filter(~F.col("left"))
        slope = (F.col("s") - F.col("a_s")) / (F.col("w") - F.col("a_w"))
        q = {r["pair"]: (-r["q"]["far"], r["q"]["s"]) for r in right.groupBy("pair").agg(
            F.min(F.struct(slope.alias("slope"), (-F.col("w")).alias("far"), "s")).alias("q")).collect()}
        shared = spark.createDataFrame([(g, *q[g]) for g in moving], "pair int, a_w double, a_s double")
        left = _joined(points, span, shared).filter("left")
        slope = (F.col("a_s") - F.col("s")) / (F.col("a_w") - F.col("w"))
        p = {r["pair"]: (-r["p"]["far"], r["p"]["s"]) for r in left.groupBy("pair").agg(
            F.max(F.struct(slope.alias("slope"), (-F.col("w")).alias("far"), "s")).alias("p")).collect()}
        still = set()
        for g in moving:
            found[g] = (p[g][0], q[g][0])
            if p[g] != at[g]:
                still.add(g)
            at[g] = p[g]
        moving = still
    return spark.createDataFrame([(g, *v) for g, v in found.items()], "pair int, p_w double, q_w double")


def isotonic_blocks(df: DataFrame, x: str, y: str, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """``x_lo, x_hi, weight, value``: the blocks of the rising fit of ``y``
    on ``x``, each with the x it spans, its weight and its level.

    Rows of one x are one point.  Rows with a null or a weight of 0 or less
    are left out; an empty table gives no rows.  ``ranges`` is the number of
    ranges of x (by default the session's shuffle partitions)."""
    spark = df.sparkSession
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")) \
        .filter("x is not null and y is not null and w > 0")
    points = rows.groupBy("x").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = store(points.repartitionByRange(ranges, "x").withColumn("range", F.spark_partition_id()), "isotonic-points")
    # a row per range
    order = Window.orderBy("range")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("range").agg(F.sum("w").alias("tw"), F.sum("s").alias("ts"), F.min("x").alias("x0"))
    base = sums.select("range", (F.row_number().over(order) - 1).cast("int").alias("part"),
                       (F.sum("tw").over(before) - F.col("tw")).alias("base_w"),
                       (F.sum("ts").over(before) - F.col("ts")).alias("base_s"), F.lead("x0").over(order).alias("next_x"))
    base = base.withColumn("first", F.col("part") == 0)
    hulls = store(placed.join(F.broadcast(base), "range").drop("range").groupBy("part").applyInArrow(_hull, _POINT),
                  "isotonic-hull")
    drop(placed)
    parts = hulls.agg(F.max("part")).first()[0]
    if parts is None:
        return spark.createDataFrame([], "x_lo double, x_hi double, weight double, value double")
    span = 1
    while span <= parts:
        lines = _touching_lines(hulls, span)
        if lines is not None:
            cut = (_joined(hulls, span, None).join(F.broadcast(lines), "pair", "left")
                   .filter(F.col("p_w").isNull() | F.when(F.col("left"), F.col("w") <= F.col("p_w"))
                           .otherwise(F.col("w") >= F.col("q_w"))))
            smaller = store(cut.select(*hulls.columns), "isotonic-hull")
            drop(hulls)
            hulls = smaller
        span *= 2
    # the next corner: in the same range, else the first one of the next range that has any
    firsts = hulls.groupBy("part").agg(F.min(F.struct("w", "s", "x_end")).alias("head"))
    nexts = firsts.select("part", F.lead("head").over(Window.orderBy("part")).alias("beyond"))
    own = F.lead(F.struct("w", "s", "x_end")).over(Window.partitionBy("part").orderBy("w"))
    corners = hulls.withColumn("own", own).join(F.broadcast(nexts), "part").withColumn("to", F.coalesce("own", "beyond"))
    width = F.col("to.w") - F.col("w")
    return corners.filter("to is not null").select(
        F.col("x_next").alias("x_lo"), F.col("to.x_end").alias("x_hi"), width.alias("weight"),
        ((F.col("to.s") - F.col("s")) / width).alias("value"))
