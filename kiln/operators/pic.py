"""Power iteration clustering on the hub-safe edge layout.

The affinities are made symmetric and laid out once (``graph.hub_layout``),
so a step moves one number per vertex: every vertex takes the mean of its
neighbours' values, weighted by affinity, and the values are scaled to sum to
one.  The steps stop when they no longer accelerate.  The values, a mix of the
leading eigenvectors that is nearly constant inside a cluster, are then parted
by k-means on the line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.graph import hub_layout, join_values, spread_to_salts
from kiln.operators.layout import sized_shuffles
from kiln.operators.scratch import drop, store


@dataclass
class PowerClusters:
    """``assigned``: (node, value, cluster); ``centres`` in rising order."""
    assigned: DataFrame
    steps: int
    centres: list


def _centres_of(values: DataFrame, k: int, rounds: int) -> tuple[list, int]:
    """K-means of numbers: centres start in the middles of k equal parts of
    their range, the nearest (the lower of two) takes a number; a centre
    without numbers stays.  k numbers a round reach the driver."""
    span = values.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    centres = [span["lo"] + (span["hi"] - span["lo"]) * (2 * i + 1) / (2 * k) for i in range(k)]
    for done in range(1, rounds + 1):
        found = {r["cluster"]: r["mean"] for r in
                 values.groupBy(nearest("value", centres).alias("cluster")).agg(F.avg("value").alias("mean")).collect()}
        new = [found.get(i, c) for i, c in enumerate(centres)]
        if new == centres:
            return centres, done
        centres = new
    return centres, rounds


def nearest(column: str, centres: list):
    """Index of the nearest centre (the lower of two)."""
    distance = [F.struct(F.abs(F.col(column) - F.lit(float(c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*distance))["i"]


def power_clusters(edges: DataFrame, k: int = 2, max_steps: int = 30, stop: float | None = 1e-5,
                   rounds: int = 30) -> PowerClusters:
    """Clusters of the vertices of ``edges (src, dst, weight)``.

    Affinities of a pair add up whatever their direction; loops, nulls and
    weights of 0 are left out, a negative weight raises.  Steps start from
    the degrees and end after ``max_steps``, or as soon as the change of the
    values differs from the step before by less than ``stop`` per vertex
    (None: never).  Vertices without edges do not occur."""
    spark = edges.sparkSession
    pairs = edges.filter("src is not null and dst is not null and weight is not null and src <> dst and weight <> 0")
    if not pairs.filter("weight < 0").isEmpty():
        raise ValueError("affinities are not negative")
    both = pairs.select("src", "dst", "weight").unionByName(
        pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    links = store(both.groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("weight")), "pic-links")
    nodes = store(links.groupBy("src").agg(F.sum("weight").alias("volume"), F.count(F.lit(1)).alias("deg")), "pic-nodes")
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("v"), F.sum("deg").alias("e")).first()
    n = size["n"]
    if not n:
        drop(links, nodes)
        return PowerClusters(spark.createDataFrame([], f"node {edges.schema['src'].dataType.simpleString()}, value double, "
                                                       "cluster int"), 0, [])
    with sized_shuffles(spark, size["e"]):
        salted, hubs = hub_layout(links, nodes.select("src", "deg"), size["e"], int(spark.conf.get("spark.sql.shuffle.partitions")))
        values = store(nodes.select("src", (F.col("volume") / F.lit(float(size["v"]))).alias("value")), "pic-values")
        last, steps = None, 0
        for steps in range(1, max_steps + 1):
            sent = join_values(salted, spread_to_salts(values, hubs), n)
            taken = (sent.groupBy(F.col("dst").alias("src")).agg(F.sum(F.col("weight") * F.col("value")).alias("got"))
                     .join(nodes, "src").select("src", (F.col("got") / F.col("volume")).alias("raw")))
            taken = store(taken.join(values, "src"), "pic-step")
            total = taken.agg(F.sum(F.abs("raw"))).first()[0]
            fresh = store(taken.select("src", (F.col("raw") / F.lit(total)).alias("value"),
                                       F.abs(F.col("raw") / F.lit(total) - F.col("value")).alias("moved")), "pic-values")
            change = fresh.agg(F.sum("moved")).first()[0]
            drop(values, taken)
            values = fresh.drop("moved")
            values.scratch = fresh.scratch
            if stop is not None and last is not None and abs(change - last) < stop / n:
                break
            last = change
    salted.unpersist()
    centres, _ = _centres_of(values, k, rounds)
    assigned = values.select(F.col("src").alias("node"), "value", nearest("value", centres).alias("cluster"))
    drop(links, nodes)
    return PowerClusters(assigned, steps, centres)
