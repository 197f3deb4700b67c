"""Graph jobs on edge DataFrames: degrees, PageRank, connected components.

Each iteration is a join of the edges with the vertex values on ``src``
and a grouped sum/min by ``dst`` (partially aggregated before its shuffle,
so a vertex with many in-edges costs one row per task).  The edges are laid
out once (``hub_layout``): hash-partitioned by ``(src, salt)`` and kept, so
a round shuffles only the vertex values, never the edges.  A hub vertex
(out-degree above E / P) has its edges dealt over several salts and its
value replicated to each, so no task holds more than about one partition's
share of edges.  Lineage is cut with ``checkpoint()`` (reliable, in
``spark.checkpoint.dir``) every few rounds so long iterations do not grow
the plan.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.joins import BROADCAST_MAX_BYTES
from kiln.operators.layout import sized_shuffles
from kiln.session import delete_scratch, ensure_checkpoint_dir, scratch_path

BROADCAST_MAX_ROWS = BROADCAST_MAX_BYTES // 32  # vertex values are fixed-width rows of three numbers


def hub_layout(edges: DataFrame, degrees: DataFrame, total: int, partitions: int):
    """Edges ``(src, dst, ...)`` laid out for repeated joins on ``src``.

    ``degrees`` = ``(src, deg)`` out-degrees, ``total`` = their sum (E).
    Returns ``(salted, hubs)``: ``salted`` = the edges plus ``salt``,
    hash-partitioned by ``(src, salt)`` into P partitions and persisted;
    ``hubs`` = ``(src, n_salts)`` for vertices whose out-degree exceeds
    E / P, their edges dealt over ``ceil(deg / (E / P))`` salts by a hash
    of ``dst``.  Degrees sum to E, so fewer than P vertices can exceed E / P:
    ``hubs`` has a proven bound of P rows and is broadcast (None: no hub)."""
    spark = edges.sparkSession
    share = max(1, -(-int(total) // partitions))
    hub_rows = (degrees.filter(F.col("deg") > F.lit(share))
                .select("src", F.ceil(F.col("deg") / F.lit(share)).cast("int").alias("n_salts")).collect())
    if not hub_rows:
        # no hub: one salt (a constant the optimizer drops from the join
        # keys), so the layout is by src alone
        hubs = None
        salted = edges.withColumn("salt", F.lit(0)).repartition(partitions, "src")
    else:
        hubs = spark.createDataFrame(hub_rows, T.StructType([edges.schema["src"],
                                                             T.StructField("n_salts", T.IntegerType())]))
        salted = (edges.join(F.broadcast(hubs), "src", "left")
                  .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("n_salts")), F.lit(0)).cast("int"))
                  .drop("n_salts")
                  .repartition(partitions, "src", "salt"))
    salted = salted.persist(StorageLevel.MEMORY_AND_DISK)
    # materialised now: a cached plan's partitioning is known to the
    # planner (AQE re-plans cached plans) only once it has run, and every
    # round is planned against it
    salted.count()
    return salted, hubs


def join_values(salted: DataFrame, values: DataFrame, n_values: int) -> DataFrame:
    """Edges joined with per-vertex values on ``(src, salt)``.  The values
    are broadcast only when their counted size allows it; otherwise both
    are hash-partitioned by ``(src, salt)`` and only the values move, as the
    edges already are laid out that way."""
    if n_values <= BROADCAST_MAX_ROWS:
        return salted.join(F.broadcast(values), ["src", "salt"])
    return salted.join(values, ["src", "salt"])


def spread_to_salts(values: DataFrame, hubs: DataFrame) -> DataFrame:
    """Vertex values keyed by ``src``, one copy per salt of a hub (one row
    for every other vertex), ready to join ``hub_layout`` edges on
    ``(src, salt)``."""
    if hubs is None:
        return values.withColumn("salt", F.lit(0))
    return (values.join(F.broadcast(hubs), "src", "left")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1)))
            .drop("n_salts"))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (out.join(inn, "node", "full")
            .select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


def pagerank(edges: DataFrame, iters: int = 10, damping: float = 0.85, checkpoint_every: int = 5) -> DataFrame:
    """Power iteration ``r' = (1-d)/N + d * sum_{u->v} r_u / outdeg_u``.
    Mass of vertices without out-edges is not redistributed."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    # the edge and vertex tables are read every round: computed once, kept
    # (memory, spilling to disk) for the loop, released at the end
    # vertex table with its out-degree, hash-partitioned by vertex and kept:
    # every round's rank update joins it without a shuffle of its own
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    nodes = (edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
             .join(deg, "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg"))
             .persist(StorageLevel.MEMORY_AND_DISK))
    stats = nodes.agg(F.count(F.lit(1)).alias("n"), F.sum("deg").alias("e")).first()
    n = stats["n"]
    if n == 0:  # no edges: no vertices to rank
        nodes.unpersist()
        return spark.createDataFrame([], T.StructType([T.StructField("node", edges.schema["src"].dataType),
                                                       T.StructField("rank", T.DoubleType())]))
    with sized_shuffles(spark, stats["e"] or 0):
        salted, hubs = hub_layout(edges.select("src", "dst"), nodes.withColumnRenamed("node", "src"),
                                  stats["e"] or 0, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ranks = nodes.withColumn("rank", F.lit(1.0 / n))
        for i in range(iters):
            # each vertex sends rank / out-degree along every out-edge
            shares = ranks.filter(F.col("deg") > 0).select(F.col("node").alias("src"),
                                                           (F.col("rank") / F.col("deg")).alias("share"))
            contrib = (join_values(salted, spread_to_salts(shares, hubs), n)
                       .groupBy(F.col("dst").alias("node")).agg(F.sum("share").alias("s")))
            ranks = (nodes.join(contrib, "node", "left")
                     .select("node", "deg", (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("s", F.lit(0.0)))
                             .alias("rank")))
            if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < iters:
                ensure_checkpoint_dir(spark)
                ranks = ranks.checkpoint(eager=True)
        # keep the result itself, so releasing the loop inputs does not make a
        # later action recompute every round
        ranks = ranks.select("node", "rank").persist(StorageLevel.MEMORY_AND_DISK)
        ranks.count()
    salted.unpersist()
    nodes.unpersist()
    return ranks


def connected_components(edges: DataFrame, max_iter: int | None = None, checkpoint_every: int = 1) -> DataFrame:
    """Components of the undirected graph: ``(node, component)`` with the
    component named by its smallest vertex id.

    Large-star and small-star rounds: every vertex first links its larger
    neighbours, then its smaller ones, to the smallest vertex it knows, so
    paths halve and the rounds grow with the logarithm of the vertices, not
    with the diameter.  The smallest neighbour is a partially aggregated
    minimum, joined back by vertex (a hub is split by the adaptive skew
    join).  A round names its edges many times, so each round's edges are
    written to the shared folder (and the last round's deleted): the plan of
    a round starts from files, and a lost executor costs a re-read.  The
    fixed point is found by an order-free checksum that the write observes.
    ``max_iter`` is a guard: reaching it before the fixed point raises.
    ``checkpoint_every`` is accepted and has no effect: every round is kept."""
    pairs = edges.select("src", "dst").filter("src is not null and dst is not null")
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select(F.col("dst").alias("node"))).distinct()
    star, path, before = _round(pairs.filter("src <> dst")
                                .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                                .distinct())
    i = 0
    while before[0]:
        if max_iter is not None and i >= max_iter:
            raise RuntimeError(f"components not stable after max_iter={max_iter} rounds")
        both = star.union(star.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = (both.join(low, "src").filter(F.col("dst") > F.col("src"))
                 .select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct())
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        last = path
        star, path, after = _round(
            small.select(F.explode(F.array(F.struct(F.col("src"), F.col("low").alias("dst")),
                                           F.struct(F.col("dst").alias("src"), F.col("low").alias("dst"))))
                         .alias("e")).select("e.src", "e.dst").filter("src <> dst").distinct())
        delete_scratch(edges.sparkSession, last)
        i += 1
        if after == before:
            break
        before = after
    # at the fixed point every vertex but a component's smallest has one edge
    return (nodes.join(star.withColumnRenamed("src", "node"), "node", "left")
            .select("node", F.coalesce("dst", "node").alias("component")))


def _round(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """The edges written and read back, their folder, and their count with an
    order-free checksum."""
    spark = edges.sparkSession
    path, seen = scratch_path(spark, "star"), Observation()
    (edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h"))
     .write.parquet(path))
    return spark.read.schema(edges.schema).parquet(path), path, (seen.get["n"], seen.get["h"])
