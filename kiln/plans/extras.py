"""Jobs implied by the sample data formats (recommendation,
clustering, graphs, itemsets, isotonic, topics, sentiment, streaming),
run on the driver tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, PowerIterationClustering
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from kiln.operators import clustering, graph, isotonic, itemsets, pic, recommend, text, topics
from kiln.operators.layout import dealt, dealt_by_one, sized_shuffles, whole_files
from kiln.operators.scratch import store
from kiln.plans.constants import SEED
from kiln.plans.registry import register
from kiln.plans.training import SQL_X, SQL_Y
from kiln.session import scratch_path
from kiln.sources import image_table, read_table

TOKEN_SQL = r"string_split_regex(lower(text), '[^\p{L}]+')"


# ---------------------------------------------------------------- F1 recommendation

@register("ratings_matrix", """
SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def q_ratings_matrix(spark, sf_dir):
    """User x item interaction counts (implicit ratings) from the events."""
    return recommend.interaction_counts(read_table(spark, sf_dir, "events"), "user_id", "event_type", "n")


def purchase_ratings(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return (j.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
            .agg(F.count(F.lit(1)).alias("rating"),
                 F.max(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01"))).alias("ts")))


@register("ratings_parse", """
SELECT CAST(o_custkey AS BIGINT) AS "user", CAST(l_partkey AS BIGINT) AS item,
       CAST(count(*) AS FLOAT) AS rating,
       max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
""")
def q_ratings_parse(spark, sf_dir):
    """Purchases as ``user::item::rating::ts`` lines, parsed back."""
    path = scratch_path(spark, "ratings")
    recommend.write_ratings_text(purchase_ratings(spark, sf_dir), path)
    return recommend.read_ratings_text(spark, path)


@register("als_recommend")
def q_als_recommend(spark, sf_dir):
    """ALS (rank 8) on customer x part purchase counts: per customer the
    best-scored purchased part and the fit error on observed pairs."""
    # read by the range check, the fit and its evaluation: joined once
    ratings = store(purchase_ratings(spark, sf_dir).select("user", "item", "rating"), "ratings")
    model = recommend.als_fit(ratings, rank=8, max_iter=5, seed=SEED)
    return recommend.evaluate_fit(model, ratings)


# ---------------------------------------------------------------- F2 k-means

@register("kmeans_assign", """
WITH x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos
           FROM embeddings),
     c AS (SELECT label AS cluster, pos, avg(v) AS m FROM x GROUP BY 1, 2),
     d AS (SELECT x.vec_id, c.cluster, sum(pow(x.v - c.m, 2)) AS d2 FROM x JOIN c ON x.pos = c.pos GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS rn FROM d)
SELECT vec_id AS id, CAST(cluster AS BIGINT) AS cluster, round(sqrt(d2), 6) AS distance FROM r WHERE rn = 1
""")
def q_kmeans_assign(spark, sf_dir):
    """Nearest of the per-label centroids (a k-means assignment step)."""
    df = image_table(spark, sf_dir)
    keys, centres = clustering.collect_centroids(clustering.group_centroids(df, "label"), "label")
    out = clustering.assign_nearest(df, centres, "features", names=[int(k) for k in keys])
    return out.select("id", F.col("cluster").cast("bigint").alias("cluster"),
                      F.round("distance", 6).alias("distance"))


def _lloyd_sql(rounds: int) -> str:
    """Rounds of assign and average from the label centroids, unrolled."""
    parts = ["""x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS pos
      FROM embeddings)""", "c0 AS (SELECT label AS cluster, pos, avg(v) AS m FROM x GROUP BY 1, 2)"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT vec_id, cluster, d2 FROM (
      SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster) AS rn FROM (
        SELECT x.vec_id, c.cluster, sum(pow(x.v - c.m, 2)) AS d2 FROM x JOIN c{i} c ON x.pos = c.pos GROUP BY 1, 2))
      WHERE rn = 1)""")
        parts.append(f"""c{i + 1} AS (SELECT a.cluster, x.pos, avg(x.v) AS m
      FROM x JOIN a{i} a USING (vec_id) GROUP BY 1, 2)""")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(sum(d2), 4) AS cost FROM a{rounds} GROUP BY cluster""")


@register("kmeans_lloyd", _lloyd_sql(2))
def q_kmeans_lloyd(spark, sf_dir):
    """Two k-means rounds from the label centroids, then sizes and costs."""
    df = image_table(spark, sf_dir)
    keys, centres = clustering.collect_centroids(clustering.group_centroids(df, "label"), "label")
    keys, centres = clustering.lloyd(df, centres, [int(k) for k in keys], rounds=2)
    out = clustering.assign_nearest(df, centres, "features", names=keys)
    return out.groupBy(F.col("cluster").cast("bigint").alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.pow("distance", 2)), 4).alias("cost"))


@register("kmeans_fit")
def q_kmeans_fit(spark, sf_dir):
    """Spark ML k-means, k = 10: cluster sizes and training cost."""
    df = image_table(spark, sf_dir)
    model = clustering.kmeans_fit(df, 10, seed=SEED)
    pred = model.transform(df.withColumn("_k_vec", array_to_vector("features")))
    cost = float(model.summary.trainingCost)
    return pred.groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).withColumn("cost", F.lit(cost))


# ---------------------------------------------------------------- F3-F5 graphs

def supply_edges(spark, sf_dir):
    """Supplier-part graph: vertex ids 2*suppkey+1 (suppliers), 2*partkey (parts)."""
    li = read_table(spark, sf_dir, "lineitem")
    pairs = li.select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"))
    return dealt(pairs, li.count(), "src", "dst").distinct()


def weighted_edges(li):
    """The same pairs weighted by line counts."""
    pairs = li.select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"))
    return (dealt(pairs, li.count(), "src", "dst").groupBy("src", "dst")
            .agg(F.count(F.lit(1)).cast("double").alias("weight")))


def edges_by_part(li):
    """The weighted pairs with those of a part together.  Every step of the
    fit sends a vertex's value to, and a sum from, each partition that holds
    an edge of it: a part then has one such partition, instead of nearly as
    many as it has suppliers."""
    pairs = li.select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst"))
    pairs, salt = dealt_by_one(pairs, "dst", "src")
    return pairs.groupBy("src", "dst", *salt).agg(F.count(F.lit(1)).cast("double").alias("weight")).drop(*salt)


@register("pic_clusters")
def q_pic_clusters(spark, sf_dir):
    """Power-iteration clustering (k = 2) of the supplier-part graph weighted
    by line counts."""
    # written once: the fit's graphs go back to it, not to the line items
    w = store(edges_by_part(read_table(spark, sf_dir, "lineitem")), "pic-edges")
    pic = PowerIterationClustering(k=2, maxIter=10, weightCol="weight", initMode="degree")
    with whole_files(spark):
        return pic.assignClusters(w).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


PIC_STEPS, PIC_ROUNDS = 6, 20


def _pic_sql() -> str:
    """The steps, then the rounds of k-means on the line, unrolled."""
    parts = ["""e AS (SELECT l_suppkey * 2 + 1 AS a, l_partkey * 2 AS b, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2)""",
             "l AS (SELECT a AS src, b AS dst, w FROM e UNION ALL SELECT b, a, w FROM e)",
             "d AS (SELECT src, sum(w) AS v FROM l GROUP BY src)",
             "v0 AS (SELECT src, v / (SELECT sum(v) FROM d) AS x FROM d)"]
    for i in range(PIC_STEPS):
        parts.append(f"r{i} AS (SELECT dst AS src, sum(w * x) / any_value(d.v) AS x FROM l JOIN v{i} USING (src) "
                     f"JOIN d ON d.src = l.dst GROUP BY dst)")
        parts.append(f"v{i + 1} AS MATERIALIZED (SELECT src, x / (SELECT sum(abs(x)) FROM r{i}) AS x FROM r{i})")
    parts.append(f"""c0 AS (SELECT min(x) + (max(x) - min(x)) * 0.25 AS p, min(x) + (max(x) - min(x)) * 0.75 AS q FROM v{PIC_STEPS})""")
    for i in range(PIC_ROUNDS):
        low = "abs(x - p) <= abs(x - q)"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT coalesce(avg(x) FILTER ({low}), any_value(p)) AS p, "
                     f"coalesce(avg(x) FILTER (NOT {low}), any_value(q)) AS q FROM v{PIC_STEPS}, c{i})")
    return ("WITH " + ",\n".join(parts) + f"""
SELECT CASE WHEN abs(x - p) <= abs(x - q) THEN 0 ELSE 1 END AS cluster, count(*) AS n
FROM v{PIC_STEPS}, c{PIC_ROUNDS} GROUP BY 1""")


@register("pic_steps", _pic_sql())
def q_pic_steps(spark, sf_dir):
    """Power iteration clustering (k = 2) of the same graph on its own
    layout, at a fixed number of steps: cluster sizes."""
    li = read_table(spark, sf_dir, "lineitem")
    w = weighted_edges(li)
    with sized_shuffles(spark, 2 * li.count()):  # both directions
        found = pic.power_clusters(w, 2, max_steps=PIC_STEPS, stop=None, rounds=PIC_ROUNDS)
    return found.assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("pagerank_k", """
WITH e0 AS (SELECT DISTINCT l_suppkey * 2 + 1 AS a, l_partkey * 2 AS b FROM lineitem),
     e AS (SELECT a AS src, b AS dst FROM e0 UNION SELECT b AS src, a AS dst FROM e0),
     nodes AS (SELECT DISTINCT src AS node FROM e UNION SELECT DISTINCT dst FROM e),
     n AS (SELECT count(*) AS n FROM nodes),
     deg AS (SELECT src, count(*) AS d FROM e GROUP BY src),
     w AS (SELECT e.src, e.dst, 1.0 / deg.d AS w FROM e JOIN deg USING (src)),
     r0 AS (SELECT node, 1.0 / n.n AS rank FROM nodes, n),
     c1 AS (SELECT w.dst AS node, sum(r0.rank * w.w) AS s FROM w JOIN r0 ON w.src = r0.node GROUP BY 1),
     r1 AS (SELECT nodes.node, 0.15 / n.n + 0.85 * coalesce(c1.s, 0.0) AS rank FROM nodes CROSS JOIN n
            LEFT JOIN c1 ON nodes.node = c1.node),
     c2 AS (SELECT w.dst AS node, sum(r1.rank * w.w) AS s FROM w JOIN r1 ON w.src = r1.node GROUP BY 1),
     r2 AS (SELECT nodes.node, 0.15 / n.n + 0.85 * coalesce(c2.s, 0.0) AS rank FROM nodes CROSS JOIN n
            LEFT JOIN c2 ON nodes.node = c2.node),
     c3 AS (SELECT w.dst AS node, sum(r2.rank * w.w) AS s FROM w JOIN r2 ON w.src = r2.node GROUP BY 1),
     r3 AS (SELECT nodes.node, 0.15 / n.n + 0.85 * coalesce(c3.s, 0.0) AS rank FROM nodes CROSS JOIN n
            LEFT JOIN c3 ON nodes.node = c3.node)
SELECT node, round(rank * n.n, 6) AS scaled_rank FROM r3, n
""")
def q_pagerank_k(spark, sf_dir):
    """PageRank, 3 steps, damping 0.85, on the undirected supplier-part
    graph; ranks scaled by the vertex count (mean 1)."""
    e = graph.undirected(supply_edges(spark, sf_dir))
    with sized_shuffles(spark, 2 * read_table(spark, sf_dir, "lineitem").count()):  # both directions
        ranks = graph.pagerank(e, iters=3)
    n = ranks.count()
    return ranks.select("node", F.round(F.col("rank") * F.lit(n), 6).alias("scaled_rank"))


def follow_edges(spark, sf_dir):
    """Who buys from whom: distinct customer -> supplier edges."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (li.join(orders, li.l_orderkey == orders.o_orderkey)
            .select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct())


@register("graph_degrees", """
WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
     od AS (SELECT src, count(*) AS d FROM e GROUP BY src),
     id AS (SELECT dst, count(*) AS d FROM e GROUP BY dst)
SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, CAST(coalesce(od.d, 0) AS BIGINT) AS degree
FROM customer LEFT JOIN od ON c_custkey = od.src
UNION ALL
SELECT 'supplier' AS kind, s_suppkey AS id, s_name AS name, CAST(coalesce(id.d, 0) AS BIGINT) AS degree
FROM supplier LEFT JOIN id ON s_suppkey = id.dst
""")
def q_graph_degrees(spark, sf_dir):
    """Buyer graph joined to its user dimensions: out-degree of every
    customer, in-degree of every supplier (0 when isolated)."""
    deg = graph.degrees(follow_edges(spark, sf_dir))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    c = (cust.join(deg.select(F.col("node").alias("c_custkey"), "out_degree"), "c_custkey", "left")
         .select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                 F.coalesce("out_degree", F.lit(0)).cast("bigint").alias("degree")))
    s = (supp.join(deg.select(F.col("node").alias("s_suppkey"), "in_degree"), "s_suppkey", "left")
         .select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                 F.coalesce("in_degree", F.lit(0)).cast("bigint").alias("degree")))
    return c.unionByName(s)


@register("connected_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst FROM lineitem),
     u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
     cc(node, comp) USING KEY (node) AS (
         SELECT DISTINCT src AS node, src AS comp FROM u
         UNION
         (SELECT u.dst AS node, min(cc.comp) AS comp
          FROM cc JOIN u ON u.src = cc.node JOIN recurring.cc AS cur ON cur.node = u.dst
          GROUP BY u.dst, cur.comp
          HAVING min(cc.comp) < cur.comp))
SELECT comp AS component, count(*) AS n FROM cc GROUP BY comp
""")
def q_connected_components(spark, sf_dir):
    """Components of the supplier-part graph (star rounds): sizes."""
    comp = graph.connected_components(supply_edges(spark, sf_dir))
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- F6 itemsets

MIN_SUPPORT = 0.02


def brand_baskets(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return itemsets.baskets(li.join(part, li.l_partkey == part.p_partkey), "l_orderkey", "p_brand")


@register("fpgrowth_itemsets", f"""
WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
     n AS (SELECT ceil({MIN_SUPPORT} * count(DISTINCT l_orderkey)) AS m FROM b),
     s1 AS (SELECT p_brand AS items, 1 AS size, count(*) AS freq FROM b GROUP BY 1),
     s2 AS (SELECT x.p_brand || ',' || y.p_brand AS items, 2 AS size, count(*) AS freq
            FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1),
     s3 AS (SELECT x.p_brand || ',' || y.p_brand || ',' || z.p_brand AS items, 3 AS size, count(*) AS freq
            FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand
                     JOIN b z ON z.l_orderkey = x.l_orderkey AND y.p_brand < z.p_brand GROUP BY 1)
SELECT items, size, freq FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), n
WHERE freq >= n.m
""")
def q_fpgrowth_itemsets(spark, sf_dir):
    """FP-growth over per-order brand baskets (min support 2 %)."""
    model = itemsets.frequent_itemsets(brand_baskets(spark, sf_dir), MIN_SUPPORT)
    fi = model.freqItemsets
    return fi.select(itemsets.itemset_key("items").alias("items"), F.size("items").alias("size"), "freq")


@register("association_rules", f"""
WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
     tot AS (SELECT count(DISTINCT l_orderkey) AS n, ceil({MIN_SUPPORT} * count(DISTINCT l_orderkey)) AS m FROM b),
     f1 AS (SELECT p_brand AS a, count(*) AS freq FROM b GROUP BY 1 HAVING count(*) >= (SELECT m FROM tot)),
     f2 AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS freq
            FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand
            GROUP BY 1, 2 HAVING count(*) >= (SELECT m FROM tot)),
     f3 AS (SELECT x.p_brand AS a, y.p_brand AS b, z.p_brand AS c, count(*) AS freq
            FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand
                     JOIN b z ON z.l_orderkey = x.l_orderkey AND y.p_brand < z.p_brand
            GROUP BY 1, 2, 3 HAVING count(*) >= (SELECT m FROM tot)),
     r AS (SELECT f2.a AS antecedent, f2.b AS consequent, f2.freq AS f, f1.freq AS fa FROM f2 JOIN f1 ON f1.a = f2.a
           UNION ALL SELECT f2.b, f2.a, f2.freq, f1.freq FROM f2 JOIN f1 ON f1.a = f2.b
           UNION ALL SELECT f3.a || ',' || f3.b, f3.c, f3.freq, p.freq FROM f3 JOIN f2 p ON p.a = f3.a AND p.b = f3.b
           UNION ALL SELECT f3.a || ',' || f3.c, f3.b, f3.freq, p.freq FROM f3 JOIN f2 p ON p.a = f3.a AND p.b = f3.c
           UNION ALL SELECT f3.b || ',' || f3.c, f3.a, f3.freq, p.freq FROM f3 JOIN f2 p ON p.a = f3.b AND p.b = f3.c)
SELECT antecedent, consequent, round(f / fa, 6) AS confidence,
       round((f / fa) / (fc.freq / tot.n), 6) AS lift, round(f / tot.n, 6) AS support
FROM r JOIN f1 fc ON fc.a = r.consequent, tot
WHERE f / fa >= 0.1
""")
def q_association_rules(spark, sf_dir):
    """Rules from the same FP-growth model (confidence >= 0.1); the
    antecedent is written in sorted item order."""
    model = itemsets.frequent_itemsets(brand_baskets(spark, sf_dir), MIN_SUPPORT, min_confidence=0.1)
    return model.associationRules.select(itemsets.itemset_key("antecedent").alias("antecedent"),
                                         F.array_join("consequent", ",").alias("consequent"),
                                         F.round("confidence", 6).alias("confidence"),
                                         F.round("lift", 6).alias("lift"), F.round("support", 6).alias("support"))


# ---------------------------------------------------------------- F7 isotonic

# The isotonic fit at the i-th distinct x is max over j <= i of min over
# k >= i of mean(y over x_j .. x_k) (prefix sums over distinct x, a suffix
# minimum per j); a pooled block keeps both end points as boundaries, a
# single point one.  Fits of one block computed from different (j, k) pairs
# agree to rounding, hence the relative tolerance when finding blocks.
ISOTONIC_SQL = f"""
WITH d AS (SELECT CAST({SQL_X} AS DOUBLE) AS x, CAST({SQL_Y} AS DOUBLE) AS y FROM documents),
     u AS (SELECT x, sum(y) AS sy, count(*) AS w FROM d GROUP BY x),
     o AS (SELECT x, sy, w, row_number() OVER (ORDER BY x) AS i,
                  sum(sy) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM u),
     pr AS (SELECT a.i AS j, b.i AS k, (b.cs - a.cs + a.sy) / (b.cw - a.cw + a.w) AS m
            FROM o a JOIN o b ON b.i >= a.i),
     sm AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM pr),
     f AS (SELECT k AS i, max(s) AS fit FROM sm GROUP BY k),
     g AS (SELECT o.i, o.x, f.fit,
                  CASE WHEN abs(lag(f.fit) OVER (ORDER BY o.i) - f.fit) <= 1e-9 * greatest(1.0, abs(f.fit))
                       THEN 0 ELSE 1 END AS starts
           FROM o JOIN f USING (i)),
     b AS (SELECT i, sum(starts) OVER (ORDER BY i) AS blk FROM g),
     bs AS (SELECT blk, count(*) AS c FROM b GROUP BY blk)
SELECT (SELECT CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 2 END) AS INTEGER) FROM bs) AS n_boundaries,
       (SELECT round(avg((d.y - g.fit) * (d.y - g.fit)), 6) FROM d JOIN g ON d.x = g.x) AS mse
"""


@register("isotonic_fit", ISOTONIC_SQL)
def q_isotonic_fit(spark, sf_dir):
    """Isotonic regression of document length on word count: boundaries and
    fit quality."""
    from kiln.plans.training import doc_features
    d = doc_features(spark, sf_dir).select("words", array_to_vector(F.array("words")).alias("features"),
                                           F.col("target").alias("label"))
    # one weighted point for each distinct x before the fit: what the fit
    # pools on the driver is bounded by the distinct word counts
    points = d.groupBy("words").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    points = points.select(array_to_vector(F.array("words")).alias("features"), "label", "w")
    model = IsotonicRegression(weightCol="w").fit(points)
    pred = model.transform(d)
    m = pred.agg(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("mse")).first()
    return spark.createDataFrame([(len(model.boundaries), round(float(m["mse"]), 6))], "n_boundaries int, mse double")


ISOTONIC_BLOCKS_SQL = ISOTONIC_SQL[:ISOTONIC_SQL.index("     bs AS (")].rstrip().rstrip(",") + """
SELECT min(x) AS x_lo, max(x) AS x_hi, CAST(sum(w) AS BIGINT) AS n, round(sum(sy) / sum(w), 6) AS value
FROM b JOIN o USING (i) GROUP BY blk
"""


@register("isotonic_blocks", ISOTONIC_BLOCKS_SQL)
def q_isotonic_blocks(spark, sf_dir):
    """The blocks of that fit from hulls of prefix sums, joined range by
    range: span of word counts, documents, level."""
    from kiln.plans.training import doc_features
    blocks = isotonic.isotonic_blocks(doc_features(spark, sf_dir), "words", "target")
    return blocks.select("x_lo", "x_hi", F.round("weight").cast("long").alias("n"), F.round("value", 6).alias("value"))


# ---------------------------------------------------------------- F8 terms and topics

@register("term_counts", f"""
WITH t AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_total FROM t WHERE term <> '' GROUP BY term
""")
def q_term_counts(spark, sf_dir):
    """Document frequency and total count of every term of every whole document."""
    return text.term_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def topic_model(docs):
    """CountVectorizer + LDA (k = 5, 5 iterations) over every document and
    term, no vocabulary cap: ``(vocabulary, model)``.  Expectation
    maximisation reads every document in every iteration (the online
    optimizer draws its minibatch with replacement, whatever the rate)."""
    cv = CountVectorizer(inputCol="tokens", outputCol="counts", vocabSize=1 << 30, minDF=1.0).fit(docs)
    lda = LDA(k=5, maxIter=5, featuresCol="counts", seed=SEED, optimizer="em")
    return cv.vocabulary, lda.fit(cv.transform(docs))


def lda_model(spark, sf_dir):
    return topics.lda(read_table(spark, sf_dir, "documents"), "doc_id", "text", k=5, iterations=5, seed=SEED)


@register("lda_topics")
def q_lda_topics(spark, sf_dir):
    """Variational topics of every document and term: top 5 terms per topic."""
    return lda_model(spark, sf_dir).top_terms(5).select(
        F.col("topic").cast("int").alias("topic"), "terms", F.col("weights").alias("termWeights"))


@register("lda_bound")
def q_lda_bound(spark, sf_dir):
    """The likelihood bound of every iteration over all documents."""
    bounds = lda_model(spark, sf_dir).bounds
    return spark.createDataFrame(list(enumerate(bounds, 1)), "iteration int, bound double")


# ---------------------------------------------------------------- F11 sentiment

def toxic_lexicon(spark, sf_dir):
    return text.derive_lexicon(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SENTIMENT_SQL = f"""
WITH lab AS (SELECT d.doc_id, d.text, l.toxic AS flag FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
     tot AS (SELECT sum(flag) AS n_pos, count(*) - sum(flag) AS n_neg FROM lab),
     pres AS (SELECT DISTINCT doc_id, flag, term
              FROM (SELECT doc_id, flag, unnest({TOKEN_SQL}) AS term FROM lab) WHERE term <> ''),
     st AS (SELECT term, sum(flag) AS pos, count(*) AS df FROM pres GROUP BY term),
     lex AS (SELECT term, greatest(-5, least(5, CAST(round(ln(((pos + 1) / (df - pos + 1))
                                                            * ((tot.n_neg + 1) / (tot.n_pos + 1)))) AS INTEGER))) AS score
             FROM st, tot WHERE df >= 3),
     toks AS (SELECT doc_id, unnest({TOKEN_SQL}) AS term FROM documents),
     hits AS (SELECT doc_id, sum(score) AS s, count(*) AS m FROM toks JOIN lex USING (term)
              WHERE score <> 0 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(h.s, 0) AS BIGINT) AS score, CAST(coalesce(h.m, 0) AS BIGINT) AS n_matched
FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id
"""


@register("sentiment_score", SENTIMENT_SQL)
def q_sentiment_score(spark, sf_dir):
    """Lexicon scoring of every whole document; the lexicon (word -> integer
    score in -5..5) is derived from the toxicity labels."""
    return text.score_documents(read_table(spark, sf_dir, "documents"), toxic_lexicon(spark, sf_dir))


TOKENS_SQL = r"list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda s: s <> '')"


@register("sentiment_phrases", f"""
WITH lab AS (SELECT d.doc_id, l.toxic AS flag, {TOKENS_SQL} AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
     tot AS (SELECT sum(flag) AS n_pos, count(*) - sum(flag) AS n_neg FROM lab),
     pres AS (SELECT DISTINCT doc_id, flag, term
              FROM (SELECT doc_id, flag,
                           unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))
                           AS term FROM lab)),
     st AS (SELECT term, sum(flag) AS pos, count(*) AS df FROM pres GROUP BY term),
     lex AS (SELECT term AS key, greatest(-5, least(5, CAST(round(ln(((pos + 1) / (df - pos + 1))
                                                            * ((tot.n_neg + 1) / (tot.n_pos + 1)))) AS INTEGER))) AS score
             FROM st, tot WHERE df >= 3),
     toks AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
     grams AS (SELECT doc_id, g.pos AS pos, g.n AS n, g.key AS key
               FROM (SELECT doc_id, unnest(list_concat(
                         list_transform(range(1, len(t) + 1), lambda i: {{'pos': i, 'n': 1, 'key': t[i]}}),
                         list_transform(range(1, len(t)), lambda i: {{'pos': i, 'n': 2, 'key': t[i] || ' ' || t[i + 1]}})))
                         AS g FROM toks)),
     hits AS (SELECT doc_id, list({{'pos': pos, 'n': n, 'score': score}} ORDER BY pos, n DESC) AS m
              FROM grams JOIN lex USING (key) WHERE score <> 0 GROUP BY doc_id),
     walk AS (SELECT doc_id,
                     list_reduce(m, lambda acc, x: CASE WHEN x.pos >= acc.nx
                                      THEN {{'nx': x.pos + x.n, 's': acc.s + x.score, 'k': acc.k + 1}} ELSE acc END,
                                 {{'nx': 0::BIGINT, 's': 0::BIGINT, 'k': 0::BIGINT}}) AS w
              FROM hits)
SELECT d.doc_id, CAST(coalesce(w.w.s, 0) AS BIGINT) AS score, CAST(coalesce(w.w.k, 0) AS BIGINT) AS n_matched
FROM documents d LEFT JOIN walk w ON d.doc_id = w.doc_id
""")
def q_sentiment_phrases(spark, sf_dir):
    """Lexicon scoring with phrases: words and two-word phrases scored from
    the toxicity labels; every whole document read left to right, the
    longest entry at each token matched and its tokens consumed."""
    docs = read_table(spark, sf_dir, "documents")
    lexicon = text.derive_lexicon(docs, read_table(spark, sf_dir, "labels"), max_words=2)
    return text.score_documents(docs, lexicon)


STREAM_FILE_BYTES = 64 << 20  # of text, that one task writes and reads


@register("sentiment_stream", SENTIMENT_SQL)  # the stream must equal the batch job
def q_sentiment_stream(spark, sf_dir):
    """The same scoring as a Structured Streaming job over document files
    (availableNow trigger, idempotent sink): four micro-batches of a file
    each, or of as many as keep a file at STREAM_FILE_BYTES of text."""
    from kiln.streaming.sentiment import run_sentiment_stream
    src = scratch_path(spark, "docstream")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // (4 * STREAM_FILE_BYTES)))  # of a micro-batch
    docs.repartitionByRange(4 * files, "doc_id").write.mode("overwrite").parquet(src)
    out = run_sentiment_stream(spark, src, docs.schema, toxic_lexicon(spark, sf_dir),
                               scratch_path(spark, "docsink"), scratch_path(spark, "docckpt"), files_per_trigger=files)
    return out.select("doc_id", "score", "n_matched")


# ---------------------------------------------------------------- F10 streaming k-means

@register("stream_kmeans")
def q_stream_kmeans(spark, sf_dir):
    """Mini-batch k-means (k = 10, decay 0.9) over embedding files arriving
    one per micro-batch; starts from 10 points of the seeded order."""
    from kiln.operators.sampling import with_shuffle_key
    from kiln.streaming.kmeans import StreamingKMeans
    import numpy as np

    src = scratch_path(spark, "pointstream")
    pts = image_table(spark, sf_dir).select("id", F.col("features").cast("array<double>").alias("features"))
    pts.repartitionByRange(4, "id").write.mode("overwrite").parquet(src)
    init = with_shuffle_key(pts, SEED, "id", "k").orderBy("k", "id").limit(10).select("features").collect()
    job = StreamingKMeans(np.array([r["features"] for r in init]), decay=0.9)
    return job.run(spark, src, pts.schema, scratch_path(spark, "kmstate"), scratch_path(spark, "kmckpt"))


# ---------------------------------------------------------------- F12 multi-class

@register("class_counts", """
SELECT CAST(label AS DOUBLE) AS label, count(*) AS n FROM embeddings GROUP BY 1
""")
def q_class_counts(spark, sf_dir):
    return (image_table(spark, sf_dir).groupBy(F.col("label").cast("double").alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


@register("multiclass_fit")
def q_multiclass_fit(spark, sf_dir):
    """Multinomial logistic regression on the 10-class vectors: iterations,
    training accuracy, per-class recall."""
    df = image_table(spark, sf_dir).select(F.col("label").cast("double").alias("label"),
                                           array_to_vector("features").alias("features"))
    model = LogisticRegression(family="multinomial", maxIter=20, regParam=0.01).fit(df)
    pred = model.transform(df)
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(pred)
    return (pred.groupBy("label").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("recall"))
            .withColumn("accuracy", F.lit(acc))
            .withColumn("iterations", F.lit(model.summary.totalIterations)))
