"""recommendation of items a user does not have."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import mips, recommend
from kiln.plans.constants import SEED
from kiln.plans.extras import purchase_ratings
from kiln.plans.registry import register
from kiln.sources import read_table

TOP = 10


def affinity_factors(spark, sf_dir):
    """(users, items, bought) with whole-number factors over the brands: what
    a customer bought of each brand, and a part's sales in its own brand's
    place.  Their product is brand affinity times popularity."""
    bought = purchase_ratings(spark, sf_dir).select("user", "item", "rating").persist()
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))
    brands = sorted(r["brand"] for r in part.select("brand").distinct().collect() if r["brand"] is not None)
    lines = bought.join(part, "item")
    users = lines.groupBy("user").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("brand") == b, F.col("rating"))), F.lit(0)).cast("double")
        for b in brands]).alias("vec"))
    sales = lines.groupBy("item", "brand").agg(F.sum("rating").cast("double").alias("sales"))
    items = sales.select("item", F.array(*[F.when(F.col("brand") == b, F.col("sales")).otherwise(F.lit(0.0))
                                           for b in brands]).alias("vec"))
    return users, items, bought


@register("recommend_unseen", f"""
WITH b AS (SELECT o_custkey AS "user", l_partkey AS item, count(*) AS n
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
     lines AS (SELECT b.*, p_brand FROM b JOIN part ON p_partkey = item),
     affinity AS (SELECT "user", p_brand, sum(n) AS a FROM lines GROUP BY 1, 2),
     sales AS (SELECT item, p_brand, sum(n) AS s FROM lines GROUP BY 1, 2),
     scored AS (SELECT u."user", sales.item, CAST(coalesce(a, 0) * s AS DOUBLE) AS score
                FROM (SELECT DISTINCT "user" FROM lines) u CROSS JOIN sales
                LEFT JOIN affinity f ON f."user" = u."user" AND f.p_brand = sales.p_brand
                WHERE NOT EXISTS (SELECT 1 FROM b WHERE b."user" = u."user" AND b.item = sales.item))
SELECT "user", CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank, item, score
FROM scored QUALIFY rank <= {TOP}
""")
def q_recommend_unseen(spark, sf_dir):
    """Per customer the 10 parts not bought with the most sales weighted by
    what the customer buys of their brand."""
    users, items, bought = affinity_factors(spark, sf_dir)
    out = mips.top_unseen(users, items, bought, TOP)
    bought.unpersist()
    return out


@register("als_recommend_unseen")
def q_als_recommend_unseen(spark, sf_dir):
    """ALS (rank 8) on customer x part purchase counts: per customer the 10
    parts not bought with the best predicted rating."""
    ratings = purchase_ratings(spark, sf_dir).persist()
    model = recommend.als_fit(ratings, rank=8, max_iter=5, seed=SEED)
    users = model.userFactors.select(F.col("id").cast("long").alias("user"), F.col("features").alias("vec"))
    items = model.itemFactors.select(F.col("id").cast("long").alias("item"), F.col("features").alias("vec"))
    out = mips.top_unseen(users, items, ratings, TOP)
    ratings.unpersist()
    return out
