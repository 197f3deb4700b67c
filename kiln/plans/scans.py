"""File round trips (write what Spark derives from the tables,
read it back through the source under test)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import arrays
from kiln.session import scratch_path
from kiln.sources import files, read_table
from kiln.plans.registry import register


@register("scan_csv", """
SELECT l_orderkey AS _c0, l_partkey AS _c1, l_suppkey AS _c2, l_quantity AS _c3, l_extendedprice AS _c4
FROM lineitem
""")
def q_scan_csv(spark, sf_dir):
    """Headerless CSV with type inference (columns ``_c0..``)."""
    path = scratch_path(spark, "csv")
    li = read_table(spark, sf_dir, "lineitem")
    files.write_csv(li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), path)
    df = files.read_csv_inferred(spark, path)
    return df.select(*[F.col(c).cast("bigint").alias(c) for c in ("_c0", "_c1", "_c2")],
                     *[F.col(c).cast("double").alias(c) for c in ("_c3", "_c4")])


@register("scan_csv_named", """
SELECT p_partkey AS partkey, p_size AS size, p_retailprice AS retailprice FROM part
""")
def q_scan_csv_named(spark, sf_dir):
    """Headerless CSV read with assigned names and types (no inference)."""
    path = scratch_path(spark, "csvnamed")
    files.write_csv(read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), path)
    return files.read_csv_named(spark, path, ["partkey", "size", "retailprice"],
                                [T.LongType(), T.IntegerType(), T.DoubleType()])


@register("scan_libsvm", """
SELECT CAST(label AS DOUBLE) AS label, count(*) AS n,
       round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 6) AS total
FROM embeddings GROUP BY 1
""")
def q_scan_libsvm(spark, sf_dir):
    """libsvm round trip of the embeddings: per label, rows and value sum."""
    path = scratch_path(spark, "libsvm")
    emb = read_table(spark, sf_dir, "embeddings")
    files.write_libsvm(emb.select("label", "embedding"), path, "label", "embedding")
    df = files.read_libsvm(spark, path, 64)
    return (df.groupBy("label")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.sum(arrays.array_sum(vector_to_array("features"))), 6).alias("total")))


@register("libsvm_dense", """
SELECT vec_id AS id, CAST(pos AS BIGINT) AS pos, CAST(v AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
""")
def q_libsvm_dense(spark, sf_dir):
    """libsvm -> dense float32 rows.  The row key rides in the label slot so
    every element can be checked."""
    path = scratch_path(spark, "libsvmdense")
    emb = read_table(spark, sf_dir, "embeddings")
    files.write_libsvm(emb.select(F.col("vec_id").alias("label"), "embedding"), path, "label", "embedding")
    dense = files.libsvm_dense(files.read_libsvm(spark, path, 64), "features", "dense", "float32")
    return (dense.select(F.col("label").cast("bigint").alias("id"), F.posexplode("dense").alias("pos", "v"))
            .select("id", F.col("pos").cast("bigint").alias("pos"), F.col("v").cast("double").alias("value")))


@register("csv_to_array", """
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS f0, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS f1,
       CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS f2, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS f3
FROM lineitem
""")
def q_csv_to_array(spark, sf_dir):
    """Headerless CSV -> float32 matrix rows."""
    path = scratch_path(spark, "csvarray")
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    files.write_csv(read_table(spark, sf_dir, "lineitem").select(*cols), path)
    df = files.read_csv_named(spark, path, cols, [T.LongType(), T.IntegerType()] + [T.DoubleType()] * 4)
    arr = files.csv_to_array(df, cols[2:], "x", "float")
    return arr.select("l_orderkey", "l_linenumber",
                      *[F.col("x")[i].cast("double").alias(f"f{i}") for i in range(4)])


_HOST = r"^https?://([^/?#]+)"
_LANG = r"^https?://[^/?#]+/([^/?#]+)"


@register("partitioned_files", f"""
WITH p AS (
  SELECT html,
         regexp_extract(regexp_extract(url, '{_HOST}', 1), '\\.([^.]+)$', 1) AS tld,
         regexp_extract(url, '{_LANG}', 1) AS lang0
  FROM pages
)
SELECT tld, CASE WHEN lang0 = '' THEN 'none' ELSE lang0 END AS lang,
       CAST(sum(strlen(html) + 1) AS BIGINT) AS n_bytes, count(*) AS n_pages
FROM p GROUP BY 1, 2
""")
def q_partitioned_files(spark, sf_dir):
    """Pages written as text under ``tld=../lang=..`` folders, listed back
    with ``binaryFile`` partition discovery; bytes and pages per folder.
    The ``image`` source with ``dropInvalid`` drops every one of these
    non-image files (checked in pytest)."""
    path = scratch_path(spark, "pages")
    pages = read_table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", _HOST, 1)
    lang = F.regexp_extract("url", _LANG, 1)
    staged = pages.select("html", F.regexp_extract(host, r"\.([^.]+)$", 1).alias("tld"),
                          F.when(lang == "", F.lit("none")).otherwise(lang).alias("lang"))
    files.write_partitioned_text(staged, path, "html", ["tld", "lang"])
    n_pages = staged.groupBy("tld", "lang").agg(F.count(F.lit(1)).alias("n_pages"))
    listing = files.list_binary_files(spark, path)
    sizes = listing.groupBy(F.col("tld").cast("string").alias("tld"), F.col("lang").cast("string").alias("lang")) \
        .agg(F.sum("length").cast("bigint").alias("n_bytes"))
    return sizes.join(n_pages, ["tld", "lang"]).select("tld", "lang", "n_bytes", "n_pages")
