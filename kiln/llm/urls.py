"""URL filters: host and path rules, and gradient-boosted trees on lexical
features for the urls that no rule fits.

Only DataFrame functions and Spark ML run here.  The urls that a rule judges
are the labelled ones: the trees learn from them (at most about MAX_TRAIN
distinct urls, of each verdict by itself, chosen by hash).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.registry import register
from kiln.llm.tables import join_counted, written

# (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]
MAX_RULES = 500        # the rules are one expression
MAX_TRAIN = 50_000
BROADCAST_SUFFIXES = 20_000  # more distinct host suffixes than these are joined by suffix
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _AZ, _az)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _count(url: Column, pattern: str) -> Column:
    return F.length(url) - F.length(F.regexp_replace(url, pattern, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the url's letters alone."""
    u = F.coalesce(url, F.lit(""))
    size = F.greatest(F.length(u), F.lit(1))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    chars = F.split(u, "")
    entropy = F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda a, c: F.when(F.length(c) == 0, a).otherwise(
            a - ((size - F.length(F.replace(u, c, F.lit("")))) / size)
            * F.log2((size - F.length(F.replace(u, c, F.lit("")))) / size)))
    return {
        "f_length": F.length(u), "f_host_length": F.length(host), "f_path_length": F.length(path),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)),
        "f_labels": F.size(F.split(host, r"\.")),
        "f_digits": _count(u, "[0-9]") / size, "f_host_digits": _count(host, "[0-9]"),
        "f_hyphens": _count(host, "-"), "f_marks": _count(u, r"[^A-Za-z0-9/:.]") / size,
        "f_entropy": entropy,
        "f_params": F.when(F.length(query) == 0, 0).otherwise(F.size(F.split(query, "&"))),
        "f_fragment": F.when(u.contains("#"), 1).otherwise(0),
        "f_secure": F.when(u.startswith("https"), 1).otherwise(0),
        "f_longest": F.array_max(F.transform(F.split(host, r"\."), lambda s: F.length(s))),
    }


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """``(suffix, pages, f_suffix_n, f_suffix_hosts)`` over all pages: how
    common a host suffix is and how many hosts share it."""
    return written(
        rows.groupBy("suffix", "host").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("suffix").agg(F.sum("n").alias("pages"), F.log1p(F.sum("n")).alias("f_suffix_n"),
                               F.log1p(F.count(F.lit(1))).alias("f_suffix_hosts")), "suffixes")


def with_suffix(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``rows`` with the statistics of their suffix; ``stats`` has them all."""
    found = stats.agg(F.count(F.lit(1)).alias("k"), F.sum("pages").alias("n")).first()
    if found["k"] <= BROADCAST_SUFFIXES:
        return rows.join(F.broadcast(stats.drop("pages")), "suffix")
    return join_counted(rows, stats, ["suffix"], "pages", found["n"]).drop("pages")


def fit_trees(judged: DataFrame, features: VectorAssembler, max_train: int):
    """Trees on the judged urls, both verdicts weighing the same; None when
    a verdict is missing.  Beyond ``max_train`` urls each verdict is sampled
    by itself: half of them, and what the other leaves free."""
    ruled = judged.filter(F.col("verdict").isNotNull()).dropDuplicates(["url"])
    found = {r["verdict"]: r["n"] for r in ruled.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(found.values())
    if n > max_train:
        rare = min(found, key=found.get)
        room = {v: max_train - min(found[rare], max_train // 2) for v in found}
        room[rare] = max_train // 2 if len(found) > 1 else max_train
        bound = F.create_map(*[F.lit(x) for v in found for x in (v, int(min(1.0, room[v] / found[v]) * 2**32))])
        ruled = ruled.filter(F.pmod(F.xxhash64("url"), F.lit(2**32)) < bound[F.col("verdict")])
    train = written(ruled.withColumn("label", (F.col("verdict") == "block").cast("double")), "judged")
    classes = train.agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not classes["n"] or classes["b"] in (0, classes["n"]):
        return None
    share = classes["b"] / classes["n"]
    weighed = train.withColumn("w", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    return GBTClassifier(featuresCol="f", labelCol="label", weightCol="w", maxIter=10, maxDepth=3, seed=7).fit(
        features.transform(weighed).select("f", "label", "w"))


def judge(pages: DataFrame, id_col="page_id", url_col="url", rules=RULES, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score`` (the
    trees' probability of block; null where a rule decides).

    A null url, or one without ``://``, has empty host and path, fits no rule
    and is judged by its letters like any other.  Repeated urls get equal
    verdicts and are learnt from once.  Without urls of both verdicts there
    is nothing to learn: the rest is allowed.  Other columns are not read.
    An empty table gives no rows."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    base = base.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    lex = lexical(F.col("url"), F.col("host"), F.col("path"))
    rows = base.select("*", rule.alias("rule"), verdict.alias("verdict"), _suffix(F.col("host")).alias("suffix"),
                       *[c.cast("double").alias(k) for k, c in lex.items()])
    rows = with_suffix(rows, suffix_statistics(rows))
    features = VectorAssembler(inputCols=[*lex, "f_suffix_n", "f_suffix_hosts"], outputCol="f")
    trees = fit_trees(rows, features, max_train)
    if trees is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("score"))
    scored = trees.transform(features.transform(rows)).withColumn("p", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", "rule",
                         F.coalesce("verdict", F.when(F.col("p") >= 0.5, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("p")).alias("score"))


@register("op9_url_filter")
def op9_url_filter(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))
