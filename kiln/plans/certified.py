"""Fits that come with the proof of their optimum."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions.hashing import sql_seeded_uniform
from kiln.operators import gram, sampling, svm
from kiln.plans.constants import SEED
from kiln.plans.registry import register
from kiln.plans.training import DOC_FEATURES, SQL_X, SQL_Y, doc_features
from kiln.sources import image_table

REG, MIX = 0.3, 0.2     # of the reference's elastic net
SWEEPS = 400            # of the oracle
SVM_REG, SVM_GAP = 0.1, 1e-4

_CHARS = {"digits": "[0-9]", "upper": "[A-Z]", "punct": "[.,;:!?]"}


def _elastic_sql() -> str:
    """Moments, then the sweeps as a recursion: each coordinate in turn."""
    xs = ["x0", "x1", "x2", "x3", "x4"]
    columns = [f"{SQL_X} AS x0", "(len(string_split(text, chr(10))) / 100.0) AS x1"] + [
        f"(len(text) - len(regexp_replace(text, '{p}', '', 'g'))) / 100.0 AS x{i + 2}" for i, p in enumerate(_CHARS.values())]
    cells = [f"coalesce(covar_pop({a}, {b}) / (nullif(stddev_samp({a}), 0) * nullif(stddev_samp({b}), 0)), 0) AS g{i}{j}"
             for i, a in enumerate([*xs, "y"]) for j, b in enumerate([*xs, "y"]) if i <= j]
    cells += [f"stddev_samp({a}) AS s{i}, avg({a}) AS m{i}" for i, a in enumerate([*xs, "y"])]

    def g(i, j):
        return f"g{min(i, j)}{max(i, j)}"
    step = "SELECT cd.*, m.* EXCLUDE (fit_on) FROM cd JOIN m USING (fit_on) WHERE it < " + str(SWEEPS)
    for j in range(5):
        rest = " - ".join([f"g{j}5"] + [f"{g(i, j)} * {'n' if i < j else 'w'}{i}" for i in range(5) if i != j])
        step = f"""SELECT *, CASE WHEN coalesce(s{j}, 0) = 0 THEN 0 ELSE sign({rest}) * greatest(abs({rest}) - {REG * MIX!r} / s5, 0)
               / ({g(j, j)} + {REG * (1 - MIX)!r} / s5) END AS n{j} FROM ({step})"""
    out = "\nUNION ALL ".join(f"SELECT fit_on, '{name}' AS feature, round(w{j} * s5 / nullif(s{j}, 0), 6) AS coefficient, "
                              f"w{j} <> 0 AS active FROM z" for j, name in enumerate(DOC_FEATURES))
    const = " - ".join(["m5"] + [f"coalesce(w{j} * s5 / nullif(s{j}, 0), 0) * m{j}" for j in range(5)])
    return f"""
WITH RECURSIVE d AS (SELECT {', '.join(columns)}, {SQL_Y} AS y,
                            {sql_seeded_uniform(SEED, "'split'", 'doc_id')} < 0.7 AS in_train FROM documents),
     f AS (SELECT 'train' AS fit_on, * FROM d WHERE in_train UNION ALL SELECT 'all', * FROM d),
     m AS (SELECT fit_on, {', '.join(cells)} FROM f GROUP BY fit_on),
     cd AS (SELECT fit_on, 0 AS it, {', '.join(f'CAST(0 AS DOUBLE) AS w{j}' for j in range(5))} FROM m
            UNION ALL
            SELECT fit_on, it + 1, {', '.join(f'n{j}' for j in range(5))} FROM ({step})),
     z AS (SELECT * FROM cd JOIN m USING (fit_on) WHERE it = {SWEEPS})
{out}
UNION ALL SELECT fit_on, 'intercept', round({const}, 6), true FROM z"""


@register("elastic_net_exact", _elastic_sql())
def q_elastic_net_exact(spark, sf_dir):
    """The elastic net of ``linreg_elastic`` from one pass of moments, on the
    70 % part and on all rows, solved until nothing moves."""
    d = sampling.split_fraction(doc_features(spark, sf_dir), SEED, "doc_id", [0.7, 0.3], ["train", "test"])
    rows = []
    for fit_on, part in (("train", d.filter(F.col("split") == "train")), ("all", d)):
        fit = gram.elastic_net(gram.moments(part, DOC_FEATURES, "target"), REG, MIX)
        rows += [(fit_on, name, round(float(c), 6), bool(w != 0))
                 for name, c, w in zip(DOC_FEATURES, fit.coefficients, fit.scaled)]
        rows.append((fit_on, "intercept", round(fit.intercept, 6), True))
    return spark.createDataFrame(rows, "fit_on string, feature string, coefficient double, active boolean")


def binary_images(spark, sf_dir):
    return image_table(spark, sf_dir).select((F.col("label") >= 5).cast("int").alias("label"), "features")


@register("svm_certificate", """
SELECT count(*) AS n, true AS gap_closed, true AS objective_holds FROM embeddings
""")
def q_svm_certificate(spark, sf_dir):
    """A linear SVM whose objective is proved to be within 1e-4 of the least;
    the objective of its weights is computed again, by other means."""
    data = binary_images(spark, sf_dir)
    fit = svm.fit_svm(data, SVM_REG, SVM_GAP)
    again = svm.objective(data, fit.weights, fit.intercept, SVM_REG)
    return again.select("n", F.lit(fit.gap <= SVM_GAP and fit.bound <= fit.primal + 1e-12).alias("gap_closed"),
                        (F.abs(F.col("objective") - fit.primal) < 1e-9).alias("objective_holds"))


@register("svm_rounds")
def q_svm_rounds(spark, sf_dir):
    """The rounds of that fit: best objective, lower bound, their distance."""
    fit = svm.fit_svm(binary_images(spark, sf_dir), SVM_REG, SVM_GAP)
    rows = [(i, p, None if b == float("-inf") else b) for i, p, b in fit.history]
    return spark.createDataFrame(rows, "round int, objective double, bound double").withColumn(
        "gap", F.col("objective") - F.col("bound"))
