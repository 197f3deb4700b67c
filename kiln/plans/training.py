"""Training, persistence, scoring and reports."""

from __future__ import annotations

import json
import time

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kiln.functions.hashing import sql_seeded_hash32, sql_seeded_uniform
from kiln.functions.text import char_count, token_count
from kiln.models import MLP, LinearNet, SmallCNN
from kiln.operators import sampling
from kiln.operators.estimators import MinibatchModel, MinibatchTrainer
from kiln.operators.features import recode_binary
from kiln.operators.gang import train_gang
from kiln.operators.training import (WINDOW_WORK, PreparedRound, TrainConfig, assign_shards_and_batches, evaluate, history_frame,
                                     standardize_input, train, with_split)
from kiln.plans.constants import IMAGE_SIDE, MLP_B1, MLP_B2, MLP_W1, MLP_W2, SEED
from kiln.plans.registry import register
from kiln.plans.sqltext import sql_affine, sql_argmax, sql_relu
from kiln.session import scratch_path
from kiln.sources import image_table, read_table

SQL_X = "(len(string_split(text, ' ')) / 1000.0)"
SQL_Y = "(n_chars / 10000.0)"


def doc_features(spark, sf_dir):
    """Numeric text statistics of every whole document (housing-style
    table: several numeric features and one numeric target)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        (token_count("text", " ") / 1000.0).alias("words"),
        (token_count("text", "\n") / 100.0).alias("lines"),
        (char_count("text", "0123456789") / 100.0).alias("digits"),
        (char_count("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / 100.0).alias("upper"),
        (char_count("text", ".,;:!?") / 100.0).alias("punct"),
        (F.col("n_chars") / 10000.0).alias("target"))


DOC_FEATURES = ["words", "lines", "digits", "upper", "punct"]


# ---------------------------------------------------------------- T10 (exact)

def _gd_sql(steps: int, lr: float) -> str:
    ctes = [f"d AS (SELECT {SQL_X} AS x, {SQL_Y} AS y FROM documents)", "s0 AS (SELECT 0.0 AS w, 0.0 AS b)"]
    for k in range(1, steps + 1):
        p = f"s{k - 1}"
        err = f"({p}.w * d.x + {p}.b - d.y)"
        ctes.append(f"g{k} AS (SELECT avg(2 * {err} * d.x) AS gw, avg(2 * {err}) AS gb, "
                    f"avg({err} * {err}) AS loss FROM d, {p})")
        ctes.append(f"s{k} AS (SELECT {p}.w - {lr} * g{k}.gw AS w, {p}.b - {lr} * g{k}.gb AS b, "
                    f"g{k}.loss AS loss FROM {p}, g{k})")
    sel = " UNION ALL ".join(
        f"SELECT {k} AS step, round(w, 6) AS w, round(b, 6) AS b, round(loss, 6) AS loss FROM s{k}"
        for k in range(1, steps + 1))
    return "WITH " + ",\n".join(ctes) + "\n" + sel


@register("gd_linear_3steps", _gd_sql(3, 0.1))
def q_gd_linear_3steps(spark, sf_dir):
    """Three full-batch gradient steps of y = w x + b (MSE, SGD lr 0.1, zero
    start) run by the distributed loop on 4 shards."""
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.array(token_count("text", " ") / 1000.0).alias("features"),
        (F.col("n_chars") / 10000.0).alias("label"))
    cfg = TrainConfig(iters=3, partitions=4, lr=0.1, full_batch=True, feature_dtype="double",
                      storage="cache", keep_params=True, seed=SEED)
    res = train(d, LinearNet(1, 1, "regression", zero_init=True).config(), cfg, id_col="doc_id")
    rows = [(h["iter"] + 1, round(float(h["params"][0]), 6), round(float(h["params"][1]), 6),
             round(float(h["loss"]), 6)) for h in res.history]
    return spark.createDataFrame(rows, "step int, w double, b double, loss double")


# ---------------------------------------------------------------- T8 (exact)

def fixed_mlp_model() -> MinibatchModel:
    net = MLP([IMAGE_SIDE * IMAGE_SIDE, len(MLP_W1), len(MLP_W2)])
    m = MinibatchModel(modelConfig=json.dumps(net.config()), featuresCol="features", predictionCol="prediction")
    m.weights = net.pack({"W0": np.array(MLP_W1), "b0": np.array(MLP_B1),
                          "W1": np.array(MLP_W2), "b1": np.array(MLP_B2)})
    return m


@register("score_mlp", f"""
WITH h AS (SELECT vec_id, {sql_relu(sql_affine('embedding', MLP_W1, MLP_B1))} AS hidden FROM embeddings),
     s AS (SELECT vec_id, {sql_affine('hidden', MLP_W2, MLP_B2)} AS scores FROM h)
SELECT vec_id AS id, CAST({sql_argmax('scores')} AS DOUBLE) AS prediction FROM s
""")
def q_score_mlp(spark, sf_dir):
    """Batch scoring with a model object (Arrow UDF, weights
    broadcast), persisted while metrics are taken (O11)."""
    scored = fixed_mlp_model().transform(image_table(spark, sf_dir))
    return scored.select("id", "prediction")


# ---------------------------------------------------------------- T5 (exact OLS)

@register("linreg_ols", f"""
WITH d AS (SELECT {SQL_X} AS x, {SQL_Y} AS y FROM documents)
SELECT round(regr_slope(y, x), 6) AS coefficient, round(regr_intercept(y, x), 6) AS intercept,
       round(regr_r2(y, x), 6) AS r2
FROM d
""")
def q_linreg_ols(spark, sf_dir):
    d = doc_features(spark, sf_dir)
    data = VectorAssembler(inputCols=["words"], outputCol="features").transform(d)
    m = LinearRegression(featuresCol="features", labelCol="target", regParam=0.0, solver="normal").fit(data)
    return spark.createDataFrame(
        [(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6), round(float(m.summary.r2), 6))],
        "coefficient double, intercept double, r2 double")


@register("ridge_2x2", f"""
WITH d AS (SELECT {SQL_X} AS x1, (len(string_split(text, chr(10))) / 100.0) AS x2, {SQL_Y} AS y FROM documents),
     c AS (SELECT covar_pop(x1, x1) + 0.01 AS a11, covar_pop(x1, x2) AS a12, covar_pop(x2, x2) + 0.01 AS a22,
                  covar_pop(x1, y) AS r1, covar_pop(x2, y) AS r2, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my
           FROM d),
     s AS (SELECT (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS w1,
                  (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS w2, m1, m2, my FROM c)
SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(my - w1 * m1 - w2 * m2, 6) AS intercept FROM s
""")
def q_ridge_2x2(spark, sf_dir):
    """Ridge regression with intercept on two features via the normal
    equations (X'X/n + lambda I) w = X'y/n on centred data; lambda = 0.01.
    One aggregation pass computes all second moments."""
    d = doc_features(spark, sf_dir)
    lam = 0.01
    c = d.agg(F.covar_pop("words", "words").alias("s11"), F.covar_pop("words", "lines").alias("s12"),
              F.covar_pop("lines", "lines").alias("s22"), F.covar_pop("words", "target").alias("r1"),
              F.covar_pop("lines", "target").alias("r2"), F.avg("words").alias("m1"),
              F.avg("lines").alias("m2"), F.avg("target").alias("my"))
    a11, a22 = F.col("s11") + lam, F.col("s22") + lam
    det = a11 * a22 - F.col("s12") * F.col("s12")
    w1 = (a22 * F.col("r1") - F.col("s12") * F.col("r2")) / det
    w2 = (a11 * F.col("r2") - F.col("s12") * F.col("r1")) / det
    return c.select(F.round(w1, 6).alias("w1"), F.round(w2, 6).alias("w2"),
                    F.round(F.col("my") - w1 * F.col("m1") - w2 * F.col("m2"), 6).alias("intercept"))


# ---------------------------------------------------------------- R queries (Spark ML, iterative)

def elastic_net(spark, sf_dir, fit_on: str = "train"):
    """The 70/30 split of the documents and the elastic net (maxIter 100,
    regParam 0.3, elasticNetParam 0.2) fitted on ``fit_on``: "train" (the 70 %
    part) or "all".  Returns (assembled rows with ``split``, model); the rows
    are persisted, the caller releases them."""
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on is 'train' or 'all'")
    d = sampling.split_fraction(doc_features(spark, sf_dir), SEED, "doc_id", [0.7, 0.3], ["train", "test"])
    # the fit and its summary both read the assembled rows: text features once
    data = VectorAssembler(inputCols=DOC_FEATURES, outputCol="features").transform(d).persist()
    try:
        part = data if fit_on == "all" else data.filter(F.col("split") == "train")
        m = LinearRegression(featuresCol="features", labelCol="target", maxIter=100, regParam=0.3,
                             elasticNetParam=0.2).fit(part)
    except BaseException:
        data.unpersist()
        raise
    return data, m


@register("linreg_elastic")
def q_linreg_elastic(spark, sf_dir):
    """Elastic-net regression with its training report (S10), fitted on the
    70 % part and on all rows: coefficients, intercept, iterations, MSE,
    RMSE, r2, and the MSE on the 30 % part."""
    rows = []
    for fit_on in ("train", "all"):
        data, m = elastic_net(spark, sf_dir, fit_on)
        try:
            s = m.summary
            test = m.transform(data.filter(F.col("split") == "test"))
            t = test.agg(F.avg(F.pow(F.col("prediction") - F.col("target"), 2)).alias("mse")).first()
            rows.append((fit_on, [float(v) for v in m.coefficients], float(m.intercept), int(s.totalIterations),
                         float(s.meanSquaredError), float(s.rootMeanSquaredError), float(s.r2), t["mse"]))
        finally:
            data.unpersist()
    return spark.createDataFrame(
        rows, "fit_on string, coefficients array<double>, intercept double, iterations int, mse double, "
              "rmse double, r2 double, test_mse double")


@register("linreg_split", f"""
SELECT CASE WHEN {sql_seeded_uniform(SEED, "'split'", 'doc_id')} < 0.7 THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, round(avg({SQL_Y}), 6) AS mean_target
FROM documents GROUP BY 1
""")
def q_linreg_split(spark, sf_dir):
    """Rows and mean target of the regression's 70/30 split."""
    d = sampling.split_fraction(doc_features(spark, sf_dir), SEED, "doc_id", [0.7, 0.3], ["train", "test"])
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("target"), 6).alias("mean_target"))


@register("linreg_history")
def q_linreg_history(spark, sf_dir):
    """Objective history of the elastic-net fit as rows."""
    data, m = elastic_net(spark, sf_dir)
    try:
        hist = [float(v) for v in m.summary.objectiveHistory]
    finally:
        data.unpersist()
    return (spark.createDataFrame([(hist,)], "h array<double>")
            .select(F.posexplode("h").alias("iteration", "objective")))


def svm_input(spark, sf_dir):
    """The two label groups (below 5, from 5 on) under their original codes,
    recoded to 0 / 1."""
    df = image_table(spark, sf_dir)
    grouped = df.select("id", F.when(F.col("label") < 5, 1).otherwise(2).alias("label"), "features")
    return recode_binary(grouped, "label").select("id", "label", array_to_vector("features").alias("features"))


@register("label_recode", """
SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE 2 END AS code,
       CASE WHEN label < 5 THEN 0.0 ELSE 1.0 END::DOUBLE AS label
FROM embeddings
""")
def q_label_recode(spark, sf_dir):
    """Two sorted distinct labels recoded to 0 / 1."""
    df = image_table(spark, sf_dir).select("id", F.when(F.col("label") < 5, 1).otherwise(2).alias("code"))
    return recode_binary(df.withColumn("label", F.col("code")), "label").select("id", "code", "label")


@register("linear_svm")
def q_linear_svm(spark, sf_dir):
    """LinearSVC(maxIter 10, regParam 0.1) on a binary recoding of the
    labels; report of coefficients size, iterations, final objective and
    training accuracy."""
    data = svm_input(spark, sf_dir)
    m = LinearSVC(maxIter=10, regParam=0.1).fit(data)
    s = m.summary()
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(m.transform(data))
    return spark.createDataFrame(
        [(len(m.coefficients), float(m.intercept), int(s.totalIterations), float(s.objectiveHistory[-1]), acc)],
        "n_coefficients int, intercept double, iterations int, objective double, accuracy double")


@register("training_history")
def q_training_history(spark, sf_dir):
    """Objective history of the SVM fit as rows ``(iteration, objective)``."""
    m = LinearSVC(maxIter=10, regParam=0.1).fit(svm_input(spark, sf_dir))
    hist = [float(v) for v in m.summary().objectiveHistory]
    return (spark.createDataFrame([(hist,)], "h array<double>")
            .select(F.posexplode("h").alias("iteration", "objective")))


def image_pipeline(partitions=4, iters=4, batch=64, shard_by="hash", shuffles=1, lr=0.001,
                   model=None, optimizer="sgd", validation_pct=0.2, storage="table", local_steps=1,
                   min_epochs=0):
    """The canonical benchmark pipeline: feature stage + distributed trainer."""
    scale = SQLTransformer(statement="SELECT *, transform(features, x -> (x - 0.0) / 0.125) AS scaled "
                                     "FROM __THIS__")
    trainer = MinibatchTrainer(modelConfig=json.dumps(model or SmallCNN(side=IMAGE_SIDE).config()),
                               featuresCol="scaled", labelCol="label", predictionCol="prediction",
                               idCol="id", iters=iters, miniBatch=batch, partitions=partitions, lr=lr,
                               optimizer=optimizer, validationPct=validation_pct, shardBy=shard_by,
                               partitionShuffles=shuffles, storage=storage, localSteps=local_steps, minEpochs=min_epochs,
                               seed=SEED)
    return Pipeline(stages=[scale, trainer])


def run_image_benchmark(spark, df, **kw):
    """fit -> save -> load -> transform (persisted) -> accuracy, one report row."""
    t0 = time.time()
    fitted = image_pipeline(**kw).fit(df)
    fit_seconds = time.time() - t0
    path = scratch_path(spark, "pipeline")
    fitted.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    preds = loaded.transform(df).persist()
    try:
        acc = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                                metricName="accuracy").evaluate(preds)
        n = preds.count()
        # the trainer's own split, a function of seed and id
        held = with_split(preds, SEED, kw.get("validation_pct", 0.2)).filter(F.col("split") == "train")
        train_acc = held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()["a"]
    finally:
        preds.unpersist()
    res = fitted.stages[-1].result
    steps = [h for h in res.history if h["split"] == "train"]
    return (res.steps, kw.get("batch", 64), kw.get("partitions", 4), float(steps[-1]["loss"]),
            float(acc), n, train_acc, res.validation["accuracy"] if res.validation else None,
            sum(int(h["n"]) for h in steps), res.train_rows, fit_seconds)


REPORT_SCHEMA = ("iters int, batch int, partitions int, last_loss double, accuracy_all double, n long, "
                 "accuracy_train double, accuracy_validation double, rows_seen long, train_rows long, "
                 "fit_seconds double")


@register("train_cnn")
def q_train_cnn(spark, sf_dir):
    """T1 + T7 + S8/S9 + T8 + A1: CNN trained with minibatch SGD on 4 shards
    (50 iterations, or one epoch of the largest shard if that is more),
    pipeline saved, reloaded, scored and evaluated."""
    row = run_image_benchmark(spark, image_table(spark, sf_dir), partitions=4, iters=50, batch=64, min_epochs=1)
    return spark.createDataFrame([row], REPORT_SCHEMA)


PICTURE_SIDE = 28


def picture_csv(spark, sf_dir) -> str:
    """A headerless CSV of 785 columns (label, 28 x 28 pixels of 0..255) in
    the scratch folder.  Pixel ``p`` of a row is its embedding value ``p mod
    64``, from [-0.5, 0.5] to 0..255 (values beyond are clipped)."""
    df = image_table(spark, sf_dir)
    pixel = [F.greatest(F.lit(0), F.least(F.lit(255), F.round((F.col("features")[p % 64] + 0.5) * 255)))
             .cast("int").alias(f"_c{p + 1}") for p in range(PICTURE_SIDE * PICTURE_SIDE)]
    path = scratch_path(spark, "pictures")
    df.select(F.col("label").alias("_c0"), *pixel).write.csv(path)
    return path


@register("train_cnn_csv")
def q_train_cnn_csv(spark, sf_dir):
    """The canonical job: headerless 785-column CSV, VectorAssembler over
    columns 1..784, 28 x 28 CNN (50 iterations or one epoch of the largest
    shard, batch 64, 3 shards), save, load, score; accuracy on train,
    validation and all rows."""
    path = picture_csv(spark, sf_dir)
    names = [f"_c{i}" for i in range(1, PICTURE_SIDE * PICTURE_SIDE + 1)]
    raw = spark.read.schema(", ".join(f"{c} int" for c in ["_c0", *names])).csv(path)
    keyed = raw.withColumn("id", F.xxhash64(*raw.columns)).withColumnRenamed("_c0", "label")
    rows = VectorAssembler(inputCols=names, outputCol="pixels").transform(keyed).select("id", "label", "pixels")
    trainer = MinibatchTrainer(modelConfig=json.dumps(SmallCNN(side=PICTURE_SIDE).config()), featuresCol="pixels",
                               labelCol="label", predictionCol="prediction", idCol="id", iters=50, miniBatch=64,
                               partitions=3, lr=0.001, validationPct=0.2, minEpochs=1, seed=SEED)
    t0 = time.time()
    fitted = Pipeline(stages=[trainer]).fit(rows)
    seconds = time.time() - t0
    saved = scratch_path(spark, "pipeline")
    fitted.write().overwrite().save(saved)
    preds = with_split(PipelineModel.load(saved).transform(rows), SEED, 0.2)
    right = (F.col("prediction") == F.col("label")).cast("double")
    # every row is scored once: the total comes from the parts
    parts = preds.groupBy("split").agg(F.sum(right).alias("right"), F.count(right).alias("judged"),
                                       F.count(F.lit(1)).alias("n"))
    both = parts.rollup("split").agg((F.sum("right") / F.sum("judged")).alias("accuracy"), F.sum("n").alias("n")) \
        .withColumn("split", F.coalesce("split", F.lit("all")))
    res = fitted.stages[-1].result
    seen = sum(int(h["n"]) for h in res.history if h["split"] == "train")
    return (both.withColumn("rows_seen", F.lit(seen).cast("long"))
            .withColumn("train_rows", F.lit(res.train_rows).cast("long"))
            .withColumn("fit_seconds", F.lit(seconds)))


@register("train_local_sgd")
def q_train_local_sgd(spark, sf_dir):
    """The canonical CNN pipeline with local SGD: 50 steps, or one epoch of
    the largest shard, in jobs of 10 minibatches per shard, weight deltas
    averaged by rows."""
    row = run_image_benchmark(spark, image_table(spark, sf_dir), partitions=4, iters=50, batch=64, local_steps=10,
                              min_epochs=1)
    return spark.createDataFrame([row], REPORT_SCHEMA)


@register("train_skewed")
def q_train_skewed(spark, sf_dir):
    """Same, rows dealt to shards by hash of label, 4 re-deal rounds of
    one epoch of their largest shard at least."""
    row = run_image_benchmark(spark, image_table(spark, sf_dir), partitions=4, iters=50, batch=64,
                              shard_by="label", shuffles=4, min_epochs=1)
    return spark.createDataFrame([row], REPORT_SCHEMA)


def mlp_splits(spark, sf_dir):
    """train / test parts (1 in 6 rows to test, as 10k of 60k)."""
    return sampling.split_fraction(image_table(spark, sf_dir), SEED, "id", [5, 1], ["train", "test"])


def mlp_config(workers: int, validation_pct: float = 0.0, **more) -> TrainConfig:
    """3 epochs of batches of 64, Adam, the rows dealt to ``workers`` shards
    and re-dealt to batches every epoch."""
    return TrainConfig(epochs=3, batch_size=64, partitions=workers, lr=1e-3, optimizer="adam",
                       validation_pct=validation_pct, seed=SEED, window_work=WINDOW_WORK, **more)


def run_mlp(spark, sf_dir, workers: int = 1):
    """The MLP job (64-128-256-10, ReLU, log-softmax) with an exact-count
    hold-out of a fifth of the training part, validated every epoch."""
    parts = mlp_splits(spark, sf_dir).filter(F.col("split") == "train").drop("split")
    hold = parts.count() // 5
    held = sampling.split_exact(parts, SEED, "id", hold).persist()
    try:
        return train(held.filter(F.col("split") == "train"), MLP([64, 128, 256, 10]).config(), mlp_config(workers),
                     validation=held.filter(F.col("split") == "validation"), eval_per_epoch=True)
    finally:
        held.unpersist()


@register("train_mlp")
def q_train_mlp(spark, sf_dir):
    """The MLP job with one worker; history per step (loss, accuracy)
    and a validation row per epoch."""
    return history_frame(spark, run_mlp(spark, sf_dir))


@register("train_mlp_rows", f"""
WITH p AS (SELECT count(*) AS n FROM embeddings WHERE {sql_seeded_uniform(SEED, "'split'", 'vec_id')} < 5 / 6.0),
     h AS (SELECT n, n // 5 AS held, n - n // 5 AS used FROM p)
SELECT 'train' AS split, CAST(3 * ceil(used / 64.0) AS BIGINT) AS records, 3 * used AS rows_seen FROM h
UNION ALL
SELECT 'validation', 3, 3 * held FROM h
""")
def q_train_mlp_rows(spark, sf_dir):
    """Steps and rows of the MLP job: every training row in every epoch, the
    exact-count hold-out validated after each."""
    h = history_frame(spark, run_mlp(spark, sf_dir))
    return h.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("rows_seen"))


@register("train_mlp_workers")
def q_train_mlp_workers(spark, sf_dir):
    """T3 with the number of workers as a parameter: 1, 2 and 4."""
    out = None
    for workers in (1, 2, 4):
        h = history_frame(spark, run_mlp(spark, sf_dir, workers)).withColumn("workers", F.lit(workers))
        out = h if out is None else out.unionByName(h)
    return out.groupBy("workers", "split").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("rows_seen"),
                                               F.max_by("loss", "iter").alias("last_loss"),
                                               F.max_by("acc", "iter").alias("last_accuracy"))


@register("test_report")
def q_test_report(spark, sf_dir):
    """The trained MLP evaluated on the test part (loss, accuracy)."""
    parts = mlp_splits(spark, sf_dir)
    res = train(parts.filter(F.col("split") == "train"), MLP([64, 128, 256, 10]).config(), mlp_config(1))
    test = standardize_input(parts.filter(F.col("split") == "test"), "id", "label", "features")
    ev = evaluate(test, res.model_config, res.params)
    return spark.createDataFrame([("test", ev["loss"], ev["accuracy"], ev["n"])],
                                 "split string, loss double, accuracy double, n long")


# shards and batch sizes of the rows-seen proof: the smallest and largest
# of the benchmark
SEEN_SHARDS, SEEN_BATCHES, SEEN_EPOCHS = (1, 4, 12, 16), (32, 2048), 2


@register("train_rows_seen", "\nUNION ALL\n".join(f"""
SELECT {p} AS partitions, {b} AS batch_size, shard, n AS n_rows, nb AS n_batches,
       CAST((t // nb) * n + least(n, (t % nb) * {b}) AS BIGINT) AS rows_seen
FROM (SELECT *, {SEEN_EPOCHS} * max(nb) OVER () AS t
      FROM (SELECT CAST({sql_seeded_hash32(SEED, "'shard0'", 'vec_id')} % {p} AS INTEGER) AS shard, count(*) AS n,
                   CAST(ceil(count(*) / {b}.0) AS BIGINT) AS nb
            FROM embeddings WHERE {sql_seeded_uniform(SEED, "'split'", 'vec_id')} >= 0.2 GROUP BY 1))
""" for p in SEEN_SHARDS for b in SEEN_BATCHES))
def q_train_rows_seen(spark, sf_dir):
    """Rows that the trainer's steps read over two epochs of the largest
    shard, per shard: every row of every shard is reached, the tail too, and
    a batch larger than a shard is the whole shard."""
    base = with_split(standardize_input(image_table(spark, sf_dir), "id", "label", "features"), SEED, 0.2)
    rows = base.filter(F.col("split") == "train").drop("split").persist()
    found = []
    try:
        for p in SEEN_SHARDS:
            for b in SEEN_BATCHES:
                cfg = TrainConfig(batch_size=b, partitions=p, validation_pct=0.2, seed=SEED, layout_partitions=p)
                prepared = PreparedRound(assign_shards_and_batches(rows, cfg, 0), cfg, "seen")
                try:
                    steps = SEEN_EPOCHS * max(prepared.shard_batches.values())
                    # a row comes once for each of its shard's epochs in the window: one scan, one aggregate
                    read = prepared.window_rows(0, steps).groupBy("shard", "n_rows", "n_batches")
                    found += [(p, b, r["shard"], r["n_rows"], r["n_batches"], r["seen"])
                              for r in read.agg(F.count(F.lit(1)).alias("seen")).collect()]
                finally:
                    prepared.release()
    finally:
        rows.unpersist()
    return spark.createDataFrame(found, "partitions int, batch_size int, shard int, n_rows long, n_batches long, "
                                        "rows_seen long")


GANG_SHARDS, GANG_BATCH, GANG_EPOCHS = 4, 64, 2


def run_gang(spark, sf_dir):
    """The CNN on 4 shards that train at the same time, 2 epochs."""
    cfg = TrainConfig(epochs=GANG_EPOCHS, batch_size=GANG_BATCH, partitions=GANG_SHARDS, lr=0.001, seed=SEED)
    return train_gang(image_table(spark, sf_dir), SmallCNN(side=IMAGE_SIDE).config(), cfg)


@register("train_gang")
def q_train_gang(spark, sf_dir):
    """T1 gang-scheduled: a barrier job per epoch, gradients exchanged between
    its tasks; loss and accuracy of the steps."""
    return history_frame(spark, run_gang(spark, sf_dir))


@register("train_gang_rows", f"""
WITH s AS (SELECT count(*) AS n, CAST(ceil(count(*) / {GANG_BATCH}.0) AS BIGINT) AS nb FROM embeddings
           GROUP BY {sql_seeded_hash32(SEED, "'shard0'", 'vec_id')} % {GANG_SHARDS}),
     t AS (SELECT *, {GANG_EPOCHS} * max(nb) OVER () AS t FROM s)
SELECT max(t) AS steps, CAST(sum((t // nb) * n + least(n, (t % nb) * {GANG_BATCH})) AS BIGINT) AS rows_seen,
       CAST(sum(n) AS BIGINT) AS train_rows FROM t
""")
def q_train_gang_rows(spark, sf_dir):
    """Steps and rows of the gang-scheduled job: every row in every epoch of
    its shard."""
    res = run_gang(spark, sf_dir)
    return spark.createDataFrame([(res.steps, sum(h["n"] for h in res.history), res.train_rows)],
                                 "steps long, rows_seen long, train_rows long")


@register("train_mlp_regression")
def q_train_mlp_regression(spark, sf_dir):
    """T4: MLP 5-10-1 regression, full batch, MSE, SGD lr 0.1, 6 epochs."""
    d = doc_features(spark, sf_dir).select("doc_id", F.array(*DOC_FEATURES).alias("features"),
                                           F.col("target").alias("label"))
    cfg = TrainConfig(iters=6, partitions=4, lr=0.1, full_batch=True, feature_dtype="double", seed=SEED)
    res = train(d, MLP([len(DOC_FEATURES), 10, 1], task="regression").config(), cfg, id_col="doc_id")
    return history_frame(spark, res).select("iter", "n", "loss")


@register("train_mlp_regression_rows", """
SELECT CAST(i AS INTEGER) AS iter, (SELECT count(*) FROM documents) AS n FROM range(6) t(i)
""")
def q_train_mlp_regression_rows(spark, sf_dir):
    """Every full-batch step of the regression reads every row."""
    return q_train_mlp_regression(spark, sf_dir).select("iter", "n")


@register("model_roundtrip", "SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS n_equal FROM embeddings")
def q_model_roundtrip(spark, sf_dir):
    """Save a model trained for 50 iterations and one epoch at least,
    load it, and check that predictions are unchanged on every row."""
    df = image_table(spark, sf_dir)
    trainer = MinibatchTrainer(modelConfig=json.dumps(LinearNet(64, 10, "classification").config()),
                               iters=50, miniBatch=64, partitions=2, lr=0.5, localSteps=10, minEpochs=1, seed=SEED)
    model = trainer.fit(df)
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = MinibatchModel.load(path)
    a = model.transform(df).select("id", F.col("prediction").alias("p1"))
    b = loaded.transform(df).select("id", F.col("prediction").alias("p2"))
    return (a.join(b, "id").agg(F.count(F.lit(1)).alias("n"),
                                F.sum((F.col("p1") == F.col("p2")).cast("long")).alias("n_equal")))


@register("pipeline_fit_score")
def q_pipeline_fit_score(spark, sf_dir):
    """Pipeline(feature stage, trainer).fit (50 iterations, one epoch at
    least) then transform: predictions for every input row."""
    df = image_table(spark, sf_dir)
    fitted = image_pipeline(partitions=2, iters=50, batch=64, local_steps=10, min_epochs=1,
                            model=LinearNet(64, 10, "classification").config(), lr=0.5).fit(df)
    return fitted.transform(df).select("id", "label", "prediction")


@register("training_report")
def q_training_report(spark, sf_dir):
    """The printed training summary as one row: coefficients,
    intercept, iterations, objective history length, residual spread and
    MSE/RMSE/r2 of the elastic-net fit (the schema print becomes the
    ``schema`` column)."""
    d = doc_features(spark, sf_dir)
    data = VectorAssembler(inputCols=DOC_FEATURES, outputCol="features").transform(d).persist()
    try:
        m = LinearRegression(featuresCol="features", labelCol="target", maxIter=100, regParam=0.3,
                             elasticNetParam=0.2).fit(data)
        s = m.summary
        res = s.residuals.agg(F.min("residuals").alias("lo"), F.max("residuals").alias("hi")).first()
        row = (d.schema.simpleString(), [float(v) for v in m.coefficients], float(m.intercept),
               int(s.totalIterations), len(s.objectiveHistory), float(res["lo"]), float(res["hi"]),
               float(s.meanSquaredError), float(s.rootMeanSquaredError), float(s.r2))
    finally:
        data.unpersist()
    return spark.createDataFrame(
        [row],
        "schema string, coefficients array<double>, intercept double, iterations int, history_len int, "
        "residual_min double, residual_max double, mse double, rmse double, r2 double")


@register("train_mlp_builtin")
def q_train_mlp_builtin(spark, sf_dir):
    """Second MLP backend: Spark ML MultilayerPerceptronClassifier 64-128-10
    (sigmoid hidden layer, L-BFGS) on the train part, accuracy on test."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    parts = mlp_splits(spark, sf_dir).select("split", F.col("label").cast("double").alias("label"),
                                              array_to_vector("features").alias("features"))
    model = MultilayerPerceptronClassifier(layers=[64, 128, 10], maxIter=50, seed=SEED).fit(
        parts.filter(F.col("split") == "train"))
    pred = model.transform(parts)
    return (pred.groupBy("split").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                                      F.count(F.lit(1)).alias("n")))
