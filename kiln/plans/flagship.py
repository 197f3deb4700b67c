"""The flagship job: normalise -> seeded split -> minibatches -> distributed
softmax-regression training -> JVM-side scoring -> accuracy and
cross-entropy per split."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import arrays
from kiln.models import LinearNet
from kiln.operators import features, metrics, sampling
from kiln.operators.training import TrainConfig, train
from kiln.plans.constants import DIM, N_CLASSES, SEED
from kiln.plans.registry import register
from kiln.sources import image_table


def flagship(spark, sf_dir, epochs: int = 1, partitions: int = 4, batch: int = 64):
    df = features.normalize(image_table(spark, sf_dir), "features", 0.0, 0.125)
    df = sampling.split_fraction(df, SEED, "id", [0.8, 0.2], ["train", "test"])
    net = LinearNet(DIM, N_CLASSES, "classification")
    cfg = TrainConfig(epochs=epochs, batch_size=batch, partitions=partitions, lr=0.5, validation_pct=0.0, seed=SEED)
    res = train(df.filter(F.col("split") == "train"), net.config(), cfg)
    p = net.unpack(res.params)
    # a linear model is small enough to score with column expressions
    scored = df.withColumn("scores", arrays.affine("features", p["W"].tolist(), p["b"].tolist()))
    scored = scored.select("split", "label", arrays.argmax("scores").alias("prediction"),
                           metrics.cross_entropy_expr(arrays.log_softmax("scores"), "label").alias("ce"))
    return (scored.groupBy("split")
            .agg(F.round(metrics.accuracy_expr("label", "prediction"), 6).alias("accuracy"),
                 F.round(F.avg("ce"), 6).alias("loss"), F.count(F.lit(1)).alias("n")))


@register("flagship_softmax")
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)
