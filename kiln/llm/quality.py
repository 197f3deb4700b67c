"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in surface features of its whole text.  The
weights come from preference pairs (a document labelled 1 beats one labelled
0): logistic loss on the feature difference, fitted by Spark ML on a bounded
sample of labelled rows.  The decision threshold is a quantile of the raw
scores: the sample's share of label 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm.registry import register
from kiln.llm.tables import documents, fresh, held_out, text_of, written

MAX_LABELLED = 20_000  # labelled rows of a fit, chosen by a hash of the id
PAIRS_PER_ROW = 10     # expected preference pairs per labelled row
SLOTS = 4              # pairing slots a row takes
KEEP = 0.7             # score from which on a document is predicted good

_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[0x41:0x5B], _DIGIT[0x30:0x3A] = True, True
_CLASSES = [_UPPER, _DIGIT]
for _chars in (b"!", b"|", b"#", b"$%&*", b".", b",;:", b"<>{}[]()=/\\_~^+", b"\n", b"\"'-?@"):
    _mask = np.zeros(256, bool)
    _mask[list(_chars)] = True
    _CLASSES.append(_mask)
_WIDE = np.zeros(256, bool)
_WIDE[0x80:] = True
_CLASSES.append(_WIDE)
_LETTER = _WIDE.copy()
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
N_FEATURES = len(_CLASSES) + 11


def _per_row(values, offs):
    """Sums of ``values`` between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offs[1:]] - total[offs[:-1]]


def _distinct(rows, hashes, n):
    key = np.unique(G.mix(hashes) ^ (rows.astype(np.uint64) << np.uint64(44)) if len(rows) else hashes,
                    return_index=True)[1]
    return np.bincount(rows[key], minlength=n).astype(np.float64)


def features(data, offs):
    """(rows, N_FEATURES) of a chunk of texts; an empty text is all zeros."""
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    per_byte = 1.0 / np.maximum(size, 1)
    cols = [_per_row(mask[data], offs) * per_byte for mask in _CLASSES]
    starts, ends, woff = G.word_spans(data, offs, G.SPACE)
    words = np.diff(woff).astype(np.float64)
    per_word = 1.0 / np.maximum(words, 1)
    lens = ends - starts
    row = np.repeat(np.arange(n), np.diff(woff))
    hashes = G.word_hashes(data, starts, ends)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
    letters, uppers = letters[ends] - letters[starts], uppers[ends] - uppers[starts]
    odd_end = ~_LETTER[data[ends - 1]] & (data[ends - 1] != 0x2E) & (data[ends - 1] != 0x2C)
    cols += [np.log1p(size), np.log1p(words), _per_row(lens, woff) * per_word,
             _per_row(lens > 12, woff) * per_word, _per_row(lens == 1, woff) * per_word,
             _per_row(odd_end, woff) * per_word, _per_row((letters > 1) & (uppers == letters), woff) * per_word,
             _per_row(letters == 0, woff) * per_word,
             _distinct(row, hashes, n) * per_word / np.maximum(1, np.log1p(words))]
    line = np.zeros(256, bool)
    line[0x0A] = True
    ls, le, loff = G.word_spans(data, offs, line)
    lines = np.diff(loff).astype(np.float64)
    per_line = 1.0 / np.maximum(lines, 1)
    lrow = np.repeat(np.arange(n), np.diff(loff))
    cols += [1 - _distinct(lrow, G.word_hashes(data, ls, le), n) * per_line - (lines == 0),
             _per_row(le - ls < 30, loff) * per_line]
    return np.stack(cols, axis=1)


def _scan(emit):
    def run(batches):
        for batch in batches:
            data, offs = G.text_buffer(batch.column(batch.num_columns - 1))
            for lo, hi in G.chunks(offs):
                x = features(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                keep = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keep, emit(x)], names=[*batch.schema.names[:-1], "out"])
    return run


def _as_lists(x):
    return G.row_lists(np.full(len(x), x.shape[1]), pa.array(x.ravel()))


class Model:
    """Weights on raw features and the raw score that maps to ``KEEP``."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = x @ self.weights - self.threshold + math.log(KEEP / (1 - KEEP))
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -500, 500)))


def preference_pairs(sample: DataFrame, n_good: int, n_bad: int) -> DataFrame:
    """``(x, y)``: features of a good and a bad row that share a slot.  Each
    row takes SLOTS hashed slots; their number makes PAIRS_PER_ROW pairs a
    row expected, so the pairs grow with the sample, not with its square."""
    slots = max(1, round(n_good * n_bad * SLOTS * SLOTS / (PAIRS_PER_ROW * max(1, n_good + n_bad))))
    draws = F.array(*[F.pmod(F.xxhash64(F.lit(j), "id"), F.lit(slots)) for j in range(SLOTS)])
    placed = sample.withColumn("slot", F.explode(F.array_distinct(draws)))
    good = placed.filter("quality = 1").select("slot", F.col("out").alias("x"))
    bad = placed.filter("quality = 0").select("slot", F.col("out").alias("y"))
    return good.join(bad, "slot").select("x", "y")


RANK_BUCKETS = 1 << 16
BROADCAST_LABELS = 500_000  # labelled rows that meet the texts by a broadcast; more meet their scores


def exact_quantile(values: DataFrame, share: float) -> float:
    """The interpolated quantile of column ``r``: a histogram finds the
    bucket of the wanted ranks, and only its distinct values are counted."""
    ends = values.agg(F.count("r").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    if ends["lo"] == ends["hi"]:
        return float(ends["lo"])
    place = share * (ends["n"] - 1)
    low, high = math.floor(place), math.ceil(place)
    cell = F.floor((F.col("r") - ends["lo"]) / (ends["hi"] - ends["lo"]) * (RANK_BUCKETS - 1))
    found = {}
    before = 0
    for row in sorted(values.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()):
        for rank in (low, high):
            if before <= rank < before + row["n"]:
                found[rank] = (row["c"], before)
        before += row["n"]
    at = {}
    for rank, (c, seen) in found.items():
        for row in sorted(values.filter(cell == c).groupBy("r").agg(F.count(F.lit(1)).alias("n")).collect()):
            if seen <= rank < seen + row["n"]:
                at[rank] = row["r"]
            seen += row["n"]
    return float(at[low] + (at[high] - at[low]) * (place - low))


def labelled_scores(docs: DataFrame, marked: DataFrame, n: int, weights, id_col: str, text_col: str) -> DataFrame:
    """``(quality, r)``: raw score of every row of ``marked`` (n rows)."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    if n <= BROADCAST_LABELS:
        source = source.join(F.broadcast(marked.select("id")), "id", "left_semi")
    scored = source.mapInArrow(_scan(lambda x: pa.array(x @ weights)), f"id {kind}, out double")
    return written(scored.join(marked, "id").select("quality", F.col("out").alias("r")), "scored")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality",
        max_labelled: int = MAX_LABELLED) -> Model:
    """Learn the weights from the labelled rows that are not held out (at
    most about ``max_labelled`` of them); the threshold, the quantile of the
    label share, is taken over all of them.  With no pair of different labels nothing is
    learnt: all weights are zero and every document scores ``KEEP``."""
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("quality"))
              .filter(F.col("quality").isin(0, 1) & ~held_out("id")).dropDuplicates(["id"]))
    n, every = marked.count(), marked
    if n > max_labelled:
        share = int(max_labelled / n * 2**32)
        marked = marked.filter(F.pmod(F.xxhash64("id"), F.lit(2**32)) < share)
    kind = docs.schema[id_col].dataType.simpleString()
    source = (docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
              .join(F.broadcast(marked), "id").select("id", "quality", "text"))  # bounded by max_labelled
    sample = written(source.mapInArrow(_scan(_as_lists), f"id {kind}, quality int, out array<double>"), "labelled")
    counts = {r["quality"]: r["n"] for r in sample.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return Model(np.zeros(N_FEATURES), 0.0)
    spread = sample.select(F.posexplode("out").alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("s")).collect()
    scale = np.ones(N_FEATURES)
    for r in spread:
        scale[r["i"]] = r["s"] if r["s"] and r["s"] > 1e-9 else 1.0
    inverse = F.lit((1 / scale).tolist())
    pairs = preference_pairs(sample, good, bad)
    # each pair once in each direction: the model has no intercept
    ahead = F.transform(F.arrays_zip("x", "y", inverse.alias("w")), lambda t: (t["x"] - t["y"]) * t["w"])
    pairs = written(pairs.select(ahead.alias("d")), "pairs")
    both = pairs.select("d", F.lit(1.0).alias("label")).unionByName(
        pairs.select(F.transform("d", lambda v: -v).alias("d"), F.lit(0.0).alias("label")))
    if pairs.isEmpty():
        return Model(np.zeros(N_FEATURES), 0.0)
    ranker = LogisticRegression(featuresCol="f", labelCol="label", fitIntercept=False, standardization=False,
                                regParam=1e-3, maxIter=50).fit(both.select(array_to_vector("d").alias("f"), "label"))
    weights = np.array(ranker.coefficients.toArray()) / scale
    if n > max_labelled:
        scored = labelled_scores(docs, every, n, weights, id_col, text_col)
        total = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("quality")).alias("bad")).first()
        return Model(weights, exact_quantile(scored, total["bad"] / total["n"]))
    raw = F.aggregate(F.arrays_zip(F.col("out"), F.lit(weights.tolist()).alias("w")), F.lit(0.0),
                      lambda a, t: a + t["out"] * t["w"])
    cut = sample.select(raw.alias("r")).agg(F.percentile("r", F.lit(bad / (good + bad))).alias("c")).first()["c"]
    return Model(weights, float(cut))


def score(docs: DataFrame, model: Model, keep: list, text_col="text") -> DataFrame:
    """``keep`` columns plus ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, text_of(text_col).alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    scored = source.mapInArrow(_scan(lambda x: pa.array(shared.value.scores(x))), f"{schema}, out double")
    return scored.withColumnRenamed("out", "score")


def quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null text counts as empty, and an empty text gets the score of zero
    features; repeated rows score alike; null ids and ids without a label
    are scored and never learnt from; null labels are skipped, of repeated
    labels one counts.  Only the id, text and label columns are read.  An
    empty table of documents gives no rows."""
    model = fit(docs, labels, id_col, text_col)
    out = score(docs, model, [F.col(id_col).alias("doc_id")], text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                      (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with a score of at least ``KEEP``, all their columns."""
    model = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh(docs, "text_")
    source = docs.withColumn(text, text_of(text_col))

    def run(batches):
        for batch in batches:
            data, offs = G.text_buffer(batch.column(batch.num_columns - 1))
            kept = np.concatenate([np.zeros(0)] + [
                shared.value.scores(features(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]))
                for lo, hi in G.chunks(offs)]) >= KEEP
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(kept))
    return source.mapInArrow(run, docs.schema)


@register("op2_quality")
def op2_quality(spark, sf_dir):
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
