"""Latent Dirichlet allocation by variational expectation maximisation.

Documents are rows of term keys and counts, written once.  Every iteration
reads every document: its topic weights are fitted to the current topics in
vectorised steps over a chunk of documents, and the expected counts per term
are summed inside the task before the one exchange, by term, that makes the
next topics.  The topics are a table by term.  While they are measured to fit
a broadcast, every task has them all.  Beyond that documents are dealt once to
blocks of a bounded number of pairs and kept there, and an iteration brings
every block the topics of its own distinct terms: what moves are the terms of
blocks, many documents each, never the documents or their pairs.

Term keys are 64-bit hashes, starting topics a function of term and topic, so
any partitioning gives the same model up to the order of sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.operators.joins import BROADCAST_MAX_BYTES
from kiln.operators.scratch import drop, store
from kiln.operators.text import tokens

CHUNK = 1 << 18   # (document, term) pairs that are fitted at a time
BLOCK = 1 << 23   # pairs of the documents that share the topics of their terms
STEPS = 20        # of a document's fit, at most
CHANGE = 1e-3     # mean change of its weights that ends it
TINY = 1e-100


def digamma(x: np.ndarray) -> np.ndarray:
    """Series at x + 6, and the recurrence back."""
    x = np.asarray(x, np.float64)
    back = sum(1.0 / (x + i) for i in range(6))
    y = x + 6
    z = 1.0 / (y * y)
    tail = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132 - z * (691 / 32760))))))
    return np.log(y) - 0.5 / y - tail - back


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    y = x + 6
    z = 1.0 / (y * y)
    tail = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + tail - np.log(
        x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _expectation(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet rows."""
    return digamma(weights) - digamma(weights.sum(axis=1, keepdims=True))


def fit_documents(off: np.ndarray, n: np.ndarray, beta: np.ndarray, alpha: float):
    """Documents as segments ``off`` (none empty) of pairs with counts ``n``
    and topic rows ``beta`` (exponentials of expected logarithms).  Returns
    (expected counts per pair and topic, bound of each document)."""
    k = beta.shape[1]
    total = np.add.reduceat(n, off[:-1])
    gamma = np.repeat((alpha + total / k)[:, None], k, axis=1)
    live, at, count, rows = np.arange(len(total)), off, n, beta
    for _ in range(STEPS):
        theta = np.exp(_expectation(gamma[live]))
        doc = np.repeat(np.arange(len(live)), np.diff(at))
        share = count / (np.einsum("ik,ik->i", theta[doc], rows) + TINY)
        new = alpha + theta * np.add.reduceat(share[:, None] * rows, at[:-1], axis=0)
        moved = np.abs(new - gamma[live]).mean(axis=1) >= CHANGE
        gamma[live] = new
        if not moved.any():
            break
        if not moved.all():  # documents that stand still leave
            pair = moved[doc]
            size = np.diff(at)[moved]
            live, count, rows = live[moved], count[pair], rows[pair]
            at = np.concatenate([[0], np.cumsum(size)])
    log_theta = _expectation(gamma)
    theta = np.exp(log_theta)
    doc = np.repeat(np.arange(len(total)), np.diff(off))
    norm = np.einsum("ik,ik->i", theta[doc], beta) + TINY
    expected = theta[doc] * beta * (n / norm)[:, None]
    bound = (np.add.reduceat(n * np.log(norm), off[:-1]) + ((alpha - gamma) * log_theta).sum(axis=1)
             + (log_gamma(gamma) - log_gamma(np.array(alpha))).sum(axis=1)
             + log_gamma(np.array(k * alpha)) - log_gamma(gamma.sum(axis=1)))
    return expected, bound


def _count_rows(batches):
    """(doc, list of keys) rows to (keys, counts) rows, a document each."""
    for batch in batches:
        lists = batch.column(0)
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, row))
        row, flat = row[order], flat[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.concatenate([first, [len(flat)]]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(size)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[first])),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(n.astype(np.int32)))], names=["keys", "n"])


def _chunks(off: np.ndarray):
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, side="right")) - 1)
        yield lo, min(hi, len(off) - 1)
        lo = hi


def _rows(key, sums, bound, k, names):
    return pa.RecordBatch.from_arrays(
        [pa.array(key.astype(np.int64)), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(k)],
         pa.array(bound)], names=names)


def _names(k):
    return ["key", *[f"s{i}" for i in range(k)], "bound"]


def _schema(k):
    return "key long, " + ", ".join(f"s{i} double" for i in range(k)) + ", bound double"


def _fit(keys, beta, batches, alpha: float, k: int):
    """(keys, n) rows under the topics of ``keys`` (sorted): one row a term
    with its expected counts, and one without any for the bound."""
    sums, bound = np.zeros((len(keys), k)), 0.0
    for batch in batches:
        lists = batch.column(0)
        size = np.diff(lists.offsets.to_numpy())
        off = np.concatenate([[0], np.cumsum(size[size > 0])])
        at = np.searchsorted(keys, lists.flatten().to_numpy(zero_copy_only=False))
        n = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        for lo, hi in _chunks(off):
            a, b = off[lo], off[hi]
            expected, each = fit_documents(off[lo:hi + 1] - a, n[a:b], beta[at[a:b]], alpha)
            bound += each.sum()
            for i in range(k):
                sums[:, i] += np.bincount(at[a:b], weights=expected[:, i], minlength=len(keys))
    used = np.flatnonzero(sums.any(axis=1))
    for lo in range(0, len(used), 50_000):
        part = used[lo:lo + 50_000]
        yield _rows(keys[part], sums[part], np.zeros(len(part)), k, _names(k))
    if bound:
        yield _rows(keys[:1], np.zeros((1, k)), np.array([bound]), k, _names(k))


def _fit_broadcast(topics, alpha: float, k: int):
    """``mapInArrow`` over (keys, n) rows."""
    def run(batches):
        keys, beta = topics.value
        yield from _fit(keys, beta, batches, alpha, k)
    return run


def _fit_block(alpha: float, k: int):
    """A block's (keys, n, block) rows with its terms' (home, key, topics)."""
    names = _names(k)
    schema = pa.schema([("key", pa.int64()), *[(name, pa.float64()) for name in names[1:]]])

    def run(docs, terms):
        key = terms.column("key").to_numpy()
        order = np.argsort(key)
        beta = np.stack([terms.column(f"b{i}").to_numpy()[order] for i in range(k)], axis=1)
        return pa.Table.from_batches(list(_fit(key[order], beta, docs.to_batches(), alpha, k)), schema)
    return run


def _blocks(rows: DataFrame):
    """(documents ``keys, n, block``, their distinct terms ``home, key``),
    laid out by block and by key and kept, so that neither moves again."""
    spark = rows.sparkSession
    pairs = rows.agg(F.sum(F.size("keys"))).first()[0]
    count = max(-(-pairs // BLOCK), min(pairs, 2 * spark.sparkContext.defaultParallelism))
    tasks = max(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("doc"), F.lit(count)).cast("int").alias("block")
    docs = (rows.select("keys", "n", block).repartition(tasks, "block").sortWithinPartitions("block")
            .persist(StorageLevel.DISK_ONLY))
    docs.count()  # a kept plan's partitioning is known once it has run
    terms = (docs.select(F.col("block").alias("home"), F.explode("keys").alias("key")).distinct().repartition(tasks, "key")
             .persist(StorageLevel.DISK_ONLY))
    terms.count()
    return docs, terms


def _topic_rows(k: int, totals: list, eta: float):
    """``mapInArrow`` over (key, weights): topic rows and the bound's part."""
    whole = digamma(np.array(totals))

    def run(batches):
        for batch in batches:
            weights = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            log_beta = digamma(weights) - whole
            part = ((eta - weights) * log_beta + log_gamma(weights) - log_gamma(np.array(eta))).sum(axis=1)
            off = np.arange(len(weights) + 1, dtype=np.int32) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(np.exp(log_beta).ravel())),
                 pa.array(part)], names=["key", "beta", "part"])
    return run


@dataclass
class TopicModel:
    """``weights``: (term, key, weights), a row a term of the corpus;
    ``totals``: the sums of the topics; ``bounds``: the likelihood bound that
    each iteration's documents reached under the topics before it."""
    weights: DataFrame
    totals: list
    bounds: list

    def top_terms(self, n: int) -> DataFrame:
        """``topic, terms, weights`` of the ``n`` heaviest terms (ties by
        term) per topic, weights as shares of the topic."""
        entries = self.weights.select("term", F.posexplode("weights").alias("topic", "w"))
        # the limit reaches the tasks before the shuffle
        place = Window.partitionBy("topic").orderBy(F.desc("w"), "term")
        best = entries.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= n)
        total = F.element_at(F.array(*[F.lit(float(t)) for t in self.totals]), F.col("topic") + 1)
        return (best.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("nth", "term", (F.col("w") / total).alias("w"))))
                                          .alias("b"))
                .select("topic", F.col("b.term").alias("terms"), F.col("b.w").alias("weights")))



def lda(docs: DataFrame, id_col: str, text_col: str, k: int = 5, iterations: int = 5, alpha: float | None = None,
        eta: float | None = None, seed: int = 42, broadcast_bytes: int = BROADCAST_MAX_BYTES) -> TopicModel:
    """Topics of every whole text of ``docs``; a term is a maximal run of
    letters, lower-cased, and none is left out.

    ``alpha`` and ``eta`` default to 1 / k.  Null and empty texts have no
    terms and change nothing; repeated rows count each time; a table without
    terms gives no rows.  ``broadcast_bytes`` bounds the topics that travel to
    every task; above it every block of documents gets those of its terms."""
    spark = docs.sparkSession
    alpha, eta = alpha or 1.0 / k, eta or 1.0 / k
    hashed = F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.xxhash64(t))
    rows = store(docs.select(hashed.alias("keys")).filter(F.size("keys") > 0)
                 .mapInArrow(_count_rows, "keys array<long>, n array<int>")
                 .select("keys", "n", F.monotonically_increasing_id().alias("doc")), "lda-docs")
    words = (docs.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("docs")))
    start = [0.5 + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "term"), F.lit(1 << 20)) / F.lit(float(1 << 20)) for i in range(k)]
    weights = store(words.select("term", F.xxhash64("term").alias("key"), F.array(*start).alias("weights")), "lda-topics")
    size = weights.count()
    if size != weights.select("key").distinct().count():
        raise ValueError("two terms have one 64-bit key")
    terms = weights.select("term", "key")
    first, bounds = weights, []

    def totals_of(table):
        return list(table.agg(*[F.coalesce(F.sum(F.col("weights")[i]), F.lit(0.0)) for i in range(k)]).first())

    totals = totals_of(weights)
    if not size:
        return TopicModel(weights, totals, [])
    whole = size * 8 * (k + 1) <= broadcast_bytes
    kept = [] if whole or not iterations else _blocks(rows)
    for _ in range(iterations):
        beta = weights.select("key", "weights").mapInArrow(
            _topic_rows(k, totals, eta), "key long, beta array<double>, part double")
        topic_part = beta.agg(F.sum("part")).first()[0]
        topic_part += float((log_gamma(np.array(size * eta)) - log_gamma(np.array(totals))).sum())
        if whole:
            table = beta.select("key", "beta").orderBy("key").toArrow()
            topics = spark.sparkContext.broadcast((
                table.column("key").to_numpy(),
                table.column("beta").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)))
            fitted = rows.select("keys", "n").mapInArrow(_fit_broadcast(topics, alpha, k), _schema(k))
        else:
            blocks, own = kept
            each = own.join(beta.select("key", *[F.col("beta")[i].alias(f"b{i}") for i in range(k)]).hint("merge"), "key")
            fitted = blocks.groupBy("block").cogroup(each.groupBy("home")).applyInArrow(_fit_block(alpha, k), _schema(k))
        summed = fitted.groupBy("key").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)], F.sum("bound").alias("bound"))
        after = store(terms.join(summed, "key", "left").select("term", "key", F.array(*[
            F.lit(eta) + F.coalesce(f"s{i}", F.lit(0.0)) for i in range(k)]).alias("weights"), "bound"), "lda-topics")
        bounds.append(float(after.agg(F.sum("bound")).first()[0]) + topic_part)
        if weights is not first:
            drop(weights)
        weights, totals = after, totals_of(after)
    for table in kept:
        table.unpersist()
    drop(rows, *([first] if weights is not first else []))
    return TopicModel(weights.select("term", "key", "weights"), totals, bounds)
