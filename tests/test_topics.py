"""Variational topics against a plain replay, and their bound."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import topics

SAMPLE = [(i, " ".join(random.Random(i).choices(["apple", "pear", "plum", "fig"] if i % 2 else
                                              ["rock", "sand", "clay", "Fig"], k=5 + i % 40))) for i in range(60)]
SAMPLE += [(100, None), (101, ""), (102, "1 2 3"), (103, "été 漢字 été"), (0, SAMPLE[0][1]), (None, "apple")]


def test_gamma_functions():
    x = np.concatenate([np.logspace(-6, 8, 400), [1.0, 2.0, 0.5]])
    assert np.allclose(topics.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)
    assert math.isclose(topics.digamma(np.array([1.0]))[0], -0.5772156649015329, rel_tol=1e-11)
    h = 1e-5
    y = x[(x > 0.1) & (x < 100)]
    slope = (topics.log_gamma(y + h) - topics.log_gamma(y - h)) / (2 * h)
    assert np.allclose(topics.digamma(y), slope, rtol=1e-5, atol=1e-5)


def replay(start, docs, k, iterations):
    """One document at a time, plain loops over its terms."""
    alpha = eta = 1.0 / k
    weights = {t: np.array(w) for t, w in start.items()}
    counts = [Counter(d) for d in docs if d]
    bounds = []
    for _ in range(iterations):
        total = sum(weights.values())
        log_beta = {t: topics.digamma(w) - topics.digamma(total) for t, w in weights.items()}
        sums = {t: np.zeros(k) for t in weights}
        bound = 0.0
        for c in counts:
            gamma = np.full(k, alpha + sum(c.values()) / k)
            for _ in range(topics.STEPS):
                theta = np.exp(topics.digamma(gamma) - topics.digamma(gamma.sum()))
                new = np.full(k, alpha)
                for t, n in c.items():
                    row = theta * np.exp(log_beta[t])
                    new += n * row / row.sum()
                still = np.abs(new - gamma).mean() < topics.CHANGE
                gamma = new
                if still:
                    break
            log_theta = topics.digamma(gamma) - topics.digamma(gamma.sum())
            for t, n in c.items():
                row = np.exp(log_theta + log_beta[t])
                sums[t] += n * row / row.sum()
                bound += n * math.log(row.sum())
            bound += ((alpha - gamma) * log_theta).sum() + sum(math.lgamma(g) for g in gamma) - k * math.lgamma(alpha)
            bound += math.lgamma(k * alpha) - math.lgamma(gamma.sum())
        for t, w in weights.items():
            bound += ((eta - w) * log_beta[t]).sum() + sum(math.lgamma(x) for x in w) - k * math.lgamma(eta)
        bound += sum(math.lgamma(len(weights) * eta) - math.lgamma(x) for x in total)
        bounds.append(bound)
        weights = {t: eta + s for t, s in sums.items()}
    return weights, bounds


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_topics_equal_a_plain_replay(spark, limit):
    """Both ways: topics broadcast, and joined by term."""
    df = spark.createDataFrame(SAMPLE, "doc_id long, text string").repartition(3)
    start = {r["term"]: r["weights"] for r in topics.lda(df, "doc_id", "text", k=3, iterations=0).weights.collect()}
    model = topics.lda(df, "doc_id", "text", k=3, iterations=4, broadcast_bytes=limit)
    words = [[w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()] for _, t in SAMPLE]
    want, bounds = replay(start, words, 3, 4)
    got = {r["term"]: np.array(r["weights"]) for r in model.weights.collect()}
    assert set(got) == set(want) and "fig" in got and "été" in got
    assert all(np.allclose(got[t], want[t], rtol=1e-9) for t in want)
    assert np.allclose(model.bounds, bounds, rtol=1e-10)
    assert np.allclose(model.totals, sum(want.values()))
    top = {r["topic"]: (r["terms"], r["weights"]) for r in model.top_terms(2).collect()}
    for i in range(3):
        best = sorted(want, key=lambda t: (-want[t][i], t))[:2]
        assert top[i][0] == best and np.allclose(top[i][1], [want[t][i] / sum(want.values())[i] for t in best])


def test_two_themes_part_and_the_bound_rises(spark):
    df = spark.createDataFrame(SAMPLE[:60], "doc_id long, text string")
    model = topics.lda(df, "doc_id", "text", k=2, iterations=15, seed=3)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    side = {t: int(np.argmax(w)) for t, w in ((r["term"], r["weights"]) for r in model.weights.collect())}
    assert side["apple"] == side["pear"] == side["plum"] != side["rock"] == side["sand"] == side["clay"]


def test_topics_of_nothing(spark):
    empty = spark.createDataFrame([(1, None), (2, "12 .")], "doc_id long, text string")
    model = topics.lda(empty, "doc_id", "text", k=2)
    assert model.weights.count() == 0 and model.bounds == [] and model.top_terms(3).count() == 0


def test_small_chunks_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    off = np.concatenate([[0], np.cumsum(rng.integers(1, 30, 50))])
    n, beta = rng.integers(1, 5, off[-1]).astype(float), rng.random((off[-1], 4))
    whole = topics.fit_documents(off, n, beta, 0.25)
    monkeypatch.setattr(topics, "CHUNK", 7)
    parts = [topics.fit_documents(off[lo:hi + 1] - off[lo], n[off[lo]:off[hi]], beta[off[lo]:off[hi]], 0.25)
             for lo, hi in topics._chunks(off)]
    assert np.allclose(np.concatenate([p[0] for p in parts]), whole[0], rtol=1e-12)
    assert np.allclose(np.concatenate([p[1] for p in parts]), whole[1], rtol=1e-12)


def test_beyond_a_broadcast_the_terms_of_blocks_move(spark, monkeypatch):
    """Not a row for each (document, term) pair."""
    docs = [(i, "apple pear plum fig rock sand clay lime") for i in range(400)] + [(7, "apple apple"), (None, "kiwi")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = topics.lda(df, "doc_id", "text", k=3, iterations=3)
    sizes, blocks = [], topics._blocks

    def watched(rows):
        kept, terms = blocks(rows)
        sizes.append((kept.select("block").distinct().count(), kept.agg(F.sum(F.size("keys"))).first()[0], terms.count()))
        return kept, terms
    monkeypatch.setattr(topics, "_blocks", watched)
    for bound in (topics.BLOCK, 50):
        monkeypatch.setattr(topics, "BLOCK", bound)
        got = topics.lda(df, "doc_id", "text", k=3, iterations=3, broadcast_bytes=0)
        assert np.allclose(got.bounds, want.bounds, rtol=1e-10) and np.allclose(got.totals, want.totals)
    for count, pairs, moved in sizes:
        assert pairs == 3202 and moved <= 9 * count < pairs / 4
    assert sizes[0][0] <= 2 * spark.sparkContext.defaultParallelism < sizes[1][0]
