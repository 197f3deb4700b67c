"""Top-k of unseen items against brute force over the same factors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kiln.operators import mips, recommend
from kiln.plans.extras import purchase_ratings


def brute(users, items, seen, k):
    have = set(seen)
    out = []
    for u, x in users:
        scored = sorted((-float(np.dot(x, v)), i) for i, v in items if (u, i) not in have)
        out += [(u, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def tables(spark, users, items, seen):
    return (spark.createDataFrame(users, "user long, vec array<double>").repartition(3),
            spark.createDataFrame(items, "item long, vec array<double>"),
            spark.createDataFrame(seen, "user long, item long"))


@pytest.mark.parametrize("block_items,part", [(7, 2048), (100, 16), (10 ** 6, 2048)])
def test_top_unseen_equals_brute_force(spark, block_items, part):
    """Small whole numbers: many ties, exact sums; blocks of 7 items take many
    rounds, one block takes one."""
    rng = np.random.default_rng(5)
    users = [(u, [float(x) for x in rng.integers(-3, 4, 4)]) for u in range(60)] + [(99, [0.0] * 4), (100, [1e-9, 0.0, 0.0, 0.0])]
    items = [(i * 3, [float(x) for x in rng.integers(-2, 3, 4) * (5 if i % 9 == 0 else 1)]) for i in range(150)]
    seen = [(int(u), int(i) * 3) for u, i in zip(rng.integers(0, 60, 900), rng.integers(0, 150, 900))]
    seen += [(7, i) for i, _ in items[:147]] + [(8, i) for i, _ in items] + [(12345, 3), (1, 999999), (None, 3), (2, None)]
    got = mips.top_unseen(*tables(spark, users, items, seen), k=5, block_bytes=block_items * (8 * 4 + 24))
    want = brute(users, items, seen, 5)
    assert sorted(tuple(r[c] for c in ("user", "rank", "item", "score")) for r in got.collect()) == want
    assert sum(r[0] == 7 for r in want) == 3 and not any(r[0] == 8 for r in want)


def test_blocks_are_skipped_by_their_norm(monkeypatch):
    """Items of a falling norm: once k candidates beat the bound, nothing else
    is scored, however many items follow."""
    n, calls = 100_000, []
    real = np.partition

    def counted(a, *args, **kwargs):
        calls.append(a.shape)
        return real(a, *args, **kwargs)
    monkeypatch.setattr(mips.np, "partition", counted)
    vectors = np.ones((n, 3)) / np.arange(1, n + 1)[:, None]
    none = np.zeros(0, np.int64)
    row, score, item = mips.merge_block(np.ones((2, 3)), np.full(2, 3 ** .5), (none, np.zeros(0), none), (none, none),
                                        np.arange(n), vectors, np.linalg.norm(vectors, axis=1), 10)
    assert item.tolist() == list(range(10)) * 2 and len(calls) == 1


def test_top_unseen_edges(spark):
    users, items, seen = tables(spark, [(1, [1.0, 2.0])], [(5, [1.0, 1.0])], [])
    assert [tuple(r) for r in mips.top_unseen(users, items, seen, 3).collect()] == [(1, 1, 5, 3.0)]
    assert mips.top_unseen(users, items.limit(0), seen, 3).count() == 0
    assert mips.top_unseen(users.limit(0), items, seen, 3).count() == 0
    assert mips.top_unseen(users.limit(0), items.limit(0), seen, 3).count() == 0
    for bad in ([1.0], [1.0, None], [1.0, float("nan")], None):
        with pytest.raises(ValueError):
            mips.top_unseen(users, spark.createDataFrame([(5, bad)], "item long, vec array<double>"), seen, 3)


def test_als_recommendations_equal_brute_force_of_the_factors(spark):
    ratings = purchase_ratings(spark, SF001).persist()
    model = recommend.als_fit(ratings, rank=4, max_iter=2, seed=1)
    users = model.userFactors.select(F.col("id").cast("long").alias("user"), F.col("features").alias("vec"))
    items = model.itemFactors.select(F.col("id").cast("long").alias("item"), F.col("features").alias("vec"))
    got = mips.top_unseen(users, items, ratings, 10, block_bytes=40 * 56)
    us, its = ([(r[0], np.array(r[1], float)) for r in t.collect()] for t in (users, items))
    want = brute(us, its, {(r["user"], r["item"]) for r in ratings.collect()}, 10)
    rows = sorted(tuple(r) for r in got.collect())
    assert [r[:2] for r in rows] == [r[:2] for r in want] and len(rows) >= 10
    assert np.allclose([r[3] for r in rows], [r[3] for r in want], rtol=1e-9, atol=1e-12)
    ratings.unpersist()


def test_items_of_few_entries_are_skipped_by_their_sums(monkeypatch):
    """A user who spreads over many brands and items of one brand each: the
    product of norms bounds nothing, that of entry and sum ends at once."""
    n, d, calls = 50_000, 25, []
    real = np.partition

    def counted(a, *args, **kwargs):
        calls.append(a.shape)
        return real(a, *args, **kwargs)
    monkeypatch.setattr(mips.np, "partition", counted)
    sales = np.linspace(100, 50, n)
    vectors = np.zeros((n, d))
    vectors[np.arange(n), np.arange(n) % d] = sales
    none = np.zeros(0, np.int64)
    row, score, item = mips.merge_block(np.ones((1, d)), np.full(1, 5.0), (none, np.zeros(0), none), (none, none),
                                        np.arange(n), vectors, sales, 10)
    assert item.tolist() == list(range(10)) and len(calls) == 1


def test_blocks_are_skipped_by_their_sums(spark, monkeypatch):
    """The same over blocks: the first is enough, and nothing is lost when a
    later block has the larger sums."""
    blocks = []
    real = mips._score
    monkeypatch.setattr(mips, "_score", lambda *a: blocks.append(1) or real(*a))
    users = [(u, [1.0, 1.0, 1.0, 1.0]) for u in range(5)]
    items = [(i, [float(200 - i) if i % 4 == j else 0.0 for j in range(4)]) for i in range(80)]
    got = mips.top_unseen(*tables(spark, users, items, [(1, 0)]), k=3, block_bytes=20 * (8 * 4 + 24))
    assert sorted(tuple(r[c] for c in ("user", "rank", "item", "score")) for r in got.collect()) == brute(
        users, items, [(1, 0)], 3) and len(blocks) == 1
    blocks.clear()
    items = items[:40] + [(100, [75.0, 75.0, 75.0, 75.0])]
    got = mips.top_unseen(*tables(spark, users, items, []), k=1, block_bytes=20 * (8 * 4 + 24))
    assert [r["item"] for r in got.collect()] == [100] * 5 and len(blocks) == 3
