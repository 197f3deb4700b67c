"""Power iteration clustering against numpy and the sample graph."""

import numpy as np
import pytest

from kiln.operators import pic
from kiln.plans import extras

# fixed values: weighted edges of the sample power-iteration-clustering file
SAMPLE = [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 0.1),
          (4, 5, 1.0), (4, 15, 1.0), (5, 6, 1.0), (6, 7, 1.0), (7, 8, 1.0), (8, 9, 1.0), (9, 10, 1.0),
          (10, 11, 1.0), (11, 12, 1.0), (12, 13, 1.0), (13, 14, 1.0), (14, 15, 1.0)]
SCHEMA = "src long, dst long, weight double"


def test_sample_splits_clique_from_ring(spark):
    found = pic.power_clusters(spark.createDataFrame(SAMPLE, SCHEMA), 2, max_steps=40)
    groups = {}
    for r in found.assigned.collect():
        groups.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], list(range(4, 16))]


def replay(edges, k, steps, rounds):
    nodes = sorted({v for a, b, w in edges for v in (a, b)})
    at = {v: i for i, v in enumerate(nodes)}
    A = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        A[at[a], at[b]] += w
        A[at[b], at[a]] += w
    d = A.sum(axis=1)
    v = d / d.sum()
    for _ in range(steps):
        v = A @ v / d
        v /= np.abs(v).sum()
    c = [v.min() + (v.max() - v.min()) * (2 * i + 1) / (2 * k) for i in range(k)]
    for _ in range(rounds):
        own = np.abs(v[:, None] - c).argmin(axis=1)
        c = [v[own == i].mean() if (own == i).any() else c[i] for i in range(k)]
    return dict(zip(nodes, v)), dict(zip(nodes, np.abs(v[:, None] - c).argmin(axis=1)))


def test_steps_equal_a_replay_with_a_hub(spark):
    """Vertex 0 has more edges than a partition's share; repeated edges in
    both directions add up, loops and zeros do not count."""
    rng = np.random.default_rng(7)
    edges = [(0, int(i), 1.0 + i % 3) for i in range(1, 120)]
    edges += [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(1, 120, 90), rng.integers(1, 120, 90), rng.random(90)) if a != b]
    edges += [(5, 0, 2.0), (0, 5, 0.5)]
    noise = [(3, 3, 9.0), (4, 500, 0.0), (None, 4, 1.0), (4, None, 1.0), (4, 6, None)]
    found = pic.power_clusters(spark.createDataFrame(edges + noise, SCHEMA), 3, max_steps=4, stop=None)
    value, cluster = replay(edges, 3, 4, 30)
    got = {r["node"]: r for r in found.assigned.collect()}
    assert set(got) == set(value) and found.steps == 4
    assert all(abs(got[v]["value"] - value[v]) < 1e-12 for v in value)
    assert all(got[v]["cluster"] == cluster[v] for v in value)


def test_edges_of_nothing_and_negative_weights(spark):
    none = pic.power_clusters(spark.createDataFrame([(1, 1, 1.0)], SCHEMA))
    assert none.assigned.count() == 0 and none.steps == 0
    with pytest.raises(ValueError, match="negative"):
        pic.power_clusters(spark.createDataFrame([(1, 2, -1.0)], SCHEMA))
    two = pic.power_clusters(spark.createDataFrame([(1, 2, 1.0)], SCHEMA), 2)
    assert {r["cluster"] for r in two.assigned.collect()} == {0}


@pytest.mark.parametrize("hub", [0, 3000])
def test_fit_gets_the_edges_of_a_part_together(spark, tmp_path, monkeypatch, hub):
    """Part 7 has ``hub`` more line items, beyond a partition's share: its
    edges alone are dealt over several partitions.  Weights stay line counts."""
    rng = np.random.default_rng(3)
    lines = [(int(a), int(b)) for a, b in zip(rng.integers(0, 90, 4000), rng.integers(0, 300, 4000))]
    lines += [(i % 90, 7) for i in range(hub)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, fit = [], extras.PowerIterationClustering.assignClusters

    def watch(self, edges):
        seen.extend(edges.rdd.mapPartitionsWithIndex(lambda i, rows: [(i, *r) for r in rows]).collect())
        return fit(self, edges)

    monkeypatch.setattr(extras.PowerIterationClustering, "assignClusters", watch)
    n = {r["cluster"]: r["n"] for r in extras.q_pic_clusters(spark, str(tmp_path)).collect()}
    count, held = {}, {}
    for a, b in lines:
        count[2 * a + 1, 2 * b] = count.get((2 * a + 1, 2 * b), 0) + 1
    for i, _, dst, _ in seen:
        held.setdefault(dst, set()).add(i)
    assert {(a, b): w for _, a, b, w in seen} == count and len(seen) == len(count)
    wide = {dst for dst, at in held.items() if len(at) > 1}
    assert wide == ({14} if hub else set())
    assert len({i for i, *_ in seen}) > 8
    assert sum(n.values()) == len({v for pair in count for v in pair})
