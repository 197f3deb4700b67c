"""Known answers on the small sample files (copied here as literals) and
brute-force replays of the iterative jobs."""

import glob
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import functions as F

from conftest import SF001
from kiln.operators import clustering, graph, itemsets, recommend, text
from kiln.session import ensure_checkpoint_dir, scratch_path

# fixed values: points of the sample k-means file (two groups of three)
KMEANS_POINTS = [[0.0, 0.0, 0.0], [0.1, 0.1, 0.1], [0.2, 0.2, 0.2],
                 [9.0, 9.0, 9.0], [9.1, 9.1, 9.1], [9.2, 9.2, 9.2]]
# fixed values: baskets of the sample FP-growth file
FP_BASKETS = ["r z h k p", "z y x w v u t s", "s x o n r", "x z y m t s q e", "z", "x z y r q t p"]
# fixed values: edges of the sample PageRank file (a star around vertex 1)
PR_EDGES = [(1, 2), (1, 3), (1, 4), (2, 1), (3, 1), (4, 1)]
# fixed values: follower edges and user rows of the sample graph files
FOLLOWERS = [(2, 1), (4, 1), (1, 2), (6, 3), (7, 3), (7, 6), (6, 7), (3, 7)]
USERS = [(1, "BarackObama", "Barack Obama"), (2, "ladygaga", "Goddess of Love"), (3, "jeresig", "John Resig"),
         (4, "justinbieber", "Justin Bieber"), (6, "matei_zaharia", "Matei Zaharia"),
         (7, "odersky", "Martin Odersky"), (8, "anonsys", None)]
# fixed values: the two-block ratings test file (user, item, rating)
ALS_RATINGS = [(1, 1, 5.0), (1, 2, 1.0), (1, 3, 5.0), (1, 4, 1.0), (2, 1, 5.0), (2, 2, 1.0), (2, 3, 5.0),
               (2, 4, 1.0), (3, 1, 1.0), (3, 2, 5.0), (3, 3, 1.0), (3, 4, 5.0), (4, 1, 1.0), (4, 2, 5.0),
               (4, 3, 1.0), (4, 4, 5.0)]
# fixed values: weighted edges of the sample power-iteration-clustering file
PIC_EDGES = [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 0.1),
             (4, 5, 1.0), (4, 15, 1.0), (5, 6, 1.0), (6, 7, 1.0), (7, 8, 1.0), (8, 9, 1.0), (9, 10, 1.0),
             (10, 11, 1.0), (11, 12, 1.0), (12, 13, 1.0), (13, 14, 1.0), (14, 15, 1.0)]


def test_kmeans_sample_centres(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(KMEANS_POINTS)], "id long, features array<double>")
    model = clustering.kmeans_fit(df, 2, seed=1)
    centres = sorted(round(float(c[0]), 6) for c in model.clusterCenters())
    assert centres == [0.1, 9.1]


def test_fpgrowth_sample_has_18_itemsets_and_matches_brute_force(spark):
    rows = [(i, list(dict.fromkeys(b.split()))) for i, b in enumerate(FP_BASKETS)]
    b = spark.createDataFrame(rows, "id int, items array<string>")
    got = {(r["k"], r["freq"]) for r in itemsets.frequent_itemsets(b, 0.5).freqItemsets
           .select(itemsets.itemset_key("items").alias("k"), "freq").collect()}
    assert len(got) == 18
    sets = [set(x) for _, x in rows]
    universe = sorted(set().union(*sets))
    brute = set()
    for size in range(1, len(universe) + 1):
        for combo in combinations(universe, size):
            n = sum(1 for s in sets if set(combo) <= s)
            if n >= 3:
                brute.add((",".join(sorted(combo)), n))
    assert got == brute


def _numpy_pagerank(edges, iters, d=0.85):
    nodes = sorted({x for e in edges for x in e})
    idx = {v: i for i, v in enumerate(nodes)}
    n = len(nodes)
    out = np.zeros(n)
    for s, _ in edges:
        out[idx[s]] += 1
    r = np.full(n, 1.0 / n)
    for _ in range(iters):
        c = np.zeros(n)
        for s, t in edges:
            c[idx[t]] += r[idx[s]] / out[idx[s]]
        r = (1 - d) / n + d * c
    return dict(zip(nodes, r))


def test_pagerank_matches_power_iteration_with_checkpoints(spark):
    e = spark.createDataFrame(PR_EDGES, "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(e, iters=7, checkpoint_every=2).collect()}
    want = _numpy_pagerank(PR_EDGES, 7)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_components_and_degrees_on_follower_graph(spark):
    e = spark.createDataFrame(FOLLOWERS, "src long, dst long")
    comp = {r["node"]: r["component"] for r in graph.connected_components(e, checkpoint_every=1).collect()}
    assert comp == {1: 1, 2: 1, 4: 1, 3: 3, 6: 3, 7: 3}
    users = spark.createDataFrame(USERS, "id long, handle string, name string")
    deg = graph.degrees(e).withColumnRenamed("node", "id")
    joined = {r["handle"]: (r["in_degree"], r["name"]) for r in users.join(deg, "id", "left").collect()}
    assert joined["BarackObama"][0] == 2 and joined["anonsys"] == (None, None)


def test_hub_vertex_is_split_and_results_stay_exact(spark):
    """Vertex 0 has 600 of the ~1,050 edges: its edges are dealt over
    several salts, no partition of the layout holds far more than E / P
    edges, and PageRank / components equal the brute-force replay."""
    edges = [(0, d) for d in range(1, 601)] + [(d, d + 1) for d in range(1, 400)] + \
            [(700 + i, 800 + i) for i in range(50)]
    e = spark.createDataFrame(edges, "src long, dst long")
    P = 8
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    salted, hubs = graph.hub_layout(e, deg, len(edges), P)
    assert {r["src"]: r["n_salts"] for r in hubs.collect()} == {0: -(-600 // -(-len(edges) // P))}
    sizes = [r["n"] for r in salted.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 3 * len(edges) / P
    salted.unpersist()
    got = {r["node"]: r["rank"] for r in graph.pagerank(e, iters=4, checkpoint_every=2).collect()}
    want = _numpy_pagerank(edges, 4)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    comp = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert all(comp[v] == 0 for v in range(0, 601)) and comp[400] == 0
    assert all(comp[700 + i] == comp[800 + i] == 700 + i for i in range(50))


def test_graph_loops_without_broadcast_equal_replay(spark, monkeypatch):
    """Vertex values above the broadcast limit: the rounds shuffle them to
    the edges' (src, salt) layout; results are unchanged."""
    monkeypatch.setattr(graph, "BROADCAST_MAX_ROWS", 0)
    edges = [(0, d) for d in range(1, 301)] + [(d, d + 1) for d in range(1, 200)] + [(500, 501), (501, 500)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.pagerank(e, iters=3).collect()}
    want = _numpy_pagerank(edges, 3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    comp = {r["node"]: r["component"] for r in graph.connected_components(e).collect()}
    assert {comp[v] for v in range(0, 301)} == {0} and comp[500] == comp[501] == 500


def test_graph_jobs_on_an_empty_edge_table(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.pagerank(e, iters=2).collect() == []
    assert graph.connected_components(e).collect() == []


def test_components_run_to_convergence_and_a_cap_never_truncates(spark):
    path = [(i, i + 1) for i in range(12)]  # diameter 12: needs about 12 rounds
    e = spark.createDataFrame(path, "src long, dst long")
    comp = {r["node"]: r["component"] for r in graph.connected_components(e, checkpoint_every=4).collect()}
    assert comp == {v: 0 for v in range(13)}
    with pytest.raises(RuntimeError, match="not stable"):
        graph.connected_components(e, max_iter=3)


def test_components_of_a_long_path_take_few_rounds_and_leave_one_table(spark):
    """10,000 vertices in a row, ids shuffled: rounds grow with the logarithm,
    and the rounds before the last are deleted."""
    n = 10_000
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids[:-1], ids[1:])), "src long, dst long").repartition(8)
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/kiln-star-*"))
    comp = graph.connected_components(e, max_iter=25).collect()
    assert len(comp) == n and {r["component"] for r in comp} == {0}
    assert len(set(glob.glob(f"{base}/kiln-star-*")) - before) == 1


def test_als_recovers_two_taste_blocks(spark):
    r = spark.createDataFrame(ALS_RATINGS, "user int, item int, rating float")
    model = recommend.als_fit(r, rank=2, max_iter=15, reg=0.01, seed=1)
    pred = {(x["user"], x["item"]): x["prediction"] for x in model.transform(r).collect()}
    assert pred[(1, 1)] > 4 and pred[(1, 2)] < 2 and pred[(3, 2)] > 4 and pred[(3, 1)] < 2


def test_pic_sample_splits_clique_from_ring(spark):
    e = spark.createDataFrame(PIC_EDGES, "src long, dst long, weight double")
    out = PowerIterationClustering(k=2, maxIter=40, weightCol="weight").assignClusters(e).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], list(range(4, 16))]


def test_ratings_text_round_trip(spark):
    df = spark.createDataFrame([(1, 10, 5.0, 100), (2, 20, 1.0, 200)], "user int, item int, rating float, ts long")
    path = scratch_path(spark, "t-ratings")
    recommend.write_ratings_text(df, path)
    assert sorted(recommend.read_ratings_text(spark, path).collect()) == sorted(df.collect())


def test_streaming_kmeans_equals_numpy_replay(spark):
    from kiln.streaming.kmeans import StreamingKMeans
    points = {i: [float(i % 3), float(i // 3)] for i in range(12)}
    pts = spark.createDataFrame(sorted(points.items()), "id long, features array<double>")
    src = scratch_path(spark, "t-km")
    pts.repartitionByRange(3, "id").write.parquet(src)
    init = np.array([[0.0, 0.0], [2.0, 3.0]])
    job = StreamingKMeans(init, decay=0.5)
    out = job.run(spark, src, pts.schema, scratch_path(spark, "t-kms"), scratch_path(spark, "t-kmc"))
    assert sum(b["rows"] for b in job.batches) == 12
    c, n = init.copy(), np.zeros(2)
    for b in job.batches:  # same batches, same order, numpy only
        X = np.array([points[i] for i in range(b["min_id"], b["max_id"] + 1)])
        a = ((X[:, None, :] - c[None]) ** 2).sum(-1).argmin(1)
        S = np.array([X[a == j].sum(0) for j in range(2)])
        M = np.array([(a == j).sum() for j in range(2)], dtype=float)
        c, n = clustering.streaming_update(c, n, S, M, 0.5)
    got = np.array([r["centre"] for r in sorted(out.collect(), key=lambda r: r["cluster"])])
    assert np.allclose(got, c, atol=1e-12)
    S = np.array([[1.0, 1.0], [4.0, 6.0]])
    c2, n2 = clustering.streaming_update(init, np.zeros(2), S, np.array([1.0, 2.0]), 0.5)
    assert np.allclose(c2, [[1.0, 1.0], [2.0, 3.0]]) and np.allclose(n2, [1.0, 2.0])


@pytest.mark.parametrize("max_words", [1, 2])
def test_sentiment_stream_equals_batch(spark, max_words):
    from kiln.sources import read_table
    from kiln.streaming.sentiment import run_sentiment_stream
    docs = read_table(spark, SF001, "documents").select("doc_id", "text")
    lex = text.derive_lexicon(docs, read_table(spark, SF001, "labels"), min_docs=2, max_words=max_words)
    batch = {(r["doc_id"], r["score"], r["n_matched"]) for r in text.score_documents(docs, lex).collect()}
    src = scratch_path(spark, "t-docs")
    docs.repartitionByRange(3, "doc_id").write.parquet(src)
    stream = run_sentiment_stream(spark, src, docs.schema, lex, scratch_path(spark, "t-sink"),
                                  scratch_path(spark, "t-ck"))
    got = {(r["doc_id"], r["score"], r["n_matched"]) for r in stream.collect()}
    assert got == batch and len(got) == docs.count()
    assert any(s != 0 for _, s, _ in got)


def _pava(x, y):
    order = np.argsort(x, kind="stable")
    xs, ys = np.asarray(x)[order], np.asarray(y)[order]
    ux, inv = np.unique(xs, return_inverse=True)
    yv = np.array([ys[inv == i].mean() for i in range(len(ux))])
    w = np.array([(inv == i).sum() for i in range(len(ux))], dtype=float)
    blocks = [[yv[i], w[i], [i]] for i in range(len(ux))]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            v = (blocks[i][0] * blocks[i][1] + blocks[i + 1][0] * blocks[i + 1][1]) / (blocks[i][1] + blocks[i + 1][1])
            blocks[i] = [v, blocks[i][1] + blocks[i + 1][1], blocks[i][2] + blocks[i + 1][2]]
            del blocks[i + 1]
            i = max(i - 1, 0)
        else:
            i += 1
    fit = np.zeros(len(ux))
    for v, _, members in blocks:
        fit[members] = v
    return dict(zip(ux, fit))


def test_isotonic_matches_pava(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression
    from kiln.plans.training import doc_features
    d = doc_features(spark, SF001).select("words", "target").collect()
    x = [r["words"] for r in d]
    y = [r["target"] for r in d]
    df = spark.createDataFrame(list(zip(x, y)), "x double, label double") \
        .withColumn("features", array_to_vector(F.array("x")))
    pred = {r["x"]: r["prediction"] for r in IsotonicRegression().fit(df).transform(df).collect()}
    want = _pava(x, y)
    assert all(abs(pred[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("min_docs", [2])
def test_lexicon_scores_are_bounded_integers(spark, min_docs):
    from kiln.sources import read_table
    docs = read_table(spark, SF001, "documents")
    lex = text.derive_lexicon(docs, read_table(spark, SF001, "labels"), min_docs=min_docs).collect()
    assert lex and all(-5 <= r["score"] <= 5 and r["score"] != 0 for r in lex)


# fixed values: phrase, hyphen and apostrophe entries of the sample lexicon
# file, with two of their single words added (score 3 and 1)
PHRASE_LEXICON = [("not good", -2), ("does not work", -3), ("can't stand", -3), ("cover-up", -3),
                  ("once-in-a-lifetime", 3), ("good", 3), ("stand", 1)]


def _greedy_score(tokens, lexicon):
    """Brute force: left to right, the longest entry at each token matches."""
    longest = max(len(k.split(" ")) for k in lexicon)
    i, score, matched = 0, 0, 0
    while i < len(tokens):
        for n in range(min(longest, len(tokens) - i), 0, -1):
            key = " ".join(tokens[i:i + n])
            if key in lexicon:
                score, matched, i = score + lexicon[key], matched + 1, i + n
                break
        else:
            i += 1
    return score, matched


def _py_tokens(s):
    import regex
    return [t for t in regex.split(r"[^\p{L}]+", s.lower()) if t]


def test_phrase_lexicon_longest_match(spark):
    docs = spark.createDataFrame([
        (1, "Not good. Not GOOD at all, good!"),
        (2, "I can't stand a cover-up; a once-in-a-lifetime stand"),
        (3, "It does not work, not good, not"),
        (4, "nothing here"),
        (5, "")], "doc_id long, text string")
    lex = spark.createDataFrame(PHRASE_LEXICON, "term string, score int")
    got = {r["doc_id"]: (r["score"], r["n_matched"]) for r in text.score_documents(docs, lex).collect()}
    assert got == {1: (-1, 3), 2: (-2, 4), 3: (-5, 2), 4: (0, 0), 5: (0, 0)}
    table = {" ".join(_py_tokens(k)): v for k, v in PHRASE_LEXICON}
    for r in docs.collect():
        assert got[r["doc_id"]] == _greedy_score(_py_tokens(r["text"]), table)


def test_phrase_scoring_equals_brute_force(spark):
    from kiln.sources import read_table
    docs = read_table(spark, SF001, "documents").select("doc_id", "text")
    lex = text.derive_lexicon(docs, read_table(spark, SF001, "labels"), min_docs=2, max_words=3)
    table = {r["term"]: r["score"] for r in lex.collect()}
    assert any(" " in k for k in table)
    got = {r["doc_id"]: (r["score"], r["n_matched"]) for r in text.score_documents(docs, lex).collect()}
    want = {r["doc_id"]: _greedy_score(_py_tokens(r["text"]), table) for r in docs.collect()}
    assert got == want


def test_single_word_lexicon_is_plain_sum(spark):
    docs = spark.createDataFrame([(1, "good good not good stand")], "doc_id long, text string")
    lex = spark.createDataFrame([("good", 3), ("stand", 1)], "term string, score int")
    assert [(r["score"], r["n_matched"]) for r in text.score_documents(docs, lex).collect()] == [(10, 4)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_phrase_scoring_on_dense_overlaps_equals_brute_force(spark, seed):
    """Random texts over six words and a random lexicon of 1-3 word entries
    (some written with hyphens): overlapping phrase matches everywhere; every
    document equals the brute-force left-to-right longest match."""
    rng = np.random.default_rng(seed)
    vocab = ["ab", "cd", "ef", "gh", "ij", "kl"]
    entries = {}
    while len(entries) < 14:
        n = int(rng.integers(1, 4))
        words = [vocab[i] for i in rng.integers(0, len(vocab), n)]
        sep = "-" if rng.random() < 0.3 else " "
        entries.setdefault(sep.join(words), int(rng.integers(-5, 6)))
    # entries normalising to one key keep the score of the smallest text
    table = {}
    for term in sorted(entries):
        table.setdefault(" ".join(_py_tokens(term)), entries[term])
    docs = [(i, " ".join(vocab[j] for j in rng.integers(0, len(vocab), int(rng.integers(0, 40)))))
            for i in range(300)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string")
    ldf = spark.createDataFrame(list(entries.items()), "term string, score int")
    got = {r["doc_id"]: (r["score"], r["n_matched"]) for r in text.score_documents(ddf, ldf).collect()}
    assert got == {i: _greedy_score(_py_tokens(t), table) for i, t in docs}


def test_streaming_kmeans_resumes_with_old_and_new_checkpoints(spark):
    """A finished stream adds nothing when restarted; a new checkpoint over
    the same state folds its batches in again; unreadable state raises."""
    from kiln.streaming.kmeans import StreamingKMeans
    pts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, features array<double>")
    src, state, ck = (scratch_path(spark, t) for t in ("t-km", "t-kms", "t-kmc"))
    pts.repartitionByRange(2, "id").write.parquet(src)
    init = np.array([[0.0, 0.0], [5.0, 1.0]])
    first = StreamingKMeans(init)
    first.run(spark, src, pts.schema, state, ck)
    again = StreamingKMeans(init)
    again.run(spark, src, pts.schema, state, ck)
    assert again.batches == [] and np.allclose(again.centres, first.centres)
    fresh = StreamingKMeans(init)
    fresh.run(spark, src, pts.schema, state, scratch_path(spark, "t-kmc"))
    assert sum(b["rows"] for b in fresh.batches) == 6 and fresh.counts.sum() == 12
    bad = scratch_path(spark, "t-bad")
    spark.createDataFrame([("x",)], "v string").write.text(bad)
    with pytest.raises(Exception):
        StreamingKMeans(init).run(spark, src, pts.schema, bad, scratch_path(spark, "t-kmc"))


def test_long_path_takes_few_component_rounds(spark):
    n = 600
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    comp = graph.connected_components(e, max_iter=12).collect()
    assert len(comp) == n + 1 and {r["component"] for r in comp} == {0}


def test_large_ids_are_numbered_before_als(spark):
    big = 2**40
    df = spark.createDataFrame([(big + u, i, r) for u, i, r in ALS_RATINGS], "user long, item long, rating float")
    with pytest.raises(ValueError, match="32 bits"):
        recommend.als_fit(df)
    numbered = recommend.index_ids(df, "user", "uid")
    assert sorted({(r["user"] - big, r["uid"]) for r in numbered.collect()}) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert recommend.als_fit(numbered.drop("user").withColumnRenamed("uid", "user"), rank=2, max_iter=2) is not None


def test_lexicon_file_scores_words_and_phrases(spark):
    path = scratch_path(spark, "t-lex")
    spark.createDataFrame([("good\t3",), ("not good\t-2",), ("Bad\t-3",)], "value string").coalesce(1).write.text(path)
    docs = spark.createDataFrame([(1, "Good good, not good"), (2, "bad"), (3, "none")], "doc_id long, text string")
    out = {r["doc_id"]: (r["score"], r["n_matched"]) for r in
           text.score_documents(docs, text.read_lexicon(spark, path)).collect()}
    assert out == {1: (4, 3), 2: (-3, 1), 3: (0, 0)}


def test_image_files_with_partitions_and_an_invalid_file(spark, tmp_path):
    import struct
    import zlib
    from kiln.sources.files import read_images

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    png = (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0))
           + chunk(b"IDAT", zlib.compress(b"\x00\x01\x02\x03" * 2)) + chunk(b"IEND", b""))
    for name, body in (("cls=kittens/a.png", png), ("cls=kittens/not-image.txt", b"not an image\n"), ("cls=dogs/b.png", png)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = read_images(spark, f"file:{tmp_path}").select("image.width", "image.height", "cls").collect()
    assert sorted(tuple(r) for r in rows) == [(3, 2, "dogs"), (3, 2, "kittens")]


def test_topics_count_every_token_of_every_document(spark):
    """One word per document, each its own term: the topics' term counts add
    up to the tokens and every term has its full count (a sampled iteration
    misses documents and counts others twice)."""
    from kiln.plans.extras import topic_model
    docs = spark.createDataFrame([(i, [f"w{i}"] * (1 + i % 3)) for i in range(60)], "doc_id long, tokens array<string>")
    vocabulary, model = topic_model(docs)
    per_term = model.topicsMatrix().toArray().sum(axis=1)
    want = [1 + int(w[1:]) % 3 for w in vocabulary]
    assert len(vocabulary) == 60
    np.testing.assert_allclose(per_term, want, rtol=1e-6)


@pytest.mark.parametrize("max_words", [1, 2, 3])
def test_large_lexicon_scores_in_blocks(spark, monkeypatch, max_words):
    """Beyond a broadcast the rows are the same, and neither the keys of a
    document nor its matches are shuffled."""
    rng = np.random.default_rng(max_words)
    vocab = ["ab", "cd", "ef", "gh", "ij", "kl"]
    docs = [(i // 2 if i < 20 else i, " ".join(vocab[j] for j in rng.integers(0, 6, int(rng.integers(0, 30))))) for i in range(120)]
    docs += [(None, "ab cd"), (None, "ef"), (500, None), (501, ""), (502, "1 2"), (503, "AB-cd")]
    flags = [(i, int("ab" in t or "cd ef" in t)) for i, t in docs[20:120:2]]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lex = text.derive_lexicon(ddf, spark.createDataFrame(flags, "doc_id long, toxic int"), min_docs=1, max_words=max_words)
    want = sorted(map(tuple, text.score_documents(ddf, lex).collect()), key=str)
    plans, store = [], text.store

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, tag)
    monkeypatch.setattr(text, "store", seen)
    monkeypatch.setattr(text, "BROADCAST_MAX_BYTES", 0)
    monkeypatch.setattr(text, "BLOCK_BYTES", 300)
    own = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    assert sorted(map(tuple, text.score_documents(ddf, lex).collect()), key=str) == want
    assert len(want) == len(docs) and any(score for _, score, _ in want)
    moved = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(" in line]
    dealt = [line for line in moved if "hashpartitioning(_block" in line]  # the layout, in the kept plan, and what was found
    assert len(plans) == 1 and not any("doc_id" in line.split("ENSURE")[0] for line in moved) and dealt
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == own
