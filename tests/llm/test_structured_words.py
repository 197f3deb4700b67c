"""Sequences on which polynomial hashes modulo 2^64 collide for every base."""

import hashlib
import random

import numpy as np
import pytest
from llm import brute

from kiln.llm import grams as G
from kiln.llm import jaccard, phrase_dedup, repeats, suffix_dedup
from kiln.llm.decontaminate import decontaminate

SWAP = str.maketrans("ab", "ba")


def thue_morse(n, a="a"):
    text = a
    while len(text) < n:
        text += text.translate(SWAP)
    return text[:n]


# a pair of unequal words of each length, and words about the length where hashing changes
PAIRS = [(thue_morse(n), thue_morse(n, "b")) for n in (256, 512, 1024, 2048, 4096)]
LONG_WORDS = ["x" * n for n in (511, 512, 513, 1023, 1024, 5000)] + ["x" * 511 + "y", "x" * 4999 + "y", "é" * 600]


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def documents(seed):
    """Pairs of documents that differ only in structured words."""
    rng = random.Random(seed)
    docs = []
    for a, b in PAIRS:
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(40)]
        for word in (a, b):
            docs.append(" ".join(word if i % 3 == 1 else w for i, w in enumerate(base)))
    docs += [" ".join(rng.sample(LONG_WORDS, 6)) for _ in range(12)]
    docs += [" ".join(thue_morse(1100, c)) for c in "ab"] + [" ".join(thue_morse(1500, c)) for c in "ab"]
    return list(enumerate(docs, 100))


def test_words_have_own_hashes():
    words = [w for p in PAIRS for w in p] + LONG_WORDS
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = G.word_spans(data, np.array([0, len(data)]), G.SPACE)
    hashes = G.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words)
    again = G.word_hashes(data, starts[::-1], ends[::-1])
    assert (again[::-1] == hashes).all()


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_spans_of_structured_symbols_have_own_hashes(n):
    a, b = (np.frombuffer(thue_morse(n, c).encode(), np.uint8) for c in "ab")
    whole = np.array([0]), np.array([n])
    one, two = G.Spans(G.BYTE_CODE[a]), G.Spans(G.BYTE_CODE[b])
    assert one.hash64(*whole) == two.hash64(*whole)  # the second hash alone does not do
    assert one.hash(*whole) != two.hash(*whole)


def test_products_modulo_the_prime():
    rng, p = random.Random(1), (1 << 61) - 1
    a, b = ([rng.randrange(p) for _ in range(500)] + [0, 1, p - 1] for _ in range(2))
    got = G.mul61(np.array(a, np.uint64), np.array(b, np.uint64)).tolist()
    assert got == [x * y % p for x, y in zip(a, b)]
    assert G.reduce61(np.array([p, p + 1, 2 ** 64 - 1], np.uint64)).tolist() == [0, 1, (2 ** 64 - 1) % p]


def test_span_hashes_do_not_depend_on_their_place():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    s[500:800] = s[100:400]
    spans = G.Spans(s)
    start, end = np.array([100, 500, 101]), np.array([400, 800, 401])
    x, y, z = spans.hash(start, end)
    assert x == y != z and G.Spans(s[100:]).hash(np.array([0]), np.array([300]))[0] == x
    c = G.content_hashes(s, start, end)
    assert c[0] == c[1] != c[2]


def test_jaccard_keeps_them_apart(spark, make_docs):
    docs = documents(1)
    got = rows_of(jaccard.jaccard_join(make_docs(docs)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.components(docs, 4, 85, 100), key=repr)
    assert all(got[2 * i][2] != got[2 * i + 1][2] for i in range(len(PAIRS)))


@pytest.mark.parametrize("window,gram,crowd", [(35, 8, 4000), (1024, 8, 4000), (35, 8, 1)])
def test_phrases_keep_them_apart(spark, make_docs, monkeypatch, window, gram, crowd):
    monkeypatch.setattr(phrase_dedup, "CROWD", crowd)
    docs = documents(2)
    out = phrase_dedup.phrase_dedup(make_docs(docs), window=window, gram=gram)
    got = rows_of(out, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.phrases(docs, window), key=repr)


@pytest.mark.parametrize("crowd", [1000, 1])
def test_substrings_keep_them_apart(spark, make_docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    docs = [(d, t) for d, t in documents(3) if len(t) < 20_000] + [(900 + i, w) for i, p in enumerate(PAIRS) for w in p]
    out = suffix_dedup.suffix_dedup(make_docs(docs))
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == \
        sorted(brute.suffix(docs, 400), key=repr)


def test_windows_counted_one_by_one_keep_them_apart(spark):
    """The last way out of a crowded core, called directly."""
    contents = [w.encode() for p in PAIRS[2:4] for w in p]
    rows = [(1, i, 0, 1, (False, i, b"k", 0), bytearray(c)) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "fp long, ctx long, at int, n long, first struct<no_id:boolean,doc_id:long,"
                                     "row_key:binary,start:int>, content binary")
    got = {r["ctx"]: sum(x["hi"] - x["lo"] for x in r["runs"]) for r in repeats.window_runs(df, "bytes", 1024).collect()}
    seen = [c[i:i + 1024] for c in contents for i in range(len(c) - 1023)]
    for i, c in enumerate(contents):
        again = any(seen.count(c[j:j + 1024]) > 1 for j in range(len(c) - 1023))
        assert (i in got) == again


def test_decontamination_keeps_them_apart(spark, make_docs):
    items = [(i, " ".join([a] + [f"v{i}x{j}" for j in range(9)])) for i, (a, _) in enumerate(PAIRS)]
    items += [(50 + i, a) for i, (a, _) in enumerate(PAIRS)]  # one word, a whole item
    docs = [(10 + i, " ".join([b] + [f"v{i}x{j}" for j in range(9)])) for i, (_, b) in enumerate(PAIRS)]
    docs.append((99, "before " + items[2][1] + " after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r["doc_id"]: r for r in decontaminate(make_docs(docs), bench).collect()}
    assert [d for d, r in out.items() if r["contaminated"]] == [99] and out[99]["n_hit"] == 10
    assert out[99]["items_sha256"] == hashlib.sha256(b"2,52").hexdigest()
