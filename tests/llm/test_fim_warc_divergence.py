"""Operators 11 to 13 against plain versions, round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kiln.llm import divergence as D
from kiln.llm import fim, warc
from kiln.session import scratch_path

LONG = " ".join(f"w{i % 977}é{i % 31}" for i in range(20000))
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def clashing(df):
    return df.selectExpr("*", *[f"'x' AS {c}" for c in ("n", "form", "OUTPUT", "c0", "c1", "term", "page", "digest")])


# op11 ----------------------------------------------------------------------
FIM_DOCS = [(1, None), (2, ""), (3, "a"), (4, "é"), (5, "漢字 mixed 😀 wörds\nand\ttabs"), (6, "has <P> inside"), (7, "x <S"),
            (8, "<"), (9, "P>S>M> <<<P"), (9, "P>S>M> <<<P"), (None, "no id"), (10, LONG), (11, "\x00\x7f 0"),
            (12, "é" * 3000), (13, "\U0010ffffࠀ߿\u0080")] + [
    (100 + i, "".join(random.Random(i).choices("abZ é漢😀<>PSM \n", k=i))) for i in range(120)]


def fim_plain(docs, unit="token", percent=90, spm=20):
    out = []
    for d, t in docs:
        t = t or ""
        h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t) if unit == "token" else list(t)
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
            out.append((d, len(units), "plain", None, None, t, t))
        elif h[3] % 100 < spm:
            out.append((d, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            out.append((d, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("unit", ["token", "char"])
@pytest.mark.parametrize("percent,spm", [(90, 20), (100, 50)])
def test_fill_in_middle(spark, make_docs, unit, percent, spm):
    docs = make_docs(FIM_DOCS)
    out = fim.fill_in_middle(docs, unit=unit, fim_percent=percent, spm_percent=spm)
    back = out.withColumn("back", fim.restored("form", "output"))
    got = rows_of(back, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back")
    assert got == fim_plain(FIM_DOCS, unit, percent, spm)
    assert {"psm", "spm", "plain"} == {r[2] for r in got}


def test_fill_in_middle_edges(spark, make_docs):
    docs = clashing(make_docs(FIM_DOCS))
    out = fim.fill_in_middle(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    n, form, prefix, middle, output = fim.fim_columns(docs)
    assert n == "n_" and output.lower() not in {c.lower() for c in docs.columns}
    assert rows_of(out, "doc_id", n, form, output) == sorted(((r[0], r[1], r[2], r[5]) for r in fim_plain(FIM_DOCS)), key=repr)
    assert fim.fill_in_middle(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, unit="word")


def test_exception_index_converts_both_ways():
    text = "aé漢😀b" * 50 + "plain ascii tail"
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions(raw)
    chars = np.arange(len(text) + 1)
    want = np.array([len(text[:c].encode()) for c in chars])
    assert (index.to_bytes(chars) == want).all() and (index.to_chars(want) == chars).all()
    assert len(index.at) == 150  # only the multibyte characters are recorded


# op12 ----------------------------------------------------------------------
def fake(body, magic="WARC/1.0"):
    return f"{magic}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


NASTY = [
    "x" * 150 + "\r\n\r\n" + fake("a whole record inside") + "tail",
    "\r\n" + fake("y" * 300) * 5,
    fake("at the very start") + "z" * 120,
    "ends with a magic " + "q" * 100 + "\r\nWARC/1.0\r\n",
    "\r\nWARC/1." * 40, "\r\nWARC/1.1\r\n\r\n" * 20, "WARC/1.0\r\n",
    "liar\r\n\r\nWARC/1.0\r\nContent-Length: 99999999999\r\n\r\n" + "k" * 100,
    "\r\n" * 200, "\r\nWWARC/1.0\r\nWARC/1\r\nWARC/", "é漢😀\x00" * 60,
]
PAGES = ([(i, f"http://h/{i} x\r\nWARC/1.0\r\n", t) for i, t in enumerate(NASTY)]
         + [(50, None, None), (51, "http://e", ""), (52, "http://e", ""), (53, "u", "short"), (54, "u", "short")]
         + [(60 + i, f"http://copy/{i}", "copy " * 30) for i in range(40)]
         + [(59, "http://copy/first", "copy " * 30), (None, "http://copy/none", "copy " * 30)]
         + [(7000, "same", "repeated row " * 20)] * 7 + [(7001, "same", "repeated row " * 20)]
         + [(8000, "b", "one id, two urls" * 10), (8000, "a", "one id, two urls" * 10)]
         + [(9000, "long", "very long " * 60000), (9001, "long", NASTY[1] * 300), (9002, "again", NASTY[1] * 300)])


def warc_plain(pages):
    groups = defaultdict(list)
    for i, (p, u, h) in enumerate(pages):
        if len((h or "").encode()) >= 100:
            groups[h].append((p is None, p or 0, u or "", i))
    out = []
    for i, (p, u, h) in enumerate(pages):
        raw = (h or "").encode()
        keep = min(groups[h])[3] if h in groups else i
        out.append((p, len(raw), sha(raw), "response" if keep == i else "revisit", None if keep == i else pages[keep][0]))
    return sorted(out, key=repr)


@pytest.fixture
def small_ranges(spark):
    """Archives are read in ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "331b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def page_table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def digest(records):
    cut = lambda r, c: int(r[c][10:-1]) if r[c] and r[c] != "<urn:page:>" else None
    return sorted(((cut(r, "record_id"), r["full_bytes"], r["full_sha256"], r["record_type"], cut(r, "refers_to"))
                   for r in records.collect()), key=repr)


def test_warc_round_trip(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_warc(clashing(page_table(spark, PAGES).repartition(3)), path)
    records = warc.read_warc(spark, path)
    assert digest(warc.resolve_revisits(records)) == warc_plain(PAGES)
    for r in records.collect():
        assert sha(bytes(r["payload"])) == r["payload_sha256"] and len(r["payload"]) == r["payload_bytes"]
        assert (r["record_type"] == "revisit") == (r["refers_to"] is not None)


@pytest.mark.parametrize("payloads", [False, True])
def test_records_and_payloads_over_many_ranges(spark, small_ranges, payloads):
    """Magics, headers and payloads are cut by range ends everywhere."""
    pages = [p for p in PAGES if p[0] is None or p[0] < 8500]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(page_table(spark, pages).coalesce(2), path)
    records = warc.read_warc(spark, path, payloads=payloads)
    assert digest(warc.resolve_revisits(records)) == warc_plain(pages)


def test_warc_edges(spark):
    path = scratch_path(spark, "test-warc")
    warc.write_warc(page_table(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0
    bad = scratch_path(spark, "test-warc")
    whole = fake("a record") * 3
    spark.createDataFrame([(whole[:-6],)], "value string").write.option("lineSep", "#").text(bad)
    with pytest.raises(ValueError, match="end of the file"):
        warc.read_warc(spark, bad)
    mixed = scratch_path(spark, "test-warc")
    spark.createDataFrame([(fake("a", "WARC/1.1") + fake("b") + fake("c")[:-4],)], "value string") \
        .write.option("lineSep", "\r\n\r\n").text(mixed)
    assert rows_of(warc.read_warc(spark, mixed), "payload") == [(b"a",), (b"b",), (b"c",)]


def test_a_changed_payload_is_refused(spark):
    path = scratch_path(spark, "test-warc")
    text = fake("body").replace("Content-Length", f"WARC-Payload-Digest: sha256:{sha('other')}\r\nContent-Length")
    spark.createDataFrame([(text[:-4],)], "value string").write.option("lineSep", "\r\n\r\n").text(path)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.resolve_revisits(warc.read_warc(spark, path)).collect()


# op13 ----------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence_plain(docs, min_docs, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(AZ))
        groups[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        all_of = {t: sum(count[lang, s][t] for s in sources) for t in kept}

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}
        q = p(all_of)
        each = {s: p(count[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            term = [(q[t] - each[s][t], t.encode()) for t in kept if count[lang, s][t] > 0 and each[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:limit])]
    return sorted(out, key=repr)


def audit_docs(seed, n_docs, n_sources):
    rng = random.Random(seed)
    words = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["é", "漢字", "Éa", "ÉA", "WORD", "word"]
    docs = [(" 1-".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "de", None]),
             f"s{min(rng.randrange(n_sources), rng.randrange(n_sources))}") for _ in range(n_docs)]
    return docs + [(None, "en", "empty"), ("", "xx", None), ("123 456", "xx", "b"), ("only here", "yy", "z"),
                   (docs[0][0], "en", "s0"), (docs[0][0], "en", "s0"), (LONG, "en", "s1")]


COLS = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("tile", [256, 3])
def test_divergence(spark, tile):
    """Blocks of 3 sources change nothing."""
    docs = audit_docs(1, 300, 8)
    table = clashing(spark.createDataFrame(docs, "text string, lang string, source string").repartition(5))
    for min_docs, top in ((3, 7), (1, 50), (10 ** 6, 5)):
        got = rows_of(D.divergence(table, min_docs=min_docs, top=top, tile=tile), *COLS)
        assert got == divergence_plain(docs, min_docs, top)


def test_partial_counts_and_slices():
    """The scan function with early flushes and short slices."""
    texts = ["Abc abc " + "x" * 30 + " é漢 ZZ", "", "abc"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s", "s", "r"]),
                                        pa.array([t.encode() for t in texts])], names=["lang", "source", "text"])
    total, groups = Counter(), set()
    for out in D._count_terms(flush=5, piece=8)(iter([batch, batch])):
        for r in out.to_pylist():
            if r["term"] is None:
                groups.add((r["lang"], r["source"]))
            else:
                total[r["source"], r["term"]] += r["n"]
                total[r["source"], r["term"], "docs"] += r["docs"]
    assert groups == {("en", "s"), ("en", "r")}
    assert total["s", "abc"] == 4 and total["s", "abc", "docs"] == 2 and total["r", "abc"] == 2
    assert total["s", "x" * 30] == 2 and total["s", "é漢"] == 2 and total["s", "zz"] == 2


def test_divergence_of_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    n = 9_000_000_000_000_000
    df = spark.createDataFrame([(n, 3 * n, 7)], "c long, t long, v long")
    assert df.select(D.smoothed("c", "t", "v").alias("p")).first()["p"] == 1 + 10 ** 9 * (n + 5) // (3 * n + 35)


def test_divergence_of_an_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
