"""Substring dedup by repeated-phrase automata.

Recurring passages are confirmed first: windows of ``window`` words whose
sequence also starts elsewhere (see ``repeats``).  Documents are dealt to
shards; each shard compiles an Aho-Corasick automaton of the passages that
its documents can hold, one copy each, and streams all its documents through
it to find every occurrence.  A shard's automaton is no larger than its texts,
and a passage on a third of all documents is one pattern in each shard.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm import repeats as R
from kiln.llm.registry import register
from kiln.llm.tables import documents, packed, total_bytes, written

WINDOW = 35
GRAM = 8
CROWD = 4000  # contexts of an anchor that one task compares: under 2 MB of word hashes
SHARD_BYTES = 2 << 20
COMPARE_BYTES = 4 << 20
_U = np.uint64
_CODES = 500_000  # code points of one alphabet; larger vocabularies take two a word


def _compare(w):
    """Windows of the contexts of an anchor that two contexts hold, or one
    that occurs twice."""
    def compare(table):
        for part in R.pieces_of(table, COMPARE_BYTES):
            words, off = R.content_arrays(part, "words")
            count = np.diff(off) - w + 1
            seg = np.repeat(np.arange(len(part)), count)
            j = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
            s = off[:-1][seg] + j
            fp, at = part.column("fp").to_numpy().view(_U), part.column("at").to_numpy()
            ctx, n = part.column("ctx").to_numpy().view(_U), part.column("n").to_numpy()
            key = G.mix(G.Spans(words).hash(s, s + w) + G.mix(fp[seg] + (at[seg] - j).astype(_U) * _U(0x9E3779B97F4A7C15)))
            who = G.mix(ctx + at.astype(_U))[seg]
            order = np.lexsort((who, key))
            k, first = key[order], None
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
            flags = np.zeros(len(k), bool)
            if len(k):
                last = np.concatenate([first[1:], [len(k)]]) - 1
                hit = who[order][first] != who[order][last]
                hit |= np.maximum.reduceat(n[seg][order], first) > 1
                flags[order] = np.repeat(hit, last - first + 1)
            woff = np.concatenate([[0], np.cumsum(count)])
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).combine_chunks() for c in R.CONTEXT], R.runs_of(flags, woff, w)],
                names=[*R.CONTEXT, "runs"])
    return compare


def recurring_passages(rows: DataFrame, w: int, k: int):
    """(places, ``fp, ctx, at, runs``): the word ranges of each context that
    recurring windows cover."""
    places, contexts = R.repeated_contexts(rows, "words", w, k)
    contexts = written(contexts, "contexts")
    # the only context of its anchor, at several places: recurs as a whole
    whole = contexts.filter("others = 1").select(
        *R.CONTEXT, F.array(F.struct(F.lit(0).alias("lo"), F.col("len").alias("hi"))).alias("runs"))
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = contexts.filter(F.col("others").between(2, CROWD))
    plain = (R.with_content(some, rows, "words", w).repartition(shards, "fp").sortWithinPartitions("fp")
             .select(*R.CONTEXT, "n", "content")
             .mapInArrow(R.by_anchor(_compare(w)), f"fp long, ctx long, at int, runs {R.RUNS}"))
    out = whole.unionByName(plain)
    crowded = contexts.filter(F.col("others") > CROWD)
    if not crowded.isEmpty():
        out = out.unionByName(R.crowded_runs(R.with_content(crowded, rows, "words", w, few=True), "words", w,
                                              CROWD, _compare(w), later=False))
    return places, written(out.filter(F.size("runs") > 0).dropDuplicates(R.CONTEXT), "passages")


def _spell(words, vocabulary):
    """Words as text: a character a word (two beyond _CODES words), 0 for
    words that no passage has."""
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    code = np.where(vocabulary[at] == words, at + 1, 0) if len(vocabulary) else np.zeros(len(words), np.int64)
    if len(vocabulary) >= _CODES:
        code = np.stack([code // _CODES, code % _CODES + _CODES], axis=1).ravel()
    point = code + 0x100
    point = np.where(point >= 0xD800, point + 0x800, point)
    return point.astype("<u4").tobytes().decode("utf-32-le")


def _locate(w, with_text):
    def run(key, docs: pa.Table, passages: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        data, offs = G.unpacked(docs.column("text").combine_chunks())
        starts, ends, woff = G.word_spans(data, offs, G.SPACE)
        words = G.word_hashes(data, starts, ends)
        row_of = {k: i for i, k in enumerate(docs.column("row_key").to_pylist())}
        ranges, single = [], []
        for k, runs, start, times in zip(*[passages.column(c).to_pylist() for c in ("row_key", "runs", "start", "times")]):
            if k in row_of:
                base = int(woff[row_of[k]]) + start
                (single if times == 1 else ranges).extend((base + r["lo"], base + r["hi"]) for r in runs)
        # passages that this shard holds once, where they overlap, are one
        # longer passage: they can only be found there
        for a, b in sorted(single):
            if ranges and ranges[-1][2:] and a < ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(b, ranges[-1][1]), True)
            else:
                ranges.append((a, b, True))
        ranges = [r[:2] for r in ranges]
        removed = np.zeros(len(words), bool)
        if ranges:
            vocabulary = np.unique(np.concatenate([words[a:b] for a, b in ranges]))
            width = 2 if len(vocabulary) >= _CODES else 1
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for a, b in ranges:
                automaton.add_word(_spell(words[a:b], vocabulary), int(b - a))
            automaton.make_automaton()
            cover = np.zeros(len(words) + 1, np.int32)
            for i in range(len(offs) - 1):
                a, b = woff[i], woff[i + 1]
                if b - a < w:
                    continue
                found = list(automaton.iter(_spell(words[a:b], vocabulary)))
                if found:
                    hit = np.array(found, np.int64)
                    stop = a + (hit[:, 0] + 1) // width
                    np.add.at(cover, stop - hit[:, 1], 1)
                    np.add.at(cover, stop, -1)
            removed = np.cumsum(cover)[:-1] > 0
        sha, kept, gone = [], [], []
        raw = data.tobytes()
        for i in range(len(offs) - 1):
            own = raw[offs[i]:offs[i + 1]].split()
            drop = removed[woff[i]:woff[i + 1]]
            if drop.any():
                own = [x for x, d in zip(own, drop.tolist()) if not d]
            text = b" ".join(own)
            gone.append(int(drop.sum())), sha.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode("utf-8", "replace") if with_text else None)
        return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(np.diff(woff), pa.int64()),
                         "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()),
                         "kept": pa.array(kept, pa.string())})
    return run


def phrase_dedup(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, gram=GRAM,
                 with_text=True) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256,
    kept`` (kept words joined by one space).

    A word goes if a window of ``window`` words that covers it has a sequence
    that also starts elsewhere, judged on the input.  Null text has no words;
    shorter texts stay whole; repeated rows are copies of each other.  Only
    the id and text columns are read.  An empty table gives no rows."""
    n, size = total_bytes(docs, text_col)
    shards = max(1, -(-size // SHARD_BYTES), -(-n // 20_000))
    rows = R.keyed(docs, id_col, text_col)
    places, passages = recurring_passages(rows, window, gram)
    shard = F.pmod(F.xxhash64("row_key"), F.lit(shards))
    # one place a shard for each context: a passage on many documents is one
    # pattern, reduced before it shuffles
    held = (places.groupBy(shard.alias("shard"), *R.CONTEXT).agg(
        F.min(F.struct("row_key", "start")).alias("p"), F.count(F.lit(1)).alias("times"))
            .join(passages, R.CONTEXT).select("shard", "p.row_key", "p.start", "times", "runs"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return packed(rows).withColumn("shard", shard).groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(
        _locate(window, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


@register("op5_phrase_dedup")
def op5_phrase_dedup(spark, sf_dir):
    return phrase_dedup(documents(spark, sf_dir), with_text=False).drop("kept")
