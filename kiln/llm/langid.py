"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed byte trigrams of lower-cased
letters, learnt from all training rows.  A document is a mixture: expectation
maximisation estimates the language proportions from the n-gram likelihoods,
and the language set is chosen by penalised likelihood (a language is added
while the log-likelihood gains more than a BIC penalty).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import grams as G
from kiln.llm.registry import register
from kiln.llm.tables import documents, held_out, text_of

BUCKETS = 1 << 13
EM_ROUNDS = 12
MAX_LANGS = 1000  # languages of a model; more raise instead of growing the broadcast
SMOOTH = 0.5

_LETTER = np.zeros(256, np.uint8)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_CODE = G.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_CODE[0] = 0


def gram_counts(data, offs):
    """(row, bucket, count) of a chunk, sorted by row: trigrams over lower-
    cased letters, other bytes read as one blank; at least one byte of a
    trigram is a letter."""
    n = len(data)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    c = _LETTER[data]
    a, b, d = _CODE[c[:-2]], _CODE[c[1:-1]], _CODE[c[2:]]
    h = G.mix(a * np.uint64(3) + b * np.uint64(0x10000000000001B3) + d * np.uint64(0x9E3779B97F4A7C15))
    bucket = (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    ok = (rows[:-2] == rows[2:]) & ((c[:-2] > 0) | (c[1:-1] > 0) | (c[2:] > 0))
    key, count = np.unique(rows[:-2][ok] * BUCKETS + bucket[ok], return_counts=True)
    return key // BUCKETS, key % BUCKETS, count.astype(np.float64)


def _em(weight, like, start, rows_of, n, rounds=EM_ROUNDS):
    """Mixture proportions and log-likelihood of every row.  ``like`` is
    (entries, languages), ``start`` the (rows, languages) first guess (zeros
    stay out), ``rows_of`` the row of each entry, ``weight`` its count."""
    pi = start
    total = np.maximum(np.bincount(rows_of, weight, minlength=n), 1e-12)
    for _ in range(rounds):
        part = pi[rows_of] * like
        part *= (weight / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        pi = np.stack([np.bincount(rows_of, part[:, j], minlength=n) for j in range(like.shape[1])], axis=1)
        pi /= total[:, None]
    ll = np.bincount(rows_of, weight * np.log(np.maximum((pi[rows_of] * like).sum(axis=1), 1e-300)), minlength=n)
    return pi, ll


def infer(data, offs, table):
    """(mixture of the chosen set per row, rows without a letter gram)."""
    n, langs = len(offs) - 1, table.shape[1]
    rows, buckets, weight = gram_counts(data, offs)
    like = table[buckets]
    size = np.bincount(rows, weight, minlength=n)
    single = np.stack([np.bincount(rows, weight * np.log(like[:, j]), minlength=n) for j in range(langs)], axis=1)
    # grow each row's set by the language that gains most, while that pays
    first = single.argmax(axis=1)
    chosen = np.zeros((n, langs), bool)
    chosen[np.arange(n), first] = True
    best = np.zeros((n, langs))
    best[np.arange(n), first] = 1.0
    best_ll = single[np.arange(n), first]
    penalty = 0.5 * np.log(np.maximum(size, 2)) + 2.0
    open_ = size > 0
    for k in range(2, langs + 1):
        if not open_.any():
            break
        next_ll, next_pi, added = np.full(n, -np.inf), np.zeros((n, langs)), np.zeros(n, np.int64)
        for j in range(langs):
            todo = np.flatnonzero(open_ & ~chosen[:, j])
            if not len(todo):
                continue
            local = np.full(n, -1)
            local[todo] = np.arange(len(todo))
            pick = local[rows] >= 0
            start = chosen[todo] / k
            start[:, j] = 1.0 / k
            pi, ll = _em(weight[pick], like[pick], start, local[rows[pick]], len(todo))
            ahead = ll > next_ll[todo]
            next_ll[todo[ahead]], next_pi[todo[ahead]], added[todo[ahead]] = ll[ahead], pi[ahead], j
        open_ &= next_ll - best_ll > penalty
        best[open_], best_ll[open_] = next_pi[open_], next_ll[open_]
        chosen[open_, added[open_]] = True
    return best, size == 0


def _count_grams(batches):
    totals: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offs = G.text_buffer(batch.column(1))
        for lo, hi in G.chunks(offs):
            rows, buckets, weight = gram_counts(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
            names = langs[lo:hi]
            for name in set(names):
                of = np.array([x == name for x in names])
                pick = of[rows]
                texts[name] = texts.get(name, 0) + int(of.sum())
                totals.setdefault(name, np.zeros(BUCKETS))
                totals[name] += np.bincount(buckets[pick], weight[pick], minlength=BUCKETS)
    for name, counts in totals.items():
        used = np.flatnonzero(counts)
        # the bucket -1 counts the texts
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (len(used) + 1), pa.string()), pa.array(np.append(used, -1).astype(np.int32)),
             pa.array(np.append(counts[used], float(texts[name])))], names=["lang", "bucket", "n"])


class Model:
    """``table``: gram distributions; ``shares``: of the training texts."""

    def __init__(self, langs: list[str], table: np.ndarray, shares: np.ndarray):
        self.langs, self.table, self.shares = langs, table, shares


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Gram distributions of every language of the rows that are not held
    out.  The model has BUCKETS numbers a language, however much is read."""
    train = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col)).select(
        F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    counts = (train.mapInArrow(_count_grams, "lang string, bucket int, n double")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    rows = counts.limit(MAX_LANGS * (BUCKETS + 1) + 1).collect()
    langs = sorted({r["lang"] for r in rows})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    at = {name: j for j, name in enumerate(langs)}
    texts = np.zeros(len(langs))
    for r in rows:
        if r["bucket"] < 0:
            texts[at[r["lang"]]] += r["n"]
        else:
            table[r["bucket"], at[r["lang"]]] += r["n"]
    return Model(langs, table / table.sum(axis=0), texts / max(1, texts.sum()))


def language_mixture(docs: DataFrame, model: Model, keep: list, text_col="text") -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (its proportion) and
    ``mixture`` (the chosen set with proportions)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, text_of(text_col).alias("text_"))

    def run(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            data, offs = G.text_buffer(batch.column(batch.num_columns - 1))
            for lo, hi in G.chunks(offs):
                part, o = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                n = hi - lo
                if m.langs:
                    pi, none = infer(part, o, m.table)
                    # letters but no gram: no evidence, so the training shares speak
                    pi[none] = np.where(np.arange(len(m.langs)) == m.shares.argmax(), m.shares, 0.0)
                else:
                    pi, none = np.zeros((n, 1)), np.ones(n, bool)
                letters = np.concatenate([[0], np.cumsum(_LETTER[part] > 0)])
                none = letters[o[1:]] == letters[o[:-1]] if m.langs else none
                top = np.where(none, len(m.langs), pi.argmax(axis=1))
                share = np.where(none, 0.0, pi.max(axis=1))
                row, col = np.nonzero((pi > 0) & ~none[:, None])
                inside = pa.StructArray.from_arrays(
                    [pa.array(list(names[col]), pa.string()), pa.array(pi[row, col])], names=["lang", "share"])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(lo, n) for i in range(batch.num_columns - 1)],
                     pa.array(list(names[top]), pa.string()), pa.array(share),
                     G.row_lists(np.bincount(row, minlength=n), inside)],
                    names=[*batch.schema.names[:-1], "lang_pred", "score", "mixture"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(
        run, f"{schema}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, mixture``.

    ``und`` with score 0 where the text is null, empty or has no letter (a
    letter: A-Z, a-z or any character beyond ASCII that is a letter), or
    where nothing could be learnt.  A text with a letter but too short for a
    gram (``ok``) gets the language of most training texts, with that
    language's share of them as its score.  Null languages are not learnt from;
    repeated rows count as often as they occur and get equal results.  Other
    columns are not read.  An empty table gives no rows."""
    model = fit(docs, id_col, text_col, lang_col)
    letters = text_of(text_col).rlike(r"\p{L}")
    out = language_mixture(docs, model, [F.col(id_col).alias("doc_id"), letters.alias("has_letter")], text_col)
    return out.select("doc_id", held_out("doc_id").alias("held_out"),
                      F.when(F.col("has_letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(F.col("has_letter"), F.col("score")).otherwise(0.0).alias("score"), "mixture")


@register("op6_language_id")
def op6_language_id(spark, sf_dir):
    return identify(documents(spark, sf_dir))
