"""Fill-in-middle transformation with a sparse exception index.

A text is cut at two token positions into prefix, middle and suffix and put
out as ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle``
(spm).  Cuts are found in the bytes of an Arrow batch and wanted in code
points as well.  Only characters of more than one byte make the two differ,
so only those are recorded: their byte positions and their excess bytes.  A
position is converted by one ``searchsorted`` in that list; inside ASCII spans
the conversion is plain arithmetic.

Every draw is a function of the document's id, so a retried task or another
partitioning gives the same output.  One scan, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.grams import chunks, text_buffer
from kiln.llm.registry import register
from kiln.llm.tables import documents, fresh, text_of

# fixed values of the output format
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

SEED = 1
FIM_PERCENT = 90   # of the documents are transformed
SPM_PERCENT = 20   # of those have the suffix in front

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = True
_LETTER[0x61:0x7B] = True


class Exceptions:
    """Byte and code-point positions of one UTF-8 buffer.

    ``at`` has the byte positions of the characters of more than one byte,
    ``excess`` the bytes beyond one of all such characters before each of
    them (and, last, of all)."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(extra)]).astype(np.int64)
        self.chars_at = self.at - self.excess[:-1]

    def to_chars(self, cut: np.ndarray) -> np.ndarray:
        """Code points before the byte positions ``cut`` (character starts)."""
        return cut - self.excess[np.searchsorted(self.at, cut)]

    def to_bytes(self, cut: np.ndarray) -> np.ndarray:
        """Bytes before the code-point positions ``cut``."""
        return cut + self.excess[np.searchsorted(self.chars_at, cut)]


def token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where the tokens ``[A-Za-z]+|[^A-Za-z]`` start."""
    letter = _LETTER[data]
    inner = np.zeros(len(data), bool)
    inner[1:] = letter[1:] & letter[:-1]
    first = offs[:-1]
    inner[first[first < len(data)]] = False
    return np.flatnonzero(~inner & ((data & 0xC0) != 0x80))


def cut_rows(data: np.ndarray, offs: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "token"):
    """Per row: number of units, and the byte and code-point positions in
    the row of its two cuts."""
    index = Exceptions(data)
    base = index.to_chars(offs)
    if unit == "token":
        starts = np.append(token_starts(data, offs), len(data))
        row = np.searchsorted(starts[:-1], offs)
        n = np.diff(row)
    else:
        n = np.diff(base)
    drawn = h1 % (n + 1), h2 % (n + 1)
    cuts = []
    for k in (np.minimum(*drawn), np.maximum(*drawn)):
        # the token after a row's last starts where the next text does
        at = starts[row[:-1] + k] if unit == "token" else index.to_bytes(base[:-1] + k)
        cuts.append((at - offs[:-1], index.to_chars(at) - base[:-1]))
    return n, cuts


def _transform(unit: str, fim_percent: int, spm_percent: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for batch in batches:
            # the last five columns are the text and the four draws
            data, offs = text_buffer(batch.column(batch.num_columns - 5))
            draws = [batch.column(batch.num_columns - 4 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            for lo, hi in chunks(offs):
                part, at = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
                h1, h2, h3, h4 = (d[lo:hi] for d in draws)
                n, ((a, prefix), (b, upto)) = cut_rows(part, at, h1, h2, unit)
                raw = part.tobytes()
                forms, outputs, plain = [], [], np.zeros(hi - lo, bool)
                for i in range(hi - lo):
                    text = raw[at[i]:at[i + 1]]
                    if not text or h3[i] % 100 >= fim_percent or any(m in text for m in marks):
                        plain[i] = True
                        forms.append("plain")
                        outputs.append(text)
                        continue
                    head, body, tail = text[:a[i]], text[a[i]:b[i]], text[b[i]:]
                    if h4[i] % 100 < spm_percent:
                        forms.append("spm")
                        outputs.append(b"".join((marks[1], tail, marks[0], head, marks[2], body)))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((marks[0], head, marks[1], tail, marks[2], body)))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:-5], pa.array(n.astype(np.int64)), pa.array(forms, pa.string()),
                     pa.array(prefix.astype(np.int64), mask=plain), pa.array((upto - prefix).astype(np.int64), mask=plain),
                     pa.array(outputs, pa.binary()).cast(pa.string())],
                    names=[*rows.schema.names[:-5], "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def draws(id_col: str, seed: int = SEED) -> list:
    """Four unsigned 32-bit draws from the hex SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fim_columns(docs: DataFrame) -> list[str]:
    """Names of the five columns that ``fill_in_middle`` adds: the number of
    units, the form, the code points of prefix and middle, the output."""
    return [fresh(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token",
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """``docs`` with every column and the five of ``fim_columns``.

    Units are the tokens ``[A-Za-z]+|[^A-Za-z]`` or, with ``unit="char"``,
    code points.  The prefix ends after the smaller and the middle after the
    larger of two draws over 0..n units; parts may be empty.  Null text
    counts as empty; empty texts and texts that contain a mark stay plain, as
    do those beyond ``fim_percent``; plain rows have null part lengths.  A
    null id draws as the empty text; rows that repeat an id draw alike.
    Texts are cut whole, one at a time when longer than a chunk.  An empty
    table gives no rows."""
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    n, form, prefix, middle, output = fim_columns(docs)
    schema = T.StructType([
        *[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)],
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType())])
    rows = docs.select("*", text_of(text_col), *draws(id_col, seed))
    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]) \
        .mapInArrow(_transform(unit, fim_percent, spm_percent), schema) \
        .toDF(*docs.columns, n, form, prefix, middle, output)


def restored(form: str, output: str):
    """The text rebuilt from an output and its form alone.  A text that holds
    a mark is plain and no mark overlaps itself or another, so the marks of
    an output are those that were put there."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    return (F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col(output)))


@register("op11_fill_in_middle", sql=r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS tok FROM d),
c AS (SELECT *, len(tok) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tok) + 1) AS x,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tok) + 1) AS y,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS z,
             CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS w FROM k),
p AS (SELECT *, array_to_string(tok[1:least(x, y)], '') AS pre,
             array_to_string(tok[least(x, y) + 1:greatest(x, y)], '') AS mid,
             array_to_string(tok[greatest(x, y) + 1:], '') AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR z >= 90 THEN 'plain'
                  WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op11_fill_in_middle(spark, sf_dir):
    """Per document: tokens, form, part lengths, digests of the output and
    of the text rebuilt from it."""
    out = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored("form", "output").cast("binary"), 256).alias("restored_sha256"))
