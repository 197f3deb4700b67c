"""Seeded, partitioning-independent randomness as column expressions.

``rand()`` and ``randomSplit`` depend on how rows are laid out in
partitions, so a re-run on a different cluster gives a different answer.
Here every random draw is a pure function of (seed, row key): the first 32
bits of ``md5("seed:key")``.  The same value is produced by any SQL engine
with ``md5``, which is what lets the oracles reproduce splits and batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_key(seed, *cols) -> Column:
    parts = [F.lit(str(seed))] + [_as_col(c).cast("string") for c in cols]
    return F.concat_ws(":", *parts)


def seeded_hash32(seed, *cols) -> Column:
    """Unsigned 32-bit hash in [0, 2^32) as BIGINT."""
    return F.conv(F.substring(F.md5(seeded_key(seed, *cols)), 1, 8), 16, 10).cast("bigint")


def seeded_uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_hash32(seed, *cols) / F.lit(TWO_POW_32)


def sql_seeded_hash32(seed, *exprs: str) -> str:
    """The same hash as DuckDB/ANSI SQL text (used by the oracles)."""
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"CAST(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8)) AS BIGINT)"


def sql_seeded_uniform(seed, *exprs: str) -> str:
    return f"({sql_seeded_hash32(seed, *exprs)} / 4294967296.0)"
