"""Whole-text statistics as JVM expressions (no intermediate arrays)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_count(text, chars: str) -> Column:
    """Occurrences of any of ``chars`` in the whole text (one regex scan)."""
    cls = "".join(re.escape(ch) if ch not in "\n\t" else ch for ch in chars)
    return F.regexp_count(_c(text), F.lit(f"[{cls}]"))


def token_count(text, sep: str) -> Column:
    """Number of ``sep``-separated pieces, empty pieces included; equals
    ``size(split(text, sep))`` for a single-character separator."""
    return char_count(text, sep) + 1
