"""Importing this module registers the subpackage's queries."""

from kiln.llm import (decontaminate, divergence, exact_dedup, fim, jaccard, langid, lines, packing,  # noqa: F401
                      phrase_dedup, quality, suffix_dedup, urls, warc)
from kiln.llm.registry import LLM_ORACLES, LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
