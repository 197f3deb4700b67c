"""Registry of this subpackage's queries, kept apart from the main one."""

from __future__ import annotations

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in LLM_QUERIES:
            raise ValueError(f"duplicate query {name}")
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql.strip()
        return fn
    return deco
