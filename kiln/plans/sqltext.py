"""Small builders for the DuckDB oracle text (array maths mirrors
``kiln.functions.arrays``)."""

from __future__ import annotations

from kiln.functions.hashing import sql_seeded_hash32, sql_seeded_uniform
from kiln.plans.registry import sql_list

__all__ = ["sql_affine", "sql_argmax", "sql_log_softmax", "sql_relu", "sql_dot",
           "sql_seeded_hash32", "sql_seeded_uniform", "sql_list"]


def sql_dot(arr: str, w) -> str:
    return f"list_dot_product(CAST({arr} AS DOUBLE[]), {sql_list(w)})"


def sql_affine(arr: str, weights, bias) -> str:
    parts = [f"{sql_dot(arr, row)} + {float(b)!r}" for row, b in zip(weights, bias)]
    return "list_value(" + ", ".join(parts) + ")"


def sql_argmax(s: str) -> str:
    return f"CAST(list_position({s}, list_max({s})) - 1 AS BIGINT)"


def sql_log_softmax(s: str) -> str:
    return (f"list_transform({s}, lambda v: v - (list_max({s}) + "
            f"ln(list_sum(list_transform({s}, lambda u: exp(u - list_max({s})))))))")


def sql_relu(s: str) -> str:
    return f"list_transform({s}, lambda v: greatest(v, 0.0))"
