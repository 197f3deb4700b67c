"""Every query of the subpackage with SQL equals DuckDB on the same tables."""

import pytest

from conftest import SF001
import __spark_entry__
from kiln.llm.queries import LLM_ORACLES, LLM_QUERIES
from oracle_harness import compare


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_duckdb(spark, name):
    problems, stypes, dtypes = compare(spark, name, LLM_QUERIES[name], LLM_ORACLES[name], SF001)
    assert not problems, f"{name}: {problems}\nspark={stypes}\nduck={dtypes}"


def test_the_operators_and_the_pipeline():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
