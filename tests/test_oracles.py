"""Every registered query that has an SQL oracle must equal DuckDB on the
same parquet tables (row multiset, column names)."""

import pytest

from conftest import SF001
from kiln.plans import ORACLES, QUERIES
from oracle_harness import compare, duck_connection

_CON = {}


def _con():
    if "c" not in _CON:
        _CON["c"] = duck_connection(SF001)
    return _CON["c"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    problems, stypes, dtypes = compare(spark, name, QUERIES[name], ORACLES[name], SF001, _con())
    assert not problems, f"{name}: {problems}\nspark={stypes}\nduck={dtypes}"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
