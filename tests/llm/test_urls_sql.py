"""Host, path, rule and the rules' verdicts of every page against DuckDB."""

import duckdb
from conftest import SF01

from kiln.llm.urls import op9_url_filter

SQL = rf"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
                                     ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
                                     ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM read_parquet('{SF01}/pages.parquet')),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT s.*, h || p AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
      FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, verdict FROM f WHERE n = 1
"""


def test_rules_of_every_page(spark):
    want = {r[0]: r[1:] for r in duckdb.sql(SQL).fetchall()}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op9_url_filter(spark, SF01).collect()}
    assert set(got) == set(want) and len({w[2] for w in want.values()}) >= 5
    for page, (host, path, rule, verdict) in want.items():
        assert got[page][:3] == (host, path, rule)
        assert got[page][3] == verdict if rule else got[page][3] in ("allow", "block")
