"""Registered queries against DuckDB. A sample of them by default; ``GM_ALL_QUERIES=1`` runs every one with a counterpart."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from groundmetrics.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ("set_match", "grouping_sets", "nearest_negative", "asof_nearest", "interval_join", "select_evidence", "select_panels", "segment_evidence", "evidence_rank",
          "parse_points", "validate_selection", "evaluate_2d", "paired_bootstrap", "merge_first_wins", "set_fingerprint", "quantile_rows")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("GM_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_entry(spark):
    assert entry.entry(spark).count() > 0
