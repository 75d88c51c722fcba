"""Registered queries against DuckDB on the driver's smallest tables, where those are there."""

import glob
import os

import pytest

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["tokenize_documents", "bm25_topk", "rrf_hybrid", "weighted_fusion", "temporal_hints", "merge_intervals", "graph_bfs", "retrieval_metrics", "idempotent_requests", "plan_prefix", "distribution_summary"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no driver tables")
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fold = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted(repr([fold(r[i]) for i in order]) for r in records)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_entry_module_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 130
