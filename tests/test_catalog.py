"""Every registered query against its DuckDB twin on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows_of(names, rows, cols):
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = rows_of(df.columns, df.collect(), cols)
    if name not in ORACLES:
        return
    db.execute(ORACLES[name])
    names = [d[0] for d in db.description]
    assert sorted(names) == cols
    assert got == rows_of(names, db.fetchall(), cols)


# Queries with a running scan, again with every scan cut into pieces.
SCANS = ("c2_register_join_arrival c4_assign_seq c11_stamp_hlc c12_observe_hlc c16_seal e1_debounce_batch "
         "h1_upsert_heads h13_restore_versions j4_prefetch_plan j7_history_base m12_sequence_text p6_enforce_caps "
         "p9_role_changes p16_redeem_promos").split()


@pytest.mark.parametrize("name", SCANS)
def test_query_in_pieces(spark, db, pieces, name):
    pieces(500)
    test_query(spark, db, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
