"""Every catalogue query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import tidemark.plans.lifecycle  # noqa: F401  registers its queries
import tidemark.plans.storeplans  # noqa: F401  registers its queries
from tidemark.plans.catalogue import QUERIES, SQL
from tidemark.sources.tables import Tables

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata")

#: Queries that may be empty on small tables.
MAYBE_EMPTY = {"cp_reuse", "wl_e"}


@pytest.fixture(scope="module")
def sf():
    """The smallest tables hold too few prefixes for the ranges of the catalogue."""
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    assert name in SQL
    got = QUERIES[name](Tables(spark, sf))
    want = duck.sql(SQL[name])
    mine, theirs = normal([tuple(r) for r in got.collect()], got.columns), normal(want.fetchall(), want.columns)
    assert mine == theirs
    assert mine[1] or name in MAYBE_EMPTY


@pytest.mark.parametrize("before, met, sources", [(0, True, {"inputs", "blocks", "records"}), (128, True, {"inputs", "records"}), (128, False, {"inputs"})])
def test_obsolete_tables_where_a_source_is_empty(spark, tmp_path, before, met, sources):
    """Records in an even block, in an odd one only (no unique blocks), and none."""
    first = [(i // 100, i % 100) for i in range(before)] + ([(42, 20), (44, 7)] if met else [(46, 0)])
    keys = first + [(600, i % 100) for i in range(3 * len(first))]  # the first quarter is run 0
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, 'click', 1.0, ?)", [(i, p, f'{{"k": {s}}}') for i, (p, s) in enumerate(keys)])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = QUERIES["cp_obsolete"](Tables(spark, str(tmp_path)))
    rows, want = [tuple(r) for r in got.collect()], con.sql(SQL["cp_obsolete"])
    assert normal(rows, got.columns) == normal(want.fetchall(), want.columns)
    assert {r[0] for r in rows} == sources
