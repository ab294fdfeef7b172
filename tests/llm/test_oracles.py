"""Queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import flatgraph
from tidemark.llm.queries import OP1_SQL, oracle_sql, queries

DATA = "/root/testdata/sf0.01"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries()[name](spark, DATA), con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_links_match_sql_where_there_are_many(spark):
    """The tables' vectors lie far apart at this size; these have groups, copies, odd rows."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 16))
    x = x[rng.integers(0, 60, 400)] + rng.normal(size=(400, 16)) * rng.uniform(0, 0.15, (400, 1))
    rows = [(int(i) if i % 50 else None, [float(np.float32(v)) for v in vector], "x") for i, vector in enumerate(x)]
    rows += [(1001, rows[5][1], "x"), (1002, rows[5][1], "x"), (7, rows[9][1], "x"), (1003, [0.0] * 16, "x"), (1004, None, "x"), (1005, [], "x"), (1006, [float("nan")] * 16, "x"), (1007, [1.0, 2.0], "x"), (1008, [2.0, 4.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links string").withColumn("hash", F.lit("y"))
    con = duckdb.connect()
    embeddings = frame.toArrow()  # noqa: F841  DuckDB finds it by name
    want = con.sql(OP1_SQL)
    got = flatgraph.near_duplicates(frame, shard_rows=100)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
