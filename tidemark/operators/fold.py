"""Newest-wins folds of an operation log (seq, prefix, suffix, is_delete, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("prefix", "suffix")


def newest(rows: DataFrame, by: Sequence[str], *order: str | Column) -> DataFrame:
    """For each value of ``by`` the row that is largest by ``order``.

    It is a hash aggregate with partial aggregation: no sort, and a hot key shrinks to
    one row a task before the shuffle.  ``order`` must tell all rows of a key apart.
    """
    rest = [c for c in rows.columns if c not in by]
    rank = F.struct(*[F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)])
    best = F.max_by(F.struct(*rest), rank).alias("best")
    return rows.groupBy(*by).agg(best).select(*by, *[F.col(f"best.`{c}`").alias(c) for c in rest])


def fold_all(oplog: DataFrame) -> DataFrame:
    """Latest operation of each key, deletes kept."""
    return newest(oplog, KEY, "seq")


def fold_live(oplog: DataFrame) -> DataFrame:
    """State: latest value of each key that isn't deleted."""
    return fold_all(oplog).where(~F.col("is_delete")).drop("is_delete")


def put_validate(oplog: DataFrame, lsn: Column) -> DataFrame:
    """Fold where a put counts only if its LSN is not older; later arrival wins a tie."""
    return newest(oplog, KEY, lsn, "seq")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Merge sorted runs: of equal keys the newest run's row stays, deletes included."""
    return newest(runs, KEY, "run")


def without(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Physical removal of keys; absent ones don't matter."""
    return state.join(keys.select(*KEY).distinct(), list(KEY), "left_anti")


def appended(oplog: DataFrame, writes: DataFrame, start: int) -> DataFrame:
    """The log with ``writes`` (rank, prefix, suffix, is_delete, value) put behind it."""
    return oplog.unionByName(writes.withColumn("seq", F.lit(start) + F.col("rank")).drop("rank"))
