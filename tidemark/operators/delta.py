"""Add, delete and replace deltas of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE = ["prefix", "suffix_min", "suffix_max"]
PLACE = ["block", "offset", "cnt"]


def normalize(adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """(RANGE, op, PLACE): equal adds and deletes cancel out as multisets, what is left on
    one range pairs up to replacements with the add's place, the rest stays."""
    cols = RANGE + PLACE
    order = Window.partitionBy(*RANGE).orderBy(*PLACE)
    side = lambda df, name: df.withColumn("rn", F.row_number().over(order)).select(*RANGE, "rn", F.struct(*PLACE).alias(name))
    a, d = adds.select(*cols), deletes.select(*cols)
    both = side(a.exceptAll(d), "added").join(side(d.exceptAll(a), "gone"), [*RANGE, "rn"], "full")
    op = F.when(F.col("added").isNull(), "delete").when(F.col("gone").isNull(), "add").otherwise("replace")
    place = F.coalesce("added", "gone")
    return both.select(*RANGE, op.alias("op"), *[place[c].alias(c) for c in PLACE])


def build(adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """A row for each prefix: how many adds, deletes and replacements it has."""
    ops = normalize(adds, deletes)
    count = lambda name: F.sum((F.col("op") == name).cast("long")).alias(f"{name}s")
    return ops.groupBy("prefix").agg(count("add"), count("delete"), count("replace"))


def apply(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Windows after a delta: deletes take equal windows away, replacements all windows of
    their range; then adds and replacements come in."""
    cols = RANGE + PLACE
    gone = delta.where("op = 'delete'").select(*cols)
    changed = delta.where("op = 'replace'").select(*RANGE).distinct()
    left = base.select(*cols).join(gone, cols, "left_anti").join(changed, RANGE, "left_anti")
    return left.unionByName(delta.where("op IN ('add', 'replace')").select(*cols))


def rebuild(base: DataFrame, target: DataFrame, changed: DataFrame) -> DataFrame:
    """Windows where the changed prefixes come from ``target`` and others stay as they are."""
    keys = changed.select("prefix").distinct()
    return base.join(keys, "prefix", "left_anti").unionByName(target.join(keys, "prefix", "left_semi"))
