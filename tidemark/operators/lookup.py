"""Point lookups, batches of them and ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import at_or_after, at_or_before
from tidemark.operators.blocks import partition_of, ranked
from tidemark.operators.fold import KEY


def get(state: DataFrame, prefix: int, suffix: int) -> DataFrame:
    return state.where((F.col("prefix") == prefix) & (F.col("suffix") == suffix))


def multiget(state: DataFrame, probes: DataFrame) -> DataFrame:
    """All probes with what they find; ``hit`` tells absent keys from null values."""
    held = state.withColumn("hit", F.lit(True))
    return probes.join(held, list(KEY), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def classify(folded: DataFrame, probes: DataFrame) -> DataFrame:
    """Three-valued lookup: found, deleted, or miss."""
    found = folded.select(*KEY, F.col("is_delete").alias("gone"))
    outcome = F.when(F.col("gone").isNull(), "miss").when(F.col("gone"), "deleted").otherwise("found")
    return probes.join(found, list(KEY), "left").withColumn("outcome", outcome).drop("gone")


def scan(state: DataFrame, prefix: int, suffix: int, n: int) -> DataFrame:
    """The first n rows at or after a key, in key order (a top-n, not a full sort)."""
    return state.where(at_or_after(prefix, suffix)).orderBy(*KEY).limit(n)


def scan_range(state: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """All rows between two keys, both included, in key order."""
    return state.where(at_or_after(*low) & at_or_before(*high)).orderBy(*KEY)


def scan_prefix(state: DataFrame, prefix: int) -> DataFrame:
    return state.where(F.col("prefix") == prefix).orderBy("suffix")


def foreach_until(state: DataFrame, stop) -> DataFrame:
    """Rows in key order up to and including the first one where ``stop`` holds.

    The stopping key is one small aggregate; the rows before it are a filter, so no task
    has to see all rows in order.
    """
    key = F.struct(*KEY)
    first = state.where(stop).agg(F.min(key).alias("at")).first()["at"]
    if first is None:
        return state.orderBy(*KEY)
    return state.where(at_or_before(first["prefix"], first["suffix"])).orderBy(*KEY)


def scans(state: DataFrame, asked: DataFrame, width: int, parts: int) -> DataFrame:
    """(probe, n, last_prefix, last_suffix): for many scans (probe, prefix, suffix, n) at once,
    how many rows each finds and the key of its last one, null if it finds none.

    Rows are numbered in key order, by range partition; a scan's start is the number of rows
    before its key, and its end is found by number, so no scan is made row by row.
    """
    keyed = state.select(*KEY, F.lit(0).alias("all")).withColumn("part", partition_of(F.col("prefix"), width))
    numbered = ranked(keyed, ["all"], F.col("part"), list(KEY), parts + 1).select(F.col("prefix").alias("last_prefix"), F.col("suffix").alias("last_suffix"), "rank")
    rows = keyed.select(*KEY, "part", F.lit(1).alias("row"), F.lit(None).cast("long").alias("probe"), F.lit(None).cast("long").alias("n"))
    rows = rows.unionByName(asked.select(*KEY, partition_of(F.col("prefix"), width).alias("part"), F.lit(0).alias("row"), "probe", F.col("n").cast("long").alias("n")))
    before = Window.partitionBy("part").orderBy(*KEY, "row").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("own", F.coalesce(F.sum("row").over(before), F.lit(0))).where("row = 0")
    sizes = rows.groupBy("part").agg(F.sum("row").alias("size"))
    earlier, total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sizes = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(total).alias("total"))
    found = counted.join(F.broadcast(sizes), "part").withColumn("at", F.col("start") + F.col("own"))
    ends = found.select("probe", F.least("n", F.col("total") - F.col("at")).alias("n"), "at")
    ends = ends.withColumn("rank", F.when(F.col("n") > 0, F.col("at") + F.col("n") - 1))
    return ends.join(numbered, "rank", "left").select("probe", "n", "last_prefix", "last_suffix")
