"""Interval lookups over block and window metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import FINE, part_of_block, partition_of, ranked


def _lo() -> Column:
    return F.struct(F.col("min_prefix").alias("prefix"), F.col("min_suffix").alias("suffix"))


def _hi() -> Column:
    return F.struct(F.col("max_prefix").alias("prefix"), F.col("max_suffix").alias("suffix"))


def _key(prefix: int, suffix: int) -> Column:
    return F.struct(F.lit(prefix).cast("long").alias("prefix"), F.lit(suffix).cast("long").alias("suffix"))


def stab(table: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """(probe, run, block): probes with the block of each run whose key range holds them.

    Blocks of a run don't overlap, so it can only be the first one that doesn't end before
    the probe.
    """
    first = first_tables(table, probes, width)
    held = first.join(table.select("run", "block", _lo().alias("lo")), ["run", "block"]).join(probes.select("probe", F.struct("prefix", "suffix").alias("key")), "probe")
    return held.where("key >= lo").select("probe", "run", "block")


def overlapping(table: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Blocks that meet the range, bounds included."""
    pushed = (F.col("max_prefix") >= low[0]) & (F.col("min_prefix") <= high[0])
    return table.where(pushed & (_hi() >= _key(*low)) & (_lo() <= _key(*high)))


def first_tables(table: DataFrame, probes: DataFrame, width: int, n: int = 1, runs: int = 32, parts: int = 64) -> DataFrame:
    """For each probe (probe, prefix, suffix) and run the n-th block whose greatest key is not
    below the probe.

    Block ends are numbered in each run.  Ends and probes are ordered together inside one
    range partition of a run, which counts the ends before a probe; the block is then found
    by its number.  Runs are few (a ring of at most 31), so each probe is repeated for each.
    """
    ends = table.select("run", _hi().alias("key"), "block", part_of_block(F.col("block")).alias("part"))
    numbered = ranked(ends, ["run"], F.col("part"), ["key", "block"], runs * parts).select("run", "block", "rank")
    names = F.broadcast(table.select("run").distinct())
    asks = probes.crossJoin(names).select("run", F.struct("prefix", "suffix").alias("key"), partition_of(F.col("prefix"), width).alias("part"), "probe")
    rows = ends.select("run", "part", "key", F.lit(1).alias("end"), F.lit(None).cast("long").alias("probe"))
    rows = rows.unionByName(asks.select("run", "part", "key", F.lit(0).alias("end"), "probe"))
    before = Window.partitionBy("run", "part").orderBy("key", "end").rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("own", F.coalesce(F.sum("end").over(before), F.lit(0))).where("end = 0")
    sizes = rows.groupBy("run", "part").agg(F.sum("end").alias("size"))
    earlier = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("run", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    found = counted.join(F.broadcast(sizes), ["run", "part"]).select("run", "probe", (F.col("start") + F.col("own") + (n - 1)).alias("rank"))
    return found.join(numbered, ["run", "rank"]).select("run", "probe", "block")


def clip(windows: DataFrame, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """Windows cut to an inclusive key range; those outside go."""
    p = F.col("prefix")
    lo = F.when(p == low[0], F.greatest("suffix_min", F.lit(low[1]))).otherwise(F.col("suffix_min"))
    hi = F.when(p == high[0], F.least("suffix_max", F.lit(high[1]))).otherwise(F.col("suffix_max"))
    cut = windows.where((p >= low[0]) & (p <= high[0])).withColumns({"suffix_min": lo, "suffix_max": hi})
    return cut.where("suffix_min <= suffix_max")


def fragments(table: DataFrame, prefixes: DataFrame, width: int) -> DataFrame:
    """A row for each block and existing prefix that its range holds, with the part of the
    suffix range: from 0 and to the greatest value where a neighbour prefix takes over."""
    fine = max(1, -(-width // FINE))  # a block stays in its range partition: at most FINE + 1 pieces
    piece = lambda c: F.floor(F.col(c) / fine).cast("long")
    spread = table.withColumn("piece", F.explode(F.sequence(piece("min_prefix"), piece("max_prefix"))))
    held = spread.join(prefixes.select("prefix", piece("prefix").alias("piece")), "piece")
    held = held.where("prefix BETWEEN min_prefix AND max_prefix").drop("piece")
    lo = F.when(F.col("prefix") == F.col("min_prefix"), F.col("min_suffix")).otherwise(F.lit(0))
    hi = F.when(F.col("prefix") == F.col("max_prefix"), F.col("max_suffix")).otherwise(F.lit((1 << 63) - 1))
    return held.select("run", "block", "prefix", lo.alias("suffix_min"), hi.alias("suffix_max"), "max_seq")


def lookup(windows: DataFrame, probes: DataFrame, n: int = 1) -> DataFrame:
    """For each probe the first n windows that hold it, by end, newest first, block."""
    hits = probes.join(windows, "prefix").where("suffix BETWEEN suffix_min AND suffix_max")
    order = Window.partitionBy("prefix", "suffix").orderBy("suffix_max", F.desc("run"), "block")
    return hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def normalized(windows: DataFrame) -> DataFrame:
    """Of windows with equal prefix and suffix range the newest; ties by block, offset, length."""
    order = Window.partitionBy("prefix", "suffix_min", "suffix_max").orderBy(F.desc("run"), "block", "offset", "cnt")
    return windows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def coverage(table: DataFrame, windows: DataFrame) -> DataFrame:
    """Per block: do its windows cover all its entries without a gap?"""
    order = Window.partitionBy("run", "block").orderBy("offset", "end")
    ends = windows.where("cnt > 0").withColumn("end", F.col("offset") + F.col("cnt"))
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = ends.withColumn("gap", (F.col("offset") > reach).cast("int")).groupBy("run", "block").agg(F.max("gap").alias("gap"), F.max("end").alias("end"))
    covered = (F.coalesce("gap", F.lit(1)) == 0) & (F.coalesce("end", F.lit(0)) >= F.col("entries"))
    return table.select("run", "block", "entries").join(gaps, ["run", "block"], "left").select("run", "block", covered.alias("covered"))


def fallback(precise: DataFrame, derived: DataFrame) -> DataFrame:
    """Precise windows, and derived ones for the blocks that have no precise window."""
    named = precise.select("run", "block").distinct()
    return precise.unionByName(derived.join(named, ["run", "block"], "left_anti"))


def meeting(windows: DataFrame) -> DataFrame:
    """(broken, windows): how many windows start before one of their prefix and run has ended."""
    order = Window.partitionBy("run", "prefix").orderBy("suffix_min", "suffix_max")
    bad = (F.lag("suffix_max").over(order) >= F.col("suffix_min")).cast("long")
    return windows.select(bad.alias("bad")).agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("broken"), F.count("*").alias("windows"))


def obsolete(table: DataFrame, inputs: DataFrame, blocks: DataFrame, records: DataFrame) -> DataFrame:
    """Tables named by the first of three sources (run, block) that names any, and which ``source`` it was."""
    for name, source in (("inputs", inputs), ("blocks", blocks), ("records", records)):
        if not source.isEmpty():
            return table.join(source.select("run", "block").distinct(), ["run", "block"], "left_semi").withColumn("source", F.lit(name))
    return table.limit(0).withColumn("source", F.lit("nothing"))
