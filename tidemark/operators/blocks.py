"""Blocks of sorted runs and their metadata.

A run is cut at range partitions and then every ``capacity`` rows.  Ranks are counted in
fine pieces of a partition and added up, so no task sorts a whole partition of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 128
#: Block numbers of one range partition; a partition's first block is a multiple of it.
#: With it a long holds four million partitions of a million million blocks.
STRIDE = 1 << 40
#: Pieces of a range partition that are ranked by tasks of their own.
FINE = 64


def partition_of(prefix: Column, width: int) -> Column:
    return F.floor(prefix / width).cast("long")


def part_of_block(block: Column) -> Column:
    return F.shiftright(block, STRIDE.bit_length() - 1)


def ranked(rows: DataFrame, groups: list[str], piece: Column, order: list[str], pieces: int) -> DataFrame:
    """Rows with ``rank``, their zero-based place in each of ``groups`` by ``order``.

    ``piece`` must not fall as ``order`` grows.  Ranks are counted in a piece, to which the
    sizes of the pieces before it are added: at most ``pieces`` rows that may be broadcast.
    """
    marked = rows.withColumn("_piece", piece)
    sizes = marked.groupBy(*groups, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*groups, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sizes = F.broadcast(sizes) if pieces <= 1_000_000 else sizes
    own = F.row_number().over(Window.partitionBy(*groups, "_piece").orderBy(*order)) - 1
    numbered = marked.withColumn("_own", own).join(sizes, [*groups, "_piece"])
    return numbered.select(*rows.columns, (F.col("_own") + F.col("_before")).alias("rank"))


def cut(rows: DataFrame, width: int, capacity: int = CAPACITY, runs: int = 32, parts: int = 64) -> DataFrame:
    """Add ``block`` and ``slot`` to rows (run, prefix, suffix, ...) of at most ``runs`` runs
    and ``parts`` range partitions."""
    placed = rows.withColumn("_part", partition_of(F.col("prefix"), width))
    piece = F.floor(F.col("prefix") / max(1, -(-width // FINE))).cast("long")
    place = ranked(placed, ["run", "_part"], piece, ["prefix", "suffix"], runs * parts * (FINE + 1))
    return place.select(*rows.columns, (F.col("_part") * STRIDE + F.floor(F.col("rank") / capacity)).alias("block"), (F.col("rank") % capacity).cast("int").alias("slot"))


def metadata(blocks: DataFrame) -> DataFrame:
    """One row a block: least and greatest key, entries, newest seq."""
    key = F.struct("prefix", "suffix")
    table = blocks.groupBy("run", "block").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("entries"), F.max("seq").alias("max_seq"))
    return table.select("run", "block", F.col("lo.prefix").alias("min_prefix"), F.col("lo.suffix").alias("min_suffix"), F.col("hi.prefix").alias("max_prefix"), F.col("hi.suffix").alias("max_suffix"), "entries", "max_seq")


def windows(blocks: DataFrame) -> DataFrame:
    """Stretches of one prefix in a block: suffix range, first slot, length."""
    return blocks.groupBy("run", "block", "prefix").agg(F.min("suffix").alias("suffix_min"), F.max("suffix").alias("suffix_max"), F.min("slot").alias("offset"), F.count("*").alias("cnt"))


def order_violations(blocks: DataFrame) -> DataFrame:
    """How many neighbours inside a block stand in the wrong order."""
    order = Window.partitionBy("run", "block").orderBy("slot")
    key = F.struct("prefix", "suffix")
    return blocks.select((F.lag(key).over(order) > key).alias("bad")).agg(F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("violations"))


def search_window(blocks: DataFrame, probes: DataFrame, windows_table: DataFrame) -> DataFrame:
    """Exact match of probes inside the windows of their prefix, not outside their slots."""
    inside = (F.col("slot") >= F.col("offset")) & (F.col("slot") < F.least(F.col("offset") + F.col("cnt"), F.lit(CAPACITY)))
    hit = probes.join(windows_table, "prefix").where("suffix BETWEEN suffix_min AND suffix_max")
    return hit.join(blocks.select("run", "block", "prefix", "suffix", "slot", "value"), ["run", "block", "prefix", "suffix"]).where(inside).select("prefix", "suffix", "run", "block", "slot", "value")


def reusable(table: DataFrame) -> DataFrame:
    """Blocks whose key range meets no block of another run, bounds included.

    Every range is cut by range partition first, so the running maxima are per partition.
    """
    part = part_of_block(F.col("block"))
    lo, hi = F.struct("min_prefix", "min_suffix"), F.struct("max_prefix", "max_suffix")
    order = Window.partitionBy("part").orderBy("lo", "run", "block")
    marked = table.withColumns({"part": part, "lo": lo, "hi": hi})
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("lo").over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (before.isNull() | (before < F.col("lo"))) & (after.isNull() | (after > F.col("hi")))
    return marked.withColumn("free", free).where("free").drop("part", "lo", "hi", "free")
