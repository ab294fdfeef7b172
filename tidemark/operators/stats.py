"""Per-prefix statistics, policies and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def governance(rows: DataFrame, hot: int = 512, cow: int = 1024, parallel: int = 512) -> DataFrame:
    n = F.col("records")
    counted = rows.groupBy("prefix").agg(F.count("*").alias("records"))
    return counted.withColumns({"hot": n >= hot, "prefer_cow": n >= cow, "parallel": n >= parallel})


def descriptor(windows: DataFrame, tiny: int = 128) -> DataFrame:
    """tiny: one block, one window and at most ``tiny`` entries; else normal."""
    table = windows.groupBy("prefix").agg(F.countDistinct("run", "block").alias("blocks"), F.count("*").alias("windows"), F.sum("cnt").alias("entries"))
    small = (F.col("blocks") == 1) & (F.col("windows") == 1) & (F.col("entries") <= tiny)
    return table.withColumn("mode", F.when(small, "tiny").otherwise("normal"))


def hysteresis(now: DataFrame, before: DataFrame, leave: int = 192, streak: int = 2) -> DataFrame:
    """Mode after an update: a tiny prefix stays tiny below ``leave`` entries, a normal one
    turns tiny once it has qualified ``streak`` times in a row, a new one at once."""
    seen = before.select("prefix", F.col("mode").alias("was"), F.col("streak").alias("runs"))
    fits = F.col("mode") == "tiny"
    run = F.when(fits, F.coalesce("runs", F.lit(0)) + 1).otherwise(0)
    mode = F.when(F.col("was").isNull(), F.col("mode")).when((F.col("was") == "tiny") & (F.col("entries") < leave) & (F.col("blocks") == 1), "tiny").when(fits & (run >= streak), "tiny").otherwise("normal")
    return now.join(seen, "prefix", "left").select("prefix", "entries", mode.alias("mode"), run.cast("long").alias("streak"))


def update_mode(existing: DataFrame, changed: DataFrame, least: int, most: int, percent: int) -> DataFrame:
    """cow where enough records exist and few enough of them change, else bulk."""
    table = existing.join(changed, "prefix", "left").withColumn("changed", F.coalesce("changed", F.lit(0)))
    n, c = F.col("existing"), F.col("changed")
    return table.withColumn("mode", F.when((n >= least) & (c <= most) & (c * 100 <= n * percent), "cow").otherwise("bulk"))


def rank_of(n: int, per_cent: int = 99) -> int:
    """Zero-based rank of the p99 rule: floor(n * 99 / 100), at most n - 1."""
    return max(0, min(n - 1, n * per_cent // 100))


def value_at(rows: DataFrame, column: str, n: int, rank: int, most: int = 1_000_000) -> float:
    """The value at a zero-based rank among ``n`` non-null ones.

    The range that holds it is narrowed by approximate percentiles whose bounds are counted,
    until at most ``most`` values are left to sort, or all that are left are equal.
    """
    v = F.col(column)
    low, high = rows.agg(F.min(v), F.max(v)).first()
    skipped, inside = 0, n
    while inside > most and low < high:
        at = (rank - skipped) / inside
        part = rows.where(v.between(low, high))
        a, b = part.agg(F.percentile_approx(v, [max(0.0, at - 0.01), min(1.0, at + 0.01)], F.lit(1000))).first()[0]
        below, among = part.agg(F.count_if(v < a), F.count_if(v.between(a, b))).first()
        if not skipped + below <= rank < skipped + below + among:
            a, b = (low, a) if rank < skipped + below else (b, high)
            below, among = part.agg(F.count_if(v < a), F.count_if(v.between(a, b))).first()
        if among == inside:
            break
        low, high, skipped, inside = a, b, skipped + below, among
    if low == high:
        return low
    return rows.where(v.between(low, high)).orderBy(v).select(v).offset(rank - skipped).limit(1).first()[0]


def latency(values: DataFrame, column: str) -> DataFrame:
    """n, avg, p99 (the value at the zero-based rank floor(n * 99 / 100)) and the mean of
    the values from there on, of which those above p99 are added up and the rest equal it."""
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n = rows.count()
    p99 = value_at(rows, "v", n, rank_of(n)) if n else None
    above = F.col("v") > F.lit(p99)
    figures = rows.agg(F.count("*").alias("n"), F.avg("v").alias("avg_v"), F.coalesce(F.sum(F.when(above, F.col("v"))), F.lit(0.0)).alias("sum"), F.count_if(above).alias("more"))
    tail = n - rank_of(n)
    mean = (F.col("sum") + (F.lit(tail) - F.col("more")) * F.lit(p99)) / F.lit(max(1, tail))
    return figures.select("n", "avg_v", F.lit(p99).cast("double").alias("p99"), mean.cast("double").alias("top1pct_avg"))


def classify_load(rows: DataFrame, by: str, is_write: Column) -> DataFrame:
    """Write share of each ``by`` and the mode that it asks for; -1 when idle."""
    table = rows.groupBy(by).agg(F.count("*").alias("ops"), F.sum(is_write.cast("long")).alias("writes"))
    share = ratio(F.col("writes"), F.col("ops"), -1.0)
    mode = F.when(share > 0.5, "write").when(share == 0, "read_only").otherwise("read_optimized")
    return table.withColumns({"write_ratio": share, "mode": mode})


def packed(sizes: DataFrame, key: str, size: str, capacity: int, by: str) -> DataFrame:
    """Page of each item when items fill pages in key order inside ``by``: the running sum
    before an item, divided by the capacity."""
    order = Window.partitionBy(by).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    return sizes.withColumn("page", F.floor(before / capacity).cast("long"))
