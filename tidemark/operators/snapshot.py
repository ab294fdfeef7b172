"""Export of the interval index by prefix, and import that takes only sound states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FORMAT = 4
MODES = ("normal", "tiny")


def _sum(suffix_min: str = "suffix_min", suffix_max: str = "suffix_max", cnt: str = "cnt") -> Column:
    """An order-free checksum of windows."""
    return F.sum(F.col(suffix_min) * 31 + F.col(suffix_max) * 17 + F.col(cnt))


def export(windows: DataFrame, tiny: int = 128) -> DataFrame:
    """One header a prefix: format, mode, records, entries and checksum of its windows."""
    table = windows.groupBy("prefix").agg(F.count("*").alias("records"), F.countDistinct("run", "block").alias("blocks"), F.sum("cnt").alias("entries"), _sum().alias("checksum"))
    small = (F.col("blocks") == 1) & (F.col("records") == 1) & (F.col("entries") <= tiny)
    return table.select("prefix", F.lit(FORMAT).alias("format"), F.when(small, "tiny").otherwise("normal").alias("mode"), "records", "entries", "checksum")


def problems(headers: DataFrame, windows: DataFrame) -> DataFrame:
    """(prefix, problem): what forbids the import of a prefix, the first that applies, or 'ok'.

    Windows of a run must ascend, and the header must agree with them.
    """
    order = Window.partitionBy("run", "prefix").orderBy("suffix_min", "suffix_max")
    meets = F.coalesce(F.lag("suffix_max").over(order) >= F.col("suffix_min"), F.lit(False)) | (F.col("suffix_min") > F.col("suffix_max"))
    found = windows.withColumn("bad", meets).groupBy("prefix").agg(F.count("*").alias("n"), F.sum("cnt").alias("held"), _sum().alias("sum"), F.max("bad").alias("bad"))
    problem = (
        F.when(F.col("format") != FORMAT, "format")
        .when(~F.col("mode").isin(*MODES), "mode")
        .when(F.coalesce(F.col("n"), F.lit(0)) != F.col("records"), "records")
        .when(F.coalesce("bad", F.lit(False)), "order")
        .when((F.col("held") != F.col("entries")) | (F.col("sum") != F.col("checksum")), "checksum")
        .otherwise("ok")
    )
    return headers.join(found, "prefix", "left").select("prefix", problem.alias("problem"))


def imported(headers: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of the prefixes that may be imported."""
    sound = problems(headers, windows).where("problem = 'ok'").select("prefix")
    return windows.join(sound, "prefix", "left_semi")
