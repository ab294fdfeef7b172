"""Connected components of a link table, by alternating large and small stars.

Every round rewrites the links so that nodes hang on smaller ones; it is a constant
number of joins on node ids, its result is written to the shared folder, and the number
of rounds grows with the logarithm of the longest path.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b) but each component's smallest
    node, which is the component's name.  Loops, nulls and repeated links change nothing."""
    named = links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = stored(named, "links")
    seen = _state(now)
    while seen[0]:
        both = now.select("hi", "lo").unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("least"))
        pair = F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        own = F.struct(F.col("hi").alias("hi"), F.col("least").alias("lo"))
        small = large.join(lowest, "hi").select(F.inline(F.array(pair, own))).where("hi != lo").distinct()
        before, now = now, stored(small, "links")
        was, seen = seen, _state(now)
        dropped(before)
        if seen == was:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
