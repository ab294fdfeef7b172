"""The operation log and states that the driver's tables hold."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import blocks, fold

RUNS, PARTS = 4, 12


class Tables:
    """Lazy base relations over one folder of Parquet tables.

    ``parts`` range partitions are the unit of parallelism of block queries; block numbers
    depend on it.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder, parts

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def bounds(self) -> tuple[int, int]:
        """Greatest event id and user id, from one aggregate that Parquet statistics answer."""
        row = self["events"].agg(F.max("event_id"), F.max("user_id")).first()
        return int(row[0] or 0), int(row[1] or 0)

    @property
    def width(self) -> int:
        """Prefixes of one of the ``parts`` range partitions."""
        return self.bounds[1] // self.parts + 1

    @cached_property
    def oplog(self) -> DataFrame:
        """events as (seq, prefix, suffix, is_delete, value, event_type, run)."""
        run = F.floor(F.col("event_id") * RUNS / (self.bounds[0] + 1)).cast("long")
        return self["events"].select(
            F.col("event_id").alias("seq"),
            F.col("user_id").alias("prefix"),
            F.get_json_object("props", "$.k").cast("long").alias("suffix"),
            (F.col("event_type") == "error").alias("is_delete"),
            "value",
            "event_type",
            run.alias("run"),
        )

    @property
    def log(self) -> DataFrame:
        return self.oplog.select("seq", "prefix", "suffix", "is_delete", "value")

    @property
    def folded(self) -> DataFrame:
        return fold.fold_all(self.log)

    @property
    def state(self) -> DataFrame:
        return fold.fold_live(self.log)

    @property
    def runs(self) -> DataFrame:
        """Newest operation of each key in each run."""
        return fold.newest(self.oplog.drop("event_type"), ("run", "prefix", "suffix"), "seq")

    @property
    def blocks(self) -> DataFrame:
        return blocks.cut(self.runs, self.width, runs=RUNS, parts=self.parts)

    @property
    def pst(self) -> DataFrame:
        return blocks.metadata(self.blocks)

    @property
    def windows(self) -> DataFrame:
        return blocks.windows(self.blocks)

    @property
    def owners(self) -> DataFrame:
        """orders as a state with unique keys (o_custkey, o_orderkey)."""
        return self["orders"].select(F.col("o_custkey").alias("prefix"), F.col("o_orderkey").alias("suffix"), F.col("o_totalprice").alias("value"))
