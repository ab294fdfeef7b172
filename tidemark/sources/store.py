"""A durable store: operation log, level-0 runs, level-1 snapshots and a pointer.

    oplog/batch=B     appended operations (Parquet), durable once the pointer names B
    level=0/run=N     folded, key-sorted runs, deletes kept
    level=1/version=V the merged bottom level
    _pointer.0, _pointer.1   two slots that take turns, each with version and checksum

Only the pointer says what exists; folders are never listed for truth.  A crash between
writing data and writing a slot leaves the old version, a torn slot fails its checksum
and the other one counts.  Everything a commit supersedes is removed by ``collect``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fold
from tidemark.sources.files import Files

SCHEMA = "seq long, prefix long, suffix long, is_delete boolean, value double"


#: Fixed value: runs that the ring of level 0 holds.
RING = 31


@dataclass
class Config:
    """Policies of a store.

    The stall threshold is kept within the ring.  Modes move thresholds, they don't reject
    writes: a read-only load flushes at once, a read-optimised one compacts at one run.
    """

    compact_at: int = 4
    stall_at: int = RING
    flush_at: int = 4096
    compaction_enabled: bool = True
    read_only: bool = False
    read_optimized: bool = False

    def __post_init__(self):
        self.stall_at = min(max(1, self.stall_at), RING)

    def adapt(self, write_ratio: float) -> None:
        """Modes for a load by its share of writes; a negative share is no load."""
        if write_ratio >= 0:
            self.read_only = write_ratio == 0
            self.read_optimized = write_ratio <= 0.5

    def flush_due(self, entries: int) -> bool:
        return entries >= (1 if self.read_only else self.flush_at)

    def compaction_due(self, runs: int) -> bool:
        return self.compaction_enabled and runs >= (1 if self.read_optimized else self.compact_at)

    def stalled(self, runs: int) -> bool:
        return runs >= self.stall_at


@dataclass
class Pointer:
    version: int = 0
    batches: list[int] = field(default_factory=list)  # committed, not yet flushed
    done: int = -1  # all batches up to here are flushed or committed
    runs: list[int] = field(default_factory=list)
    base: int | None = None
    flushed_seq: int = -1
    next_seq: int = 0
    next_id: int = 0

    def text(self) -> str:
        body = json.dumps(self.__dict__, sort_keys=True)
        return json.dumps({"crc": zlib.crc32(body.encode()), "body": body})

    @classmethod
    def parse(cls, text: str | None) -> Pointer | None:
        try:
            outer = json.loads(text or "")
            if zlib.crc32(outer["body"].encode()) == outer["crc"]:
                return cls(**json.loads(outer["body"]))
        except (ValueError, KeyError, TypeError):
            pass
        return None


class Store:
    """``trip`` is called with the name of each step; tests raise there to crash."""

    def __init__(self, spark: SparkSession, path: str, compact_at: int = 4, tasks: int | None = None, trip: Callable[[str], None] = lambda _: None, config: Config | None = None):
        self.spark, self.path, self.trip = spark, path, trip
        self.config = config or Config(compact_at=compact_at)
        self.tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.files = Files(spark)
        self.now = self._recovered()

    def _recovered(self) -> Pointer:
        texts = [self.files.read(f"{self.path}/_pointer.{k}") for k in (0, 1)]
        valid = [p for p in map(Pointer.parse, texts) if p]
        if not valid and any(t is not None for t in texts):
            raise ValueError(f"no valid pointer in {self.path}")
        return max(valid, key=lambda p: p.version, default=Pointer())

    def _commit(self, new: Pointer) -> None:
        new.version = self.now.version + 1
        self.trip("before_pointer")
        self.files.write(f"{self.path}/_pointer.{new.version % 2}", new.text())
        self.now = new
        self.trip("after_pointer")

    def _changed(self, **changes) -> Pointer:
        return Pointer(**(json.loads(json.dumps(self.now.__dict__)) | changes))

    def _read(self, *folders: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def _sorted(self, rows: DataFrame, folder: str) -> None:
        """Key-sorted files, so that row-group statistics are selective on both words."""
        table = rows.repartitionByRange(self.tasks, *fold.KEY).sortWithinPartitions(*fold.KEY)
        table.select("seq", "prefix", "suffix", "is_delete", "value").write.mode("overwrite").parquet(f"{self.path}/{folder}")

    # ---- reads

    @property
    def tail(self) -> DataFrame:
        """Committed operations that no run holds yet."""
        return self._read(*[f"oplog/batch={b}" for b in self.now.batches])

    @property
    def runs(self) -> DataFrame:
        return self._read(*[f"level=0/run={r}" for r in self.now.runs])

    @property
    def base(self) -> DataFrame:
        return self._read(*([] if self.now.base is None else [f"level=1/version={self.now.base}"]))

    @property
    def folded(self) -> DataFrame:
        """Latest operation of every key."""
        return fold.fold_all(self.tail.unionByName(self.runs).unionByName(self.base))

    @property
    def state(self) -> DataFrame:
        return self.folded.where("NOT is_delete").drop("is_delete")

    # ---- writes

    def append(self, ops: DataFrame, batch: int | None = None) -> bool:
        """Commit a batch of (seq, ...); a batch id that is committed already is ignored."""
        if batch is not None and (batch <= self.now.done or batch in self.now.batches):
            return False
        batch = self.now.next_id if batch is None else batch
        folder = f"{self.path}/oplog/batch={batch}"
        seen = Observation()  # the greatest seq comes with the write, without a second read
        rows = ops.select("seq", "prefix", "suffix", "is_delete", "value").observe(seen, F.max("seq").alias("top"))
        rows.write.mode("overwrite").parquet(folder)
        self.trip("after_log")
        top = seen.get["top"]
        seq = self.now.next_seq if top is None else max(self.now.next_seq, top + 1)
        self._commit(self._changed(batches=[*self.now.batches, batch], next_seq=seq, next_id=max(self.now.next_id, batch + 1)))
        return True

    def put(self, rows: list[tuple[int, int, float | None]], delete: bool = False) -> None:
        """Put or delete a few keys; sequence numbers go on from the greatest so far."""
        start = self.now.next_seq
        ops = [(start + i, p, s, delete, None if delete else v) for i, (p, s, v) in enumerate(rows)]
        self.append(self.spark.createDataFrame(ops, SCHEMA))

    def flush(self) -> bool:
        """Fold the committed batches to a new sorted run."""
        if not self.now.batches:
            return False
        run = self.now.next_id
        self._sorted(fold.fold_all(self.tail), f"level=0/run={run}")
        self.trip("after_run")
        self._commit(self._changed(runs=[*self.now.runs, run], batches=[], done=max([self.now.done, *self.now.batches]), flushed_seq=self.now.next_seq - 1, next_id=run + 1))
        return True

    def compact(self, purge: bool = False) -> bool:
        """Merge all runs and the bottom level to a new bottom level.

        Deletes stay, so that operations which arrive late still lose to them; ``purge``
        drops them, for callers who know that nothing older can come.
        """
        if not self.now.runs:
            return False
        version = self.now.next_id
        merged = fold.fold_all(self.runs.unionByName(self.base))
        self._sorted(merged.where("NOT is_delete") if purge else merged, f"level=1/version={version}")
        self.trip("after_merge")
        self._commit(self._changed(runs=[], base=version, next_id=version + 1))
        return True

    def maintain(self) -> None:
        """Flush, and compact once enough runs stand in level 0; a store at its stall
        threshold compacts whatever the other policies say."""
        self.flush()
        if self.config.compaction_due(len(self.now.runs)) or self.config.stalled(len(self.now.runs)):
            self.compact()

    def collect(self) -> list[str]:
        """Remove folders that the pointer doesn't name; tells which."""
        now = self.now
        live = {f"oplog/batch={b}" for b in now.batches} | {f"level=0/run={r}" for r in now.runs} | ({f"level=1/version={now.base}"} if now.base is not None else set())
        gone = [f"{top}/{name}" for top in ("oplog", "level=0", "level=1") for name in self.files.list(f"{self.path}/{top}") if f"{top}/{name}" not in live]
        for folder in gone:
            self.files.delete(f"{self.path}/{folder}")
        return gone

    def checksum(self) -> tuple[int, int]:
        """(rows, order-free checksum) of the state."""
        row = self.state.agg(F.count("*"), F.sum(F.xxhash64("prefix", "suffix", "value", "seq").cast("decimal(38,0)"))).first()
        return int(row[0]), int(row[1] or 0)
