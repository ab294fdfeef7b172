"""Queries that go through a store on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.catalogue import query
from tidemark.sources.files import scratch
from tidemark.sources.store import Store
from tidemark.sources.tables import Tables
from tidemark.streaming.ingest import drain, event_stream


def loaded(t: Tables, flushes: int, compact: bool) -> Store:
    store = Store(t.spark, scratch(t.spark, "store"))
    for run in range(4):
        store.append(t.oplog.where(F.col("run") == run))
        if run < flushes:
            store.flush()
    if compact:
        store.compact(purge=True)
    return store


@query("eng_flush", "SELECT prefix, suffix, value, seq FROM st")
def eng_flush(t: Tables) -> DataFrame:
    """Two flushed runs and a log tail, read as one state."""
    return loaded(t, 2, False).state


@query("eng_compact", "SELECT prefix, suffix, value, seq FROM st")
def eng_compact(t: Tables) -> DataFrame:
    """All runs merged to the bottom level."""
    return loaded(t, 4, True).base.drop("is_delete")


@query("log_write_put", "SELECT seq, prefix, suffix, is_delete, value FROM op")
def log_write_put(t: Tables) -> DataFrame:
    """The log written and read back, puts and deletes."""
    return loaded(t, 0, False).tail


@query("mf_snapshot", "SELECT prefix, suffix, value, seq FROM st")
def mf_snapshot(t: Tables) -> DataFrame:
    """A store opened anew from its pointer after a compaction and a later flush."""
    store = loaded(t, 3, True)
    return Store(t.spark, store.path).state


@query("eng_drain", "SELECT prefix, suffix, value, seq FROM st")
def eng_drain(t: Tables) -> DataFrame:
    """Streaming ingest of all events, then the state of the store."""
    path = scratch(t.spark, "stream")
    store = drain(event_stream(t.spark, t.folder), Store(t.spark, f"{path}/store"), f"{path}/checkpoint")
    return store.state
