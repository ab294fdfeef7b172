"""Queries of an engine's life: opening, policies, log and block steps, versions, manifest
transactions, index bookkeeping and the figures of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import blocks, delta, fold, intervals, lookup, snapshot, stats
from tidemark.plans.catalogue import CLIP, FRAGMENTS, HIGH, LOW, NORMAL, PROBES, TINY, U64, fragment_rows, probes, query
from tidemark.plans.storeplans import loaded
from tidemark.sources.files import scratch
from tidemark.sources.store import RING, Config, Store
from tidemark.sources.tables import Tables


def rows(t: Tables, schema: str, *values: tuple) -> DataFrame:
    return t.spark.createDataFrame(list(values), schema)


def of_run(t: Tables, run: int) -> DataFrame:
    return t.oplog.where(F.col("run") == run)


LIVE = "(SELECT count(*) FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM op WHERE run <= {0}) WHERE r = 1 AND NOT is_delete)"


# ---- engine


@query("eng_open", "SELECT 6 AS version, 2 AS runs, 2 AS batches, (SELECT max(seq) + 1 FROM op) AS next_seq, (SELECT count(*) FROM st) AS live")
def eng_open(t: Tables) -> DataFrame:
    """A store opened from its path: two runs, two batches not yet flushed."""
    now = (again := Store(t.spark, loaded(t, 2, False).path)).now
    facts = {"version": now.version, "runs": len(now.runs), "batches": len(now.batches), "next_seq": now.next_seq}
    return again.state.agg(F.count("*").alias("live")).select(*[F.lit(v).cast("long").alias(k) for k, v in facts.items()], "live")


@query("eng_config", "SELECT * FROM (VALUES ('compact_at', '7'), ('stall_at', '31'), ('flush_at', '4096'), ('compaction_enabled', 'True'), ('read_only', 'False'), ('read_optimized', 'False')) AS c(name, value)", base=False)
def eng_config(t: Tables) -> DataFrame:
    """What a configuration turns into; the stall threshold is beyond the ring."""
    return rows(t, "name string, value string", *[(k, str(v)) for k, v in Config(compact_at=7, stall_at=99).__dict__.items()])


@query("eng_modes", ", w AS (SELECT seq // 7 AS phase, count(*) AS ops, avg(CASE WHEN event_type IN ('purchase', 'error') THEN 1.0 ELSE 0.0 END) AS share FROM op GROUP BY 1) SELECT phase, ops, share = 0 AS read_only, share <= 0.5 AS read_optimized, CASE WHEN share = 0 THEN 1 ELSE 4096 END AS flush_at, CASE WHEN share <= 0.5 THEN 1 ELSE 4 END AS compact_at FROM w")
def eng_modes(t: Tables) -> DataFrame:
    """Modes that each seven operations of the load ask for, and the thresholds they set.
    Writes are never rejected."""
    load = stats.classify_load(t.oplog.withColumn("phase", F.floor(F.col("seq") / 7)), "phase", F.col("event_type").isin("purchase", "error"))
    plain = Config()
    modes = load.select("phase", "ops", (F.col("mode") == "read_only").alias("read_only"), (F.col("mode") != "write").alias("read_optimized"))
    return modes.withColumns({"flush_at": F.when(F.col("read_only"), 1).otherwise(plain.flush_at), "compact_at": F.when(F.col("read_optimized"), 1).otherwise(plain.compact_at)})


@query("eng_thresholds", "SELECT v AS runs, greatest(1, least(31, v)) AS stall_at, v >= 4 AS due, v >= 1 AS due_read_optimized, false AS due_disabled, v >= 20 AS stalled FROM range(-3, 41) r(v)", base=False)
def eng_thresholds(t: Tables) -> DataFrame:
    plain, quick, off, stall = Config(), Config(read_optimized=True), Config(compaction_enabled=False), Config(stall_at=20)
    decided = [(v, Config(stall_at=v).stall_at, plain.compaction_due(v), quick.compaction_due(v), off.compaction_due(v), stall.stalled(v)) for v in range(-3, 41)]
    return rows(t, "runs long, stall_at long, due boolean, due_read_optimized boolean, due_disabled boolean, stalled boolean", *decided)


# ---- log


@query("log_write_delete", "SELECT seq, prefix, suffix FROM op WHERE is_delete")
def log_write_delete(t: Tables) -> DataFrame:
    """Delete records as the log gives them back; they carry no value that counts."""
    return loaded(t, 0, False).tail.where("is_delete").select("seq", "prefix", "suffix")


@query("log_read_segment", "SELECT seq, prefix, suffix, is_delete, value, (SELECT count(*) FROM op WHERE seq // 100 = 3) AS entries FROM op WHERE seq // 100 = 3")
def log_read_segment(t: Tables) -> DataFrame:
    """One segment of the log and how many records it holds."""
    part = t.log.where("seq >= 300 AND seq < 400")
    return part.crossJoin(F.broadcast(part.agg(F.count("*").alias("entries"))))


# ---- blocks


@query("blk_add", "SELECT run, block, slot, prefix, suffix, slot = 127 AS full_after FROM blk")
def blk_add(t: Tables) -> DataFrame:
    """Where every entry goes, and whether its block is full then."""
    return t.blocks.select("run", "block", "slot", "prefix", "suffix", (F.col("slot") == blocks.CAPACITY - 1).alias("full_after"))


@query("blk_flush", "SELECT run, block, count(*) AS entries, 128 - count(*) AS padding FROM blk GROUP BY run, block")
def blk_flush(t: Tables) -> DataFrame:
    return t.blocks.groupBy("run", "block").agg(F.count("*").alias("entries")).withColumn("padding", blocks.CAPACITY - F.col("entries"))


def point(t: Tables) -> DataFrame:
    """Probes looked up in the one block of each run that may hold them."""
    asked = probes(t).withColumn("probe", F.col("prefix") * 1000 + F.col("suffix"))
    held = intervals.stab(t.pst, asked, t.width).join(asked, "probe").drop("probe")
    return held.join(t.blocks.select("run", "block", "prefix", "suffix", "value"), ["run", "block", "prefix", "suffix"])


@query("pst_point", PROBES + " SELECT prefix, suffix, run, block, value, 16 AS size FROM probe JOIN blk USING (prefix, suffix)")
def pst_point(t: Tables) -> DataFrame:
    return point(t).select("prefix", "suffix", "run", "block", "value", F.lit(16).alias("size"))


@query("pst_point_window", PROBES + " SELECT prefix, suffix, run, block, value, 16 AS size FROM probe JOIN blk USING (prefix, suffix)")
def pst_point_window(t: Tables) -> DataFrame:
    found = blocks.search_window(t.blocks, probes(t), t.windows)
    return found.select("prefix", "suffix", "run", "block", "value", F.lit(16).alias("size"))


@query("pst_iter", "SELECT run, block, slot, prefix, suffix, value, slot = max(slot) OVER (PARTITION BY run, block) AS last_one FROM blk")
def pst_iter(t: Tables) -> DataFrame:
    """Every block in slot order, with the mark of its last entry."""
    ends = t.pst.select("run", "block", (F.col("entries") - 1).alias("last"))
    return t.blocks.join(ends, ["run", "block"]).select("run", "block", "slot", "prefix", "suffix", "value", (F.col("slot") == F.col("last")).alias("last_one"))


@query("kv_iter", ", f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY prefix, suffix) AS r FROM runkv WHERE prefix > 42 OR (prefix = 42 AND suffix >= 17)) SELECT a.run, a.prefix AS at_prefix, a.suffix AS at_suffix, b.prefix AS next_prefix, b.suffix AS next_suffix FROM f a LEFT JOIN f b ON b.run = a.run AND b.r = 2 WHERE a.r = 1", base=True)
def kv_iter(t: Tables) -> DataFrame:
    """A cursor over each run moved to a key, and its next step."""
    key = F.struct("prefix", "suffix")
    ahead = t.runs.where(keys.at_or_after(*LOW)).select("run", key.alias("key"))
    first = ahead.groupBy("run").agg(F.min("key").alias("at"))
    after = ahead.join(F.broadcast(first), "run").where("key > at").groupBy("run").agg(F.min("key").alias("next"))
    return first.join(after, "run", "left").select("run", F.col("at.prefix").alias("at_prefix"), F.col("at.suffix").alias("at_suffix"), F.col("next.prefix").alias("next_prefix"), F.col("next.suffix").alias("next_suffix"))


@query("rec_iter_compact", "SELECT run, prefix, suffix, is_delete, value, row_number() OVER (PARTITION BY prefix, suffix ORDER BY run DESC) AS nth FROM runkv")
def rec_iter_compact(t: Tables) -> DataFrame:
    """The stream that a merge reads: all runs by key, of equal keys the newest run first."""
    nth = F.row_number().over(Window.partitionBy("prefix", "suffix").orderBy(F.desc("run")))
    return t.runs.select("run", "prefix", "suffix", "is_delete", "value", nth.alias("nth"))


# ---- versions


@query("ver_find_record", PROBES + " SELECT prefix, suffix, run, block, suffix_min, suffix_max, cnt FROM (SELECT probe.prefix, probe.suffix, run, block, suffix_min, suffix_max, cnt, row_number() OVER (PARTITION BY probe.prefix, probe.suffix ORDER BY suffix_max, run DESC, block) AS rn FROM probe JOIN win ON probe.prefix = win.prefix AND probe.suffix BETWEEN suffix_min AND suffix_max) WHERE rn = 1")
def ver_find_record(t: Tables) -> DataFrame:
    """The window that answers each probe."""
    asked = probes(t)
    return intervals.lookup(t.windows, asked).select("prefix", "suffix", "run", "block", "suffix_min", "suffix_max", "cnt")


@query("ver_l0_ring", ", f AS (SELECT DISTINCT seq * 40 // (me + 1) AS id FROM op, bnd) SELECT id, id % 31 AS slot, id < 5 + 31 AS fits, id <> 12 AS ready, id >= 5 AND min(CASE WHEN id = 12 THEN 0 ELSE 1 END) OVER (ORDER BY id) = 1 AS visible FROM f")
def ver_l0_ring(t: Tables) -> DataFrame:
    """Forty flushes through a ring of 31 whose first five are freed and whose twelfth isn't
    ready: a run is visible if no run up to it is missing."""
    runs = t.oplog.select(F.floor(F.col("seq") * 40 / (t.bounds[0] + 1)).alias("id")).distinct()
    gap = F.broadcast(runs.where("id = 12").agg(F.min("id").alias("gap")))
    seen = (F.col("id") >= 5) & (F.col("gap").isNull() | (F.col("id") < F.col("gap")))
    return runs.crossJoin(gap).select("id", (F.col("id") % RING).alias("slot"), (F.col("id") < 5 + RING).alias("fits"), (F.col("id") != 12).alias("ready"), seen.alias("visible"))


@query("ver_seq", "SELECT * FROM (VALUES ('append', 1), ('append', 2), ('flush', 3), ('append', 4), ('flush', 5), ('compact', 6)) AS v(step, version)", base=False)
def ver_seq(t: Tables) -> DataFrame:
    """The version after each commit."""
    store, steps = Store(t.spark, scratch(t.spark, "store")), []
    for step, act in (("append", 0), ("append", 1), ("flush", None), ("append", 2), ("flush", None), ("compact", None)):
        store.append(of_run(t, act)) if act is not None else getattr(store, step)()
        steps.append((step, store.now.version))
    return rows(t, "step string, version long", *steps)


@query("ver_insert_l1", FRAGMENTS + " SELECT prefix, bool_or(run = 1) AS inserted, bool_or(run = 0) AS deleted FROM frag WHERE run = 1 OR (run = 0 AND block % 2 = 0) GROUP BY prefix")
def ver_insert_l1(t: Tables) -> DataFrame:
    """Prefixes that change as run 1's tables come in and every other table of run 0 goes."""
    part = fragment_rows(t).where("run = 1 OR (run = 0 AND block % 2 = 0)")
    return part.groupBy("prefix").agg(F.bool_or(F.col("run") == 1).alias("inserted"), F.bool_or(F.col("run") == 0).alias("deleted"))


@query("ver_batch", 'SELECT prefix, suffix_min, suffix_max, block, "offset", cnt FROM win WHERE run = 3')
def ver_batch(t: Tables) -> DataFrame:
    """Three nested updates collected and applied at once: what one adds and a later one
    deletes cancels out."""
    step = lambda run: t.windows.where(F.col("run") == run)
    adds = step(1).unionByName(step(2)).unionByName(step(3))
    deletes = step(0).unionByName(step(1)).unionByName(step(2))
    return delta.apply(step(0), delta.normalize(adds, deletes))


@query("ver_export", "SELECT pst.run, pst.block, entries, windows, prefixes FROM pst JOIN (SELECT run, block, count(*) AS windows, count(DISTINCT prefix) AS prefixes FROM win GROUP BY run, block) USING (run, block) WHERE run = 0")
def ver_export(t: Tables) -> DataFrame:
    """Active tables of the bottom level with their records."""
    held = t.windows.groupBy("run", "block").agg(F.count("*").alias("windows"), F.countDistinct("prefix").alias("prefixes"))
    return t.pst.where("run = 0").join(held, ["run", "block"]).select("run", "block", "entries", "windows", "prefixes")


HEADERS = ", hd AS (SELECT prefix, 4 AS format, CASE WHEN count(DISTINCT (run, block)) = 1 AND count(*) = 1 AND sum(cnt) <= 128 THEN 'tiny' ELSE 'normal' END AS mode, count(*) AS records, CAST(sum(cnt) AS BIGINT) AS entries, CAST(sum(suffix_min * 31 + suffix_max * 17 + cnt) AS BIGINT) AS checksum FROM win GROUP BY prefix)"
BROKEN = HEADERS + ", pr AS (SELECT prefix, CASE prefix % 6 WHEN 1 THEN 'format' WHEN 2 THEN 'mode' WHEN 3 THEN 'records' WHEN 4 THEN 'order' WHEN 5 THEN 'checksum' ELSE 'ok' END AS problem FROM hd)"


def planted(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An export in which five of six prefixes are spoilt, each kind in its own way."""
    headers, kind = snapshot.export(t.windows), F.col("prefix") % 6
    headers = headers.withColumns(
        {
            "format": F.when(kind == 1, 9).otherwise(F.col("format")),
            "mode": F.when(kind == 2, "odd").otherwise(F.col("mode")),
            "records": F.when(kind == 3, F.col("records") + 1).otherwise(F.col("records")),
            "checksum": F.when(kind == 5, F.col("checksum") + 1).otherwise(F.col("checksum")),
        }
    )
    return headers, t.windows.withColumn("suffix_min", F.when(kind == 4, F.col("suffix_max") + 1).otherwise(F.col("suffix_min")))


@query("ver_snapshot_export", HEADERS + " SELECT * FROM hd")
def ver_snapshot_export(t: Tables) -> DataFrame:
    return snapshot.export(t.windows)


@query("ver_snapshot_import", BROKEN + " SELECT * FROM pr")
def ver_snapshot_import(t: Tables) -> DataFrame:
    """What the import finds in each prefix of a spoilt export."""
    return snapshot.problems(*planted(t))


@query("ver_bulk_recover", FRAGMENTS + " SELECT prefix, count(*) AS records FROM frag WHERE NOT (run = 2 AND block % 2 = 1) GROUP BY prefix")
def ver_bulk_recover(t: Tables) -> DataFrame:
    """The index built from the valid tables; every other one of run 2 is dropped before."""
    valid = t.pst.where("NOT (run = 2 AND block % 2 = 1)")
    return intervals.fragments(valid, t.log.select("prefix").distinct(), t.width).groupBy("prefix").agg(F.count("*").alias("records"))


# ---- flush and compaction


@query("fl_run", ", seg AS (SELECT seq // 100 AS segment, max(run) AS run FROM op GROUP BY 1), fr AS (SELECT run, count(*) AS reclaimed FROM seg WHERE run < 2 GROUP BY run), k AS (SELECT run, count(*) AS entries, count(*) FILTER (is_delete) AS tombstones, count(DISTINCT block) AS blocks FROM blk WHERE run < 2 GROUP BY run) SELECT run, entries, tombstones, blocks, coalesce(reclaimed, 0) AS reclaimed FROM k LEFT JOIN fr USING (run)")
def fl_run(t: Tables) -> DataFrame:
    """Flushes of the first two runs: entries, blocks, and the log segments that no later run
    needs, which are reclaimed."""
    last = t.oplog.groupBy(F.floor(F.col("seq") / 100).alias("segment")).agg(F.max("run").alias("run"))
    freed = last.where("run < 2").groupBy("run").agg(F.count("*").alias("reclaimed"))
    kept = t.blocks.where("run < 2").groupBy("run").agg(F.count("*").alias("entries"), F.count_if("is_delete").alias("tombstones"), F.countDistinct("block").alias("blocks"))
    return kept.join(freed, "run", "left").withColumn("reclaimed", F.coalesce("reclaimed", F.lit(0)))


@query("fl_pst", "SELECT run, count(*) AS tables, min(min_prefix * 1000 + min_suffix) AS lo, max(max_prefix * 1000 + max_suffix) AS hi, max(max_seq) AS max_seq FROM pst GROUP BY run")
def fl_pst(t: Tables) -> DataFrame:
    """What a flush registers for its run."""
    flat = lambda side: F.col(f"{side}_prefix") * 1000 + F.col(f"{side}_suffix")
    return t.pst.groupBy("run").agg(F.count("*").alias("tables"), F.min(flat("min")).alias("lo"), F.max(flat("max")).alias("hi"), F.max("max_seq").alias("max_seq"))


@query("fl_parallel", "SELECT run, prefix, suffix, row_number() OVER (PARTITION BY run ORDER BY prefix, suffix) - 1 AS place FROM runkv")
def fl_parallel(t: Tables) -> DataFrame:
    """Places of all entries in their run, counted by range partition: those of a serial flush."""
    part = blocks.partition_of(F.col("prefix"), t.width)
    return blocks.ranked(t.runs, ["run"], part, ["prefix", "suffix"], 4 * t.parts + 4).select("run", "prefix", "suffix", F.col("rank").alias("place"))


@query("cp_merge_parallel", "SELECT prefix // width AS part, prefix, suffix, value, is_delete, run FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY run DESC) AS r FROM runkv), bnd WHERE r = 1")
def cp_merge_parallel(t: Tables) -> DataFrame:
    """The merge of each range partition by itself; together they are the whole merge."""
    parts = t.runs.withColumn("part", blocks.partition_of(F.col("prefix"), t.width))
    return fold.newest(parts, ("part", *fold.KEY), "run").select("part", "prefix", "suffix", "value", "is_delete", "run")


@query("cp_synth_windows", "SELECT * FROM win WHERE run = 1 AND block % 2 = 0")
def cp_synth_windows(t: Tables) -> DataFrame:
    """Windows derived anew from the entries of some blocks."""
    return blocks.windows(t.blocks.where("run = 1 AND block % 2 = 0"))


OLD = "SELECT DISTINCT run, block FROM win WHERE run = 0 AND prefix BETWEEN 42 AND 45 AND NOT (prefix = 42 AND suffix_max < 17) AND NOT (prefix = 45 AND suffix_min > 10)"


@query("cp_obsolete", f", r AS ({OLD}), o AS (SELECT 'inputs' AS source, run, block FROM pst WHERE run = 0 AND block % 4 = 0 UNION ALL SELECT 'blocks', run, block FROM r WHERE block % 2 = 0 UNION ALL SELECT 'records', run, block FROM r) SELECT source, run, block, entries FROM o JOIN pst USING (run, block)")
def cp_obsolete(t: Tables) -> DataFrame:
    """Tables that a compaction makes obsolete, from the first source that names any: its
    inputs, else its unique blocks, else the records that it read; from none, no table.
    Where a source is empty, the choice is that of the next one, which is listed once."""
    table, none = t.pst, t.pst.select("run", "block").limit(0)
    inputs = table.where("run = 0 AND block % 4 = 0").select("run", "block")
    records = intervals.clip(t.windows.where("run = 0"), LOW, HIGH).select("run", "block").distinct()
    some = records.where("block % 2 = 0")
    chosen = [intervals.obsolete(table, *given) for given in ((inputs, some, records), (none, some, records), (none, none, records), (none, none, none))]
    out = chosen[0]
    for part in chosen[1:]:
        out = out.unionByName(part)
    return out.select("source", "run", "block", "entries").distinct()


@query("cp_clean", "SELECT 9 AS version, 0 AS runs, 0 AS batches, (SELECT count(*) FROM st) AS entries")
def cp_clean(t: Tables) -> DataFrame:
    """What one commit after a compaction says: no runs, a new bottom level."""
    store = loaded(t, 4, True)
    now = Store(t.spark, store.path).now
    return store.base.agg(F.count("*").alias("entries")).select(F.lit(now.version).alias("version"), F.lit(len(now.runs)).alias("runs"), F.lit(len(now.batches)).alias("batches"), "entries")


@query("cp_reclaim", "SELECT * FROM (VALUES ('oplog', 4), ('level=0', 4)) AS v(kind, folders)", base=False)
def cp_reclaim(t: Tables) -> DataFrame:
    """Folders that are removed after the commit that supersedes them."""
    gone = [g.split("/")[0] for g in loaded(t, 4, True).collect()]
    return rows(t, "kind string, folders long", *[(k, gone.count(k)) for k in sorted(set(gone))])


# ---- manifest


def stopped(t: Tables, step: str) -> Store:
    """A store whose second append was stopped at a step, opened anew."""
    store = Store(t.spark, scratch(t.spark, "store"))
    store.append(of_run(t, 0))

    def trip(name: str) -> None:
        if name == step:
            raise InterruptedError(name)

    store.trip = trip
    try:
        store.append(of_run(t, 1))
    except InterruptedError:
        pass
    return Store(t.spark, store.path)


def told(t: Tables, case: str, store: Store) -> DataFrame:
    now = store.now
    return store.state.agg(F.count("*").alias("live")).select(F.lit(case).alias("case"), F.lit(now.version).cast("long").alias("version"), F.lit(len(now.batches)).cast("long").alias("batches"), "live")


@query("mf_open", f"SELECT 'fresh' AS \"case\", 0 AS version, 0 AS batches, 0 AS live UNION ALL SELECT 'again', 1, 1, {LIVE.format(0)}")
def mf_open(t: Tables) -> DataFrame:
    fresh = Store(t.spark, scratch(t.spark, "store"))
    used = Store(t.spark, scratch(t.spark, "store"))
    used.append(of_run(t, 0))
    return told(t, "fresh", fresh).unionByName(told(t, "again", Store(t.spark, used.path)))


@query("mf_commit", f"SELECT 'abort' AS \"case\", 1 AS version, 1 AS batches, {LIVE.format(0)} AS live UNION ALL SELECT 'commit', 2, 2, {LIVE.format(1)}")
def mf_commit(t: Tables) -> DataFrame:
    """A transaction stopped before its pointer leaves nothing behind; one that ends counts."""
    return told(t, "abort", stopped(t, "before_pointer")).unionByName(told(t, "commit", stopped(t, "never")))


@query("mf_failpoint", f"SELECT 'after_log' AS \"case\", 1 AS version, 1 AS batches, {LIVE.format(0)} AS live UNION ALL SELECT 'before_pointer', 1, 1, {LIVE.format(0)} UNION ALL SELECT 'after_pointer', 2, 2, {LIVE.format(1)}")
def mf_failpoint(t: Tables) -> DataFrame:
    parts = [told(t, step, stopped(t, step)) for step in ("after_log", "before_pointer", "after_pointer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("mf_replay", f"SELECT 'torn' AS \"case\", 1 AS version, 1 AS batches, {LIVE.format(0)} AS live UNION ALL SELECT 'replayed', 2, 2, {LIVE.format(1)} UNION ALL SELECT 'twice', 2, 2, {LIVE.format(1)}")
def mf_replay(t: Tables) -> DataFrame:
    """The newest slot is torn: the one before counts, the lost batch is replayed, and a
    second replay changes nothing."""
    store = Store(t.spark, scratch(t.spark, "store"))
    store.append(of_run(t, 0), 0)
    store.append(of_run(t, 1), 1)
    store.files.write(f"{store.path}/_pointer.{store.now.version % 2}", store.now.text()[:30])
    found = Store(t.spark, store.path)
    out = told(t, "torn", found)
    found.append(of_run(t, 1), 1)
    out = out.unionByName(told(t, "replayed", Store(t.spark, store.path)))
    found.append(of_run(t, 1), 1)
    return out.unionByName(told(t, "twice", Store(t.spark, store.path)))


@query("mf_add", "SELECT * FROM (VALUES ('flushed', 1, 0), ('flushed', 2, 0), ('compacted', 0, 1)) AS v(event, runs, bases)", base=False)
def mf_add(t: Tables) -> DataFrame:
    """Tables that the manifest names as flushes add some and a compaction takes them off."""
    store, seen = Store(t.spark, scratch(t.spark, "store")), []
    note = lambda event: seen.append((event, len(store.now.runs), int(store.now.base is not None)))
    for run in (0, 1):
        store.append(of_run(t, run))
        store.flush()
        note("flushed")
    store.compact()
    note("compacted")
    return rows(t, "event string, runs long, bases long", *seen)


@query("mf_versions", "SELECT 7 AS version, 5 AS l0_version, 3 AS l1_version, (SELECT max(seq) FROM op WHERE run < 3) AS flushed_seq")
def mf_versions(t: Tables) -> DataFrame:
    """Versions and ids after a compaction, a flush, and an append that isn't flushed."""
    store = Store(t.spark, scratch(t.spark, "store"))
    for run in (0, 1):
        store.append(of_run(t, run))
    store.flush(), store.compact()
    store.append(of_run(t, 2))
    store.flush()
    store.append(of_run(t, 3))
    now = Store(t.spark, store.path).now
    return rows(t, "version long, l0_version long, l1_version long, flushed_seq long", (now.version, min(now.runs), now.base, now.flushed_seq))


@query("mf_flushlog", "SELECT run AS batch, run >= 2 AS pending, CASE WHEN run >= 2 THEN count(*) END AS redo FROM op GROUP BY run")
def mf_flushlog(t: Tables) -> DataFrame:
    """Batches of the log after a flush of the first two: what recovery has to redo."""
    store = Store(t.spark, scratch(t.spark, "store"))
    for run in range(4):
        store.append(of_run(t, run), run)
        if run == 1:
            store.flush()
    now = Store(t.spark, store.path).now
    redo = store.tail.select(F.col("seq")).join(t.oplog.select("seq", "run"), "seq").groupBy("run").agg(F.count("*").alias("redo"))
    known = rows(t, "batch long, pending boolean", *[(b, b in now.batches) for b in range(4)])
    return known.join(redo.withColumnRenamed("run", "batch"), "batch", "left").select("batch", "pending", "redo")


# ---- interval index


@query("l1_range_parallel", CLIP + " SELECT run, block, prefix, suffix_min, suffix_max, row_number() OVER (ORDER BY prefix, suffix_min, suffix_max, run DESC, block) - 1 AS place FROM clip")
def l1_range_parallel(t: Tables) -> DataFrame:
    """Records of a range with their places in it, counted prefix by prefix: a serial scan's."""
    met = intervals.clip(t.windows, LOW, HIGH).select("run", "block", "prefix", "suffix_min", "suffix_max").withColumns({"all": F.lit(0), "newest": -F.col("run")})
    return blocks.ranked(met, ["all"], F.col("prefix"), ["prefix", "suffix_min", "suffix_max", "newest", "block"], HIGH[0] - LOW[0] + 1).select("run", "block", "prefix", "suffix_min", "suffix_max", F.col("rank").alias("place"))


@query("l1_route", PROBES + TINY.format(0) + " SELECT p.prefix, coalesce(blocks, 0) AS blocks, coalesce(windows, 0) AS windows, p.prefix BETWEEN 42 AND 45 AS in_range FROM (SELECT DISTINCT prefix FROM probe) p LEFT JOIN des USING (prefix)")
def l1_route(t: Tables) -> DataFrame:
    """The descriptor that each probe's prefix leads to, and those of a range of prefixes."""
    asked = probes(t).select("prefix").distinct()
    routes = stats.descriptor(t.windows.where("run = 0")).select("prefix", "blocks", "windows")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(routes, "prefix", "left").select("prefix", zero("blocks"), zero("windows"), F.col("prefix").between(LOW[0], HIGH[0]).alias("in_range"))


@query("l1_update_stats", NORMAL + " SELECT count(DISTINCT prefix) AS prefixes, count(*) FILTER (op = 'add') AS adds, count(*) FILTER (op = 'delete') AS deletes, count(*) FILTER (op = 'replace') AS replaces, CAST(sum(CASE WHEN op = 'delete' THEN 0 ELSE cnt END) AS BIGINT) AS entries FROM dl")
def l1_update_stats(t: Tables) -> DataFrame:
    """Counters of an update of the index from the oldest run's windows to the next run's."""
    ops = delta.normalize(t.windows.where("run = 1"), t.windows.where("run = 0"))
    of = lambda name: F.count_if(F.col("op") == name).alias(f"{name}s")
    return ops.agg(F.countDistinct("prefix").alias("prefixes"), of("add"), of("delete"), of("replace"), F.sum(F.when(F.col("op") == "delete", 0).otherwise(F.col("cnt"))).alias("entries"))


@query("l1_state_io", BROKEN + " SELECT win.* FROM win JOIN pr USING (prefix) WHERE problem = 'ok'")
def l1_state_io(t: Tables) -> DataFrame:
    """The windows that an import of a spoilt export takes in."""
    return snapshot.imported(*planted(t)).select("run", "block", "prefix", "suffix_min", "suffix_max", "offset", "cnt")


@query("l1_debug", 'SELECT run, block, suffix_min, suffix_max, "offset", cnt FROM win WHERE prefix = 42')
def l1_debug(t: Tables) -> DataFrame:
    """The partition of one prefix."""
    return t.windows.where("prefix = 42").select("run", "block", "suffix_min", "suffix_max", "offset", "cnt")


@query("l1_governance_lineitem", "SELECT l_suppkey AS prefix, count(*) AS records, count(*) >= 512 AS hot, count(*) >= 1024 AS prefer_cow, count(*) >= 512 AS parallel FROM lineitem GROUP BY l_suppkey", base=False)
def l1_governance_lineitem(t: Tables) -> DataFrame:
    """The thresholds as they are set by default."""
    return stats.governance(t["lineitem"].select(F.col("l_suppkey").alias("prefix")))


@query("l1_descriptor_default", TINY.format(0) + " SELECT *, CASE WHEN blocks = 1 AND windows = 1 AND entries <= 128 THEN 'tiny' ELSE 'normal' END AS mode FROM des")
def l1_descriptor_default(t: Tables) -> DataFrame:
    return stats.descriptor(t.windows.where("run = 0"))


@query("al_space", "SELECT run, count(*) AS tables, count(*) * 4096 AS bytes FROM pst GROUP BY run")
def al_space(t: Tables) -> DataFrame:
    """Space that each run's blocks take up."""
    return t.pst.groupBy("run").agg(F.count("*").alias("tables")).withColumn("bytes", F.col("tables") * 4096)


# ---- generators, loads and figures


@query("gen_uniform_id", f"SELECT o_orderkey, lpad(CAST(1 + (((o_orderkey + 1)::HUGEINT * 11400714819323198393) % {U64}) % (SELECT count(*) FROM orders) AS VARCHAR), 16, '0') AS id FROM orders", base=False)
def gen_uniform_id(t: Tables) -> DataFrame:
    """Ids spread evenly over 1 to N, padded with zeros."""
    n = t["orders"].count()
    place = keys.unsigned(keys.hash_key(F.col("o_orderkey"))) % F.lit(n) + 1
    return t["orders"].select("o_orderkey", F.lpad(place.cast("decimal(20,0)").cast("string"), 16, "0").alias("id"))


@query("wl_write_online", ", b AS (SELECT seq * 8 // (me + 1) AS batch, count(*) AS ops FROM op, bnd GROUP BY 1) SELECT batch, ops, (batch + 1) % 3 AS runs, (batch + 1) // 3 AS compactions, (SELECT count(*) FROM st) AS live FROM b")
def wl_write_online(t: Tables) -> DataFrame:
    """Eight batches of puts, each flushed, with a compaction at three runs; then a drain."""
    store, seen, compactions = Store(t.spark, scratch(t.spark, "store"), config=Config(compact_at=3)), [], 0
    numbered = t.oplog.withColumn("batch", F.floor(F.col("seq") * 8 / (t.bounds[0] + 1)))
    for batch in range(8):
        store.append(numbered.where(F.col("batch") == batch), batch)
        before = store.now.base
        store.maintain()
        compactions += store.now.base != before
        seen.append((batch, len(store.now.runs), compactions))
    store.compact()
    ops = numbered.groupBy("batch").agg(F.count("*").alias("ops"))
    live = store.state.agg(F.count("*").alias("live"))
    return rows(t, "batch long, runs long, compactions long", *seen).join(ops, "batch").crossJoin(F.broadcast(live)).select("batch", "ops", "runs", "compactions", "live")


@query("an_latency", ", v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM op WHERE value IS NOT NULL), e AS (SELECT epoch(max(ts)) - epoch(min(ts)) AS elapsed FROM events) SELECT max(n) AS n, round(avg(value), 6) AS avg_v, max(CASE WHEN r = least(n - 1, n * 99 // 100) THEN value END) AS p99, round(max(n) / max(elapsed), 9) AS throughput FROM v, e")
def an_latency(t: Tables) -> DataFrame:
    """Mean and p99 of the events' values, and events a second of the time they span."""
    span = t["events"].agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("micros"))
    figures = stats.latency(t.log, "value").crossJoin(F.broadcast(span))
    return figures.select("n", F.round("avg_v", 6).alias("avg_v"), "p99", F.round(F.col("n") / (F.col("micros") / 1e6), 9).alias("throughput"))


#: Keys up to which a route's hot leaves get so many MiB.
BUDGETS = ((1_000_000, 0), (10_000_000, 32), (100_000_000, 64), (1_000_000_000, 512), (10_000_000_000, 2048), (100_000_000_000, 8192))
BEYOND = 32_768
RATIOS = (0.1, 0.05, 0.01)


@query("an_sweep", ", k AS (SELECT count(*) AS n FROM orders), s AS (SELECT n * times AS keys, ratio FROM k, (VALUES (1), (1000), (100000), (100000000)) m(times), (VALUES (0.1), (0.05), (0.01)) r(ratio)) SELECT keys, CAST(ratio AS DOUBLE) AS ratio, CAST(floor(keys * ratio) AS BIGINT) AS prefixes, CASE " + " ".join(f"WHEN keys <= {k} THEN {m}" for k, m in BUDGETS) + f" ELSE {BEYOND} END AS budget_mib FROM s")
def an_sweep(t: Tables) -> DataFrame:
    """Parameter matrix of a sweep: prefixes by ratio, and the budget by the number of keys."""
    n = t["orders"].count()
    cases = rows(t, "keys long, ratio double, percent long", *[(n * times, r, round(r * 100)) for times in (1, 1000, 100_000, 100_000_000) for r in RATIOS])
    budget = F.lit(BEYOND)
    for most, mib in reversed(BUDGETS):
        budget = F.when(F.col("keys") <= most, mib).otherwise(budget)
    return cases.select("keys", "ratio", F.floor(F.col("keys") * F.col("percent") / 100).alias("prefixes"), budget.alias("budget_mib"))


@query("an_reopen_rss", PROBES + " SELECT count(*) AS checked, count(st.seq) AS found, (SELECT count(*) FROM st) AS live FROM probe LEFT JOIN st USING (prefix, suffix)")
def an_reopen_rss(t: Tables) -> DataFrame:
    """A store opened anew after a compaction, validated by probes and by the count of keys."""
    again = Store(t.spark, loaded(t, 4, True).path)
    found = lookup.multiget(again.state, probes(t)).agg(F.count("*").alias("checked"), F.count_if("hit").alias("found"))
    return found.crossJoin(F.broadcast(again.state.agg(F.count("*").alias("live"))))
