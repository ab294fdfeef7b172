"""The query catalogue: every operator as a query with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import keys
from tidemark.operators import blocks, delta, fold, intervals, lookup, stats
from tidemark.sources.tables import Tables

Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """
WITH bnd AS (SELECT max(event_id) AS me, max(user_id) AS mu, max(user_id) // 12 + 1 AS width FROM events),
op AS (SELECT event_id AS seq, user_id AS prefix, CAST(json_extract_string(props, '$.k') AS BIGINT) AS suffix,
  event_type = 'error' AS is_delete, value, event_type, (event_id * 4) // (me + 1) AS run FROM events, bnd),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS rn FROM op) WHERE rn = 1),
st AS (SELECT prefix, suffix, value, seq FROM latest WHERE NOT is_delete),
runkv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, prefix, suffix ORDER BY seq DESC) AS rn FROM op) WHERE rn = 1),
blk AS (SELECT run, prefix, suffix, seq, is_delete, value, (prefix // width) * 1099511627776 + rk // 128 AS block, rk % 128 AS slot FROM
  (SELECT runkv.*, width, row_number() OVER (PARTITION BY run, prefix // width ORDER BY prefix, suffix) - 1 AS rk FROM runkv, bnd)),
pst AS (SELECT run, block, arg_min(prefix, slot) AS min_prefix, arg_min(suffix, slot) AS min_suffix, arg_max(prefix, slot) AS max_prefix,
  arg_max(suffix, slot) AS max_suffix, count(*) AS entries, max(seq) AS max_seq FROM blk GROUP BY run, block),
win AS (SELECT run, block, prefix, min(suffix) AS suffix_min, max(suffix) AS suffix_max, min(slot) AS "offset", count(*) AS cnt FROM blk GROUP BY run, block, prefix)
"""


def query(name: str, sql: str | None = None, base: bool = True):
    """Register a query and, where given, its SQL (on top of the base relations)."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (BASE if base else "") + sql
        return f

    return add


# ---- client operations

LOW, HIGH = (42, 17), (45, 10)
IN_RANGE = "(prefix > 42 OR (prefix = 42 AND suffix >= 17)) AND (prefix < 45 OR (prefix = 45 AND suffix <= 10))"


@query("kv_fold", "SELECT * FROM st")
def kv_fold(t: Tables) -> DataFrame:
    return t.state


@query("kv_put", "SELECT prefix, suffix, CASE WHEN prefix % 10 = 0 THEN value + 1 ELSE value END AS value FROM st")
def kv_put(t: Tables) -> DataFrame:
    """Every tenth prefix is put again with a value one higher; the fold takes the puts."""
    writes = t.state.where("prefix % 10 = 0").select("seq", "prefix", "suffix", F.lit(False).alias("is_delete"), (F.col("value") + 1).alias("value"))
    return fold.fold_live(fold.appended(t.log, writes.withColumnRenamed("seq", "rank"), t.bounds[0] + 1)).select("prefix", "suffix", "value")


@query("kv_delete", "SELECT prefix, suffix, value, seq FROM st WHERE suffix % 5 <> 0")
def kv_delete(t: Tables) -> DataFrame:
    """Blind deletes of present and absent keys."""
    gone = t.log.where("suffix % 5 = 0").groupBy("prefix", "suffix").agg(F.max("seq").alias("rank")).withColumns({"is_delete": F.lit(True), "value": F.lit(None).cast("double")})
    return fold.fold_live(fold.appended(t.log, gone, t.bounds[0] + 1)).select("prefix", "suffix", "value", "seq")


@query("kv_get", "SELECT prefix, suffix, value, seq FROM st WHERE prefix = 0 AND suffix = 3")
def kv_get(t: Tables) -> DataFrame:
    return lookup.get(t.state, 0, 3)


@query("kv_multiget", ", own AS (SELECT o_custkey AS prefix, o_orderkey AS suffix, o_totalprice AS value FROM orders), probe AS (SELECT prefix, suffix FROM own UNION ALL SELECT prefix, suffix + 1000000000 FROM own) SELECT prefix, suffix, value, own.value IS NOT NULL AS hit FROM probe LEFT JOIN own USING (prefix, suffix)")
def kv_multiget(t: Tables) -> DataFrame:
    """Every key, and as many that lie behind all of them."""
    own = t.owners.select("prefix", "suffix")
    return lookup.multiget(t.owners, own.unionByName(own.withColumn("suffix", F.col("suffix") + 1_000_000_000)))


PROBES = ", probe AS (SELECT DISTINCT prefix, (suffix + 1) % 100 AS suffix FROM op)"


def probes(t: Tables) -> DataFrame:
    """The key behind that of every operation."""
    return t.log.select("prefix", ((F.col("suffix") + 1) % 100).alias("suffix")).distinct()


@query("kv_get_memtable", PROBES + " SELECT prefix, suffix, CASE WHEN seq IS NULL THEN 'miss' WHEN is_delete THEN 'deleted' ELSE 'found' END AS outcome FROM probe LEFT JOIN latest USING (prefix, suffix)")
def kv_get_memtable(t: Tables) -> DataFrame:
    return lookup.classify(t.folded, probes(t))


@query("kv_scan", "SELECT prefix, suffix FROM st WHERE prefix > 42 OR (prefix = 42 AND suffix >= 17) ORDER BY prefix, suffix LIMIT 100")
def kv_scan(t: Tables) -> DataFrame:
    return lookup.scan(t.state, *LOW, 100).select("prefix", "suffix")


@query("kv_rw_ratio", "SELECT run, count(*) AS ops, sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) AS writes, sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*) AS write_ratio FROM op GROUP BY run")
def kv_rw_ratio(t: Tables) -> DataFrame:
    return stats.classify_load(t.oplog, "run", F.col("event_type").isin("purchase", "error")).drop("mode")


@query("kv_get_stats", PROBES + " SELECT count(*) AS total, count(st.seq) AS hits, count(st.seq)::DOUBLE / count(*) AS hit_rate FROM probe LEFT JOIN st USING (prefix, suffix)")
def kv_get_stats(t: Tables) -> DataFrame:
    found = lookup.multiget(t.state, probes(t)).agg(F.count("*").alias("total"), F.sum(F.col("hit").cast("long")).alias("hits"))
    return found.withColumn("hit_rate", stats.ratio(F.col("hits"), F.col("total")))


# ---- engine policies and recovery


@query("eng_autotrigger", "SELECT run, count(*) AS ops, sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) AS writes, CASE WHEN sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) * 2 > count(*) THEN 'write' WHEN sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) = 0 THEN 'read_only' ELSE 'read_optimized' END AS mode FROM op GROUP BY run")
def eng_autotrigger(t: Tables) -> DataFrame:
    return stats.classify_load(t.oplog, "run", F.col("event_type").isin("purchase", "error")).drop("write_ratio")


@query("eng_autocompact", "SELECT count(DISTINCT run) AS runs, count(DISTINCT run) >= 4 AS compact FROM op")
def eng_autocompact(t: Tables) -> DataFrame:
    return t.oplog.agg(F.countDistinct("run").alias("runs")).withColumn("compact", F.col("runs") >= 4)


@query("eng_recover", "SELECT prefix, suffix, is_delete, value, seq FROM latest")
def eng_recover(t: Tables) -> DataFrame:
    """A snapshot of the log's first part, folded with the tail behind it."""
    seen = t.bounds[0] * 6 // 10
    snapshot = fold.fold_all(t.log.where(F.col("seq") <= seen))
    return fold.fold_all(snapshot.unionByName(t.log.where(F.col("seq") > seen), allowMissingColumns=True).select("seq", "prefix", "suffix", "is_delete", "value"))


@query("eng_lsn", "SELECT xor(prefix, suffix) & 255 AS bucket, count(*) AS n, max(seq) AS last_seq FROM op GROUP BY 1")
def eng_lsn(t: Tables) -> DataFrame:
    bucket = F.col("prefix").bitwiseXOR(F.col("suffix")).bitwiseAND(F.lit(255))
    return t.log.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("eng_memtable_size", "SELECT run, count(*) AS entries, count(DISTINCT prefix * 1000 + suffix) AS keys FROM op GROUP BY run")
def eng_memtable_size(t: Tables) -> DataFrame:
    return t.oplog.groupBy("run").agg(F.count("*").alias("entries"), F.countDistinct("prefix", "suffix").alias("keys"))


# ---- ordered index


@query("ix_get", "SELECT value FROM st WHERE prefix = 0 AND suffix = 3")
def ix_get(t: Tables) -> DataFrame:
    return lookup.get(t.state, 0, 3).select("value")


@query("ix_put", "SELECT prefix, suffix, value FROM latest")
def ix_put(t: Tables) -> DataFrame:
    return fold.newest(t.log.select("prefix", "suffix", "value", "seq"), fold.KEY, "seq").select("prefix", "suffix", "value")


@query("ix_put_validate", "SELECT prefix, suffix, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq % 50 DESC, seq DESC) AS r FROM op) WHERE r = 1")
def ix_put_validate(t: Tables) -> DataFrame:
    return fold.put_validate(t.log, F.col("seq") % 50).select("prefix", "suffix", "value", "seq")


@query("ix_delete", PROBES + " SELECT prefix, suffix, value, seq FROM st WHERE NOT EXISTS (SELECT 1 FROM probe WHERE probe.prefix = st.prefix AND probe.suffix = st.suffix)")
def ix_delete(t: Tables) -> DataFrame:
    return fold.without(t.state, probes(t))


@query("ix_scan", "SELECT value FROM st WHERE prefix > 42 OR (prefix = 42 AND suffix >= 17) ORDER BY prefix, suffix LIMIT 100")
def ix_scan(t: Tables) -> DataFrame:
    return lookup.scan(t.state, *LOW, 100).select("value")


@query("ix_scan2", "SELECT prefix, suffix, value FROM st WHERE prefix > 42 OR (prefix = 42 AND suffix >= 17) ORDER BY prefix, suffix LIMIT 100")
def ix_scan2(t: Tables) -> DataFrame:
    return lookup.scan(t.state, *LOW, 100).select("prefix", "suffix", "value")


@query("ix_scan_range", f"SELECT prefix, suffix, value, seq FROM st WHERE {IN_RANGE}")
def ix_scan_range(t: Tables) -> DataFrame:
    return lookup.scan_range(t.state, LOW, HIGH)


@query("ix_scan_prefix", "SELECT prefix, suffix, value, seq FROM st WHERE prefix = 42")
def ix_scan_prefix(t: Tables) -> DataFrame:
    return lookup.scan_prefix(t.state, 42)


STOP = "SELECT prefix, suffix, value FROM (SELECT *, coalesce(max(CASE WHEN value > 200 THEN 1 ELSE 0 END) OVER (ORDER BY prefix, suffix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM {0}) WHERE stopped = 0"


@query("ix_foreach", STOP.format("st"))
def ix_foreach(t: Tables) -> DataFrame:
    return lookup.foreach_until(t.state, F.col("value") > 200).select("prefix", "suffix", "value")


@query("ix_foreach_range", STOP.format(f"(SELECT * FROM st WHERE {IN_RANGE})"))
def ix_foreach_range(t: Tables) -> DataFrame:
    return lookup.foreach_until(t.state.where(keys.at_or_after(*LOW) & keys.at_or_before(*HIGH)), F.col("value") > 200).select("prefix", "suffix", "value")


# ---- log


@query("log_read_value", PROBES + " SELECT prefix, suffix, op.seq, op.value FROM probe JOIN latest USING (prefix, suffix) JOIN op USING (prefix, suffix) WHERE op.seq = latest.seq")
def log_read_value(t: Tables) -> DataFrame:
    """Dereference the log address that the index holds for each probe."""
    place = t.folded.select("prefix", "suffix", "seq").join(probes(t), ["prefix", "suffix"])
    return place.join(t.log.select("seq", "value"), "seq").select("prefix", "suffix", "seq", "value")


@query("log_segments_valid", "SELECT run, count(*) AS entries FROM op WHERE run <> 1 GROUP BY run")
def log_segments_valid(t: Tables) -> DataFrame:
    """Segments in use: those of all runs but the flushed one."""
    return t.oplog.where("run <> 1").groupBy("run").agg(F.count("*").alias("entries"))


@query("log_redo", "SELECT seq, prefix, suffix, is_delete, value FROM op WHERE run NOT IN (0, 2)")
def log_redo(t: Tables) -> DataFrame:
    done = t.spark.createDataFrame([(0,), (2,)], "run long")
    return t.oplog.join(F.broadcast(done), "run", "left_anti").select("seq", "prefix", "suffix", "is_delete", "value")


@query("log_group", "SELECT run, count(*) AS segments, sum(n) AS entries FROM (SELECT run, seq // 100 AS segment, count(*) AS n FROM op GROUP BY 1, 2) GROUP BY run")
def log_group(t: Tables) -> DataFrame:
    segments = t.oplog.groupBy("run", F.floor(F.col("seq") / 100).alias("segment")).agg(F.count("*").alias("n"))
    return segments.groupBy("run").agg(F.count("*").alias("segments"), F.sum("n").alias("entries"))


# ---- blocks


@query("blk_traverse", "SELECT run, block, slot, prefix, suffix, value FROM blk WHERE run = 0")
def blk_traverse(t: Tables) -> DataFrame:
    return t.blocks.where("run = 0").select("run", "block", "slot", "prefix", "suffix", "value")


@query("blk_search", "SELECT run, block, slot, value FROM blk WHERE prefix = 0 AND suffix = 3")
def blk_search(t: Tables) -> DataFrame:
    return lookup.get(t.blocks, 0, 3).select("run", "block", "slot", "value")


@query("blk_search_window", PROBES + " SELECT prefix, suffix, run, block, slot, value FROM probe JOIN blk USING (prefix, suffix)")
def blk_search_window(t: Tables) -> DataFrame:
    return blocks.search_window(t.blocks, probes(t), t.windows)


@query("pst_add", "SELECT * FROM pst")
def pst_add(t: Tables) -> DataFrame:
    return t.pst


@query("pst_meta_recover", "SELECT run, block, min_prefix, min_suffix, max_prefix, max_suffix, entries, 0 AS max_seq FROM pst")
def pst_meta_recover(t: Tables) -> DataFrame:
    return blocks.metadata(t.blocks.withColumn("seq", F.lit(0)))


@query("row_iter", "SELECT prefix, suffix, value, is_delete FROM blk WHERE run = 0 AND (prefix > 42 OR (prefix = 42 AND suffix >= 17))")
def row_iter(t: Tables) -> DataFrame:
    """A cursor over one run moved to a key: blocks that end before it are skipped."""
    ahead = t.pst.where((F.col("run") == 0) & (F.struct("max_prefix", "max_suffix") >= F.struct(F.lit(42).cast("long").alias("max_prefix"), F.lit(17).cast("long").alias("max_suffix")))).select("run", "block")
    return t.blocks.join(ahead, ["run", "block"], "left_semi").where(keys.at_or_after(*LOW)).select("prefix", "suffix", "value", "is_delete")


@query("rec_iter_scan", f"SELECT prefix, suffix, value, is_delete, run FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY run DESC) AS r FROM blk WHERE {IN_RANGE}) WHERE r = 1")
def rec_iter_scan(t: Tables) -> DataFrame:
    part = lookup.scan_range(t.runs, LOW, HIGH)
    return fold.merge_runs(part).select("prefix", "suffix", "value", "is_delete", "run")


@query("pst_delete", "SELECT run, block, entries FROM pst WHERE NOT (run = 0 AND block % 2 = 0)")
def pst_delete(t: Tables) -> DataFrame:
    gone = t.pst.where("run = 0 AND block % 2 = 0").select("run", "block")
    return t.pst.select("run", "block", "entries").join(gone, ["run", "block"], "left_anti")


@query("bulk_load", ", w AS (SELECT max(o_custkey) // 12 + 1 AS width FROM orders), r AS (SELECT o_custkey AS prefix, o_orderkey AS suffix, (o_custkey // width) * 1099511627776 + (row_number() OVER (PARTITION BY o_custkey // width ORDER BY o_custkey, o_orderkey) - 1) // 128 AS block FROM orders, w) SELECT block, count(*) AS entries, min(prefix) AS min_prefix, max(prefix) AS max_prefix FROM r GROUP BY block")
def bulk_load(t: Tables) -> DataFrame:
    """A sorted load past the log: rows straight to blocks."""
    width = int(t["orders"].agg(F.max("o_custkey")).first()[0]) // 12 + 1
    rows = blocks.cut(t.owners.withColumns({"run": F.lit(0), "seq": F.lit(0)}), width)
    return blocks.metadata(rows).select("block", "entries", "min_prefix", "max_prefix")


# ---- versions

RANK = ", p2 AS (SELECT *, max_prefix * 1000 + max_suffix AS hi, min_prefix * 1000 + min_suffix AS lo FROM pst), ask AS (SELECT seq AS probe, prefix, suffix, prefix * 1000 + suffix AS k FROM op)"


def asks(t: Tables) -> DataFrame:
    """The key of every operation."""
    return t.log.select(F.col("seq").alias("probe"), "prefix", "suffix")


@query("ver_get", PROBES + " SELECT prefix, suffix, run, value FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY run DESC) AS r FROM probe JOIN runkv USING (prefix, suffix)) WHERE r = 1 AND NOT is_delete")
def ver_get(t: Tables) -> DataFrame:
    """Newest run first; a delete there ends the search."""
    held = t.runs.join(probes(t), ["prefix", "suffix"], "left_semi")
    return fold.merge_runs(held).where("NOT is_delete").select("prefix", "suffix", "run", "value")


@query("ver_find_table", RANK + " SELECT run, probe, arg_min(block, hi) AS block FROM ask JOIN p2 ON hi >= k GROUP BY run, probe")
def ver_find_table(t: Tables) -> DataFrame:
    return intervals.first_tables(t.pst, asks(t), t.width)


@query("ver_find_table2", RANK + " SELECT run, probe, block FROM (SELECT run, probe, block, row_number() OVER (PARTITION BY run, probe ORDER BY hi) AS r FROM ask JOIN p2 ON hi >= k) WHERE r = 2")
def ver_find_table2(t: Tables) -> DataFrame:
    return intervals.first_tables(t.pst, asks(t), t.width, 2)


@query("ver_scan_tables", RANK + " SELECT run, block FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hi) AS r FROM p2 WHERE hi >= 42017) WHERE r <= 5")
def ver_scan_tables(t: Tables) -> DataFrame:
    ahead = intervals.overlapping(t.pst, LOW, ((1 << 63) - 1, 0))
    order = Window.partitionBy("run").orderBy("max_prefix", "max_suffix")
    return ahead.withColumn("r", F.row_number().over(order)).where("r <= 5").select("run", "block")


@query("ver_l1_iter", "SELECT prefix, suffix, value FROM latest WHERE NOT is_delete AND (prefix > 42 OR (prefix = 42 AND suffix >= 17))")
def ver_l1_iter(t: Tables) -> DataFrame:
    return t.state.where(keys.at_or_after(*LOW)).select("prefix", "suffix", "value")


@query("ver_publish", "SELECT run FROM (SELECT run, min(CASE WHEN run = 2 THEN 0 ELSE 1 END) OVER (ORDER BY run) AS ok FROM (SELECT DISTINCT run FROM op)) WHERE ok = 1")
def ver_publish(t: Tables) -> DataFrame:
    """Runs that are visible while run 2 isn't ready: the ready ones before the first gap."""
    runs = t.oplog.select("run").distinct()
    return runs.join(F.broadcast(runs.where("run = 2").agg(F.min("run").alias("gap"))), F.col("gap").isNull() | (F.col("run") < F.col("gap"))).select("run")


@query("ver_insert_l0", "SELECT run, min(prefix * 1000 + suffix) AS lo, max(prefix * 1000 + suffix) AS hi, count(DISTINCT block) AS tables FROM blk GROUP BY run")
def ver_insert_l0(t: Tables) -> DataFrame:
    flat = lambda side: F.col(f"{side}_prefix") * 1000 + F.col(f"{side}_suffix")
    return t.pst.groupBy("run").agg(F.min(flat("min")).alias("lo"), F.max(flat("max")).alias("hi"), F.count("*").alias("tables"))


FRAGMENTS = ", pre AS (SELECT DISTINCT prefix FROM op), frag AS (SELECT run, block, prefix, CASE WHEN prefix = min_prefix THEN min_suffix ELSE 0 END AS suffix_min, CASE WHEN prefix = max_prefix THEN max_suffix ELSE 9223372036854775807 END AS suffix_max, max_seq FROM pst JOIN pre ON prefix BETWEEN min_prefix AND max_prefix)"


def fragment_rows(t: Tables) -> DataFrame:
    return intervals.fragments(t.pst, t.log.select("prefix").distinct(), t.width)


@query("ver_changed_prefixes", FRAGMENTS + " SELECT DISTINCT prefix FROM frag WHERE run = 1")
def ver_changed_prefixes(t: Tables) -> DataFrame:
    return fragment_rows(t).where("run = 1").select("prefix").distinct()


@query("ver_pick_l0", "SELECT run, count(*) AS tables, sum(entries) AS entries FROM pst WHERE run > 0 GROUP BY run")
def ver_pick_l0(t: Tables) -> DataFrame:
    return t.pst.where("run > 0").groupBy("run").agg(F.count("*").alias("tables"), F.sum("entries").alias("entries")).orderBy(F.desc("run"))


@query("ver_pick_l1_overlap", f", w2 AS (SELECT * FROM win WHERE run = 0 AND prefix BETWEEN 42 AND 45 AND NOT (prefix = 42 AND suffix_max < 17) AND NOT (prefix = 45 AND suffix_min > 10)) SELECT DISTINCT run, block FROM w2")
def ver_pick_l1_overlap(t: Tables) -> DataFrame:
    return intervals.clip(t.windows.where("run = 0"), LOW, HIGH).select("run", "block").distinct()


@query("ver_overlaps", RANK + " SELECT run, block FROM p2 WHERE hi >= 42017 AND lo <= 45010")
def ver_overlaps(t: Tables) -> DataFrame:
    return intervals.overlapping(t.pst, LOW, HIGH).select("run", "block")


@query("ver_candidates", RANK + " SELECT probe, run, block FROM ask JOIN p2 ON k BETWEEN lo AND hi")
def ver_candidates(t: Tables) -> DataFrame:
    return intervals.stab(t.pst, asks(t), t.width).select("probe", "run", "block")


@query("ver_resolve", ", w2 AS (SELECT DISTINCT block FROM win WHERE run = 0 AND prefix BETWEEN 42 AND 45) SELECT block, entries, max_prefix, max_suffix FROM pst JOIN w2 USING (block) WHERE run = 0")
def ver_resolve(t: Tables) -> DataFrame:
    named = t.windows.where("run = 0 AND prefix BETWEEN 42 AND 45").select("run", "block").dropDuplicates()
    return t.pst.join(named, ["run", "block"]).select("block", "entries", "max_prefix", "max_suffix").orderBy("max_prefix", "max_suffix", "block")


@query("ver_level_size", "SELECT CASE WHEN run = 0 THEN 1 ELSE 0 END AS level, count(*) AS tables, sum(entries) AS entries FROM pst GROUP BY 1")
def ver_level_size(t: Tables) -> DataFrame:
    level = F.when(F.col("run") == 0, 1).otherwise(0)
    return t.pst.groupBy(level.alias("level")).agg(F.count("*").alias("tables"), F.sum("entries").alias("entries"))


# ---- flush and compaction


@query("fl_partition_cut", "SELECT run, prefix // width AS part, count(*) AS n, min(prefix) AS lo, max(prefix) AS hi FROM runkv, bnd GROUP BY 1, 2")
def fl_partition_cut(t: Tables) -> DataFrame:
    part = blocks.partition_of(F.col("prefix"), t.width).alias("part")
    return t.runs.groupBy("run", part).agg(F.count("*").alias("n"), F.min("prefix").alias("lo"), F.max("prefix").alias("hi"))


@query("cp_pick", RANK + ", hull AS (SELECT min(lo) AS lo, max(hi) AS hi FROM p2 WHERE run > 0 AND block < 2 * 1099511627776) SELECT p2.block, p2.entries FROM p2, hull WHERE run = 0 AND p2.hi >= hull.lo AND p2.lo <= hull.hi")
def cp_pick(t: Tables) -> DataFrame:
    """The hull of newer blocks of the first partitions, and the oldest run's blocks there."""
    key = lambda side: F.struct(F.col(f"{side}_prefix").alias("prefix"), F.col(f"{side}_suffix").alias("suffix"))
    hull = t.pst.where("run > 0 AND block < 2 * 1099511627776").agg(F.min(key("min")).alias("lo"), F.max(key("max")).alias("hi")).first()
    if hull["lo"] is None:
        return t.pst.where("false").select("block", "entries")
    return intervals.overlapping(t.pst.where("run = 0"), tuple(hull["lo"]), tuple(hull["hi"])).select("block", "entries")


@query("cp_merge", "SELECT prefix, suffix, value, is_delete, run FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY run DESC) AS r FROM runkv) WHERE r = 1")
def cp_merge(t: Tables) -> DataFrame:
    return fold.merge_runs(t.runs).select("prefix", "suffix", "value", "is_delete", "run")


@query("cp_reuse", RANK + ", q AS (SELECT run, block, block // 1099511627776 AS part, lo, hi FROM p2 WHERE run = block // 1099511627776 % 4 OR (run = 1 AND block < 3 * 1099511627776)) SELECT a.run, a.block FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE (b.run <> a.run OR b.block <> a.block) AND b.part = a.part AND b.hi >= a.lo AND b.lo <= a.hi)")
def cp_reuse(t: Tables) -> DataFrame:
    own = blocks.part_of_block(F.col("block")) % 4
    some = t.pst.where((F.col("run") == own) | ((F.col("run") == 1) & (F.col("block") < 3 * blocks.STRIDE)))
    return blocks.reusable(some).select("run", "block")


@query("cp_order_check", ", sw AS (SELECT run, block, prefix, suffix, CASE WHEN block % 3 = 1 AND slot < 2 * ((SELECT max(slot) + 1 FROM blk b WHERE b.run = blk.run AND b.block = blk.block) // 2) THEN xor(slot, 1) ELSE slot END AS slot FROM blk), v AS (SELECT block % 3 = 1 AS swapped, lag(prefix * 1000 + suffix) OVER (PARTITION BY run, block ORDER BY slot) > prefix * 1000 + suffix AS bad FROM sw) SELECT swapped, count(*) FILTER (bad) AS violations FROM v GROUP BY swapped")
def cp_order_check(t: Tables) -> DataFrame:
    """Neighbours in every third block have changed places; the check must find them all."""
    full = t.blocks.groupBy("run", "block").agg((F.max("slot") + 1).alias("entries"))
    paired = (F.col("block") % 3 == 1) & (F.col("slot") < 2 * F.floor(F.col("entries") / 2))
    swapped = t.blocks.join(full, ["run", "block"]).withColumn("slot", F.when(paired, F.col("slot").bitwiseXOR(F.lit(1))).otherwise(F.col("slot")))
    parts = [blocks.order_violations(swapped.where(cond)).withColumn("swapped", F.lit(is_swapped)) for cond, is_swapped in (("block % 3 = 1", True), ("block % 3 <> 1", False))]
    return parts[0].unionByName(parts[1]).select("swapped", "violations")


@query("cp_patch_windows", "SELECT * FROM win")
def cp_patch_windows(t: Tables) -> DataFrame:
    return t.windows


@query("cp_dedup_patch", 'SELECT DISTINCT prefix, suffix_min, suffix_max, block, "offset", cnt FROM win WHERE cnt > 0')
def cp_dedup_patch(t: Tables) -> DataFrame:
    cols = [*delta.RANGE, *delta.PLACE]
    return t.windows.unionByName(t.windows.where("run = 0")).where("cnt > 0").select(*cols).dropDuplicates(cols)


@query("cp_union_patch", "SELECT run, prefix, cnt FROM win WHERE run = 0 UNION ALL SELECT run, prefix, cnt FROM win WHERE run = 1")
def cp_union_patch(t: Tables) -> DataFrame:
    part = lambda run: t.windows.where(F.col("run") == run).select("run", "prefix", "cnt")
    return part(0).unionByName(part(1))


@query("cp_fallback_add", 'SELECT * FROM win WHERE prefix % 3 = 0 UNION ALL SELECT * FROM win w WHERE NOT EXISTS (SELECT 1 FROM win x WHERE x.prefix % 3 = 0 AND x.run = w.run AND x.block = w.block)')
def cp_fallback_add(t: Tables) -> DataFrame:
    return intervals.fallback(t.windows.where("prefix % 3 = 0"), t.windows)


@query("cp_unique_blocks", "SELECT DISTINCT run, block FROM win")
def cp_unique_blocks(t: Tables) -> DataFrame:
    return t.windows.select("run", "block").distinct().orderBy("run", "block")


@query("cp_readability", "SELECT run, bool_and(cnt <> 0) AS readable, count(*) FILTER (cnt <> 0) AS windows FROM win GROUP BY run")
def cp_readability(t: Tables) -> DataFrame:
    return t.windows.groupBy("run").agg(F.every(F.col("cnt") != 0).alias("readable"), F.count_if(F.col("cnt") != 0).alias("windows"))


@query("cp_normalize_windows", 'SELECT run, block, prefix, suffix_min, suffix_max, "offset", cnt FROM (SELECT *, row_number() OVER (PARTITION BY prefix, suffix_min, suffix_max ORDER BY run DESC, block, "offset", cnt) AS r FROM win) WHERE r = 1')
def cp_normalize_windows(t: Tables) -> DataFrame:
    return intervals.normalized(t.windows)


COVER = ", kept AS (SELECT * FROM win WHERE prefix % 20 <> 3), cov AS (SELECT pst.run, pst.block, pst.entries, coalesce(sum(cnt), 0) = entries AS covered FROM pst LEFT JOIN kept USING (run, block) GROUP BY pst.run, pst.block, pst.entries)"


@query("cp_coverage", COVER + " SELECT run, block, covered FROM cov")
def cp_coverage(t: Tables) -> DataFrame:
    return intervals.coverage(t.pst, t.windows.where("prefix % 20 <> 3"))


@query("cp_deletable", COVER + " SELECT run, block, entries FROM cov WHERE covered")
def cp_deletable(t: Tables) -> DataFrame:
    done = cp_coverage(t).where("covered").select("run", "block")
    return t.pst.select("run", "block", "entries").join(done, ["run", "block"], "left_semi")


NORMAL = """, a AS (SELECT prefix, suffix_min, suffix_max, block, "offset", cnt FROM win WHERE run = 1), d AS (SELECT prefix, suffix_min, suffix_max, block, "offset", cnt FROM win WHERE run = 0),
ax AS (SELECT *, row_number() OVER (PARTITION BY prefix, suffix_min, suffix_max ORDER BY block, "offset", cnt) AS rn FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM d)),
dx AS (SELECT *, row_number() OVER (PARTITION BY prefix, suffix_min, suffix_max ORDER BY block, "offset", cnt) AS rn FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM a)),
dl AS (SELECT coalesce(ax.prefix, dx.prefix) AS prefix, coalesce(ax.suffix_min, dx.suffix_min) AS suffix_min, coalesce(ax.suffix_max, dx.suffix_max) AS suffix_max,
CASE WHEN ax.rn IS NULL THEN 'delete' WHEN dx.rn IS NULL THEN 'add' ELSE 'replace' END AS op, coalesce(ax.block, dx.block) AS block, coalesce(ax."offset", dx."offset") AS "offset", coalesce(ax.cnt, dx.cnt) AS cnt
FROM ax FULL JOIN dx ON ax.prefix = dx.prefix AND ax.suffix_min = dx.suffix_min AND ax.suffix_max = dx.suffix_max AND ax.rn = dx.rn)"""


@query("cp_delta_normalize", NORMAL + " SELECT * FROM dl")
def cp_delta_normalize(t: Tables) -> DataFrame:
    return delta.normalize(t.windows.where("run = 1"), t.windows.where("run = 0"))


@query("cp_delta_build", NORMAL + " SELECT prefix, count(*) FILTER (op = 'add') AS adds, count(*) FILTER (op = 'delete') AS deletes, count(*) FILTER (op = 'replace') AS replaces FROM dl GROUP BY prefix")
def cp_delta_build(t: Tables) -> DataFrame:
    return delta.build(t.windows.where("run = 1"), t.windows.where("run = 0"))


# ---- metadata


@query("mf_recover", "SELECT run, count(*) AS tables, min(block) AS first_block FROM pst WHERE run >= 2 GROUP BY run")
def mf_recover(t: Tables) -> DataFrame:
    return t.pst.where("run >= 2").groupBy("run").agg(F.count("*").alias("tables"), F.min("block").alias("first_block"))


@query("mf_l0gc", "SELECT run, block FROM pst WHERE run >= 1")
def mf_l0gc(t: Tables) -> DataFrame:
    return t.pst.where("run >= 1").select("run", "block")


# ---- interval index


@query("l1_bulkload", FRAGMENTS + " SELECT prefix, count(*) AS records, count(DISTINCT (run, block)) AS blocks FROM frag GROUP BY prefix")
def l1_bulkload(t: Tables) -> DataFrame:
    return fragment_rows(t).groupBy("prefix").agg(F.count("*").alias("records"), F.countDistinct("run", "block").alias("blocks"))


@query("l1_clip_prefix", FRAGMENTS + " SELECT * FROM frag")
def l1_clip_prefix(t: Tables) -> DataFrame:
    return fragment_rows(t)


HITS = PROBES + ", hit AS (SELECT probe.prefix, probe.suffix, run, block, row_number() OVER (PARTITION BY probe.prefix, probe.suffix ORDER BY suffix_max, run DESC, block) AS rn FROM probe JOIN win ON probe.prefix = win.prefix AND probe.suffix BETWEEN suffix_min AND suffix_max)"


@query("l1_lookup", HITS + " SELECT prefix, suffix, run, block FROM hit WHERE rn = 1")
def l1_lookup(t: Tables) -> DataFrame:
    return intervals.lookup(t.windows, probes(t)).select("prefix", "suffix", "run", "block")


@query("l1_lookup_n", HITS + " SELECT prefix, suffix, run, block, rn FROM hit WHERE rn <= 3")
def l1_lookup_n(t: Tables) -> DataFrame:
    return intervals.lookup(t.windows, probes(t), 3).select("prefix", "suffix", "run", "block", "rn")


CLIP = ", clip AS (SELECT * FROM (SELECT run, block, prefix, CASE WHEN prefix = 42 THEN greatest(suffix_min, 17) ELSE suffix_min END AS suffix_min, CASE WHEN prefix = 45 THEN least(suffix_max, 10) ELSE suffix_max END AS suffix_max FROM win WHERE prefix BETWEEN 42 AND 45) WHERE suffix_min <= suffix_max)"


@query("l1_range", CLIP + " SELECT run, block, min(prefix * 1000 + suffix_min) AS first_key FROM clip GROUP BY run, block")
def l1_range(t: Tables) -> DataFrame:
    """Blocks with windows in the range, each once, with the first place they are met."""
    met = intervals.clip(t.windows, LOW, HIGH)
    return met.groupBy("run", "block").agg(F.min(F.col("prefix") * 1000 + F.col("suffix_min")).alias("first_key"))


@query("l1_range_records", CLIP + " SELECT * FROM clip")
def l1_range_records(t: Tables) -> DataFrame:
    return intervals.clip(t.windows, LOW, HIGH).select("run", "block", "prefix", "suffix_min", "suffix_max")


@query("l1_export", "SELECT run, block, max_prefix, max_suffix FROM pst")
def l1_export(t: Tables) -> DataFrame:
    return t.pst.select("run", "block", "max_prefix", "max_suffix").orderBy("max_prefix", "max_suffix", "run", "block")


@query("l1_apply_delta", 'SELECT prefix, suffix_min, suffix_max, block, "offset", cnt FROM win WHERE run = 1')
def l1_apply_delta(t: Tables) -> DataFrame:
    """The oldest run's windows turned into the next run's by the delta between them."""
    base, target = t.windows.where("run = 0"), t.windows.where("run = 1")
    return delta.apply(base, delta.normalize(target, base))


@query("l1_rebuild", 'SELECT prefix, suffix_min, suffix_max, cnt FROM win WHERE (run = 0 AND prefix % 7 <> 0) OR (run = 1 AND prefix % 7 = 0)')
def l1_rebuild(t: Tables) -> DataFrame:
    cols = ["prefix", "suffix_min", "suffix_max", "cnt"]
    part = lambda run: t.windows.where(F.col("run") == run).select(*cols)
    return delta.rebuild(part(0), part(1), t.log.where("prefix % 7 = 0"))


@query("l1_update_mode", ", n AS (SELECT prefix, count(*) AS existing FROM win GROUP BY prefix), c AS (SELECT prefix, count(*) AS changed FROM win WHERE run = 3 GROUP BY prefix) SELECT prefix, existing, coalesce(changed, 0) AS changed, CASE WHEN existing >= 3 AND coalesce(changed, 0) <= 2 AND coalesce(changed, 0) * 100 <= existing * 60 THEN 'cow' ELSE 'bulk' END AS mode FROM n LEFT JOIN c USING (prefix)")
def l1_update_mode(t: Tables) -> DataFrame:
    have = t.windows.groupBy("prefix").agg(F.count("*").alias("existing"))
    turn = t.windows.where("run = 3").groupBy("prefix").agg(F.count("*").alias("changed"))
    return stats.update_mode(have, turn, 3, 2, 60)


TINY = ", des AS (SELECT prefix, count(DISTINCT (run, block)) AS blocks, count(*) AS windows, sum(cnt) AS entries FROM win WHERE run = {0} GROUP BY prefix)"


@query("l1_descriptor_mode", TINY.format(0) + " SELECT *, CASE WHEN blocks = 1 AND windows = 1 AND entries <= 16 THEN 'tiny' ELSE 'normal' END AS mode FROM des")
def l1_descriptor_mode(t: Tables) -> DataFrame:
    return stats.descriptor(t.windows.where("run = 0"), 16)


@query("l1_descriptor_hysteresis", TINY.format(0) + ", d1 AS (SELECT prefix, count(DISTINCT block) AS blocks, count(*) AS windows, sum(cnt) AS entries FROM win WHERE run = 1 GROUP BY prefix), m AS (SELECT d1.*, d1.blocks = 1 AND d1.windows = 1 AND d1.entries <= 16 AS fits, CASE WHEN des.prefix IS NULL THEN NULL WHEN des.blocks = 1 AND des.windows = 1 AND des.entries <= 16 THEN 'tiny' ELSE 'normal' END AS was FROM d1 LEFT JOIN des USING (prefix)) SELECT prefix, entries, CASE WHEN was IS NULL THEN CASE WHEN fits THEN 'tiny' ELSE 'normal' END WHEN was = 'tiny' AND entries < 24 AND blocks = 1 THEN 'tiny' WHEN fits AND (CASE WHEN was = 'tiny' THEN 2 ELSE 1 END) >= 2 THEN 'tiny' ELSE 'normal' END AS mode, CASE WHEN NOT fits THEN 0 WHEN was = 'tiny' THEN 2 ELSE 1 END AS streak FROM m")
def l1_descriptor_hysteresis(t: Tables) -> DataFrame:
    before = stats.descriptor(t.windows.where("run = 0"), 16).withColumn("streak", (F.col("mode") == "tiny").cast("long"))
    return stats.hysteresis(stats.descriptor(t.windows.where("run = 1"), 16), before, leave=24)


@query("l1_governance", "SELECT prefix, count(*) AS records, count(*) >= 40 AS hot, count(*) >= 45 AS prefer_cow, count(*) >= 40 AS parallel FROM latest GROUP BY prefix")
def l1_governance(t: Tables) -> DataFrame:
    return stats.governance(t.folded, 40, 45, 40)


@query("l1_window_map", 'SELECT prefix, block, "offset" AS start, cnt FROM win WHERE run = 0')
def l1_window_map(t: Tables) -> DataFrame:
    return t.windows.where("run = 0").select("prefix", "block", F.col("offset").alias("start"), "cnt")


@query("l1_pack", ", n AS (SELECT prefix, prefix // width AS part, count(*) AS records FROM win, bnd WHERE run = 0 GROUP BY 1, 2) SELECT prefix, records, CAST(coalesce(sum(records) OVER (PARTITION BY part ORDER BY prefix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8 AS BIGINT) AS page FROM n")
def l1_pack(t: Tables) -> DataFrame:
    counts = t.windows.where("run = 0").groupBy("prefix").agg(F.count("*").alias("records")).withColumn("part", blocks.partition_of(F.col("prefix"), t.width))
    return stats.packed(counts, "prefix", "records", 8, "part").select("prefix", "records", "page")


@query("l1_validate", ", bad AS (SELECT run, prefix, suffix_min, CASE WHEN prefix % 5 = 0 THEN 100 ELSE suffix_max END AS suffix_max FROM win), o AS (SELECT *, lag(suffix_max) OVER (PARTITION BY run, prefix ORDER BY suffix_min, suffix_max) AS before FROM bad) SELECT count(*) FILTER (before >= suffix_min) AS broken, count(*) AS windows FROM o")
def l1_validate(t: Tables) -> DataFrame:
    """Windows of a prefix in a run must ascend and not meet; here every fifth prefix's
    windows reach beyond their ends, so where it has two or more they do meet."""
    return intervals.meeting(t.windows.withColumn("suffix_max", F.when(F.col("prefix") % 5 == 0, 100).otherwise(F.col("suffix_max"))))


@query("l1_mem", "SELECT count(DISTINCT prefix) AS prefixes, count(DISTINCT prefix) * 32 AS bytes FROM op")
def l1_mem(t: Tables) -> DataFrame:
    return t.log.agg(F.countDistinct("prefix").alias("prefixes")).withColumn("bytes", F.col("prefixes") * 32)


# ---- generators and figures

ORD = "SELECT o_custkey AS prefix, o_orderkey AS suffix, "
U64 = "18446744073709551616::HUGEINT"


@query("gen_hash_keys", f"SELECT o_orderkey, CAST(((o_orderkey + 1)::HUGEINT * 11400714819323198393) % {U64} AS VARCHAR) AS hash_key FROM orders", base=False)
def gen_hash_keys(t: Tables) -> DataFrame:
    return t["orders"].select("o_orderkey", keys.unsigned(keys.hash_key(F.col("o_orderkey"))).cast("string").alias("hash_key"))


@query("gen_prefix_uniform", "SELECT o_orderkey, o_orderkey % 100 AS prefix, o_orderkey // 100 AS suffix FROM orders", base=False)
def gen_prefix_uniform(t: Tables) -> DataFrame:
    i = F.col("o_orderkey")
    return t["orders"].select("o_orderkey", (i % 100).alias("prefix"), F.floor(i / 100).alias("suffix"))


def skewed(share: float, part: int):
    """Prefix of row i of n: ``share`` of the rows fall on the first 1/part of p prefixes."""

    def of(t: Tables) -> DataFrame:
        rows = t["orders"]
        n = rows.count()
        p = max(part, n // 10)
        hot, few = int(n * share), p // part
        i = F.col("o_orderkey") - rows.agg(F.min("o_orderkey")).first()[0]
        return rows.select(F.when(i < hot, i % few).otherwise(few + (i - hot) % (p - few)).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))

    return of


SKEW = "WITH s AS (SELECT count(*) AS n, greatest({1}, count(*) // 10) AS p, min(o_orderkey) AS m FROM orders), h AS (SELECT CAST(floor(n * {0}) AS BIGINT) AS hot, p // {1} AS few, p, m FROM s) SELECT CASE WHEN o_orderkey - m < hot THEN (o_orderkey - m) % few ELSE few + (o_orderkey - m - hot) % (p - few) END AS prefix, count(*) AS n FROM orders, h GROUP BY 1"
query("gen_prefix_skew", SKEW.format(0.8, 5), base=False)(skewed(0.8, 5))
query("gen_prefix_skew_extreme", SKEW.format(0.99, 100), base=False)(skewed(0.99, 100))


@query("gen_counts", "SELECT o_orderkey % 100 AS prefix, count(*) AS n FROM orders GROUP BY 1", base=False)
def gen_counts(t: Tables) -> DataFrame:
    """Closed form of the uniform generator's rows per prefix over ids 0 to n - 1."""
    n = t["orders"].count()
    return t.spark.range(min(100, n)).select(F.col("id").alias("prefix"), (F.lit(n // 100) + (F.col("id") < n % 100).cast("long")).alias("n"))


HEXED = "lower(printf('%016x', CAST({0} AS UBIGINT)))"


@query("gen_value", f"SELECT o_custkey, o_orderkey, CAST(xor(CAST((o_custkey::HUGEINT * 1469598103934665603) % {U64} AS UBIGINT), CAST((o_orderkey::HUGEINT + 11400714819323198485) % {U64} AS UBIGINT)) AS VARCHAR) AS lo, CAST(xor(CAST(o_orderkey * 2 AS UBIGINT), CAST((o_custkey::HUGEINT + 5871781006564002453) % {U64} AS UBIGINT)) AS VARCHAR) AS hi FROM orders", base=False)
def gen_value(t: Tables) -> DataFrame:
    p, s = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda x: keys.unsigned(x).cast("string")
    return t["orders"].select("o_custkey", "o_orderkey", text(keys.value_lo(p, s)).alias("lo"), text(keys.value_hi(p, s)).alias("hi"))


@query("gen_queries", "SELECT o_custkey AS prefix, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS suffix, o_orderkey % 5 < 4 AS expect_hit FROM orders", base=False)
def gen_queries(t: Tables) -> DataFrame:
    """Probes of which four in five hit; the others lie behind all used suffixes."""
    hit = F.col("suffix") % 5 < 4
    return t.owners.select("prefix", F.when(hit, F.col("suffix")).otherwise(F.col("suffix") + 1_000_000_000).alias("suffix"), hit.alias("expect_hit"))


def workload(write_percent: int):
    """A load of reads and writes by event id: how many reads hit the state at its start
    (the first half of the log) and how many keys the writes leave behind."""

    def of(t: Tables) -> DataFrame:
        half = t.bounds[0] // 2
        start = fold.fold_live(t.log.where(F.col("seq") <= half))
        load = t.log.where(F.col("seq") > half).withColumn("writes", F.col("seq") % 100 < write_percent)
        reads = lookup.multiget(start.select("prefix", "suffix"), load.where("NOT writes").select("prefix", "suffix"))
        hits = reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"))
        puts = load.where("writes").withColumn("is_delete", F.lit(False)).drop("writes")
        after = fold.fold_live(t.log.where(F.col("seq") <= half).unionByName(puts)).agg(F.count("*").alias("live"))
        return hits.crossJoin(after)

    return of


LOAD = ", h AS (SELECT me // 2 AS half FROM bnd), b AS (SELECT * FROM (SELECT op.*, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM op, h WHERE seq <= half) WHERE r = 1 AND NOT is_delete), rd AS (SELECT op.prefix, op.suffix, b.seq AS found FROM op JOIN h ON op.seq > half LEFT JOIN b USING (prefix, suffix) WHERE op.seq % 100 >= {0}), wr AS (SELECT seq, prefix, suffix, is_delete FROM op, h WHERE seq <= half UNION ALL SELECT seq, prefix, suffix, false FROM op, h WHERE seq > half AND seq % 100 < {0}), fin AS (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM wr) SELECT (SELECT count(*) FROM rd) AS reads, (SELECT count(found) FROM rd) AS hits, (SELECT count(*) FROM fin WHERE r = 1 AND NOT is_delete) AS live"
for _name, _share in (("wl_a", 50), ("wl_b", 5), ("wl_c", 0), ("wl_d", 5), ("wl_g", 0), ("wl_h", 0)):
    query(_name, LOAD.format(_share))(workload(_share))


SCANS = """, h AS (SELECT me // 2 AS half FROM bnd), b AS (SELECT prefix, suffix, row_number() OVER (ORDER BY prefix, suffix) - 1 AS rk FROM (SELECT op.*, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM op, h WHERE seq <= half) WHERE r = 1 AND NOT is_delete),
tot AS (SELECT count(*) AS total FROM b), sc AS (SELECT seq, prefix, suffix, 1 + seq % 100 AS n FROM op, h WHERE seq > half AND seq % 100 >= 5),
u AS (SELECT prefix, suffix, 1 AS kind, NULL AS seq, NULL AS n FROM b UNION ALL SELECT prefix, suffix, 0, seq, n FROM sc),
st0 AS (SELECT seq, n, kind, coalesce(sum(kind) OVER (ORDER BY prefix, suffix, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM u),
g AS (SELECT seq, CAST(least(n, total - first) AS BIGINT) AS n, first FROM st0, tot WHERE kind = 0),
wr AS (SELECT seq, prefix, suffix, is_delete FROM op, h WHERE seq <= half UNION ALL SELECT seq, prefix, suffix, false FROM op, h WHERE seq > half AND seq % 100 < 5),
fin AS (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM wr)
SELECT g.seq, g.n, b.prefix AS last_prefix, b.suffix AS last_suffix, (SELECT count(*) FROM fin WHERE r = 1 AND NOT is_delete) AS live FROM g LEFT JOIN b ON b.rk = g.first + g.n - 1 AND g.n > 0"""


@query("wl_e", SCANS)
def wl_e(t: Tables) -> DataFrame:
    """95 % scans of 1 to 100 rows from a key on, across prefixes, and 5 % puts, over all
    operations of the log's second half: how many rows each scan finds in the state at the
    start, the key where it ends, and how many keys live after the puts."""
    half = t.bounds[0] // 2
    start = fold.fold_live(t.log.where(F.col("seq") <= half))
    load = t.log.where(F.col("seq") > half)
    scans = load.where("seq % 100 >= 5").select(F.col("seq").alias("probe"), "prefix", "suffix", (1 + F.col("seq") % 100).alias("n"))
    ends = lookup.scans(start, scans, t.width, t.parts)
    puts = load.where("seq % 100 < 5").withColumn("is_delete", F.lit(False))
    live = fold.fold_live(t.log.where(F.col("seq") <= half).unionByName(puts)).agg(F.count("*").alias("live"))
    return ends.withColumnRenamed("probe", "seq").crossJoin(F.broadcast(live))


@query("wl_rmw", "SELECT prefix, suffix, value FROM st")
def wl_rmw(t: Tables) -> DataFrame:
    """Every other key is read and written back as it was."""
    back = t.state.where("suffix % 2 = 0").select(F.col("seq").alias("rank"), "prefix", "suffix", F.lit(False).alias("is_delete"), "value")
    return fold.fold_live(fold.appended(t.log, back, t.bounds[0] + 1)).select("prefix", "suffix", "value")


@query("wl_f", ", h AS (SELECT me // 2 AS half FROM bnd), b AS (SELECT * FROM (SELECT op.*, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM op, h WHERE seq <= half) WHERE r = 1 AND NOT is_delete), rd AS (SELECT op.seq, op.seq % 2 = 0 AS modify, b.seq AS found, b.prefix, b.suffix, b.value FROM op JOIN h ON op.seq > half LEFT JOIN b USING (prefix, suffix)), wr AS (SELECT seq, prefix, suffix, value FROM b UNION ALL SELECT seq, prefix, suffix, value FROM rd WHERE modify AND found IS NOT NULL), fin AS (SELECT *, row_number() OVER (PARTITION BY prefix, suffix ORDER BY seq DESC) AS r FROM wr) SELECT prefix, suffix, value, seq, (SELECT count(*) FROM rd WHERE NOT modify) AS gets, (SELECT count(found) FROM rd WHERE NOT modify) AS hits, (SELECT count(found) FROM rd WHERE modify) AS rewritten FROM fin WHERE r = 1")
def wl_f(t: Tables) -> DataFrame:
    """50 % gets and 50 % read-modify-writes over the second half of the log, against the
    state at its start: the state that the rewrites leave, and how many reads hit."""
    half = t.bounds[0] // 2
    start = fold.fold_live(t.log.where(F.col("seq") <= half))
    asked = t.log.where(F.col("seq") > half).select(F.col("seq").alias("at"), "prefix", "suffix", (F.col("seq") % 2 == 0).alias("modify"))
    read = lookup.multiget(start.drop("seq"), asked)
    written = read.where("modify AND hit").select(F.col("at").alias("seq"), "prefix", "suffix", "value")
    after = fold.newest(start.select("seq", "prefix", "suffix", "value").unionByName(written), fold.KEY, "seq")
    counted = read.agg(F.count_if(~F.col("modify")).alias("gets"), F.count_if(~F.col("modify") & F.col("hit")).alias("hits"), F.count_if(F.col("modify") & F.col("hit")).alias("rewritten"))
    return after.select("prefix", "suffix", "value", "seq").crossJoin(F.broadcast(counted))


@query("an_p99", ", v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM op WHERE value IS NOT NULL) SELECT max(n) AS n, max(CASE WHEN r = least(n - 1, n * 99 // 100) THEN value END) AS p99 FROM v")
def an_p99(t: Tables) -> DataFrame:
    return stats.latency(t.log, "value").select("n", "p99")


@query("an_top1pct", ", v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM op WHERE value IS NOT NULL) SELECT round(avg(value), 6) AS top1pct_avg FROM v WHERE r >= least(n - 1, n * 99 // 100)")
def an_top1pct(t: Tables) -> DataFrame:
    return stats.latency(t.log, "value").select(F.round("top1pct_avg", 6).alias("top1pct_avg"))


@query("an_ratios", "SELECT run, sum(CASE WHEN is_delete THEN 1 ELSE 0 END)::DOUBLE / count(*) AS delete_ratio, count(DISTINCT prefix * 1000 + suffix)::DOUBLE / count(*) AS reuse_ratio FROM op GROUP BY run")
def an_ratios(t: Tables) -> DataFrame:
    table = t.oplog.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.col("is_delete").cast("long")).alias("d"), F.countDistinct("prefix", "suffix").alias("k"))
    return table.select("run", stats.ratio(F.col("d"), F.col("n")).alias("delete_ratio"), stats.ratio(F.col("k"), F.col("n")).alias("reuse_ratio"))


@query("an_flush_stats", "SELECT count(*) AS flushes, sum(entries) AS entries, max(entries) AS largest, min(entries) AS smallest FROM (SELECT run, sum(entries) AS entries FROM pst GROUP BY run)")
def an_flush_stats(t: Tables) -> DataFrame:
    runs = t.pst.groupBy("run").agg(F.sum("entries").alias("entries"))
    return runs.agg(F.count("*").alias("flushes"), F.sum("entries").alias("entries"), F.max("entries").alias("largest"), F.min("entries").alias("smallest"))


@query("an_report", ", r AS (SELECT run, count(*) AS n FROM op GROUP BY run) SELECT run, n, n - lag(n) OVER (ORDER BY run) AS change, (n - lag(n) OVER (ORDER BY run)) * 100.0::DOUBLE / lag(n) OVER (ORDER BY run) AS percent FROM r")
def an_report(t: Tables) -> DataFrame:
    """Figures of each run against the run before it."""
    n = t.oplog.groupBy("run").agg(F.count("*").alias("n"))
    before = n.select((F.col("run") + 1).alias("run"), F.col("n").alias("was"))
    return n.join(before, "run", "left").select("run", "n", (F.col("n") - F.col("was")).alias("change"), ((F.col("n") - F.col("was")) * 100.0 / F.col("was")).alias("percent"))


@query("li_fold", "SELECT prefix, suffix, value FROM (SELECT l_orderkey AS prefix, l_linenumber::BIGINT AS suffix, l_extendedprice AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1", base=False)
def li_fold(t: Tables) -> DataFrame:
    rows = t["lineitem"].select(F.col("l_orderkey").alias("prefix"), F.col("l_linenumber").cast("long").alias("suffix"), F.col("l_extendedprice").alias("value"), "l_shipdate", "l_partkey", "l_suppkey")
    return fold.newest(rows, fold.KEY, "l_shipdate", "l_partkey", "l_suppkey", "value").select("prefix", "suffix", "value")
