"""Block numbers, ranks, interval lookups, scans, exact percentiles and policies."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, intervals, lookup, stats
from tidemark.sources.store import RING, Config, Store
from tidemark.sources.tables import Tables


def test_block_numbers_beyond_a_million_keep_their_partition(spark):
    """The numbers of blocks far into a partition never run into the next partition's."""
    far = spark.createDataFrame([(p, n) for p in (0, 1, 11, 4_000_000) for n in (0, 999_999, 1_000_000, 5_000_000_000, blocks.STRIDE - 1)], "part long, n long")
    numbered = far.withColumn("block", F.col("part") * blocks.STRIDE + F.col("n"))
    assert numbered.where(blocks.part_of_block(F.col("block")) != F.col("part")).count() == 0
    assert numbered.select("block").distinct().count() == far.count() and numbered.where("block < 0").count() == 0


def state(spark, rng, n, prefixes):
    keys = sorted({(rng.randrange(prefixes), rng.randrange(60)) for _ in range(n)})
    return keys, spark.createDataFrame([(0, p, s, i) for i, (p, s) in enumerate(keys)], "run long, prefix long, suffix long, seq long")


@pytest.mark.parametrize("width", [1, 7, 100, 1000])
def test_cut_numbers_rows_in_key_order(spark, width):
    """One prefix holds a third of the rows; partitions are narrow, wide, or all there is."""
    rng = random.Random(width)
    keys, frame = state(spark, rng, 500, 90)
    hot = spark.createDataFrame([(0, 41, 100 + i, 1000 + i) for i in range(250)], frame.schema)
    rows = sorted(blocks.cut(frame.unionByName(hot), width, capacity=8).collect(), key=lambda r: (r.prefix, r.suffix))
    seen = {}
    for r in rows:
        part = r.prefix // width
        at = seen[part] = seen.get(part, -1) + 1
        assert (r.block, r.slot) == (part * blocks.STRIDE + at // 8, at % 8)


def test_first_tables_and_stabs_equal_brute_force(spark):
    rng = random.Random(5)
    rows, width = [], 9
    for run in range(3):
        for p, s in sorted({(rng.randrange(60), rng.randrange(40)) for _ in range(150)}):
            if p // width != 3:  # one range partition holds nothing
                rows.append((run, p, s, len(rows)))
    cut = blocks.cut(spark.createDataFrame(rows, "run long, prefix long, suffix long, seq long"), width, capacity=5)
    table = blocks.metadata(cut)
    known = [tuple(r) for r in table.select("run", "block", "min_prefix", "min_suffix", "max_prefix", "max_suffix").collect()]
    asked = [(i, rng.randrange(-1, 64), rng.randrange(42)) for i in range(200)]
    probes = spark.createDataFrame(asked, "probe long, prefix long, suffix long")
    for n in (1, 2, 3):
        want = set()
        for i, p, s in asked:
            for run in range(3):
                ahead = sorted(((k[4], k[5]), k[1]) for k in known if k[0] == run and (k[4], k[5]) >= (p, s))
                if len(ahead) >= n:
                    want.add((run, i, ahead[n - 1][1]))
        assert {tuple(r) for r in intervals.first_tables(table, probes, width, n).select("run", "probe", "block").collect()} == want
    want = {(i, k[0], k[1]) for i, p, s in asked for k in known if (k[2], k[3]) <= (p, s) <= (k[4], k[5])}
    assert {tuple(r) for r in intervals.stab(table, probes, width).collect()} == want


def test_scans_equal_slices(spark):
    rng = random.Random(9)
    keys, frame = state(spark, rng, 400, 50)
    asked = [(i, rng.randrange(52), rng.randrange(60), rng.randrange(1, 100)) for i in range(150)]
    got = lookup.scans(frame, spark.createDataFrame(asked, "probe long, prefix long, suffix long, n long"), 8, 7)
    want = {}
    for i, p, s, n in asked:
        at = bisect.bisect_left(keys, (p, s))
        found = keys[at : at + n]
        want[i] = (len(found), *(found[-1] if found else (None, None)))
    assert {r.probe: (r.n, r.last_prefix, r.last_suffix) for r in got.collect()} == want


@pytest.mark.parametrize("values", [[1.0], [5.0] * 300, list(range(1000)), [0.0] * 700 + list(range(300)), [float(i * i % 97) for i in range(2500)]])
def test_percentile_is_the_value_at_its_rank(spark, values):
    random.Random(1).shuffle(values)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    for most in (1_000_000, 20):
        for rank in {0, len(values) // 2, stats.rank_of(len(values)), len(values) - 1}:
            assert stats.value_at(frame.where("v IS NOT NULL"), "v", len(values), rank, most) == sorted(values)[rank]
    top = sorted(values)[stats.rank_of(len(values)) :]
    r = stats.latency(frame, "v").first()
    assert (r.n, r.p99) == (len(values), top[0]) and r.top1pct_avg == pytest.approx(sum(top) / len(top))
    assert stats.latency(frame.limit(0), "v").first().n == 0


def test_policies(spark, tmp_path):
    c = Config(stall_at=0)
    assert c.stall_at == 1 and Config(stall_at=99).stall_at == RING
    for ratio, modes in ((0.6, (False, False)), (0.5, (False, True)), (0.0, (True, True)), (-1.0, (True, True))):
        c.adapt(ratio)
        assert (c.read_only, c.read_optimized) == modes
    assert c.flush_due(1) and c.compaction_due(1) and not Config().compaction_due(3)
    store = Store(spark, f"file://{tmp_path}/s", config=Config(compaction_enabled=False, stall_at=2))
    for k in range(2):
        store.put([(1, k, 1.0)])
        store.maintain()
    assert store.now.runs == [] and store.now.base is not None  # stalled: compacted all the same


def test_other_numbers_of_partitions_hold_the_same_rows(spark, sf):
    few, many = Tables(spark, sf, parts=3), Tables(spark, sf, parts=40)
    key = ("run", "prefix", "suffix", "value")
    assert {tuple(r) for r in few.blocks.select(*key).collect()} == {tuple(r) for r in many.blocks.select(*key).collect()}
    assert few.pst.count() <= many.pst.count()


def test_obsolete_names_the_source_that_chose(spark):
    """The first source that names any decides, even if it names no known table."""
    table = spark.createDataFrame([(0, b, 9) for b in range(4)], "run long, block long, entries long")
    some = lambda *found: spark.createDataFrame([(0, b) for b in found], "run long, block long")
    chosen = lambda *given: sorted((r.source, r.block) for r in intervals.obsolete(table, *(some(*g) for g in given)).collect())
    assert chosen([0, 0, 1], [2], [3]) == [("inputs", 0), ("inputs", 1)]
    assert chosen([], [2], [2, 3]) == [("blocks", 2)]
    assert chosen([], [], [3, 3, 9]) == [("records", 3)]
    assert chosen([], [9], [3]) == chosen([], [], []) == []
