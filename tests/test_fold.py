"""Folds against a plain dictionary, and traps of the semantics."""

import random

import pytest

from tidemark.operators import fold, lookup
from tidemark.functions import keys

SCHEMA = "seq long, prefix long, suffix long, is_delete boolean, value double"


@pytest.mark.parametrize("seed,n_keys,n_ops,puts,deletes", [(20260302, 256, 512, 55, 20), (20260303, 512, 640, 60, 20), (20260304, 384, 1280, 55, 25)])
def test_fold_equals_dictionary(spark, seed, n_keys, n_ops, puts, deletes):
    rng, shadow, ops = random.Random(seed), {}, []
    for seq in range(n_ops):
        key, draw = rng.randrange(n_keys), rng.randrange(100)
        if draw < puts:
            value = float(100_000 + seq * 17 + key)
            ops.append((seq, key // 64, key % 64, False, value))
            shadow[key // 64, key % 64] = value
        elif draw < puts + deletes:
            ops.append((seq, key // 64, key % 64, True, None))
            shadow.pop((key // 64, key % 64), None)
    rng.shuffle(ops)
    state = fold.fold_live(spark.createDataFrame(ops, SCHEMA))
    assert {(r.prefix, r.suffix): r.value for r in state.collect()} == shadow


def test_key_zero_null_values_and_lifecycle(spark):
    ops = [(0, 0, 0, False, None), (1, 0, 20, False, 1020.0), (2, 0, 20, True, None), (3, 0, 20, False, 2020.0), (4, 0, 20, True, None), (5, 0, 20, False, 3030.0)]
    log = spark.createDataFrame(ops, SCHEMA)
    assert {(r.suffix, r.value) for r in fold.fold_live(log).collect()} == {(0, None), (20, 3030.0)}
    assert fold.fold_live(log.where("seq <= 4")).count() == 1
    hit = lookup.multiget(fold.fold_live(log), spark.createDataFrame([(0, 0), (0, 7)], "prefix long, suffix long"))
    assert {(r.suffix, r.hit) for r in hit.collect()} == {(0, True), (7, False)}


def test_put_validate_takes_the_later_of_equal_lsns(spark):
    rows = spark.createDataFrame([(0, 1, 1, False, 1.0, 5), (1, 1, 1, False, 2.0, 5), (2, 1, 1, False, 3.0, 4)], SCHEMA + ", lsn long")
    assert [r.value for r in fold.put_validate(rows, rows.lsn).collect()] == [2.0]


def test_newest_run_wins_over_older_ones(spark):
    runs = spark.createDataFrame([(r, 1, 1, r == 2, float(r)) for r in range(3)], "run long, prefix long, suffix long, is_delete boolean, value double")
    assert [(r.run, r.is_delete) for r in fold.merge_runs(runs).collect()] == [(2, True)]


def test_scan_start_in_a_gap_and_unsigned_order(spark):
    state = spark.createDataFrame([(p, s, 0.0) for p in (1, 3) for s in (5, 9)], "prefix long, suffix long, value double")
    assert [(r.prefix, r.suffix) for r in lookup.scan(state, 1, 6, 10).collect()] == [(1, 9), (3, 5), (3, 9)]
    assert lookup.scan(state, 4, 0, 10).count() == 0
    words = spark.createDataFrame([(0, -1), (0, 1), (-1, 0)], "prefix long, suffix long")
    by_bytes = [tuple(r) for r in words.orderBy(keys.sort_key(words.prefix, words.suffix)).collect()]
    assert by_bytes == [(0, 1), (0, -1), (-1, 0)]
    assert by_bytes == [tuple(r) for r in words.orderBy(keys.flipped(words.prefix), keys.flipped(words.suffix)).collect()]


def test_word_arithmetic_wraps(spark):
    values = [0, 1, 2**32, 2**62 + 12345, -1, -(2**63), 987654321987654321]
    rows = spark.createDataFrame([(v,) for v in values], "x long")
    got = rows.select(keys.unsigned(keys.times(rows.x, keys.HASH_FACTOR)).cast("string"), keys.unsigned(keys.plus(rows.x, keys.VALUE_LO)).cast("string")).collect()
    want = [(str(v % 2**64 * keys.HASH_FACTOR % 2**64), str((v + keys.VALUE_LO) % 2**64)) for v in values]
    assert [tuple(r) for r in got] == want
