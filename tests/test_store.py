"""The store on disk: lifecycle, crashes, torn pointers, streaming."""

import pytest

from tidemark.sources.store import Store
from tidemark.streaming.ingest import drain, event_stream
from tidemark.sources.tables import Tables


def contents(store):
    return {(r.prefix, r.suffix): r.value for r in store.state.collect()}


def test_delete_lifecycle(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path)
    store.put([(0, 10, 1010.0), (0, 20, 1020.0), (0, 30, 1030.0)])
    store.put([(0, 20, None)], delete=True)
    store.flush(), store.compact()
    assert contents(store) == {(0, 10): 1010.0, (0, 30): 1030.0}
    store.put([(0, 20, 2020.0)])
    store.flush(), store.compact()
    assert contents(store)[0, 20] == 2020.0
    store.put([(0, 20, None)], delete=True)
    store.flush(), store.compact()
    again = Store(spark, path)
    assert (0, 20) not in contents(again)
    again.put([(0, 20, 3030.0)])
    assert contents(again) == contents(Store(spark, path)) == {(0, 10): 1010.0, (0, 20): 3030.0, (0, 30): 1030.0}
    assert again.collect() and contents(again)[0, 20] == 3030.0
    assert not again.collect()


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["after_log", "after_run", "after_merge", "before_pointer", "after_pointer"])
def test_crash_at_every_step_keeps_committed_state(spark, tmp_path, step):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path)
    for r in range(3):
        base = (r + 1) * 10_000
        store.put([(1, base + 2 * i + 1, float(base * 3 + 7 * i)) for i in range(24)])
        want, armed = contents(store), [True]

        def trip(name, armed=armed):
            if armed and name == step:
                raise Crash(name)

        crashing = Store(spark, path, trip=trip)
        for act in (lambda s: s.put([(2, r, 1.0)]), lambda s: s.flush(), lambda s: s.compact()):
            try:
                act(crashing)
            except Crash:
                break
        store = Store(spark, path)
        got = contents(store)
        assert {k: v for k, v in got.items() if k[0] == 1} == want | {}
        store = Store(spark, path)
        assert contents(store) == got
        store.maintain(), store.compact()
        assert contents(Store(spark, path)) == got
        spark.createDataFrame([(2, r)], "prefix long, suffix long")
        store.put([(2, r, None)], delete=True)


def test_torn_slot_falls_back_and_two_torn_slots_fail(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path)
    store.put([(1, 1, 1.0)])
    store.put([(1, 2, 2.0)])
    store.files.write(f"{path}/_pointer.{store.now.version % 2}", store.now.text()[:40])
    assert contents(Store(spark, path)) == {(1, 1): 1.0}
    for k in (0, 1):
        store.files.write(f"{path}/_pointer.{k}", "{}")
    with pytest.raises(ValueError):
        Store(spark, path)


def test_redelivered_batches_and_late_operations(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", compact_at=1)
    schema = "seq long, prefix long, suffix long, is_delete boolean, value double"
    new = spark.createDataFrame([(9, 1, 1, True, None), (8, 1, 2, False, 8.0)], schema)
    assert store.append(new, 0) and not store.append(new, 0)
    store.maintain()
    assert not store.append(new, 0)
    store.append(spark.createDataFrame([(3, 1, 1, False, 3.0), (4, 1, 2, False, 4.0)], schema), 1)
    store.maintain()
    assert contents(store) == {(1, 2): 8.0}


def test_streaming_equals_batch(spark, sf, tmp_path):
    store = drain(event_stream(spark, sf), Store(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/c")
    again = drain(event_stream(spark, sf), store, f"file://{tmp_path}/c")
    assert sorted(map(tuple, again.state.collect()), key=str) == sorted((tuple(r) for r in Tables(spark, sf).state.select(again.state.columns).collect()), key=str)


def test_empty_store_and_empty_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert contents(store) == {} and not store.flush() and not store.compact()
    store.append(spark.createDataFrame([], "seq long, prefix long, suffix long, is_delete boolean, value double"))
    store.maintain()
    assert contents(store) == {} and store.checksum() == (0, 0)
