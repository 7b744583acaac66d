"""Reads and writes: overwriting, deleting, missing keys, batches, replays."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.errors import InvalidDataError
from tidelog.operators import state
from tidelog.operators.state import KVFrame

LOG = "seq long, key string, value string, is_tombstone boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_put_overwrite_delete_missing(spark):
    kv = KVFrame.empty(spark).put("k1", "v1")
    assert kv.get("k1") == "v1"
    kv = kv.put("k1", "v2")
    assert kv.get("k1") == "v2"
    kv = kv.delete("k1")
    assert kv.get("k1") is None and kv.get_entry("k1") == (None, True)
    assert kv.get("k2") is None and kv.get_entry("k2") is None


def test_deleting_an_absent_key_is_allowed(spark):
    kv = KVFrame.empty(spark).put("k1", "v1").put("k2", "v2").delete("k3")
    assert [kv.get(k) for k in ("k1", "k2", "k3")] == ["v1", "v2", None]


def test_len_counts_live_entries_and_scans_show_tombstones(spark):
    kv = KVFrame.empty(spark).put("key1", "a").put("key2", "b")
    assert kv.len() == 2
    kv = kv.delete("key1")
    assert kv.len() == 1
    assert [(r.key, r.value, r.is_tombstone) for r in kv.scan().collect()] == [("key1", None, True), ("key2", "b", False)]
    assert kv.clear().len() == 0


def test_batches_apply_in_order_and_empty_ones_change_nothing(spark):
    kv = KVFrame.empty(spark)
    assert kv.write_batch([]) is kv
    kv = kv.write_batch([("put", "a", "1"), ("put", "a", "2"), ("delete", "b"), ("put", "b", "3"), ("delete", "a")])
    assert rows(kv.live(), "key", "value") == [("b", "3")]
    frame = spark.createDataFrame([(1, "c", "5", False), (0, "c", "4", False)], "op_index long, key string, value string, is_tombstone boolean")
    assert rows(kv.write_frame(frame).live(), "key", "value") == [("b", "3"), ("c", "5")]


def test_a_null_value_is_no_tombstone(spark):
    log = spark.createDataFrame([(0, "a", "old", False), (1, "a", None, False), (0, "b", "x", False), (2, "b", None, True)], LOG)
    assert rows(state.live(log), "key", "value") == [("a", None)]
    assert state.point_get(log, "a").first()[1:] == (None, True)
    assert state.point_get(log, "b").first()[1:] == (None, False)
    assert state.point_get(log, "zz").first()[1:] == (None, False)


def test_empty_keys_and_byte_order(spark):
    kv = KVFrame.empty(spark).write_batch([("put", k, k) for k in ("é", "a", "", "Z", "z")])
    assert [r.key for r in kv.scan().collect()] == ["", "Z", "a", "z", "é"]
    assert [r.key for r in kv.range("Z", "z").collect()] == ["Z", "a", "z"]


def test_keys_without_a_total_order_are_refused(spark):
    with pytest.raises(InvalidDataError):
        KVFrame(spark.createDataFrame([], "seq long, key double, value string, is_tombstone boolean"))
    with pytest.raises(InvalidDataError):
        KVFrame(spark.createDataFrame([], "seq long, key string"))


def test_live_state_equals_a_plain_replay_in_any_partitioning(spark):
    rng = random.Random(5)
    log = [(i, f"k{rng.randrange(20)}", f"v{i}", rng.random() < 0.3) for i in range(500)]
    log = [(s, k, None if dead else v, dead) for s, k, v, dead in log]
    want = {}
    for _, k, v, dead in log:
        want.pop(k, None)
        if not dead:
            want[k] = v
    rng.shuffle(log)
    df = spark.createDataFrame(log, LOG)
    for n in (1, 7):
        assert dict(rows(state.live(df.repartition(n)), "key", "value")) == want


def test_key_predicate_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(0, "a", "1", False)], LOG).write.parquet(str(tmp_path / "log"))
    df = state.point_get(spark.read.parquet(str(tmp_path / "log")), "a")
    assert "EqualTo(key,a)" in df._jdf.queryExecution().executedPlan().toString()


def test_batch_accounting(spark):
    df = spark.createDataFrame([(0, 0, "a", "1", False), (0, 1, "a", "2", False), (1, 0, "a", None, True)], "batch_id long, op_index int, key string, value string, is_tombstone boolean")
    assert rows(state.batch_counts(df), "batch_id", "n_ops", "n_deletes", "bytes") == [(0, 2, 0, 96), (1, 1, 1, 24)]
    assert rows(state.replayed(df), "key", "value", "is_tombstone") == [("a", None, True)]
    got = spark.range(2050).select(state.group_commits(F.col("id")).alias("c")).groupBy("c").count()
    assert rows(got, "c", "count") == [(0, 1024), (1, 1024), (2, 2)]


def test_accuracy_of_no_probes_is_zero(spark):
    probes = spark.createDataFrame([], "key string, expected boolean")
    assert state.accuracy(probes, spark.createDataFrame([("a", "1")], "key string, value string")).first()[:] == (0, 0, 0.0)
