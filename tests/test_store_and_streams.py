"""The store on disk, its recovery, the catalog, and streams."""

import threading

import pytest
from pyspark.sql import functions as F

from tidelog.errors import CorruptionError, InvalidDataError
from tidelog.operators import catalog, state
from tidelog.sources.store import Run, Store
from tidelog.streaming import live as streams

LOG = "seq long, key string, value string, is_tombstone boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_reopen_replays_the_log(spark, tmp_path):
    db = Store.open(spark, str(tmp_path))
    db.put("k1", "v1")
    db.put("k2", "v2")
    db.delete("k3")
    again = Store.open(spark, str(tmp_path))
    assert [again.get(k) for k in ("k1", "k2", "k3")] == ["v1", "v2", None]
    assert again.buffered == 0
    again.put("k1", "v3")
    assert Store.open(spark, str(tmp_path)).get("k1") == "v3"


def test_flush_merge_and_reopen(spark, tmp_path):
    db = Store.open(spark, str(tmp_path), limit=96)
    for at in range(0, 8, 2):
        db.write_batch([("put", f"key-{at}", "val"), ("put", f"key-{at + 1}", "val")])
    assert db.runs == [Run(1, 4)] and db.compaction_backlog() == 0 and db.log_ids() == []
    db.write_batch([("put", "key-0", "new-val"), ("delete", "key-7")])
    assert db.total_run_count() == 1 and db.log_ids() == [4]
    for s in (db, Store.open(spark, str(tmp_path), limit=96)):
        assert [s.get(k) for k in ("key-0", "key-1", "key-7", "none")] == ["new-val", "val", None, None]
        assert s.get_entry("key-7") == (None, True)
    db.flush()
    assert db.runs == [Run(0, 5), Run(1, 4)]
    assert rows(db.run_metadata(), "level", "sstable_id", "num_entries", "num_live", "filter_type") == [(0, 5, 2, 1, "xor8"), (1, 4, 8, 8, "xor16")]
    assert rows(db.live(), "key") == [(f"key-{i}",) for i in range(7)]
    assert db.disk_usage() > 0 and rows(db.range("key-1", "key-2"), "key") == [("key-1",), ("key-2",)]
    probes = spark.createDataFrame([("key-0",), ("key-7",)], "key string")
    assert rows(db.multi_get(probes), "key", "found") == [("key-0", True), ("key-7", False)]


def test_values_of_other_types(spark, tmp_path):
    db = Store.open(spark, str(tmp_path), key="struct<a:int,b:string>", value="array<int>")
    db.put((1, "x"), [1, 2])
    db.flush()
    assert [tuple(r.key) for r in db.live().collect()] == [(1, "x")] and db.live().first().value == [1, 2]


def test_a_damaged_log_stops_the_store(spark, tmp_path):
    db = Store.open(spark, str(tmp_path))
    db.put("k", "v")
    bad = db.log().withColumn("value", F.lit("w")).collect()
    db.files.delete(f"{tmp_path}/wal/000000.wal")
    spark.createDataFrame(bad, db.logged).write.parquet(f"{tmp_path}/wal/000000.wal")
    with pytest.raises(CorruptionError):
        Store.open(spark, str(tmp_path))


def test_a_missing_run_stops_the_store_and_an_orphan_does_not(spark, tmp_path):
    db = Store.open(spark, str(tmp_path))
    db.put("k", "v")
    db.flush()
    spark.createDataFrame([(9, "k", "orphan", False)], db.schema).write.parquet(f"{tmp_path}/runs/{Run(0, 99999).path}")
    assert Store.open(spark, str(tmp_path)).get("k") == "v"
    db.files.delete(f"{tmp_path}/runs/{Run(0, 0).path}")
    with pytest.raises(CorruptionError):
        Store.open(spark, str(tmp_path))


def test_point_reads_push_the_key_down(spark, tmp_path):
    db = Store.open(spark, str(tmp_path))
    db.put("k", "v")
    db.flush()
    plan = state.live(db.entries().where(F.col("key") == "k"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k)" in plan


def test_catalog_fold_allows_adding_again(spark):
    log = spark.createDataFrame([(0, "add", 0, "a", None), (1, "next_id", None, None, 1), (2, "remove", 0, "a", None), (3, "add", 0, "a", None), (4, "add", 1, "b", None), (5, "remove", 1, "b", None), (6, "next_id", None, None, 9)], "seq long, action string, level int, path string, next_id long")
    assert rows(catalog.active_runs(log), "level", "path") == [(0, "a")] and catalog.next_id(log).first().next_id == 9
    assert catalog.next_id(log.limit(0)).first().next_id == 0
    files = spark.createDataFrame([("a", 1), ("L0-1.sst", 5), ("000001.wal", 2), ("x.wal", 3), ("12.wal", 4)], "name string, length long")
    assert rows(catalog.logs(files), "wal_id") == [(1,), (12,)] and rows(catalog.orphans(files, log), "name") == [("L0-1.sst",)]
    assert catalog.disk_usage(files).first().bytes == 15 and catalog.disk_usage(files.limit(0)).first().bytes == 0


def test_many_logs_replay_by_number_then_place(spark):
    df = spark.createDataFrame([(2, 0, "k", "new", False), (1, 9, "k", "old", False), (2, 1, "j", None, True), (1, 0, "j", "x", False)], "wal_id long, pos long, key string, value string, is_tombstone boolean")
    assert rows(state.live(df, order=catalog.replay_order()), "key", "value") == [("k", "new")]


@pytest.fixture
def log_files(spark, tmp_path):
    """Three files of a log, out of order."""
    log = [(i, f"k{i % 7}", None if i % 5 == 0 else f"v{i}", i % 5 == 0) for i in range(60)]
    for n, part in enumerate((log[40:], log[:20], log[20:40])):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert n < 3
    batch = spark.read.parquet(str(tmp_path / "in"))
    return streams.log_stream(spark, str(tmp_path / "in"), batch.schema, 1), rows(state.live(batch), "key", "value"), tmp_path


def test_stream_in_complete_mode_equals_the_batch(spark, log_files):
    stream, want, top = log_files
    q = streams.newest(stream).writeStream.outputMode("complete").format("memory").queryName("newest").option("checkpointLocation", str(top / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("newest").where(~F.col("is_tombstone")), "key", "value") == want


def test_stream_with_state_per_key_equals_the_batch(spark, log_files):
    stream, want, top = log_files
    q = streams.upserted(stream).writeStream.outputMode("update").format("memory").queryName("upserted").option("checkpointLocation", str(top / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(state.live(spark.table("upserted")), "key", "value") == want


def test_stream_of_snapshots_equals_the_batch(spark, log_files):
    stream, want, top = log_files
    got = streams.drained(stream, streams.Snapshots(spark, str(top / "s")), str(top / "c"))
    assert rows(got.live(), "key", "value") == want


def test_snapshots_go_on_after_a_restart(spark, tmp_path, monkeypatch):
    """A stream that is stopped and started again, with a new object over the same folder and checkpoint."""
    monkeypatch.setattr(streams.Snapshots, "MERGED", 2)

    def put(rows):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def drain():
        stream = streams.log_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
        return streams.drained(stream, streams.Snapshots(spark, str(tmp_path / "s")), str(tmp_path / "c"))

    put([(0, "a", "1", False), (1, "b", "2", False)])
    assert rows(drain().live(), "key", "value") == [("a", "1"), ("b", "2")]
    put([(2, "c", "3", False), (3, "a", None, True)])
    assert rows(drain().live(), "key", "value") == [("b", "2"), ("c", "3")]
    assert rows(drain().live(), "key", "value") == [("b", "2"), ("c", "3")]  # no new file
    for i in range(4):
        put([(10 + i, "d", str(i), False)])
        drain()
    again = streams.Snapshots(spark, str(tmp_path / "s"))
    assert rows(again.live(), "key", "value") == [("b", "2"), ("c", "3"), ("d", "3")]
    assert again._there("b") == [3, 5] and again._there("d") == [4, 5] and rows(again.entries(4), "key", "value") == [("a", None), ("b", "2"), ("c", "3"), ("d", "2")]


@pytest.mark.parametrize("merged", [1, 2, 16])
def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path, monkeypatch, merged):
    monkeypatch.setattr(streams.Snapshots, "MERGED", merged)
    batches = [[(0, "a", "1", False)], [(1, "b", "2", False)], [(2, "a", None, True)]]
    frames_ = [spark.createDataFrame(b, LOG) for b in batches]
    for i in (0, 1, 1, 2, 2):
        streams.Snapshots(spark, str(tmp_path / "s")).merge(frames_[i], i)
    got = streams.Snapshots(spark, str(tmp_path / "s"))
    assert rows(got.live(), "key") == [("b",)] and got.version == 2
    spark.createDataFrame([], LOG).write.parquet(str(tmp_path / "s" / "d3"))
    got.files.delete(str(tmp_path / "s" / "d3" / "_SUCCESS"))
    assert got.version == 2  # a folder that was never finished doesn't count
    with pytest.raises(InvalidDataError):
        streams.Snapshots(spark, str(tmp_path / "none")).live()


def damaged(path, pattern, at=-1):
    """Flip a byte of the first file that fits."""
    file = sorted(path.glob(pattern))[0]
    raw = bytearray(file.read_bytes())
    raw[at] ^= 0xFF
    file.write_bytes(raw)
    for crc in path.glob("**/.*.crc"):
        crc.unlink()


def two_runs(spark, path):
    db = Store.open(spark, str(path))
    for part in (range(50), range(40, 90)):
        db.write_batch([("put", f"k{i:03}", f"value {i}" * 3) for i in part])
        db.flush()
    return db


def test_gets_leave_out_runs_that_cannot_hold_the_key(spark, tmp_path):
    db = two_runs(spark, tmp_path)
    for own in (db, Store.open(spark, str(tmp_path))):
        assert [len(own.holding(k)) for k in ("k001", "k045", "k080", "a", "z")] == [1, 2, 1, 0, 0]
        assert own.get("k045") == "value 45" * 3 and own.get("a") is None and own.get_entry("z") is None
        assert [(r, p.rsplit("/", 1)[1]) for r, p, n in own.run_files() if n > 500] == [(r, r.path) for r in own.runs]


def test_damage_of_catalog_and_runs_is_found(spark, tmp_path):
    for name, pattern, at in (("catalog", "MANIFEST/part-*", -1), ("footer", "runs/*/part-*", -1), ("short", "runs/*/part-*", None)):
        path = tmp_path / name
        two_runs(spark, path)
        if at is None:
            file = sorted(path.glob(pattern))[0]
            spark.read.parquet(str(file.parent)).limit(7).write.parquet(str(path / "other"))
            file.write_bytes(next((path / "other").glob("part-*")).read_bytes())
            [c.unlink() for c in path.glob("**/.*.crc")]
        else:
            damaged(path, pattern, at)
        with pytest.raises(CorruptionError):
            Store.open(spark, str(path))
    path = tmp_path / "row"
    db = two_runs(spark, path)
    rows_ = db.manifest().withColumn("level", F.col("level") + 1).collect()
    db.files.delete(f"{path}/MANIFEST")
    spark.createDataFrame(rows_, db.manifest().schema).write.parquet(f"{path}/MANIFEST")
    with pytest.raises(CorruptionError):
        Store.open(spark, str(path))
    path = tmp_path / "page"
    two_runs(spark, path)
    damaged(path, "runs/*/part-*", 60)  # inside of the first page
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt|decompress|snappy|uncompress"):
        Store.open(spark, str(path)).live().collect()


def test_clearing_the_log_and_the_catalog(spark, tmp_path):
    db = two_runs(spark, tmp_path)
    db.put("new", "x")
    db.clear_log()
    assert db.get("new") is None and Store.open(spark, str(tmp_path)).get("k001") is not None
    db.clear_catalog()
    assert Store.open(spark, str(tmp_path)).live().collect() == [] and db.get("k001") is None


def test_writes_of_many_threads_are_committed_in_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "GROUP_COMMIT", 100)
    db, commits = Store.open(spark, str(tmp_path)), []
    write = db.write_batch
    monkeypatch.setattr(db, "write_batch", lambda ops: commits.append(len(ops)) or write(ops))
    with db.writer() as w:
        def work(t):
            for i in range(65):
                w.put(f"{t}-{i}", "1")
            w.submit(("put", f"{t}-0", "2"), ("delete", f"{t}-1"))

        threads = [threading.Thread(target=work, args=(t,)) for t in range(4)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert sum(commits) == 4 * 67 and len(commits) == 3
    live = dict(rows(Store.open(spark, str(tmp_path)).live(), "key", "value"))
    assert len(live) == 4 * 64 and all(live[f"{t}-0"] == "2" and f"{t}-1" not in live for t in range(4))


def test_single_writes_are_gathered(spark, monkeypatch):
    monkeypatch.setattr(state, "GROUP_COMMIT", 8)
    kv = state.KVFrame.empty(spark)
    for i in range(30):
        kv = kv.put(f"k{i % 7}", str(i))
    assert kv.log._jdf.queryExecution().logical().toString().count("Union") <= 5
    kv = kv.delete("k0")
    assert rows(kv.live(), "key", "value") == sorted((f"k{i % 7}", str(i)) for i in range(23, 30) if i % 7) and kv.get("k0") is None
