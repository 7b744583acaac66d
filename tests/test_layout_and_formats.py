"""Block layout, frames, footers, generators, formats, measurements."""

import random
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import formats, frames, generators, measure
from tidelog.operators import layout
from tidelog.plans import queries

RUN = "sstable_id long, key string, value string, is_tombstone boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def model(entries, size=4096):
    """Blocks as (entries, data bytes, restarts), by bytes written one after the other."""
    out, n, data, last = [], 0, 0, b""
    for key, value in entries:
        raw = struct.pack("<Q", len(key.encode())) + key.encode()
        shared = 0
        if n % 16:
            while shared < min(len(raw), len(last)) and raw[shared] == last[shared]:
                shared += 1
        data += 12 + len(raw) - shared + (2 if value is None else 10 + len(value.encode()))
        n, last = n + 1, raw
        if data + 4 * -(-n // 16) >= size:
            out.append((n, data, -(-n // 16)))
            n, data, last = 0, 0, b""
    return out + [(n, data, -(-n // 16))] * (n > 0)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=300), min_size=1, max_size=120, unique=True))
def test_blocks_equal_the_byte_model(spark, keys):
    keys.sort(key=lambda k: k.encode())
    entries = [(k, None if i % 5 == 0 else "v" * (i * 7 % 90)) for i, k in enumerate(keys)]
    df = spark.createDataFrame([(1, k, v, v is None) for k, v in entries], RUN)
    got = sorted((r.block_no, r.num_entries, r.data_bytes, r.restarts) for r in layout.blocks(df).collect())
    assert [g[1:] for g in got] == model(entries)
    assert got[0][1] >= 1


def test_prefixes_of_keys_of_one_length(spark):
    df = spark.createDataFrame([(1, f"user_id_{i:05}", f"val{i}", False) for i in (1, 2, 3)], RUN)
    numbered = layout.numbered(df).select("key", layout.shared_prefix(F.col("key"), F.col("before")).alias("s"), layout.key_size(F.col("key")).alias("n"))
    assert rows(numbered, "key", "s", "n") == [("user_id_00001", 0, 21), ("user_id_00002", 20, 21), ("user_id_00003", 20, 21)]


def test_prefix_of_keys_of_other_lengths(spark):
    keys = [("a", "ab"), ("x" * 256, "x" * 512), ("x" * 4, "x" * 260), ("", ""), ("", "a"), ("é", "è")]
    df = spark.createDataFrame(keys, "b string, k string")

    def shared(a, b):
        x, y = (struct.pack("<Q", len(s.encode())) + s.encode() for s in (a, b))
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    # the header is compared over the low bytes that lengths below 2^24 have
    got = [r.s for r in df.select(layout.shared_prefix(F.col("k"), F.col("b")).alias("s")).collect()]
    assert got == [shared(a, b) for a, b in keys]


def test_encoded_sizes(spark):
    df = spark.createDataFrame([("k", "vv", False), ("key", None, True)], "key string, value string, dead boolean")
    sizes = df.select(layout.value_size(F.col("value"), F.col("dead")).alias("v"), layout.log_size(F.col("key"), F.col("value"), F.col("dead")).alias("l"))
    assert rows(sizes, "v", "l") == [(2, 12 + 12 + 3), (12, 20 + 12 + 1 + 2)]


@pytest.mark.parametrize("size", [60, 300, 4096])
def test_blocks_of_runs_dealt_over_chunks(spark, size):
    """Runs of several lengths and kinds of keys, in chunks of all sizes, against one pass over each run."""
    rng = random.Random(size)
    data = [(run, f"{'p' * rng.randrange(3)}{i:05}", rng.choice([None, "", "v" * rng.randrange(1, 60)]), False) for run, n in ((1, 900), (2, 1), (5, 333), (9, 64)) for i in range(n)]
    data = [(r, k, v, v is None) for r, k, v, _ in data]
    want = []
    for run in sorted({r for r, *_ in data}):
        n = data_bytes = block = 0
        before = first = None
        for k, v, dead in sorted((k, v, d) for r, k, v, d in data if r == run):
            raw = struct.pack("<Q", len(k)) + k.encode()
            shared = 0
            if n % 16:
                while shared < min(len(raw), len(before)) and raw[shared] == before[shared]:
                    shared += 1
                if len(raw) != len(before):
                    shared = min(shared, 0)
            first = k if n == 0 else first
            data_bytes += 12 + len(raw) - shared + (2 if dead else 10 + len(v))
            n, before = n + 1, raw
            if data_bytes + 4 * -(-n // 16) >= size:
                want.append((run, block, first, n, data_bytes, -(-n // 16)))
                n, data_bytes, block = 0, 0, block + 1
        if n:
            want.append((run, block, first, n, data_bytes, -(-n // 16)))
    df = spark.createDataFrame(data, RUN)
    cols = ("sstable_id", "block_no", "first_key", "num_entries", "data_bytes", "restarts")
    for chunk in (1, 300, layout.CHUNK):
        packed = layout.blocks(df, block_size=size, chunk=chunk)
        assert rows(packed, *cols) == want
    held = layout.encoded(df, packed)
    back = rows(layout.decoded(held), "sstable_id", "key", "is_tombstone")
    assert back == sorted((r, k, d) for r, k, _, d in data)
    assert rows(held.groupBy("sstable_id", "block_no").agg(F.count("*").alias("n")), "sstable_id", "block_no", "n") == [(r, b, n) for r, b, _, n, *_ in want]
    assert layout.blocks(df.limit(0)).collect() == []


def test_offsets_run_on(spark):
    df = spark.createDataFrame([(1, f"k{i:04}", "v" * 100, False) for i in range(200)], RUN)
    got = layout.offsets(layout.blocks(df)).orderBy("block_no").collect()
    at = 0
    for r in got:
        assert r.offset == at and (r.data_bytes + 4 * r.restarts >= 4096 or r is got[-1])
        at += r.data_bytes + 4 * r.restarts + 28


@pytest.mark.parametrize(("prefix", "length", "n", "width", "ratio"), [("user_", 10, 50_000, 50, 1.28), ("", 10, 100_000, 10, 1.81), ("data_", 25, 7_500, 75, 1.04)])
def test_space_test_ratios(spark, prefix, length, n, width, ratio):
    key = generators.space_key(F.col("id"), "prefixed" if prefix else "sequential", length, prefix)
    run = spark.range(n).select(F.lit(1).cast("long").alias("sstable_id"), key.alias("key"), F.lit("v" * width).alias("value"), F.lit(False).alias("is_tombstone"))
    blocks = layout.blocks(run).agg(F.sum(layout.frame_bytes())).first()[0]
    raw = run.agg(F.sum(F.octet_length("key") + F.octet_length("value"))).first()[0]
    index_and_filter = 1.23 * n + 26 * (blocks / 4096)  # a byte and a quarter a key, and an index entry a block
    assert abs((blocks + index_and_filter) / raw - ratio) < 0.03


def test_round_trip_of_suffixes(spark):
    keys = sorted({f"{'abc'[: i % 4]}{i * 37 % 101:03}" for i in range(90)})
    df = layout.numbered(spark.createDataFrame([(1, k, "", False) for k in keys], RUN))
    shared = F.when(F.col("pos") % 16 == 0, 0).otherwise(layout.common_prefix(F.col("key"), F.col("before"))).cast("long")
    cut = df.select("sstable_id", "pos", "key", shared.alias("shared")).select("sstable_id", "pos", "shared", F.substring(F.col("key"), F.col("shared").cast("int") + 1, F.length("key")).alias("suffix"))
    assert [k for _, k in rows(layout.rebuilt(cut), "pos", "key")] == keys


def frame(payload, crc=None, size=None):
    return struct.pack("<IQ", zlib.crc32(payload) if crc is None else crc, len(payload) if size is None else size) + payload


def test_frame_verdicts(spark):
    good = frame(b"\x2a\0\0\0payload")
    cases = [(good, "ok"), (good + good, "ok"), (b"", "end"), (good[:3], "end"), (good[:4], "truncated length"), (good[:11], "truncated length"), (good[:-5], "truncated data"), (good[:-1] + b"\0", "checksum mismatch"), (frame(b"x", size=64 * 1024 * 1024 + 1), "record too large"), (frame(b""), "ok"), (frame(b"x", size=2**64 - 1), "record too large")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, raw binary")
    assert [v for _, v in rows(df.select("i", frames.frame_verdict(F.col("raw")).alias("v")), "i", "v")] == [v for _, v in cases]


def test_events_without_properties_get_verdicts(spark, monkeypatch):
    events = spark.createDataFrame([(i, p) for i, p in enumerate([None] * 6 + [""] * 6 + ["ab"])], "event_id long, props string")
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: events)
    empty = [(12, "ok"), (3, "end"), (9, "truncated length"), (11, "truncated length"), (12, "record too large"), (12, "record too large")]
    assert rows(queries.frame_verdicts(spark, ""), "event_id", "n_bytes", "verdict") == [(i, *v) for i, v in enumerate([*empty, *empty, (14, "ok")])]


def test_frames_as_written(spark):
    df = spark.createDataFrame([(bytearray(b"LSM,Rust"),), (bytearray(b""),)], "p binary")
    assert [bytes(r.f) for r in df.select(frames.frame(F.col("p")).alias("f")).collect()] == [frame(b"LSM,Rust"), frame(b"")]


def test_footer_verdicts(spark):
    def foot(magic=0xDEADC0DEBEEFCAFF, version=1):
        return struct.pack("<QQQQQI", 1, 2, 3, 4, magic, version) + bytes(20)

    cases = [(b"data" + foot(), "ok"), (foot(), "ok"), (foot()[1:], "too small"), (foot(magic=1), "bad magic"), (foot(version=2), "unsupported version"), (b"", "too small")]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, raw binary")
    assert [v for _, v in rows(df.select("i", frames.footer_verdict(F.col("raw")).alias("v")), "i", "v")] == [v for _, v in cases]


def test_generators_wrap_like_64_bit_numbers(spark):
    def lcg(i):
        return (i * 6364136223846793005 + 1) % 2**64

    ids = [0, 1, 2, 12345, 199_999, 10**9, 2**40]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", generators.lcg(F.col("i")).alias("x"), generators.target(F.col("i"), 50_000).alias("r"), generators.target(F.col("i"), 777, generators.OVERWRITE).alias("o"), generators.key(F.col("i"), "striped", 4, 16).alias("s"), generators.key(F.col("i"), "random", 24).alias("k"))
    for r in df.collect():
        assert int(r.x) == lcg(r.i)
        assert r.r == (lcg(r.i) * 1103515245 + 12345) % 2**64 % 50_000
        assert r.o == (lcg(r.i) * 1664525 + 1013904223) % 2**64 % 777
        assert r.s == f"s{r.i % 16}-key-{r.i // 16:04}" and r.k == f"key-{lcg(r.i) % 10**9:024}"


def test_random_space_keys_repeat_and_have_their_length(spark):
    df = spark.range(50).select(generators.space_key(F.col("id"), "random", 16).alias("k"))
    keys = [r.k for r in df.collect()]
    assert keys == [r.k for r in df.collect()] and len(set(keys)) == 50 and all(len(k) == 16 and k.isalnum() for k in keys)


def test_formats(spark):
    df = spark.createDataFrame([(0, 0.0), (999, 0.994), (1000, 1.0), (1234567, 999.94), (5, 1000.4), (5, -3000.0), (5, -0.25), (5, 1234567.6), (5, float("nan")), (5, float("inf"))], "n long, v double")
    got = df.select(formats.thousands(F.col("n")).alias("t"), formats.short_float(F.col("v")).alias("f"), formats.zero_pad(F.col("n"), 3).alias("z")).collect()
    assert [r.t for r in got[:4]] == ["0", "999", "1_000", "1_234_567"]
    assert [r.f for r in got] == ["0.00", "0.99", "1.0", "999.9", "1_000", "-3000.0", "-0.25", "1_234_568", "NaN", "inf"]
    assert [r.z for r in got[:4]] == ["000", "999", "1000", "1234567"]
    assert spark.range(1).select(formats.run_name(F.lit(0), F.lit(99999)), formats.log_name(F.lit(7)), formats.kilobytes(F.lit(1536 * 1024))).first()[:] == ("L0-00000000000000099999.sst", "000007.wal", "1_536.00")


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 7)], "phase string, us long")
    got = {r.phase: r[1:] for r in measure.latencies(df, ["phase"]).collect()}
    assert got["a"] == (10, 4.5, 4.5, pytest.approx(8.55), pytest.approx(8.91)) and got["b"] == (1, 7.0, 7.0, 7.0, 7.0)


def test_throughput_and_improvement(spark):
    df = spark.createDataFrame([("x", measure.DIRTY, 2.0), ("x", measure.CLEANED, 1.5), ("y", measure.DIRTY, 0.0), ("y", measure.CLEANED, 1.0), ("z", measure.DIRTY, 1.0)], "config string, phase string, mean_us double")
    assert rows(measure.read_improvement(df), "config", "improvement_pct", "improvement_us") == [("x", 25.0, 0.5), ("y", 0.0, 0.0), ("z", 0.0, 0.0)]
    one = spark.range(1).select(measure.ops_per_second(F.lit(10), F.lit(0.0)), measure.mean_us(F.lit(0), F.lit(1.0)), layout.tier(F.lit(1.04)), layout.tier(F.lit(1.05)), layout.tier(F.lit(1.15)), layout.amplification(F.lit(1.0), F.lit(0)))
    assert one.first()[:] == (0.0, 0.0, "ELITE", "EXCELLENT", "GOOD", 0.0)


def test_records_of_framed_files(spark):
    good = [frame(b"one"), frame(b""), frame(b"x" * 100_000)]
    whole = b"".join(good)
    cases = {0: whole, 1: whole[:-1], 2: whole + b"\0\0\0", 3: whole + b"\0\0\0\0", 4: b"", 5: None, 6: frame(b"bad", crc=1) + whole, 7: frame(b"x", size=2**63) + whole}
    got = frames.records(spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in cases.items()], "f int, raw binary"), "f")
    found = {}
    for r in got.orderBy("f", "pos").collect():
        found.setdefault(r.f, []).append((r.offset, None if r.payload is None else bytes(r.payload), r.verdict))
    all_ok = [(0, b"one", "ok"), (15, b"", "ok"), (27, b"x" * 100_000, "ok")]
    assert found == {0: all_ok, 1: [*all_ok[:2], (27, None, "truncated data")], 2: all_ok, 3: [*all_ok, (len(whole), None, "truncated length")], 6: [(0, None, "checksum mismatch")], 7: [(0, None, "record too large")]}
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate((good[0], good[0][:-1], b""))], "i int, raw binary")
    assert [r[0] and bytes(r[0]) for r in df.orderBy("i").select(frames.frame_payload(F.col("raw"))).collect()] == [b"one", None, None]


def test_block_scan_of_keys_that_lie_in_a_run_several_times(spark, tmp_path):
    pages = [(i, f"https://{'x' * (j % 40)}.example.com/{j:05}") for i, j in enumerate(k // 3 if k % 2 else k for k in range(900))]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(f"Customer#{i // 90:09}", "BUILDING") for i in range(400)], "c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    urls = sorted(((u, str(i)) for i, u in pages), key=lambda e: (e[0], len(e[1]), e[1]))
    want = [(0, k, b[0], 0) for k, b in enumerate(model([(f"Customer#{i // 90:09}", "BUILDING") for i in range(400)]))]
    want += [(1, k, b[0], 0) for k, b in enumerate(model(urls))]
    assert rows(queries.QUERIES["block_scan"](spark, str(tmp_path)), "sstable_id", "block_no", "num_entries", "n_differ") == want


def test_records_of_many_small_files_share_batches(spark):
    class Files:
        schema = spark.createDataFrame([], "f long, raw binary").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    def read(*raws):
        files = pa.RecordBatch.from_arrays([pa.array(range(len(raws)), pa.int64()), pa.array(raws, pa.binary())], ["f", "raw"])
        return list(frames.records(Files(), "f")(iter([files, files.slice(0, 0)])))

    small = read(*(frame(b"%d" % i) for i in range(5000)))
    assert len(small) == 1 and small[0].column("payload").to_pylist() == [b"%d" % i for i in range(5000)] and small[0].column("f").to_pylist() == list(range(5000))
    long = read(frame(b"") * (frames.OUT + 5), None, frame(b"z")[:-1])
    assert [b.num_rows for b in long] == [frames.OUT, 6]
    assert [(r["f"], r["pos"], r["offset"], r["payload"], r["verdict"]) for r in long[1].to_pylist()] == [*((0, frames.OUT + i, 12 * (frames.OUT + i), b"", "ok") for i in range(5)), (2, 0, 0, None, "truncated data")]
    assert [b.num_rows for b in read(*[frame(b"x" * (frames.OUT_BYTES // 2))] * 5)] == [2, 2, 1]
    assert read() == [] and read(b"", None) == []
