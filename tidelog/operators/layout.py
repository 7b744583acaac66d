"""Block layout of sorted runs: shared prefixes, restart points, block packing, offsets and encoded sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.frames import FOOTER_SIZE, little
from tidelog.operators import lookup, ranged
from tidelog.sources.shared import cut, partitions

BLOCK_SIZE, RESTART_INTERVAL = 4096, 16
#: Bytes of a frame's checksum and length; of an entry's three lengths; of a string's length.
FRAME, ENTRY, LENGTH = 12, 12, 8
#: Bytes of a block besides its data and restart points: two lengths and the frame.
BLOCK_FRAME = FRAME + 2 * LENGTH


def key_size(key: Column) -> Column:
    return (F.octet_length(key) + LENGTH).cast("long")


def value_size(value: Column, tombstone: Column) -> Column:
    return F.when(tombstone, F.lit(2)).otherwise(F.octet_length(value) + 10).cast("long")


def log_size(key: Column, value: Column, tombstone: Column) -> Column:
    """Bytes of a log record with its frame."""
    return F.when(tombstone, F.octet_length(key) + 12 + FRAME).otherwise(F.octet_length(key) + F.octet_length(value) + 20 + FRAME).cast("long")


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two strings share at their beginnings."""
    x, y = a.cast("binary"), b.cast("binary")
    n = F.least(F.octet_length(a), F.octet_length(b))
    differ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
    at = F.array_position(differ, True)
    return F.when(n == 0, 0).when(at > 0, at - 1).otherwise(n).cast("long")


def shared_prefix(key: Column, before: Column) -> Column:
    """Bytes that a serialised key shares with the one before it; a key begins with its length, low byte first."""
    n, m = F.octet_length(key), F.octet_length(before)
    header = F.lit(0)
    for k in (3, 2, 1):
        header = F.when(F.shiftright(n, 8 * (k - 1)) % 256 == F.shiftright(m, 8 * (k - 1)) % 256, F.lit(1) + header).otherwise(0)
    return F.when(before.isNull(), 0).when(n == m, common_prefix(key, before) + LENGTH).otherwise(header).cast("long")


def numbered(entries: DataFrame, by: str = "sstable_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Entries of runs with their 0-based place and the key before; a long run is dealt over many tasks.

    Entries of one key lie in the order of the columns `ties`; in any order without them.
    """
    placed = ranged.ranged(entries, by, "key", *ties)
    carry = ranged.carried(placed, by, __offset=(F.count("*"), "sum"), __last=(F.max("key"), "last"))
    order = ranged.within(by, "key", *ties)
    rows = placed.withColumn("__row", F.row_number().over(order)).withColumn("__lag", F.lag("key").over(order))
    out = ranged.joined(rows, carry, by)
    place = (F.col("__row") - 1 + F.coalesce("__offset", F.lit(0))).cast("long")
    return out.select(*entries.columns, place.alias("pos"), F.coalesce("__lag", "__last").alias("before"))


def restart_points(entries: DataFrame, by: str = "sstable_id", interval: int = RESTART_INTERVAL) -> DataFrame:
    """Every 16th key of a run taken as one block; also its sparse index of that spacing."""
    return numbered(entries, by).where(F.col("pos") % interval == 0).select(by, F.floor(F.col("pos") / interval).cast("long").alias("block_no"), F.col("key").alias("first_key"))


def rebuilt(suffixes: DataFrame, by: str = "sstable_id") -> DataFrame:
    """Keys from rows (by, pos, shared, suffix): each takes its shared bytes from the key before, within a restart group."""
    group = F.floor(F.col("pos") / RESTART_INTERVAL)
    rows = suffixes.groupBy(by, group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("pos", "shared", "suffix"))).alias("rows"))  # 16 rows at most
    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<struct<pos:bigint,key:string>>").alias("keys"))

    def step(s: Column, r: Column) -> Column:
        key = F.concat(F.substring(s["last"], F.lit(1), r["shared"].cast("int")), r["suffix"])
        return F.struct(key.alias("last"), F.concat(s["keys"], F.array(F.struct(r["pos"].alias("pos"), key.alias("key")))).alias("keys"))

    return rows.select(by, F.explode(F.aggregate("rows", zero, step, lambda s: s["keys"])).alias("r")).select(by, "r.pos", "r.key")


def serialised(key: Column) -> Column:
    """A key's bytes in a run: its length in eight, then itself."""
    return F.concat(little(F.octet_length(key).cast("long"), LENGTH), key.cast("binary"))


def in_blocks(entries: DataFrame, packed: DataFrame, by: str = "sstable_id") -> DataFrame:
    """Entries with block_no, place (from 0) in the block, the key before, and `shared` bytes, by the blocks of `packed`.

    An entry's place in its run decides, not its key: a key may lie in a run several times, and on both sides of a block's
    end. Such entries are in the order in which `blocks` packs them.
    """
    sized = entries.withColumn("__width", value_size(F.col("value").cast("string"), F.col("is_tombstone")))
    rows = numbered(sized, by, ("__width", "value", "is_tombstone")).drop("__width")
    starts = packed.select(by, F.col("start").alias("first_key"), "block_no")
    floor = lookup.floor_lookup(rows.select(by, F.col("pos").alias("key")), starts, by)
    out = rows.join(floor.select(by, F.col("key").alias("pos"), "block_no", (F.col("key") - F.col("first_key")).alias("place")), [by, "pos"])
    shared = F.when(F.col("place") % RESTART_INTERVAL == 0, 0).otherwise(shared_prefix(F.col("key"), F.col("before")))
    return out.withColumn("shared", shared.cast("long"))


def held(rows: DataFrame, by: str = "sstable_id") -> DataFrame:
    """(by, block_no, place, shared, suffix, value, is_tombstone): what `in_blocks` gives as blocks hold it."""
    suffix = F.expr("substring(raw, cast(shared as int) + 1)")
    return rows.withColumn("raw", serialised(F.col("key"))).select(by, "block_no", "place", "shared", suffix.alias("suffix"), "value", "is_tombstone")


def encoded(entries: DataFrame, packed: DataFrame, by: str = "sstable_id") -> DataFrame:
    """A run's entries as its blocks hold them."""
    return held(in_blocks(entries, packed, by), by)


def decoded(held: DataFrame, by: str = "sstable_id") -> DataFrame:
    """Entries (by, block_no, place, key, value, is_tombstone) from what `encoded` gives, sixteen at a time."""
    group = F.floor(F.col("place") / RESTART_INTERVAL)
    rows = held.groupBy(by, "block_no", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("place", "shared", "suffix", "value", "is_tombstone"))).alias("rows"))
    kind = f"array<struct<place:bigint,raw:binary,value:{held.schema['value'].dataType.simpleString()},is_tombstone:boolean>>"
    zero = F.struct(F.unhex(F.lit("")).alias("last"), F.array().cast(kind).alias("out"))

    def step(s: Column, r: Column) -> Column:
        raw = F.concat(F.substring(s["last"], F.lit(1), r["shared"].cast("int")), r["suffix"])
        return F.struct(raw.alias("last"), F.concat(s["out"], F.array(F.struct(r["place"].alias("place"), raw.alias("raw"), r["value"].alias("value"), r["is_tombstone"].alias("is_tombstone")))).alias("out"))

    rows = rows.select(by, "block_no", F.explode(F.aggregate("rows", zero, step, lambda s: s["out"])).alias("r"))
    return rows.select(by, "block_no", "r.place", F.expr(f"substring(r.raw, {LENGTH + 1})").cast("string").alias("key"), "r.value", "r.is_tombstone")


def filter_bytes(n: Column, level: Column) -> Column:
    """Bytes of an xor filter of n keys: a seed, a block length and the fingerprints, of 8 bits at level 0 and of 16 above."""
    slots = F.floor((F.floor(n * F.lit(1.23)) + 32) / 3) * 3
    return (FRAME + 3 * LENGTH + slots * F.when(level > 0, 2).otherwise(1)).cast("long")


def file_sizes(entries: DataFrame, packed: DataFrame, level: Column | None = None, by: str = "sstable_id") -> DataFrame:
    """(by, block_bytes, filter_bytes, index_bytes, meta_bytes, file_size) of every run as a file, footer included."""
    level = F.lit(0) if level is None else level
    of = packed.groupBy(by).agg(F.sum(frame_bytes()).cast("long").alias("block_bytes"), (F.sum(F.octet_length("first_key") + 2 * LENGTH) + LENGTH + FRAME).cast("long").alias("index_bytes"))
    ends = entries.groupBy(by).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    meta = key_size(F.col("least").cast("string")) + key_size(F.col("most").cast("string")) + LENGTH + 2 + FRAME
    out = of.join(ends, by).select(by, "block_bytes", filter_bytes(F.col("n"), level).alias("filter_bytes"), "index_bytes", meta.cast("long").alias("meta_bytes"))
    return out.withColumn("file_size", F.col("block_bytes") + F.col("filter_bytes") + F.col("index_bytes") + F.col("meta_bytes") + FOOTER_SIZE)


#: Entries of a run that are packed together.
CHUNK = 1 << 18


def _ends(full: np.ndarray, rest: np.ndarray, block_size: int, most: int) -> np.ndarray:
    """For a block beginning at each entry, the entry after its last; len + 1 if it isn't filled by these entries.

    An entry costs `full` where a restart begins (every sixteenth of the block), else `rest`. Sums of `rest` and, sixteen by
    sixteen, of what restarts cost more give any block's size at once, so the ends are sought by halving for all entries
    side by side.
    """
    n = len(full)
    sums = np.concatenate([[0], np.cumsum(rest)])
    more = np.zeros(-(-n // RESTART_INTERVAL) * RESTART_INTERVAL, np.int64)
    more[:n] = full - rest
    more = np.concatenate([np.zeros(RESTART_INTERVAL, np.int64), np.cumsum(more.reshape(-1, RESTART_INTERVAL), axis=0).ravel()])  # at i + 16: those at i, i - 16, ...
    first = np.arange(n)

    def filled(last: np.ndarray) -> np.ndarray:
        restarts = (last - first) // RESTART_INTERVAL
        size = sums[last + 1] - sums[first] + more[first + (restarts + 1) * RESTART_INTERVAL] - more[first]
        return size + 4 * (restarts + 1) >= block_size

    low, high = first.copy(), np.minimum(first + most, n - 1)
    ever = filled(high)
    while (low < high).any():
        mid = (low + high) // 2
        yes = filled(mid)
        low, high = np.where(yes, low, np.minimum(mid + 1, high)), np.where(yes, mid, high)
    return np.where(ever, low + 1, n + 1)


def blocks(entries: DataFrame, by: str = "sstable_id", block_size: int = BLOCK_SIZE, chunk: int = CHUNK) -> DataFrame:
    """(by, block_no, first_key, num_entries, data_bytes, restarts, start): a block closes with the entry that fills it;
    `start` is its first entry's place in the run.

    Where a block begins depends on all before it, yet a block's end depends on its beginning alone. So a run is cut into
    chunks of entries, each with the last entries of the chunk before (as many as a block can hold). A chunk tabulates, for
    each entry at which the block that reaches into it may have begun, how many blocks it ends and where the next one
    begins; one task a run goes through these tables; and every chunk then lists its own blocks.
    """
    most = block_size // (ENTRY + 2) + 2
    chunk = max(chunk, most)
    rows = numbered(entries.select(by, F.col("key").cast("string").alias("key"), value_size(F.col("value").cast("string"), F.col("is_tombstone")).alias("width")), by, ("width",))
    full = ENTRY + LENGTH + F.octet_length("key") + F.col("width")
    rows = rows.select(by, "pos", "key", full.cast("long").alias("full"), (full - shared_prefix(F.col("key"), F.col("before"))).cast("long").alias("rest"))
    own = F.floor(F.col("pos") / chunk).cast("long")
    also = F.when(F.col("pos") % chunk >= chunk - most, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("chunk", F.explode(also)).select(by, "chunk", "pos", "full", "rest", "key")
    dealt = cut(dealt.repartition(partitions(rows), by, "chunk").sortWithinPartitions(by, "chunk", "pos"))
    kind = entries.schema[by]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each (run, chunk), whole."""
        now, kept = None, []
        for b in batches:
            if not b.num_rows:
                continue
            of = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if of[s] != now:
                    if kept:
                        yield pa.Table.from_batches(kept)
                    now, kept = of[s], []
                kept.append(b.slice(s, e - s))
        if kept:
            yield pa.Table.from_batches(kept)

    def read(t: pa.Table) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, first place, how many entries are of the chunk before, both costs, and the ends."""
        number, pos = t["chunk"][0].as_py(), t["pos"].to_numpy()
        full, rest = t["full"].to_numpy(), t["rest"].to_numpy()
        return number, int(pos[0]), int(np.searchsorted(pos, number * chunk)), full, rest, _ends(full, rest, block_size, most)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            number, first, before, full, _, ends = read(t)
            n = len(full)
            at, made = np.arange(before + 1), np.zeros(before + 1, np.int64)
            begun = at + first
            going = np.arange(len(at))
            while len(going):
                to = ends[np.minimum(at[going], n - 1)]
                # a block of the chunk before that ends there is that chunk's, and no block that reaches into this one
                going, to = going[(at[going] < n) & (to <= n)], to[(at[going] < n) & (to <= n)]
                at[going] = to
                made[going] += to > before
            yield pa.RecordBatch.from_arrays([t[by].combine_chunks().slice(0, 1), *(pa.array([x], k) for x, k in ((number, pa.int64()), (begun.tolist(), pa.list_(pa.int64())), (made.tolist(), pa.list_(pa.int64())), ((at + first).tolist(), pa.list_(pa.int64()))))], [by, "chunk", "begun", "made", "next"])

    def run_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, made = None, 0, 0
        for b in batches:
            out: list[tuple[int, int]] = []
            for i, of in enumerate(b.column(0).to_pylist()):
                if of != now:
                    now, at, made = of, 0, 0
                out.append((at, made))
                begun = b.column(2)[i].values.to_numpy()
                k = int(np.searchsorted(begun, at))
                made += b.column(3)[i].values[k].as_py()
                at = b.column(4)[i].values[k].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], [by, "chunk", "at", "made"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            _, first, before, full, rest, ends = read(t)
            s, n, starts, stops = t["at"][0].as_py() - first, len(full), [], []
            if before == n:  # beyond the run's last entry
                continue
            last = t["pos"][n - 1].as_py() == t["size"][0].as_py() - 1
            while s < n and (ends[s] <= n or last):
                starts.append(s)
                stops.append(min(int(ends[s]), n))
                s = stops[-1]
            b, e = np.array(starts, np.int64), np.array(stops, np.int64)
            sums = np.concatenate([[0], np.cumsum(rest)])
            extra = np.array([int((full - rest)[x:y:RESTART_INTERVAL].sum()) for x, y in zip(starts, stops, strict=True)], np.int64)
            cols = [pa.array(np.arange(len(b)) + t["made"][0].as_py()), t["key"].take(pa.array(b)).combine_chunks(), pa.array(e - b), pa.array(sums[e] - sums[b] + extra), pa.array(-(-(e - b) // RESTART_INTERVAL)), pa.array(b + first)]
            yield pa.RecordBatch.from_arrays([t[by].combine_chunks().take(pa.array(np.zeros(len(b), np.int64))), *cols], [by, "block_no", "first_key", "num_entries", "data_bytes", "restarts", "start"])

    def schema(of: str) -> T.StructType:
        return T.StructType([kind, *T._parse_datatype_string(of).fields])

    tables = dealt.mapInArrow(tabulate, schema("chunk long, begun array<long>, made array<long>, next array<long>"))
    entered = tables.repartition(by).sortWithinPartitions(by, "chunk").mapInArrow(run_through, schema("chunk long, at long, made long"))
    sizes = rows.groupBy(by).agg(F.count("*").alias("size"))
    whole = dealt.join(entered.join(sizes, by), [by, "chunk"]).select(*dealt.columns, "at", "made", "size")
    out = whole.repartition(partitions(rows), by, "chunk").sortWithinPartitions(by, "chunk", "pos").mapInArrow(listed, schema("block_no long, first_key string, num_entries long, data_bytes long, restarts long, start long"))
    return out


def frame_bytes() -> Column:
    return (F.col("data_bytes") + F.col("restarts") * 4 + BLOCK_FRAME).cast("long")


def offsets(packed: DataFrame, by: str = "sstable_id", size: Column | None = None) -> DataFrame:
    """Blocks with the byte offset at which each begins in its run's file; `size` sums up something else."""
    placed = ranged.ranged(packed.withColumn("__bytes", frame_bytes() if size is None else size), by, "block_no")
    carry = ranged.carried(placed, by, __base=(F.sum("__bytes"), "sum"))
    before = ranged.within(by, "block_no").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.joined(placed.withColumn("__own", F.sum("__bytes").over(before)), carry, by)
    return out.select(*packed.columns, (F.coalesce("__own", F.lit(0)) + F.coalesce("__base", F.lit(0))).cast("long").alias("offset"))


def amplification(on_disk: Column, raw: Column) -> Column:
    return F.when(raw > 0, on_disk / raw).otherwise(0.0)


def tier(ratio: Column) -> Column:
    return F.when(ratio < 1.05, "ELITE").when(ratio < 1.15, "EXCELLENT").otherwise("GOOD")
