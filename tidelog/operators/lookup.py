"""The read path as data: layered lookups, runs probed, overlaps, floor lookups in an index, block-cache traces."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import ranged


def layered(entries: DataFrame) -> DataFrame:
    """From entries with layer (0 the newest): the first layer that has each key decides, tombstones hiding the rest."""
    first = F.min_by(F.struct("layer", "value", "is_tombstone"), "layer").alias("e")
    return entries.groupBy("key").agg(first).select("key", F.col("e.layer").alias("layer"), F.when(~F.col("e.is_tombstone"), F.col("e.value")).alias("value"), (~F.col("e.is_tombstone")).alias("found"))


#: Runs whose ranges are counted together.
CHUNK = 64


def _probed(keys: np.ndarray, hit: np.ndarray, ids: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For sorted keys, how many runs hold each within their range and are as new as `hit` (-1 for none) or newer.

    Runs are taken in chunks, newest first: one sum of steps covers all keys whose hit is older than the whole chunk; only
    for keys whose hit lies within the chunk's ids are its runs looked at one by one.
    """
    first, end = np.searchsorted(keys, least), np.searchsorted(keys, most, side="right")
    out, order = np.zeros(len(keys), np.int64), np.argsort(-ids, kind="stable")
    for i in range(0, len(order), CHUNK):
        own = order[i : i + CHUNK]
        steps = np.zeros(len(keys) + 1, np.int64)
        np.add.at(steps, first[own], 1)
        np.add.at(steps, end[own], -1)
        oldest, newest = ids[own[-1]], ids[own[0]]
        out += np.where(hit <= oldest, np.cumsum(steps)[:-1], 0)
        at = np.flatnonzero((hit > oldest) & (hit <= newest))
        out[at] += ((first[own] <= at[:, None]) & (at[:, None] < end[own]) & (ids[own] >= hit[at][:, None])).sum(axis=1)
    return out


def runs_probed(probes: DataFrame, runs: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, n_probed): runs whose key range holds the probe, newest first, up to the one that has it.

    `runs` is run metadata, one row a run. Probes are range-partitioned by key; a run goes to each partition that its range
    meets, and a partition counts by sorted places, without forming pairs.
    """
    hit = entries.groupBy("key").agg(F.max("sstable_id").alias("hit"))
    keys = ranged.ranged(probes.select("key").where(F.col("key").isNotNull()).distinct(), "key")
    parts = keys.groupBy(ranged.PART).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    meets = overlap(F.col("lo"), F.col("hi"), F.col("min_key"), F.col("max_key"))
    own = runs.select(F.col("sstable_id").cast("long").alias("id"), "min_key", "max_key").join(F.broadcast(parts), meets)  # a row for each partition
    kind = probes.schema["key"].dataType
    rows = keys.join(hit, "key", "left").select(ranged.PART, F.lit(1).alias("side"), "key", F.coalesce("hit", F.lit(-1)).cast("long").alias("id"), F.lit(None).cast(kind).alias("most"))
    rows = own.select(ranged.PART, F.lit(0).alias("side"), F.col("min_key").cast(kind).alias("key"), "id", F.col("max_key").cast(kind).alias("most")).unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        now = None

        def counted() -> Iterator[pa.RecordBatch]:
            if held[1]:
                asked = pa.Table.from_batches(held[1])
                runs_ = pa.Table.from_batches(held[0]) if held[0] else asked.slice(0, 0)
                key, least, most = (c.to_numpy() for c in (asked["key"], runs_["key"], runs_["most"]))
                n = _probed(key, asked["id"].to_numpy(), runs_["id"].to_numpy(), least, most)
                yield pa.RecordBatch.from_arrays([asked["key"].combine_chunks(), pa.array(n)], ["key", "n_probed"])
            held.update({0: [], 1: []})

        for b in batches:
            part, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (side[1:] != side[:-1]))) if len(part) else []
            for i, e in zip(edges, [*edges[1:], len(part)], strict=True):
                if part[i] != now:
                    yield from counted()
                    now = part[i]
                held[int(side[i])].append(b.slice(i, e - i))
        yield from counted()

    key_type = T.StructType([T.StructField("key", kind), T.StructField("n_probed", T.LongType())])
    return rows.repartition(ranged.PART).sortWithinPartitions(ranged.PART, "side", "key").mapInArrow(run, key_type)


#: Bits a key and hashes of a run's approximate filter: one absent key in a hundred is taken for a present one.
FILTER_BITS, FILTER_HASHES = 10, 7


def key_hash(key: Column, seed: int = 0) -> Column:
    """64 bits of a key; only their spread matters."""
    return F.xxhash64(key, F.lit(seed))


def _positions(size: int) -> Column:
    return F.explode(F.array(*(F.pmod(key_hash(F.col("key"), k), F.lit(size)) for k in range(FILTER_HASHES))))


def filter_of(keys: DataFrame, n: int) -> DataFrame:
    """(word, bits): a filter for `n` keys, 64 positions a word, combined before the shuffle."""
    at = keys.select(_positions(max(64, n * FILTER_BITS)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))


def maybe_contains(probes: DataFrame, bits: DataFrame, n: int) -> DataFrame:
    """(key, maybe) for every distinct probe: false only for keys that the filter was not made of."""
    at = probes.select("key").distinct().select("key", _positions(max(64, n * FILTER_BITS)).alias("at")).withColumn("word", F.floor(F.col("at") / 64))
    hit = F.coalesce(F.expr("(shiftrightunsigned(bits, cast(at % 64 as int)) & 1) = 1"), F.lit(False))
    return at.join(bits, "word", "left").groupBy("key").agg(F.bool_and(hit).alias("maybe"))


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Whether two closed key ranges meet."""
    return (a_min <= b_max) & (b_min <= a_max)


def overlapping(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of runs whose ranges meet."""
    a = left.select(F.col("sstable_id").alias("left_id"), F.col("min_key").alias("a_min"), F.col("max_key").alias("a_max"))
    b = right.select(F.col("sstable_id").alias("right_id"), F.col("min_key").alias("b_min"), F.col("max_key").alias("b_max"))
    return a.join(b, overlap(*map(F.col, ("a_min", "a_max", "b_min", "b_max")))).select("left_id", "right_id")


def hull_overlapping(runs: DataFrame, level: DataFrame) -> DataFrame:
    """The runs of a level that meet the hull of a set of runs; none for an empty set."""
    hull = runs.agg(F.min("min_key").alias("hull_min"), F.max("max_key").alias("hull_max"))
    meets = overlap(F.col("hull_min"), F.col("hull_max"), F.col("min_key"), F.col("max_key"))
    return level.join(F.broadcast(hull), meets).drop("hull_min", "hull_max")  # one row is broadcast


def floor_lookup(probes: DataFrame, index: DataFrame, by: str = "sstable_id") -> DataFrame:
    """For each probe (by, key) the greatest first_key <= key of the index (by, first_key, block_no), null below the first.

    Both are sorted together, a run over many tasks; the last index row seen is the floor, which partitions hand on.
    """
    rows = index.select(by, F.col("first_key").alias("key"), F.struct("first_key", "block_no").alias("floor"), F.lit(0).alias("side"))
    rows = rows.unionByName(probes.select(by, "key", F.lit(None).cast(rows.schema["floor"].dataType).alias("floor"), F.lit(1).alias("side")))
    placed = ranged.ranged(rows, by, "key", "side")
    carry = ranged.carried(placed, by, __floor=(F.max("floor"), "last"))
    seen = ranged.within(by, "key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.joined(placed.withColumn("__own", F.last("floor", ignorenulls=True).over(seen)), carry, by).where("side = 1")
    floor = F.coalesce("__own", "__floor")
    return found.select(by, "key", floor["first_key"].alias("first_key"), floor["block_no"].alias("block_no"))


def run_get(probes: DataFrame, entries: DataFrame, index: DataFrame, held: DataFrame) -> DataFrame:
    """(sstable_id, key, in_range, block_no, value, is_tombstone, found) for each probe (sstable_id, key) of a run.

    As a run is read: keys outside its range are answered by its metadata; of the others those that the filter rules out
    go; the index's floor names the block of what is left, and only that block is looked into. `held` is the entries with
    their block_no, `index` their blocks' first keys. block_no, value and is_tombstone are null unless the key is found.
    """
    ends = entries.groupBy("sstable_id").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    asked = probes.select("sstable_id", "key").distinct().join(ends, "sstable_id", "left")
    asked = asked.withColumn("in_range", F.coalesce(F.col("key").between(F.col("least"), F.col("most")), F.lit(False))).drop("least", "most")
    pair = F.struct(F.col("sstable_id").cast("long").alias("r"), F.col("key").alias("k")).alias("key")
    n = entries.count()
    maybe = maybe_contains(asked.where("in_range").select(pair), filter_of(entries.select(pair), n), n).where("maybe").select(F.col("key.r").alias("sstable_id"), F.col("key.k").alias("key"))
    at = floor_lookup(maybe, index).select("sstable_id", "key", "block_no").where(F.col("block_no").isNotNull())
    hit = at.join(held.select("sstable_id", "block_no", "key", "value", "is_tombstone"), ["sstable_id", "block_no", "key"]).withColumn("found", F.lit(True))
    out = asked.join(hit, ["sstable_id", "key"], "left")
    return out.select("sstable_id", "key", "in_range", "block_no", "value", "is_tombstone", F.coalesce("found", F.lit(False)).alias("found"))


def cache_trace(accesses: DataFrame) -> DataFrame:
    """Accesses (access_no, sstable_id, offset) with hit: whether an unbounded cache has the block by then."""
    first = accesses.groupBy("sstable_id", "offset").agg(F.min("access_no").alias("first"))
    return accesses.join(first, ["sstable_id", "offset"]).select("access_no", "sstable_id", "offset", (F.col("access_no") > F.col("first")).alias("hit"))


def bounded_cache_trace(accesses: DataFrame, capacity: int, shards: int = 1, block_size: int = 4096) -> DataFrame:
    """Accesses with hit: whether a cache of `capacity` blocks, least recently used ones leaving, has the block by then.

    What a cache holds depends on every access before, so one shard's accesses pass through one task, in constant memory.
    A cache of many shards, each with its share of the capacity, is as many tasks.
    """
    shard = F.pmod(F.floor(F.col("offset") / block_size) + F.col("sstable_id"), F.lit(shards)).cast("int")
    rows = accesses.select(shard.alias("shard"), F.col("access_no").cast("long").alias("access_no"), F.col("sstable_id").cast("long").alias("sstable_id"), F.col("offset").cast("long").alias("offset"))
    room = max(0, capacity // shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, OrderedDict] = {}
        for b in batches:
            hits = []
            for s, *block in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                own, block = held.setdefault(s, OrderedDict()), tuple(block)
                hits.append(block in own)
                own[block] = True
                own.move_to_end(block)
                if len(own) > room:
                    own.popitem(last=False)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(hits, pa.bool_())], ["access_no", "sstable_id", "offset", "hit"])

    return rows.repartition("shard").sortWithinPartitions("shard", "access_no").mapInArrow(run, "access_no long, sstable_id long, offset long, hit boolean")
