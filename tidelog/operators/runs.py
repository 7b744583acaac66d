"""Write-buffer generations and the sorted runs that they become.

A generation ends with the entry that brings its size to the limit; the next begins at 0. That is a fold over the whole
log, done here without one task reading it: its numbers and sizes (no keys or values) are range-partitioned by seq, into as
many partitions as their bytes ask for; each partition tabulates, for every size it may be entered with, how many generations it ends and the size it leaves
with (a step function with as many steps as a generation has rows at most); one task runs through the tables in order; and
every partition then numbers its own rows, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.state import PUT_COST, cost, latest
from tidelog.sources import shared

FANOUT = 4
#: Levels beyond which no run can lie: 4^16 flushes.
LEVELS = 16


def _table(costs: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step i holds for entry sizes of least[i] and more (falling): generations ended and size left with. The last step,
    least 0, is entered when no generation ends: its size is what the rows add.

    All steps go through the rows side by side, one generation at a time.
    """
    c = np.cumsum(costs)
    n = len(c)
    last = min(n, int(np.searchsorted(c, limit)) + 1)
    at, ended = np.arange(last), np.ones(last, np.int64)
    going = at
    while len(going):
        following = np.searchsorted(c, c[at[going]] + limit)
        going = going[following < n]
        at[going] = following[following < n]
        ended[going] += 1
    return limit - c[:last], ended, c[-1] - c[at]


def generations(log: DataFrame, limit: int, size: Column | None = None, partitions: int | None = None) -> DataFrame:
    """`log` with gen, the number of the write-buffer generation of each entry (from 0), in order of seq.

    `size` is an entry's size, shallow unless given; a size of 0 or a null one counts as nothing. Entries of one seq share a
    generation; those without one get none. Only numbers and sizes are sorted; entries meet their generation by seq.
    """
    sizes = log.select("seq", F.coalesce(size if size is not None else cost(), F.lit(0)).cast("long").alias("size")).where("seq is not null")
    n = partitions or shared.partitions(sizes)
    placed = shared.cut(sizes.repartitionByRange(n, "seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id()))

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes = None, []
        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
                sizes.append(b.column(1).to_numpy())
        if sizes:
            costs = np.concatenate(sizes)
            steps = _table(costs, limit)
            cols = [[part], [int(costs.sum())], *([s.tolist()] for s in steps)]
            kinds = (pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "total", "least", "ended", "left"])

    def run_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gen = held = 0
        for b in batches:
            parts, totals = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([gen], pa.int64()), pa.array([held], pa.int64())], ["part", "gen", "held"])
                least, ended, left = (b.column(k)[i].values.to_numpy() for k in (2, 3, 4))
                step = int(np.searchsorted(-least, -held))
                if step < len(least):
                    gen, held = gen + int(ended[step]), int(left[step])
                else:
                    held += totals[i]

    tables = placed.select("part", "size").mapInArrow(tabulate, "part int, total long, least array<long>, ended array<long>, left array<long>")
    entered = tables.coalesce(1).sortWithinPartitions("part").mapInArrow(run_through, "part int, gen long, held long")
    starts = {r.part: (r.gen, r.held) for r in entered.collect()}  # a row for each partition

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gen = held = last = None
        for b in batches:
            if not b.num_rows:
                continue
            if gen is None:
                gen, held = starts[b.column(2)[0].as_py()]
            seq, c = b.column(0).to_numpy(), np.cumsum(b.column(1).to_numpy())
            gens, at, base = np.zeros(len(c), np.int64), 0, -held
            while True:
                end = int(np.searchsorted(c, base + limit))
                gens[at : end + 1] = gen
                if end >= len(c):
                    break
                gen, at, base = gen + 1, end + 1, int(c[end])
            held = int(c[-1]) - base
            new = np.append(last is None or seq[0] != last, seq[1:] != seq[:-1])
            last = seq[-1]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(new)), pa.array(gens[new])], ["seq", "gen"])

    numbered = placed.mapInArrow(number, T.StructType([log.schema["seq"], T.StructField("gen", T.LongType())]))
    kept = [c for c in log.columns if c != "gen"]
    return log.select(*kept).join(numbered, "seq", "left").select(*kept, "gen")


def put_only_generation(position: Column, limit: int) -> Column:
    """The generation of a 0-based position in a log of puts alone."""
    return F.floor(position / F.lit(-(-limit // PUT_COST))).cast("long")


def full(numbered: DataFrame, limit: int, size: Column | None = None) -> DataFrame:
    """Entries of generations that reached the limit: those that were flushed."""
    sizes = numbered.groupBy("gen").agg(F.sum(size if size is not None else cost()).alias("__size"))
    return numbered.join(sizes.where(F.col("__size") >= limit).select("gen"), "gen", "left_semi")


def flushed(numbered: DataFrame) -> DataFrame:
    """(gen, key, value, is_tombstone): the newest entry of each key in each generation, tombstones kept."""
    return latest(numbered, "gen")


def metadata(entries: DataFrame, run: str = "gen") -> DataFrame:
    """First and last key, number of entries (tombstones included) and of live ones for each run."""
    return entries.groupBy(run).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("num_entries"), F.sum((~F.col("is_tombstone")).cast("long")).alias("num_live"))


def filter_type(level: Column) -> Column:
    return F.when(level > 0, "xor16").otherwise("xor8")


def level_of(gen: Column, flushes: Column) -> Column:
    """The level that generation `gen` has reached after so many flushes, when full levels merge at once."""
    levels = [F.when(gen < F.floor(flushes / F.lit(FANOUT**k)) * F.lit(FANOUT**k), F.lit(k)) for k in range(LEVELS)]
    return F.greatest(*levels, F.lit(-1)).cast("int")


def run_of(gen: Column, level: Column) -> Column:
    """The number of its run within the level."""
    return F.floor(gen / F.pow(F.lit(FANOUT), level)).cast("long")


def files_at(flushes: int | Column, level: Column) -> Column:
    return F.floor((F.lit(flushes) if isinstance(flushes, int) else flushes) / F.pow(F.lit(FANOUT), level)).cast("long") % FANOUT


def flush_id(gen: Column) -> Column:
    """The id of a flush's run: flushes and merges draw from one counter."""
    total = gen
    for k in range(1, LEVELS):
        total = total + F.floor(gen / F.lit(FANOUT**k))
    return total.cast("long")
