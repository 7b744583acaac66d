"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.shared import cut as cut
from tidelog.sources.shared import scratch as scratch_path

#: Whole texts that a Python worker takes from an Arrow batch at a time (the batch itself is bounded by Spark's bytes).
TEXT_BATCH_ROWS = 256
#: Bytes of files under which partitions are put together.
SMALL = 8 << 20
#: Keys that are broadcast at most; a hashed one takes some 70 bytes.
FEW = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame) -> int:
    """Partitions that suit a table's size, by its plan's estimate: of SMALL bytes at least, but two for each core."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, min(-(-size // SMALL), 1 << 30))


def scanned(df: DataFrame) -> DataFrame:
    """`df` in fewer partitions where its files are many and small, so that what is written from it isn't; no shuffle."""
    return df.coalesce(parts(df))


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write to a table in the shared folder and read it back: a checkpoint in columnar, compressed form.

    A narrow table's small partitions are put together first (adaptive execution sees how many are needed).
    """
    path = scratch_path(df.sparkSession, name)
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(columns: Iterable[str], name: str) -> str:
    """`name`, or one made of it, that none of `columns` has (Spark takes names for equal whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """The column of exactly that name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def only(df: DataFrame, key: Column, wanted: DataFrame, others: DataFrame) -> DataFrame:
    """The rows of `df` whose key is in `wanted`. Both tables have one column, key; `others` holds the remaining keys.

    Wide rows stay where they are if one of the tables has FEW keys at most: the smaller one is broadcast. Else both sides
    are shuffled. Rows with a null key go.
    """
    at = free(df.columns, "__key")
    wanted, others, rows = wanted.select(F.col("key").alias(at)), others.select(F.col("key").alias(at)), df.where(key.isNotNull())
    match = key == F.col(at)
    n, m = wanted.count(), others.count()
    if min(n, m) <= FEW:
        return rows.join(F.broadcast(wanted), match, "left_semi") if n <= m else rows.join(F.broadcast(others), match, "left_anti")
    return rows.join(wanted.hint("shuffle_hash"), match, "left_semi")


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = TEXT_BATCH_ROWS) -> Callable:
    """`run` on batches of `rows` rows at most, whatever the session's batches hold; empty ones are left out.

    After its partition the worker gives back the memory that Arrow and malloc only keep for later.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(sliced(batches, rows))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidy


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunked(items: Column) -> Column:
    """An array's elements in chunks of the square root of their number; one empty chunk of none."""
    n = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("int")
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / width).cast("int"))
    return F.transform(numbers, lambda k: F.slice(items, k * width + 1, width))


def run_through(items: Column, start: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """All that `emit` (an array of `kind`) gives for the elements of an array, from the state before each.

    The state goes on by `advance`. Arrays grow by copying in an aggregate, so elements are taken in chunks of the square
    root of their number: once for the state that each chunk begins with, once within the chunks.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(chunk: Column, state: Column) -> Column:
        zero = F.struct(state.alias("s"), none.alias("out"))
        return F.aggregate(chunk, zero, lambda a, x: F.struct(advance(a["s"], x).alias("s"), F.concat(a["out"], emit(a["s"], x)).alias("out")), lambda a: a["out"])

    def states(chunks: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array(start).alias("all"))
        after = lambda a, c: F.aggregate(c, a["s"], advance)

        def step(a: Column, c: Column) -> Column:
            return let(after(a, c), lambda s: F.struct(s.alias("s"), F.concat(a["all"], F.array(s)).alias("all")))

        return F.aggregate(chunks, zero, step, lambda a: a["all"])

    return F.flatten(let(let(items, chunked), lambda chunks: let(states(chunks), lambda before: F.transform(chunks, lambda c, i: within(c, F.element_at(before, i + 1))))))


def block_of(n: int, dim: int, tasks: int, floats: int, least: int = 1024) -> int:
    """Vectors that one task holds at a time: a task's share of them, but never more than `floats` numbers."""
    return max(1, min(max(least, -(-n // max(1, tasks))), max(1, floats // max(1, dim))))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], value: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """From batches sorted by integer key columns: each key with the values of all its rows."""
    last, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        vals = batch.column(value).to_numpy(zero_copy_only=False)
        new = np.zeros(len(vals), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        for b, e in zip(at, [*at[1:], len(vals)], strict=True):
            key = tuple(int(c[b]) for c in cols)
            if key != last:
                if kept:
                    yield last, np.concatenate(kept)
                last, kept = key, []
            kept.append(vals[b:e])
    if kept:
        yield last, np.concatenate(kept)


class Forest:
    """Union-find over 0..n-1 in whole arrays; a root is the smallest member of its tree."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(q, p):
                self.parent = p
                return p
            p = q

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            x, y = p[a], p[b]
            m = x != y
            a, b, x, y = a[m], b[m], x[m], y[m]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
