"""State queries over a mutation log: rows (seq, key, value, is_tombstone), the newest per key deciding.

The newest entry is an aggregate (`max_by` over a struct), so Spark combines it before the shuffle and a hot key costs one
row a task. Tombstones are filtered after it: below it, that filter would bring older values back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import InvalidDataError

#: Shallow size of a put and of a delete: what a write buffer's limit counts by default.
PUT_COST, DELETE_COST = 48, 24
#: Writes that share one commit when the queue is full.
GROUP_COMMIT = 1024


def latest(log: DataFrame, *by: str, order: str | Column = "seq", extra: tuple[str, ...] = ()) -> DataFrame:
    """The newest entry of each key (of each key within `by`), tombstones included."""
    kept = ("value", "is_tombstone", *extra)
    newest = F.max_by(F.struct(*kept), F.col(order) if isinstance(order, str) else order).alias("e")
    return log.groupBy(*by, "key").agg(newest).select(*by, "key", *(F.col(f"e.{c}").alias(c) for c in kept))


def live(log: DataFrame, order: str | Column = "seq") -> DataFrame:
    """(key, value) of each key whose newest entry is no tombstone."""
    return latest(log, order=order).where(~F.col("is_tombstone")).select("key", "value")


def cost(tombstone: str | Column = "is_tombstone") -> Column:
    return F.when(F.col(tombstone) if isinstance(tombstone, str) else tombstone, F.lit(DELETE_COST)).otherwise(F.lit(PUT_COST)).cast("long")


class KVFrame:
    """A lazily built mutation log: every read is a query. Later writes get higher numbers.

    Single writes are gathered, GROUP_COMMIT of them to one part of the log, so its plan doesn't grow with each of them.
    """

    def __init__(self, log: DataFrame, next_seq: int | None = None, gathered: tuple[tuple, ...] = ()):
        missing = {"seq", "key", "value", "is_tombstone"} - set(log.columns)
        if missing:
            raise InvalidDataError(f"columns missing: {sorted(missing)}")
        kind = log.schema["key"].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType, T.MapType)):
            raise InvalidDataError("keys need a total order and equality; floating point and map keys have none")
        self.base = log.select("seq", "key", "value", "is_tombstone")
        self.gathered = gathered
        self.next_seq = next_seq

    @property
    def log(self) -> DataFrame:
        return self.base.unionByName(self._frame(self.gathered)) if self.gathered else self.base

    def _frame(self, rows: tuple[tuple, ...]) -> DataFrame:
        return self.base.sparkSession.createDataFrame(list(rows), T.StructType([T.StructField(f.name, f.dataType) for f in self.base.schema]))

    @classmethod
    def empty(cls, spark, key: str = "string", value: str = "string") -> KVFrame:
        return cls(spark.createDataFrame([], f"seq long, key {key}, value {value}, is_tombstone boolean"), 0)

    def _next(self) -> int:
        if self.next_seq is None:
            last = self.log.agg(F.max("seq")).first()[0]
            self.next_seq = 0 if last is None else last + 1
        return self.next_seq

    def write_batch(self, operations: list[tuple]) -> KVFrame:
        """Operations ("put", key, value) or ("delete", key), in order; an empty batch changes nothing."""
        if not operations:
            return self
        at = self._next()
        rows = (*self.gathered, *((at + i, o[1], o[2] if o[0] == "put" else None, o[0] != "put") for i, o in enumerate(operations)))
        if len(rows) >= GROUP_COMMIT:
            return KVFrame(self.base.unionByName(self._frame(rows)), at + len(operations))
        return KVFrame(self.base, at + len(operations), rows)

    def put(self, key, value) -> KVFrame:
        return self.write_batch([("put", key, value)])

    def delete(self, key) -> KVFrame:
        return self.write_batch([("delete", key)])

    def write_frame(self, batch: DataFrame, index: str = "op_index") -> KVFrame:
        """A batch as a DataFrame (op_index, key, value, is_tombstone) of any size."""
        at, n = self._next(), batch.agg(F.max(index)).first()[0]
        rows = batch.select((F.col(index) + F.lit(at)).cast("long").alias("seq"), "key", "value", "is_tombstone")
        return self if n is None else KVFrame(self.log.unionByName(rows), at + n + 1)

    def latest(self) -> DataFrame:
        return latest(self.log)

    def live(self) -> DataFrame:
        return live(self.log)

    def get_entry(self, key) -> tuple | None:
        """(value, is_tombstone), or None for a key never written."""
        row = latest(self.log.where(F.col("key") == F.lit(key))).first()
        return None if row is None else (row.value, row.is_tombstone)

    def get(self, key):
        entry = self.get_entry(key)
        return None if entry is None or entry[1] else entry[0]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return multi_get(keys, self.live())

    def scan(self) -> DataFrame:
        """All newest entries in key order, tombstones included."""
        return self.latest().orderBy("key")

    def range(self, least, most) -> DataFrame:
        return live(self.log.where(F.col("key").between(least, most))).orderBy("key")

    def len(self) -> int:
        return self.live().count()

    def clear(self) -> KVFrame:
        return KVFrame(self.log.limit(0), 0)


def point_get(log: DataFrame, key) -> DataFrame:
    """One row (key, value, found), also for a key that is deleted or was never written.

    The key's predicate goes below the aggregation, into the scan.
    """
    newest = F.max_by(F.struct("value", "is_tombstone"), "seq").alias("e")
    found = F.coalesce(~F.col("e.is_tombstone"), F.lit(False))
    return log.where(F.col("key") == F.lit(key)).agg(newest).select(F.lit(key).alias("key"), F.when(found, F.col("e.value")).alias("value"), found.alias("found"))


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """(key, value, found) for every probe; the planner broadcasts the state only where its size allows."""
    hit = state.select("key", "value", F.lit(True).alias("hit"))
    return keys.select("key").join(hit, "key", "left").select("key", "value", F.coalesce("hit", F.lit(False)).alias("found"))


def accuracy(probes: DataFrame, state: DataFrame) -> DataFrame:
    """From probes (key, expected): how many there are, how many were answered as expected, and the percentage (0 of none)."""
    hit = state.select("key", F.lit(True).alias("hit"))
    right = F.when(F.col("expected") == F.coalesce("hit", F.lit(False)), 1).otherwise(0)
    checked = probes.join(hit, "key", "left")
    return checked.agg(F.count("*").alias("n"), F.coalesce(F.sum(right), F.lit(0)).cast("long").alias("n_right"), F.coalesce(F.avg(right.cast("double")) * 100, F.lit(0.0)).alias("accuracy"))


def replayed(batches: DataFrame) -> DataFrame:
    """Newest entries of a log of batches: the last batch decides, and within it the last operation."""
    return latest(batches, order=F.struct("batch_id", "op_index"))


def batch_counts(batches: DataFrame) -> DataFrame:
    """Operations (not keys) of each batch, and their shallow size."""
    size = F.sum(cost()).cast("long").alias("bytes")
    return batches.groupBy("batch_id").agg(F.count("*").alias("n_ops"), F.sum(F.col("is_tombstone").cast("long")).alias("n_deletes"), size)


def group_commits(position: Column, group: int = GROUP_COMMIT) -> Column:
    """The number of the commit that writes a 0-based position of a full queue."""
    return F.floor(position / F.lit(group)).cast("long")
