"""The live state of an unbounded mutation log.

Three forms, all deciding by the greatest seq, so replays and late files change nothing: an aggregation in complete or
update mode; a state per key, tombstones included; and micro-batches merged into versioned snapshots. State must not
expire: a mutation may come at any time, and a forgotten tombstone would let an older put come back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.errors import InvalidDataError
from tidelog.operators.state import latest
from tidelog.sources.shared import scratch
from tidelog.sources.store import Files


def log_stream(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def newest(log: DataFrame) -> DataFrame:
    """The newest entry of each key, for complete or update mode."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "is_tombstone"), "seq").alias("e")).select("key", "e.value", "e.is_tombstone")


def upserted(log: DataFrame) -> DataFrame:
    """(key, seq, value, is_tombstone) of keys whose newest entry changed, for update mode; state is kept per key."""
    key, value = log.schema["key"].dataType, log.schema["value"].dataType
    out = T.StructType([T.StructField("key", key), T.StructField("seq", T.LongType()), T.StructField("value", value), T.StructField("is_tombstone", T.BooleanType())])
    kept = T.StructType(out.fields[1:])

    def upsert(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None
        best = old
        for rows in parts:
            if len(rows):
                r = rows.loc[rows["seq"].idxmax()]
                if best is None or r["seq"] > best[0]:
                    best = (int(r["seq"]), None if r["is_tombstone"] else r["value"], bool(r["is_tombstone"]))
        if best is not None and best != old:
            state.update(best)
            yield pd.DataFrame([(k[0], *best)], columns=out.names)

    return log.groupBy("key").applyInPandasWithState(upsert, out, kept, "update", GroupStateTimeout.NoTimeout)


class Snapshots:
    """A merged state in versioned folders: d<n>, the newest entries of batch n alone, and b<n>, those of all up to n.

    A batch costs what it holds; every MERGED batches, what lies since the last whole state is merged with it into a new
    one. What is there decides, not what this object remembers, so a new one over the same folder goes on where the last
    ended. A folder counts once it is written whole. All since the whole state before the last one stays, for readers and
    for a batch that is run again.
    """

    MERGED = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)

    def _there(self, kind: str) -> list[int]:
        """The numbers of the whole folders of a kind, oldest first."""
        found = [int(n[1:]) for n in self.files.names(self.path) if n[0] == kind and n[1:].isdigit()]
        return sorted(v for v in found if self.files.exists(f"{self.path}/{kind}{v}/_SUCCESS"))

    @property
    def version(self) -> int | None:
        """The last batch that was merged."""
        return max([*self._there("d"), *self._there("b")], default=None)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Idempotent: a batch that is run again writes its folders anew."""
        rows = batch.select("seq", "key", "value", "is_tombstone")
        latest(rows, extra=("seq",)).select(*rows.columns).write.mode("overwrite").parquet(f"{self.path}/d{batch_id}")
        if (batch_id + 1) % self.MERGED == 0:
            before = [v for v in self._there("b") if v < batch_id]
            self.entries(batch_id, rows.schema, before).write.mode("overwrite").parquet(f"{self.path}/b{batch_id}")
            for kind in "bd":
                for v in self._there(kind):
                    if before and (v < before[-1] or kind == "d" and v == before[-1]):
                        self.files.delete(f"{self.path}/{kind}{v}")

    def entries(self, version: int | None = None, schema: T.StructType | None = None, whole: list[int] | None = None) -> DataFrame:
        """Newest entries (seq, key, value, is_tombstone), tombstones included, as of the newest version unless another is named."""
        version = self.version if version is None else version
        if version is None:
            raise InvalidDataError("no batch has been merged yet")
        base = max((v for v in (self._there("b") if whole is None else whole) if v <= version), default=-1)
        paths = [f"{self.path}/b{base}"] * (base >= 0) + [f"{self.path}/d{v}" for v in self._there("d") if base < v <= version]
        rows = (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(*paths)
        return latest(rows, extra=("seq",)).select("seq", "key", "value", "is_tombstone")

    def live(self) -> DataFrame:
        return self.entries().where(~F.col("is_tombstone")).select("key", "value")


def drained(log: DataFrame, snapshots: Snapshots, checkpoint: str) -> Snapshots:
    """Merge all that is there now, batch by batch."""
    log.writeStream.foreachBatch(snapshots.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return snapshots


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    dead = F.coalesce(F.col("event_type") == "error", F.lit(False))
    return rows.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(~dead, F.col("props")).alias("value"), dead.alias("is_tombstone"))


def live_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log's live state through a stream of what is there now."""
    top = scratch(spark, f"stream-{uuid.uuid4().hex}")
    return drained(events_stream(spark, sf_dir), Snapshots(spark, f"{top}/state"), f"{top}/checkpoint").live()


def written(changes: DataFrame, mode: str) -> DataFrame:
    """What a stream's batches give once all that is there now has gone through: rows (batch_id, ...), from Parquet."""
    spark = changes.sparkSession
    top = scratch(spark, f"stream-{uuid.uuid4().hex}")

    def kept(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{top}/out/batch={batch_id}")

    changes.writeStream.outputMode(mode).foreachBatch(kept).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*changes.schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{top}/out")
