"""A durable key-value store over Parquet: logs, key-sorted runs and a catalog, in any file system that Spark reads.

    <path>/wal/000007.wal/        batches of mutations with checksums, appended
    <path>/runs/L0-<id>.sst/      a run: newest entries, sorted by key, with row-group statistics and a bloom filter
    <path>/MANIFEST/              the catalog: add, remove and next_id rows, appended

Every mutation has a number that grows across logs, kept in the runs, so recency never depends on places. A batch is one
Spark write and becomes visible whole. What the catalog doesn't name is ignored. Log records and catalog rows carry
checksums; runs carry those of their Parquet pages, checked when a page is read, and the catalog knows how many entries
each has and between which keys they lie, so a get leaves out the runs that can't hold its key.
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.errors import CorruptionError, InvalidDataError
from tidelog.operators import catalog, runs, state

#: `entries` and `ends` (first and last key, as JSON; null for keys that aren't strings or whole numbers) describe an added run.
CATALOG = "seq long, action string, level int, path string, next_id long, entries long, ends string, crc long"
#: Options of reads that check the pages' checksums.
CHECKED = {"parquet.page.verify-checksum.enabled": "true"}


@dataclass(frozen=True, order=True)
class Run:
    level: int
    id: int

    @property
    def path(self) -> str:
        return f"L{self.level}-{self.id:020}.sst"


class Files:
    """What the store needs of a file system, by the names that Spark itself resolves."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.fs.exists(self._path(path)) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength() if self.fs.exists(self._path(path)) else 0


def checksum(schema: T.StructType) -> Column:
    """Of a mutation's key, value and kind, by their text; a null value has a text of its own."""

    def text(c: str) -> Column:
        nested = isinstance(schema[c].dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.coalesce(F.to_json(c) if nested else F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))

    return F.crc32(F.concat_ws("\0", text("key"), text("value"), F.col("is_tombstone").cast("string")).cast("binary"))


def catalog_checksum() -> Column:
    """Of a catalog row, by the text of its columns; a null one has a text of its own."""
    names = [f.split()[0] for f in CATALOG.split(", ")][:-1]
    return F.crc32(F.concat_ws("\0", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in names)).cast("binary"))


class Store:
    def __init__(self, spark: SparkSession, path: str, limit: int, key: str, value: str):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), limit
        self.schema = T._parse_datatype_string(f"seq long, key {key}, value {value}, is_tombstone boolean")
        if isinstance(self.schema["key"].dataType, (T.FloatType, T.DoubleType, T.MapType)):
            raise InvalidDataError("keys need a total order and equality; floating point and map keys have none")
        self.files = Files(spark, self.path)
        self.logged = T.StructType([*self.schema.fields, T.StructField("crc", T.LongType())])
        self.log_id = self.next_seq = self.next_id = self.events = self.buffered = 0
        self.runs: list[Run] = []
        self.ends: dict[Run, tuple] = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, limit: int = 4 << 20, key: str = "string", value: str = "string") -> Store:
        """The store at a path, new or recovered. It stops at a log record or a catalog row that fails its checksum, and at
        a run that is missing, can't be read or has not as many entries as the catalog says. Recovered entries don't count
        towards the limit."""
        self = cls(spark, path, limit, key, value)
        manifest = self.manifest()
        wrong = F.col("crc").isNull() | (F.col("crc") != catalog_checksum())
        try:
            self.events, damaged = manifest.agg(F.count("*"), F.coalesce(F.sum(wrong.cast("int")), F.lit(0))).first()
        except (PySparkException, Py4JJavaError) as e:
            raise CorruptionError("the catalog can't be read") from e
        if damaged:
            raise CorruptionError("a catalog row doesn't match its checksum")
        self.next_id = catalog.next_id(manifest).first().next_id
        added = {Run(r.level, int(r.path.split("-")[1][:20])): r for r in catalog.active_runs(manifest, "entries", "ends").collect()}
        missing = {r.path for r in added} - set(self.files.names(f"{self.path}/runs"))
        if missing:
            raise CorruptionError(f"the catalog names runs that aren't there: {sorted(missing)}")
        self.runs = sorted(added)
        self._validate(added)
        self.next_id = max([self.next_id, *(r.id + 1 for r in self.runs)])
        logs = self.log_ids()
        self.log_id = max(logs, default=0)
        if logs:
            bad = self.log().where(F.col("crc").isNull() | (F.col("crc") != checksum(self.schema))).limit(1).count()
            if bad:
                raise CorruptionError("a log record doesn't match its checksum")
        last = self.entries().agg(F.max("seq")).first()[0]
        self.next_seq = 0 if last is None else last + 1
        return self

    def _validate(self, added: dict[Run, Row]) -> None:
        """Open every run's files: do they hold as many entries as were written?"""
        if not self.runs:
            return
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        try:
            found = {r.run: r.n for r in self._runs(self.runs).groupBy(folder.alias("run")).agg(F.count("*").alias("n")).collect()}
        except (PySparkException, Py4JJavaError) as e:
            raise CorruptionError("a run can't be read") from e
        for run in self.runs:
            row = added[run]
            if row.entries is not None and found.get(run.path, 0) != row.entries:
                raise CorruptionError(f"{run.path} has {found.get(run.path, 0)} entries, not {row.entries}")
            if row.ends:
                self.ends[run] = tuple(json.loads(row.ends))

    # Reading

    def _runs(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.options(**CHECKED).schema(self.schema).parquet(*(f"{self.path}/runs/{r.path}" for r in runs))

    def log_ids(self) -> list[int]:
        found = self.spark.createDataFrame([(n, 0) for n in self.files.names(f"{self.path}/wal")], "name string, length long")
        return sorted(r.wal_id for r in catalog.logs(found).collect())

    def log(self) -> DataFrame:
        paths = [f"{self.path}/wal/{i:06}.wal" for i in self.log_ids()]
        return self.spark.read.schema(self.logged).parquet(*paths) if paths else self.spark.createDataFrame([], self.logged)

    def manifest(self) -> DataFrame:
        if not self.files.names(f"{self.path}/MANIFEST"):
            return self.spark.createDataFrame([], CATALOG)
        return self.spark.read.schema(CATALOG).parquet(f"{self.path}/MANIFEST")

    def run(self, run: Run) -> DataFrame:
        return self._runs([run])

    def entries(self, runs: list[Run] | None = None) -> DataFrame:
        """All entries of logs and runs (all unless named), one or more a key."""
        out, runs = self.log().drop("crc"), self.runs if runs is None else runs
        return out.unionByName(self._runs(runs)) if runs else out

    def holding(self, key) -> list[Run]:
        """The runs whose range holds a key; all whose range isn't known."""
        def may(run: Run) -> bool:
            least, most = self.ends.get(run, (None, None))
            return least is None or type(key) is not type(least) or least <= key <= most

        return [r for r in self.runs if may(r)]

    def latest(self) -> DataFrame:
        return state.latest(self.entries())

    def live(self) -> DataFrame:
        return state.live(self.entries())

    def get_entry(self, key) -> tuple | None:
        return state.KVFrame(self.entries(self.holding(key))).get_entry(key)

    def get(self, key):
        return state.KVFrame(self.entries(self.holding(key))).get(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return state.multi_get(keys, self.live())

    def range(self, least, most) -> DataFrame:
        return state.KVFrame(self.entries()).range(least, most)

    def run_metadata(self) -> DataFrame:
        """(level, sstable_id, min_key, max_key, num_entries, num_live, filter_type) of every run."""
        out = None
        for r in self.runs:
            m = self.run(r).select(F.lit(r.level).alias("level"), F.lit(r.id).cast("long").alias("sstable_id"), "key", "is_tombstone")
            out = m if out is None else out.unionByName(m)
        if out is None:
            out = self.log().limit(0).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("sstable_id"), "key", "is_tombstone")
        meta = runs.metadata(out.withColumn("r", F.struct("level", "sstable_id")), "r")
        return meta.select("r.level", "r.sstable_id", "min_key", "max_key", "num_entries", "num_live", runs.filter_type(F.col("r.level")).alias("filter_type"))

    def run_files(self) -> list[tuple[Run, str, int]]:
        """(run, path, bytes) of every run."""
        return [(r, f"{self.path}/runs/{r.path}", self.files.size(f"{self.path}/runs/{r.path}")) for r in self.runs]

    def disk_usage(self) -> int:
        return self.files.size(self.path)

    def total_run_count(self) -> int:
        return len(self.runs)

    def compaction_backlog(self) -> int:
        """Runs in levels that are due to be merged."""
        return sum(len(of) for of in map(self._level, self._levels()) if len(of) >= runs.FANOUT)

    def _levels(self) -> list[int]:
        return sorted({r.level for r in self.runs})

    def _level(self, level: int) -> list[Run]:
        return [r for r in self.runs if r.level == level]

    # Writing

    def write_frame(self, batch: DataFrame, index: str = "op_index") -> None:
        """A batch (op_index from 0, key, value, is_tombstone) in one commit; an empty one changes no state."""
        rows = batch.select((F.col(index) + F.lit(self.next_seq)).cast("long").alias("seq"), "key", F.when(~F.col("is_tombstone"), F.col("value")).alias("value"), "is_tombstone")
        seen = Observation()  # counted while it is written
        counted = rows.observe(seen, F.count("*").alias("n"), F.max("seq").alias("last"), F.sum(state.cost()).alias("bytes"))
        counted.withColumn("crc", checksum(self.schema)).write.mode("append").parquet(f"{self.path}/wal/{self.log_id:06}.wal")
        if not seen.get["n"]:
            return
        self.next_seq, self.buffered = seen.get["last"] + 1, self.buffered + seen.get["bytes"]
        if self.buffered >= self.limit:
            self.flush()

    def write_batch(self, operations: list[tuple]) -> None:
        """Operations ("put", key, value) or ("delete", key), in order."""
        if operations:
            rows = [(i, o[1], o[2] if o[0] == "put" else None, o[0] != "put") for i, o in enumerate(operations)]
            kinds = [T.StructField("op_index", T.LongType()), *self.schema.fields[1:]]
            self.write_frame(self.spark.createDataFrame(rows, T.StructType(kinds)).coalesce(1))

    def put(self, key, value) -> None:
        self.write_batch([("put", key, value)])

    def delete(self, key) -> None:
        self.write_batch([("delete", key)])

    def writer(self) -> Writer:
        return Writer(self)

    def _write_run(self, entries: DataFrame, run: Run) -> None:
        found = entries.agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).first()
        n = found.n
        out = entries.repartitionByRange(max(1, -(-n // 4_000_000)), "key").sortWithinPartitions("key").write.mode("overwrite")
        out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, n)))
        out.parquet(f"{self.path}/runs/{run.path}")
        plain = isinstance(self.schema["key"].dataType, (T.StringType, T.IntegralType))
        self.written = (n, json.dumps([found.least, found.most]) if plain and n else None)
        if plain and n:
            self.ends[run] = (found.least, found.most)

    def _record(self, rows: list[tuple]) -> None:
        """One append of catalog rows (action, level, path, next_id); an added run is the one just written."""
        numbered = [(self.events + i, *r, *(self.written if r[0] == "add" else (None, None)), None) for i, r in enumerate(rows)]
        frame = self.spark.createDataFrame(numbered, CATALOG).withColumn("crc", catalog_checksum())
        frame.coalesce(1).write.mode("append").parquet(f"{self.path}/MANIFEST")
        self.events += len(rows)

    def clear_log(self) -> None:
        """Forget what isn't in a run yet."""
        for i in self.log_ids():
            self.files.delete(f"{self.path}/wal/{i:06}.wal")
        self.buffered = 0

    def clear_catalog(self) -> None:
        """Forget all runs; their files are orphans from then on."""
        self.files.delete(f"{self.path}/MANIFEST")
        self.runs, self.ends, self.events = [], {}, 0

    def flush(self) -> None:
        """The buffer's newest entries become a run of level 0; then the logs that it covers go. Full levels are merged."""
        newest = state.latest(self.log(), extra=("seq",)).select(*self.schema.names)
        if newest.limit(1).count():
            covered, run = self.log_ids(), Run(0, self.next_id)
            self._write_run(newest, run)
            self._record([("add", 0, run.path, None), ("next_id", None, None, run.id + 1)])
            self.next_id, self.runs, self.log_id = run.id + 1, sorted([*self.runs, run]), self.log_id + 1
            for i in covered:
                self.files.delete(f"{self.path}/wal/{i:06}.wal")
        self.buffered = 0
        self.handle_compaction_results()

    def compact(self, level: int) -> Run | None:
        """All runs of a level become one of the next, tombstones kept; the catalog changes in one append."""
        old = self._level(level)
        if not old:
            return None
        parts = self._runs(old)
        run = Run(level + 1, self.next_id)
        self._write_run(state.latest(parts, extra=("seq",)).select(*self.schema.names), run)
        self._record([*(("remove", r.level, r.path, None) for r in old), ("add", run.level, run.path, None), ("next_id", None, None, run.id + 1)])
        self.next_id, self.runs = run.id + 1, sorted([*(r for r in self.runs if r not in old), run])
        for r in old:
            self.files.delete(f"{self.path}/runs/{r.path}")
            self.ends.pop(r, None)
        return run

    def handle_compaction_results(self) -> None:
        """Merge levels of FANOUT runs or more until there is none."""
        while full := [k for k in self._levels() if len(self._level(k)) >= runs.FANOUT]:
            self.compact(full[0])


class Writer:
    """Single writes of any number of threads, committed in groups: GROUP_COMMIT of them, or what there is at flush().

    A group is one Spark write, whole or not at all, in the order in which the writes came. Leaving the context flushes.
    """

    def __init__(self, store: Store):
        self.store, self.pending, self.lock = store, [], threading.Lock()

    def submit(self, *operations: tuple) -> None:
        """Operations ("put", key, value) or ("delete", key); those of one call lie next to each other."""
        with self.lock:
            self.pending.extend(operations)
            if len(self.pending) >= state.GROUP_COMMIT:
                self._commit()

    def put(self, key, value) -> None:
        self.submit(("put", key, value))

    def delete(self, key) -> None:
        self.submit(("delete", key))

    def _commit(self) -> None:
        group, self.pending = self.pending, []
        self.store.write_batch(group)

    def flush(self) -> None:
        with self.lock:
            self._commit()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.flush()
