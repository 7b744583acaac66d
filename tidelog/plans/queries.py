"""Registered queries: every operator over the driver's tables, with its SQL for the oracle in `oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import formats, frames, generators, measure
from tidelog.operators import catalog, layout, lookup, merge, runs, state
from tidelog.plans.oracle import ORACLE_SQL
from tidelog.plans.tables import events_log, names, orders_log, table, urls
from tidelog.sources.shared import cut, scratch
from tidelog.sources.store import Store
from tidelog.streaming import live as streams

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Bytes at which the queries' write buffer is flushed.
LIMIT = 8192
#: Numbers of the catalog log that a flush and its merges take at most.
A_FLUSH = 8 * runs.LEVELS


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# State


@query
def live_state(spark, sf_dir):
    return state.live(events_log(spark, sf_dir))


@query
def live_state_orders(spark, sf_dir):
    return state.live(orders_log(spark, sf_dir))


@query
def latest_entry_with_tombstones(spark, sf_dir):
    return state.latest(events_log(spark, sf_dir))


@query
def live_count_vs_entry_count(spark, sf_dir):
    entries = state.latest(events_log(spark, sf_dir))
    return entries.agg(F.count("*").alias("n_entries"), F.sum((~F.col("is_tombstone")).cast("long")).alias("n_live"))


@query
def point_get_hit(spark, sf_dir):
    return state.point_get(events_log(spark, sf_dir), 7)


@query
def point_get_all_keys(spark, sf_dir):
    """Every user's get, deleted ones included: value and whether it is found."""
    log = events_log(spark, sf_dir)
    return state.multi_get(log.select("key").distinct(), state.live(log))


@query
def point_get_missing(spark, sf_dir):
    return state.point_get(events_log(spark, sf_dir), -1)


@query
def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return state.multi_get(keys, state.live(orders_log(spark, sf_dir)))


@query
def membership_accuracy(spark, sf_dir):
    """Users below twice the largest id, half of them never written; expected present where any event isn't an error."""
    log = events_log(spark, sf_dir)
    last = log.agg(F.coalesce(F.max("key"), F.lit(0))).first()[0]
    probes = spark.range(2 * last + 1).withColumnRenamed("id", "key")
    written = log.groupBy("key").agg(F.max((~F.col("is_tombstone")).cast("int")).alias("put"))
    return state.accuracy(probes.join(written, "key", "left").select("key", (F.coalesce("put", F.lit(0)) == 1).alias("expected")), state.live(log))


@query
def range_scan(spark, sf_dir):
    return state.KVFrame(events_log(spark, sf_dir)).range(3, 40)


# Batches and the write buffer


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_log(spark, sf_dir).select(F.floor(F.col("seq") / 100).alias("batch_id"), (F.col("seq") % 100).cast("int").alias("op_index"), "key", "value", "is_tombstone")


@query
def batch_replay(spark, sf_dir):
    return state.replayed(batches(spark, sf_dir)).where(~F.col("is_tombstone")).select("key", "value")


@query
def batch_op_counts(spark, sf_dir):
    return state.batch_counts(batches(spark, sf_dir)).select("batch_id", "n_ops", "n_deletes")


@query
def batch_size_accounting(spark, sf_dir):
    return state.batch_counts(batches(spark, sf_dir)).select("batch_id", "bytes")


@query
def group_commit_batches(spark, sf_dir):
    commit = state.group_commits(F.col("seq")).alias("commit_no")
    return events_log(spark, sf_dir).groupBy(commit).agg(F.count("*").alias("n_writes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.generations(events_log(spark, sf_dir), LIMIT)


@query
def memtable_generations(spark, sf_dir):
    return numbered(spark, sf_dir).groupBy("gen").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_ops"), F.sum(state.cost()).alias("bytes"))


@query
def generations_put_only(spark, sf_dir):
    """Customers as puts in order of their key, which is dense from 0 or 1: generations by the closed form."""
    rows = table(spark, sf_dir, "customer")
    first = rows.agg(F.min("c_custkey").alias("least"))
    gen = runs.put_only_generation(F.col("c_custkey") - F.col("least"), LIMIT)
    return rows.join(F.broadcast(first)).groupBy(gen.alias("gen")).agg(F.count("*").alias("n_puts"), F.min("c_name").alias("min_key"), F.max("c_name").alias("max_key"))  # one row is broadcast


@query
def memtable_contents(spark, sf_dir):
    """The write buffer that is still open: newest entries, tombstones included, and whether each counts as live."""
    rows = numbered(spark, sf_dir)
    shut = runs.full(rows, LIMIT).select("gen").distinct()
    return state.latest(rows.join(shut, "gen", "left_anti")).select("key", "value", "is_tombstone")


# Runs and levels


def flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flushed(runs.full(numbered(spark, sf_dir), LIMIT))


def flushed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flushes(spark, sf_dir).withColumnRenamed("gen", "sstable_id")


def n_flushes(entries: DataFrame, by: str = "gen") -> DataFrame:
    return entries.agg((F.max(by) + 1).alias("flushes"))


@query
def flush_runs(spark, sf_dir):
    return flushes(spark, sf_dir)


@query
def run_metadata(spark, sf_dir):
    return runs.metadata(flushes(spark, sf_dir))


def flushed_gens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gen) of every flush, from a checkpoint: the catalog's queries look at it several times."""
    return cut(flushes(spark, sf_dir).select("gen").distinct())


def placed(rows: DataFrame) -> DataFrame:
    """(gen, level, run_no) of every flush (gen), once all full levels are merged."""
    level = runs.level_of(F.col("gen"), F.col("flushes"))
    return rows.join(F.broadcast(n_flushes(rows))).withColumn("level", level).withColumn("run_no", runs.run_of(F.col("gen"), F.col("level")))  # one row is broadcast


@query
def level_placement(spark, sf_dir):
    return placed(flushed_gens(spark, sf_dir)).select("gen", "level", "run_no")


@query
def level_file_counts(spark, sf_dir):
    return placed(flushed_gens(spark, sf_dir)).groupBy("level").agg(F.countDistinct("run_no").alias("n_runs"))


@query
def total_run_count(spark, sf_dir):
    return placed(flushed_gens(spark, sf_dir)).agg(F.countDistinct("level", "run_no").alias("n_runs"))


@query
def compaction_backlog(spark, sf_dir):
    """Runs in flight if every level of two runs or more were being merged."""
    counts = level_file_counts(spark, sf_dir)
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n_runs") >= 2, F.col("n_runs"))), F.lit(0)).cast("long").alias("backlog"))


@query
def filter_tier(spark, sf_dir):
    return placed(flushed_gens(spark, sf_dir)).select("gen", "level", runs.filter_type(F.col("level")).alias("filter_type"))


@query
def flush_ids(spark, sf_dir):
    rows = flushes(spark, sf_dir).select("gen").distinct()
    return rows.select("gen", runs.flush_id(F.col("gen")).alias("sstable_id"))


@query
def run_file_names(spark, sf_dir):
    rows = flushes(spark, sf_dir).select("gen").distinct()
    return rows.select("gen", formats.run_name(F.lit(0), runs.flush_id(F.col("gen"))).alias("run_file"), formats.log_name(F.col("gen")).alias("log_file"))


# Merging


@query
def merge_order(spark, sf_dir):
    return merge.merge_order(flushed_runs(spark, sf_dir).select("sstable_id", "key", "is_tombstone")).select("pop_no", "key", "sstable_id", "is_tombstone")


@query
def kway_merge(spark, sf_dir):
    return merge.kway_merge(flushed_runs(spark, sf_dir))


@query
def level_compaction(spark, sf_dir):
    """The entries of every run after all merges: in each, the newest generation's; tombstones stay."""
    rows = flushes(spark, sf_dir)
    rows = rows.join(placed(rows.select("gen").distinct()), "gen")
    return state.latest(rows, "level", "run_no", order="gen")


@query
def compaction_preserves_live(spark, sf_dir):
    """Differences between the live state of the log and that of its merged runs and open buffer: none."""
    rows = numbered(spark, sf_dir)
    shut = runs.full(rows, LIMIT)
    merged = merge.compacted(runs.flushed(shut).withColumnRenamed("gen", "sstable_id")).withColumn("layer", F.lit(1))
    rest = state.latest(rows.join(shut.select("gen").distinct(), "gen", "left_anti")).withColumn("layer", F.lit(0))
    after = lookup.layered(rest.unionByName(merged)).where("found").select("key", "value")
    return merge.differences(state.live(events_log(spark, sf_dir)), after)


@query
def run_set_difference(spark, sf_dir):
    """Runs that stay when those of the lowest level are replaced."""
    at = placed(flushed_gens(spark, sf_dir)).select("level", "run_no").distinct()
    return at.join(at.where("level = 0"), ["level", "run_no"], "left_anti")


# The read path


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as layers: the last tenth in the buffer, the tenth before it frozen, the rest in four runs."""
    log = events_log(spark, sf_dir)
    n = log.agg((F.max("seq") + 1).alias("n"))
    slot = F.floor(F.col("seq") * 10 / F.col("n"))
    layer = F.when(slot == 9, 0).when(slot == 8, 1).otherwise(F.lit(5) - F.floor(slot / 2)).cast("int")
    return state.latest(log.join(F.broadcast(n)).withColumn("layer", layer), "layer")  # one row is broadcast


@query
def layered_lookup(spark, sf_dir):
    return lookup.layered(layers(spark, sf_dir))


@query
def runs_probed_per_get(spark, sf_dir):
    entries = flushed_runs(spark, sf_dir)
    probes = table(spark, sf_dir, "events").select(F.explode(F.array(F.col("user_id"), F.col("user_id") + 1000)).alias("key")).distinct()
    return lookup.runs_probed(probes, runs.metadata(entries, "sstable_id"), entries)


@query
def filter_membership(spark, sf_dir):
    """A filter of the customers with orders, asked for all customers: none that is there is missed."""
    keys = orders_log(spark, sf_dir).select("key").distinct()
    n = keys.count()
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    got = lookup.maybe_contains(asked, lookup.filter_of(keys, n), n).join(keys.withColumn("there", F.lit(True)), "key", "left")
    there = F.coalesce("there", F.lit(False))
    return got.agg(F.sum(there.cast("long")).alias("n_there"), F.sum((there & ~F.col("maybe")).cast("long")).alias("n_missed"))


@query
def run_scan(spark, sf_dir):
    """The event log as one merged run, scanned in key order, tombstones included."""
    run = state.latest(events_log(spark, sf_dir)).withColumn("sstable_id", F.lit(0).cast("long"))
    return layout.numbered(run).select("pos", "key", "value", "is_tombstone")


@query
def run_overlap_pairs(spark, sf_dir):
    meta = runs.metadata(order_runs(spark, sf_dir), "sstable_id")
    return lookup.overlapping(meta.where("sstable_id % 2 = 0"), meta.where("sstable_id % 2 = 1"))


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty runs of customers by key range, some ranges meeting."""
    rows = state.latest(orders_log(spark, sf_dir))
    n = rows.agg((F.max("key") + 1).alias("n"))
    cell = F.floor(F.col("key") * 10 / F.col("n"))
    both = F.explode(F.array(cell * 2, F.when(F.col("key") % 3 == 0, F.least(cell + 1, F.lit(9)) * 2 + 1).otherwise(cell * 2 + 1)))
    return rows.join(F.broadcast(n)).select(both.alias("sstable_id"), "key", "value", "is_tombstone")  # one row is broadcast


@query
def hull_overlap(spark, sf_dir):
    meta = runs.metadata(order_runs(spark, sf_dir), "sstable_id")
    return lookup.hull_overlapping(meta.where("sstable_id in (4, 6)"), meta.where("sstable_id % 2 = 1")).select("sstable_id", "min_key", "max_key")


@query
def sparse_index(spark, sf_dir):
    return layout.restart_points(urls(spark, sf_dir)).select("block_no", "first_key")


@query
def index_floor_lookup(spark, sf_dir):
    rows = urls(spark, sf_dir)
    return lookup.floor_lookup(rows.select("sstable_id", "key"), layout.restart_points(rows)).select("key", "first_key", "block_no")


@query
def run_entry_get(spark, sf_dir):
    """Every customer asked of two runs: range, filter, floor of the index, block."""
    entries = order_runs(spark, sf_dir)
    k = F.col("c_custkey")
    probes = table(spark, sf_dir, "customer").select(F.explode(F.array((k % 20).cast("long"), (k * 7 % 20).cast("long"))).alias("sstable_id"), k.alias("key"))
    held = layout.numbered(entries).withColumn("block_no", F.floor(F.col("pos") / layout.RESTART_INTERVAL).cast("long"))
    got = lookup.run_get(probes, entries, layout.restart_points(entries), held)
    return got.select("sstable_id", "key", "in_range", F.coalesce("block_no", F.lit(-1)).alias("block_no"), "value", "found")


@query
def read_order(spark, sf_dir):
    """The runs in the order that a read asks them: level by level, the newest of a level first."""
    at = placed(flushed_gens(spark, sf_dir)).select("level", "run_no").distinct()
    place = F.row_number().over(Window.orderBy("level", F.desc("run_no")))  # three runs a level at most
    return at.select((place - 1).cast("long").alias("place"), "level", "run_no")


@query
def bounded_cache_trace(spark, sf_dir):
    """The accesses of block_cache_trace with room for eight blocks in four shards."""
    rows = table(spark, sf_dir, "events")
    accesses = rows.select(F.col("event_id").alias("access_no"), (F.col("user_id") % 2).alias("sstable_id"), (F.floor(F.col("user_id") / 10) * 4096).alias("offset"))
    return lookup.bounded_cache_trace(accesses, 8, 4)


@query
def block_cache_trace(spark, sf_dir):
    """A user's event reads the block of the user's ten neighbours in run 0 or 1."""
    rows = table(spark, sf_dir, "events")
    return lookup.cache_trace(rows.select(F.col("event_id").alias("access_no"), (F.col("user_id") % 2).alias("sstable_id"), (F.floor(F.col("user_id") / 10) * 4096).alias("offset")))


# Layout


@query
def restart_points(spark, sf_dir):
    return layout.numbered(names(spark, sf_dir)).select("key", "pos", (F.col("pos") % layout.RESTART_INTERVAL == 0).alias("is_restart"))


@query
def shared_prefix_len(spark, sf_dir):
    shared = layout.shared_prefix(F.col("key"), F.col("before"))
    return layout.numbered(urls(spark, sf_dir)).select("key", F.when(F.col("pos") % layout.RESTART_INTERVAL == 0, 0).otherwise(shared).cast("long").alias("shared"))


@query
def prefix_roundtrip(spark, sf_dir):
    """Keys cut to their suffixes and rebuilt: how many, and how many differ."""
    rows = layout.numbered(names(spark, sf_dir))
    shared = F.when(F.col("pos") % layout.RESTART_INTERVAL == 0, 0).otherwise(layout.common_prefix(F.col("key"), F.col("before")))
    cut = rows.select("sstable_id", "pos", "key", shared.alias("shared"))
    suffixes = cut.select("sstable_id", "pos", "shared", F.substring(F.col("key"), F.col("shared").cast("int") + 1, F.length("key")).alias("suffix"))
    back = layout.rebuilt(suffixes).withColumnRenamed("key", "again")
    return cut.join(back, ["sstable_id", "pos"]).agg(F.count("*").alias("n_keys"), F.sum((F.col("key") != F.col("again")).cast("long")).alias("n_differ"))


@query
def block_packing(spark, sf_dir):
    return layout.blocks(names(spark, sf_dir)).select("block_no", "first_key", "num_entries", "data_bytes", "restarts")


@query
def block_offsets(spark, sf_dir):
    return layout.offsets(layout.blocks(names(spark, sf_dir))).select("block_no", "offset", layout.frame_bytes().alias("bytes"))


@query
def block_index(spark, sf_dir):
    """A run's sparse index: the first key of every block and where the block begins."""
    return layout.offsets(layout.blocks(names(spark, sf_dir))).select("first_key", "offset")


@query
def block_scan(spark, sf_dir):
    """Every block of two runs packed to bytes and read back: entries, and how many differ from what was packed."""
    rows = names(spark, sf_dir).unionByName(urls(spark, sf_dir).withColumn("sstable_id", F.lit(1).cast("long")))
    placed_ = cut(layout.in_blocks(rows, layout.blocks(rows)))
    back = layout.decoded(layout.held(placed_)).withColumnsRenamed({"key": "k", "value": "v", "is_tombstone": "d"})
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("value").eqNullSafe(F.col("v")) & F.col("is_tombstone").eqNullSafe(F.col("d"))
    got = back.join(placed_.withColumn("packed", F.lit(True)), ["sstable_id", "block_no", "place"], "left")
    differs = ~(F.coalesce("packed", F.lit(False)) & same)
    return got.groupBy("sstable_id", "block_no").agg(F.count("*").alias("num_entries"), F.sum(differs.cast("long")).alias("n_differ"))


@query
def encoded_sizes(spark, sf_dir):
    key, value, dead = F.col("key").cast("string"), F.col("value"), F.col("is_tombstone")
    return events_log(spark, sf_dir).select("seq", layout.key_size(key).alias("key_bytes"), layout.value_size(value, dead).alias("value_bytes"), layout.log_size(key, value, dead).alias("log_bytes"))


@query
def run_file_sizes(spark, sf_dir):
    """Two runs as files of level 0 and 1: path, blocks, filter, index, metadata, and the whole file with its footer."""
    rows = names(spark, sf_dir).unionByName(urls(spark, sf_dir).withColumn("sstable_id", F.lit(1).cast("long")))
    level = F.col("sstable_id").cast("int")
    sizes = layout.file_sizes(rows, layout.blocks(rows), level)
    return sizes.select("sstable_id", formats.run_name(level, F.col("sstable_id")).alias("path"), "block_bytes", "filter_bytes", "index_bytes", "meta_bytes", "file_size")


@query
def space_amplification(spark, sf_dir):
    """Bytes of each table's run as a file over its raw bytes."""
    rows = names(spark, sf_dir).unionByName(urls(spark, sf_dir).withColumn("sstable_id", F.lit(1).cast("long")))
    raw = rows.groupBy("sstable_id").agg(F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("raw_bytes"))
    sized = layout.file_sizes(rows, layout.blocks(rows)).join(raw, "sstable_id")
    run = F.when(F.col("sstable_id") == 0, "names").otherwise("urls").alias("run")
    ratio = layout.amplification(F.col("disk_bytes"), F.col("raw_bytes"))
    return sized.select(run, F.col("file_size").alias("disk_bytes"), "raw_bytes").withColumn("ratio", ratio).withColumn("tier", layout.tier(F.col("ratio")))


# Catalog and recovery


def manifest(rows: DataFrame) -> DataFrame:
    """The catalog log that flushes (gen) and their merges leave behind."""
    levels = F.expr(f"filter(sequence(0, {runs.LEVELS - 1}), k -> (gen + 1) % shiftleft(1L, 2 * k) = 0)")  # 4**k flushes make a run of level k
    made = rows.select("gen", F.explode(levels).alias("level")).withColumn("run_no", F.expr("shiftright(gen, 2 * level)"))
    own = made.select("gen", "level", "run_no", F.lit("add").alias("action"), (2 * F.col("level")).alias("step"))
    parts = F.explode(F.sequence(F.col("run_no") * runs.FANOUT, F.col("run_no") * runs.FANOUT + runs.FANOUT - 1)).alias("run_no")
    old = made.where("level > 0").select("gen", (F.col("level") - 1).alias("level"), parts, F.lit("remove").alias("action"), (2 * F.col("level") - 1).alias("step"))
    log = own.unionByName(old)
    seq = (F.col("gen") * A_FLUSH + F.col("step") * 4).cast("long")
    added = log.select(seq.alias("seq"), "action", "level", formats.run_name(F.col("level"), F.col("run_no")).alias("path"), F.lit(None).cast("long").alias("next_id"))
    ids = rows.select((F.col("gen") * A_FLUSH + 1).alias("seq"), F.lit("next_id").alias("action"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("path"), (runs.flush_id(F.col("gen")) + 1).alias("next_id"))
    return added.unionByName(ids)


@query
def manifest_active_runs(spark, sf_dir):
    return catalog.active_runs(manifest(flushed_gens(spark, sf_dir)))


@query
def manifest_next_id(spark, sf_dir):
    return catalog.next_id(manifest(flushed_gens(spark, sf_dir)))


def listing(gens: DataFrame) -> DataFrame:
    """A directory: a level-0 file for every flush (gen), merged or not, the merged runs, and logs among other files."""
    files = gens.select(formats.run_name(F.lit(0), F.col("gen")).alias("name"), (F.col("gen") + 1000).alias("length"))
    merged = placed(gens).where("level > 0").select("level", "run_no").distinct()
    files = files.unionByName(merged.select(formats.run_name(F.col("level"), F.col("run_no")).alias("name"), (F.col("run_no") + 2000).alias("length")))
    others = gens.select(F.concat(formats.zero_pad(F.col("gen"), 6), F.when(F.col("gen") % 3 == 0, ".wal").when(F.col("gen") % 3 == 1, ".wal.bak").otherwise("x.wal")).alias("name"), (F.col("gen") * 7).alias("length"))
    return files.unionByName(others)


@query
def orphan_files(spark, sf_dir):
    gens = flushed_gens(spark, sf_dir)
    return catalog.orphans(listing(gens), manifest(gens)).select("name", "length")


@query
def used_files(spark, sf_dir):
    gens = flushed_gens(spark, sf_dir)
    return catalog.used(listing(gens), manifest(gens)).select("name", "length")


@query
def log_discovery(spark, sf_dir):
    return catalog.logs(listing(flushed_gens(spark, sf_dir)))


@query
def disk_usage(spark, sf_dir):
    return catalog.disk_usage(listing(flushed_gens(spark, sf_dir)))


@query
def wal_replay(spark, sf_dir):
    """The event log dealt over three logs by thirds, read in any order and replayed by log and place."""
    log = events_log(spark, sf_dir)
    n = log.agg((F.max("seq") + 1).alias("n"))
    rows = log.join(F.broadcast(n)).withColumn("wal_id", F.floor(F.col("seq") * 3 / F.col("n"))).withColumnRenamed("seq", "pos")  # one row is broadcast
    return state.live(rows, order=catalog.replay_order())


@query
def frame_verdicts(spark, sf_dir):
    """Frames of the users' properties, whole and damaged in five ways; null ones are framed as empty."""
    raw = frames.frame(F.coalesce(F.col("props"), F.lit("")).cast("binary"))
    n = F.octet_length(raw)
    kind = F.col("event_id") % 6
    flipped = F.concat(F.substring(raw, F.lit(1), n - 1), F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(raw, n, F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(255))), 2, "0")))
    large = F.concat(F.substring(raw, 1, 4), F.unhex(F.lit("0000000400000001")), F.substring(raw, F.lit(13), n))
    damaged = F.when(kind == 0, raw).when(kind == 1, F.substring(raw, 1, 3)).when(kind == 2, F.substring(raw, 1, 9)).when(kind == 3, F.substring(raw, F.lit(1), n - 1)).when(kind == 4, large).otherwise(flipped)
    rows = table(spark, sf_dir, "events")
    rows = rows.select("event_id", damaged.alias("raw"))  # a step of its own: the verdict looks at the bytes many times
    return rows.select("event_id", F.octet_length("raw").cast("long").alias("n_bytes"), frames.frame_verdict(F.col("raw")).alias("verdict"))


@query
def frame_payloads(spark, sf_dir):
    """Frames of the users' properties, every third cut short: the payload of those that can be read."""
    raw = frames.frame(F.coalesce(F.col("props"), F.lit("")).cast("binary"))
    cut_ = F.when(F.col("event_id") % 3 == 0, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    rows = table(spark, sf_dir, "events").select("event_id", cut_.alias("raw"))
    return rows.select("event_id", frames.frame_payload(F.col("raw")).cast("string").alias("payload"))


#: Events that lie in one framed file at most.
FRAMED = 1000


def framed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, raw): a user's properties framed one after the other, a file for each range of FRAMED events' numbers; the files
    of every third user lack their last five bytes."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", frames.frame(F.coalesce(F.col("props"), F.lit("")).cast("binary")).alias("frame"))
    file = F.struct("user_id", F.floor(F.col("event_id") / FRAMED).alias("part")).alias("file")
    held = rows.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("event_id", F.hex("frame").alias("x")))).alias("f"))  # FRAMED rows at most
    whole = held.select("file", F.unhex(F.array_join(F.transform("f", lambda f: f["x"]), "")).alias("raw"))
    short = F.substring(F.col("raw"), F.lit(1), F.octet_length("raw") - 5)
    return whole.select("file", F.when(F.col("file.user_id") % 3 == 0, short).otherwise(F.col("raw")).alias("raw"))


@query
def framed_log_scan(spark, sf_dir):
    """Framed files read record by record, up to the first that is damaged."""
    found = frames.records(framed_logs(spark, sf_dir), "file")
    return found.select("file.user_id", "file.part", "pos", "offset", F.col("payload").cast("string").alias("payload"), "verdict")


@query
def footer_verdicts(spark, sf_dir):
    """Footers: whole, cut short, of another magic number, of a later version."""
    kind = F.col("c_custkey") % 4
    magic = F.when(kind == 2, F.lit("00" * 8)).otherwise(F.lit(frames.MAGIC))
    version = F.when(kind == 3, F.lit("02000000")).otherwise(F.lit("01000000"))
    foot = F.unhex(F.concat(F.lit("00" * 32), magic, version, F.lit("00" * 20)))
    raw = F.concat(F.col("c_name").cast("binary"), F.when(kind == 1, F.substring(foot, 20, 40)).otherwise(foot))
    return table(spark, sf_dir, "customer").select("c_custkey", frames.footer_verdict(raw).alias("verdict"))


# Measurements and workloads


@query
def latency_percentiles(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("us"))
    return measure.latencies(samples, ["event_type"])


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase metrics from the event log: operations and seconds of each kind of event, per ten users."""
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("config"), "event_type", "value")
    phase = F.when(F.col("event_type") == "click", measure.DIRTY).when(F.col("event_type") == "view", measure.CLEANED).otherwise(F.col("event_type"))
    return rows.groupBy("config", phase.alias("phase")).agg(F.count("*").alias("ops"), F.sum(F.floor("value")).cast("long").alias("ms"))


@query
def phase_report(spark, sf_dir):
    seconds = F.col("ms") / 1000.0
    return phases(spark, sf_dir).select("config", "phase", "ops", measure.ops_per_second(F.col("ops"), seconds).alias("ops_per_s"), measure.mean_us(F.col("ops"), seconds).alias("mean_us"))


@query
def read_improvement(spark, sf_dir):
    return measure.read_improvement(phase_report(spark, sf_dir))


@query
def format_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919).alias("n"))
    third = F.col("n") / 3.0
    return rows.select("k", formats.thousands(F.col("n")).alias("grouped"), formats.short_float(third).alias("short"), formats.short_float(F.col("k") / 777.0).alias("small"), formats.kilobytes(F.col("n")).alias("kb"), formats.zero_pad(F.col("n"), 5).alias("padded"))


@query
def lcg_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    i = F.col("i")
    kinds = {"sequential_key": "sequential", "random_key": "random", "striped_key": "striped"}
    values = [generators.value(i, p, 12).alias(f"{p}_value") for p in ("v", "upd", "thr")]
    return rows.select("i", generators.lcg(i).cast("string").alias("lcg"), *(generators.key(i, k, 16).alias(a) for a, k in kinds.items()), *values)


@query
def read_targets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    return rows.select("i", generators.target(F.col("i"), 50_000).alias("read_target"), generators.target(F.col("i"), 50_000, generators.OVERWRITE).alias("overwrite_target"))


#: The published configurations (name, writes, overwrites, threads, deletions, keys, bytes of the write buffer).
CONFIGS = (
    ("SmallSeq", 50_000, 10_000, 1, 5_000, "sequential", 4 << 20),
    ("MediumRandom", 200_000, 50_000, 4, 25_000, "random", 8 << 20),
    ("StripedHighConcurrency", 300_000, 100_000, 8, 50_000, "striped", 16 << 20),
    ("HighBatchIngest", 500_000, 0, 1, 0, "sequential", 32 << 20),
)
#: Writes of a configuration whose numbers and sizes one task takes; the workload is fixed, whatever the session shuffles into.
A_TASK = 1 << 17
#: Their reads.
READS = {"SmallSeq": 20_000, "MediumRandom": 50_000, "StripedHighConcurrency": 100_000, "HighBatchIngest": 50_000}
#: Three of the published space tests (name, kind of keys, prefix, their length, entries, bytes of a value); a
#: prefix is as long as the published one.
SPACE = (
    ("long prefixed", "prefixed", "a.long.prefix.that.all.of.these.records.have_", 45, 10_000, 100),
    ("long random", "random", "", 64, 5_000, 200),
    ("mixed length", "prefixed", "data_", 25, 7_500, 75),
)


def workload(spark: SparkSession, writes: int, overwrites: int, threads: int, deletes: int, pattern: str, pad: int) -> DataFrame:
    """The benchmark's log: bulk puts, overwrites, the threads' rewrites, deletions."""
    def phase(n: int, at: int, index, value):
        i = spark.range(n)
        return i.select((F.col("id") + at).alias("seq"), index(F.col("id")).alias("i"), value.alias("prefix"))

    share = writes // threads if threads > 1 else 0
    parts = [
        phase(writes, 0, lambda c: c, F.lit("v")),
        phase(overwrites, writes, lambda c: generators.target(c, writes, generators.OVERWRITE), F.lit("upd")),
        phase(share * threads, writes + overwrites, lambda c: c, F.lit("thr")),
        phase(deletes, writes + overwrites + share * threads, lambda c: c, F.lit(None).cast("string")),
    ]
    log = parts[0]
    for p in parts[1:]:
        log = log.unionByName(p)
    return log.select("seq", generators.key(F.col("i"), pattern, pad).alias("key"), generators.value(F.col("i"), "", 16).alias("padded"), "prefix").select("seq", "key", F.concat("prefix", "padded").alias("value"), F.col("prefix").isNull().alias("is_tombstone"))


@query
def bench_end_state(spark, sf_dir):
    """The benchmark's end state by the first bytes of the values: keys and their least and greatest."""
    rows = state.live(workload(spark, 4000, 1000, 4, 500, "random", 24))
    return rows.groupBy(F.substring("value", 1, 3).alias("kind")).agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query
def bench_read_accuracy(spark, sf_dir):
    """The benchmark's last phase: random reads, deleted indices expected absent."""
    log = workload(spark, 4000, 1000, 4, 500, "random", 24)
    at = generators.target(F.col("id"), 4000)
    probes = spark.range(2000).select(generators.key(at, "random", 24).alias("key"), (at >= 500).alias("expected"))
    return state.accuracy(probes, state.live(log))


@query
def bench_dirty_reads(spark, sf_dir):
    """The benchmark's reads before threads and deletions: every target is there."""
    log = workload(spark, 4000, 1000, 1, 0, "random", 24)
    at = generators.target(F.col("id"), 4000)
    return state.accuracy(spark.range(2000).select(generators.key(at, "random", 24).alias("key"), F.lit(True).alias("expected")), state.live(log))


def phase_ends(n: int, over: int, threads: int, dele: int) -> list[tuple[str, int]]:
    """The phases that write, each with the number of writes by its end."""
    ends = [("bulk", n)] + [("overwrite", n + over)] * (over > 0) + [("threads", n + over + n // threads * threads)] * (threads > 1)
    return ends + [("delete", ends[-1][1] + dele)] * (dele > 0)


@query
def bench_report(spark, sf_dir):
    """The benchmark's report without its times: operations of every phase, runs on disk after it, and how many of the reads
    were answered rightly (all operations, where a phase reads nothing). Reads before threads are dirty, the last clean."""
    runs_ = bench_flush_counts(spark, sf_dir)
    phases_, reads = [], None
    for name, n, over, threads, dele, pattern, _ in CONFIGS:
        ends = phase_ends(n, over, threads, dele)
        begun = 0
        for phase, end in ends:
            phases_.append((name, phase, end - begun, phase))
            begun = end
        dirty = [p for p, _ in ends if p in ("bulk", "overwrite")][-1]
        phases_ += [(name, "dirty read", READS[name], dirty), (name, "cleaned read", READS[name], ends[-1][0])]
        log = workload(spark, n, over, threads, dele, pattern, 24)
        at = generators.target(F.col("id"), n)
        probes = spark.range(READS[name]).select(generators.key(at, pattern, 24).alias("key"), at.alias("at"))
        for phase, seen, there in (("dirty read", log.where(F.col("seq") < n + over), F.lit(True)), ("cleaned read", log, F.col("at") >= dele)):
            got = state.accuracy(probes.select("key", there.alias("expected")), state.live(seen)).select(F.lit(name).alias("config"), F.lit(phase).alias("phase"), "n_right")
            reads = got if reads is None else reads.unionByName(got)
    of = spark.createDataFrame(phases_, "config string, phase string, ops long, after string")  # a row a phase
    out = of.join(runs_.withColumnRenamed("phase", "after"), ["config", "after"]).join(reads, ["config", "phase"], "left")
    return out.select("config", "phase", "ops", "n_runs", F.coalesce("n_right", "ops").alias("n_right"))


@query
def space_test(spark, sf_dir):
    """Runs of generated keys written as files: bytes on disk, raw bytes, their ratio."""
    rows = None
    for i, (_, kind, prefix, length, n, width) in enumerate(SPACE):
        key = generators.space_key(F.col("id"), kind, length, prefix)
        own = spark.range(n).select(F.lit(i).cast("long").alias("sstable_id"), key.alias("key"), F.lit("v" * width).alias("value"), F.lit(False).alias("is_tombstone"))
        rows = own if rows is None else rows.unionByName(own)
    raw = rows.groupBy("sstable_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("raw_bytes"))
    ratio = layout.amplification(F.col("file_size"), F.col("raw_bytes"))
    sized = layout.file_sizes(rows, layout.blocks(rows)).join(raw, "sstable_id").withColumn("ratio", ratio)
    name = F.element_at(F.array(*(F.lit(c[0]) for c in SPACE)), (F.col("sstable_id") + 1).cast("int"))
    return sized.select(name.alias("test"), "n", "file_size", "raw_bytes", "ratio", layout.tier(F.col("ratio")).alias("tier"))


@query
def bench_flush_counts(spark, sf_dir):
    """Runs on disk at the end of each phase of the benchmark's configurations, in one partitioned pass each."""
    out = None
    for name, n, over, threads, dele, pattern, limit in CONFIGS:
        log = workload(spark, n, over, threads, dele, pattern, 24).select("seq", "is_tombstone")
        ends = phase_ends(n, over, threads, dele)
        gens = runs.generations(log, limit, partitions=-(-ends[-1][1] // A_TASK)).groupBy("gen").agg(F.sum(state.cost()).alias("bytes"), F.max("seq").alias("last")).where(F.col("bytes") >= limit)
        at = [F.struct(F.lit(name).alias("config"), F.lit(p).alias("phase"), F.sum((F.col("last") < end).cast("long")).alias("n")) for p, end in ends]
        rows = gens.agg(F.array(*at).alias("r")).select(F.explode("r").alias("r")).select("r.config", "r.phase", F.coalesce("r.n", F.lit(0)).alias("n_runs"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def space_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"))
    i = F.col("i")
    return rows.select("i", generators.space_key(i, "prefixed", 10, "user_").alias("short_key"), generators.space_key(i, "prefixed", 4, "data_").alias("unpadded_key"), generators.space_key(i, "sequential", 10).alias("fixed_key"), generators.space_key(i, "random", 16, seed=7).alias("random_key"))


# Streaming


@query
def stream_live_state(spark, sf_dir):
    return streams.live_once(spark, sf_dir)


@query
def stream_aggregated_state(spark, sf_dir):
    """The newest entries, tombstones included, as an aggregation in complete mode gives them with its last batch."""
    out = streams.written(streams.newest(streams.events_stream(spark, sf_dir)), "complete")
    last = out.agg(F.max("batch_id").alias("batch_id"))
    return out.join(F.broadcast(last), "batch_id").select("key", "value", "is_tombstone")  # one row is broadcast


@query
def stream_keyed_state(spark, sf_dir):
    """The newest entries, tombstones included, from the changes that a state per key puts out."""
    out = streams.written(streams.upserted(streams.events_stream(spark, sf_dir)), "update")
    return state.latest(out)


# The durable store


def parts_written(spark: SparkSession, sf_dir: str, n: int, limit: int) -> Store:
    """A store into which the event log was written in n batches by ranges of its numbers, and opened anew."""
    log, path = events_log(spark, sf_dir), scratch(spark, "store")
    kinds = {"key": log.schema["key"].dataType.simpleString(), "value": log.schema["value"].dataType.simpleString()}
    end = log.agg(F.max("seq") + 1).first()[0] or 0
    db = Store.open(spark, path, limit, **kinds)
    for i in range(n):
        part = log.where((F.col("seq") >= end * i // n) & (F.col("seq") < end * (i + 1) // n))
        db.write_frame(part.withColumn("op_index", F.col("seq") - end * i // n))
    return Store.open(spark, path, limit, **kinds)


@query
def store_recovered_state(spark, sf_dir):
    """The live state of a store that was closed with all its batches in the log."""
    return parts_written(spark, sf_dir, 3, 1 << 40).live()


@query
def store_merged_state(spark, sf_dir):
    """The newest entries of a store whose five batches were each flushed, four of the runs merged."""
    return parts_written(spark, sf_dir, 5, 1).latest()


@query
def store_run_metadata(spark, sf_dir):
    """The runs that those five batches leave: one merged run, one of level 0."""
    return parts_written(spark, sf_dir, 5, 1).run_metadata()


@query
def store_catalog(spark, sf_dir):
    """The catalog that they leave: what was added, what was removed, the next id."""
    return parts_written(spark, sf_dir, 5, 1).manifest().select("seq", "action", F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("next_id", F.lit(-1)).alias("next_id"))
