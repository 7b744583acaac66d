"""Generations, runs, levels and merging."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import formats
from tidelog.operators import catalog, lookup, merge, runs, state
from tidelog.plans import queries
from tidelog.plans.oracle import ORACLE_SQL
from tidelog.plans.queries import workload

LOG = "seq long, key string, value string, is_tombstone boolean"
RUN = "sstable_id long, key string, value string, is_tombstone boolean"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def fold(costs, limit):
    gen = held = 0
    out = []
    for c in costs:
        out.append(gen)
        held += c
        if held >= limit:
            gen, held = gen + 1, 0
    return out


@pytest.mark.parametrize(("n", "limit", "parts"), [(1, 10, 3), (200, 100, 5), (300, 1000, 4), (50, 10**9, 3), (120, 24, 7), (0, 10, 2)])
def test_generations_equal_a_plain_fold(spark, n, limit, parts):
    rng = random.Random(n)
    log = [(i, "k", "v", rng.random() < 0.4) for i in range(n)]
    got = runs.generations(spark.createDataFrame(log, LOG), limit, partitions=parts)
    want = fold([24 if r[3] else 48 for r in log], limit)
    assert [g for _, g in rows(got, "seq", "gen")] == want


def test_generations_by_other_sizes(spark):
    log = spark.createDataFrame([(i, "k", "x" * (i % 7), False) for i in range(100)], LOG)
    got = runs.generations(log, 20, F.octet_length("value"), partitions=6)
    assert [g for _, g in rows(got, "seq", "gen")] == fold([i % 7 for i in range(100)], 20)


def test_ten_flushes_of_two_puts(spark):
    log = spark.createDataFrame([(i, f"key-{i}", "val", False) for i in range(20)], LOG)
    got = runs.full(runs.generations(log, 50), 50)
    assert rows(got.groupBy("gen").count(), "gen", "count") == [(g, 2) for g in range(10)]


def test_published_run_counts(spark):
    """A larger configuration than the registered query's: 0, 1, 2, 2 runs at the phases' ends."""
    n, over, dele, limit = 300_000, 100_000, 50_000, 16 << 20
    log = workload(spark, n, over, 8, dele, "striped", 32).select("seq", "is_tombstone")
    ends = [n, n + over, 2 * n + over, 2 * n + over + dele]
    gens = runs.generations(log, limit).groupBy("gen").agg(F.sum(state.cost()).alias("b"), F.max("seq").alias("last")).where(F.col("b") >= limit).collect()
    assert [sum(r["last"] < e for r in gens) for e in ends] == [0, 1, 2, 2]


def test_levels_and_ids_against_a_simulation(spark):
    levels, ids, next_id, flush_ids = {0: []}, {}, 0, []
    seen = {}
    for n in range(1, 120):
        flush_ids.append(next_id)
        levels[0].append([n - 1])
        next_id += 1
        k = 0
        while len(levels.get(k, [])) == 4:
            levels.setdefault(k + 1, []).append(sum(levels[k], []))
            levels[k] = []
            next_id += 1
            k += 1
        seen[n] = {g: (k, i) for k, of in levels.items() for r, gens in enumerate(of) for g in gens for i in [gens[0] // 4**k]}
    df = spark.createDataFrame([(n, g) for n in (1, 4, 5, 16, 63, 64, 119) for g in range(n)], "n long, gen long")
    level = runs.level_of(F.col("gen"), F.col("n"))
    for r in df.select("n", "gen", level.alias("level"), runs.run_of(F.col("gen"), level).alias("run"), runs.flush_id(F.col("gen")).alias("id")).collect():
        assert (r.level, r.run) == seen[r.n][r.gen] and r.id == flush_ids[r.gen]
    assert ids == {}


#: The highest level by the number of flushes.
TOP_LEVEL = {0: 0, 3: 0, 64: 3, 1023: 4, 1024: 5, 4**6 + 5: 6}


@pytest.mark.parametrize("n", TOP_LEVEL)
def test_the_catalog_knows_the_runs_of_all_levels(spark, monkeypatch, n):
    monkeypatch.setattr(queries, "flushes", lambda spark, sf_dir: spark.range(n).select(F.col("id").alias("gen")))
    placed = queries.placed(queries.flushed_gens(spark, "")).select("level", formats.run_name(F.col("level"), F.col("run_no")).alias("path")).distinct()
    active = set(rows(placed, "level", "path"))
    assert set(rows(queries.manifest_active_runs(spark, ""), "level", "path")) == active and max([k for k, _ in active], default=0) == TOP_LEVEL[n]
    used, orphans = ({x for x, in rows(q(spark, ""), "name")} for q in (queries.used_files, queries.orphan_files))
    assert used == {p for _, p in active} and orphans == {f"L0-{g:020}.sst" for g in range(n)} - used


def test_merge_order_newer_runs_first(spark):
    def order(pairs):
        df = spark.createDataFrame([(i, k, "", False) for k, i in pairs], RUN)
        return [(r.key, r.sstable_id) for r in merge.merge_order(df).orderBy("pop_no").collect()]

    assert order([("C", 1), ("A", 1), ("B", 1)]) == [("A", 1), ("B", 1), ("C", 1)]
    assert order([("A", 10), ("A", 2), ("A", 5)]) == [("A", 10), ("A", 5), ("A", 2)]
    assert order([("B", 100), ("A", 1), ("B", 50), ("A", 50)]) == [("A", 50), ("A", 1), ("B", 100), ("B", 50)]


def test_merge_keeps_the_newest_and_tombstones(spark):
    df = spark.createDataFrame(
        [(1, "A", "v1-old", False), (1, "C", "v1", False), (1, "E", "v1", False), (2, "A", "v2-new", False), (2, "B", "v2", False), (2, "D", "v2", False), (3, "C", None, True)], RUN
    )
    assert rows(merge.kway_merge(df), "key", "sstable_id") == [("A", 2), ("B", 2), ("C", 3), ("D", 2), ("E", 1)]
    assert rows(merge.compacted(df), "key", "is_tombstone") == [("A", False), ("B", False), ("C", True), ("D", False), ("E", False)]
    assert rows(merge.compacted(df, drop_tombstones=True), "key") == [("A",), ("B",), ("D",), ("E",)]


def test_merging_adjacent_runs_leaves_the_live_state(spark):
    rng = random.Random(1)
    log = [(i, f"k{rng.randrange(30)}", f"v{i}", rng.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame([(s, k, None if d else v, d) for s, k, v, d in log], LOG)
    flushed = runs.flushed(runs.generations(df, 500)).withColumnRenamed("gen", "sstable_id")
    part = F.col("sstable_id").between(2, 4)
    merged = merge.compacted(flushed.where(part)).withColumn("sstable_id", F.lit(4).cast("long"))
    both = flushed.where(~part).unionByName(merged)
    assert merge.differences(state.live(df), state.live(both, order="sstable_id")).first()[:] == (0, 0)


def test_filter_tier(spark):
    assert [r.f for r in spark.range(3).select(runs.filter_type(F.col("id")).alias("f")).collect()] == ["xor8", "xor16", "xor16"]


def test_overlaps_touching_nested_disjoint_empty(spark):
    meta = "sstable_id long, min_key string, max_key string"
    a = spark.createDataFrame([(1, "c", "f")], meta)
    level = spark.createDataFrame([(10, "a", "c"), (11, "d", "e"), (12, "g", "z"), (13, "a", "z"), (14, "f", "f"), (15, "a", "b")], meta)
    assert [r for _, r in rows(lookup.overlapping(a, level), "left_id", "right_id")] == [10, 11, 13, 14]
    assert rows(lookup.hull_overlapping(spark.createDataFrame([(1, "b", "b"), (2, "g", "g")], meta), level), "sstable_id") == [(10,), (11,), (12,), (13,), (14,), (15,)]
    assert lookup.hull_overlapping(a.limit(0), level).count() == 0
    assert lookup.overlapping(a, level.limit(0)).count() == 0


def test_layers_hide_what_is_below(spark):
    df = spark.createDataFrame([(0, "a", None, True), (1, "a", "old", False), (2, "b", "x", False), (5, "b", "y", False)], "layer int, key string, value string, is_tombstone boolean")
    assert rows(lookup.layered(df), "key", "layer", "found") == [("a", 0, False), ("b", 2, True)]


def test_floor_lookup_below_the_first_key_and_between(spark):
    index = spark.createDataFrame([(1, "c", 0), (1, "m", 1), (2, "a", 0)], "sstable_id long, first_key string, block_no long")
    probes = spark.createDataFrame([(1, "a"), (1, "c"), (1, "d"), (1, "z"), (2, "z")], "sstable_id long, key string")
    got = lookup.floor_lookup(probes, index).collect()
    assert {(r.sstable_id, r.key): r.first_key for r in got} == {(1, "a"): None, (1, "c"): "c", (1, "d"): "c", (1, "z"): "m", (2, "z"): "a"}


def test_cache_misses_once_a_block(spark):
    df = spark.createDataFrame([(0, 1, 100), (1, 1, 100), (2, 1, 200)], "access_no long, sstable_id long, offset long")
    assert [h for _, h in rows(lookup.cache_trace(df), "access_no", "hit")] == [False, True, False]


def test_filters_miss_no_key_and_few_others(spark):
    keys = spark.range(0, 4000, 2).withColumnRenamed("id", "key")
    got = lookup.maybe_contains(spark.range(4000).withColumnRenamed("id", "key"), lookup.filter_of(keys, 2000), 2000).collect()
    assert len(got) == 4000 and all(r.maybe for r in got if r.key % 2 == 0) and sum(r.maybe for r in got if r.key % 2) < 60
    none = lookup.maybe_contains(keys, lookup.filter_of(keys.limit(0), 0), 0)
    assert none.where("maybe").count() == 0


def test_catalog_beyond_five_levels(spark):
    """1,500 flushes make runs of level 5; the catalog's fold against levels merged one by one."""
    levels, n = {}, 1500
    for gen in range(n):
        levels.setdefault(0, []).append(gen)
        k = 0
        while len(levels[k]) == 4:
            levels.setdefault(k + 1, []).append(levels[k][0] // 4)
            levels[k] = []
            k += 1
    gens = spark.range(n).withColumnRenamed("id", "gen")
    log = queries.manifest(gens)
    got = sorted((r.level, int(r.path.split("-")[1][:20])) for r in catalog.active_runs(log).collect())
    assert got == sorted((k, x) for k, of in levels.items() for x in of) and max(levels) == 5
    files = queries.listing(gens)
    used = {r.name for r in catalog.used(files, log).collect()}
    assert len(used) == len(got) and not used & {r.name for r in catalog.orphans(files, log).collect()}
    con = duckdb.connect()
    sql = ORACLE_SQL["manifest_active_runs"].replace("shut AS (SELECT gen FROM g GROUP BY gen HAVING sum(c) >= 8192)", f"shut AS (SELECT i AS gen FROM range(0, {n}) t(i))")
    con.sql("create view events as select 0::bigint as event_id, 1::bigint as user_id, 'x' as event_type, '' as props")
    assert sorted((r[0], int(r[1].split("-")[1][:20])) for r in con.sql(sql).fetchall()) == got


@pytest.mark.parametrize("kind", ["long", "string"])
def test_runs_probed_against_pairs(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    make = (lambda i: int(i)) if kind == "long" else (lambda i: f"k{i:04}é" if i % 3 else f"k{i:04}")
    entries = [(int(r), make(k)) for r in range(30) for k in rng.choice(400, 9, replace=False)]
    asked = sorted({make(i) for i in rng.integers(0, 500, 300)})
    bounds = {r: (min(k for q, k in entries if q == r), max(k for q, k in entries if q == r)) for r in range(30)}
    want = {}
    for k in asked:
        hit = max((r for r, x in entries if x == k), default=-1)
        want[k] = sum(lo <= k <= hi and r >= hit for r, (lo, hi) in bounds.items())
    df = spark.createDataFrame([(r, k, False) for r, k in entries], f"sstable_id long, key {kind}, is_tombstone boolean")
    probes = spark.createDataFrame([(k,) for k in [*asked, *asked[:5], None]], f"key {kind}")
    for chunk in (7, 64):
        monkeypatch.setattr(lookup, "CHUNK", chunk)
        assert {r.key: r.n_probed for r in lookup.runs_probed(probes, runs.metadata(df, "sstable_id"), df).collect()} == want
    none = lookup.runs_probed(probes, runs.metadata(df.limit(0), "sstable_id"), df.limit(0)).collect()
    assert {r.key: r.n_probed for r in none} == dict.fromkeys(asked, 0)


def test_a_bounded_cache_drops_the_least_recently_used(spark):
    rng = np.random.default_rng(3)
    accesses = [(i, int(b) % 2, int(b) // 2 * 4096) for i, b in enumerate(rng.zipf(1.4, 600) % 40)]
    df = spark.createDataFrame(accesses, "access_no long, sstable_id long, offset long")
    for capacity, shards in ((8, 1), (8, 4), (0, 1), (1000, 2)):
        held, want = {}, []
        for _, run, at in accesses:
            own = held.setdefault((at // 4096 + run) % shards, [])
            want.append((run, at) in own)
            if (run, at) in own:
                own.remove((run, at))
            own.append((run, at))
            del own[: max(0, len(own) - capacity // shards)]
        assert [r.hit for r in lookup.bounded_cache_trace(df, capacity, shards).orderBy("access_no").collect()] == want
    assert rows(lookup.bounded_cache_trace(df, 1000, 1), "access_no", "hit") == rows(lookup.cache_trace(df), "access_no", "hit")


def test_tasks_of_the_fixed_workload_depend_on_its_writes_alone(spark, monkeypatch):
    from tidelog.plans import queries

    seen = []

    def generations(log, limit, **given):
        seen.append(given.get("partitions"))
        return spark.createDataFrame([], "seq long, is_tombstone boolean, gen long")

    monkeypatch.setattr(queries.runs, "generations", generations)
    queries.QUERIES["bench_flush_counts"](spark, "/no/such/folder")
    assert seen == [1, 4, 6, 4]
