"""The queries' SQL for the oracle."""

from __future__ import annotations

from textwrap import dedent

_M1 = """m1 AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, coalesce(event_type = 'error', false) AS is_tombstone FROM events)"""
_M2 = """m2 AS (SELECT o_orderkey AS seq, o_custkey AS key, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value, coalesce(o_orderstatus = 'P', false) AS is_tombstone FROM orders)"""
_L1 = f"""{_M1}, l1 AS (SELECT key, value, is_tombstone FROM m1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""
_L2 = f"""{_M2}, l2 AS (SELECT key, value, is_tombstone FROM m2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""
#: Generations of the event log: one row after the other. A row's size goes on from the last, or from 0 once that is full.
_GEN = f"""{_M1},
o AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, CASE WHEN is_tombstone THEN 24 ELSE 48 END AS c FROM m1),
f(rn, gen, acc) AS (
  SELECT 1::BIGINT, 0::BIGINT, (SELECT c FROM o WHERE rn = 1)::BIGINT
  UNION ALL
  SELECT o.rn, f.gen + (f.acc >= 8192)::BIGINT, (CASE WHEN f.acc >= 8192 THEN 0 ELSE f.acc END + o.c)::BIGINT FROM f JOIN o ON o.rn = f.rn + 1
),
g AS (SELECT o.seq, o.key, o.value, o.is_tombstone, o.c, f.gen FROM o JOIN f USING (rn)),
shut AS (SELECT gen FROM g GROUP BY gen HAVING sum(c) >= 8192),
fl AS (SELECT gen, key, value, is_tombstone FROM g WHERE gen IN (FROM shut) QUALIFY row_number() OVER (PARTITION BY gen, key ORDER BY seq DESC) = 1),
nf AS (SELECT max(gen) + 1 AS n FROM shut),
pl AS (
  SELECT gen, lv AS level, (gen // (4 ** lv)::BIGINT)::BIGINT AS run_no
  FROM (SELECT gen, list_max(list_filter(range(0, 16), lambda l: gen < (n // (4 ** l)::BIGINT) * (4 ** l)::BIGINT))::INTEGER AS lv FROM shut, nf)
)"""
_RUN_NAME = "'L' || {0} || '-' || lpad({1}::VARCHAR, 20, '0') || '.sst'"
_FLUSH_ID = "(gen + " + " + ".join(f"gen // {4**k}" for k in range(1, 16)) + ")"
_MANIFEST = f"""{_GEN},
k AS (SELECT unnest(range(0, 16))::INTEGER AS k),
made AS (SELECT gen, k, (gen // (4 ** k)::BIGINT)::BIGINT AS run_no FROM shut, k WHERE (gen + 1) % (4 ** k)::BIGINT = 0),
mf AS (
  SELECT (gen * 128 + 8 * k)::BIGINT AS seq, 'add' AS action, k AS level, {_RUN_NAME.format("k", "run_no")} AS path FROM made
  UNION ALL
  SELECT (gen * 128 + 4 * (2 * k - 1))::BIGINT, 'remove', k - 1, {_RUN_NAME.format("(k - 1)", "r")} FROM (SELECT gen, k, unnest(range(run_no * 4, run_no * 4 + 4)) AS r FROM made WHERE k > 0)
),
active AS (SELECT level, path FROM mf QUALIFY row_number() OVER (PARTITION BY level, path ORDER BY seq DESC) = 1 AND action = 'add'),
ls AS (
  SELECT {_RUN_NAME.format("0", "gen")} AS name, gen + 1000 AS length FROM shut
  UNION ALL
  SELECT DISTINCT {_RUN_NAME.format("level", "run_no")}, run_no + 2000 FROM pl WHERE level > 0
  UNION ALL
  SELECT lpad(gen::VARCHAR, 6, '0') || CASE gen % 3 WHEN 0 THEN '.wal' WHEN 1 THEN '.wal.bak' ELSE 'x.wal' END, gen * 7 FROM shut
)"""
_ORDER_RUNS = f"""{_L2},
n AS (SELECT max(key) + 1 AS n FROM l2),
cell AS (SELECT *, floor(key * 10 / n)::BIGINT AS cell FROM l2, n),
runs AS (
  SELECT cell * 2 AS sstable_id, key, value, is_tombstone FROM cell
  UNION ALL
  SELECT CASE WHEN key % 3 = 0 THEN least(cell + 1, 9) * 2 + 1 ELSE cell * 2 + 1 END, key, value, is_tombstone FROM cell
),
meta AS (SELECT sstable_id, min(key) AS min_key, max(key) AS max_key FROM runs GROUP BY 1)"""
_URLS = "u AS (SELECT url AS key, page_id::VARCHAR AS value, row_number() OVER (ORDER BY url) - 1 AS pos, lag(url) OVER (ORDER BY url) AS before FROM pages)"
_NAMES = "u AS (SELECT c_name AS key, c_mktsegment AS value, row_number() OVER (ORDER BY c_name) - 1 AS pos, lag(c_name) OVER (ORDER BY c_name) AS before FROM customer)"
_LCP = "list_max(list_filter(range(0, least(strlen(key), strlen(before)) + 1), lambda n: left(key, n) = left(before, n)))"
#: Blocks of one run: each entry's size depends on whether a restart begins with it. A key shares bytes with the one before
#: only if both have the same length here (none is longer than 255).
def _blocks(source: str, t: str = "") -> str:
    return f"""{source},
e{t} AS (SELECT key, pos, 12 + 8 + strlen(key) + 10 + strlen(value) AS whole, coalesce(CASE WHEN strlen(key) = strlen(before) THEN 8 + {_LCP} ELSE 0 END, 0) AS shared FROM u{t}),
b{t}(pos, block_no, n, data) AS (
  SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT, (SELECT whole FROM e{t} WHERE pos = 0)::BIGINT
  UNION ALL
  SELECT e{t}.pos, b{t}.block_no + (b{t}.data + 4 * ((b{t}.n + 15) // 16) >= 4096)::BIGINT,
         CASE WHEN b{t}.data + 4 * ((b{t}.n + 15) // 16) >= 4096 THEN 1 ELSE b{t}.n + 1 END,
         CASE WHEN b{t}.data + 4 * ((b{t}.n + 15) // 16) >= 4096 THEN e{t}.whole ELSE b{t}.data + e{t}.whole - CASE WHEN b{t}.n % 16 = 0 THEN 0 ELSE e{t}.shared END END::BIGINT
  FROM b{t} JOIN e{t} ON e{t}.pos = b{t}.pos + 1
),
bl{t} AS (SELECT block_no, min(key) AS first_key, count(*) AS num_entries, max(data)::BIGINT AS data_bytes, ((count(*) + 15) // 16)::BIGINT AS restarts FROM b{t} JOIN e{t} USING (pos) GROUP BY block_no)"""


_BLOCKS = _blocks(_NAMES)
_BOTH = f"""{_BLOCKS},
{_blocks(_URLS.replace("u AS", "uu AS", 1), "u")},
rows AS (SELECT 0::BIGINT AS sstable_id, key, value FROM u UNION ALL SELECT 1, key, value FROM uu),
blocks AS (SELECT 0::BIGINT AS sstable_id, * FROM bl UNION ALL SELECT 1, * FROM blu),
ends AS (SELECT sstable_id, count(*) AS n, strlen(min(key)) + strlen(max(key)) AS keys, sum(strlen(key) + strlen(value))::BIGINT AS raw_bytes FROM rows GROUP BY 1),
parts AS (SELECT sstable_id, sum(data_bytes + 4 * restarts + 28)::BIGINT AS block_bytes, (20 + sum(strlen(first_key) + 16))::BIGINT AS index_bytes FROM blocks GROUP BY 1)"""
_SLOTS = "((floor(1.23::DOUBLE * n)::BIGINT + 32) // 3 * 3)"


_LCG = "((({0})::HUGEINT * 6364136223846793005) % 18446744073709551616 + 1) % 18446744073709551616"


def _target(i: str, n: int, a: int, c: int) -> str:
    return f"((((({_LCG.format(i)}) * {a}) % 18446744073709551616 + {c}) % 18446744073709551616) % {n})::BIGINT"


def _random_key(i: str) -> str:
    return f"'key-' || lpad((({_LCG.format(i)}) % 1000000000)::VARCHAR, 24, '0')"


_WORKLOAD = f"""w AS (
  SELECT i AS seq, i AS idx, 'v' AS prefix FROM range(0, 4000) t(i)
  UNION ALL SELECT 4000 + i, {_target("i", 4000, 1664525, 1013904223)}, 'upd' FROM range(0, 1000) t(i)
  UNION ALL SELECT 5000 + i, i, 'thr' FROM range(0, 4000) t(i)
  UNION ALL SELECT 9000 + i, i, NULL FROM range(0, 500) t(i)
),
log AS (SELECT seq, {_random_key("idx")} AS key, prefix || lpad(idx::VARCHAR, 16, '0') AS value, prefix IS NULL AS is_tombstone FROM w),
st AS (SELECT key, value FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND NOT is_tombstone)"""
_PHASES = """ph AS (
  SELECT (user_id // 10)::BIGINT AS config, CASE event_type WHEN 'click' THEN 'Random Read (Dirty)' WHEN 'view' THEN 'Random Read (Cleaned)' ELSE event_type END AS phase,
         count(*) AS ops, sum(floor(value))::BIGINT AS ms FROM events GROUP BY ALL
),
rp AS (SELECT config, phase, ops, CASE WHEN ms > 0 THEN ops / (ms / 1000.0::DOUBLE) ELSE 0.0 END AS ops_per_s, (ms / 1000.0::DOUBLE) * 1000000 / ops AS mean_us FROM ph)"""
_LAYERS = f"""{_M1}, n AS (SELECT max(seq) + 1 AS n FROM m1),
s AS (SELECT *, (seq * 10) // n AS slot FROM m1, n),
ly AS (SELECT CASE WHEN slot = 9 THEN 0 WHEN slot = 8 THEN 1 ELSE 5 - slot // 2 END::INTEGER AS layer, key, value, is_tombstone, seq FROM s)"""


def _thousands(x: str) -> str:
    return f"format('{{:_}}', ({x})::BIGINT)"


def _space(t: str, key: str, n: int, width: int) -> str:
    """Blocks of n generated keys, as e, b and bl with the suffix t."""
    source = f"""k{t} AS (SELECT {key} AS key, repeat('v', {width}) AS value FROM range(0, {n}) r(i)),
u{t} AS (SELECT key, value, row_number() OVER (ORDER BY key) - 1 AS pos, lag(key) OVER (ORDER BY key) AS before FROM k{t})"""
    return _blocks(source, t)


def _random_letters(i: str, n: int, seed: int) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return f"array_to_string([substr('{letters}', (('0x' || substr(md5('{seed}:' || {i} || ':' || k), 1, 8))::BIGINT % 62 + 1)::BIGINT, 1) for k in range(0, {n})], '')"


_SPACE = ",\n".join((
    _space("1", "'a.long.prefix.that.all.of.these.records.have_' || i", 10_000, 100),
    _space("2", _random_letters("i", 64, 0), 5_000, 200),
    _space("3", "'data_' || lpad(i::VARCHAR, 20, '0')", 7_500, 75),
))


def _short(x: str) -> str:
    return f"CASE WHEN {x} < 1 THEN printf('%.2f', {x}) WHEN {x} < 1000 THEN printf('%.1f', {x}) ELSE {_thousands(f'round({x})')} END"


ORACLE_SQL = {
    "live_state": f"WITH {_L1} SELECT key, value FROM l1 WHERE NOT is_tombstone",
    "live_state_orders": f"WITH {_L2} SELECT key, value FROM l2 WHERE NOT is_tombstone",
    "latest_entry_with_tombstones": f"WITH {_L1} SELECT key, value, is_tombstone FROM l1",
    "live_count_vs_entry_count": f"WITH {_L1} SELECT count(*) AS n_entries, (count(*) FILTER (NOT is_tombstone))::BIGINT AS n_live FROM l1",
    "point_get_hit": f"WITH {_L1} SELECT 7::INTEGER AS key, max(value) AS value, coalesce(bool_or(NOT is_tombstone), false) AS found FROM l1 WHERE key = 7",
    "point_get_all_keys": f"WITH {_L1} SELECT key, value, NOT is_tombstone AS found FROM l1",
    "point_get_missing": f"WITH {_L1} SELECT -1::INTEGER AS key, max(value) AS value, coalesce(bool_or(NOT is_tombstone), false) AS found FROM l1 WHERE key = -1",
    "multi_get": f"WITH {_L2} SELECT c_custkey AS key, value, l.key IS NOT NULL AS found FROM customer LEFT JOIN (FROM l2 WHERE NOT is_tombstone) l ON l.key = c_custkey",
    "membership_accuracy": f"""WITH {_L1}, p AS (SELECT unnest(range(0, (SELECT max(key) * 2 + 1 FROM m1))) AS key),
x AS (SELECT p.key, coalesce((SELECT bool_or(NOT is_tombstone) FROM m1 WHERE m1.key = p.key), false) AS expected, EXISTS (FROM l1 WHERE l1.key = p.key AND NOT is_tombstone) AS found FROM p)
SELECT count(*) AS n, (count(*) FILTER (expected = found))::BIGINT AS n_right, avg(CASE WHEN expected = found THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS accuracy FROM x""",
    "range_scan": f"WITH {_L1} SELECT key, value FROM l1 WHERE NOT is_tombstone AND key BETWEEN 3 AND 40",
    "batch_replay": f"WITH {_M1} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq // 100 DESC, seq % 100 DESC) AS rn FROM m1) WHERE rn = 1 AND NOT is_tombstone",
    "batch_op_counts": f"WITH {_M1} SELECT (seq // 100)::BIGINT AS batch_id, count(*) AS n_ops, count(*) FILTER (is_tombstone) AS n_deletes FROM m1 GROUP BY 1",
    "batch_size_accounting": f"WITH {_M1} SELECT (seq // 100)::BIGINT AS batch_id, sum(CASE WHEN is_tombstone THEN 24 ELSE 48 END)::BIGINT AS bytes FROM m1 GROUP BY 1",
    "group_commit_batches": f"WITH {_M1} SELECT (seq // 1024)::BIGINT AS commit_no, count(*) AS n_writes, min(seq) AS first_seq, max(seq) AS last_seq FROM m1 GROUP BY 1",
    "memtable_generations": f"WITH RECURSIVE {_GEN} SELECT gen, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_ops, sum(c)::BIGINT AS bytes FROM g GROUP BY gen",
    "generations_put_only": "SELECT ((c_custkey - (SELECT min(c_custkey) FROM customer)) // 171)::BIGINT AS gen, count(*) AS n_puts, min(c_name) AS min_key, max(c_name) AS max_key FROM customer GROUP BY 1",
    "memtable_contents": f"WITH RECURSIVE {_GEN} SELECT key, value, is_tombstone FROM g WHERE gen NOT IN (FROM shut) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1",
    "flush_runs": f"WITH RECURSIVE {_GEN} SELECT * FROM fl",
    "run_metadata": f"WITH RECURSIVE {_GEN} SELECT gen, min(key) AS min_key, max(key) AS max_key, count(*) AS num_entries, count(*) FILTER (NOT is_tombstone) AS num_live FROM fl GROUP BY gen",
    "level_placement": f"WITH RECURSIVE {_GEN} SELECT gen, level, run_no FROM pl",
    "level_file_counts": f"WITH RECURSIVE {_GEN} SELECT level, count(DISTINCT run_no) AS n_runs FROM pl GROUP BY level",
    "total_run_count": f"WITH RECURSIVE {_GEN} SELECT count(*) AS n_runs FROM (SELECT DISTINCT level, run_no FROM pl)",
    "compaction_backlog": f"WITH RECURSIVE {_GEN} SELECT coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS backlog FROM (SELECT count(DISTINCT run_no) AS n FROM pl GROUP BY level)",
    "filter_tier": f"WITH RECURSIVE {_GEN} SELECT gen, level, CASE WHEN level > 0 THEN 'xor16' ELSE 'xor8' END AS filter_type FROM pl",
    "flush_ids": f"WITH RECURSIVE {_GEN} SELECT gen, {_FLUSH_ID}::BIGINT AS sstable_id FROM shut",
    "run_file_names": f"WITH RECURSIVE {_GEN} SELECT gen, {_RUN_NAME.format('0', _FLUSH_ID)} AS run_file, lpad(gen::VARCHAR, 6, '0') || '.wal' AS log_file FROM shut",
    "merge_order": f"WITH RECURSIVE {_GEN} SELECT row_number() OVER (ORDER BY key, gen DESC) - 1 AS pop_no, key, gen AS sstable_id, is_tombstone FROM fl",
    "kway_merge": f"WITH RECURSIVE {_GEN} SELECT key, value, is_tombstone, gen AS sstable_id FROM fl QUALIFY row_number() OVER (PARTITION BY key ORDER BY gen DESC) = 1",
    "level_compaction": f"WITH RECURSIVE {_GEN} SELECT level, run_no, key, value, is_tombstone FROM fl JOIN pl USING (gen) QUALIFY row_number() OVER (PARTITION BY level, run_no, key ORDER BY gen DESC) = 1",
    "compaction_preserves_live": "SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b",
    "run_set_difference": f"WITH RECURSIVE {_GEN} SELECT DISTINCT level, run_no FROM pl WHERE level <> 0",
    "layered_lookup": f"WITH {_LAYERS} SELECT key, layer, value, NOT is_tombstone AS found FROM ly QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, seq DESC) = 1",
    "runs_probed_per_get": f"""WITH RECURSIVE {_GEN}, p AS (SELECT user_id AS key FROM events UNION SELECT user_id + 1000 FROM events),
meta AS (SELECT gen, min(key) AS lo, max(key) AS hi FROM fl GROUP BY gen), hit AS (SELECT key, max(gen) AS hit FROM fl GROUP BY key)
SELECT p.key, (count(*) FILTER (meta.gen IS NOT NULL AND (hit IS NULL OR meta.gen >= hit)))::BIGINT AS n_probed FROM p LEFT JOIN meta ON p.key BETWEEN lo AND hi LEFT JOIN hit ON hit.key = p.key GROUP BY p.key""",
    "filter_membership": "SELECT (count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)))::BIGINT AS n_there, 0::BIGINT AS n_missed FROM customer",
    "run_scan": f"WITH {_L1} SELECT row_number() OVER (ORDER BY key) - 1 AS pos, key, value, is_tombstone FROM l1",
    "run_overlap_pairs": f"WITH {_ORDER_RUNS} SELECT a.sstable_id AS left_id, b.sstable_id AS right_id FROM meta a JOIN meta b ON a.min_key <= b.max_key AND b.min_key <= a.max_key WHERE a.sstable_id % 2 = 0 AND b.sstable_id % 2 = 1",
    "hull_overlap": f"WITH {_ORDER_RUNS}, h AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM meta WHERE sstable_id IN (4, 6)) SELECT sstable_id, min_key, max_key FROM meta, h WHERE sstable_id % 2 = 1 AND lo <= max_key AND min_key <= hi",
    "sparse_index": f"WITH {_URLS} SELECT (pos // 16)::BIGINT AS block_no, key AS first_key FROM u WHERE pos % 16 = 0",
    "index_floor_lookup": f"WITH {_URLS}, ix AS (SELECT (pos // 16)::BIGINT AS block_no, key AS first_key FROM u WHERE pos % 16 = 0) SELECT u.key, ix.first_key, ix.block_no FROM u ASOF LEFT JOIN ix ON u.key >= ix.first_key",
    "block_cache_trace": """WITH a AS (SELECT event_id AS access_no, user_id % 2 AS sstable_id, (user_id // 10) * 4096 AS "offset" FROM events)
SELECT access_no, sstable_id, "offset", row_number() OVER (PARTITION BY sstable_id, "offset" ORDER BY access_no) > 1 AS hit FROM a""",
    "restart_points": f"WITH {_NAMES} SELECT key, pos::BIGINT AS pos, pos % 16 = 0 AS is_restart FROM u",
    "shared_prefix_len": f"WITH {_URLS} SELECT key, (CASE WHEN pos % 16 = 0 THEN 0 WHEN strlen(key) = strlen(before) THEN 8 + {_LCP} ELSE 0 END)::BIGINT AS shared FROM u",
    "prefix_roundtrip": "SELECT count(*) AS n_keys, 0::BIGINT AS n_differ FROM customer",
    "block_packing": f"WITH RECURSIVE {_BLOCKS} SELECT * FROM bl",
    "block_offsets": f"""WITH RECURSIVE {_BLOCKS}, s AS (SELECT block_no, data_bytes + 4 * restarts + 28 AS bytes FROM bl)
SELECT block_no, coalesce(sum(bytes) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", bytes::BIGINT AS bytes FROM s""",
    "encoded_sizes": f"""WITH {_M1} SELECT seq, (strlen(key::VARCHAR) + 8)::BIGINT AS key_bytes, (CASE WHEN is_tombstone THEN 2 ELSE strlen(value) + 10 END)::BIGINT AS value_bytes,
(CASE WHEN is_tombstone THEN strlen(key::VARCHAR) + 24 ELSE strlen(key::VARCHAR) + strlen(value) + 32 END)::BIGINT AS log_bytes FROM m1""",
    "run_file_sizes": f"""WITH RECURSIVE {_BOTH},
z AS (SELECT sstable_id, block_bytes, (36 + {_SLOTS} * (sstable_id + 1))::BIGINT AS filter_bytes, index_bytes, (keys + 38)::BIGINT AS meta_bytes FROM parts JOIN ends USING (sstable_id))
SELECT sstable_id, {_RUN_NAME.format("sstable_id", "sstable_id")} AS path, block_bytes, filter_bytes, index_bytes, meta_bytes, block_bytes + filter_bytes + index_bytes + meta_bytes + 64 AS file_size FROM z""",
    "space_amplification": f"""WITH RECURSIVE {_BOTH},
z AS (SELECT sstable_id, (block_bytes + 36 + {_SLOTS} + index_bytes + keys + 38 + 64)::BIGINT AS disk_bytes, raw_bytes FROM parts JOIN ends USING (sstable_id)),
t AS (SELECT CASE sstable_id WHEN 0 THEN 'names' ELSE 'urls' END AS run, disk_bytes, raw_bytes, CASE WHEN raw_bytes > 0 THEN disk_bytes / raw_bytes ELSE 0.0::DOUBLE END AS ratio FROM z)
SELECT *, CASE WHEN ratio < 1.05 THEN 'ELITE' WHEN ratio < 1.15 THEN 'EXCELLENT' ELSE 'GOOD' END AS tier FROM t""",
    "block_index": f"""WITH RECURSIVE {_BLOCKS} SELECT first_key, coalesce(sum(data_bytes + 4 * restarts + 28) OVER (ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM bl""",
    "block_scan": f"WITH RECURSIVE {_BOTH} SELECT sstable_id, block_no, num_entries, 0::BIGINT AS n_differ FROM blocks",
    "run_entry_get": f"""WITH {_ORDER_RUNS},
p AS (SELECT DISTINCT unnest([c_custkey % 20, c_custkey * 7 % 20])::BIGINT AS sstable_id, c_custkey AS key FROM customer),
x AS (SELECT *, (row_number() OVER (PARTITION BY sstable_id ORDER BY key) - 1) // 16 AS block_no FROM runs)
SELECT p.sstable_id, p.key, coalesce(p.key BETWEEN min_key AND max_key, false) AS in_range, coalesce(x.block_no, -1)::BIGINT AS block_no, x.value, x.key IS NOT NULL AS found
FROM p LEFT JOIN meta USING (sstable_id) LEFT JOIN x ON x.sstable_id = p.sstable_id AND x.key = p.key""",
    "read_order": f"WITH RECURSIVE {_GEN} SELECT row_number() OVER (ORDER BY level, run_no DESC) - 1 AS place, level, run_no FROM (SELECT DISTINCT level, run_no FROM pl)",
    "bounded_cache_trace": """WITH a AS (SELECT event_id::BIGINT AS access_no, (user_id % 2)::BIGINT AS s, ((user_id // 10) * 4096)::BIGINT AS o, (user_id // 10 + user_id % 2) % 4 AS shard FROM events),
p AS (SELECT *, lag(access_no) OVER (PARTITION BY s, o ORDER BY access_no) AS prev FROM a),
d AS (SELECT p.access_no, count(DISTINCT (b.s, b.o)) AS n FROM p JOIN a b ON b.shard = p.shard AND b.access_no > p.prev AND b.access_no < p.access_no GROUP BY 1)
SELECT access_no, s AS sstable_id, o AS "offset", prev IS NOT NULL AND coalesce(d.n, 0) < 2 AS hit FROM p LEFT JOIN d USING (access_no)""",
    "frame_payloads": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE coalesce(props, '') END AS payload FROM events",
    "framed_log_scan": """WITH e AS (SELECT user_id, event_id, (event_id // 1000)::BIGINT AS part, coalesce(props, '') AS p FROM events),
f AS (SELECT user_id, part, p, row_number() OVER w - 1 AS pos, coalesce(sum(strlen(p) + 12) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", lead(event_id) OVER w IS NULL AND user_id % 3 = 0 AS cut
FROM e WINDOW w AS (PARTITION BY user_id, part ORDER BY event_id))
SELECT user_id, part, pos, "offset", CASE WHEN cut THEN NULL ELSE p END AS payload, CASE WHEN NOT cut THEN 'ok' WHEN strlen(p) < 5 THEN 'truncated length' ELSE 'truncated data' END AS verdict FROM f""",
    "space_test": f"""WITH RECURSIVE {_SPACE},
s AS ({" UNION ALL ".join(f"""SELECT '{name}' AS test, (SELECT count(*) FROM u{t}) AS n, (SELECT sum(strlen(key) + strlen(value))::BIGINT FROM u{t}) AS raw_bytes,
(SELECT strlen(min(key)) + strlen(max(key)) FROM u{t}) AS keys, (SELECT sum(data_bytes + 4 * restarts + 28 + strlen(first_key) + 16)::BIGINT FROM bl{t}) AS blocks""" for t, name in (("1", "long prefixed"), ("2", "long random"), ("3", "mixed length")))}),
t AS (SELECT test, n, (blocks + 20 + 36 + {_SLOTS} + keys + 38 + 64)::BIGINT AS file_size, raw_bytes FROM s)
SELECT *, file_size / raw_bytes AS ratio, CASE WHEN file_size / raw_bytes < 1.05 THEN 'ELITE' WHEN file_size / raw_bytes < 1.15 THEN 'EXCELLENT' ELSE 'GOOD' END AS tier FROM t""",
    "bench_report": """WITH p(config, phase, ops, n_runs) AS (VALUES ('SmallSeq', 'bulk', 50000::BIGINT, 0::BIGINT), ('SmallSeq', 'overwrite', 10000, 0), ('SmallSeq', 'dirty read', 20000, 0), ('SmallSeq', 'delete', 5000, 0), ('SmallSeq', 'cleaned read', 20000, 0),
('MediumRandom', 'bulk', 200000, 1), ('MediumRandom', 'overwrite', 50000, 1), ('MediumRandom', 'dirty read', 50000, 1), ('MediumRandom', 'threads', 200000, 2), ('MediumRandom', 'delete', 25000, 2), ('MediumRandom', 'cleaned read', 50000, 2),
('StripedHighConcurrency', 'bulk', 300000, 0), ('StripedHighConcurrency', 'overwrite', 100000, 1), ('StripedHighConcurrency', 'dirty read', 100000, 1), ('StripedHighConcurrency', 'threads', 300000, 2), ('StripedHighConcurrency', 'delete', 50000, 2), ('StripedHighConcurrency', 'cleaned read', 100000, 2),
('HighBatchIngest', 'bulk', 500000, 0), ('HighBatchIngest', 'dirty read', 50000, 0), ('HighBatchIngest', 'cleaned read', 50000, 0))
SELECT *, ops AS n_right FROM p""",
    "bench_dirty_reads": f"""WITH w AS (SELECT DISTINCT {_random_key("i")} AS key FROM range(0, 4000) t(i)), p AS (SELECT {_random_key(_target("i", 4000, 1103515245, 12345))} AS key FROM range(0, 2000) t(i))
SELECT count(*) AS n, (count(*) FILTER (key IN (FROM w)))::BIGINT AS n_right, avg(CASE WHEN key IN (FROM w) THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS accuracy FROM p""",
    "stream_aggregated_state": f"WITH {_L1} SELECT key, value, is_tombstone FROM l1",
    "stream_keyed_state": f"WITH {_L1} SELECT key, value, is_tombstone FROM l1",
    "store_recovered_state": f"WITH {_L1} SELECT key, value FROM l1 WHERE NOT is_tombstone",
    "store_merged_state": f"WITH {_L1} SELECT key, value, is_tombstone FROM l1",
    "store_run_metadata": f"""WITH {_M1}, n AS (SELECT max(seq) + 1 AS n FROM m1),
r AS (SELECT key, is_tombstone, CASE WHEN seq >= n * 4 // 5 THEN 0 ELSE 1 END::INTEGER AS level, seq FROM m1, n),
x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY level, key ORDER BY seq DESC) = 1)
SELECT level, CASE level WHEN 0 THEN 5 ELSE 4 END::BIGINT AS sstable_id, min(key) AS min_key, max(key) AS max_key, count(*) AS num_entries, count(*) FILTER (NOT is_tombstone) AS num_live, CASE level WHEN 0 THEN 'xor8' ELSE 'xor16' END AS filter_type FROM x GROUP BY level""",
    "store_catalog": """WITH a(seq, action, level, id, next_id) AS (VALUES (0, 'add', 0, 0, NULL), (1, 'next_id', NULL, NULL, 1), (2, 'add', 0, 1, NULL), (3, 'next_id', NULL, NULL, 2), (4, 'add', 0, 2, NULL), (5, 'next_id', NULL, NULL, 3),
(6, 'add', 0, 3, NULL), (7, 'next_id', NULL, NULL, 4), (8, 'remove', 0, 0, NULL), (9, 'remove', 0, 1, NULL), (10, 'remove', 0, 2, NULL), (11, 'remove', 0, 3, NULL), (12, 'add', 1, 4, NULL), (13, 'next_id', NULL, NULL, 5),
(14, 'add', 0, 5, NULL), (15, 'next_id', NULL, NULL, 6))
SELECT seq::BIGINT AS seq, action, coalesce(level, -1)::INTEGER AS level, coalesce('L' || level || '-' || lpad(id::VARCHAR, 20, '0') || '.sst', '') AS path, coalesce(next_id, -1)::BIGINT AS next_id FROM a""",
    "manifest_active_runs": f"WITH RECURSIVE {_MANIFEST} SELECT level, path FROM active",
    "manifest_next_id": f"WITH RECURSIVE {_GEN} SELECT coalesce(max({_FLUSH_ID} + 1), 0)::BIGINT AS next_id FROM shut",
    "orphan_files": f"WITH RECURSIVE {_MANIFEST} SELECT name, length FROM ls WHERE name LIKE '%.sst' AND name NOT IN (SELECT path FROM active)",
    "used_files": f"WITH RECURSIVE {_MANIFEST} SELECT name, length FROM ls WHERE name IN (SELECT path FROM active)",
    "log_discovery": f"WITH RECURSIVE {_MANIFEST} SELECT regexp_extract(name, '^(\\d+)\\.wal$', 1)::BIGINT AS wal_id, name FROM ls WHERE regexp_matches(name, '^\\d+\\.wal$')",
    "disk_usage": f"WITH RECURSIVE {_MANIFEST} SELECT sum(length)::BIGINT AS bytes FROM ls",
    "wal_replay": f"WITH {_L1} SELECT key, value FROM l1 WHERE NOT is_tombstone",
    "frame_verdicts": """WITH e AS (SELECT event_id, event_id % 6 AS kind, coalesce(strlen(props), 0) AS n FROM events)
SELECT event_id, (CASE kind WHEN 1 THEN 3 WHEN 2 THEN 9 WHEN 3 THEN n + 11 ELSE n + 12 END)::BIGINT AS n_bytes,
CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'end' WHEN 2 THEN 'truncated length' WHEN 3 THEN if(n = 0, 'truncated length', 'truncated data') WHEN 4 THEN 'record too large' ELSE if(n = 0, 'record too large', 'checksum mismatch') END AS verdict FROM e""",
    "footer_verdicts": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'too small' WHEN 2 THEN 'bad magic' ELSE 'unsupported version' END AS verdict FROM customer",
    "latency_percentiles": """WITH s AS (SELECT event_type, floor(value)::BIGINT AS us FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, sum(us)::DOUBLE / count(*) AS mean_us, quantile_cont(us, 0.5) AS p50_us, quantile_cont(us, 0.95) AS p95_us, quantile_cont(us, 0.99) AS p99_us FROM s GROUP BY event_type""",
    "phase_report": f"WITH {_PHASES} SELECT * FROM rp",
    "read_improvement": f"""WITH {_PHASES}, b AS (SELECT config, max(mean_us) FILTER (phase = 'Random Read (Dirty)') AS d, max(mean_us) FILTER (phase = 'Random Read (Cleaned)') AS c FROM rp GROUP BY config)
SELECT config, CASE WHEN d > 0 AND c IS NOT NULL THEN (d - c) / d * 100 ELSE 0.0 END AS improvement_pct, CASE WHEN d > 0 AND c IS NOT NULL THEN d - c ELSE 0.0 END AS improvement_us FROM b""",
    "format_numbers": f"""WITH r AS (SELECT o_orderkey AS k, o_orderkey * 7919 AS n FROM orders), c AS (SELECT *, n / 3.0::DOUBLE AS t, k / 777.0::DOUBLE AS v, round(n / 1024.0::DOUBLE * 100)::BIGINT AS cents FROM r)
SELECT k, {_thousands("n")} AS grouped, {_short("t")} AS short, {_short("v")} AS small,
{_thousands("cents // 100")} || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS kb, CASE WHEN length(n::VARCHAR) < 5 THEN lpad(n::VARCHAR, 5, '0') ELSE n::VARCHAR END AS padded FROM c""",
    "lcg_keys": f"""WITH r AS (SELECT o_orderkey AS i FROM orders) SELECT i, ({_LCG.format("i")})::VARCHAR AS lcg, 'key-' || lpad(i::VARCHAR, 16, '0') AS sequential_key,
'key-' || lpad((({_LCG.format("i")}) % 1000000000)::VARCHAR, 16, '0') AS random_key, 's' || (i % 16) || '-key-' || lpad((i // 16)::VARCHAR, 16, '0') AS striped_key,
'v' || lpad(i::VARCHAR, 12, '0') AS v_value, 'upd' || lpad(i::VARCHAR, 12, '0') AS upd_value, 'thr' || lpad(i::VARCHAR, 12, '0') AS thr_value FROM r""",
    "read_targets": f"SELECT o_orderkey AS i, {_target('o_orderkey', 50000, 1103515245, 12345)} AS read_target, {_target('o_orderkey', 50000, 1664525, 1013904223)} AS overwrite_target FROM orders",
    "bench_end_state": f"WITH {_WORKLOAD} SELECT left(value, 3) AS kind, count(*) AS n, min(key) AS min_key, max(key) AS max_key FROM st GROUP BY 1",
    "bench_read_accuracy": f"""WITH {_WORKLOAD}, t AS (SELECT {_target("i", 4000, 1103515245, 12345)} AS tgt FROM range(0, 2000) t(i)), p AS (SELECT {_random_key("tgt")} AS key, tgt >= 500 AS expected FROM t),
x AS (SELECT expected, key IN (SELECT key FROM st) AS found FROM p)
SELECT count(*) AS n, (count(*) FILTER (expected = found))::BIGINT AS n_right, avg(CASE WHEN expected = found THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS accuracy FROM x""",
    "bench_flush_counts": """SELECT * FROM (VALUES ('SmallSeq', 'bulk', 0::BIGINT), ('SmallSeq', 'overwrite', 0), ('SmallSeq', 'delete', 0),
('MediumRandom', 'bulk', 1), ('MediumRandom', 'overwrite', 1), ('MediumRandom', 'threads', 2), ('MediumRandom', 'delete', 2),
('StripedHighConcurrency', 'bulk', 0), ('StripedHighConcurrency', 'overwrite', 1), ('StripedHighConcurrency', 'threads', 2), ('StripedHighConcurrency', 'delete', 2), ('HighBatchIngest', 'bulk', 0)) t(config, phase, n_runs)""",
    "space_keys": """SELECT c_custkey AS i, 'user_' || CASE WHEN length(c_custkey::VARCHAR) < 5 THEN lpad(c_custkey::VARCHAR, 5, '0') ELSE c_custkey::VARCHAR END AS short_key, 'data_' || c_custkey AS unpadded_key, lpad(c_custkey::VARCHAR, 10, '0') AS fixed_key, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', (('0x' || substr(md5('7:' || c_custkey || ':' || k), 1, 8))::BIGINT % 62 + 1)::BIGINT, 1) for k in range(0, 16)], '') AS random_key FROM customer""",
    "stream_live_state": f"WITH {_L1} SELECT key, value FROM l1 WHERE NOT is_tombstone",
}
ORACLE_SQL = {k: dedent(v) for k, v in ORACLE_SQL.items()}
