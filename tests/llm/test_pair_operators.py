"""Near-duplicates, embeddings, nearest neighbours, components: against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, empty, near_pairs, plain_components, plain_fingerprint
from tidelog.llm import ann, components, metric_join, queries, simhash
from tidelog.llm.components import connected_components

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_groups(docs):
    fps = [plain_fingerprint(r.text) for r in docs]
    roots = plain_components(len(docs), near_pairs(fps))
    least = {}
    for r, root in zip(docs, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(r.doc_id, least.get(root, r.doc_id))
    return sorted((str(r.doc_id), format(f, "016x"), str(least.get(root))) for r, f, root in zip(docs, fps, roots, strict=True))


def test_simhash_against_brute_force(spark):
    got = queries.op4_simhash(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == plain_groups(docs)


def test_simhash_on_awkward_tables(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).select("id", simhash.hex_digits().alias("f"), "component_id").collect()
    assert sorted((str(r.id), r.f, str(r.component_id)) for r in got) == plain_groups(docs.collect())
    assert {r.component_id for r in got if r.f == "0" * 16} == {2}
    assert simhash.near_duplicates(empty(spark)).collect() == []
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 8, 9]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["Der Hund und die Katze"]
    assert simhash.one_of_each(empty(spark)).collect() == []


def test_one_of_each_where_texts_share_an_id(spark):
    a, b, c = ("the first text has these words in it and some more of them", "quite another one that is about boats, rivers and the sea", "a third of its own kind with nothing of the rest at all")
    table = [(3, a, "x"), (7, a, "y"), (7, b, "z"), (9, b, "u"), (8, c, "v"), (8, c, "w"), (5, c, "t"), (11, "one more that nobody else has here", "s")]
    found = lambda rows: sorted((r.doc_id, r.text) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, k string")).collect())
    assert found(table) == sorted([(3, a), (7, b), (5, c), (11, table[-1][1])])
    assert found([(6, a, "x"), (6, b, "y"), (6, b, "z"), (9, a, "u")]) == sorted([(6, a), (6, b)])


def test_one_of_each_of_rows_without_ids_and_of_clashing_names(spark):
    a, b, c = ("the first text has these words in it and some more of them", "quite another one that is about boats, rivers and the sea", "a third of its own kind with nothing of the rest at all")
    rows = [(None, a), (None, a), (None, b), (4, b), (1, a + " x" * 0), (None, c), (1, c)]
    names = ["__fp", "__key", "__id", "__head", "__KEY_", "fp", "id", "root", "least", "a.b"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(*r, *("v" + n for n in names)) for r in rows], schema)
    for own, want in ((df, [(1, a), (1, c), (4, b)]), (df.where("doc_id is null"), [(None, a), (None, b), (None, c)])):
        got = simhash.one_of_each(own)
        assert got.columns == df.columns and sorted((str(r[0]), r[1]) for r in got.collect()) == sorted((str(i), t) for i, t in want)
        assert all(r[2:] == tuple("v" + n for n in names) for r in got.collect())


def test_long_texts_are_fingerprinted_by_chunks(monkeypatch):
    text = " ".join(f"w{i * i % 101}" for i in range(3000)) + "\n\n tail"
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == want
    for short in ("", None, "one", "one two three", "ÄÖ one two three four five"):
        assert simhash.fingerprint(short) == plain_fingerprint(short)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6, 7])
def test_bit_planes_against_counts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.uint64(sum(1 << int(j) for j in rng.choice(64, k, replace=False))) for b in base for k in rng.integers(0, 10, 30)], np.uint64))
    got = simhash.within(simhash.bit_planes(fps), len(fps), fps[:70], radius)
    want = np.bitwise_count(fps[:70, None] ^ fps[None, :]) <= radius
    assert np.array_equal(got if got is not None else np.zeros_like(want), want)
    far = rng.integers(0, 2**63, 90, dtype=np.uint64)
    assert simhash.within(simhash.bit_planes(far), 90, ~far[:1], 0) is None or radius == 0


def test_links_of_a_crowded_bucket_dealt_over_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 4)
    fps = sorted({int(b) ^ sum(1 << int(j) for j in rng.choice(20, k, replace=False)) for b in base for k in rng.integers(0, 9, 100)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block, blocks in ((8, 5), (4096, 5), (4096, None), (16, 6), (4096, 7), (8, 8)):
        edges = [(r.a, r.b) for r in simhash.links(df, block=block, blocks=blocks).collect()]
        at = {f: i for i, f in enumerate(fps)}
        assert plain_components(len(fps), [(at[a], at[b]) for a, b in edges]) == plain_components(len(fps), near_pairs(fps))


def test_blocks_of_bits_grow_with_the_fingerprints():
    found = [simhash.blocks_for(n) for n in (0, 10**3, 10**6, 10**8, 10**9, 10**11, 10**13)]
    assert found[0] == 5 and found == sorted(found) and found[-1] >= 8


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = np.random.default_rng(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, int(j)) for j in rng.integers(501, 600, 60)] + [(7, 7), (3, None), (None, None), (900, 901), (901, 900), (900, 901)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None]
    roots = plain_components(1000, real)
    assert got == {i: r for i, r in enumerate(roots) if i != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_links(rows, least=0.95):
    good = [i for i, r in enumerate(rows) if r.vec_id is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    units = {i: np.array(rows[i].embedding, float) / np.linalg.norm(np.array(rows[i].embedding, float)) for i in good}
    pairs = [(a, b) for n, a in enumerate(good) for b in good[n + 1 :] if len(units[a]) == len(units[b]) and units[a] @ units[b] >= least]
    links = np.zeros(len(rows), int)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    roots = plain_components(len(rows), pairs)
    out = []
    for i, r in enumerate(rows):
        own = min((rows[j].vec_id for j in range(len(rows)) if roots[j] == roots[i] and rows[j].vec_id is not None), default=None)
        out.append((str(r.vec_id), int(links[i]), str(own), own == r.vec_id))
    return sorted(out)


def clustered(spark, n=400, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dim) * (0.25 if i % 2 else 0.9)
        rows.append((i * 3 % n, (v * (1 + i % 5)).astype(np.float32).tolist(), i))
    rows += [(n + i, rows[i][1], 0) for i in range(20)]
    rows += [(n + 100, None, 0), (n + 101, [], 0), (n + 102, [0.0] * dim, 0), (n + 103, [float("nan")] + [1.0] * (dim - 1), 0), (n + 104, [float("inf")] + [1.0] * (dim - 1), 0), (n + 105, [1.0, 2.0], 0), (n + 106, [2.0, 4.0], 0), (None, rows[0][1], 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    return df.withColumn("embedding", F.when(F.col("vec_id") == n + 107, None).otherwise(F.col("embedding"))).withColumn("unit", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("n_links", F.lit(0))


@pytest.mark.parametrize("block", [16, 70, 4096])
def test_metric_join_against_brute_force(spark, block):
    df = clustered(spark)
    got = metric_join.linked(df, block=block).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got if r.vec_id is not None) == [x for x in plain_links(df.collect()) if x[0] != "None"]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_metric_join_of_many_lengths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2 + i % 9).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(300 + i, [x * 2 for x in rows[i][1]], 0) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    want = plain_links(df.collect())
    for most in (4096, 3):
        monkeypatch.setattr(metric_join, "MAX_LENGTHS", most)
        for block in (8, None):
            got = metric_join.linked(df, block=block).collect()
            assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want


def test_cells_prune_where_vectors_lie_in_clusters():
    """Clusters far apart: vectors visit few blocks. Rings part a cell that is too large; every near pair still meets."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 24)) * 0.05
    u = rng.permutation(x / np.linalg.norm(x, axis=1, keepdims=True))
    r = np.sqrt(2 - 2 * 0.95)
    for pivots, block, most in ((metric_join.choose_pivots(u[:2000], len(u), 250, r), 250, 3.0), (u[:1], 250, None)):
        d = metric_join._distances(u, pivots)
        home, dist = d.argmin(axis=1), d.min(axis=1)
        step = (dist * (metric_join.RINGS / r)).astype(int)
        counts = {}
        for c, s, v in zip(home.tolist(), step.tolist(), dist.tolist(), strict=True):
            n, lo, hi = counts.get((c, s), (0, v, v))
            counts[c, s] = (n + 1, min(lo, v), max(hi, v))
        cells = metric_join.Cells(pivots, r, 5, counts, block)
        own = cells.home(home, step, rng.integers(0, 1 << 20, len(u)))
        assert np.bincount(own - 5).max() <= 1.5 * block + 50 and cells.end == 5 + len(cells.numbers)
        who, to = cells.visits(u, home, own)
        assert most is None or len(who) <= most * len(u)
        there = set(zip(who.tolist(), to.tolist(), strict=True))
        a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
        assert len(a) > 10_000
        for i, j in zip(a[::97].tolist(), b[::97].tolist(), strict=True):
            assert ((i, own[j]) in there) + ((j, own[i]) in there) == 1 + (own[i] == own[j])


def test_metric_join_of_whole_tables(spark):
    assert metric_join.linked(spark.createDataFrame([], VECTORS)).collect() == []
    got = queries.op5_metric_join(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == plain_links(rows)


def plain_nearest(rows, every, k=10):
    good = [r for r in rows if r.vec_id is not None and r.embedding and len(r.embedding) == len(rows[0].embedding) and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in good]), np.array([r.embedding for r in good], float)
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        d = np.sqrt(((x - x[int(np.flatnonzero(ids == q)[0])]) ** 2).sum(axis=1))
        keep = ids != q
        order = np.lexsort((ids[keep], d[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order].tolist(), strict=True))
    return out


def test_nearest_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    want = plain_nearest(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), 100)
    got = {}
    for r in queries.op9_ann(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.keys() == want.keys() and all([x[0] for x in v] == list(range(1, 11)) for v in got.values())
    hits = sum(len({x[1] for x in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    scores = {(q, i): d for q in want for i, d in want[q]}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q, v in got.items() for _, i, s in v if (q, i) in scores)


@pytest.mark.parametrize("block", [16, 4096])
def test_nearest_neighbours_on_awkward_tables(spark, block):
    df = clustered(spark, 121)
    got = {}
    for r in ann.nearest(df, F.col("id") % 5 == 0, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = plain_nearest(df.collect(), 5)
    assert got.keys() == want.keys()
    assert all(len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda x: (x[1], x[0])) and q not in {i for i, _ in got[q]} for q in want)
    assert sum((Counter(i for i, _ in got[q]) & Counter(i for i, _ in want[q])).total() for q in want) >= 0.9 * 10 * len(want)
    assert ann.nearest(spark.createDataFrame([], VECTORS), F.col("id") % 20 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.0], 0)], VECTORS)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few, F.col("id") == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(few.limit(1), F.col("id") == 0).collect() == []


def test_an_index_finds_all_codes_within_the_radius():
    """Pigeonhole: by look-up of flipped bits or by comparison, what the index finds is what all distances say."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 32)), 10, axis=0) + rng.normal(size=(600, 32)) * 0.02
    index = ann.learn(x, 5)
    assert index.width == 16 and index.reached < 0.1 and index.radius < 48
    for width, radius in ((16, index.radius), (16, 7), (16, 40), (32, 25), (64, 90), (128, 60), (16, 140)):
        index.width, index.radius = width, radius
        block = ann.Block(index, np.arange(600), x)
        assert block.lookups == (width == 16 and radius < 100)
        asked = block.codes[:80]
        want = np.bitwise_count(asked[:, None, :] ^ block.codes[None]).sum(2) <= radius
        a, b = block.within(asked)
        got = np.zeros_like(want)
        got[a, b] = True
        assert np.array_equal(got, want) and len(a) == want.sum()
        assert (ann.probed(index, block.codes, asked, width) >= want).all()


def test_codes_of_long_vectors_keep_their_neighbours():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(150, 600)), 4, axis=0) + rng.normal(size=(600, 600)) * 0.3
    index = ann.learn(x, 3)
    assert index.rotations.shape == (600, ann.BITS) and index.codes(x).shape == (600, ann.BITS // 64)
    block = ann.Block(index, np.arange(600), x)
    a, b, d = block.search(np.arange(600), x, 3)
    assert np.mean(a // 4 == b // 4) > 0.95 and (np.diff(d.reshape(600, 3)) >= 0).all()


def test_queries_take_bounds_along_to_later_blocks(spark, monkeypatch):
    df = clustered(spark, 300)
    every = F.col("id") % 4 == 0
    want = sorted(r[:] for r in ann.nearest(df, every, block=8).collect())
    monkeypatch.setattr(ann, "MANY", 1000)
    assert sorted(r[:] for r in ann.nearest(df, every, block=8).collect()) == want and len(want) >= 300


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_only_by_either_side_or_a_shuffle(spark, monkeypatch, few):
    from tidelog.llm import common

    monkeypatch.setattr(common, "FEW", few)
    df = spark.createDataFrame([(i if i % 9 else None, str(i)) for i in range(60)], "id long, __text string")
    keys = spark.range(60).withColumnRenamed("id", "key")
    for wanted, others in (("key % 20 = 1", "key % 20 <> 1"), ("key % 20 <> 1", "key % 20 = 1")):
        got = common.only(df, F.col("id"), keys.where(wanted), keys.where(others))
        assert got.columns == df.columns
        assert sorted(r.id for r in got.collect()) == [i for i in range(60) if i % 9 and (i % 20 == 1) == (wanted == "key % 20 = 1")]
