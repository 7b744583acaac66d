"""Tokens, binary files, packing, mixing and the pipeline."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, crc, empty, near_pairs, plain_components, plain_fingerprint
from tidelog.llm import langid, mixing, packing, queries, secrets, tokenbin
from tidelog.llm.tokens import Encoder

SF, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
WORDS, BYTES = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_cached_ids_are_the_library_s(spark, path):
    rng, plain, enc = random.Random(1), library(path), Encoder(path)
    letters = [*"aé .,\n\t '|!3Σİß́ \x1f\x00日本ẖA\u0085​　Ž", "  ", "'s", "<|endoftext|>", " the", "\r\n", " ,", "2.0"]
    letters += ["<|", "|>", "<|startoftext|>", "<|EndOfText|>", "endoftext"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(4000)] + ["a <|endoftext|> b"] + [r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()] + [None, ""]
    for _ in range(2):
        for t, ids in zip(texts, enc.ids(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain(t), t


def test_texts_with_added_tokens_in_files_and_windows(spark):
    texts = ["a <|endoftext|> b", "<|startoftext|>", "plain", None, "<|endoftext|>" * 900, "<|END"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((str(r[0]), *r[1:]) for r in tokenbin.round_trip(docs, WORDS).collect()) == plain_files(docs.collect())
    check_packing(packing.packed(docs, BYTES).collect(), docs.collect())
    assert np.frombuffer(Encoder(WORDS).ids(texts[:1])[0], "<u4").tolist() == [320, 49407, 321]


def test_a_full_cache_is_pruned(monkeypatch):
    from tidelog.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 50)
    monkeypatch.setattr(tokens, "AT_ONCE", 200)
    enc, plain = Encoder(WORDS), library(WORDS)
    texts = [f"word{i} and {chr(97 + i % 26) * (i % 9 + 1)} the end, of it." for i in range(200)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == [plain(t) for t in texts]
    assert len(enc.known) < 400


def test_coding_round_trips():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 3), (700, 50), (200_000, 60_000), (tokenbin.BLOCK, 9), (tokenbin.BLOCK * 2 + 1, 300)):
        ids = np.minimum(rng.zipf(1.3, n), top).astype(np.int64)
        counts = Counter(ids.tolist())
        for table in (tokenbin.Table.of(dict(counts)), tokenbin.Table.of(dict(counts), most=2), tokenbin.Table.of({7: 1})):
            assert table.freq.sum() == 1 << tokenbin.BITS and (table.freq > 0).all()
            again = tokenbin.Table.read(table.image())
            points, blocks = tokenbin.encode_blocks(ids, table)
            assert np.array_equal(tokenbin.decode_blocks(memoryview(b"".join(blocks)), points, n, again), ids)
            last = points[-1:].copy()
            if n > tokenbin.BLOCK and n % tokenbin.BLOCK:
                whole = tokenbin.decode_blocks(memoryview(b"".join(blocks)), points[:1], tokenbin.BLOCK, again)
                assert np.array_equal(whole, ids[: tokenbin.BLOCK]) and last["offset"] > 0


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.int64) % 91
    table = tokenbin.Table.of(dict(Counter(ids.tolist())))
    raw = bytearray(tokenbin.segment([1, None], [4000, 1000], ids, 0, table, 5))
    docs, lengths, back, before = tokenbin.read_segment(bytes(raw), table, 5)
    assert (docs, lengths.tolist(), before) == ([1, None], [4000, 1000], 0) and np.array_equal(back, ids)
    raw[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        tokenbin.read_segment(bytes(raw), table, 5)
    with pytest.raises(ValueError, match="damaged"):
        tokenbin.Table.read(table.image()[:-1] + b"\0\0"[:1] if table.image()[-1] else table.image()[:-1] + b"\1")


def plain_files(docs, end=1):
    plain = library(WORDS)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, ids) for r in docs for ids in [[*plain(r.text), end]]), key=lambda x: (x[0], x[1], len(x[2]), crc(x[2])))
    out, at = [], 0
    for known, doc, ids in rows:
        out.append((str(doc if known else None), at, len(ids), crc(ids)))
        at += len(ids)
    return sorted(out)


def test_token_files_against_the_library(spark):
    got = queries.op7_token_ids(spark, SF).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_files(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_token_files_of_awkward_tables(spark, tmp_path):
    docs = awkward(spark)
    tokenbin.write_ids(docs, WORDS, str(tmp_path / "a"), segment_ids=100, part_ids=1000)
    got = tokenbin.read_ids(spark, str(tmp_path / "a"), with_ids=True).collect()
    assert sorted((str(r[0]), *r[1:4]) for r in got) == plain_files(docs.collect())
    assert all(crc(r.ids) == r.ids_crc32 and r.ids[-1] == 1 for r in got)
    assert tokenbin.round_trip(empty(spark), WORDS).collect() == []


def check_packing(pieces, docs, end=0, capacity=1024):
    """Every id in exactly one piece, windows without gaps; returns the padding, none at a power of two."""
    plain = library(BYTES)
    want = Counter((str(r.doc_id), tuple(ids)) for r in docs for ids in [[*plain(r.text), end]])
    texts = {}
    for (doc, ids), n in want.items():
        texts.setdefault(doc, []).extend([ids] * n)
    by_doc, windows = {}, {}
    for p in pieces:
        by_doc.setdefault(str(p.doc_id), []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        expected = sorted((s, min(capacity, len(ids) - s), crc(ids[s : s + capacity]), len(ids)) for ids in texts[doc] for s in range(0, len(ids), capacity))
        assert sorted(own) == expected
    padding = 0
    for of in windows.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    pieces = queries.op8_packing(spark, SF).collect()
    assert check_packing(pieces, docs) <= 0.01 * sum(p.length for p in pieces)


def test_packing_awkward_tables(spark):
    docs = awkward(spark)
    check_packing(packing.packed(docs, BYTES).collect(), docs.collect())
    check_packing(packing.packed(docs.repartition(3), BYTES, flush=2).collect(), docs.collect())
    assert packing.packed(empty(spark), BYTES).collect() == []


def test_fill_is_the_closest_multiset():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(5, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        counts = [lengths.count(n) for n in range(capacity + 1)]
        found = packing.fill(counts, capacity)
        assert all(c <= counts[n] for n, c in found)
        longest = max(lengths)
        rest = list(lengths)
        rest.remove(longest)
        sums = {0}
        for n in rest:
            sums |= {s + n for s in sums}
        assert sum(n * c for n, c in found) == longest + max(s for s in sums if s + longest <= capacity)


def test_packing_many_lengths_leaves_little():
    lengths = np.random.default_rng(1).integers(1, 1024, 20_000)
    window, offset, n = packing.pack(lengths)
    fill = np.bincount(window, lengths, n)
    assert fill.max() <= 1024 and (1024 * n - lengths.sum()) <= 0.006 * lengths.sum()
    assert all(np.array_equal(np.sort(offset[window == w]), np.cumsum([0, *lengths[window == w][np.argsort(offset[window == w])]])[:-1]) for w in range(0, n, 997))


def test_mixing_equals_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op10_mixing"]).df()
    got = queries.op10_mixing(spark, SF).toPandas()
    order = ["doc_id", "copy_no"]
    cols = sorted(got.columns)
    a, b = (d.sort_values(order)[cols].reset_index(drop=True) for d in (got, want))
    assert a.equals(b) and sorted(want.columns) == cols


def test_mixing_reaches_its_targets(spark):
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 300 == 1, "rare").otherwise("other").alias("source"))
    got = {r.source: r["count"] for r in mixing.mixed(df, {"hot": 1, "rare": 2, "other": 1, "none": 5}, total=40_000).groupBy("source").count().collect()}
    assert abs(got["hot"] - 40_000 / 4) < 400 and abs(got["rare"] - 40_000 / 2) < 600 and abs(got["other"] - 40_000 / 4) < 400
    counts = mixing.mixed(df.where("source = 'rare'"), total=600).groupBy("doc_id").count().count()
    assert abs(counts - 200 * (1 - np.exp(-3))) < 15
    assert mixing.mixed(df, {"hot": 1}).where("source <> 'hot'").count() == 0


def test_poisson_steps(spark):
    for rate in (0.0, 0.1, 3.0, 50.0, 200.0, 2000.0, 1e6, 1e8):
        r = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s"), mixing.first_step(F.lit(rate)).alias("f")).first()
        steps = np.array(r.s)
        if rate:
            mean = r.f + (1 - np.minimum(1, steps)).sum()
            assert abs(mean - rate) < 1e-6 * max(1, rate) and steps[-1] == pytest.approx(1, abs=1e-8) and len(steps) < 30 * np.sqrt(rate) + 60
            spread = np.diff(np.concatenate([[0], steps])) @ (r.f + np.arange(len(steps)) - rate) ** 2
            assert spread == pytest.approx(rate, rel=1e-6)
        else:
            assert steps.tolist() == [1.0]


def test_poisson_steps_from_the_middle_are_those_from_zero(spark):
    """At a rate whose table begins above 0, against exact sums."""
    from fractions import Fraction
    from math import exp

    rate, term, total, want = 400, Fraction(1), Fraction(0), []
    for k in range(700):
        total += term
        want.append(total)
        term = term * rate / (k + 1)
    r = spark.range(1).select(mixing.poisson_steps(F.lit(float(rate))).alias("s"), mixing.first_step(F.lit(float(rate))).alias("f")).first()
    assert r.f > 100
    assert np.allclose(r.s, [float(want[r.f + i] / total) for i in range(len(r.s))], rtol=1e-9, atol=1e-15) and exp(-rate) > 0


def test_a_very_large_rate_is_dealt_by_blocks(spark, monkeypatch):
    df = spark.range(1001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "one").otherwise("rest").alias("source"))
    got = mixing.mixed(df, total=2_000_000).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("m"))
    by = {r.doc_id: r for r in got.collect()}
    assert abs(by[7].n - 1_000_000) < 6_000 and len(by) == 1001 and all(r.n == r.d == r.m + 1 for r in by.values())
    small = df.where("doc_id < 60")
    want = sorted(r[:] for r in mixing.mixed(small, total=9000).collect())
    monkeypatch.setattr(mixing, "COPIES", 50)
    assert sorted(r[:] for r in mixing.mixed(small, total=9000).collect()) == want
    plan = mixing.mixed(small, total=9000)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_leaves_clashing_columns_alone(spark):
    names = ["__mix_source", "__mix_steps", "__mix_first", "__mix_n", "__mix_copy", "__MIX_KEY", "rate", "source_", "a.b"]
    df = spark.createDataFrame([(1, "a", *names), (2, "b", *names)], "doc_id long, source string, " + ", ".join(f"`{n}` string" for n in names))
    got = mixing.mixed(df, total=20, mark=False)
    assert got.columns == df.columns and {r[2:] for r in got.collect()} == {tuple(names)}
    assert mixing.mixed(df, total=20).columns == ["copy_no", "shuffle_key", *df.columns]


def test_mixing_awkward_tables(spark):
    docs = awkward(spark).withColumn("shuffle_key", F.lit(1))
    got = mixing.mixed(docs, total=60).collect()
    assert {r.source for r in got} == {None, "a", "b", "c"} and sorted(mixing.mixed(docs).columns) == sorted(docs.columns)
    counts = Counter(r.doc_id for r in got)
    assert counts[1] % 2 == 0 and [r.shuffle_key for r in got if r.doc_id == 5] == [r.shuffle_key for r in mixing.mixed(docs, total=60).collect() if r.doc_id == 5]
    assert mixing.mixed(docs, mark=False).columns == docs.columns
    assert mixing.mixed(empty(spark)).collect() == [] and mixing.mixed(docs, {}).collect() == []


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 40).cast("string").alias("source"))
    want = sorted(r[:] for r in mixing.mixed(df).collect())
    for name, few in (("FEW_SOURCES", 5), ("FEW_STEPS", 100)):
        with monkeypatch.context() as m:
            m.setattr(mixing, name, few)
            assert sorted(r[:] for r in mixing.mixed(df).collect()) == want


def test_no_python_in_the_mixing(spark):
    plan = queries.op10_mixing(spark, TINY)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_stages(docs, model):
    """The stages but the last one by one in plain Python; the language model is the operator's own."""
    docs = [d for d in docs if not model.predict(d["text"])[2]]
    fps = [plain_fingerprint(d["text"]) for d in docs]
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    roots = plain_components(len(docs), near_pairs(fps))
    order = sorted(range(len(docs)), key=lambda i: (docs[i]["doc_id"] is None, docs[i]["doc_id"] or 0, signed[i]))
    heads, kept = {}, []
    for i in order:
        if heads.setdefault(roots[i], i) == i:
            kept.append(docs[i])
    for d in kept:
        spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, d["text"]) if len(m[r.group]) >= r.least)
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [d["text"][at:s], "[SECRET]"]
            at = max(at, e)
        d["text"] = "".join(out) + d["text"][at:]
    con = duckdb.connect()
    con.register("docs_df", pa.Table.from_pylist(kept))
    con.sql("create view documents as select doc_id, text, lang, source, n_chars from docs_df")
    return kept, list(con.sql(queries.ORACLE_SQL["op10_mixing"]).df().astype({"doc_id": "Int64"}).itertuples(index=False))


def test_pipeline_against_plain_stages(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{TINY}/documents.parquet").orderBy("doc_id").collect()]
    kept, mixed = plain_stages(docs, langid.train(spark.read.parquet(f"{TINY}/documents.parquet")))
    assert check_packing(corpus_pipeline.run(spark, TINY).collect(), mixed) < 2048
    assert 0 < len(kept) < 200


def test_pipeline_of_an_awkward_table(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, copies, secrets, columns with the stages' own names."""
    own = ["__fp", "__key", "__id", "__head", "__secret_blob", "__secret_spans", "__secret_text", "__mix_n", "__mix_copy", "__mix_key", "fp", "root", "rate", "Text_", "a.b"]
    rows = awkward(spark)
    tiny = spark.read.parquet(f"{TINY}/documents.parquet").where("doc_id < 120")
    both = tiny.unionByName(rows.select(*tiny.columns)).unionByName(rows.select(*tiny.columns).where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    for name in [*rows.columns[5:], *own]:
        both = both.withColumn(name, F.lit(name))
    both.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.select(*(F.col(f"`{c}`") for c in docs.columns[5:])).distinct().count() == 1
    plain = sorted((r.asDict() for r in docs.select(*tiny.columns).collect()), key=lambda d: (d["doc_id"] is None, d["doc_id"] or 0))
    kept, mixed = plain_stages(plain, langid.train(docs))
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), [r._replace(doc_id=None if r.doc_id is pd.NA else int(r.doc_id)) for r in mixed])
    assert len(kept) < len(plain) and sum(d["doc_id"] is None for d in kept) > 0


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns or name == "packing"
        assert stage(spark, docs.limit(0), TINY).collect() == []


def test_long_texts_are_read_in_small_batches(spark, tmp_path):
    path, fresh = str(tmp_path / "t"), spark.newSession()
    fresh.createDataFrame([(i, "x" * 2000) for i in range(5000)], "doc_id long, text string").coalesce(1).write.parquet(path)
    read = queries.in_small_batches(lambda s, p: s.read.parquet(p))

    def batches(df):
        assert len(df.collect()) == 5000
        plan = df._jdf.queryExecution().executedPlan()
        while plan.nodeName() != "ColumnarToRow":
            plan = plan.children().apply(0)
        return plan.metrics().apply("numInputBatches").value()

    assert batches(read(fresh, path)) >= 5000 / 512
    fresh.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")
    assert batches(read(fresh, path)) == 50


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert queries.ORACLE_SQL.keys() <= queries.QUERIES.keys()
