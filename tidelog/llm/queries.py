"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import ann, langid, licenses, metric_join, mixing, packing, secrets, simhash, tokenbin, toxicity
from tidelog.llm.common import table


#: Rows of a batch, of Arrow's and of the Parquet reader's, that the registered queries and the pipeline's stages ask Spark
#: for: whole texts are long, and a reader's batch lies in the heap, in arrays of up to twice its size. The operators themselves
#: leave the session alone and bound what they take from a batch.
BATCH_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.parquet.columnarReaderBatchSize": 512}


def in_small_batches(query: Callable) -> Callable:
    """The query, in a session whose batches have BATCH_ROWS rows at most: the same for all, whichever runs first."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        for name, rows in BATCH_ROWS.items():
            if not 0 < int(spark.conf.get(name)) <= rows:
                spark.conf.set(name, str(rows))
        return query(spark, *args)

    return run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.lit(2) - F.coalesce(F.col("quality"), F.lit(1)))
    return toxicity.severity(docs, toxicity.train(docs, labels, grade))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.linked(table(spark, sf_dir, "embeddings"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source the same share of the corpus, in documents."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: in_small_batches(f) for f in (op1_langid, op2_licenses, op3_toxicity, op4_simhash, op5_metric_join, op6_secrets, op7_token_ids, op8_packing, op9_ann, op10_mixing)}


def _secrets_sql() -> str:
    """Places from the lengths of the matches and of what lies between them, rule by rule."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}', 0) AS whole,
regexp_extract_all(t, '{p}', {r.group}) AS val, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')""")
    counts = ", ".join(f"(count(*) FILTER (rank = {i}))::BIGINT AS n_{r.kind}" for i, r in enumerate(secrets.BASE))
    listed = "string_agg(kind || ':' || b || ':' || (b + n), ',' ORDER BY b, rank)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
s AS (
  SELECT doc, rank, kind, least, length(val[i]) AS size, length(whole[i]) AS n,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::BIGINT AS b FROM i
),
g AS (
  SELECT doc, {counts}, {listed} AS spans, {listed} FILTER (rank < {len(secrets.BASE)}) AS base FROM s WHERE size >= least GROUP BY doc
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
FROM d LEFT JOIN g USING (doc)
"""


ORACLE_SQL = {
    "op5_metric_join": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {metric_join.MIN_COSINE}),
r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.n),
c AS (SELECT n AS vec_id, min(c) AS component_id FROM r GROUP BY n),
l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(l.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN l USING (vec_id)
""",
    "op6_secrets": _secrets_sql(),
    "op10_mixing": f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE * (SELECT count(*) FROM documents)::DOUBLE / n::DOUBLE AS rate FROM sizes),
steps AS (
  SELECT source, rate, 0 AS k, -rate AS lg, exp(-rate) AS cum FROM rates
  UNION ALL
  SELECT source, rate, k + 1, lg + ln(rate) - ln((k + 1)::DOUBLE), cum + exp(lg + ln(rate) - ln((k + 1)::DOUBLE)) FROM steps
  WHERE k + 1 <= ceil(rate + 12.0 * sqrt(rate) + 24.0)
),
u AS (SELECT *, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {mixing.DIGITS}))::BIGINT::DOUBLE / {int(mixing.SCALE)}.0 AS x FROM documents),
counted AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(s.k) AS n
  FROM u LEFT JOIN steps s ON s.source IS NOT DISTINCT FROM u.source AND s.cum <= u.x
  GROUP BY ALL
)
SELECT g.i::INTEGER AS copy_no, md5('{mixing.SEED}:shuffle:' || coalesce(doc_id::VARCHAR, '') || ':' || g.i) AS shuffle_key,
       doc_id, text, lang, source, n_chars
FROM counted, LATERAL (SELECT unnest(range(n)) AS i) g
""",
}
