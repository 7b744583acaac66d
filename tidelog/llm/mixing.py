"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its target share of the corpus over its size. Each document's uniform number comes from
a hash of its id and a seed; inverting the Poisson distribution function of the rate at that number gives its count of
copies. The function is tabulated once a source, only where it is neither 0 nor 1 to the precision of the uniform numbers:
some 24 standard deviations, so a table grows with the root of its rate. Counts are exploded (long ones in blocks of COPIES
that tasks share), and copies are dealt and sorted by a second hash: a global shuffle that any rerun repeats.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import free, let, named, parts, run_through, scanned

SEED = "tidelog"
#: Sources whose rates reach the driver at most, and steps of all tables that are broadcast at most (8 bytes each);
#: beyond either, documents meet their source's table by shuffle.
FEW_SOURCES, FEW_STEPS = 10_000, 2_000_000
#: Counts from which the series used here is exact to the last digits of a double.
SERIES = 64
#: Copies of a document that one task makes.
COPIES = 4096
#: The uniform numbers are multiples of 2^-52.
DIGITS, SCALE = 13, float(1 << 52)


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the seed and the key (null counts as an empty key)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(SCALE)


def _spread(rate: Column) -> Column:
    return F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)


def first_step(rate: Column) -> Column:
    """The count below which no uniform number leads: 0 for all but large rates, from SERIES up for those."""
    first = F.floor(rate - _spread(rate)).cast("long")
    return F.when(first >= SERIES, first).otherwise(F.lit(0).cast("long"))


def poisson_steps(rate: Column) -> Column:
    """P(count <= k) for k = first_step, ... as far as a multiple of 2^-52 can tell; terms are summed from logarithms.

    The first term is exp(-rate) where first_step is 0, else it comes from Stirling's series.
    """
    first, last = first_step(rate), F.ceil(rate + _spread(rate)).cast("long")
    k = first.cast("double")
    series = F.lit(1.0) / (12 * k) - F.lit(1.0) / (360 * k * k * k) + F.lit(1.0) / (1260 * k * k * k * k * k)
    far = -F.lit(0.5) * F.log(F.lit(2 * math.pi) * k) - series - (k * F.log1p((k - rate) / rate) + rate - k)
    start = F.when(first == 0, F.negative(rate)).otherwise(far)

    def steps(zero: Column) -> Column:
        def advance(s: Column, k: Column) -> Column:
            log = s["log"] + F.log(rate) - F.log(k.cast("double"))
            return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

        more = run_through(F.sequence(first + 1, last), zero, advance, lambda s, k: F.array(advance(s, k)["sum"]), "double")
        return F.concat(F.array(zero["sum"]), more)

    return F.when(rate > 0, let(F.struct(start.alias("log"), F.exp(start).alias("sum")), steps)).otherwise(F.array(F.lit(1.0)))


def rates(df: DataFrame, weights: Mapping[str | None, float] | None = None, source_col: str = "source", size: Column | None = None, total: float | None = None) -> DataFrame:
    """(source, rate): target share times the total size over the source's size.

    `weights` maps sources to target weights (those left out get none); without it every source weighs the same. A null
    source is a source of its own. The size of a document is 1 unless given; the total is the corpus's own unless given.
    """
    sizes = df.groupBy(named(source_col).cast("string").alias("source")).agg(F.sum(size if size is not None else F.lit(1)).cast("double").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("w", F.lit(1.0))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, w double")
        sizes = sizes.join(given, sizes.source.eqNullSafe(given.k), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = sizes.agg(F.sum("w").alias("w"), F.sum("size").alias("size")).first()
    mass, all_w = float(total if total is not None else sums["size"] or 0.0), float(sums["w"] or 0.0)
    rate = F.col("w") / F.lit(all_w or 1.0) * F.lit(mass) / F.col("size")
    return sizes.select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def mixed(
    df: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    total: float | None = None,
    seed: str = SEED,
    mark: bool = True,
) -> DataFrame:
    """The rows of `df`, each as often as its count says, globally shuffled.

    With `mark`, columns copy_no (from 0) and shuffle_key come first, in place of any such columns of `df`. Rows with
    equal ids get equal counts; a null id counts as an empty one. An empty table gives an empty result.
    """
    spark = df.sparkSession
    source, steps, first, n, copy, key = (free(df.columns, f"__mix_{x}") for x in ("source", "steps", "first", "n", "copy", "key"))
    found = rates(df, weights, source_col, size, total)
    few = found.limit(FEW_SOURCES + 1).collect()
    held = len(few) <= FEW_SOURCES and sum(24 * math.sqrt(r.rate) + 49 for r in few) <= FEW_STEPS
    if held:
        found = spark.createDataFrame(few, found.schema)
        most = max((r.rate for r in few), default=0.0)
    else:
        most = found.agg(F.max("rate")).first()[0]
    found = found.select(F.col("source").alias(source), poisson_steps(F.col("rate")).alias(steps), first_step(F.col("rate")).alias(first))
    u, ids = uniform(named(id_col), seed), F.coalesce(named(id_col).cast("string"), F.lit(""))
    rows = scanned(df).join(F.broadcast(found) if held else found, named(source_col).cast("string").eqNullSafe(F.col(source)))
    count = (F.col(first) + F.size(F.filter(F.col(steps), lambda p: p <= u))).cast("int")
    kept = [named(c) for c in df.columns]
    rows = rows.select(*kept, count.alias(n)).where(F.col(n) > 0)

    def copies(rows: DataFrame, least: Column, most: Column) -> DataFrame:
        return rows.select(*kept, F.explode(F.sequence(least, most)).alias(copy))

    zero = F.lit(0)
    if most + 12 * math.sqrt(most) + 24 <= COPIES:
        rows = copies(rows, zero, F.col(n) - 1)
    else:  # the few documents of long counts are dealt by blocks of copies first
        long = rows.where(F.col(n) > COPIES)
        long = long.select(*kept, n, F.explode(F.sequence(zero, F.floor((F.col(n) - 1) / COPIES).cast("int"))).alias(copy)).repartition(ids, copy)
        long = copies(long, F.col(copy) * COPIES, F.least(F.col(copy) * COPIES + COPIES, F.col(n)) - 1)
        rows = copies(rows.where(F.col(n) <= COPIES), zero, F.col(n) - 1).unionByName(long)
    mixing = F.md5(F.concat(F.lit(seed + ":shuffle:"), ids, F.lit(":"), F.col(copy)))
    rows = rows.withColumn(key, mixing).repartition(key).sortWithinPartitions(key).coalesce(parts(df))
    if not mark:
        return rows.select(*kept)
    own = [named(c) for c in df.columns if c.lower() not in ("copy_no", "shuffle_key")]
    return rows.select(F.col(copy).alias("copy_no"), F.col(key).alias("shuffle_key"), *own)
