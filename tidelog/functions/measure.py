"""Measurements: percentiles, throughput, improvement between phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRTY, CLEANED = "Random Read (Dirty)", "Random Read (Cleaned)"


def latencies(samples: DataFrame, by: list[str], x: str = "us") -> DataFrame:
    """Mean and percentiles by linear interpolation. Equal samples are counted first, so a group's task holds its
    distinct values alone."""
    counted = samples.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    p = F.percentile(F.col(x), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.col("n")).alias("p")
    mean = (F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias("mean_us")
    out = counted.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), mean, p)
    return out.select(*by, "n", "mean_us", *(F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)).alias(a) for i, a in enumerate(("p50_us", "p95_us", "p99_us"))))


def ops_per_second(ops: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, ops / seconds).otherwise(0.0)


def mean_us(ops: Column, seconds: Column, measured: Column | None = None) -> Column:
    own = F.when(ops == 0, 0.0).otherwise(seconds * 1_000_000 / ops)
    return own if measured is None else F.coalesce(measured, own)


def read_improvement(phases: DataFrame, by: str = "config") -> DataFrame:
    """From (config, phase, mean_us): how much faster reads are after cleaning, in percent and µs; 0 without both."""
    dirty, clean = (F.max(F.when(F.col("phase") == p, F.col("mean_us"))) for p in (DIRTY, CLEANED))
    both = phases.groupBy(by).agg(dirty.alias("d"), clean.alias("c"))
    ok = F.col("d").isNotNull() & F.col("c").isNotNull() & (F.col("d") > 0)
    return both.select(by, F.when(ok, (F.col("d") - F.col("c")) / F.col("d") * 100).otherwise(0.0).alias("improvement_pct"), F.when(ok, F.col("d") - F.col("c")).otherwise(0.0).alias("improvement_us"))
