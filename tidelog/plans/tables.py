"""The driver's tables as mutation logs and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _log(df: DataFrame, seq: str, key: str, value: str, tombstone: Column) -> DataFrame:
    dead = F.coalesce(tombstone, F.lit(False))
    return df.select(F.col(seq).alias("seq"), F.col(key).alias("key"), F.when(~dead, F.col(value)).alias("value"), dead.alias("is_tombstone"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' newest properties; an error event deletes the user."""
    return _log(table(spark, sf_dir, "events"), "event_id", "user_id", "props", F.col("event_type") == "error")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' newest order total; status P deletes the customer."""
    return _log(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus") == "P")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of keys of one length."""
    live = F.lit(False).alias("is_tombstone")
    return table(spark, sf_dir, "customer").select(F.lit(0).cast("long").alias("sstable_id"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"), live)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of keys of many lengths."""
    live = F.lit(False).alias("is_tombstone")
    return table(spark, sf_dir, "pages").select(F.lit(0).cast("long").alias("sstable_id"), F.col("url").alias("key"), F.col("page_id").cast("string").alias("value"), live)
