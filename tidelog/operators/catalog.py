"""Catalog and recovery: rows (seq, action, level, path, next_id), action add, remove or next_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_runs(manifest: DataFrame, *more: str) -> DataFrame:
    """(level, path) whose last action is add, and `more` columns of that row; adding again after a removal counts."""
    runs = manifest.where(F.col("action").isin("add", "remove"))
    last = F.max_by(F.struct("action", *more), "seq").alias("last")
    return runs.groupBy("level", "path").agg(last).where("last.action = 'add'").select("level", "path", *(f"last.{c}" for c in more))


def next_id(manifest: DataFrame) -> DataFrame:
    """One row: the last next_id, 0 if there is none."""
    return manifest.where("action = 'next_id'").agg(F.coalesce(F.max_by("next_id", "seq"), F.lit(0)).cast("long").alias("next_id"))


def used(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    return listing.join(active_runs(manifest), listing.name == F.col("path"), "left_semi")


def orphans(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files of runs that the catalog doesn't name; they are ignored, never read."""
    runs = listing.where(F.col("name").endswith(".sst"))
    return runs.join(active_runs(manifest), runs.name == F.col("path"), "left_anti")


def logs(listing: DataFrame) -> DataFrame:
    """(wal_id, name) of the files that are logs: a number and .wal; others are ignored."""
    digits = F.regexp_extract("name", r"^(\d+)\.wal$", 1)
    return listing.where(digits != "").select(digits.cast("long").alias("wal_id"), "name")


def replay_order():
    """Recency over many logs: by the log's number, then by place."""
    return F.struct("wal_id", "pos")


def disk_usage(listing: DataFrame) -> DataFrame:
    return listing.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
