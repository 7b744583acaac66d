"""Number formats and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_pad(n: Column, width: int | Column) -> Column:
    """At least so many digits; longer numbers keep all of theirs."""
    s = n.cast("string")
    w = F.lit(width) if isinstance(width, int) else width
    return F.lpad(s, F.greatest(w, F.length(s)), F.lit("0"))


def thousands(n: Column) -> Column:
    return F.replace(F.format_number(n.cast("long"), 0), F.lit(","), F.lit("_"))


def short_float(v: Column) -> Column:
    """Two decimals below 1, one below 1000 (and for all negatives from -1 down), else a rounded integer in groups."""
    v = v.cast("double")
    small = F.when(F.abs(v) < 1, F.format_string("%.2f", v)).when(v < 1000, F.format_string("%.1f", v))
    odd = F.when(F.isnan(v), "NaN").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    return F.coalesce(odd, small, thousands(F.round(F.when(F.abs(v) < 9e18, v), 0)))


def kilobytes(n: Column) -> Column:
    cents = F.round(n / F.lit(1024.0) * 100, 0).cast("long")
    return F.concat(thousands(F.floor(cents / 100)), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def log_name(wal_id: Column) -> Column:
    return F.concat(zero_pad(wal_id, 6), F.lit(".wal"))


def run_name(level: Column, run_id: Column) -> Column:
    return F.concat(F.lit("L"), level.cast("string"), F.lit("-"), zero_pad(run_id, 20), F.lit(".sst"))
