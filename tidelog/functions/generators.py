"""Workload generators: the multiplicative generator, key patterns, targets and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.formats import zero_pad

#: Fixed values of the workload.
LCG, READ, OVERWRITE, WRAP, SPREAD = 6364136223846793005, (1103515245, 12345), (1664525, 1013904223), 1 << 64, 1_000_000_000


def _big(n: int) -> Column:
    return F.expr(f"cast({n} as decimal(38,0))")


def _wrapped(c: Column) -> Column:
    return (c % _big(WRAP)).cast("decimal(20,0)")


def lcg(i: Column) -> Column:
    """i * LCG + 1 modulo 2^64, unsigned."""
    return _wrapped(_wrapped(i.cast("decimal(19,0)") * F.expr(f"cast({LCG} as decimal(19,0))")) + _big(1))


def target(i: Column, n: int | Column, pick: tuple[int, int] = READ) -> Column:
    product = _wrapped(lcg(i) * F.expr(f"cast({pick[0]} as decimal(10,0))"))
    return (_wrapped(product + _big(pick[1])) % (F.lit(n) if isinstance(n, int) else n)).cast("long")


def key(i: Column, pattern: str, pad: int, stripes: int = 16) -> Column:
    if pattern == "sequential":
        return F.concat(F.lit("key-"), zero_pad(i, pad))
    if pattern == "random":
        return F.concat(F.lit("key-"), zero_pad((lcg(i) % SPREAD).cast("long"), pad))
    if pattern == "striped":
        return F.concat(F.lit("s"), (i % stripes).cast("string"), F.lit("-key-"), zero_pad(F.floor(i / stripes).cast("long"), pad))
    raise ValueError(f"no such key pattern: {pattern}")


def value(i: Column, prefix: str, pad: int) -> Column:
    """prefix v, upd or thr before the padded index."""
    return F.concat(F.lit(prefix), zero_pad(i, pad))


def space_key(i: Column, kind: str, length: int, prefix: str = "", seed: int = 0) -> Column:
    """Keys of the space test: prefixed, sequential, or random alphanumeric ones (repeatable by the seed)."""
    if kind == "prefixed":
        return F.concat(F.lit(prefix), zero_pad(i, max(0, length - len(prefix))))
    if kind == "sequential":
        return zero_pad(i, length)
    if kind == "random":
        letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

        def letter(k: int) -> Column:
            digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), i, F.lit(k))), 1, 8)
            return F.substring(letters, (F.conv(digits, 16, 10).cast("long") % 62 + 1).cast("int"), F.lit(1))

        return F.concat(*(letter(k) for k in range(length)))
    raise ValueError(f"no such key kind: {kind}")
