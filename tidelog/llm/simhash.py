"""SimHash near-duplicates: shingle fingerprints, compared in vertical bit planes with carry-save counters.

Fingerprints link at RADIUS or fewer differing bits. Of the 64 bits cut into b > RADIUS blocks, each linked pair agrees on
b - RADIUS whole ones at least, so fingerprints that share the values of some such choice of blocks form a bucket. b grows
with the number of fingerprints: more blocks mean longer keys, more copies of each fingerprint, and smaller buckets.
Buckets over BLOCK fingerprints are dealt over pairs of hashed sub-blocks, so no task holds more than two of those. Inside a
bucket the planes are stored one bit position after the other, 64 fingerprints in a machine word; distances of a whole word
grow by carry-save addition, and a tile is abandoned when every counter has passed the radius. Copies meet once (distinct
fingerprints are compared), and a bucket returns a spanning forest of its links rather than its pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Forest, cut, free, groups, named, only, scanned, stored, tidied
from tidelog.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Distinct fingerprints of a bucket that are compared in one piece.
BLOCK = 4096
#: Fingerprints whose comparison with one costs as much as dealing one copy of it.
COPY = 512
#: Bytes of a text from which shingles are taken at a time.
CHUNK = 1 << 22
TILE = 256
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _words(text: bytes, carry: int) -> Iterator[list[bytes]]:
    """The words of a text by chunks; each chunk begins with the last `carry` words before it."""
    if len(text) <= CHUNK:
        yield text.split()
        return
    at, before = 0, []
    while at < len(text):
        m = _SPACE.search(text, at + CHUNK)
        end = m.start() if m else len(text)
        before = before[-carry:] + text[at:end].split() if carry else text[at:end].split()
        at = end
        yield before


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half the shingles' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    head: list[bytes] = []
    for words in _words((text or "").encode().lower(), width - 1):
        if len(words) < width:
            head = words
            continue
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        n += len(h)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(head), SEED) if head else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row; a null text counts as empty. Whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    return scanned(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidied(run), "id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit j of 64 fingerprints in each word of row j."""
    n = -(-len(fps) // 64) * 64
    bits = np.zeros((n, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, n: int, queries: np.ndarray, radius: int) -> np.ndarray | None:
    """(queries, n) booleans: distance at most `radius`; None once every distance is known to be larger."""
    q = np.unpackbits(queries.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    full = np.uint64(2**64 - 1)
    shape = (len(queries), planes.shape[1])
    lanes = np.full(planes.shape[1], full)
    if n % 64:
        lanes[-1] = np.uint64((1 << (n % 64)) - 1)
    counters = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.broadcast_to(~lanes, shape).copy()

    def exceeded() -> np.ndarray:
        more, equal = np.zeros(shape, np.uint64), np.full(shape, full)
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                more |= equal & counters[k]
                equal &= ~counters[k]
        return over | more

    for j in range(64):
        carry = planes[j][None, :] ^ np.where(q[:, j], full, np.uint64(0))[:, None]
        for c in counters:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if j % 8 == 7 and j > radius and (exceeded() == full).all():
            return None
    return np.unpackbits((~exceeded()).astype("<u8").view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")[:, :n].astype(bool)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root), of the links among distinct fingerprints."""
    f, planes = Forest(len(fps)), bit_planes(fps)
    for i in range(0, len(fps), TILE):
        skip = i // 64
        mask = within(planes[:, skip:], len(fps) - skip * 64, fps[i : i + TILE], radius)
        if mask is not None:
            a, b = np.nonzero(mask)
            a, b = a + i, b + skip * 64
            f.union(a[a < b], b[a < b])
    roots = f.roots()
    at = np.flatnonzero(roots != np.arange(len(fps)))
    return fps[at], fps[roots[at]]


def blocks_for(n: float, radius: int = RADIUS) -> int:
    """How many blocks of bits cost least for n distinct fingerprints spread evenly: copies, and partners of each copy."""
    cost = lambda b: math.comb(b, radius) * (COPY + n / 2 ** (64 * (b - radius) // b))
    return min(range(radius + 1, radius + 7), key=cost)


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints of `fps` (fp long) within `radius`, by buckets."""
    blocks = blocks or blocks_for(fps.count(), radius)
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [F.shiftrightunsigned(F.shiftleft("fp", 64 - edge[i + 1]), 64 - edge[i + 1] + edge[i]) for i in range(blocks)]

    def joined(chosen: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for i in chosen:
            out = F.shiftleft(out, edge[i + 1] - edge[i]).bitwiseOR(bits[i])
        return out

    band = F.array(*[F.struct(F.lit(k).alias("band"), joined(chosen).alias("v")) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))])
    rows = fps.select("fp", F.explode(band).alias("x")).select("fp", "x.band", "x.v")
    large = rows.groupBy("band", "v").agg(F.count("*").alias("n")).where(F.col("n") > block)
    k = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), k).cast("int")
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1)))
    dealt = (
        rows.join(large, ["band", "v"], "left")
        .select("fp", "band", "v", F.coalesce(own, F.lit(0)).alias("s"), other.alias("t"))
        .select("band", "v", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "fp")
    )
    keys = ["band", "v", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groups(batches, keys, "fp"):
            if len(found) > 1:
                a, b = forest(found.view(np.uint64), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidied(run, 1 << 16), "a long, b long")


def _rooted(df: DataFrame, id_col: str, text_col: str, radius: int, width: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, least, root) of every fingerprint: its smallest id and its component's root."""
    docs = stored(fingerprints(df, id_col, text_col, width), "simhash")
    fps = docs.groupBy("fp").agg(F.min("id").alias("least"))
    parts = connected_components(links(fps.select("fp"), radius, block))
    return docs, fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per row of `df`: id, fp long, component_id (smallest id reachable through links, itself included).

    Null and empty texts and texts of blanks have fingerprint 0, linked like any other. A row with a null id keeps its
    null id, links like any other and lends its component no id: component_id is null where no member has one. Repeated
    rows are repeated in the result. An empty table gives an empty result.
    """
    docs, rooted = _rooted(df, id_col, text_col, radius, width, block)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut(rooted.join(least, "root").select("fp", "component_id"))
    return docs.join(ids, "fp").select("id", "fp", "component_id")


def _with_fingerprint(df: DataFrame, text_col: str, width: int, at: str) -> DataFrame:
    """`df` and the fingerprints of its texts, in the column `at`."""
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(n).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(fps, pa.int64())], names)

    names = [*df.columns, at]
    schema = df.withColumn(at, F.lit(0).cast("long")).schema
    rows = df.withColumn(at, named(text_col).cast("string"))
    return rows.toDF(*map(str, range(n + 1))).mapInArrow(tidied(run), schema)  # numbers: names may hold dots


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """`df` with one row of each component: that of the smallest id (null last), then of the smallest fingerprint.

    Rows are told apart by id and fingerprint, so different texts that share an id, or have none, stay or go by themselves.
    Of rows equal in both, that of the smallest hash of all its columns stays. No component is left without a row.

    Where an id is one row's alone, that row stays where it is, picked by its id; the others, with repeated or null ids, are
    picked by fingerprint.
    """
    docs, rooted = _rooted(df, id_col, text_col, radius, width, block)
    first = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp")
    heads = cut(rooted.groupBy("root").agg(F.min(first).alias("h")).select("h.id", "h.fp", F.lit(True).alias("head")))
    rows = docs.where("id is not null").groupBy("id", "fp").agg(F.count("*").alias("n")).join(heads, ["id", "fp"], "left")
    kept = cut(rows.groupBy("id").agg(F.coalesce(F.max("head"), F.lit(False)).alias("stays"), F.sum("n").alias("n")))
    id_, ids = named(id_col).cast("long"), F.col("id").alias("key")
    out = only(scanned(df), id_, kept.where("stays and n = 1").select(ids), kept.where("not stays or n > 1").select(ids))
    odd = []
    if kept.where("stays and n > 1").take(1):
        odd.append(only(scanned(df), id_, kept.where("stays and n > 1").select(ids), kept.where("not stays or n = 1").select(ids)))
    if heads.where("id is null").take(1):
        odd.append(scanned(df).where(id_.isNull()))
    for some in odd:
        at = free(df.columns, "__fp")
        some = _with_fingerprint(some, text_col, width, at)
        id_at, head_at = free(some.columns, "__id"), free(some.columns, "__head")
        wanted = heads.select(F.col("id").alias(id_at), F.col("fp").alias(head_at))
        some = some.join(wanted, id_.eqNullSafe(F.col(id_at)) & (F.col(at) == F.col(head_at)), "left_semi")
        row = F.struct(*(named(c) for c in df.columns))
        picked = some.groupBy(id_.alias("i"), F.col(at).alias("f")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("r"))
        out = out.unionByName(picked.select(*(F.col("r").getField(c).alias(c) for c in df.columns)))
    return out


def hex_digits(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
