"""Nearest neighbours by multi-index hashing of learned, rotated binary codes.

Iterative quantisation learns rotations that bring centred vectors (of more than BITS numbers: their BITS principal
components) near the corners of a cube; the signs make codes of BITS bits (as many rotations as that needs). Rows are dealt to blocks by hash, each to one; a task indexes its block's codes
by each of their m substrings and lets all queries stream past. For a Hamming radius R a query probes the buckets within
R // m of its substring (one less beyond the first R % m + 1 substrings): by the pigeonhole principle no code within R is
missed. Codes within R are then ranked by the exact distance. R is learned from the sample, and so is the substrings'
length: the shortest of WIDTHS that reaches few rows. Short ones are looked up in a table of buckets, flipping bits; of long
ones the distinct values are compared. Where a block holds fewer than k codes within R, the query's radius there grows to
the whole block, so no query comes back short.

Many blocks would send back k rows a query each. So the first blocks (as many rows as the root of all rows times a block's)
are searched first; the k-th distance found there is a bound that queries take along to the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import block_of, stored, tidied
from tidelog.llm.metric_join import usable

BITS, WIDTHS = 256, (16, 32, 64, 128)
#: Rows that the rotations and the radius are learned from, and the share of their neighbours' codes the radius holds.
SAMPLE, HELD = 4096, 0.97
#: Share of a block's rows that a substring length may reach where a longer one is to be had.
REACHED = 0.1
#: Numbers that a block's vectors hold at most (64 MB), and rows times queries of a tile.
FLOATS, TILE = 1 << 23, 1 << 21
#: Blocks from which the first ones are searched first.
MANY = 16


@dataclass
class Index:
    mean: np.ndarray
    rotations: np.ndarray  # dimensions x BITS
    radius: int
    width: int  # bits of a substring
    reached: float = 1.0  # share of the sample's rows that probing reaches

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotations > 0, axis=1, bitorder="little").view("<u8")

    def reaches(self, width: int | None = None) -> list[int]:
        """The radius of each substring; -1 for one that needs no probing."""
        m = self.rotations.shape[1] // (width or self.width)
        near, rest = divmod(self.radius, m)
        return [near if s <= rest else near - 1 for s in range(m)]


def _parts(codes: np.ndarray, width: int) -> list[np.ndarray]:
    """The codes' substrings, each as (rows, machine words)."""
    words = np.ascontiguousarray(codes).view(f"<u{min(width, 64) // 8}").reshape(len(codes), -1, max(1, width // 64))
    return [np.ascontiguousarray(words[:, s]) for s in range(words.shape[1])]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b): bits that differ."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for w in range(1, a.shape[1]):
        out = out + np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def probed(index: Index, codes: np.ndarray, asked: np.ndarray, width: int) -> np.ndarray:
    """(queries, rows): whether some substring lies within its reach; the plain form of what a block's index finds."""
    out = np.zeros((len(asked), len(codes)), bool)
    for own, rows, reach in zip(_parts(asked, width), _parts(codes, width), index.reaches(width), strict=True):
        if reach >= 0:
            out |= _apart(own, rows) <= reach
    return out


def learn(x: np.ndarray, k: int, bits: int = BITS, held: float = HELD, rounds: int = 20, seed: int = 0) -> Index:
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    v, axes = x - mean, np.eye(x.shape[1])
    if x.shape[1] > bits:
        axes = np.linalg.eigh(v.T @ v)[1][:, ::-1][:, :bits]
    v = v @ axes
    dim, parts = v.shape[1], []
    while sum(p.shape[1] for p in parts) < bits:
        rot = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ rot).T @ v)
            rot = w.T @ u.T
        parts.append(rot)
    index = Index(mean, np.ascontiguousarray(axes @ np.hstack(parts)[:, :bits]), bits, WIDTHS[-1])
    if len(x) > 1:
        codes, own = index.codes(x), np.arange(min(256, len(x)))
        d = np.maximum(0, (x[own] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[own] @ x.T)
        d[own, own] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        index.radius = int(np.quantile(np.bitwise_count(codes[own][:, None, :] ^ codes[near]).sum(2), held, method="higher"))
        for width in WIDTHS:
            index.width, index.reached = width, float(probed(index, codes, codes[own[:64]], width).mean())
            if index.reached <= REACHED:
                break
    return index


class Block:
    """One block's codes, indexed by their substrings."""

    def __init__(self, index: Index, ids: np.ndarray, x: np.ndarray):
        self.index, self.ids, self.x, self.codes = index, ids, x, index.codes(x)
        self.parts = _parts(self.codes, index.width)
        self.reaches = index.reaches()
        self.lookups = index.width == 16 and sum(math.comb(16, i) for i in range(max(0, max(self.reaches)) + 1)) <= 4096
        if self.lookups:
            self.order = [np.argsort(p[:, 0], kind="stable") for p in self.parts]
            self.starts = [np.searchsorted(p[o, 0], np.arange((1 << 16) + 1)) for p, o in zip(self.parts, self.order, strict=True)]
            flips = [sum(1 << i for i in c) for n in range(max(self.reaches) + 1) for c in combinations(range(16), n)]
            self.flips = np.array(flips, np.int64)
        else:
            self.values = [np.unique(p, axis=0, return_inverse=True) for p in self.parts]

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of codes within the radius, by the index."""
        own = _parts(asked, self.index.width)
        found = np.zeros((len(asked), len(self.ids)), bool)
        for s, reach in enumerate(self.reaches):
            if reach < 0:
                continue
            if self.lookups:
                flips = self.flips[: sum(math.comb(16, i) for i in range(reach + 1))]
                buckets = own[s].astype(np.int64) ^ flips[None, :]
                size = self.starts[s][buckets + 1] - self.starts[s][buckets]
                query, at = np.nonzero(size)
                n = size[query, at]
                first = self.starts[s][buckets[query, at]]
                rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                found[np.repeat(query, n), self.order[s][rows]] = True
            else:
                values, rows = self.values[s]
                found |= (_apart(own[s], values) <= reach)[:, rows]
        a, b = np.nonzero(found)
        keep = np.bitwise_count(asked[a] ^ self.codes[b]).sum(1) <= self.index.radius
        return a[keep], b[keep]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, distance) of the k nearest found to each query, its own id left out, none beyond its bound."""
        asked, out = self.index.codes(q), []
        tile = max(1, TILE // max(1, len(self.ids)))
        for t in range(0, len(q), tile):
            own = slice(t, min(len(q), t + tile))
            a, b = self.within(asked[own])
            mine = self.ids[b] == query_ids[own][a]
            a, b = a[~mine], b[~mine]
            short = np.flatnonzero(np.bincount(a, minlength=own.stop - t) < k)
            if len(short):
                keep = ~np.isin(a, short)
                i, j = np.nonzero(self.ids[None, :] != query_ids[own][short][:, None])
                a, b = np.append(a[keep], short[i]), np.append(b[keep], j)
            d = np.concatenate([np.sqrt(((self.x[j] - q[own][i]) ** 2).sum(axis=1)) for i, j in zip(*(np.array_split(c, 1 + len(a) * q.shape[1] // TILE) for c in (a, b)), strict=True)])
            if bounds is not None:
                keep = d <= bounds[own][a]
                a, b, d = a[keep], b[keep], d[keep]
            order = np.lexsort((self.ids[b], d, a))
            a, b, d = a[order], b[order], d[order]
            best = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((query_ids[own][a[best]], self.ids[b[best]], d[best]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest(df: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, id, score: for each row of `df` where `queries` (a condition on "id") holds, its k nearest found.

    Score is the Euclidean distance in double precision; nearest first, ties to the smaller id. Candidates are all rows
    with another id. Null ids and vectors that are null, empty, zero or hold null or non-finite components take no part;
    vectors of another length than the most frequent one take none either. A query with fewer candidates gets all of
    them; an empty table gives an empty result. Rows that repeat an id are candidates each for itself; the query is the
    least of their vectors.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable("vec") & F.col("id").isNotNull())
    schema = f"query_id long, rank int, {id_col} long, score double"
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == sizes.dim)
    drawn = rows.orderBy(F.xxhash64("id", F.lit(3)), "id", "vec").limit(sample).collect()
    index = learn(np.array([r.vec for r in drawn]), k)
    asked = rows.where(queries).groupBy("id").agg(F.min("vec").alias("vec"))
    tasks = spark.sparkContext.defaultParallelism
    block = block or block_of(sizes.n, sizes.dim, tasks, FLOATS)
    blocks = -(-sizes.n // block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, here = None, [], None
        for b in batches:
            r, s = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            edges = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])))
            for i, e in zip(edges, [*edges[1:], len(r)], strict=True):
                if r[i] != last:
                    last, kept, here = r[i], [], None
                ids = b.column(2).slice(i, e - i).to_numpy()
                vecs = b.column(3).slice(i, e - i).flatten().to_numpy().reshape(e - i, -1)
                if not s[i]:
                    kept.append((ids, vecs))
                    continue
                if here is None and kept:
                    here = Block(index, *(np.concatenate(c) for c in zip(*kept, strict=True)))
                    kept = []
                if here is not None:
                    a, c, d = here.search(ids, vecs, k, b.column(4).slice(i, e - i).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query_id", "id", "score"])

    number = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")

    def searched(first: int, end: int, queries: DataFrame) -> DataFrame:
        """What the queries (id, vec, bound) find in the blocks from `first` up to `end`."""
        own = rows.select(number.alias("r"), F.lit(False).alias("query"), "id", "vec", F.lit(0.0).alias("bound")).where(F.col("r").between(first, end - 1))
        every = queries.select(F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("r"), F.lit(True).alias("query"), "id", "vec", "bound")
        dealt = own.unionByName(every).repartition(min(max(end - first, tasks), 1 << 15), "r").sortWithinPartitions("r", "query")
        return stored(dealt.mapInArrow(tidied(run, 4096), "query_id long, id long, score double"), "neighbours")

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    free = F.lit(float("inf")).alias("bound")
    first = math.isqrt(blocks) if blocks > MANY else blocks
    found = searched(0, first, asked.select("id", "vec", free))
    if first < blocks:
        bounds = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
        bounded = asked.join(bounds, "id", "left").select("id", "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        found = found.unionByName(searched(first, blocks, bounded))
    return best(found).select("query_id", "rank", F.col("id").alias(id_col), "score")
