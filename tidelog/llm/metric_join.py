"""Embedding near-duplicates: an exact metric range join over pivot cells.

On unit vectors a cosine of at least c is a Euclidean distance of at most r = sqrt(2 - 2c). Every vector belongs to the
cell of its nearest pivot. By the triangle inequality a vector y of cell j can be within r of one of cell i only if
d(y, p_i) <= d(y, p_j) + 2r, and of one in a ring of cell i, between the distances a and b from p_i, only if
a - r <= d(y, p_i) <= b + r; only to such rings is it copied. A cell has one ring, or as many as its size asks for; a ring
over a block's size is dealt over hashed blocks. Of two blocks one hosts their pairs, so each pair meets once and each task
holds one block while the visitors stream past. Equal vectors meet once, as one of their number. A task returns for each
vector its count of links and one edge to its local component, so a dense group never becomes pairs.

Pivots are means of a sample. How many of them cost least depends on how the vectors lie: small cells near each other only
add copies, small cells far apart save comparisons. So the sample is dealt over different numbers of cells, and the number
that costs least is taken. Where distances are all alike (vectors without clusters) no bound can prune, and the work is
that of all pairs, in blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Forest, block_of, stored, tidied
from tidelog.llm.components import connected_components

MIN_COSINE = 0.95
#: Numbers that a block's vectors hold at most (32 MB in double precision), and those of a tile of similarities.
FLOATS, TILE = 1 << 22, 1 << 23
#: Pivots of one length of vector at most; larger cells have more rings and blocks. Sampled vectors for each pivot.
MAX_PIVOTS, SAMPLED = 1 << 14, 8
#: Lengths of vectors (the most frequent ones) that have pivots; the others share blocks by their length.
MAX_LENGTHS = 4096
#: Rings begin at multiples of r over RINGS, and of one over STEPS at least.
RINGS, STEPS = 4, 64
#: Comparisons that cost as much as one copy of a vector.
COPY = 500
#: Rows of a batch of visitors.
VISITORS = 2048


def usable(vec: str):
    """Whether a vector takes part: not null, not zero, no null or non-finite component."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def _raw(vector: list[float]) -> bytes:
    """A vector's components, in 32 bits each where that loses nothing."""
    wide = np.array(vector, "<f8")
    with np.errstate(over="ignore"):
        narrow = wide.astype("<f4")
    return (narrow if np.array_equal(narrow, wide) else wide).tobytes()


def _units(raws: list[bytes], dim: int) -> np.ndarray:
    x = np.array([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in raws], np.float64).reshape(len(raws), dim)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))


def _means(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """`n` pivots at most: directions of the means of a sample's cells."""
    pivots = sample[:n]
    for _ in range(rounds if len(sample) > n else 0):
        home = np.concatenate([(sample[i : i + VISITORS] @ pivots.T).argmax(axis=1) for i in range(0, len(sample), VISITORS)])
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        good = size > 1e-9
        pivots = np.where(good[:, None], sums / np.where(good, size, 1)[:, None], pivots)
    return pivots


def choose_pivots(sample: np.ndarray, n: int, block: int, r: float) -> np.ndarray:
    """Pivots for n vectors of which `sample` (unit vectors) is a fair part: as many as cost least in copies and comparisons."""
    best, least = None, math.inf
    for times in (1, 4, 16):
        count = min(MAX_PIVOTS, times * -(-n // block), len(sample))
        pivots = _means(sample, count)
        d = _distances(sample[-2048:], pivots)
        home = d.argmin(axis=1)
        own = d[np.arange(len(d)), home]
        radii = np.full(len(pivots), -1.0)
        np.maximum.at(radii, home, own)
        size = np.bincount(home, minlength=len(pivots)) / len(d) * n
        sent = (d <= own[:, None] + 2 * r) & (d <= radii + r)
        cost = (sent @ (np.ceil(size / block) * COPY + size)).mean()
        if cost < 0.9 * least:
            best, least = pivots, cost
        if count < times * -(-n // block):
            break
    return best


class Cells:
    """Where vectors of one length live and which blocks they visit."""

    def __init__(self, pivots: np.ndarray, r: float, first: int, counts: dict[tuple[int, int], tuple[int, float, float]], block: int):
        """`counts`: of each (cell, step of the distance), how many vectors there are, and their least and greatest distance."""
        self.pivots, self.r = pivots, r
        cell, start, parts, lo, hi = [], [], [], [], []
        left, at = 0, None
        for (c, step), (n, least, most) in sorted(counts.items()):
            if c != at or left + n > block:
                cell.append(c)
                start.append(step)
                parts.append(0)
                lo.append(least)
                hi.append(most)
                left, at = 0, c
            left += n
            parts[-1] = -(-left // block)
            lo[-1], hi[-1] = min(lo[-1], least), max(hi[-1], most)
        self.cell, self.start, self.lo, self.hi = np.array(cell, int), np.array(start, int), np.array(lo), np.array(hi)
        self.parts = np.array(parts, int)
        self.first = first + np.cumsum(self.parts) - self.parts
        self.end = first + int(self.parts.sum())
        self.block_ring = np.repeat(np.arange(len(self.parts)), self.parts)
        self.numbers = np.arange(first, self.end)

    def home(self, cell: np.ndarray, step: np.ndarray, salt: np.ndarray) -> np.ndarray:
        ring = np.searchsorted(self.cell * (1 << 20) + self.start, cell * (1 << 20) + step, side="right") - 1
        return self.first[ring] + salt % self.parts[ring]

    def visits(self, units: np.ndarray, cell: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, block) of every vector and block that hosts it, its own among them."""
        d = _distances(units, self.pivots)
        own = d[np.arange(len(units)), cell][:, None]
        d = d[:, self.cell]
        near = (d <= own + 2 * self.r + 1e-6) & (d <= self.hi + self.r + 1e-6) & (d >= self.lo - self.r - 1e-6)
        near = near[:, self.block_ring]
        h, k = home[:, None], self.numbers[None, :]
        hosts = near & np.where((h + k) % 2 == 0, h >= k, h <= k) | (h == k)
        who, to = np.nonzero(hosts)
        return who, self.numbers[to]


def linked(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", min_cosine: float = MIN_COSINE, block: int | None = None) -> DataFrame:
    """One row per row of `df`: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows with a null
    id; vectors of different lengths never link. Rows that repeat an id count as vectors of their own. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = rows.where(usable("vec") & F.col("id").isNotNull())
    r = math.sqrt(2 - 2 * min_cosine) + 1e-9

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(v) for v in vecs], pa.int32()), pa.array([_raw(v) for v in vecs], pa.binary()), b.column(2)], ["rep", "n", "dim", "raw", "vec"])

    classes = good.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    packed = classes.select("rep", "n", "vec").mapInArrow(tidied(pack, VISITORS), "rep long, n long, dim int, raw binary, vec array<double>")
    classes = stored(packed.withColumn("node", F.monotonically_increasing_id()), "units")  # a number of its own for each class
    units = classes.select("node", "n", "dim", "raw")
    lengths = units.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(MAX_LENGTHS).collect()
    sizes = {x.dim: x.n for x in lengths}
    others = units.count() - sum(sizes.values()) if len(lengths) == MAX_LENGTHS else 0
    tasks = spark.sparkContext.defaultParallelism
    held = {dim: block or block_of(n, dim, tasks, FLOATS) for dim, n in sizes.items()}

    wanted = {dim: min(n, SAMPLED * min(MAX_PIVOTS, 16 * -(-n // held[dim])), max(1, 2 * FLOATS // dim)) for dim, n in sizes.items() if n > held[dim]}
    drawn: dict[int, list[bytes]] = {}
    if wanted:
        share = F.create_map(*(F.lit(x) for dim, k in wanted.items() for x in (dim, int(k / sizes[dim] * (1 << 30)))))
        picked = units.where(F.pmod(F.xxhash64("raw", F.lit(5)), F.lit(1 << 30)) < F.coalesce(share[F.col("dim")], F.lit(0)))
        for x in picked.select("dim", "raw").collect():  # some FLOATS numbers at most
            drawn.setdefault(x.dim, []).append(bytes(x.raw))
    pivots: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        sample = _units(sorted(drawn.get(dim, []), key=zlib.crc32), dim)
        pivots[dim] = choose_pivots(sample, n, held[dim], r) if len(sample) else np.full((1, dim), dim**-0.5)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            raws = b.column(3).to_pylist()
            home, dist = np.zeros(len(raws), np.int32), np.zeros(len(raws))
            for dim in np.unique(dims).tolist():
                if dim not in pivots:
                    continue
                of = np.flatnonzero(dims == dim)
                for at in np.array_split(of, -(-len(of) * len(pivots[dim]) // TILE)):
                    d = _distances(_units([raws[i] for i in at], dim), pivots[dim])
                    home[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(dist), pa.array((dist * min(RINGS / r, STEPS)).astype(np.int32))], ["node", "n", "dim", "raw", "home", "dist", "step"])

    placed = stored(units.mapInArrow(tidied(nearest, VISITORS), "node long, n long, dim int, raw binary, home int, dist double, step int"), "cells")
    cells: dict[int, Cells] = {}
    found: dict[int, dict] = {dim: {} for dim in sizes}
    counted = placed.where(F.col("dim").isin(list(sizes)) if others else F.lit(True)).groupBy("dim", "home", "step").agg(F.count("*").alias("n"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    for x in counted.collect():  # for each pivot 2 * STEPS rows at most
        found[x.dim][x.home, x.step] = (x.n, x.least, x.most)
    blocks = 0
    for dim in sorted(sizes):
        cells[dim] = Cells(pivots[dim], r, blocks, found[dim], held[dim])
        blocks = cells[dim].end
    shared = -(-others // 4096)  # blocks of the lengths without pivots

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raws = b.column(2).to_numpy(), b.column(3).to_pylist()
            cell, step, salt = (b.column(k).to_numpy() for k in (4, 5, 6))
            for dim in np.unique(dims).tolist():
                of = np.flatnonzero(dims == dim)
                if dim not in cells:
                    yield dealt_to(b, of, np.full(len(of), blocks + zlib.crc32(str(dim).encode()) % shared), np.zeros(len(of), bool))
                    continue
                c = cells[dim]
                for own in np.array_split(of, -(-len(of) * (len(c.numbers) + len(c.pivots)) // TILE)):
                    home = c.home(cell[own], step[own], salt[own])
                    who, to = c.visits(_units([raws[i] for i in own], dim), cell[own], home)
                    yield dealt_to(b, own[who], to, home[who] != to)

    def dealt_to(b: pa.RecordBatch, rows: np.ndarray, to: np.ndarray, guest: np.ndarray) -> pa.RecordBatch:
        cols = [b.column(0).take(pa.array(rows)), *(b.column(k).take(pa.array(rows)) for k in (1, 2, 3))]
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(guest), *cols], ["block", "guest", "node", "n", "dim", "raw"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: list[tuple] = []
        state: dict = {}

        def settle() -> None:
            """Link a block's own vectors with each other once they are all there."""
            ids, n, u = (np.concatenate([h[k] for h in here]) for k in range(3))
            state.update(ids=ids, n=n, u=u, u32=u.astype(np.float32), links=np.zeros(len(ids), np.int64), forest=Forest(len(ids)))
            here.clear()
            for i, a, b in near(u):
                a, b = a[a + i != b] + i, b[a + i != b]
                np.add.at(state["links"], a, n[b])
                state["forest"].union(a[a < b], b[a < b])

        def near(u: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """By tiles, the tile's first row and the (row of the tile, vector of the block) that link."""
            rows = max(1, TILE // len(state["ids"]))
            for i in range(0, len(u), rows):
                own = u[i : i + rows]
                sim = own.astype(np.float32) @ state["u32"].T
                a, b = np.nonzero(sim >= min_cosine - 1e-4)
                unsure = np.flatnonzero(sim[a, b] < min_cosine + 1e-4)
                bad = [s[np.einsum("ij,ij->i", own[a[s]], state["u"][b[s]]) < min_cosine] for s in np.array_split(unsure, 1 + len(unsure) // VISITORS)]
                keep = np.ones(len(a), bool)
                keep[np.concatenate(bad)] = False
                yield i, a[keep], b[keep]

        def ended() -> pa.RecordBatch:
            if here:
                settle()
            if "ids" not in state:  # a block that only has visitors
                return made(*[np.zeros(0, np.int64)] * 3)
            ids, roots = state["ids"], state["forest"].roots()
            some = np.flatnonzero(state["links"])
            state.pop("ids")
            return made(ids[some], state["links"][some], ids[roots[some]])

        def made(node: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], ["node", "links", "root"])

        last = None
        for b in batches:
            blocks, guests, dims = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
            edges = np.flatnonzero(np.append(True, (blocks[1:] != blocks[:-1]) | (guests[1:] != guests[:-1]) | (dims[1:] != dims[:-1])))
            for s, e in zip(edges, [*edges[1:], len(blocks)], strict=True):
                if (blocks[s], dims[s]) != last:
                    if last is not None:
                        yield ended()
                    last = (blocks[s], dims[s])
                own = (b.column(2)[s:e].to_numpy(), b.column(3)[s:e].to_numpy(), _units(b.column(5)[s:e].to_pylist(), int(dims[s])))
                if not guests[s]:
                    here.append(own)
                    continue
                if here:
                    settle()
                if "ids" not in state:
                    continue
                for i, x, y in near(own[2]):
                    if len(x):
                        ids, n = own[0][i:], own[1][i:]
                        np.add.at(state["links"], y, n[x])
                        who, first, at = np.unique(x, return_index=True, return_inverse=True)
                        state["forest"].union(y[first][at], y)
                        total = np.zeros(len(who), np.int64)
                        np.add.at(total, at, state["n"][y])
                        yield made(ids[who], total, state["ids"][y[first]])
        if last is not None:
            yield ended()

    dealt = placed.select("node", "n", "dim", "raw", "home", "step", F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 20)).alias("salt")).mapInArrow(tidied(deal, VISITORS), "block int, guest boolean, node long, n long, dim int, raw binary")
    tasks = min(max(blocks + shared, tasks), 1 << 15)
    near = stored(dealt.repartition(tasks, "block").sortWithinPartitions("block", "dim", "guest").mapInArrow(tidied(join, VISITORS), "node long, links long, root long"), "links")

    degree = near.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(near, "node", "root")
    rooted = classes.select("node", "rep", "n", "vec").join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = rooted.join(least, "root").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    rest = rows.where(~usable("vec") | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.join(known, "vec").select("id", "n_links", "component_id").unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
