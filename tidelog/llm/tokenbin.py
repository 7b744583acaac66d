"""Token ids in binary files: static range asymmetric numeral systems with shared frequency tables.

A data set has one table image and any number of segment images, rows of two Parquet tables in the shared folder (Spark
commits those, whatever store holds it). A segment holds whole documents in ascending order of id, with a directory of
them; its ids are dealt to blocks of BLOCK ids that are coded independently of each other, each over LANES interleaved
states of 32 bits that pass out words of 16 bits. Checkpoints give each block's place, counts and checksum, so that any
block can be decoded by itself; here all blocks of a segment are decoded side by side.

Frequencies come from all ids of the corpus, scaled to 2^16; ids beyond the TABLE most frequent ones are escaped.

Segment, little-endian: magic 8s, table checksum u4, documents u4, ids u8, ids before it in its part u8, blocks u4;
ids of documents i8 each, whether they are null u1 each, lengths u8 each; checkpoints (offset u8, words u4, escapes u4,
checksum u4) each; blocks: states u4 x LANES, words u2 each, escaped ids u4 each.
Table: magic 8s, symbols u4, escape's frequency u4; ids u4 each, frequencies u4 each; checksum u4.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scanned, scratch_path, stored, tidied
from tidelog.llm.tokens import TOKEN_ROWS, encoder

BITS, LANES, BLOCK, TABLE = 16, 512, 1 << 16, 1 << 15
#: Ids from which a segment is closed, and of a part of the files.
SEGMENT, PART = 1 << 20, 1 << 23
MAGIC, TABLE_MAGIC = b"TLRANS01", b"TLTABL01"
HEAD, POINT = "<8sIIQQI", np.dtype([("offset", "<u8"), ("words", "<u4"), ("escapes", "<u4"), ("crc", "<u4")])
_M = np.uint64((1 << BITS) - 1)


@dataclass
class Table:
    """Frequencies of symbols that sum to 2^BITS; the last symbol is the escape."""

    ids: np.ndarray
    freq: np.ndarray

    @staticmethod
    def of(counts: dict[int, int], most: int = TABLE) -> Table:
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]
        ids, n = np.array([i for i, _ in top], np.int64), np.array([c for _, c in top] + [sum(counts.values()) - sum(c for _, c in top)], np.float64)
        spare = (1 << BITS) - len(n)
        freq = np.floor(n / max(1.0, n.sum()) * spare).astype(np.int64) + 1
        freq[int(np.argmax(freq))] += (1 << BITS) - freq.sum()
        return Table(ids, freq)

    def image(self) -> bytes:
        body = struct.pack("<8sII", TABLE_MAGIC, len(self.ids), int(self.freq[-1])) + self.ids.astype("<u4").tobytes() + self.freq[:-1].astype("<u4").tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def read(raw: bytes) -> Table:
        magic, n, escape = struct.unpack_from("<8sII", raw)
        if magic != TABLE_MAGIC or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise ValueError("the frequency table is damaged")
        ids = np.frombuffer(raw, "<u4", n, 16).astype(np.int64)
        return Table(ids, np.append(np.frombuffer(raw, "<u4", n, 16 + 4 * n).astype(np.int64), escape))

    def __post_init__(self) -> None:
        self.f = self.freq.astype(np.uint64)
        self.c = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(self.freq)), self.freq)
        self.symbol = np.full(int(self.ids.max(initial=0)) + 2, len(self.ids))
        self.symbol[self.ids] = np.arange(len(self.ids))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        return self.symbol[np.minimum(ids, len(self.symbol) - 1)]


def encode_blocks(ids: np.ndarray, table: Table) -> tuple[np.ndarray, list[bytes]]:
    """Checkpoints (offsets from the first block) and the blocks, all coded side by side."""
    n = max(1, -(-len(ids) // BLOCK))
    symbols = table.symbols(ids)
    padded = np.full(n * BLOCK, int(np.argmax(table.freq)))
    padded[: len(ids)] = symbols
    steps = min(BLOCK, -(-len(ids) // LANES) * LANES) // LANES if n == 1 else BLOCK // LANES
    rows = padded.reshape(n, BLOCK // LANES, LANES)[:, :steps].transpose(1, 0, 2).reshape(steps, n * LANES)
    x = np.full(n * LANES, 1 << BITS, np.uint64)
    words, sent = np.zeros(rows.shape, np.uint16), np.zeros(rows.shape, bool)
    for t in range(steps - 1, -1, -1):
        f = table.f[rows[t]]
        sent[t] = full = x >= f << np.uint64(32 - BITS)
        words[t] = x & _M
        x = np.where(full, x >> np.uint64(16), x)
        q = x // f
        x = (q << np.uint64(BITS)) + (x - q * f) + table.c[rows[t]]
    points, blocks, at = np.zeros(n, POINT), [], 0
    words, sent = words.reshape(steps, n, LANES), sent.reshape(steps, n, LANES)
    for b in range(n):
        own = slice(b * BLOCK, (b + 1) * BLOCK)
        w, e = words[:, b][sent[:, b]], ids[own][symbols[own] == len(table.ids)]
        raw = x[b * LANES : (b + 1) * LANES].astype("<u4").tobytes() + w.astype("<u2").tobytes() + e.astype("<u4").tobytes()
        points[b] = (at, len(w), len(e), zlib.crc32(raw))
        blocks.append(raw)
        at += len(raw)
    return points, blocks


def decode_blocks(raw: memoryview, points: np.ndarray, total: int, table: Table) -> np.ndarray:
    """The ids of the blocks at `points` in `raw`, which hold `total` ids."""
    n = len(points)
    steps = -(-total // LANES) if n == 1 else BLOCK // LANES
    x, words, escapes = np.zeros((n, LANES), np.uint64), [], []
    for b, (at, w, e, crc) in enumerate(points.tolist()):
        own = raw[at : at + 4 * LANES + 2 * w + 4 * e]
        if zlib.crc32(own) != crc:
            raise ValueError(f"block {b} is damaged")
        x[b] = np.frombuffer(own, "<u4", LANES)
        words.append(np.frombuffer(own, "<u2", w, 4 * LANES))
        escapes.append(np.frombuffer(own, "<u4", e, 4 * LANES + 2 * w))
    stream = np.concatenate([*words, np.zeros(1, "<u2")]).astype(np.uint64)
    at = np.cumsum([0, *map(len, words)])[:-1]
    out = np.zeros((n, BLOCK // LANES, LANES), np.int64)
    for t in range(steps):
        low = (x & _M).astype(np.int64)
        s = table.slot[low]
        out[:, t] = s
        x = table.f[s] * (x >> np.uint64(BITS)) + low.astype(np.uint64) - table.c[s]
        need = x < (1 << 16)
        place = np.minimum(at[:, None] + np.cumsum(need, axis=1) - 1, len(stream) - 1)
        x = np.where(need, x << np.uint64(16) | stream[place], x)
        at = at + need.sum(1)
    symbols = out.reshape(-1)[:total]
    ids = np.append(table.ids, 0)[symbols]
    ids[symbols == len(table.ids)] = np.concatenate(escapes)
    return ids


def segment(docs: list[int | None], lengths: list[int], ids: np.ndarray, before: int, table: Table, table_crc: int) -> bytes:
    points, blocks = encode_blocks(ids, table)
    head = struct.pack(HEAD, MAGIC, table_crc, len(docs), len(ids), before, len(points))
    directory = np.array([d or 0 for d in docs], "<i8").tobytes() + bytes(d is None for d in docs) + np.array(lengths, "<u8").tobytes()
    points["offset"] += np.uint64(len(head) + len(directory) + points.nbytes)
    return b"".join([head, directory, points.tobytes(), *blocks])


def read_segment(raw: bytes, table: Table, table_crc: int) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Documents, lengths, ids and the ids before it in its part."""
    magic, crc, n, total, before, blocks = struct.unpack_from(HEAD, raw)
    if magic != MAGIC or crc != table_crc:
        raise ValueError("the segment is damaged or has another table")
    at = struct.calcsize(HEAD)
    docs = [None if null else d for d, null in zip(np.frombuffer(raw, "<i8", n, at).tolist(), raw[at + 8 * n : at + 9 * n], strict=True)]
    lengths = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
    points = np.frombuffer(raw, POINT, blocks, at + 17 * n)
    return docs, lengths, decode_blocks(memoryview(raw), points, total, table), before


def tokenized(df: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, crc, ids binary, counts binary): ids in 16 bits where the vocabulary allows, else 32.

    Each task adds one row of which only `counts` isn't null: how often it met each id, 64 bits each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        size = max(enc.size, end_id + 1)
        end, kind, total = np.array([end_id], "<u4").tobytes(), "<u2" if size <= 1 << 16 else "<u4", np.zeros(size, np.int64)

        def rows(*cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "n", "crc", "ids", "counts"])

        for b in batches:
            found = [x + end for x in enc.ids(b.column(1))]
            for x in found:
                own = np.bincount(np.frombuffer(x, "<u4"))
                total[: len(own)] += own
            yield rows(b.column(0).to_pylist(), [len(x) // 4 for x in found], [zlib.crc32(x) for x in found], [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in found], [None] * len(found))
        yield rows([None], [None], [None], [None], [total.tobytes()])

    return scanned(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidied(run, TOKEN_ROWS), "id long, n long, crc long, ids binary, counts binary")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _counts(rows: DataFrame) -> dict[int, int]:
    """How often each id occurs in all rows; as many entries as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                total = np.frombuffer(raw, np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["i", "c"])

    own = rows.where("counts is not null").select("counts")
    return {r.i: r.c for r in own.mapInArrow(tidied(run), "i long, c long").groupBy("i").agg(F.sum("c").alias("c")).collect()}


def write_ids(df: DataFrame, vocabulary: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT, part_ids: int = PART) -> None:
    """Write all rows' ids under `path` in ascending order of id (null first; equal ids by length, then checksum).

    A null text counts as empty: a single end id. An empty table gives a table image and no segment.
    """
    spark = df.sparkSession
    rows = stored(tokenized(df, vocabulary, end_id, id_col, text_col), "ids")
    counts = _counts(rows)
    rows = rows.where("counts is null").drop("counts")
    image = Table.of(counts).image()
    spark.createDataFrame([(bytearray(image),)], "image binary").coalesce(1).write.parquet(f"{path}/table")
    parts = max(spark.sparkContext.defaultParallelism, -(-sum(counts.values()) // part_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crc, part = Table.read(image), zlib.crc32(image), TaskContext.get().partitionId()
        docs, lengths, kept, held, before = [], [], [], 0, 0

        def closed() -> pa.RecordBatch:
            raw = segment(docs, lengths, np.concatenate(kept), before, table, crc)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())], ["part", "before", "n_ids", "image"])

        for b in batches:
            for doc, n, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                docs.append(doc)
                lengths.append(n)
                kept.append(_ids(raw, n))
                held += n
                if held >= segment_ids:
                    yield closed()
                    before += held
                    docs, lengths, kept, held = [], [], [], 0
        if docs:
            yield closed()

    order = ["id", "n", "crc"]
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "ids").mapInArrow(tidied(run), "part int, before long, n_ids long, image binary").write.parquet(f"{path}/segments")


def read_ids(spark, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """From the files: id, start (ids of all documents before it), n_tokens, ids_crc32; with_ids adds the ids themselves."""
    image = bytes(spark.read.schema("image binary").parquet(f"{path}/table").first().image)
    segments = spark.read.schema("part int, before long, n_ids long, image binary").parquet(f"{path}/segments")
    first, at = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # a row for each part of the files
        first[r.part] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, crc = Table.read(image), zlib.crc32(image)
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, lengths, ids, before = read_segment(raw, table, crc)
                ends = np.cumsum(lengths)
                raw_ids = memoryview(ids.astype("<u4").tobytes())
                own = [raw_ids[4 * (e - n) : 4 * e] for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(first[part] + before + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                names = [id_col, "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([np.frombuffer(x, "<u4").tolist() for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return segments.select("part", "image").mapInArrow(tidied(run, 8), f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(df: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = scratch_path(df.sparkSession, "token-files")
    write_ids(df, vocabulary, path, end_id, id_col, text_col)
    return read_ids(df.sparkSession, path, id_col)
