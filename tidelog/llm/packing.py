"""Packing token ids into fixed windows by minimum bin slack.

Each document's ids are cut into full windows and one remainder. A task holds the counts of its remainders' lengths (of
FLUSH documents at most) and fills window after window: with the longest length left fixed, a dynamic programme over a
bitset (a Python integer, bit s set if sum s can be reached) finds the multiset of remaining lengths that comes closest
to capacity; going back through the recorded bitsets gives the count of each length. The same multiset fills as many
windows as the counts allow. Nothing is shuffled, and no task holds more than FLUSH remainders' lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import scanned, tidied
from tidelog.llm.tokens import TOKEN_ROWS, encoder

CAPACITY = 1024
#: Remainders that a task packs together.
FLUSH = 1 << 17
#: Characters that are encoded together: a quarter of the memory that the encoder takes by itself.
AT_ONCE = 1 << 20
#: Windows of one task at most; their numbers come after those of the tasks before it.
TASK_IDS = 1 << 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, count) of the multiset with the longest length in it whose sum is nearest to capacity."""
    longest = max(n for n in range(len(counts)) if counts[n])
    room, sums, seen = capacity - longest, 1, []
    for n in range(min(room, longest), 0, -1):
        c = min(counts[n] - (n == longest), room // n)
        if c <= 0:
            continue
        seen.append((n, c, sums))
        grown = sums
        for _ in range(c):
            more = (grown | grown << n) & ((2 << room) - 1)
            if more == grown:
                break
            grown = more
        sums = grown
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {longest: 1}
    for n, c, before in reversed(seen):
        used = next(j for j in range(c + 1) if at >= j * n and before >> (at - j * n) & 1)
        if used:
            out[n] = out.get(n, 0) + used
            at -= used * n
    return list(out.items())


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """For lengths of 1 to capacity: the window and the offset in it of each, and the number of windows."""
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    order = np.argsort(lengths, kind="stable")
    taken = np.cumsum([0, *counts])[:-1].tolist()
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    left = len(lengths)
    while left:
        multiset = fill(counts, capacity)
        times = min(counts[n] // c for n, c in multiset)
        at = 0
        for n, c in multiset:
            rows = order[taken[n] : taken[n] + c * times]
            window[rows] = made + np.repeat(np.arange(times), c)
            offset[rows] = at + n * np.tile(np.arange(c), times)
            taken[n] += c * times
            counts[n] -= c * times
            left -= c * times
            at += n * c
        made += times
    return window, offset, made


def packed(df: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, flush: int = FLUSH) -> DataFrame:
    """One row per piece (SCHEMA) of each row's ids, the end id last.

    A null text counts as empty: a single end id. Null ids stay null; rows with equal ids are packed each for itself.
    Other columns play no part, whatever their names. A longer text than a window gives full windows and a remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        made = TaskContext.get().partitionId() * TASK_IDS
        kept: list[tuple] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        def flushed() -> pa.RecordBatch:
            nonlocal made
            window, offset, n = pack(np.array([k[2] for k in kept]), capacity)
            out = rows([(*k, made + w, o) for k, w, o in zip(kept, window.tolist(), offset.tolist(), strict=True)])
            made += n
            kept.clear()
            return out

        enc = encoder(vocabulary)
        for b in batches:
            found = []
            for doc, ids in zip(b.column(0).to_pylist(), enc.ids(b.column(1), AT_ONCE), strict=True):
                ids += end
                n, raw = len(ids) // 4, memoryview(ids)
                for s in range(0, n, capacity):
                    size = min(capacity, n - s)
                    piece = (doc, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), n)
                    if size == capacity:
                        found.append((*piece, made, 0))
                        made += 1
                    else:
                        kept.append(piece)
            yield rows(found)
            if len(kept) >= flush:
                yield flushed()
        if kept:
            yield flushed()

    return scanned(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidied(run, TOKEN_ROWS), SCHEMA)
