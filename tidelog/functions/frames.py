"""Framed records [crc32 u4][length u8][payload], little-endian, and run footers, as expressions over binary columns and as files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format.
MAX_RECORD = 64 * 1024 * 1024
FOOTER_SIZE, VERSION, MAGIC = 64, 1, "FFCAEFBEDEC0ADDE"  # the magic number's bytes as they lie in the file


def _reversed_hex(raw: Column, at: int | Column, n: int) -> Column:
    start = F.lit(at) if isinstance(at, int) else at
    return F.concat(*(F.hex(F.substring(raw, start + i, F.lit(1))) for i in range(n - 1, -1, -1)))


def u32(raw: Column, at: int) -> Column:
    """The unsigned 32-bit number at a 1-based place."""
    return F.conv(_reversed_hex(raw, at, 4), 16, 10).cast("long")


def u64(raw: Column, at: int) -> Column:
    return F.conv(_reversed_hex(raw, at, 8), 16, 10).cast("decimal(20,0)")


def little(n: Column, size: int) -> Column:
    """A number's bytes, the lowest first."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1))))


def frame(payload: Column) -> Column:
    """A payload's frame."""
    return F.concat(little(F.crc32(payload), 4), little(F.octet_length(payload).cast("long"), 8), payload)


def frame_verdict(raw: Column) -> Column:
    """What reading one record at the beginning of `raw` gives: 'end', 'ok' or what is wrong."""
    n = F.octet_length(raw)
    return (
        F.when(n < 4, "end")
        .when(n < 12, "truncated length")
        .when(u64(raw, 5) > MAX_RECORD, "record too large")
        .when(u64(raw, 5) > n - 12, "truncated data")
        .when(F.crc32(F.substring(raw, F.lit(13), u64(raw, 5).cast("int"))) != u32(raw, 1), "checksum mismatch")
        .otherwise("ok")
    )


def frame_payload(raw: Column) -> Column:
    """The payload of the record at the beginning of `raw`; null unless its verdict is ok."""
    return F.when(frame_verdict(raw) == "ok", F.substring(raw, F.lit(13), u64(raw, 5).cast("int")))


def parsed(raw: bytes) -> Iterator[tuple[int, bytes | None, str]]:
    """(offset, payload, verdict) of the records that lie one after the other, up to the first that is not ok.

    Bytes that end with a record give nothing more; one to three bytes more than that are an end too, as they hold no record.
    """
    at = 0
    while len(raw) - at >= 4:
        crc, n = int.from_bytes(raw[at : at + 4], "little"), int.from_bytes(raw[at + 4 : at + 12], "little")
        data = raw[at + 12 : at + 12 + min(n, MAX_RECORD)]
        if len(raw) - at < 12:
            verdict = "truncated length"
        elif n > MAX_RECORD:
            verdict = "record too large"
        elif len(data) < n:
            verdict = "truncated data"
        else:
            verdict = "ok" if zlib.crc32(data) == crc else "checksum mismatch"
        yield at, data if verdict == "ok" else None, verdict
        if verdict != "ok":
            return
        at += 12 + n


#: Records and bytes of payloads that `records` hands on at once.
OUT, OUT_BYTES = 8192, 8 << 20


def records(files: DataFrame, by: str) -> DataFrame:
    """(by, pos, offset, payload, verdict) of every framed record in files (by, raw), as far as each can be read.

    How far one record reaches is in its own head, so a file is read by one task, record by record.
    """
    schema = T.StructType([T.StructField(by, files.schema[by].dataType), *T._parse_datatype_string("pos long, offset long, payload binary, verdict string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of many files to a batch, of OUT rows and OUT_BYTES and one record at most."""
        own, found, held = [], [], 0

        def batch(keys: pa.Array) -> pa.RecordBatch:
            files_, pos, *rest = zip(*((i, p, *f) for i, (p, f) in zip(own, found, strict=True)), strict=True)
            cols = [pa.array(c, t) for c, t in zip((pos, *rest), (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(files_, pa.int64())), *cols], schema.names)

        for b in batches:
            for i, raw in enumerate(b.column(1)):
                for pos, f in enumerate(parsed(raw.as_py() or b"")):
                    own.append(i)
                    found.append((pos, f))
                    held += len(f[1] or b"")
                    if len(found) >= OUT or held >= OUT_BYTES:
                        yield batch(b.column(0))
                        own, found, held = [], [], 0
            if found:
                yield batch(b.column(0))
                own, found, held = [], [], 0

    return files.select(by, "raw").mapInArrow(run, schema)


def footer_verdict(raw: Column) -> Column:
    """Whether the last 64 bytes of a run's file are a footer of this version."""
    n = F.octet_length(raw)
    foot = F.substring(raw, n - FOOTER_SIZE + 1, F.lit(FOOTER_SIZE))
    return F.when(n < FOOTER_SIZE, "too small").when(F.hex(F.substring(foot, 33, 8)) != MAGIC, "bad magic").when(u32(foot, 41) > VERSION, "unsupported version").otherwise("ok")
