"""Small tables with every awkward case, and plain versions of what the operators compute."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, id string, t string, fp string, rejected int, spans int, blob string, copy_no string, n long, component_id string, text_2 string"
EXTRA = ("x", "y", None, "f", 1, 2, "b", "c", 3, "d", "e")


def awkward(spark):
    """Null ids, texts, labels and sources; empty, blank and very long texts; repeated rows; columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(300_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \n\t ", "fr", "b"),
        (5, long, "en", "a"),
        (None, "Der Hund und die Katze", "de", "b"),
        (None, None, None, None),
        (6, "12345 !!! ...", "de", "b"),
        (7, "Le chat est noir et le chien est blanc", "fr", "b"),
        (8, "İstanbul'da ΣΑΣ 日本語 á   .​.. token = \"abcdef0123\"", None, "c"),
        (9, "x", "en", "c"),
    ]
    rows = [(*r, len(r[1] or ""), *EXTRA) for r in texts]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def plain_fingerprint(text, width=4):
    w = words(text)
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_components(n, linked):
    """The smallest member of each one's component, from pairs of numbers."""
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in linked:
        a, b = find(int(i)), find(int(j))
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_pairs(fps, radius=4):
    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius):
            yield i, i + 1 + j


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
