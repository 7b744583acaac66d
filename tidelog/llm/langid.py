"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text's subwords are its runs of 2, 3 and 4 bytes, ASCII lower-cased and with all ASCII but letters made blanks. Each is
hashed to one of BUCKETS embeddings; a text is the mean of its subwords' embeddings, and a linear softmax scores the
languages and one class more: text of no learned language. Training is stochastic gradient descent in numpy (with per-weight
step sizes) on a bounded sample of labelled rows; every language gets the same share. What that last class learns from is
made of the sample: each row once more with its letters scrambled, enciphered, reversed in their words, cut short or moved
to another script. A quarter of the sample and of its twins is kept back to calibrate: a temperature for the probabilities,
and a threshold halfway between what the languages' own rows reach and what the twins reach; where these overlap, the
languages' rows decide, of which rejection may cost REJECTED. For prediction the embeddings are multiplied out, so a text
costs its bucket counts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import scanned, tidied

BUCKETS, DIM, ORDERS = 1 << 13, 16, (2, 3, 4)
#: Bounds of the training sample: languages (the most frequent ones), and rows of all languages together.
MAX_LANGUAGES, MAX_ROWS = 256, 2000
EPOCHS, BATCH, RATE = 24, 32, 0.5
#: Share of rightly predicted rows that rejection may cost, and of the twins that the threshold leaves out of account.
REJECTED, LEFT_OUT = 0.001, 0.05
CHUNK = 1 << 20
#: First and last letters of other scripts, as code points.
SCRIPTS = ((0x430, 0x44F), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x561, 0x586), (0x3041, 0x3093), (0x30A1, 0x30F3), (0xAC00, 0xD7A3), (0x4E00, 0x9FA5))
_NUMERIC = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_]{2,}")
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a character of a Unicode letter category occurs; superscripts, fractions and the like are none."""
    return text is not None and any(any(map(str.isalpha, m[0])) for m in _NUMERIC.finditer(text))


def twin(text: str, seed: int) -> str:
    """`text` as a text of no learned language, in one of several ways that the seed chooses; never `text` itself."""
    rng = random.Random(seed)
    kind, text = rng.randrange(6), text.lower()
    letters = sorted({c for c in text if c.isalpha()})
    ways = (
        lambda m: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(m[0]))),  # other letters at random
        lambda m: m[0].translate(other),  # a letter for a letter
        lambda m: m[0][::-1],
        lambda m: "".join(rng.sample(m[0], len(m[0]))),
        lambda m: m[0][: rng.randint(1, 3)],  # as names in programs and abbreviations are
    )
    other = {ord(a): b for a, b in zip(letters, rng.sample(letters, len(letters)), strict=True)}
    out = _WORD.sub(ways[kind], text) if kind < len(ways) else text
    if sum(a == b for a, b in zip(out, text, strict=False)) < 0.8 * len(text):
        return out
    first, last = rng.choice(SCRIPTS)  # also where hardly a letter has changed, as in texts of very short words
    moved = {ord(c): chr(rng.randint(first, last)) for c in letters}
    return _NUMERIC.sub(lambda m: "".join(chr(rng.randint(first, last)) for _ in m[0]), text) if last - first > 1000 else text.translate(moved)


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs among a whole text's subwords; taken by chunks, so memory doesn't grow with it."""
    raw = np.frombuffer(b" " + text.encode().translate(_BYTES) + b" ", np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(raw), CHUNK):
        own = raw[i : i + CHUNK + max(ORDERS) - 1].astype(np.uint32)
        gram = own
        for k in range(2, max(ORDERS) + 1):
            gram = gram[:-1] | own[k - 1 :] << np.uint32(8 * (k - 1))
            if k in ORDERS:
                out += np.bincount(((gram[:CHUNK] + np.uint32(0x9E3779B9 * k & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x (languages, then none of them): embeddings times output weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence and whether it is rejected; `und`, 0 and rejected without a letter or a trained language."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        c = counts(text)
        p = _softmax((c @ self.weights / c.sum() + self.bias) / self.temperature)
        best = int(np.argmax(p[:-1]))
        return self.languages[best], float(min(1.0, p[best])), bool(p[best] < self.threshold)


def none() -> Model:
    """A model that rejects all."""
    return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    return x


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross-entropy against targets a row's weight short of certain, so that it is never 0."""
    sure = 1 - 1 / (len(y) + 2)
    target = np.full(z.shape, (1 - sure) / (z.shape[1] - 1))
    target[np.arange(len(y)), y] = sure
    grid = np.geomspace(1 / 64, 64, 97)
    return float(min(grid, key=lambda t: -(target * np.log(_softmax(z / t) + 1e-300)).sum()))


def _threshold(right: np.ndarray, wrong: np.ndarray) -> float:
    """Between the confidences of rightly predicted rows and those of rows of no language, in log odds."""
    if not len(right):
        return 0.0
    odds = lambda p: float(np.log((p + 1e-12) / (1 - p + 1e-12)))
    high = float(np.quantile(right, REJECTED))
    low = float(np.quantile(wrong, 1 - LEFT_OUT)) if len(wrong) else 0.0
    return high if low >= high else float(1 / (1 + np.exp(-(odds(low) + odds(high)) / 2)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: list[str], seed: int = 0) -> Model:
    """From rows of (buckets, shares) and their language numbers, one more than the languages for none of them.

    Every fourth row of each number is held back for calibration.
    """
    rng = np.random.default_rng(seed)
    n = len(languages) + 1
    back = np.zeros(len(y), bool)
    for k in range(n):
        back[np.flatnonzero(y == k)[3::4]] = True
    own = np.flatnonzero(~back)
    e, w, b = rng.normal(0, 0.5, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, n)), np.zeros(n)
    ge, gw, gb = (np.full(a.shape, 1e-8) for a in (e, w, b))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(own)
        for i in range(0, len(order), BATCH):
            now = order[i : i + BATCH]
            x = _dense([rows[j] for j in now])
            at = np.flatnonzero(x.any(axis=0))
            x = x[:, at]
            h = x @ e[at]
            d = _softmax(h @ w + b)
            d[np.arange(len(now)), y[now]] -= 1
            d /= len(now)
            for a, g, step, of in ((e, ge, x.T @ (d @ w.T), at), (w, gw, h.T @ d, slice(None)), (b, gb, d.sum(0), slice(None))):
                g[of] += step**2
                a[of] -= rate * step / np.sqrt(g[of])
    flat = e @ w
    kept = np.flatnonzero(back) if (back & (y < n - 1)).any() else np.arange(len(y))
    z, cy = np.concatenate([_dense([rows[j] for j in kept[i : i + 256]]) @ flat for i in range(0, len(kept), 256)]) + b, y[kept]
    temperature = _temperature(z, cy)
    p = _softmax(z / temperature)[:, :-1]
    known, best = cy < n - 1, p.argmax(axis=1)
    threshold = _threshold(p.max(axis=1)[known & (best == cy)], p.max(axis=1)[~known])
    return Model(languages, flat, b, temperature, threshold)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_rows: int = MAX_ROWS, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from labelled rows with an id and a letter that are not held out; without any, one that rejects all.

    The sample: of each of the `max_languages` most frequent labels, the rows of the smallest hashes of their ids, as
    many for each and `max_rows` at most in all. Their bucket counts (bounded, whatever the texts' lengths) reach the driver.
    """
    rows = scanned(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l"))
    rows = rows.where(~held_out("id") & F.col("id").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull())
    names = sorted(r.l for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_languages).collect())
    if not names:
        return none()
    share, rank = max(1, max_rows // len(names)), [F.xxhash64("id"), F.col("id")]
    ids = rows.select("id", "l", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8)).alias("part")).where(F.col("l").isin(names))
    for by in (["l", "part"], ["l"]):  # the first of each part hold the first of all, so a frequent label isn't ranked in one task
        ids = ids.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*rank))).where(F.col("r") <= share)
    ids = df.sparkSession.createDataFrame([(r.id, r.l) for r in ids.select("id", "l").distinct().collect()], "id long, l string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, lang, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if has_letter(t):
                    found += [(i, lang, counts(t)), (i, None, counts(twin(t, i)))]
            at = [np.flatnonzero(c).astype("<u2") for *_, c in found]
            cols = [[i for i, *_ in found], [x for _, x, _ in found], [a.tobytes() for a in at], [(c[a] / c.sum()).astype("<f4").tobytes() for a, (*_, c) in zip(at, found, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["id", "l", "at", "x"])

    drawn = rows.join(F.broadcast(ids), ["id", "l"]).groupBy("id", "l").agg(F.min("t").alias("t"))  # of rows that repeat an id, always the same
    sample = drawn.select("id", "l", "t").mapInArrow(tidied(run), "id long, l string, at binary, x binary").collect()
    sample.sort(key=lambda r: (r.id * 2654435761 % 2**32, r.id, r.l or "", bytes(r.x)))
    languages = sorted({r.l for r in sample if r.l is not None})
    if not languages:
        return none()
    y = np.array([len(languages) if r.l is None else languages.index(r.l) for r in sample], int)
    return fit([(np.frombuffer(r.at, "<u2"), np.frombuffer(r.x, "<f4")) for r in sample], y, languages)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, held_out, lang_pred, score, rejected. Only the whole text decides.

    A null text and one without letters get `und` and 0 and are rejected; null ids and repeated rows stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t) for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "held_out", "lang_pred", "score", "rejected"])

    rows = scanned(df).select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidied(run), f"{id_col} long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose text the model doesn't reject; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array([not model.predict(t)[2] for t in b.column(at).to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names)

    names = df.columns
    return scanned(df).toDF(*map(str, range(len(names)))).mapInArrow(tidied(run), df.schema)  # numbers: names may hold dots
