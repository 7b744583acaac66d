"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered: 0 (clean) up to the highest. One weight per feature is shared by all thresholds t_1 < t_2 < ...; the
probability of grade k or more is the logistic function of w.x - t_k, and the expected severity is the sum of these
probabilities. A text's features are its words and their first 4 and 5 letters, hashed to BUCKETS numbers, each with
log(1 + its count per thousand words). Training is proximal gradient descent with an L1 penalty on the SCREENED features
that tell the grades apart best, so few features keep a weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import scanned, tidied

#: Bounds of the training sample and of the features that training weighs.
MAX_ROWS, BUCKETS, SCREENED = 4000, 1 << 18, 4096
#: Training rows that a feature must occur in.
RARE = 5
PENALTY, ROUNDS = 0.002, 300
#: Characters of a text whose words are taken at a time; words whose features a worker remembers.
CHUNK, CACHE = 1 << 20, 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Iterator[list[str]]:
    """The lower-cased words of a whole text, by chunks that end between words."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


def numbers(word: str) -> tuple[int, ...]:
    """The hashed features of a word: itself, and its first letters if it has more."""
    names = (word, *(f"{k}^{word[:k]}" for k in (4, 5) if len(word) > k))
    return tuple(zlib.crc32(n.encode()) % BUCKETS for n in names)


def features(text: str | None) -> dict[int, float]:
    seen: Counter[str] = Counter()
    for chunk in words(text or ""):
        seen.update(chunk)
    total, out = sum(seen.values()), Counter()
    for w, n in seen.items():
        for i in numbers(w):
            out[i] += n
    return {i: float(np.log1p(1000 * n / total)) for i, n in out.items()}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: np.ndarray
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def at_least(self, text: str | None) -> np.ndarray:
        """The probabilities of grade 1 or more, 2 or more, ..."""
        counts: Counter[int] = Counter()
        total, known, weights = 0, self.known, self.weights
        for chunk in words(text or ""):
            total += len(chunk)
            for w, n in Counter(chunk).items():
                own = known.get(w)
                if own is None:
                    if len(known) >= CACHE:
                        known.clear()
                    own = known[w] = tuple(i for i in numbers(w) if i in weights)
                for i in own:
                    counts[i] += n
        score = sum(weights[i] * np.log1p(1000 * n / total) for i, n in sorted(counts.items()))
        return _sigmoid(score - self.thresholds)


def fit(rows: list[dict[int, float]], grades: list[int], penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on the mean negative log-likelihood; thresholds stay ordered by their gaps' logarithms."""
    top = max(grades, default=0)
    if top < 1 or min(grades) > 0:
        return Model({}, np.full(max(1, top), np.inf if top < 1 else -np.inf))
    y = np.array(grades)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.fromiter((i for r in rows for i in r), np.int64, len(row))
    val = np.fromiter((v for r in rows for v in r.values()), np.float64, len(row))
    toxic, n = y[row] > 0, np.array([(y == 0).sum(), (y > 0).sum()])
    sums = [np.bincount(col, val * (toxic == k), BUCKETS) / n[k] for k in (0, 1)]
    spread = np.sqrt(np.bincount(col, val**2, BUCKETS) / len(y) + 1e-9)
    apart = np.where(np.bincount(col, minlength=BUCKETS) >= RARE, np.abs(sums[1] - sums[0]) / spread, 0)
    names = np.sort(np.argsort(-apart, kind="stable")[:SCREENED])
    names = names[apart[names] > 0]
    number = np.full(BUCKETS, -1)
    number[names] = np.arange(len(names))
    kept = number[col] >= 0
    row, col, val = row[kept], number[col[kept]], val[kept]
    above = np.array([(y >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    t = -np.log(above / (1 - above))
    gaps = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    w = np.zeros(len(names))

    def thresholds(g: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([g[:1], np.exp(g[1:])]))

    def slopes(w: np.ndarray, g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = np.bincount(row, w[col] * val, len(y))
        th = np.concatenate([[-np.inf], thresholds(g), [np.inf]])
        hi, lo = _sigmoid(score - th[y]), _sigmoid(score - th[y + 1])  # P(>= grade), P(> grade)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        ds = -(dhi - dlo) / p / len(y)
        dt = np.zeros(top)
        np.add.at(dt, y[y > 0] - 1, (dhi / p / len(y))[y > 0])
        np.add.at(dt, y[y < top], -(dlo / p / len(y))[y < top])
        dg = np.cumsum(dt[::-1])[::-1].copy()
        dg[1:] *= np.exp(g[1:])
        return float(-np.log(p).mean()), np.bincount(col, ds[row] * val, len(w)), dg

    step, ahead_w, ahead_g, momentum, last = 1.0, w, gaps, 1.0, np.inf
    for _ in range(rounds):
        loss, dw, dg = slopes(ahead_w, ahead_g)
        while True:
            nw = ahead_w - step * dw
            nw = np.sign(nw) * np.maximum(0, np.abs(nw) - step * penalty)
            ng = ahead_g - step * dg
            new = slopes(nw, ng)[0]
            mw, mg = nw - ahead_w, ng - ahead_g
            if new <= loss + dw @ mw + dg @ mg + (mw @ mw + mg @ mg) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if new + penalty * np.abs(nw).sum() > last:
            grown = momentum = 1.0
        ahead_w, ahead_g = nw + (momentum - 1) / grown * (nw - w), ng + (momentum - 1) / grown * (ng - gaps)
        last, w, gaps, momentum = new + penalty * np.abs(nw).sum(), nw, ng, grown
        step *= 1.3
    return Model({int(names[i]): float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}, thresholds(gaps))


def train(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled rows with a text, at most max_rows of them: the same share for every grade, filled up by
    rows of grade 0. `grade` is computed from `labels`; rows without an id or a grade, and ids not in `where`, don't count.
    Without a labelled row of any grade above 0 nothing is ever toxic.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), grade.cast("int").alias("y")).where(F.col("id").isNotNull() & (F.col("y") >= 0))
    if where is not None:
        rows = rows.where(where)
    drawn, rank = rows.distinct().withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8))), [F.xxhash64("id"), F.col("id")]
    for by in (["y", "part"], ["y"]):  # the first of each part hold the first of all, so a frequent grade isn't ranked in one task
        drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*rank))).where(F.col("r") <= max_rows)
    drawn = drawn.select("id", "y", "r").collect()
    tops = sorted({r.y for r in drawn})
    share = max_rows // max(1, 2 * (len(tops) - 1))
    keep = [(r.id, r.y) for r in drawn if r.y and r.r <= share]
    keep += [(r.id, r.y) for r in drawn if not r.y and r.r <= max_rows - len(keep)]
    if not keep:
        return fit([], [])
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t) for t in b.column(2).to_pylist()]
            cols = [[np.fromiter(f.keys(), "<u4", len(f)).tobytes() for f in found], [np.fromiter(f.values(), "<f4", len(f)).tobytes() for f in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.binary()) for c in cols)], ["id", "y", "at", "x"])

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    ids = F.broadcast(spark.createDataFrame(keep, "id long, y int"))
    found = text.join(ids, "id").groupBy("id", "y").agg(F.min("t").alias("t")).select("id", "y", "t").mapInArrow(tidied(run), "id long, y int, at binary, x binary").collect()
    found.sort(key=lambda r: (r.id, r.y))
    levels = sorted({r.y for r in found} | {0})
    rows = [dict(zip(np.frombuffer(r.at, "<u4").tolist(), np.frombuffer(r.x, "<f4").tolist(), strict=True)) for r in found]
    return fit(rows, [levels.index(r.y) for r in found])


def severity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, severity (expected grade), grade (the most probable), p_toxic (grade 1 or more), toxic.

    A null or empty text has no feature, so it gets what the thresholds alone say. Null ids and repeated rows stay.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [model.at_least(t) for t in b.column(1).to_pylist()]
            grade = [int(np.argmax(np.append(1, p) - np.append(p, 0))) for p in ps]
            cols = [pa.array([float(p.sum()) for p in ps]), pa.array(grade, pa.int32()), pa.array([float(p[0]) for p in ps]), pa.array([bool(p[0] >= 0.5) for p in ps], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "severity", "grade", "p_toxic", "toxic"])

    rows = scanned(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(tidied(run), f"{id_col} long, severity double, grade int, p_toxic double, toxic boolean")
