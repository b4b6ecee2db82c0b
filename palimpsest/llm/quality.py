"""Quality classifier: ordinal regression with cumulative links.

All grades share one weight for each hashed text feature; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold_k - score). A document's expected grade and the probability that it has at least a
given grade follow, and the latter selects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, hashed, parts, rested, rows_of, ship, words

#: Buckets of hashed byte trigrams; after them come repeats of words at 1 to LAGS places, word lengths, and a count.
BUCKETS, LAGS, LENGTHS = 4096, 8, 24
WIDTH = BUCKETS + LAGS + LENGTHS + 1
#: Different grades that a model takes at most.
GRADES = 64


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values over rows given by offsets; rows may be empty."""
    out = np.zeros(len(off) - 1)
    some = np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(values, off[:-1][some], dtype=np.float64)
    return out


def _parts(col: pa.Array):
    """Of a chunk: trigram buckets and their rows' offsets, word hashes, word lengths and the words' offsets."""
    data, off = flat(col)
    d = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(20)
    within = np.ones(len(data), bool)  # the last two bytes of a row begin no trigram of its own
    for k in (1, 2):
        at = off[1:] - k
        within[at[at >= off[:-1]]] = False
    start, end, first = words(data, off)
    off = np.concatenate([[0], np.cumsum(np.maximum(np.diff(off) - 2, 0))])
    return bucket[within], off, hashed(data, start, end), np.minimum(end - start, LENGTHS) - 1, first


def _again(h: np.ndarray, first: np.ndarray, lag: int) -> np.ndarray:
    """Whether a word is the one `lag` places before it in its row."""
    out = np.zeros(len(h), bool)
    out[lag:] = h[lag:] == h[:-lag]
    if len(h):
        row = rows_of(first)
        out[lag:] &= row[lag:] == row[:-lag]
    return out


def features(col: pa.Array) -> np.ndarray:
    """One row of WIDTH shares for each text."""
    out, grams, count = np.zeros((len(col), WIDTH), np.float32), np.zeros(len(col)), np.zeros(len(col))
    for texts, rows in parts(col):
        bucket, off, h, size, first = _parts(texts)
        for k, r in enumerate(rows.tolist()):
            out[r, :BUCKETS] += np.bincount(bucket[off[k] : off[k + 1]], minlength=BUCKETS)
            out[r, BUCKETS + LAGS : -1] += np.bincount(size[first[k] : first[k + 1]], minlength=LENGTHS)
        for lag in range(1, LAGS + 1):
            np.add.at(out[:, BUCKETS + lag - 1], rows, _sums(_again(h, first, lag), first))
        np.add.at(grams, rows, np.diff(off))
        np.add.at(count, rows, np.diff(first))
    out[:, :BUCKETS] /= np.maximum(grams, 1)[:, None]
    out[:, BUCKETS:-1] /= np.maximum(count, 1)[:, None]
    out[:, -1] = np.log1p(count) / 10
    out[count == 0] = 0
    return out


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores of texts, and how many words each has, without a feature matrix."""
        w, total = self.weights, np.zeros((4, len(col)))  # sums over trigrams and words, and how many of either
        for texts, rows in parts(col):
            bucket, off, h, size, first = _parts(texts)
            by_word = _sums(w[BUCKETS + LAGS + size], first)
            for lag in range(1, LAGS + 1):
                by_word += w[BUCKETS + lag - 1] * _sums(_again(h, first, lag), first)
            for k, x in enumerate((_sums(w[bucket], off), by_word, np.diff(off), np.diff(first))):
                np.add.at(total[k], rows, x)
        grams, by_word, n, m = total
        s = grams / np.maximum(n, 1) + by_word / np.maximum(m, 1) + w[-1] * np.log1p(m) / 10
        return np.where(m > 0, s, 0), m

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for all k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -60, 60)))


def fit(x: np.ndarray, grade: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """Maximum likelihood by Adam over the whole sample, with a penalty on the weights."""
    grades = np.unique(grade)
    k = len(grades)
    y = np.searchsorted(grades, grade)
    if k < 2:
        return Model(grades.tolist(), np.zeros(WIDTH), np.zeros(0))
    scale = x.std(0) + 1e-4
    scale *= np.sqrt(((x / scale) ** 2).sum(1).mean())
    x = x / scale
    p = np.zeros(x.shape[1] + k - 1, np.float64)
    p[-(k - 1) :] = np.concatenate([[-(k - 2) / 2.0], np.zeros(k - 2)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    balance = (len(y) / k / np.bincount(y, minlength=k))[y] / len(y)
    for step in range(1, steps + 1):
        w, raw = p[: x.shape[1]], p[x.shape[1] :]
        cut = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
        s = x @ w.astype(np.float32)
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(edges[y + 1] - s, -40, 40)))), (1 / (1 + np.exp(-np.clip(edges[y] - s, -40, 40))))
        likely = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) * (y < k - 1), lo * (1 - lo) * (y > 0)
        ds = balance * (dhi - dlo) / likely  # of the loss, by the score
        dcut = np.zeros(k - 1)
        np.add.at(dcut, np.minimum(y, k - 2), -balance * dhi / likely)
        np.add.at(dcut, np.maximum(y - 1, 0), balance * dlo / likely)
        after = np.cumsum(dcut[::-1])[::-1]
        draw = np.concatenate([after[:1], after[1:] * np.exp(raw[1:])])
        g = np.concatenate([x.T @ ds.astype(np.float32) + decay * w, draw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = p[x.shape[1] :]
    return Model(grades.tolist(), p[: x.shape[1]] / scale, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))]))


def sample(docs: DataFrame, labels: DataFrame, grade: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and grades of at most `most` labelled rows, as many of each grade where there are, chosen by a hash of
    the doc_id; only features (of fixed size) come to the driver."""
    rated = labels.select(F.col("doc_id").cast("long"), F.col(grade).cast("double").alias("grade")).dropna().dropDuplicates()
    grades = [r.grade for r in rated.select("grade").distinct().limit(GRADES + 1).collect()]
    if len(grades) > GRADES:
        raise ValueError(f"more than {GRADES} grades")
    picked = None
    for g in sorted(grades):
        some = rated.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // len(grades))
        picked = some if picked is None else picked.union(some)
    if picked is None:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    # As many rows as were picked: their number is known before they are broadcast. Of rows that share an id one counts.
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    text = text.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "grade", "x"])

    got = sorted(text.mapInArrow(run, "doc_id long, grade double, x binary").collect())
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(-1, WIDTH)
    return x, np.array([r.grade for r in got])


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", most: int = 3000) -> Model:
    """A model from at most `most` labelled rows. A row without words is no evidence and is left out."""
    x, y = sample(docs, labels, grade, most)
    some = x.any(1)
    return fit(x[some], y[some])


def graded(docs: DataFrame, model: Model, at_least: float) -> DataFrame:
    """All columns of docs, then expected_grade, tail_probability (that the grade is at least `at_least`) and selected
    (a tail of one half or more).

    Null, empty and blank texts have the lowest grade and are not selected. A model without labels selects all others
    and leaves the two numbers null; with one grade it expects that. Repeated rows and null doc_ids are graded row by
    row. A text of more than a block is graded in parts whose sums are added. Columns of docs with the names of new ones
    are replaced; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    new = ("expected_grade", "tail_probability", "selected")
    docs = docs.drop(*new)
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        grades = np.array(m.grades)
        for b in chunks(batches):
            s, n = m.scores(b.column("text"))
            if len(grades):
                tails = np.concatenate([np.ones((len(s), 1)), m.tails(s)], 1)
                tails[n == 0, 1:] = 0
                expected = grades[0] + (tails[:, 1:] * np.diff(grades)).sum(1)
                reach = int(np.searchsorted(grades, at_least))
                tail = tails[:, reach] if reach < len(grades) else np.zeros(len(s))
                cols = [pa.array(expected), pa.array(tail), pa.array((tail >= 0.5) & (n > 0))]
            else:
                none = pa.nulls(len(s), pa.float64())
                cols = [none, none, pa.array(n > 0)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, f"{fields}, expected_grade double, tail_probability double, selected boolean")
