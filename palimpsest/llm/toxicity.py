"""Toxicity: embeddings of subwords, averaged over a text, under a linear softmax; both trained jointly in numpy.

A text's subwords are its words and their character n-grams, hashed into buckets that have embeddings, so a misspelling
that was never seen shares the vectors of the n-grams it keeps. As nothing but an average lies between embeddings and
softmax, a trained model scores through one number for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, hashed, lower, parts, rested, ship, words
from .decontam import BREAK

#: Hash buckets (as a power of two), embedding length, lengths of n-grams in bytes.
BITS, DIM, SIZES = 18, 8, (3, 4, 5)


def subwords(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of subwords and the rows they belong to, a kind at a time. A-Z is lower-cased; ASCII characters but
    letters and digits part words; n-grams include one blank before and behind a word."""
    data, off = flat(col)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    pad, of = np.full(len(data) + len(off), 32, np.uint8), np.zeros(len(data) + len(off), np.int32)
    at = np.arange(len(data)) + row + 1
    pad[at], of[at] = lower(data), row
    pad[BREAK[pad]] = 32
    start, end, _ = words(pad, np.array([0, len(pad)]))
    yield (hashed(pad, start, end) >> np.uint64(64 - BITS)).astype(np.int32), of[start]
    blanks = np.concatenate([[0], np.cumsum(pad == 32, dtype=np.int32)])
    wide = pad.astype(np.uint32)
    for k in SIZES:
        m = len(pad) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint32)
        for j in range(k):
            h ^= wide[j : j + m]
            h *= np.uint32(16777619)
        at = np.flatnonzero(blanks[k - 1 : k - 1 + m] == blanks[1 : 1 + m])  # no blank but at an end
        h = h[at]
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - BITS)).astype(np.int32), of[at + 1]


@dataclass
class Model:
    """For two classes: what each bucket adds to the second one's logit on average, and the logit of no subwords."""

    table: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        n = len(col)
        total, count = np.zeros(n), np.zeros(n)
        for texts, rows in parts(col):
            for bucket, row in subwords(texts):
                np.add.at(total, rows, np.bincount(row, self.table[bucket], len(rows)))
                np.add.at(count, rows, np.bincount(row, minlength=len(rows)))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -60, 60)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 250, rate: float = 0.2, decay: float = 1e-6, z: float = 5.0) -> Model:
    """Embeddings and softmax by Adam, on whole-sample gradients of the cross entropy; classes weigh the same.

    Only buckets that the two classes' texts have with different frequency (by `z` standard errors) get an embedding;
    the others stay zero, or chance would be learned by heart. bags: buckets of each text, and how often each occurs.
    Without two classes the score is one half for all texts.
    """
    table = np.zeros(1 << BITS, np.float32)
    if len(np.unique(y)) < 2:
        return Model(table, 0.0)
    bucket = np.concatenate([b for b, _ in bags])
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b, _ in bags])
    val = np.concatenate([c / c.sum() for _, c in bags])
    n = np.bincount(y, minlength=2)
    there = [np.bincount(bucket[y[doc] == k], minlength=1 << BITS) for k in (0, 1)]
    share = (there[0] + there[1]) / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n[0] + 1 / n[1]))
    keep = (np.abs(there[1] / n[1] - there[0] / n[0]) >= z * error)[bucket]
    used, col = np.unique(bucket[keep], return_inverse=True)
    doc, val = doc[keep], val[keep]
    rng = np.random.default_rng(7)
    params = [np.zeros((DIM, len(used))), rng.normal(0, 1, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    target, weight = np.eye(2)[y], (len(y) / 2 / n)[y][:, None] / len(y)
    for step in range(1, epochs + 1):
        emb, soft, bias = params
        hidden = np.stack([np.bincount(doc, emb[d][col] * val, len(bags)) for d in range(DIM)], 1)
        logits = hidden @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        dz = (p - target) * weight
        dh = dz @ soft.T
        grads = [np.stack([np.bincount(col, dh[doc, d] * val, len(used)) for d in range(DIM)]) + decay * emb, hidden.T @ dz, dz.sum(0)]
        for q, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    emb, soft, bias = params
    table[used] = (soft[:, 1] - soft[:, 0]) @ emb
    return Model(table, float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    """Whether a row is held out: crc32 of the doc_id as text is divisible by 5; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """A model from at most `most` labelled rows that are not held out, as many of either class where there are, chosen
    by a hash of the doc_id. Their bags, of bounded size each, come to the driver."""
    rated = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1)").where(~fold(F.col("doc_id"))).dropDuplicates()
    picked = None
    for k in (0, 1):
        some = rated.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        picked = some if picked is None else picked.union(some)
    # As many rows as were picked: their number is known before they are broadcast. Of rows that share an id one counts.
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    text = text.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            bags = [bag(b.column("text").slice(r, 1)) for r in range(b.num_rows)]
            bags = [x.astype(np.int32).tobytes() + np.minimum(n, 65535).astype(np.uint16).tobytes() for x, n in bags]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(bags, pa.binary())], names=["doc_id", "toxic", "bag"])

    got = sorted(text.mapInArrow(run, "doc_id long, toxic int, bag binary").collect())
    bags = [(np.frombuffer(r.bag, np.int32, len(r.bag) // 6), np.frombuffer(r.bag, np.uint16, offset=len(r.bag) // 6 * 4)) for r in got if r.bag]
    return fit(bags, np.array([r.toxic for r in got if r.bag], int))


def bag(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text, and how often it has each."""
    each = [np.unique(bucket, return_counts=True) for part, _ in parts(text) for bucket, _ in subwords(part)]
    if not each:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bucket, of = np.unique(np.concatenate([x for x, _ in each]), return_inverse=True)
    return bucket, np.bincount(of, np.concatenate([n for _, n in each])).astype(np.int64)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic) and predicted (1 from one half on) of every row.

    Null, empty and blank texts have the score of no evidence, the model's bias. Repeated rows and null doc_ids (held
    out) are scored row by row; nothing but the text goes into a score. A text of more than a block is scored in parts
    whose sums are added. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            s = held.value.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), fold(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
