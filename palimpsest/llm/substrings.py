"""Removal of word windows that an earlier document has: level-wise doubling.

Levels are windows of ever twice the words, from FIRST or a little fewer up to the length asked for (13: 7, 13; 50: 7, 13,
25, 50). Each
full window names its short window with the least hash, and around it one window of each level, so equal full windows
name equal ones. A level keeps the windows that a second document has and extends them alone to the next; it ends when
none survives, or at full windows. Longer ones cannot cover a word that no full window covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Seen, chunks, flat, grams, mix, odd, rested, rows_of, ship, window_min, word_hashes, written
from .runs import lists, others, runs

_NO_ID = (1 << 63) - 1  # null doc_ids come after all others
#: Words of the first level's windows, at most: of shorter ones too many stand in other documents by chance.
FIRST = 7


def _hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk, and where each row's begin."""
    return word_hashes(*flat(col))


def levels(window: int) -> list[int]:
    """Lengths of the windows, each twice the one before or one less; two levels at least."""
    out = [window]
    while out[0] > FIRST or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of n words that stay in one row, and their rows."""
    row = rows_of(first)
    ok = np.arange(len(row)) + n <= first[1:][row]
    return np.flatnonzero(ok), row[ok]


def _distinct(*cols: np.ndarray) -> list[np.ndarray]:
    """Distinct rows."""
    order = np.lexsort(cols)
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return [c[new] for c in cols]


def _named(h: np.ndarray, window: int) -> list[np.ndarray]:
    """For each full window (of words in one row or not), hashes of the windows that it names, by level but the last."""
    *short, _ = levels(window)
    if len(h) < window:
        return [np.zeros(0, np.uint64) for _ in short]
    at = window_min(grams(h, short[0], 7), window - short[0] + 1)
    first = np.arange(len(at))
    return [grams(h, n, 7)[np.minimum(at, first + window - n)] for n in short]


def _sequence(h: np.ndarray, first: np.ndarray, seed: int = 23) -> np.ndarray:
    """A hash of each row's whole word sequence."""
    n = np.diff(first)
    at = np.arange(len(h)) - np.repeat(first[:-1], n)
    terms = mix((h ^ odd(2, seed)[1]) + at.astype(np.uint64) * odd(2, seed)[0])
    return np.array([terms[a:b].sum(dtype=np.uint64) for a, b in zip(first, first[1:])], np.uint64)


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in cols.values()], names=list(cols))


def _spread(id_: np.ndarray) -> np.ndarray:
    return mix(id_.astype(np.int64).view(np.uint64).copy()).view(np.int64)


def _level(text: DataFrame, window: int) -> DataFrame:
    """(id, named, copies): of each document, the windows of the last short level that another document has too, all levels
    before having survived, and hashes of whole word sequences that it and a document with a smaller id have.

    Kinds of rows: 0 a window, 1 a whole sequence (128 bits agree: key and v), both sent by their hashes; 2 and 3 the same
    with the answer known before the shuffle, so that they are dealt out by document: of a window that very many have,
    each task sends two."""
    *short, _ = levels(window)
    names = [f"h{k}" for k in range(len(short))]
    schema = ", ".join(f"{c} long" for c in ("key", "kind", "v", "id", *names))

    @rested
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, copies = Seen(), Seen(14)
        for b in chunks(batches):
            h, first = _hashed(b.column("text"))
            ids = b.column("id").to_numpy()
            at, row = _windows(first, window)
            *hs, id_ = _distinct(*(x[at] for x in _named(h, window)), ids[row])
            known = windows.twice(hs[0], id_)
            hs = [x.view(np.int64) for x in hs]
            yield _batch(key=np.where(known, _spread(id_), hs[0]), kind=2 * known, v=0 * id_, id=id_, **dict(zip(names, hs)))
            whole = np.diff(first) >= window
            w, v, id_ = (x[whole] for x in (_sequence(h, first), _sequence(h, first, 29), ids))
            known = copies.later(w ^ mix(v.copy()), id_)
            w, v = w.view(np.int64), v.view(np.int64)
            yield _batch(key=np.where(known, _spread(id_), w), kind=1 + 2 * known, v=v, id=id_, **{c: w for c in names})

    def shared(own: str, then: str | None, last: bool):
        @rested
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cols, first, again in others(batches, ["key", "kind", "v"], "id"):
                copy = cols["kind"] % 2 == 1
                keep = (cols["kind"] >= 2) | (again & (~copy | (cols["id"] > first)))
                out = {c: x[keep] for c, x in cols.items()}
                if last:
                    yield _batch(id=out["id"], h=out[own], kind=out["kind"] % 2)
                else:  # what survives goes on under its next hash; copies are settled
                    done = out["kind"] % 2 == 1
                    out["key"] = np.where(done, _spread(out["id"]), out[then])
                    out["kind"] = np.where(done, 3, 0)
                    yield _batch(**out)

        return run

    rows = text.mapInArrow(named, schema)
    for k in range(len(short)):
        last = k == len(short) - 1
        kind = "id long, h long, kind long" if last else schema
        run = shared(f"h{k}", None if last else f"h{k + 1}", last)
        rows = rows.repartition("key").sortWithinPartitions("key", "kind", "v", "id").mapInArrow(run, kind)
        if not last:
            rows = written(rows, "survivors")
            if rows.where("kind = 0").isEmpty():
                rows = rows.where("kind = 3").select("id", F.col("h0").alias("h"), F.lit(1).cast("long").alias("kind"))
                break
    return rows.groupBy("id").agg(*(F.collect_set(F.when(F.col("kind") == k, F.col("h"))).alias(name) for k, name in enumerate(("named", "copies"))))


def _copies(b: pa.RecordBatch, h: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Which rows have the word sequence of a document with a smaller id."""
    got, off = lists(b.column("copies"))
    if not off[-1]:
        return np.zeros(b.num_rows, bool)
    own = _sequence(h, first).view(np.int64)
    return np.array([n >= window and x in got[i:j] for n, x, i, j in zip(np.diff(first), own, off, off[1:])], bool)


def _extended(text: DataFrame, level: DataFrame, window: int) -> DataFrame:
    """(id, found): of each document, the full windows that a document with a smaller id has too."""
    @rested
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in chunks(batches):
            h, first = _hashed(b.column("text"))
            ids = b.column("id").to_numpy()
            got, off = lists(b.column("named"))
            at, row = _windows(first, window)
            w, v = grams(h, window, 5)[at], grams(h, window, 9)[at]
            named = _named(h, window)[-1][at].view(np.int64)
            cut = np.searchsorted(row, np.arange(b.num_rows + 1))
            keep = np.zeros(len(at), bool)
            for r in np.flatnonzero(~_copies(b, h, first, window)):
                own = slice(cut[r], cut[r + 1])
                keep[own] = np.isin(named[own], got[off[r] : off[r + 1]])
            w, v, id_ = _distinct(w[keep], v[keep] >> np.uint64(24), ids[row[keep]])
            known = seen.later(w ^ mix(v.copy()), id_)
            w = w.view(np.int64)
            yield _batch(key=np.where(known, _spread(id_), w), v=np.where(known, -1, v.astype(np.int64)), w=w, id=id_)

    @rested
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, first, _ in runs(batches, ["key", "v"], "id"):
            keep = (cols["id"] > first) | (cols["v"] == -1)
            yield _batch(id=cols["id"][keep], w=cols["w"][keep])

    rows = text.join(level.where(F.size("named") > 0), "id").mapInArrow(full, "key long, v long, w long, id long")
    found = rows.repartition("key").sortWithinPartitions("key", "v", "id").mapInArrow(later, "id long, w long")
    return found.groupBy("id").agg(F.collect_set("w").alias("found"))


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places a run of `width` from any of the starts covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0


def remove_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, text, n_words, n_removed: each text without the words covered by a window of `window` words whose word
    sequence also starts in a document with a smaller doc_id; kept words are joined by one space.

    Words are what stands between ASCII white space, unchanged. Windows are judged on the input, not on what is left.
    Null and empty texts have no words and an empty result; of a text of any length, only its word hashes and flags are in
    memory beside it. Rows with a null doc_id come after all others and not
    before each other; rows that share a doc_id don't count as smaller than each other, and each has its own result.
    Other columns are ignored.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    ship(docs.sparkSession)
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").cast("string"))
    level = written(_level(text, window), "named")
    found = _extended(text, level, window)
    known = level.where(F.size("copies") > 0).select("id", "copies").join(found, "id", "full")

    @rested
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            ids = b.column("id").to_pylist()
            got, off = lists(b.column("found"))
            h, first = _hashed(b.column("text"))
            copies = _copies(b, h, first, window)
            out: list[tuple] = []
            for r, raw in enumerate(texts):
                left = n = (raw or b"").split()
                if copies[r]:
                    left = []
                elif off[r + 1] > off[r] and len(n) >= window:
                    starts = np.flatnonzero(np.isin(grams(h[first[r] : first[r + 1]], window, 5).view(np.int64), got[off[r] : off[r + 1]]))
                    left = list(compress(n, (~covered(starts, len(n), window)).tolist()))
                out.append((None if ids[r] == _NO_ID else ids[r], b" ".join(left), len(n), len(n) - len(left)))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            cols[1] = cols[1].view(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_words", "n_removed"])

    return text.join(known, "id", "left").mapInArrow(kept, "doc_id long, text string, n_words long, n_removed long")


def digest(result: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of remove_windows' rows."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute(rows: list[tuple], window: int = 13) -> list[tuple]:
    """What the digest must be, by comparing everything with everything; for tests."""
    ids = [_NO_ID if i is None else i for i, _ in rows]
    split = [[w for w in (t or "").encode().split()] for _, t in rows]
    least: dict = {}
    for i, w in zip(ids, split):
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, i), i)
    out = []
    for (doc, _), i, w in zip(rows, ids, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
