"""What the corpus operators share: shared storage, shipping the package, and vectorised work on UTF-8 bytes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space; all other bytes are parts of words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes hashed at once, and the longest piece of a text that is looked at byte by byte.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_FALLBACK: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}  # tables written, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir, or a temporary one of this machine where it is
    unset and there are no other machines."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = Path(tempfile.mkdtemp(prefix="palimpsest-")).as_uri()
    return _FALLBACK[key]


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that `written` has made for this application; results that still read them end."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        to = os.path.join(tempfile.mkdtemp(), "palimpsest.zip")
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(to)
        sc._palimpsest_shipped = sc.applicationId
    return spark


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each, so that a worker's arrays stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(n) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def pieces(b: pa.RecordBatch, overlap: int, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch as it is, or, where a text is longer than `most`, batches in which its pieces are rows; with the byte at
    which each row begins in its text. Pieces overlap, so that all strings of overlap + 1 bytes are there, each once."""
    n = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(n > most)
    at = 0
    for r in [*long.tolist(), b.num_rows]:
        if r > at:
            yield b.slice(at, r - at), np.zeros(r - at, np.int64)
        if r < b.num_rows:
            own = b.slice(r, 1)
            raw = pa.py_buffer(own.column("text").cast(pa.binary())[0].as_buffer())
            k = own.schema.get_field_index("text")
            for begin in range(0, int(n[r]) - overlap, most - overlap):
                part = pa.array([raw.slice(begin, min(most, int(n[r]) - begin)).to_pybytes()], pa.binary())
                yield own.set_column(k, "text", part), np.array([begin])
        at = r + 1


def parts(col: pa.Array, most: int = BLOCK) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Texts and their rows, about `most` bytes at once; a longer text comes in parts, cut behind white space (inside a
    word only if that is longer), none overlapping."""
    n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    share = np.cumsum(n) // most
    share[n > most] = -1
    cuts = [0, *(np.flatnonzero(share[1:] != share[:-1]) + 1).tolist(), len(col)]
    for i, j in zip(cuts, cuts[1:]):
        if i == j:
            continue
        if n[i] <= most:
            yield col.slice(i, j - i), np.arange(i, j)
            continue
        for r in range(i, j):
            raw, at = col.slice(r, 1).cast(pa.binary())[0].as_py(), 0
            while at < len(raw):
                end = min(at + most, len(raw))
                if end < len(raw):
                    end = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r")) + 1 or end
                    end = end if end > at else min(at + most, len(raw))
                yield pa.array([raw[at:end]], pa.binary()), np.array([r])
                at = end


class Seen:
    """What a task remembers of the keys it has sent to a shuffle, so that a key with very many rows costs two rows for
    each task. It forgets under pressure, which only means that more is sent."""

    def __init__(self, bits: int = 17):
        self.shift = np.uint64(64 - bits)
        self.key, self.id, self.many = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int8)

    def _at(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (mix(key.copy()) >> self.shift).astype(np.int64)
        return at, (self.key[at] == key) & (self.many[at] > 0)

    def twice(self, key: np.ndarray, id: np.ndarray | None = None) -> np.ndarray:
        """Which rows are known to have been preceded by two others of their key (with different ids, if there are ids);
        these need not be sent, as the two meet wherever keys meet."""
        n = len(key)
        if not n:
            return np.zeros(0, bool)
        own = np.arange(n) if id is None else id
        order = np.lexsort((own, key))
        k, i = key[order], own[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        head = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        at, hit = self._at(k[head])
        # How many different ids came before each row: those remembered, then those of this run.
        change = new.copy()
        change[1:] |= i[1:] != i[:-1]
        rank = np.cumsum(change)
        rank -= rank[head][run]
        other = hit & (True if id is None else self.id[at] != i[head])
        before = np.where(hit & (self.many[at] == 2), 2, other.astype(np.int64))[run] + rank
        last = np.append(head[1:], n) - 1
        self.many[at] = np.minimum(before[last] + 1, 2)
        self.id[at] = np.where(hit, self.id[at], i[head])
        self.key[at] = k[head]
        out = np.empty(n, bool)
        out[order] = before >= 2
        return out

    def later(self, key: np.ndarray, id: np.ndarray) -> np.ndarray:
        """Which rows are known to have a row of their key with a smaller id; the rest are sent."""
        n = len(key)
        if not n:
            return np.zeros(0, bool)
        order = np.lexsort((id, key))
        k, i = key[order], id[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        head, run = np.flatnonzero(new), np.cumsum(new) - 1
        at, hit = self._at(k[head])
        least = np.where(hit, np.minimum(self.id[at], i[head]), i[head])
        self.key[at], self.id[at], self.many[at] = k[head], least, 1
        out = np.empty(n, bool)
        out[order] = i > least[run]
        return out


def rested(run: Callable) -> Callable:
    """The same function over batches, whose task gives unused memory back when it ends: workers live on, and several
    share an executor."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte array and the offsets of its rows; null is empty."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def odd(n: int, seed: int) -> np.ndarray:
    """n random odd multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(2 * BLOCK + 2, _BASE, np.uint64)
    up[0] = 1
    down = np.full(2 * BLOCK + 2, pow(_BASE, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base modulo 2**64, and of its inverse; n is two blocks at most."""
    if n > 2 * BLOCK:
        raise ValueError("more than two blocks at once")
    return _powers()


def prefix(data: np.ndarray, seed: int = 11) -> np.ndarray:
    """Prefix sums of a polynomial hash: entry i covers the bytes before i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(seed)[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end)."""
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start] + (end - start).astype(np.uint64))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 11) -> np.ndarray:
    """`spans` of [start, end) in data, both ascending; memory beyond the result doesn't grow with data."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + BLOCK, "right"))
        if j > i:
            out[i:j] = spans(prefix(data[at : end[j - 1]], seed), start[i:j] - at, end[i:j] - at)
        else:  # longer than a block
            j, total, lift = i + 1, np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for k in range(at, end[i], BLOCK):
                part = data[k : min(k + BLOCK, end[i])]
                total += prefix(part, seed)[-1:] * lift
                lift *= powers(BLOCK)[0][BLOCK : BLOCK + 1]
            out[i] = mix(total + np.uint64(end[i] - at))[0]
        i = j
    return out


def words(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are not breaks) as [start, end) and, for each row, where its words begin in those arrays
    (one entry more than rows)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    space = np.ones(n + 2, bool)
    space[1:-1] = breaks[data]
    word = ~space[1:-1]
    start = np.flatnonzero(word & (space[:-2] | edge[:-1]))
    end = np.flatnonzero(word & (space[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where the rows' words begin."""
    start, end, first = words(data, off, breaks)
    return hashed(data, start, end), first


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def grams(w: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """Hashes of n consecutive word hashes, for each start that has as many after it (rows are not looked at)."""
    c, m = odd(n, seed), max(len(w) - n + 1, 0)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += w[k : k + m] * c[k]
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from where the rows' words begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Where the first least value stands in each w consecutive values of x."""
    n = len(x) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # The low half gives way to the place, so that equal values keep the first and one minimum yields both.
    bits = np.uint64(32)
    key = ((x >> bits) << bits) | np.arange(len(x), dtype=np.uint64)
    pad = np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate([key, pad]).reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    best = np.minimum(right[:n], left[w - 1 : w - 1 + n])
    return (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
