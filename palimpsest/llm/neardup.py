"""Near-duplicates by b-bit MinHash.

A document's set of word shingles gives minima under many hash functions. Bands of minima name candidates; the low bits
of the minima, packed, estimate a candidate pair's similarity from the bits that agree, corrected for chance; what may
reach the threshold is confirmed on the full sets. Equal sets count as one class, so copies never meet each other.

Documents that share a band form a group around the least of them, its pivot. A group is judged in blocks of bounded
size, each with the pivot, so work is in proportion to the members. Only members that this leaves outside the pivot's
component meet the other blocks: first through new pivots, and what is left in the end in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, grams, lower, mix, odd, rested, rows_of, ship, word_hashes, written
from .components import connected

BANDS, ROWS, BITS = 32, 5, 4
#: Standard deviations of the estimate that a pair may lie under the threshold and still be confirmed on its sets.
SLACK = 5.0
#: Bytes of shingle hashes in one block of a group.
BLOCK = 8 << 20
#: Rounds of new pivots (and one of pairs) for members of large groups that their pivot is not linked with.
ROUNDS = 3
_KEYS = ("pivot", "i", "j")


def shingles(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the offsets of the texts."""
    data, off = flat(col)
    h, first = word_hashes(lower(data), off)
    count = np.diff(first)
    row = rows_of(first)
    g = np.zeros(len(h), np.uint64)
    if len(h) >= n:
        g[: len(h) - n + 1] = grams(h, n, 3)
    ok = np.arange(len(h)) + n <= first[1:][row] if len(h) else np.zeros(0, bool)
    for r in np.flatnonzero((count > 0) & (count < n)):  # fewer words: the whole sequence is the one shingle
        a, b = first[r], first[r + 1]
        g[a] = mix((h[a:b] * odd(n, 4)[: b - a]).sum(dtype=np.uint64, keepdims=True) + count[r : r + 1].astype(np.uint64))[0]
        ok[a] = True
    parts, size = [], np.zeros(len(count) + 1, np.int64)
    for r in range(len(count)):
        own = np.sort(g[first[r] : first[r + 1]][ok[first[r] : first[r + 1]]])
        if len(own):
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        parts.append(own)
        size[r + 1] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(size)


def minima(u: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minima of each non-empty set under BANDS * ROWS hash functions."""
    k = BANDS * ROWS
    mul, xor = odd(k, 17), odd(k, 18)
    at = off[:-1][np.diff(off) > 0]
    out = np.empty((len(at), k), np.uint64)
    t = np.empty_like(u)
    for j in range(k):
        np.bitwise_xor(u, xor[j], out=t)
        np.multiply(t, mul[j], out=t)
        out[:, j] = np.minimum.reduceat(t, at) if len(at) else 0
    return out


def packed(sig: np.ndarray) -> np.ndarray:
    """Low BITS bits of each minimum, two to a byte."""
    low = (sig & np.uint64(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of one packed signature to many: minima that agree, less those that agree by chance."""
    x = a ^ b
    same = ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)
    c = 1 / (1 << BITS)
    return (same / (BANDS * ROWS) - c) / (1 - c)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """id, th, n, f1, f2, keys, sig: of each row with a doc_id, its set's size and 128-bit fingerprint, one key for each
    band and the packed signature; th is a hash of the text as it is."""

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = odd(ROWS, 19)
        for b in chunks(batches, most=1 << 18):
            u, off = shingles(b.column("text"), shingle)
            n = np.diff(off)
            some = n > 0
            f = np.zeros((2, len(n)), np.uint64)
            keys, sig = np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS * ROWS // 2), np.uint8)
            if some.any():
                for k in (0, 1):
                    f[k, some] = np.add.reduceat(mix(u ^ odd(2, 21)[k]), off[:-1][some])
                m = minima(u, off)
                sig = packed(m)
                keys = mix((m.reshape(-1, BANDS, ROWS) * mul).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
            lens = np.concatenate([[0], np.cumsum(some)]).astype(np.int32)
            raw = pa.py_buffer(np.ascontiguousarray(sig).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    b.column("th"),
                    pa.array(n),
                    pa.array(f[0].view(np.int64)),
                    pa.array(f[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lens * BANDS), pa.array(keys.ravel().view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((lens * sig.shape[1]).astype(np.int32)), raw]),
                ],
                names=["id", "th", "n", "f1", "f2", "keys", "sig"],
            )

    return docs.mapInArrow(run, "id long, th long, n long, f1 long, f2 long, keys array<long>, sig binary")


class Group:
    """Documents of one block, the pivot among them; finds links that join components. side: 0 if a document is to meet
    all others, 1 if it is to meet those of side 0 alone; label: components known before."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, side: np.ndarray, head: np.ndarray, sig: np.ndarray, u: np.ndarray, off: np.ndarray):
        self.ids, self.label, self.side, self.head, self.sig, self.off = ids, label.copy(), side, head, sig, off
        self.n = np.diff(off)
        vocabulary, code = np.unique(u, return_inverse=True)
        self.code, self.mark = code, np.zeros(len(vocabulary), bool)

    def common(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of one set with others."""
        self.mark[self.code[self.off[x] : self.off[x + 1]]] = True
        got = np.array([np.count_nonzero(self.mark[self.code[self.off[y] : self.off[y + 1]]]) for y in ys], np.int64)
        self.mark[self.code[self.off[x] : self.off[x + 1]]] = False
        return got

    def links(self, percent: int) -> Iterator[tuple[int, int]]:
        """Enough of the true links to connect what all of them connect."""
        m, t, label = len(self.ids), percent / 100, self.label
        p = t + (1 - t) / (1 << BITS)
        least = t - SLACK * np.sqrt(p * (1 - p) / (BANDS * ROWS)) / (1 - 1 / (1 << BITS))
        far = None
        order = np.lexsort((~self.head, self.side))  # the pivot first: it links most of its group
        for k, x in enumerate(order):
            if self.side[x]:
                break
            ys = order[k + 1 :]
            ok = (label[ys] != label[x]) & (100 * np.minimum(self.n[ys], self.n[x]) >= percent * np.maximum(self.n[ys], self.n[x]))
            if far is not None:  # distances to the pivot differ by no more than a link's own
                ok &= np.abs(far[ys] - far[x]) <= 1 - t + 1e-9
            ys = ys[ok]
            if not len(ys):
                continue
            if k == 0 and self.head[x] and m > 8:
                both = self.common(x, np.arange(m))
                far = 1 - both / np.maximum(self.n + self.n[x] - both, 1)
            ys = ys[agreement(self.sig[x], self.sig[ys]) >= least]
            both = self.common(x, ys)
            for y in ys[100 * both >= percent * (self.n[x] + self.n[ys] - both)]:
                if label[y] != label[x]:
                    yield int(self.ids[x]), int(self.ids[y])
                    label[label == label[y]] = label[x]


def _tasks(work: DataFrame) -> DataFrame:
    """(id, tasks) from work: pivot, i and j name a block; id, comp, side and head are as `Group` has them."""
    return work.groupBy("id").agg(F.collect_list(F.struct(*_KEYS, "comp", "side", "head")).alias("tasks"))


def _links(full: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) found in blocks, from (id, th, text, sig, tasks)."""

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            _, one = np.unique(np.stack([t.column(c).to_numpy() for c in ("id", "th")]), axis=1, return_index=True)
            if len(one) > 1:
                t = t.take(pa.array(one)).combine_chunks().to_batches()[0]
                u, off = shingles(t.column("text"), shingle)
                sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(one), -1)
                ids, comp, side, head = (t.column(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "side", "head"))
                found = np.array(list(Group(ids, comp, side, head, sig, u, off).links(percent)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in _KEYS], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if held and tuple(held[-1].column(k)[0].as_py() for k in _KEYS) != tuple(keys[i].tolist()):
                    yield from done()
                    held.clear()
                held.append(b.slice(i, j - i))
        if held:
            yield from done()

    full = full.select("id", "th", "text", "sig", F.explode("tasks").alias("t")).select("id", "th", "text", "sig", "t.*")
    return full.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "side", "id").mapInArrow(run, "u long, v long")


def _zero():
    return F.lit(0).cast("long")


def _around(members: DataFrame, pivot: str) -> DataFrame:
    """Work that deals members (id, comp, pivot, nb) out to nb blocks, with the one that `pivot` names in each."""
    head = F.col("id") == F.col(pivot)
    blocks = F.when(head, F.sequence(_zero(), F.col("nb") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("nb"))))
    return members.select("pivot", F.explode(blocks).alias("i"), _zero().alias("j"), "id", "comp", _zero().alias("side"), head.alias("head"))


def _all_links(members: DataFrame, text: DataFrame, single: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) from members (id, n, pivot) of groups."""
    size = F.ceil(F.sum("n") * 8 / BLOCK).cast("long")
    large = written(members.groupBy("pivot").agg(size.alias("nb")).where("nb > 1"), "sizes")
    start = members.join(large, "pivot", "left").select("id", "pivot", F.col("id").alias("comp"), F.coalesce("nb", F.lit(1).cast("long")).alias("nb"))
    own = _tasks(_around(start, "pivot")).join(single.select("id", "th", "sig"), "id")
    grouped = written(text.join(own, ["id", "th"]), "grouped")  # whole texts are dealt out once; later rounds need these alone
    roots = connected(_links(grouped, shingle, percent))
    wide = None if large.isEmpty() else written(members.join(large, "pivot"), "large")
    for k in range(ROUNDS if wide else 0):
        state = wide.join(roots.toDF("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        main = written(state.where("id = pivot").select("pivot", F.col("comp").alias("main")), "main")
        state = written(state.join(main, "pivot"), "state")
        rest = state.where("comp <> main")
        if rest.isEmpty():
            break
        if k < ROUNDS - 1:
            second = written(rest.groupBy("pivot").agg(F.min(F.struct("id", "comp")).alias("s")).select("pivot", F.col("s.id").alias("second"), F.col("s.comp").alias("own")), "pivots")
            work = _around(state.join(second, "pivot").where("comp <> own or id = second"), "second")
        else:
            nr = written(rest.groupBy("pivot").agg(size.alias("nr")), "sizes")
            every, own = lambda n: F.explode(F.sequence(_zero(), F.col(n) - 1)), lambda n: F.pmod(F.xxhash64("id"), F.col(n))
            columns = lambda i, j, side: ["pivot", "id", "comp", i.alias("i"), j.alias("j"), F.lit(side).cast("long").alias("side"), F.lit(False).alias("head")]
            left = rest.join(nr, "pivot").select(*columns(own("nr"), every("nb"), 0))
            work = left.union(state.join(nr, "pivot").select(*columns(every("nr"), own("nb"), 1)))
        roots = connected(roots.toDF("u", "v").union(_links(grouped.drop("tasks").join(_tasks(work), "id"), shingle, percent)))
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """See `judged`, whose th this leaves out."""
    return judged(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates: the rows of docs, with all columns, that are kept; of repeated
    rows (doc_id and text the same) one stays. Rows without a doc_id stay."""
    keys = ["doc_id", "th"]
    odd_ones = judged(docs, shingle, percent).where("doc_id is not null").groupBy(*keys).agg(F.count("*").alias("__rows"), F.first("kept").alias("__kept"))
    odd_ones = written(odd_ones.where("not __kept or __rows > 1"), "decisions")
    own = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    odd_ones = odd_ones.toDF("__id", "__th", "__rows", "__kept")
    most = own.join(odd_ones, ["__id", "__th"], "left_anti")
    again = own.join(odd_ones.where("__kept"), ["__id", "__th"]).dropDuplicates(["__id", "__th"])
    return most.select(docs.columns).union(again.select(docs.columns))


def judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept: documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the least doc_id reachable and kept says that it is the document's own.

    th is xxhash64 of the text. Texts are lower-cased (A-Z) and split at ASCII white space; a set holds the distinct shingles of `shingle` words,
    or the whole sequence if it is shorter. Null, empty and blank texts have an empty set and no links. Rows without a
    doc_id are linked to nothing: their component_id is null and they are kept. Repeated rows have one result each,
    the same; rows that share a doc_id but not the text are judged by their texts, and links of either hold for the
    doc_id. Other columns are ignored; an empty table gives no rows. Of a text of any length, only its shingles' hashes
    are in memory beside it. Every pair that a band names and that may join two components is judged, in blocks of
    bounded size; a true pair at 0.8 escapes all bands with a chance under 1e-5, and the estimate's slack with one under
    1e-6.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).withColumn("th", F.xxhash64("text"))
    made = written(sketches(text, shingle), "sketches")
    known = made.where("n > 0 and id is not null")
    classes = written(known.groupBy("f1", "f2", "n").agg(F.min("id").alias("least")), "classes")
    single = known.join(classes.withColumnRenamed("least", "id"), ["f1", "f2", "n", "id"]).dropDuplicates(["id", "th"])
    single = written(single, "representatives")
    bands = single.select("id", "n", F.explode("keys").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot")
    members = written(bands.join(pivots, "key").select("id", "n", "pivot").distinct(), "members")
    roots = _all_links(members, text, single, shingle, percent)
    ids = classes.join(roots, classes.least == roots.node, "left").select("f1", "f2", "n", F.coalesce("component", "least").alias("component"))
    out = made.select("id", "th", "n", "f1", "f2").join(ids, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def brute(rows: list[tuple], shingle: int = 5, percent: int = 80) -> list[tuple]:
    """What near_duplicates must give, by comparing all pairs; for tests with distinct doc_ids."""
    up = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(up).split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, _) in enumerate(rows):
        for b in range(a):
            j = rows[b][0]
            if i is not None and j is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets)]
