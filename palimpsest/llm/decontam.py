"""Benchmark decontamination: a BM25 inverted index of test items, searched with every training passage.

An item's BM25 impacts are divided by the least score that a passage with enough of the item can have, so that one
threshold, 1, holds for all items and loses none. Block maxima of the impacts bound each passage's scores; passages that
some block may let through are searched by block-max WAND, and what it retrieves is verified on word shingles of the
item's question and answer.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, flat, grams, lower, mix, odd, rested, ship, word_hashes, written

#: ASCII characters other than letters and digits part words here, so punctuation and case don't matter.
BREAK = SPACE.copy()
BREAK[:128] |= np.array([not chr(c).isalnum() for c in range(128)])
#: Bytes of test items in one index; of more items, a task holds one index at a time.
SHARD = 16 << 20
#: Bytes of word hashes that a task holds while it goes through the indexes of many items.
HELD = 32 << 20
#: Ranges of items for which every passage's scores are bounded at once, before any list is walked.
BOUNDS = 64
_SCHEMA = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double, overlap double"


def hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, and where each text's begin."""
    data, off = flat(col)
    return word_hashes(lower(data), off, BREAK)


def shingled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words; of fewer words, the whole sequence is the one shingle."""
    if len(h) >= n:
        return grams(h, n, 3)
    return mix((h * odd(n, 4)[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h))) if len(h) else np.zeros(0, np.uint64)


def short_grams(h: np.ndarray, m: int, n: int) -> np.ndarray:
    """Hashes of all sequences of m words, each as `shingled` hashes a text of m < n words."""
    if len(h) < m:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - m + 1, np.uint64)
    for k in range(m):
        total += h[k : k + len(total)] * odd(n, 4)[k]
    return mix(total + np.uint64(m))


def question(text: str) -> str:
    """The part of an item before its answer: up to the last question mark that has words behind it, else up to its
    last sentence."""
    ends = [m.end() for m in re.finditer(r"[?]", text) if re.search(r"\w", text[m.end() :])]
    ends = ends or [m.end() for m in re.finditer(r"[.!?]\s+|\n", text) if re.search(r"\w", text[m.end() :])]
    return text[: ends[-1]] if ends else text


@dataclass
class Postings:
    items: list[int]
    impacts: list[float]
    most: float
    ends: list[int] = field(default_factory=list)  # last item of each block
    tops: list[float] = field(default_factory=list)  # largest impact of each block


@dataclass
class Statistics:
    """Of all items: how many have words, words of one on average and at most, and in how many each of some terms is."""

    items: int
    average: float
    longest: int
    terms: np.ndarray
    frequency: np.ndarray


class Index:
    """Items by term, with impacts scaled so that every item's threshold is 1. Without statistics of all items, these are
    all."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, overlap: float, k1: float = 1.2, b: float = 0.75, block: int = 8, whole: Statistics | None = None):
        self.shingle, self.overlap = shingle, overlap
        rows = []
        for i, text in items:
            h, _ = hashed(pa.array([text or ""]))
            if len(h):
                rows.append((i, h, len(hashed(pa.array([question(text)]))[0])))
        self.ids = [i for i, _, _ in rows]
        self.shingles, self.answers = [], []
        terms, frequency = [], defaultdict(int)
        for _, h, q in rows:
            s = shingled(h, shingle)
            self.shingles.append(s)
            self.answers.append(np.arange(len(s)) + shingle > q)  # shingles that reach into the answer
            t, tf = np.unique(h, return_counts=True)
            terms.append((t, tf))
            for x in t.tolist():
                frequency[x] += 1
        self.terms = np.array(sorted(frequency), np.uint64)
        n = len(rows)
        if whole is None:
            sizes = [len(h) for _, h, _ in rows] or [1]
            whole = Statistics(n, np.mean(sizes), max(sizes), self.terms, np.array([frequency[x] for x in self.terms.tolist()]))
        df, average = whole.frequency[np.searchsorted(whole.terms, self.terms)].astype(float), whole.average
        self.longest = whole.longest
        idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
        per: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for k, ((t, tf), (_, h, _)) in enumerate(zip(terms, rows)):
            at = np.searchsorted(self.terms, t)
            impact = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(h) / average))
            # If a share `overlap` of the shingles is there, so many words can be missing at most, the dearest perhaps.
            gone = int(len(self.shingles[k]) - np.ceil(overlap * len(self.shingles[k]) - 1e-9))
            least = np.sort(impact)[: max(len(impact) - gone, 1)].sum()
            for x, s in zip(at.tolist(), (impact / least).tolist()):
                per[x].append((k, s))
        self.postings = []
        self.blocks = max(1, min(BOUNDS, n))
        self.width = max(1, -(-n // self.blocks))
        self.bounds = np.zeros((len(self.terms), self.blocks), np.float32)
        for x in range(len(self.terms)):
            k, s = (list(c) for c in zip(*per[x]))
            p = Postings(k, s, max(s))
            for at in range(0, len(k), block):
                p.ends.append(k[at : at + block][-1])
                p.tops.append(max(s[at : at + block]))
            self.postings.append(p)
            np.maximum.at(self.bounds[x], np.array(k) // self.width, np.array(s, np.float32))

    def wand(self, terms: list[int], least: float = 1 - 1e-6) -> list[tuple[int, float]]:
        """All (item, score) with a score of `least` or more: block-max WAND, item by item."""
        lists = [self.postings[t] for t in terms]
        at = [0] * len(lists)
        live, out = list(range(len(lists))), []
        while live:
            live.sort(key=lambda k: lists[k].items[at[k]])
            total, pivot = 0.0, None
            for n, k in enumerate(live):
                total += lists[k].most
                if total >= least:
                    pivot = n
                    break
            if pivot is None:
                break
            item = lists[live[pivot]].items[at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]].items[at[live[pivot + 1]]] == item:
                pivot += 1
            head = live[: pivot + 1]
            block = {k: bisect_left(lists[k].ends, item) for k in head}
            if sum(lists[k].tops[block[k]] for k in head if block[k] < len(lists[k].ends)) < least:
                to = min([lists[k].ends[block[k]] + 1 for k in head if block[k] < len(lists[k].ends)], default=item + 1)
                if pivot + 1 < len(live):
                    to = min(to, lists[live[pivot + 1]].items[at[live[pivot + 1]]])
                to = max(to, item + 1)
            elif lists[head[0]].items[at[head[0]]] == item:
                score = sum(lists[k].impacts[at[k]] for k in head)
                if score >= least:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for k in head:
                at[k] = bisect_left(lists[k].items, to, at[k])
            live = [k for k in live if at[k] < len(lists[k].items)]
        return out

    def search(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, float, float, float, float]]:
        """(row, item, passage, score, overlaps of question, answer and both) of rows given as word hashes.

        A passage is two segments of as many words as the longest item has; they overlap by one segment, so every
        stretch as long as an item lies in one.
        """
        if not len(self.terms) or not len(h):
            return
        step = self.longest
        n = np.diff(first)
        count = -(-n // step)
        seg0 = np.concatenate([[0], np.cumsum(count)])
        row = np.repeat(np.arange(len(n)), n)
        segment = seg0[row] + (np.arange(len(h)) - first[row]) // step
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = self.terms[at] == h
        follows = np.zeros(seg0[-1] + 1, bool)  # segments whose next one is of the same row
        follows[:-1] = np.diff(np.repeat(np.arange(len(n)), count), append=-1) == 0
        # Each passage's different terms, ascending: those of its own segment and of the next.
        terms, of = at[known], segment[known]
        second = (of > 0) & follows[of - 1]
        key = np.concatenate([of, of[second] - 1]) * len(self.terms) + np.concatenate([terms, terms[second]])
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        of, terms = np.divmod(key, len(self.terms))
        heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        ends = np.append(heads[1:], len(of))
        most = np.zeros(len(heads), np.float32)
        for i in range(0, len(heads), 1024):  # a bounded piece of the sums at a time
            own = heads[i : i + 1024]
            lo, hi = own[0], ends[min(i + 1024, len(heads)) - 1]
            most[i : i + 1024] = np.add.reduceat(self.bounds[terms[lo:hi]], own - lo).max(1)
        # The last segment is part of the passage before, unless there is none.
        alone = np.ones(seg0[-1] + 1, bool)
        alone[1:] = ~follows[:-1]
        for x in np.flatnonzero((most >= 0.999) & (follows | alone)[of[heads]]).tolist():
            s = int(of[heads[x]])
            r = int(np.searchsorted(seg0, s, "right")) - 1
            lo = first[r] + (s - seg0[r]) * step
            hi = min(lo + 2 * step, first[r + 1])
            found = self.wand(terms[heads[x] : ends[x]].tolist())
            if not found:
                continue
            sizes = {len(self.shingles[k]) for k, _ in found}
            here = shingled(h[lo:hi], self.shingle)
            for k, score in found:
                s_ = self.shingles[k]
                own = here
                if sizes == {1} or len(s_) == 1:  # perhaps an item of fewer words than a shingle
                    own = np.concatenate([here, *(short_grams(h[lo:hi], m, self.shingle) for m in range(1, self.shingle))])
                there = np.isin(s_, own)
                a = self.answers[k]
                part = lambda m: float(there[m].mean()) if m.any() else 1.0
                if min(part(~a), part(a)) >= self.overlap - 1e-9:
                    yield r, self.ids[k], s - int(seg0[r]), score, part(~a), part(a), float(there.mean())


def _terms(items: DataFrame) -> DataFrame:
    """shard, term, n: each item's different terms, and how many words it has."""

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, first = hashed(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            row, h = np.unique(np.stack([row.astype(np.uint64), h]), axis=1).astype(np.uint64)
            row = row.astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("shard").take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(np.diff(first)[row])], names=["shard", "term", "n"])

    return items.mapInArrow(run, "shard long, term long, n long")


def _shards(benchmark: DataFrame, shingle: int, overlap: float) -> list[Broadcast]:
    """Indexes of all items, in parts of bounded size, with the statistics of all items; one at a time is built, and
    sent to the executors' disks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // SHARD)
    items = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(max(n, 1))))
    known, one = None, None
    if n > 1:
        size = items.mapInArrow(_sizes, "n long").agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
        terms = written(_terms(items).select("shard", "term"), "terms")
        one = (size[0], size[1] or 1.0, size[2] or 1)
        known = written(terms.join(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").groupBy("shard", "term").agg(F.first("df").alias("df")), "frequencies")
    out = []
    for k in range(n):
        part = sorted(map(tuple, items.where(F.col("shard") == k).select("item_id", "text").collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        whole = None
        if known:
            t = known.where(F.col("shard") == k).select("term", "df").toArrow()
            term, df = t.column("term").to_numpy().view(np.uint64), t.column("df").to_numpy()
            order = np.argsort(term)
            whole = Statistics(*one, term[order], df[order])
        out.append(spark.sparkContext.broadcast(Index(part, shingle, overlap, whole=whole)))
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each item that has some."""
    for b in chunks(batches):
        n = np.diff(hashed(b.column("text"))[1])
        yield pa.RecordBatch.from_arrays([pa.array(n[n > 0])], names=["n"])


def _searched(batches: Iterator[pa.RecordBatch], shards: list[Broadcast]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Batches with what `Index.search` finds in them, over all indexes. With several, a task gathers HELD bytes of word
    hashes for each time that it goes through them, and holds one."""
    held, size = [], 0

    def through() -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for s in shards:
            for k, (_, h, first) in enumerate(held):
                found[k] += s.value.search(h, first)
            if len(shards) > 1:
                s.__dict__.pop("_value", None)  # read from disk again when it is wanted again
        yield from ((b, rows) for (b, *_), rows in zip(held, found))

    for b in chunks(batches):
        held.append((b, *hashed(b.column("text"))))
        size += held[-1][1].nbytes
        if len(shards) == 1 or size >= HELD:
            yield from through()
            held, size = [], 0
    yield from through()


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, passage, score, question_overlap, answer_overlap, overlap: the best passage of each document and
    test item where at least a share `overlap` of the word shingles of the item's question stands in it, and of those of
    its answer too (shingles that reach into the answer).

    score is BM25, with the statistics of all items, over the least that such a passage can have. Words are runs of
    letters, digits and non-ASCII characters, A-Z lower-cased; an item of fewer words than a shingle counts as one
    shingle. Null and empty texts, of documents or items, match nothing; an empty benchmark or table leaves no rows.
    Repeated rows have rows of their own; null doc_ids are carried. Of a text of any length, its word hashes are in
    memory beside it. Other columns are ignored. Documents are read once; a task holds one index of at most SHARD bytes of
    items at a time.
    """
    spark = ship(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shards = _shards(benchmark, shingle, overlap)
    if not shards:
        return spark.createDataFrame([], _SCHEMA)

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _searched(batches, shards):
            best: dict[tuple[int, int], tuple] = {}
            for r, item, *rest in found:
                if (r, item) not in best or best[r, item][1] < rest[1]:
                    best[r, item] = rest
            doc = b.column("doc_id")
            rows = [(doc[r].as_py(), item, *rest) for (r, item), rest in best.items()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
            names = ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap", "overlap"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)

    return text.mapInArrow(run, _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, overlap: float = 0.8) -> DataFrame:
    """The rows of docs, with all columns, that `contaminated` would not name; filtered where they are read."""
    ship(docs.sparkSession)
    shards = _shards(benchmark, shingle, overlap)
    if not shards:
        return docs

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in _searched(batches, shards):
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, *_ in found]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def brute(rows: list[tuple], items: list[tuple], shingle: int = 5, overlap: float = 0.8) -> set[tuple]:
    """(doc_id, item_id) where some passage-long stretch has enough of the shingles of an item's question and answer; for
    tests."""
    cut = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    many = {i: cut(t) for i, t in items}
    step = max((len(w) for w in many.values()), default=1)
    out = set()
    for doc, t in rows:
        w = cut(t)
        for i, q in many.items():
            if not q:
                continue
            m = min(shingle, len(q))
            want = [tuple(q[k : k + m]) for k in range(len(q) - m + 1)]
            for at in range(0, max(len(w), 1), step):
                p = w[at : at + 2 * step]
                have = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)}
                n = len(cut(question(dict(items)[i])))
                there = [x in have for x in want]
                parts = there[: max(n - shingle + 1, 0)], there[max(n - shingle + 1, 0) :]
                if all(sum(x) >= overlap * len(x) - 1e-9 for x in parts):
                    out.add((doc, i))
    return out
