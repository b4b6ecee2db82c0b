"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

Windows have twice a template's words and start every half of them, so some window holds all of a stretch as long as the
template, and is similar enough to it that a band agrees, with a chance the settings guarantee. Windows that hold fewer
shingles of the templates sought in them than the containment asks for have no need of minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, odd, rested, ship
from .decontam import hashed, short_grams, shingled

#: Short notices, by the name they are reported under; `defaults` adds license texts and standard headers.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
_SCHEMA = "doc_id long, license string, word long, words long, containment double"


def defaults() -> dict[str, str]:
    """Templates looked for unless others are given: the short notices, and the files of license_texts under their
    names: license texts (-text) and the headers that licenses ask for or that are in use (-header)."""
    files = resources.files(__package__).joinpath("license_texts").iterdir()
    return TEMPLATES | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in files if f.name.endswith(".txt")}


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of `rows` minima that a pair of that similarity escapes with a chance of `miss` at most."""
    return int(np.ceil(np.log(miss) / np.log1p(-(similarity**rows)))) if similarity < 1 else 1


@dataclass
class _Class:
    """Templates that are sought in windows of one length."""

    window: int
    step: int
    bands: int
    buckets: dict[tuple[int, int], list[int]]
    all: np.ndarray  # shingles of its templates
    least: float  # how many different ones of them a window must hold to match any


class Templates:
    """Signatures of the templates. `miss` bounds the chance that no band of a window agrees."""

    def __init__(self, texts: dict[str, str], shingle: int, containment: float, rows: int = 1, miss: float = 1e-9):
        self.shingle, self.containment, self.rows = shingle, containment, rows
        self.names, self.words, self.sets = [], [], []
        for name, text in sorted(texts.items()):
            h, _ = hashed(pa.array([text or ""]))
            if len(h):
                self.names.append(name)
                self.words.append(len(h))
                self.sets.append(np.unique(shingled(h, shingle)))
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.marks = np.zeros(1 << 20, bool)  # by a hash's first bits, so that few shingles are looked up
        self.marks[self.all >> np.uint64(44)] = True
        self.short = sorted({n for n in self.words if n < shingle})
        self.classes: list[_Class] = []
        by: dict[int, list[int]] = {}
        for k, n in enumerate(self.words):
            if n >= shingle:
                by.setdefault(n, []).append(k)
        for n, ks in by.items():
            count = n - shingle + 1
            # A window of 2n words in steps of n/2 holds any n words; what it can hold besides lowers the similarity.
            window, step = 2 * n, max(1, n // 2)
            likeness = containment * count / (window - shingle + 1 + (1 - containment) * count)
            bands = bands_for(likeness, rows, miss)
            least = containment * min(len(self.sets[k]) for k in ks) - 1e-6
            c = _Class(window, step, bands, {}, np.unique(np.concatenate([self.sets[k] for k in ks])), least)
            for k in ks:
                for band, key in enumerate(self.keys(self.sets[k], bands)):
                    c.buckets.setdefault((band, int(key)), []).append(k)
            self.classes.append(c)

    def keys(self, s: np.ndarray, bands: int) -> np.ndarray:
        """One key for each band of a set's minima."""
        n = bands * self.rows
        least = np.array([((s ^ x) * m).min() for m, x in zip(odd(n, 31), odd(n, 32))], np.uint64).reshape(bands, self.rows)
        return mix((least * odd(self.rows, 33)).sum(1, dtype=np.uint64))

    def places(self, s: np.ndarray) -> np.ndarray:
        """Where shingles are those of a template."""
        at = np.flatnonzero(self.marks[s >> np.uint64(44)])
        return at[np.isin(s[at], self.all)]

    def search(self, h: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, words, containment) in one text's word hashes: of windows that overlap, the best."""
        for n in self.short:
            s = short_grams(h, n, self.shingle)
            for k in (k for k, m in enumerate(self.words) if m == n):
                yield from ((k, int(at), n, 1.0) for at in np.flatnonzero(s == self.sets[k][0]))
        if len(h) < self.shingle:
            return
        s = shingled(h, self.shingle)
        known = self.places(s)
        for c in self.classes if len(known) else ():
            places = known[np.isin(s[known], c.all)]
            if len(np.unique(s[places])) < c.least:
                continue
            wide = c.window - self.shingle + 1
            starts = {max(0, (p - b) // c.step * c.step) for p in places.tolist() for b in range(0, wide + c.step, c.step)}
            seen: list[tuple] = []
            for at in sorted(starts):
                own = s[at : at + wide]
                if len(np.unique(own[np.isin(own, c.all)])) < c.least:
                    continue
                for k in {k for band, key in enumerate(self.keys(own, c.bands)) for k in c.buckets.get((band, int(key)), ())}:
                    there = np.flatnonzero(np.isin(own, self.sets[k]))
                    share = len(np.unique(own[there])) / len(self.sets[k])
                    if share >= self.containment - 1e-9:
                        first, last = densest(there, len(self.sets[k]))
                        seen.append((-share, k, at + first, at + last))
            taken: list[tuple] = []
            for share, k, i, j in sorted(set(seen)):
                if all(k != o or j < a or i > b for o, a, b in taken):
                    taken.append((k, i, j))
                    yield k, i, j - i + self.shingle, -share


def densest(there: np.ndarray, n: int) -> tuple[int, int]:
    """First and last of the places that lie within n of each other, where most do."""
    end = np.searchsorted(there, there + n)
    k = int(np.argmax(end - np.arange(len(there))))
    return int(there[k]), int(there[end[k] - 1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 5, containment: float = 0.8) -> DataFrame:
    """doc_id, license, word (where it begins), words (how many it spans), containment: every place of a document where
    a window holds at least a share `containment` of a template's word shingles.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a template of fewer words than a
    shingle counts as one shingle. Whole texts of any length are scanned, over their word hashes. Null and empty texts
    have no rows, nor does anything without templates; repeated rows have rows of their own; null doc_ids are carried.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = ship(docs.sparkSession)
    made = Templates(defaults() if templates is None else templates, shingle, containment)
    held = spark.sparkContext.broadcast(made)

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for b in chunks(batches):
            h, first = hashed(b.column("text"))
            if t.short:
                rows = range(b.num_rows)
            else:  # rows with a template's shingle
                s = shingled(h, t.shingle) if len(h) >= t.shingle else np.zeros(0, np.uint64)
                at = t.places(s)
                rows = np.unique(np.searchsorted(first, at, "right") - 1).tolist()
            ids = b.column("doc_id")
            out = [(ids[r].as_py(), t.names[k], at, n, share) for r in rows for k, at, n, share in t.search(h[first[r] : first[r + 1]])]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], x) for k, x in enumerate(kinds)], names=["doc_id", "license", "word", "words", "containment"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def brute(rows: list[tuple], templates: dict[str, str], shingle: int = 5, containment: float = 0.8) -> set[tuple]:
    """(doc_id, license) where some stretch of twice a template's words holds enough of its shingles; for tests."""
    out = set()
    for doc, text in rows:
        h, _ = hashed(pa.array([text or ""]))
        for name, t in templates.items():
            q, _ = hashed(pa.array([t]))
            m = min(shingle, len(q))
            want = {tuple(q[k : k + m]) for k in range(len(q) - m + 1)} if m else set()
            for at in range(0, max(len(h), 1)):
                p = h[at : at + 2 * len(q)]
                if want and len(want & {tuple(p[k : k + m]) for k in range(len(p) - m + 1)}) >= containment * len(want) - 1e-9:
                    out.add((doc, name))
                    break
    return out
