"""Removal of repeated byte strings, by the common-prefix interval tree of an enhanced suffix array.

A string of the length asked for is found through an anchor: the place in it where the hash of a short string is least.
Equal strings have equal anchors at equal places, so only suffixes that start at anchors found more than once need to be
sorted. What surrounds an occurrence (all strings that have their anchor there) is its context; equal contexts count as
one, which is combined where they are read. All contexts of one anchor meet; their suffixes are sorted with their common
prefixes, a stack scan gives the intervals of the common-prefix tree, and within an interval the texts before the
anchors, sorted backwards, tell how far its members agree to the left and where they part (a repeat is maximal only
where they do). That yields each interval's repeats with all occurrences, as ranges of starts.

An anchor with very many contexts is split by the bytes around it: a stretch of WIDTH neighbouring starts at a time, by
the bytes that all strings from these starts have in common. Texts longer than a block are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Seen, chunks, flat, mix, odd, pieces, powers, prefix, rested, ship, spans, window_min, written
from .runs import lists, runs
from .substrings import covered

#: Bytes of the string hashed for an anchor.
ANCHOR = 40
#: Contexts of one anchor that are sorted together in memory; a larger group is split.
GROUP = 4096
#: Starts that stay together when a large group is split; what then still is too large goes start by start.
WIDTH = 20


def _hashes(data: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of the n bytes from each place."""
    if len(data) < n:
        return np.zeros(0, np.uint64)
    pre = prefix(data, seed)
    return mix((pre[n:] - pre[:-n]) * powers(len(data))[1][: len(data) - n + 1])


def _anchors(data: np.ndarray, off: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place, and the least and last start of the strings of `length` bytes that have their anchor there."""
    w = length - anchor + 1
    g = _hashes(data, anchor, 11)
    best = window_min(g, w)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(best)]
    ok = np.arange(len(best)) + length <= off[1:][row]
    start, best, row = np.flatnonzero(ok), best[ok], row[ok]
    new = np.ones(len(start), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    return row[first], best[first], start[first], start[last]


def _batch(schema: dict, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.values())], names=list(schema))


_LONGS = lambda names: {n: pa.int64() for n in names.split()}
_FOUND = _LONGS("key kind v id th")
_CONTEXT = _LONGS("h part c1 c2 base left size multi") | {"text": pa.binary()}
_PLACES = _LONGS("c1 c2 id th") | {"starts": pa.list_(pa.int64())}
_RANGE = _LONGS("kind h node c1 c2 first last w v multi")


def _schema(kinds: dict) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{n} {names[t]}" for n, t in kinds.items())


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Chunks whose rows are texts or pieces of texts, and the byte at which each begins in its text."""
    for b in batches:
        for part, begin in pieces(b, length - 1):
            at = 0
            for c in chunks(iter([part])):
                yield c, begin[at : at + c.num_rows]
                at += c.num_rows


def _whole_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """id, th and a second hash of texts that are long enough, for copies."""
    for b in batches:
        n = pyarrow.compute.fill_null(pyarrow.compute.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(n >= length)
        texts = b.column("text").cast(pa.binary())
        v = np.array([int.from_bytes(hashlib.blake2b(texts[r].as_buffer(), digest_size=8).digest(), "little", signed=True) for r in at.tolist()], np.int64)
        yield b.column("id").to_numpy()[at], b.column("th").to_numpy()[at], v


def _level(text: DataFrame, length: int, anchor: int) -> DataFrame:
    """(id, th, anchors, copies): of each document, anchors found elsewhere too (1 in copies: it has copies and is the
    first of them, 2: it is another copy). Copies agree in two hashes, 128 bits.

    Kinds of rows: 0 an anchor, 1 a whole text, both sent by their hashes; 2 and 3 the same with the answer known before
    the shuffle, so that they are dealt out by document."""

    @rested
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, copies, least = Seen(), Seen(14), Seen(14)
        for whole in batches:
            for id_, th, v in _whole_hashes(iter([whole]), length):
                key = th ^ mix(v.view(np.uint64)).view(np.int64)
                known = copies.twice(key.view(np.uint64)) & least.later(key.view(np.uint64), id_)
                yield _batch(_FOUND, np.where(known, id_, key), 1 + 2 * known, v, id_, th)
            for b, _ in _cut(iter([whole]), length):
                data, off = flat(b.column("text"))
                id_, th = b.column("id").to_numpy(), b.column("th").to_numpy()
                row, at, _, _ = _anchors(data, off, length, anchor)
                h = _hashes(data, anchor, 13)[at] if len(at) else np.zeros(0, np.uint64)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                third = np.zeros(len(h), bool)  # two of a kind in one row say enough
                third[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
                h, row = h[~third], row[~third]
                known = anchors.twice(h)
                id_, th, h = id_[row], th[row], h.view(np.int64)
                yield _batch(_FOUND, np.where(known, mix(id_.view(np.uint64).copy()).view(np.int64), h), 2 * known, np.where(known, h, 0), id_, th)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, first, again in runs(batches, ["key", "kind", "v"], "id"):
            kind, h = cols["kind"], np.where(cols["kind"] == 2, cols["v"], cols["key"])
            copy = np.where(kind == 3, 2, np.where(kind == 1, 1 + (cols["id"] != first), 0))
            keep = again | (kind >= 2)
            yield _batch(_FOUND, h[keep], copy[keep], cols["v"][keep], cols["id"][keep], cols["th"][keep])

    rows = text.mapInArrow(named, _schema(_FOUND))
    found = rows.repartition("key").sortWithinPartitions("key", "kind", "v", "id", "th").mapInArrow(shared, _schema(_FOUND))
    anchors = F.collect_set(F.when(F.col("kind") == 0, F.col("key"))).alias("anchors")
    return found.groupBy("id", "th").agg(anchors, F.max("kind").alias("copies"))


def _found(b: pa.RecordBatch, begin: np.ndarray, length: int, anchor: int):
    """A chunk's bytes, and of its anchors that are found elsewhere too: row, hash, context's start in its text, start
    and end in the bytes, bytes before the anchor, and the context's 128-bit hash."""
    data, off = flat(b.column("text"))
    row, at, s0, s1 = _anchors(data, off, length, anchor)
    if not len(row):
        return data, *[np.zeros(0, np.int64)] * 8
    h = _hashes(data, anchor, 13)[at].view(np.int64)
    got, cut = lists(b.column("anchors"))
    own = np.searchsorted(row, np.arange(b.num_rows + 1))
    keep = np.zeros(len(row), bool)
    for r in range(b.num_rows):
        keep[own[r] : own[r + 1]] = np.isin(h[own[r] : own[r + 1]], got[cut[r] : cut[r + 1]])
    row, at, s0, end, h = (x[keep] for x in (row, at, s0, s1 + length, h))
    left = at - s0
    c1, c2 = (mix(spans(prefix(data, seed), s0, end) + left.astype(np.uint64) * odd(1, seed)[0]).view(np.int64) for seed in (11, 13))
    return data, row, h, s0 - off[row] + begin[row], s0, end, left, c1, c2


def _contexts(wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """Contexts of anchors that are found elsewhere too; one that a task has met twice before is left out."""

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b, begin in _cut(batches, length):
            data, _, h, _, s0, end, left, c1, c2 = _found(b, begin, length, anchor)
            at = np.flatnonzero(~seen.twice(c1.view(np.uint64) ^ mix(c2.view(np.uint64).copy())))
            raw, zero = data.tobytes(), np.zeros(len(at), np.int64)
            texts = [raw[i:j] for i, j in zip(s0[at].tolist(), end[at].tolist())]
            yield _batch(_CONTEXT, h[at], zero, c1[at], c2[at], zero, left[at], (end - s0)[at], zero, texts)

    return wanted.mapInArrow(run, _schema(_CONTEXT))


def _places(wanted: DataFrame, length: int, anchor: int) -> DataFrame:
    """Where each document has each context."""

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, begin in _cut(batches, length):
            _, row, _, start, _, _, _, c1, c2 = _found(b, begin, length, anchor)
            order = np.lexsort((start, c2, c1, row))
            row, start, c1, c2 = (x[order] for x in (row, start, c1, c2))
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
            cut = np.append(np.flatnonzero(new), len(row)).astype(np.int32)
            starts = pa.ListArray.from_arrays(pa.array(cut), pa.array(start.astype(np.int64)))
            row = row[new]
            cols = [pa.array(c1[new]), pa.array(c2[new]), b.column("id").take(pa.array(row)), b.column("th").take(pa.array(row)), starts]
            yield pa.RecordBatch.from_arrays(cols, names=list(_PLACES))

    return wanted.mapInArrow(run, _schema(_PLACES))


def intervals(lcp: list[int], lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(left, right, prefix, parent's prefix) of the common-prefix tree's inner nodes over entries lo to hi - 1 of a
    suffix array; lcp[i] is what entries i - 1 and i have in common."""
    stack = [(lo, 0)]
    for i in range(lo + 1, hi + 1):
        here, left = lcp[i] if i < hi else 0, i - 1
        while stack and stack[-1][1] > here:
            left, depth = stack.pop()
            yield left, i - 1, depth, max(here, stack[-1][1] if stack else 0, 0)
        if not stack or stack[-1][1] < here:
            stack.append((left, here))


def _padded(parts: list[bytes], width: int, group: np.ndarray) -> np.ndarray:
    """Rows of the group's number and a part's bytes plus one, so that zero ends a part."""
    out = np.zeros((len(parts), width + 8), np.uint8)
    out[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    n = np.array([len(x) for x in parts])
    put = np.arange(width) < n[:, None]
    out[:, 8:][put] = np.frombuffer(b"".join(parts), np.uint8) + np.uint8(1)
    return out


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and what each has in common with the one before (less the group's 8 bytes)."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) - 8
    return order, np.concatenate([[0], np.maximum(same, 0)])


def repeats(group: np.ndarray, left: list[int], texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(node, entry, first, last): starts relative to an entry's text of strings that another entry of its group has too.
    A node has the same strings, in the same order, from each of its entries, and all entries that have them: it is an
    interval of the tree of what follows the anchor, cut by one of the tree of what comes before it. Entries with equal
    group (in ascending order) have one anchor."""
    right = [t[a:] for t, a in zip(texts, left)]
    order, lcp = _sorted(_padded(right, length, group))
    ends = np.array([len(x) for x in right])[order]
    pads = np.concatenate([[0], np.minimum(ends[1:], ends[:-1])])
    lcp = np.minimum(lcp, pads).tolist()
    back, near = _sorted(_padded([t[:a][::-1] for t, a in zip(texts, left)], length, group))
    short = np.array(left)[back]
    near = np.minimum(near, np.concatenate([[0], np.minimum(short[1:], short[:-1])])).tolist()
    place = np.empty(len(back), np.int64)
    place[back] = np.arange(len(back))
    place, entry, size = place.tolist(), order.tolist(), [len(t) for t in texts]
    g = group[order]
    cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
    node = 0
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo < 2:
            continue
        for i, j, depth, above in intervals(lcp, lo, hi):
            if above >= length or depth < length - max(left[entry[k]] for k in range(i, j + 1)):
                continue
            members = sorted((place[entry[k]], entry[k]) for k in range(i, j + 1))
            agree = [min(near[a + 1 : b + 1]) for (a, _), (b, _) in zip(members, members[1:])]
            for k, m, near_, far in intervals([0, *(x + 1 for x in agree)], 0, len(members)):
                # a start `o` before the anchor: the string ends length - o behind it
                low, high = max(length - depth, far), min(length - above, near_) - 1
                if low <= high:
                    node += 1
                    for _, x in members[k : m + 1]:
                        yield node, x, left[x] - high, left[x] - low


def _once(t: pa.Table) -> pa.Table:
    """Of contexts sorted by h, part, c1, c2 and base, each once; multi if it came more than once."""
    same = np.ones(t.num_rows - 1, bool)
    for c in ("h", "part", "c1", "c2", "base"):
        x = t.column(c).to_numpy()
        same &= x[1:] == x[:-1]
    new = np.concatenate([[True], ~same])
    if new.all():
        return t
    first = np.flatnonzero(new)
    multi = np.maximum.reduceat(t.column("multi").to_numpy(), first)
    multi = np.maximum(multi, (np.diff(np.append(first, len(new))) > 1).astype(np.int64))
    t = t.take(pa.array(first))
    return t.set_column(t.schema.get_field_index("multi"), "multi", pa.array(multi))


def _grouped(length: int, width: int):
    """Ranges (kind 0) of small groups, or parts of large ones (kind 1, with the context's columns) of `width` starts."""

    def ranges(t: pa.Table) -> Iterator[pa.RecordBatch]:
        h, part, c1, c2, base, multi = (t.column(c).to_numpy() for c in ("h", "part", "c1", "c2", "base", "multi"))
        # A context with several occurrences comes as two entries, so that it repeats itself.
        of = np.sort(np.concatenate([np.arange(t.num_rows), np.flatnonzero(multi)]))
        second = np.concatenate([[False], of[1:] == of[:-1]])
        new = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
        group = np.cumsum(np.concatenate([[0], new]))[of]
        lefts, texts = t.column("left").to_pylist(), t.column("text").to_pylist()
        got = np.array(list(repeats(group, [lefts[k] for k in of], [texts[k] for k in of], length)), np.int64).reshape(-1, 4)
        got = got[~second[got[:, 1]]]
        x, zero = of[got[:, 1]], np.zeros(len(got), np.int64)
        cols = (zero, h[x], got[:, 0], c1[x], c2[x], got[:, 2] + base[x], got[:, 3] + base[x], part[x], zero, multi[x])
        yield _batch(_RANGE | {"text": pa.binary()}, *cols, [None] * len(got))

    def split(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.to_batches(max_chunksize=1024):
            h, c1, c2, base, left, size, multi = (b.column(c).to_numpy() for c in ("h", "c1", "c2", "base", "left", "size", "multi"))
            texts = b.column("text").to_pylist()
            out: list[tuple] = []
            for k, text in enumerate(texts):
                low, high = int(left[k] - size[k] + length), int(left[k])  # how far before the anchor strings may start
                for j in range(low // width, high // width + 1):
                    a, z = min(j * width + width - 1, high), max(j * width, low)
                    core = text[high - j * width : high - j * width + length - width + 1]
                    name = hashlib.blake2b(core, digest_size=16, salt=(j & 0xFFFF).to_bytes(2, "little")).digest()
                    own = (int(h[k]) ^ int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True))
                    out.append((*own, c1[k], c2[k], base[k] + high - a, a, length + a - z, multi[k], text[high - a : high - z + length]))
            one = np.ones(len(out), np.int64)
            g, part, *rest = (list(c) for c in zip(*out)) if out else [[]] * 9
            cc1, cc2, bb, ll, ss, mm, tt = rest
            yield _batch(_RANGE | {"text": pa.binary()}, one, g, ll, cc1, cc2, bb, ss, part, one * 0, mm, tt)

    @rested
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        large = None  # the group that is split as it comes
        key = lambda t: np.stack([t.column("h").to_numpy(), t.column("part").to_numpy()], 1)
        for b in batches:
            for at in range(0, b.num_rows, GROUP):
                t = pa.Table.from_batches([b.slice(at, GROUP)])
                t = _once(t if held is None else pa.concat_tables([held, t]))
                k = key(t)
                own = int((k == large).all(1).sum()) if large is not None else 0
                own -= int(0 < own == t.num_rows)  # the last context may go on
                if own:
                    yield from split(t.slice(0, own))
                    t, k = t.slice(own), k[own:]
                if t.num_rows >= 2 * GROUP:
                    cut = int(np.flatnonzero((k == k[-1]).all(1))[0])  # the last group may go on
                    if cut:
                        yield from ranges(t.slice(0, cut))
                    t = t.slice(cut)
                    if t.num_rows > GROUP:
                        large = k[-1]
                        yield from split(t.slice(0, t.num_rows - 1))
                        t = t.slice(t.num_rows - 1)
                held = t.combine_chunks()
        if held is not None:
            own = int((key(held) == large).all(1).sum()) if large is not None else 0
            if own:
                yield from split(held.slice(0, own))
            if own < held.num_rows:
                yield from ranges(held.slice(own))

    return run


def repeat_groups(docs: DataFrame, length: int = 200, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: repeats (h, w and node name the group, c1 and c2 the context, first and last the range of byte
    starts in it), all occurrences of contexts (c1, c2, id, th, starts in the document), and per document (id, th) whether
    it has copies (1: it stands for them, 2: it is one; occurrences are given for the one that stands for them alone).

    The ranges of a group are equally long and hold the same strings in the same order; every string of `length` bytes
    found more than once is in one group, which has all its contexts. th is xxhash64 of the text; id is the doc_id, a null
    one being the largest long.
    """
    found, places, copies = _repeated(docs, length, anchor)
    return found.select("h", "w", "node", "c1", "c2", "first", "last"), places, copies


def _repeated(docs: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `repeat_groups` gives, with multi (the context has several occurrences)."""
    text = _keyed(docs)
    level = written(_level(text, length, anchor), "anchors")
    wanted = text.join(level.where("copies < 2").where(F.size("anchors") > 0), ["id", "th"])
    schema, group = _schema(_RANGE | {"text": pa.binary()}), ["h", "part"]
    order = [*group, "c1", "c2", "base"]
    met = _contexts(wanted, length, anchor).repartition(*group).sortWithinPartitions(*order)
    made = written(met.mapInArrow(_grouped(length, WIDTH), schema), "ranges")
    done = made.where("kind = 0").drop("text")
    # Parts of large groups: node is left, last the size, first the base (see `split`); w the second half of the name.
    parts = made.where("kind = 1").select("h", F.col("w").alias("part"), "c1", "c2", F.col("first").alias("base"), F.col("node").alias("left"), F.col("last").alias("size"), "multi", "text")
    if not parts.isEmpty():
        met = parts.repartition(*group).sortWithinPartitions(*order)
        made = written(met.mapInArrow(_grouped(length, 1), schema), "ranges")
        done = done.union(made.where("kind = 0").drop("text"))

        def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cols, _, again in runs(batches, ["h", "w"], "c1"):
                again, zero = again | (cols["multi"] == 1), np.zeros(len(again), np.int64)
                whole = cols | {"kind": zero, "node": zero, "last": cols["first"]}
                yield _batch(_RANGE, *(whole[k][again] for k in _RANGE))

        # Starts by themselves: all of a group are the same string.
        single = made.where("kind = 1").select(*_RANGE)
        done = done.union(single.repartition("h", "w").sortWithinPartitions("h", "w").mapInArrow(twice, _schema(_RANGE)))
    return done, _places(wanted, length, anchor), level.where("copies > 0").select("id", "th", "copies")


def _keyed(docs: DataFrame, *keep) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), *keep)


def remove_repeats(docs: DataFrame, length: int = 200, anchor: int = ANCHOR, whole_characters: bool = False) -> DataFrame:
    """All columns of docs, text as binary, then n_bytes, n_removed, n_spans: each text, as UTF-8 bytes, without the
    bytes covered by a string of `length` bytes that also starts anywhere else, in the same document or another;
    n_spans counts maximal removed runs.

    Overlapping occurrences count; strings are judged on the input, not on what is left. Null and empty texts have no
    bytes; texts of any length are looked at in pieces of bounded size. Null doc_ids stay null; every row is a document of
    its own, so a repeated row removes all of its text if it is long enough. What is left may begin or end inside a
    character, hence the binary column; with whole_characters, a character of which a byte goes goes as a whole, and text
    is a string. Columns of docs with the names of new ones are replaced; an empty table gives no rows.
    """
    if not 0 < anchor < length:
        raise ValueError("the anchor must be shorter than the string")
    ship(docs.sparkSession)
    new = ("n_bytes", "n_removed", "n_spans")
    docs = docs.drop(*new)
    found, places, copies = _repeated(docs, length, anchor)
    # A table of its own, so that the join behind it may be split where very many documents share a context.
    each, whole = F.collect_set(F.struct("first", "last")), F.array(F.struct(F.min("first").alias("first"), F.max("last").alias("last")))
    per = found.groupBy("c1", "c2").agg(F.when(F.max("multi") == 1, whole).otherwise(each).alias("l"))
    per = written(per.select("c1", "c2", "l.first", "l.last"), "contexts")
    moved = lambda c: F.flatten(F.transform("starts", lambda s: F.transform(c, lambda x: x + s)))
    met = places.join(per, ["c1", "c2"]).select("id", "th", moved("first").alias("first"), moved("last").alias("last"))
    spans_ = met.groupBy("id", "th").agg(F.flatten(F.collect_list("first")).alias("first"), F.flatten(F.collect_list("last")).alias("last"))
    known = spans_.join(copies, ["id", "th"], "full")
    kind = "string" if whole_characters else "binary"
    fields = [(f.name, kind if f.name == "text" else f.dataType.simpleString()) for f in docs.schema.fields]
    kinds = {"text": pa.string() if whole_characters else pa.binary()} | _LONGS("n_bytes n_removed n_spans")

    @rested
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            texts, copies = b.column("text").cast(pa.binary()), b.column("copies").to_pylist()
            (first, off), (last, _) = lists(b.column("first")), lists(b.column("last"))
            out: list[tuple] = []
            for r in range(b.num_rows):
                raw = memoryview(texts[r].as_buffer()) if texts[r].is_valid else memoryview(b"")
                n, gone = len(raw), []
                if copies[r] and n >= length:
                    gone = [(0, n)]
                elif off[r + 1] > off[r]:
                    gone = merged(first[off[r] : off[r + 1]], last[off[r] : off[r + 1]] + length)
                if whole_characters:
                    gone = characters(raw, gone)
                at, left = 0, []
                for i, j in gone:
                    left.append(raw[at:i])
                    at = j
                left = b"".join([*left, raw[at:]])
                out.append((left.decode(errors="ignore") if whole_characters else left, n, n - len(left), len(gone)))
            made = dict(zip(kinds, (pa.array(c, t) for c, t in zip(zip(*out), kinds.values()))))
            cols = {name: made["text"] if name == "text" else b.column(f"c{k}") for k, (name, _) in enumerate(fields)} | {n: made[n] for n in new}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    keep = [F.col(f"`{name}`").alias(f"c{k}") for k, (name, _) in enumerate(fields) if name != "text"]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*fields, *((n, "long") for n in new)])
    return _keyed(docs, *keep).join(known, ["id", "th"], "left").mapInArrow(kept, schema)


def merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Intervals [first, end) as disjoint ones that don't touch, in order."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(first)) - 1
    return list(zip(first[new].tolist(), end[last].tolist()))


def characters(raw: memoryview, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The intervals widened to whole characters of UTF-8."""
    inside = lambda k: k < len(raw) and raw[k] & 0xC0 == 0x80
    wide = []
    for i, j in gone:
        while i and inside(i):
            i -= 1
        while inside(j):
            j += 1
        wide.append((i, j))
    return merged(*(np.array(x) for x in zip(*wide))) if wide else wide


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def brute(rows: list[tuple], length: int = 200) -> list[tuple]:
    """What the digest must be, from a table of all strings; for tests."""
    seen: dict[bytes, int] = {}
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for (doc, _), raw in zip(rows, raws):
        starts = np.array([k for k in range(len(raw) - length + 1) if seen[raw[k : k + length]] > 1], np.int64)
        gone = covered(starts, len(raw), length)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        out.append((doc, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out
