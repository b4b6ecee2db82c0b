"""The three operators on repeated text, held against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import components, neardup, repeats, runs, substrings

SCHEMA = "doc_id long, text string, th string, id string"


def _rows(seed=3, n=70):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    base = [" ".join(word() for _ in range(r.randint(30, 160))) for _ in range(8)]
    shared = " ".join(word() for _ in range(60))
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice((0, 0, 1, 3, 9))):
            w[r.randrange(len(w))] = word()
        if i % 5 == 0:
            at = r.randrange(len(w))
            w[at:at] = shared.split()
        out.append((r.choice((1, 1, 7)) * 1000 + i, r.choice((" ", "\n", "\t ")).join(w)))
    out += [(1, ""), (2, None), (3, "  \n"), (4, "a"), (5, "A"), (6, "a b c"), (8, "x " * 400), (9, "y z " * 300), (10, "nul\x00byte " * 90)]
    out += [(11, shared), (12, shared), (0, shared.upper())]
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(spark, shingle):
    rows = _rows() + [(None, "a b c"), (None, None)]
    got = neardup.near_duplicates(_frame(spark, rows), shingle).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(neardup.brute(rows, shingle), key=key)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    rows = _rows(5, 120)
    assert sorted(map(tuple, neardup.near_duplicates(_frame(spark, rows), 4).collect())) == sorted(neardup.brute(rows, 4))


def test_a_large_group_costs_in_proportion(spark, monkeypatch):
    r = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(3000):
        w = list(base)
        w[r.randrange(60)] = f"own{i}"
        rows.append((i, " ".join(w)))
    work, links = [], neardup._links
    monkeypatch.setattr(neardup, "_links", lambda w, *rest: (work.append(w.agg(F.sum(F.size("tasks"))).first()[0] or 0), links(w, *rest))[1])
    for block in (neardup.BLOCK, 40_000):  # one block, and some 35
        monkeypatch.setattr(neardup, "BLOCK", block)
        work.clear()
        got = neardup.near_duplicates(_frame(spark, rows), 4).collect()
        assert {x.component_id for x in got} == {0}
        members = spark.read.parquet(*[x for x in _tables(spark) if "/members-" in x][-1:]).count()
        assert sum(work) <= 1.1 * members + 2000


def _tables(spark):
    from palimpsest.llm import common

    return common._MADE.get(spark.sparkContext.applicationId, [])


def test_groups_whose_pivot_is_not_linked_with_all(spark, monkeypatch):
    """Chains and separate clusters under one band: every round has something left, and the last one pairs it."""
    r = random.Random(2)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for c in range(6):
        own = list(base)
        for k in r.sample(range(40), 3 * c):
            own[k] = f"c{c}x{k}"
        for i in range(25):
            w = list(own)
            for k in r.sample(range(40), i % 4):
                w[k] = f"c{c}i{i}k{k}"
            rows.append((100 * c + i, " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", 1500)
    assert sorted(map(tuple, neardup.near_duplicates(_frame(spark, rows), 4).collect())) == sorted(neardup.brute(rows, 4))


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (9, a + " more"), (10, b + " more"), (11, "else " * 9)]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(_frame(spark, rows), 4).collect()}
    assert got == {5: 5, 9: 5, 10: 5, 11: 11}


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (5, "q r s t u v")]
    got = sorted(map(tuple, neardup.near_duplicates(_frame(spark, rows), 4).collect()))
    assert got == [(3, 3, 3, True), (5, 3, 3, False), (5, 3, 3, False), (5, 3, 5, True)]
    none = _frame(spark, rows).limit(0)
    assert neardup.near_duplicates(none).count() == substrings.remove_windows(none).count() == repeats.remove_repeats(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 1), (3, 2), (2, 3), (900, 3), (900, 140), (50, 51)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {i: 2 for i in [3, 900, *range(100, 141)]} | {51: 50}


@pytest.mark.parametrize("window", [2, 5, 13, 40])
def test_windows(spark, window):
    rows = _rows() + [(None, "x " * 40), (None, "fresh words " * 20), (1001, "x y " * 30)]
    got = substrings.digest(substrings.remove_windows(_frame(spark, rows), window)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, substrings.brute(rows, window)))


def test_levels_double_until_none_survives(spark):
    assert substrings.levels(13) == [7, 13] and substrings.levels(50) == [7, 13, 25, 50] and substrings.levels(2) == [1, 2]
    def tables(rows):
        before = len(_tables(spark))
        got = {x.doc_id: x.n_removed for x in substrings.remove_windows(_frame(spark, rows), 50).collect()}
        return got, sum("/survivors-" in x for x in _tables(spark)[before:])
    words = [f"w{k}" for k in range(400)]
    part = lambda n: " ".join(words[:n])
    own = lambda c: " ".join(f"{c}{k}" for k in range(300))
    # nothing is shared; 9 words are, which the second level drops; 60 are, which reach the last one
    assert tables([(1, own("a")), (2, own("b"))]) == ({1: 0, 2: 0}, 1)
    assert tables([(1, f"{own('a')} {part(9)} {own('c')}"), (2, f"{own('b')} {part(9)} {own('d')}")])[0] == {1: 0, 2: 0}
    assert tables([(1, f"{own('a')} {part(60)} {own('c')}"), (2, f"{own('b')} {part(60)} {own('d')}")]) == ({1: 0, 2: 60}, 2)


@pytest.mark.parametrize("length,anchor,group", [(200, 40, 4096), (60, 20, 4096), (50, 8, 6)])
def test_repeats(spark, monkeypatch, length, anchor, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = _rows() + [(None, "x " * 140), (None, None), (11, "other text " * 3), (12, _rows()[0][1]), (12, _rows()[0][1])]
    got = repeats.digest(repeats.remove_repeats(_frame(spark, rows), length, anchor)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, repeats.brute(rows, length)))


@pytest.mark.parametrize("length,anchor,group", [(60, 20, 4096), (50, 8, 6), (50, 8, 1)])
def test_repeat_groups(spark, monkeypatch, length, anchor, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    line, often = (" ".join(word() for _ in range(30)) for _ in range(2))
    rows = _rows(4, 40) + [(100 + k, f"{word()} {line} {often} {word()} {line[: 30 + 9 * k]}{word()} {often}") for k in range(9)]
    rows += [(200, f"{often}|{often}|{often}"), (201, f"{word()}|{often}|{word()}"), (202, "same start " * 5 + line), (203, line)]
    groups, places, copies = repeats.repeat_groups(_frame(spark, rows), length, anchor)
    other = {x.id for x in copies.collect() if x.copies == 2}
    texts = {i: (t or "").encode() for i, t in rows if i not in other}
    assert len(texts) == len(rows) - len(other)
    starts = {}
    for x in places.collect():
        starts.setdefault((x.c1, x.c2), []).extend((x.id, at) for at in x.starts)
    got = {}
    for x in groups.collect():
        for k in range(x["last"] - x["first"] + 1):
            got.setdefault((x.h, x.w, x.node, k), []).extend((i, at + x["first"] + k) for i, at in starts[x.c1, x.c2])
    want = {}
    for i, raw in texts.items():
        for at in range(len(raw) - length + 1):
            want.setdefault(raw[at : at + length], []).append((i, at))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_intervals():
    # entries 0..4 with common prefixes -, 2, 5, 5, 1
    assert sorted(repeats.intervals([0, 2, 5, 5, 1], 0, 5)) == sorted([(1, 3, 5, 2), (0, 3, 2, 1), (0, 4, 1, 0)])


def test_runs_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    k = np.sort(rng.integers(0, 30, 200))
    v = np.arange(200)
    t = pa.table({"k": k, "v": v})
    for size in (1, 2, 7, 200):
        got = [(int(a), int(f), bool(g)) for c, first, again in runs.runs(iter(t.to_batches(max_chunksize=size)), ["k"], "v") for a, f, g in zip(c["v"], first, again)]
        assert got == [(i, int(np.flatnonzero(k == k[i])[0]), bool((k == k[i]).sum() > 1)) for i in range(200)]


def test_others_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = sorted(zip(rng.integers(0, 40, 300).tolist(), rng.integers(0, 3, 300).tolist()))
    rows = [(k, v) for k, v in rows if k % 3 or v == 1]
    t = pa.table({"k": [k for k, _ in rows], "v": [v for _, v in rows]})
    values = {k: sorted({v for x, v in rows if x == k}) for k, _ in rows}
    for size in (1, 2, 7, 300):
        got = [(int(a), int(f), bool(g)) for c, first, other in runs.others(iter(t.to_batches(max_chunksize=size)), ["k"], "v") for a, f, g in zip(c["k"], first, other)]
        assert got == [(k, values[k][0], len(values[k]) > 1) for k, _ in rows]


def test_written_tables_can_be_cleared(spark):
    from palimpsest.llm import common

    df = common.written(spark.range(3), "some")
    assert df.count() == 3 and df.inputFiles()
    path = df.inputFiles()[0]
    common.clear(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_very_long_texts(spark):
    """Texts of more than a block: repeats and windows across the places where they are cut, words of any length."""
    from palimpsest.llm import common

    r = random.Random(4)
    n = common.BLOCK
    words = [f"{r.getrandbits(40):x}" for _ in range(n // 5)]
    long = " ".join(words)
    assert len(long) > 2 * n
    at = n - 150
    part = long[at : at + 900]
    rows = [(1, long), (2, f"before {part} after"), (3, "y" * (n + 77) + "z"), (4, "x" * (n + 50)), (5, "no repeats here")]
    got = {x.doc_id: x for x in repeats.digest(repeats.remove_repeats(_frame(spark, rows))).collect()}
    assert got[2].n_removed in (900, 901, 902) and got[1].n_removed == got[2].n_removed and got[1].n_spans == 1
    assert got[3].n_removed == n + 77 and got[4].n_removed == n + 50 and got[5].n_removed == 0
    whole = part.split()[1:-1]
    got = {x.doc_id: x for x in substrings.digest(substrings.remove_windows(_frame(spark, rows), 13)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == len(whole) and got[1].n_words == len(words) and got[3].n_words == 1
    rows += [(6, long + " more"), (7, "y" * (n + 77) + "z"), (8, "y" * (n + 78))]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(_frame(spark, rows), 4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1, 7: 3, 8: 8}


def test_pieces_hold_every_string_once():
    import pyarrow as pa

    from palimpsest.llm import common

    texts = ["abc", None, "0123456789" * 3, "", "xyz" * 7]
    b = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["id", "text"])
    for overlap, most in ((3, 7), (3, 8), (0, 4), (5, 100)):
        got = []
        for part, begin in common.pieces(b, overlap, most):
            for i, t, at in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), begin.tolist()):
                assert len(t or b"") <= most
                got += [(i, at + k, t[k : k + overlap + 1]) for k in range(len(t or b"") - overlap)]
        want = [(i, k, t[k : k + overlap + 1].encode()) for i, t in enumerate(texts) if t for k in range(len(t) - overlap)]
        assert sorted(got) == sorted(want)


def test_seen_lets_two_rows_of_a_key_through():
    from palimpsest.llm.common import Seen

    rng = np.random.default_rng(0)
    for bits in (2, 12):
        twice, later, sent, rows = Seen(bits), Seen(bits), [], []
        for _ in range(60):
            n = rng.integers(0, 30)
            key, id_ = rng.integers(0, 25, n).astype(np.uint64), rng.integers(0, 9, n)
            known, behind = twice.twice(key, id_), later.later(key, id_)
            rows += zip(key.tolist(), id_.tolist(), known.tolist(), behind.tolist())
        ids, out, least = {}, {}, {}
        for k, i, known, behind in rows:
            ids.setdefault(k, set()).add(i)
            if not known:
                out.setdefault(k, set()).add(i)
        for k, i, known, behind in rows:
            assert not known or out[k] - {i}  # a row that is held back has another that is sent
            assert not behind or min(ids[k]) < i
        assert all(min(len(ids[k]), 2) <= len(out[k]) for k in ids)
        assert all(min(ids[k]) in {i for kk, i, _, behind in rows if kk == k and not behind} for k in ids)
