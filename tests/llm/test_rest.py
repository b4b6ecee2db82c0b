"""Search, scans, classifiers, chat formatting and decontamination, held against brute force or held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tokenizers import Tokenizer

from palimpsest.llm import ann, chat, decontam, licenses, quality, queries, toxicity

DOCS = "doc_id long, text string, score string, label string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], DOCS).repartition(3)


# op2


def test_nearest_small_is_exact(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[10][1]) for i in range(40)] + [(5000, None), (5100, []), (5200, [0.0] * 8), (5300, [1.0, None] * 4), (5400, [float("nan")] * 8), (5500, [float("inf")] * 8), (5600, [1.0] * 3), (None, rows[0][1]), (20, rows[20][1]), (20, rows[21][1]), (1000, rows[11][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted((a, b, c, round(d, 5)) for a, b, c, d in ann.nearest(df, every=20, k=5).collect())
    f = lambda v: None if v is None else [None if c is None else float(np.float32(c)) for c in v]
    want = sorted((a, b, c, round(d, 5)) for a, b, c, d in ann.brute([(i, f(v)) for i, v in rows if i != 5600], 20, 5))
    assert got == want
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id in (0, 1, 2)"), every=2, k=10).count() == 4


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, every=100, k=10).collect()}
    want = {(q, v) for q, _, v, _ in ann.brute([(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()], 100, 10)}
    assert len(got & want) / len(want) >= 0.9


def _clustered(n, width, centres, seed=0):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    return (c[r.integers(0, centres, n)] + 0.5 * r.normal(size=(n, width))).astype(np.float32)


@pytest.mark.parametrize("fit", [16384, 1024])
def test_recall_where_most_lists_are_skipped(spark, monkeypatch, fit):
    """50,000 vectors, some 1,000 lists (fitted at once, or in cells): recall, and how few lists are read."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "FIT", fit)
    x = _clustered(50_000, 24, 300)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    good = ann.usable(df, "vec_id", "embedding")
    index = ann.build(good, 10, list_size=50 if fit == 1024 else 100)
    lists = len(index.centroids.at)
    assert lists >= 400 and index.lists.select("vid").distinct().count() == len(x)
    got = ann.search(index, good.where("vec_id % 200 = 0"), 10).collect()
    from palimpsest.llm import common

    made = [p for p in common._MADE[spark.sparkContext.applicationId] if "/probes-" in p][-1]
    read = spark.read.parquet(made).groupBy("query_id").count().agg(F.avg("count")).first()[0]
    assert read < 0.15 * lists
    found, q = {(r.query_id, r.vec_id) for r in got}, np.arange(0, len(x), 200)
    d = ann.distances(x[q].astype(float), x.astype(float))
    d[np.arange(len(q)), q] = np.inf
    want = {(int(i), int(j)) for i, row in zip(q, np.argpartition(d, 9, axis=1)[:, :10]) for j in row}
    assert len(found & want) / len(want) >= 0.9


def test_the_graph_finds_near_centroids():
    x = _clustered(20_000, 16, 200, 3)
    c = ann.Centroids(x[:3000], ann.neighbours(x[:3000], np.arange(3000), 24))
    q = x[3000:3400]
    ids, d = c.search(q, 10, 32)
    want = np.argsort(ann.distances(q, c.at), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) >= 0.9 and (np.diff(d, axis=1) >= 0).all()
    ids, d = c.search(q, 10, 32, wide=1)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, want)]) >= 0.85
    tiny = ann.Centroids(x[:3], ann.neighbours(x[:3], np.arange(3), 24))
    assert (tiny.search(q, 6, 8)[0] >= 0).sum(1).tolist() == [3] * 400


# op3


def test_licenses(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    long = " ".join(word() for _ in range(60))
    t = dict(licenses.TEMPLATES, LONG=long, TINY="all mine")
    w = long.split()
    rows = [(i, f"{word()} " * r.randint(0, 80) + x + f" {word()}" * r.randint(0, 80)) for i, x in enumerate([*t.values(), "", "nothing", " ".join(w[:55]), " ".join(w[:30]), long.upper().replace(" ", ",\n")])]
    rows += [(50, None), (51, ""), (None, "Released under the MIT License."), (52, " ".join([*w[:20], "x", *w[21:45], "y", *w[46:]])), (53, (long + " filler words here ") * 3), (53, "mine")]
    got = licenses.scan(_docs(spark, rows), t).collect()
    assert {(x.doc_id, x.license) for x in got} == licenses.brute(rows, t)
    assert sum(x.doc_id == 53 and x.license == "LONG" for x in got) == 3
    assert licenses.scan(_docs(spark, rows), {}).count() == licenses.scan(_docs(spark, rows).limit(0)).count() == 0


def test_default_templates_hold_license_texts(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
# The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
# THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
# FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
# LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    t = licenses.defaults()
    assert t.items() >= licenses.TEMPLATES.items() and all(f"{x}-text" in t for x in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"))
    names = sorted(t)
    rows = [(k, f"words before it {t[x]} and behind " * 2) for k, x in enumerate(names)]
    rows += [(500, f"# {mit}"), (501, " ".join(mit.split()[:70])), (502, "the software and the use of this software in the public domain " * 30), (503, "x = 1\n" * 400 + t["GPL-2.0-header"].upper())]
    got = licenses.scan(_docs(spark, rows)).collect()
    for k, x in enumerate(names):
        assert sum(r.doc_id == k and r.license == x and r.containment == 1 for r in got) == 2, x
    assert [r.license for r in got if r.doc_id == 500] == ["MIT-text"] and not [r for r in got if r.doc_id in (501, 502)]
    small = {x: y for x, y in t.items() if len(y.split()) < 130}
    few = [(k, y) for k, y in rows if len(y.split()) < 130]
    assert {(r.doc_id, r.license) for r in got if r.doc_id in dict(few) and r.license in small} == licenses.brute(few, small)


def test_bands_guarantee_retrieval():
    assert (1 - 0.3) ** licenses.bands_for(0.3, 1, 1e-9) <= 1e-9


# op4


def _graded(n=1500, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        g = i % 3
        w = [word() for _ in range(r.randint(20, 60))]
        if g == 0:
            w = [x + "***" for x in w]
        if g == 1:
            w = [x for x in w for _ in range(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, g))
    return rows, labels


def test_ordinal_regression(spark):
    rows, labels = _graded()
    docs, lab = _docs(spark, rows), spark.createDataFrame([(i, g, "x") for i, g in labels if i < 1200], "doc_id long, quality int, text string")
    model = quality.train(docs, lab, most=1200)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.graded(docs, model, at_least=2).collect()}
    held = [(i, g) for i, g in labels if i >= 1200]
    assert np.mean([got[i].selected == (g == 2) for i, g in held]) > 0.9
    assert np.mean([round(got[i].expected_grade) == g for i, g in held]) > 0.9
    assert "score" in got[0].asDict()


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "some words"), (4, "w " * 50000), (4, "again")]
    docs, lab = _docs(spark, rows), spark.createDataFrame([], "doc_id long, quality int")
    got = quality.graded(docs, quality.train(docs, lab), 1).collect()
    assert sorted((r.doc_id or 0, r.selected) for r in got) == [(0, True), (1, False), (2, False), (3, False), (4, True), (4, True)]
    one = quality.train(docs, spark.createDataFrame([(4, 1), (None, 1), (4, None), (77, 1)], "doc_id long, quality int"))
    assert all(r.expected_grade == 1 for r in quality.graded(docs, one, 1).collect())
    assert quality.graded(docs.limit(0), one, 1).count() == 0


def test_scores_equal_features_by_weights():
    import pyarrow as pa

    m = quality.Model([0, 1], np.random.default_rng(0).normal(size=quality.WIDTH), np.zeros(1))
    col = pa.array(["Some words, some words!", None, "", "é ** é **", "x " * 300])
    x = quality.features(col)
    assert np.allclose(m.scores(col)[0], x @ m.weights, atol=1e-5)


def test_features_do_not_depend_on_the_neighbours():
    import pyarrow as pa

    m = quality.Model([0, 1], np.random.default_rng(0).normal(size=quality.WIDTH), np.zeros(1))
    texts = ["some words", "some words", "a", "", "ab", "abc", None, "é", "some words", "zz top"]
    alone = [quality.features(pa.array([t], pa.string()))[0] for t in texts]
    assert np.array_equal(quality.features(pa.array(texts)), alone)
    assert np.allclose(m.scores(pa.array(texts))[0], [m.scores(pa.array([t], pa.string()))[0][0] for t in texts], rtol=0, atol=1e-12)
    assert [round(float(x[: quality.BUCKETS].sum()), 5) for x in alone] == [1, 1, 0, 0, 0, 1, 0, 0, 1, 1]


@pytest.mark.parametrize("sf", ["0.01"])
def test_quality_on_the_tables(spark, sf):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    test = lab.where("doc_id % 5 = 0")
    model = quality.train(docs, lab.where("doc_id % 5 <> 0"))
    got = quality.graded(docs, model, 1).join(test, "doc_id").select("selected", "quality").collect()
    assert np.mean([r.selected == (r.quality == 1) for r in got]) >= 0.97


def test_quality_query_returns_every_document(spark):
    from palimpsest.llm import queries

    d = "/root/testdata/sf0.001"
    got = queries.op4_quality(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect())
    assert {r.selected for r in got} == {True, False} and all(r.selected == (r.tail_probability >= 0.5) for r in got)


# op6


@pytest.mark.parametrize("budget,history", [(512, 128), (40, 10), (1, 0), (60, 60)])
def test_chat_reads_back(spark, budget, history):
    r = random.Random(4)
    bits = ["</s>", "[INST]", "<|im_end|>\n", "<|im_start|>", "\\", "\\\\<", "<<SYS>>", "<s</s>>", "word ", "é", "\n", "assistant\n", "<", "[/INST] "]
    rows = []
    for c in range(30):
        for t in range(r.randint(1, 12)):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(("user", "assistant", "assistant", "a\\b\nc", None))
            rows.append((c, r.choice((t, t, None)), role, r.choice((None, "".join(r.choice(bits) for _ in range(r.randint(0, 15)))))))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "user", "same"), (3, 0, "user", "same"), (99, 0, "assistant", "z " * 20000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, window string")
    made = chat.format_windows(df, queries.word_bpe(), budget, history)
    whole = Tokenizer.from_file(queries.word_bpe())
    got = sorted((tuple(x)[:5] for x in chat.digest(made).collect()), key=str)
    assert got == sorted(chat.brute(rows), key=str)
    for w in made.collect():
        turns = chat.parse(w.formatted)
        assert "".join(chat.turn(*t)[0] for t in turns) == w.formatted and len(turns) > w.repeated
        cost = len(whole.encode(w.formatted, add_special_tokens=False).ids)
        assert cost <= budget or len(turns) - w.repeated == 1
    assert chat.digest(chat.format_windows(df.limit(0), queries.word_bpe())).count() == 0


def test_windows_keep_the_system_turn_and_history():
    turns = [("system", "be brief")] + [(("user", "assistant")[k % 2], f"turn {k} " * 5) for k in range(10)]
    made = list(chat.windows(iter(turns), 80, 20, lambda text: len(text) // 4))
    assert len(made) > 2 and all(chat.parse(w)[0][0] == "system" for w, _, _ in made)
    assert any(n > 1 for _, _, n in made[1:])


def test_escape_hides_every_control_string():
    r = random.Random(0)
    for _ in range(2000):
        t = "".join(r.choice([*chat.CONTROL, "<", "|", "im_start", "[", "\\", "a"]) for _ in range(6))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


# op9


def test_toxicity_on_the_tables(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, toxicity.train(docs, lab)).join(lab, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert np.mean([r.toxic == r.predicted for r in got]) >= 0.93


def test_unseen_misspellings_on_the_table(spark):
    """Held-out toxic texts with every toxic word spelt in a new way: most are caught still, by the n-grams that are left."""
    import re

    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, lab)
    held = docs.join(lab.where("toxic = 1"), "doc_id").where(toxicity.fold(docs.doc_id)).select("text").collect()
    texts = [x.text for x in held if x.text]
    r = random.Random(0)

    def new(m):
        w, k = m[0], r.randrange(1, len(m[0]))
        return w[:k] + r.choice("0123456789") + w[k + r.randint(0, 1) :]

    bad = re.compile(r"\b(stupid|disgusting|idiot|clown|trash|pathetic|worthless|scum|moron|loser)\b", re.I)
    caught = lambda change: np.mean(model.scores(pa.array([bad.sub(change, t) for t in texts])) >= 0.5)
    assert caught(lambda m: m[0]) >= 0.9 and caught(new) >= 0.6 and caught(new) >= caught("") + 0.25


def test_unseen_misspellings_share_ngrams():
    import pyarrow as pa

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = [" ".join([word() for _ in range(30)] + (["stupid", "moron"] if k % 2 else [])) for k in range(400)]
    bags = []
    for t in texts:
        bags.append(np.unique(np.concatenate([b for b, _ in toxicity.subwords(pa.array([t]))]), return_counts=True))
    m = toxicity.fit(bags, np.array([k % 2 for k in range(400)]))
    a, b = m.scores(pa.array([" ".join(word() for _ in range(30)), " ".join(word() for _ in range(28)) + " stupidd morons"]))
    assert a < 0.5 < b


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "words"), (4, "w " * 50000), (4, "again")]
    docs = _docs(spark, rows)
    got = toxicity.scored(docs, toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), toxicity.Model(np.zeros(1 << toxicity.BITS), 0.0)).count() == 0


# op10


def _items(n=30, seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    return [(i, " ".join(word() for _ in range(r.randint(8, 40))) + "? " + " ".join(word() for _ in range(r.randint(1, 6))) + ".") for i in range(n)], word, r


def test_decontamination(spark):
    items, word, r = _items()
    items += [(90, None), (91, ""), (92, "one two three"), (93, items[0][1])]
    rows = []
    for k in range(120):
        w = [word() for _ in range(r.randint(0, 200))]
        if k % 2:
            q = items[r.randrange(30)][1].split()
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                q[r.randrange(len(q))] = word()
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() for x in q] if k % 3 else q
        rows.append((k, (" ", "\n", ", ")[k % 3].join(w)))
    rows += [(200, None), (201, ""), (None, items[3][1]), (202, "so One, two; THREE more"), (203, items[5][1]), (203, items[6][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.contaminated(_docs(spark, rows), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == decontam.brute(rows, items)
    clean = decontam.clean(_docs(spark, rows), bench).collect()
    assert sorted((x.doc_id, x.text) for x in clean) == sorted((i, t) for i, t in rows if not decontam.brute([(i, t)], items))
    assert decontam.contaminated(_docs(spark, rows), bench.limit(0)).count() == decontam.contaminated(_docs(spark, rows).limit(0), bench).count() == 0
    assert decontam.clean(_docs(spark, rows), bench.limit(0)).count() == len(rows)


def test_shards_give_the_same(spark, monkeypatch):
    items, word, r = _items()
    rows = [(k, " ".join(word() for _ in range(20)) + " " + t) for k, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted((x.doc_id, x.item_id, x.passage, round(x.score, 9), x.overlap) for x in df.collect())
    want = key(decontam.contaminated(_docs(spark, rows), bench))
    assert {x[:2] for x in want} >= {(k, k) for k, _ in items}
    monkeypatch.setattr(decontam, "SHARD", 600)
    shards = decontam._shards(bench, 5, 0.8)
    assert len(shards) > 3 and key(decontam.contaminated(_docs(spark, rows), bench)) == want
    one = decontam.Index(items, 5, 0.8)
    for s in shards:  # statistics are those of all items
        for t, p in zip(s.value.terms.tolist(), s.value.postings):
            k = int(np.searchsorted(one.terms, t))
            whole = dict(zip((one.ids[i] for i in one.postings[k].items), one.postings[k].impacts))
            assert all(abs(whole[s.value.ids[i]] - x) < 1e-9 for i, x in zip(p.items, p.impacts))


def test_question_and_answer_must_both_be_there(spark):
    question, answer = "which river runs through the old town of the northern county", "the long winding river of stones and reeds"
    bench = spark.createDataFrame([(1, f"{question}? {answer}."), (2, f"{question} now? Paris.")], "item_id long, text string")
    rows = [(1, f"he asked {question} {answer} and left"), (2, f"{question} something quite different here"), (3, f"so {answer} it was"), (4, f"{question} now London"), (5, f"{question} now Paris")]
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(_docs(spark, rows), bench).collect()} == {(1, 1), (5, 2)}


def test_very_long_texts(spark):
    """Texts of several megabytes are searched, scored and scanned whole."""
    r = random.Random(3)
    words = [f"{r.getrandbits(30):x}" for _ in range(350_000)]
    question = "is this the question that nobody answers? it may well be so indeed"
    license = "Released under the MIT License."
    at = len(words) // 2
    long = " ".join([*words[:at], question, license, *words[at:]])
    rows = [(1, long), (2, "w" * 3_000_000), (3, question), (4, "")]
    bench = spark.createDataFrame([(7, question)], "item_id long, text string")
    assert {x.doc_id for x in decontam.contaminated(_docs(spark, rows), bench).collect()} == {1, 3}
    assert [(x.doc_id, x.license, x.word) for x in licenses.scan(_docs(spark, rows)).collect()] == [(1, "MIT", at + len(question.split()))]
    model = quality.Model([0.0, 1.0], np.random.default_rng(0).normal(size=quality.WIDTH), np.zeros(1))
    got = {x.doc_id: x for x in quality.graded(_docs(spark, rows), model, 1).collect()}
    assert len(got) == 4 and got[1].tail_probability is not None and not got[4].selected
    col = pa.array([long, "short one", "w" * 3_000_000])
    s, n = model.scores(col)
    x = quality.features(col).astype(float)
    assert np.allclose(s, x @ model.weights, atol=1e-3) and n[0] == len(long.split())
    table = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    whole = toxicity.Model(table, 0.1)
    parts = [toxicity.bag(pa.array([t])) for t in (long, "short one")]
    want = [1 / (1 + np.exp(-(table[b] @ n / n.sum() + 0.1))) for b, n in parts]
    assert np.allclose(whole.scores(pa.array([long, "short one"])), want, atol=1e-6)


def test_wand_retrieves_all_above_the_threshold():
    items, _, r = _items(60)
    index = decontam.Index(items, 5, 0.8, block=3)
    for _ in range(200):
        terms = sorted(r.sample(range(len(index.terms)), min(len(index.terms), r.randint(1, 60))))
        want = {}
        for t in terms:
            for k, s in zip(index.postings[t].items, index.postings[t].impacts):
                want[k] = want.get(k, 0) + s
        for least in (0.3, 0.6, 1.0):
            assert sorted(k for k, _ in index.wand(terms, least)) == sorted(k for k, s in want.items() if s >= least)
