"""The pipeline's stages on a small table: columns stay, decisions take effect, planted cases are caught."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import decontam, neardup, repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each written and read again."""
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_near_dedup_keeps_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, _, _, kept in neardup.brute(rows, 5) if kept}
    assert {r.doc_id for r in stages[2].collect()} == want


def test_repeated_strings_are_gone(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    raws = {i: t.encode() for i, t in rows}
    cut = {d[0]: d[2] for d in repeats.brute(rows)}
    after = {r.doc_id: r for r in stages[3].collect()}
    for i, raw in raws.items():
        if cut[i] == 0:
            assert after[i].text.encode() == raw
        elif i in after:  # whole characters go, so up to three bytes more at either end of each run
            assert len(after[i].text.encode()) <= len(raw) - cut[i] and after[i].n_chars == len(after[i].text)


def test_no_test_item_is_left(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in stages[3].collect()]
    hit = {d for d, _ in decontam.brute(before, items)}
    assert {r.doc_id for r in stages[4].collect()} == {i for i, _ in before} - hit


def test_packing_covers_what_is_left(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts: dict = {}
    for r in stages[5].orderBy("start").collect():
        parts[r.doc_id] = parts.get(r.doc_id, b"") + bytes(r.input_ids)
    for r in stages[4].collect():
        assert parts[r.doc_id] == np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_run_gives_the_same(spark, stages):
    names = ["doc_id", "start", "length", "ids_crc32"]
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select(names).collect()))
    assert got == sorted(map(tuple, stages[5].select(names).collect()))


def test_stages_take_empty_tables(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "A b c d e f g"), (1, "other words of this row")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, th string")
    got = sorted(((r.doc_id or 0, r.text) for r in neardup.keep_first(docs).collect()))
    assert got == [(0, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words of this row")]


def test_every_stage_takes_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns named like those that stages make."""
    import random

    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    prose = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    long = " ".join([prose[0][1], *(word() for _ in range(300_000))])
    rows = [*prose, (9001, None), (9002, ""), (9003, " \n"), (9004, long), (9004, long), (None, prose[1][1]), (None, None), (9005, "x" * 1_500_000)]
    extra = ["selected", "n_removed", "copies", "tail_probability", "id", "th", "sig", "key", "node", "component"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, None, None, None, *([f"own {k}"] * len(extra))) for k, (i, t) in enumerate(rows)], schema).repartition(4)
    docs.cache()
    mine = {(x.doc_id, x.selected) for x in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF).collect()
        assert list(got[0].asDict()) == docs.columns
        assert {(x.doc_id, x.selected) for x in got} <= mine and all(x[c] == x.selected for x in got for c in extra), name
        kept = {x.doc_id for x in got}
        if name == "minhash_near_dedup":
            assert sum(x.doc_id == 9004 for x in got) == 1 and {None, 9001, 9002, 9003, 9005} <= kept
        if name == "suffix_array_dedup":  # copies of the long text, and the x that repeat themselves, go whole
            assert not {9004, 9005} & kept and {9001, 9002, 9003} <= kept
        if name == "benchmark_decontamination":
            assert {None, 9001, 9002, 9003, 9004, 9005} <= kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").sum("length").collect()
    sizes = {x.doc_id: x[1] for x in pieces}
    assert sizes[9001] == sizes[9002] == sizes[9003] == 1 and set(sizes) == {i for i, _ in rows}
    docs.unpersist()
