"""Search, recursion, streams, statistics, audit and the fluent query."""

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.functions.text import stem, terms
from palimpsest.operators import audit, fulltext
from palimpsest.operators.builder import Query
from palimpsest.operators.recursive import fixed_point
from palimpsest.operators.snapshots import SnapshotPolicy
from palimpsest.operators.stats import analyze, histogram, suggest_indexes


def test_terms_and_stems(spark):
    row = spark.range(1).select(terms(F.lit("The quick-Brown fox, a x JUMPED over: running!")).alias("t"), terms(F.lit("running planned faster slowly nation bed"), True).alias("s")).first()
    assert row.t == ["quick", "brown", "fox", "jumped", "over", "running"]
    assert row.s == ["run", "plan", "fast", "slow", "nation", "bed"]
    assert spark.range(1).select(stem(F.lit("stations")).alias("s")).first().s == "stations"


def test_search(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "red car red"), (3, "apple red pie"), (4, None)], "id int, text string")
    index = fulltext.postings(docs, "id", "text")
    got = {r.doc: r.score for r in fulltext.text_search(index, 4, ["car", "none"]).collect()}
    assert set(got) == {2} and abs(got[2] - 1 / 3 * 1.3862943611) < 1e-9
    assert [r.doc for r in fulltext.phrase_search(index, ["red", "apple"]).collect()] == [1]
    ids = docs.select(F.col("id").alias("doc"))
    assert sorted(r.doc for r in fulltext.boolean_search(index, ids, ("and", ("term", "red"), ("not", ("phrase", ["apple", "pie"])))).collect()) == [2, 3]
    assert sorted(r.doc for r in fulltext.fuzzy_search(index, "appel", 2).collect()) == [1, 3]
    assert fulltext.highlight(docs.where("id = 1"), "text", ["apple"]).first().snippet == "red **apple** pie"


def test_fuzzy_query_searches_all_terms(spark, tmp_path):
    from palimpsest.catalog.queries import queries

    texts = ["erst Erst üerst erßt erst1", "erstä er5t ëst", "eräst first 3rst erst\U00010330 e\u0301rst", "üerstä 12 erste est 漢字", None, "erst erst"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {(k, t, distance(t, "erst")) for k, text in enumerate(texts) for t in (text or "").lower().split()}
    got = [tuple(r) for r in queries()["fts_fuzzy"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(x for x in want if x[2] <= 1) and len(got) > 10


def test_fixed_point(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    start = spark.createDataFrame([(1,)], "a int")
    got = fixed_point(start, lambda new: new.join(links, "a").select(F.col("b").alias("a")))
    assert sorted(r.a for r in got.collect()) == [1, 2, 3]


def test_statistics(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS k", "CASE WHEN id % 2 = 0 THEN 'x' END AS s")
    got = {r.column_name: r for r in analyze(df, exact=True).collect()}
    assert (got["s"].null_count, got["k"].distinct_count, got["id"].max_value) == (500, 3, "999")
    bounds = [r.bound for r in histogram(df, "id", 4).orderBy("bucket").collect()]
    assert len(bounds) == 5 and bounds == sorted(bounds) and bounds[-1] == 999
    assert [r.column_name for r in suggest_indexes(df).collect()] == ["id"]


def test_audit_and_builder(spark, tmp_path):
    e = Engine(spark, f"{tmp_path.as_uri()}/e")
    e.script("CREATE TABLE t (id INT PRIMARY KEY, v INT, s TEXT); INSERT INTO t VALUES (1, 5, 'a'), (2, NULL, 'it''s'), (3, 7, 'a')")
    e.script("CREATE TABLE u (id INT PRIMARY KEY, w INT); INSERT INTO u VALUES (1, 50); UPDATE t SET v = 0 WHERE id = 1")
    q = Query(e, "t")
    assert [r.id for r in q.where("v >= 0").order_by("v", True).select("id").limit(1).df().collect()] == [3]
    assert [r.id for r in q.where(s="it's").df().collect()] == [2]
    assert [r.id for r in q.order_by("v").select("id").offset(1).df().collect()] == [3, 2]
    assert q.as_of("@seq:3").where("id = 1").df().first().v == 5
    assert sorted(r.v for r in q.between("@seq:3", "@now").where("id = 1").df().collect()) == [0, 5]
    assert [r.v for r in q.between("@seq:1", "@seq:4", inclusive=False).where("id = 1").df().collect()] == [5]
    assert q.all_versions().where("id = 1").df().count() == 2
    assert q.join("u", ["id"], "left").where("w IS NULL").df().count() == 2
    assert q.join("u", "t.id = u.id", "anti").df().count() == 2 and q.join("u", kind="cross").df().count() == 3
    a = audit.Audit(spark, f"{tmp_path}/audit")
    a.note("ann", "SELECT", "t", "SELECT 1")
    a.note("bob", "DELETE", "t", "DELETE", ok=False, message="no")
    assert a.entries(user="bob", ok=False).count() == 1 and a.entries(limit=1).count() == 1
    a.export(f"{tmp_path}/out", "csv")
    assert audit.tagged(spark, "x", spark.range(3).count) == 3


def test_snapshot_policy(spark, tmp_path):
    p = SnapshotPolicy()
    assert not p.due(500_000, 59) and p.due(1, 3600) and not p.due(0, 9999)  # the bounds in time
    assert p.threshold(0.1) == 1000 and p.threshold(100) == 9000 and p.threshold(1e6) == 100_000
    assert not p.due(999, 1800) and p.due(1000, 1800)  # a quiet table: the least number of events
    assert not p.due(9000, 60) and p.due(9000, 91)  # a busy one waits for 1.5 times what a minute brings
    assert not SnapshotPolicy(adaptive=False).due(99_999, 9999) and SnapshotPolicy(adaptive=False).due(100_000, 0)
    e = Engine(spark, f"{tmp_path.as_uri()}/e")
    e.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    assert e.snapshot_by("t", SnapshotPolicy(least_s=0, most_s=0)) is None
    e.sql("INSERT INTO t VALUES (1, 5), (2, 6)")
    assert e.snapshot_by("t") is None
    now = SnapshotPolicy(least_s=0, most_s=0)
    assert e.snapshot_by("t", now) == 2 and e.snapshot_by("t", now) is None and e.table("t").store.snapshots() == [2]


def test_branch(spark, tmp_path):
    e = Engine(spark, f"{tmp_path.as_uri()}/e")
    e.script("CREATE TABLE t (id INT PRIMARY KEY, v INT CHECK (v > 0), w TEXT); INSERT INTO t VALUES (1, 5, 'a'), (2, 6, 'b')")
    e.script("ALTER TABLE t RENAME COLUMN w TO name; UPDATE t SET v = 7 WHERE id = 1; DELETE FROM t WHERE id = 2")
    read = lambda name: sorted(tuple(r) for r in e.table(name).df().collect())
    e.branch("t", "old", 2), e.branch("t", "same"), e.branch("t", "none", 0)
    assert read("old") == [(1, 5, "a"), (2, 6, "b")] and read("same") == read("t") == [(1, 7, "a")] and read("none") == []
    e.script("UPDATE old SET v = 9 WHERE id = 2; INSERT INTO t VALUES (3, 1, 'c'); INSERT INTO none VALUES (4, 1, 'd')")
    assert read("old") == [(1, 5, "a"), (2, 9, "b")] and read("t") == [(1, 7, "a"), (3, 1, "c")] and read("none") == [(4, 1, "d")]
    assert sorted(tuple(r) for r in e.table("old").as_of(2).df().collect()) == [(1, 5, "a"), (2, 6, "b")]
    assert e.table("old").last_seq() == 3 and e.table("none").last_seq() == 1
    with pytest.raises(Exception, match="v > 0"):
        e.sql("UPDATE old SET v = -1")
    with pytest.raises(ValueError, match="exists"):
        e.branch("t", "old")


def test_files_of_statements_and_versioning_text(spark, tmp_path):
    e = Engine(spark, f"{tmp_path.as_uri()}/e")
    e.files.write(f"{tmp_path}/in.sql", "-- a table\nCREATE TABLE t (a INT, b VARCHAR(9) NOT NULL, PRIMARY KEY (a, b))\n\nINSERT INTO t VALUES (1, 'x; --y'); SELECT * FROM t;\n")
    assert [tuple(r) for r in e.run_file(f"{tmp_path}/in.sql")[-1].collect()] == [(1, "x; --y")]
    text = e.sql("SHOW CREATE TABLE t").first()[0]
    assert text.endswith(") WITH SYSTEM VERSIONING") and "SYSTEM_TIME_END TIMESTAMP(12) GENERATED ALWAYS AS ROW END" in text
    e.sql(text.replace("TABLE t", "TABLE u"))
    t, u = e.table("t"), e.table("u")
    assert t.schema == u.schema and t.key == u.key == ["a", "b"] and u.store.meta["not_null"] == t.store.meta["not_null"]
