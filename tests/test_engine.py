"""The engine: folds against a naive replay, SQL over past states, writes, transactions, constraints."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine, EngineError, Sequence, Trigger
from palimpsest.operators import fold
from palimpsest.operators.policies import Policy
from palimpsest.plans.temporal_sql import Clause, point, rewrite, statements, timestamp
from palimpsest.sources import store


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, tmp_path.as_uri())


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# the fold


def _replay(events, upto):
    state = {}
    for seq, op, keys, pk, a, b in events:
        if seq > upto:
            break
        if op == "INSERT":
            state[pk] = {"a": a if keys is None or "a" in keys else None, "b": b if keys is None or "b" in keys else None}
        elif op == "PATCH" and pk in state:
            for c, v in (("a", a), ("b", b)):
                if keys is None or c in keys:
                    state[pk][c] = v
        elif op == "SOFT_DELETE":
            state.pop(pk, None)
    return sorted((k, v["a"], v["b"]) for k, v in state.items())


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_replay(spark, seed):
    r = random.Random(seed)
    events = []
    for seq in range(1, 121):
        op = r.choice(("INSERT", "PATCH", "PATCH", "PATCH", "SOFT_DELETE"))
        keys = r.choice((None, ["a"], ["b"], ["a", "b"], [])) if op == "PATCH" else None
        a, b = (r.choice((None, r.randint(0, 9))) for _ in range(2))
        events.append((seq, op, keys, r.randint(1, 12), None if op == "SOFT_DELETE" else a, None if op == "SOFT_DELETE" else b))
    log = spark.createDataFrame(events, "seq long, op string, keys array<string>, pk int, a int, b int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, seq)")).cache()
    versions = fold.versions(log, ["pk"], ["a", "b"]).cache()
    key = lambda x: str(x)
    for upto in (1, 7, 40, 77, 120):
        want = sorted(_replay(events, upto), key=key)
        assert rows(fold.fold(fold.as_of(log, seq=upto), ["pk"], ["a", "b"])) == want
        assert rows(versions.where(fold.valid_at(F.col("start_seq"), F.col("end_seq"), F.lit(upto))).select("pk", "a", "b")) == want
        snap = fold.fold(fold.as_of(log, seq=upto // 2), ["pk"], ["a", "b"])
        assert rows(fold.fold_from(snap, upto // 2, log, ["pk"], ["a", "b"], upto)) == want
        kept = fold.compact(log, ["pk"], ["a", "b"], retain_after=upto // 2)
        assert rows(fold.fold(fold.as_of(kept, seq=upto), ["pk"], ["a", "b"])) == want


def test_plan_prunes_and_shuffles_once(spark, tmp_path):
    log = spark.range(1000).selectExpr("id as seq", "current_timestamp() as ts", "'INSERT' as op", "id % 7 as pk", "id as a", "id as b")
    log.write.parquet(f"{tmp_path}/log")
    df = fold.fold(fold.as_of(spark.read.parquet(f"{tmp_path}/log"), seq=10), ["pk"], ["a"])
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(seq,10)" in plan and "b:bigint" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert plan.split("== Physical Plan ==")[1].count("Exchange (") == 1


# temporal text


def test_rewrite_leaves_strings_and_comments():
    seen = []
    out = rewrite("SELECT 't FOR SYSTEM_TIME ALL' FROM t FOR SYSTEM_TIME AS OF @SEQ:3 x JOIN u FOR SYSTEM_TIME AS OF '2024-01-01' ON x.a = u.a -- t FOR SYSTEM_TIME ALL", lambda n, c: seen.append((n, c)) or f"v{len(seen)}")
    assert seen == [("t", Clause("as_of", 3)), ("u", Clause("as_of", "2024-01-01 00:00:00"))]
    assert out == "SELECT 't FOR SYSTEM_TIME ALL' FROM v1 x JOIN v2 AS u ON x.a = u.a -- t FOR SYSTEM_TIME ALL"
    assert statements("a; b ';' -- c;\n; d") == ["a", "b ';'", "d"]


def test_points():
    assert point("@SEQ:12") == 12 and point("CURRENT_TIMESTAMP") is None and point("@now") is None
    assert timestamp("2024-01-01T10:00:00+02:00") == "2024-01-01 08:00:00" and timestamp("2024-01-01") == "2024-01-01 00:00:00"


# statements


def test_time_travel(engine):
    engine.sql("CREATE TABLE products (id VARCHAR(10) PRIMARY KEY, name TEXT, price DOUBLE)")
    engine.sql("INSERT INTO products VALUES ('prod1', 'Widget', 10.0)")
    engine.sql("UPDATE products SET price = 15.0 WHERE id = 'prod1'")
    assert rows(engine.sql("SELECT price FROM products")) == [(15.0,)]
    assert rows(engine.sql("SELECT price FROM products FOR SYSTEM_TIME AS OF @SEQ:1")) == [(10.0,)]
    assert rows(engine.table("products").as_of(seq=1).df()) == [("prod1", "Widget", 10.0)]
    assert rows(engine.sql("SELECT p.price, old.price FROM products p JOIN products FOR SYSTEM_TIME AS OF @SEQ:1 old ON p.id = old.id")) == [(15.0, 10.0)]
    assert engine.sql("SELECT * FROM products FOR SYSTEM_TIME AS OF '1999-01-01'").count() == 0
    engine.sql("DELETE FROM products")
    assert engine.sql("SELECT * FROM products").count() == 0
    assert [r.event_type for r in engine.sql("SELECT * FROM products FOR SYSTEM_TIME ALL ORDER BY sequence").collect()] == ["INSERT", "PATCH", "SOFT_DELETE"]
    assert engine.sql("SHOW HISTORY products WHERE id = 'prod1'").count() == 3
    assert rows(engine.table("products").diff(1, 2))[0][0] == "changed"


def test_transactions(engine):
    engine.script("CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 10), (2, 20)")
    engine.script("BEGIN; INSERT INTO t VALUES (3, 30)")
    assert engine.sql("SELECT * FROM t").count() == 3
    with pytest.raises(EngineError):
        engine.sql("INSERT INTO t VALUES (3, 31)")
    with pytest.raises(EngineError, match="aborted"):
        engine.sql("SELECT * FROM t")
    with pytest.raises(EngineError):
        engine.sql("COMMIT")
    assert rows(engine.sql("SELECT * FROM t")) == [(1, 10), (2, 20)]
    engine.script("BEGIN; UPDATE t SET v = 0; SAVEPOINT a; DELETE FROM t WHERE id = 1; SAVEPOINT b; DELETE FROM t; ROLLBACK TO b; RELEASE SAVEPOINT b; COMMIT")
    assert rows(engine.sql("SELECT * FROM t")) == [(2, 0)]
    engine.script("BEGIN; DELETE FROM t; ROLLBACK")
    assert engine.sql("SELECT * FROM t").count() == 1


def test_constraints(engine):
    engine.sql("CREATE TABLE p (id INT PRIMARY KEY, email TEXT UNIQUE, age INT NOT NULL DEFAULT 18, CHECK (age >= 18))")
    engine.sql("CREATE TABLE c (id INT PRIMARY KEY, p_id INT REFERENCES p(id))")
    engine.sql("INSERT INTO p (id, email) VALUES (1, 'a'), (2, NULL), (3, NULL)")
    assert rows(engine.sql("SELECT age FROM p WHERE id = 1")) == [(18,)]
    engine.sql("INSERT INTO c VALUES (1, 1), (2, NULL)")
    for bad in (
        "INSERT INTO p VALUES (1, 'z', 20)", "INSERT INTO p VALUES (8, 'z', 20), (8, 'y', 20)", "INSERT INTO p VALUES (NULL, 'z', 20)", "INSERT INTO p VALUES (4, 'a', 20)",
        "INSERT INTO p VALUES (4, 'z', 2)", "INSERT INTO p VALUES (4, 'z', NULL)", "INSERT INTO c VALUES (5, 99)", "UPDATE c SET p_id = 77", "DELETE FROM p WHERE id = 1",
        "TRUNCATE TABLE p", "UPDATE p SET email = 'a' WHERE id = 2", "UPDATE p SET id = 2 WHERE id = 3", "UPDATE p SET id = 50 WHERE id = 1",
    ):
        with pytest.raises(EngineError):
            engine.sql(bad)
    assert engine.table("p").last_seq() == 3
    engine.sql("UPDATE p SET email = 'a' WHERE id = 1")
    engine.sql("DELETE FROM p WHERE id = 3")
    assert engine.sql("SELECT * FROM p").count() == 2


def test_triggers_and_procedures(engine):
    engine.script("CREATE TABLE t (id INT PRIMARY KEY, v INT); CREATE TABLE audit (id INT PRIMARY KEY, n INT)")
    engine.triggers.append(Trigger("double", "t", "BEFORE", "INSERT", lambda df: df.withColumn("v", F.col("v") * 2), when="v < 100"))
    engine.triggers.append(Trigger("log", "t", "AFTER", "INSERT", lambda df: engine.insert("audit", df.selectExpr("id", "v AS n")) and None))
    engine.sql("INSERT INTO t VALUES (1, 5), (2, 500)")
    assert rows(engine.sql("SELECT * FROM t")) == rows(engine.sql("SELECT * FROM audit")) == [(1, 10), (2, 500)]

    def stop(df):
        raise EngineError("no")

    engine.triggers.append(Trigger("stop", "t", "BEFORE", "DELETE", stop))
    with pytest.raises(EngineError):
        engine.sql("DELETE FROM t")
    engine.procedures["add"] = "INSERT INTO t VALUES ($1, $2); SELECT count(*) AS n FROM t"
    assert rows(engine.call("add", 3, 7)) == [(3,)]
    engine.procedures["top"] = lambda e, k: e.sql(f"SELECT id FROM t ORDER BY v DESC LIMIT {k}")
    assert rows(engine.sql("CALL top(1)")) == [(2,)]


def test_views(engine):
    engine.script("CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 5), (2, 50); CREATE VIEW big AS SELECT * FROM t WHERE v > 10; CREATE MATERIALIZED VIEW m AS SELECT count(*) AS n FROM big")
    engine.sql("INSERT INTO t VALUES (3, 60)")
    assert engine.sql("SELECT * FROM big WHERE id > 1").count() == 2 and rows(engine.sql("SELECT * FROM m")) == [(1,)]
    engine.sql("REFRESH MATERIALIZED VIEW m")
    assert rows(engine.sql("SELECT * FROM m")) == [(2,)]
    assert "big" in Engine(engine.spark, engine.root).views
    with pytest.raises(EngineError):
        engine.sql("DROP VIEW big")
    engine.sql("DROP VIEW big CASCADE")
    assert not engine.views


def test_policies(engine):
    engine.script("CREATE TABLE t (id INT PRIMARY KEY, owner TEXT); INSERT INTO t VALUES (1, 'ann'), (2, 'bob')")
    engine.policies.add(Policy("own", "t", "owner = $user"))
    engine.policies.superusers.add("root")
    engine.user = "ann"
    assert rows(engine.sql("SELECT id FROM t")) == [(1,)]
    with pytest.raises(EngineError):
        engine.sql("INSERT INTO t VALUES (3, 'bob')")
    engine.sql("DELETE FROM t")
    engine.user = "root"
    assert rows(engine.sql("SELECT id FROM t")) == [(2,)]
    engine.user = "x' OR '1' = '1"
    assert engine.sql("SELECT id FROM t").count() == 0


def test_schema_changes(engine):
    engine.script("CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 5); ALTER TABLE t ADD COLUMN w TEXT; INSERT INTO t VALUES (2, 6, 'x')")
    assert rows(engine.sql("SELECT * FROM t")) == [(1, 5, None), (2, 6, "x")]
    engine.sql("ALTER TABLE t RENAME COLUMN v TO size")
    assert rows(engine.sql("SELECT id, size FROM t")) == [(1, 5), (2, 6)]
    engine.sql("ALTER TABLE t DROP COLUMN w")
    assert engine.sql("SELECT * FROM t").columns == ["id", "size"]
    with pytest.raises(EngineError):
        engine.sql("ALTER TABLE t DROP COLUMN id")


def test_maintenance(engine, tmp_path):
    engine.script("CREATE TABLE t (id INT PRIMARY KEY, v INT); INSERT INTO t VALUES (1, 5), (2, 6); CHECKPOINT TABLE t; UPDATE t SET v = v + 1; CREATE INDEX i ON t (v)")
    want = rows(engine.sql("SELECT * FROM t"))
    assert want == [(1, 6), (2, 7)] and engine.table("t").store.snapshots() == [2] and not engine.snapshot_due("t")
    store.backup(engine.store("t"), f"{tmp_path}/full")
    engine.sql("DELETE FROM t WHERE id = 1")
    store.backup(engine.store("t"), f"{tmp_path}/more", since=4)
    store.restore(engine.spark, [f"{tmp_path}/full", f"{tmp_path}/more"], f"{engine.root}/tables/again")
    assert rows(engine.sql("SELECT * FROM again")) == [(2, 7)]
    engine.sql("VACUUM t")
    assert rows(engine.sql("SELECT * FROM t")) == [(2, 7)] and engine.table("t").log().count() == 1
    assert "Exchange" in engine.sql("EXPLAIN SELECT v, count(*) FROM t GROUP BY v").first()[0]
    assert rows(engine.sql("ANALYZE t").select("column_name", "row_count")) == [("id", 1), ("v", 1)]
    assert rows(engine.sql("SHOW TABLES")) == [("again",), ("t",)]
    (tmp_path / "in.jsonl").write_text('{"id": 9, "v": 1}\n{"id": 10}\n')
    assert engine.ingest_jsonl("t", f"{tmp_path}/in.jsonl") == 2
    engine.sql("DROP TABLE again")
    with pytest.raises(EngineError):
        engine.sql("DROP TABLE again")


def test_sequences():
    s = Sequence(start=10, step=5, most=30)
    assert [s.next(), s.next(2), s.next()] == [10, 15, 25]
    with pytest.raises(EngineError):
        s.next(2)
    assert Sequence(start=3, most=4, least=1, cycle=True, at=4).next() == 1
