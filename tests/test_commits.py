"""Commits that fail, several tables and writers, keys, policies, and what of SQL outlives the process."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine, EngineError
from palimpsest.operators import fold, fulltext
from palimpsest.operators.policies import Policy
from palimpsest.plans.literals import bind, filled, literal
from palimpsest.sources import store


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, tmp_path.as_uri())


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


class Down(Exception):
    pass


def test_a_failed_commit_leaves_nothing(engine, monkeypatch):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    engine.sql("INSERT INTO t VALUES (1, 1), (2, 2)")
    save = store.Store.save

    def fail(self, meta):
        raise Down()

    monkeypatch.setattr(store.Store, "save", fail)
    with pytest.raises(Down):
        engine.sql("INSERT INTO t VALUES (50, 50)")
    monkeypatch.setattr(store.Store, "save", save)
    assert rows(engine.sql("SELECT * FROM t")) == [(1, 1), (2, 2)]
    engine.sql("INSERT INTO t VALUES (3, 3)")
    assert rows(engine.sql("SELECT * FROM t")) == [(1, 1), (2, 2), (3, 3)]
    seqs = [r.seq for r in engine.table("t").log().collect()]
    assert sorted(seqs) == [1, 2, 3]
    problems, left = engine.doctor("t")
    assert problems.isEmpty() and len(left) == 2
    engine.doctor("t", repair=True)
    assert engine.doctor("t")[1] == [] and len(rows(engine.sql("SELECT * FROM t"))) == 3


def _two(engine):
    engine.sql("CREATE TABLE a (id BIGINT PRIMARY KEY)")
    engine.sql("CREATE TABLE b (id BIGINT PRIMARY KEY)")
    engine.script("BEGIN; INSERT INTO a VALUES (1); INSERT INTO b VALUES (1)")


def test_two_tables_commit_together_or_not_at_all(engine, monkeypatch):
    _two(engine)
    write = store.Files.write

    def fail(self, path, text):
        if "/pending/" in path:
            raise Down()
        write(self, path, text)

    monkeypatch.setattr(store.Files, "write", fail)
    with pytest.raises(Down):
        engine.sql("COMMIT")
    monkeypatch.setattr(store.Files, "write", write)
    assert rows(engine.sql("SELECT * FROM a")) == rows(engine.sql("SELECT * FROM b")) == []


def test_a_named_commit_is_finished_by_whoever_comes_next(spark, engine, monkeypatch):
    _two(engine)
    save = store.Store.save
    saved = []

    def fail(self, meta):
        if saved:
            raise Down()
        saved.append(self.path)
        save(self, meta)

    monkeypatch.setattr(store.Store, "save", fail)
    with pytest.raises(Down):
        engine.sql("COMMIT")
    monkeypatch.setattr(store.Store, "save", save)
    other = Engine(spark, engine.root)
    assert rows(other.sql("SELECT * FROM a")) == rows(other.sql("SELECT * FROM b")) == [(1,)]
    other.sql("INSERT INTO b VALUES (2)")
    assert rows(other.sql("SELECT * FROM a")) == [(1,)] and rows(other.sql("SELECT * FROM b")) == [(1,), (2,)]
    assert not [n for n in engine.files.names(f"{engine.root}/pending") if n.endswith(".json")]


def test_two_writers_cannot_insert_one_key(spark, engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    engine.sql("INSERT INTO t VALUES (1, 0), (2, 0)")
    other = Engine(spark, engine.root)
    engine.sql("BEGIN")
    engine.sql("INSERT INTO t VALUES (7, 1)")
    other.sql("INSERT INTO t VALUES (7, 2)")
    with pytest.raises(EngineError, match="serialize"):
        engine.sql("COMMIT")
    assert rows(engine.sql("SELECT * FROM t WHERE id = 7")) == [(7, 2)]
    # other rows of the table are no conflict, and what was read stays as it was
    engine.sql("BEGIN")
    engine.sql("UPDATE t SET v = v + 1 WHERE id = 1")
    other.sql("UPDATE t SET v = 9 WHERE id = 2")
    assert rows(engine.sql("SELECT * FROM t WHERE id <= 2")) == [(1, 1), (2, 0)]
    engine.sql("COMMIT")
    assert rows(engine.sql("SELECT * FROM t WHERE id <= 2")) == [(1, 1), (2, 9)]
    # a write skew: refused when serializable, seen at once when reading what is committed
    engine.sql("BEGIN ISOLATION LEVEL SERIALIZABLE")
    engine.sql("UPDATE t SET v = 5 WHERE id = 1")
    other.sql("UPDATE t SET v = 8 WHERE id = 2")
    with pytest.raises(EngineError, match="serialize"):
        engine.sql("COMMIT")
    engine.sql("BEGIN ISOLATION LEVEL READ COMMITTED")
    engine.sql("SELECT * FROM t")
    other.sql("UPDATE t SET v = 3 WHERE id = 2")
    assert rows(engine.sql("SELECT v FROM t WHERE id = 2")) == [(3,)]
    engine.sql("ROLLBACK")


def test_the_lock_of_a_dead_writer_is_taken_over(engine, monkeypatch):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    engine.files.create(f"{engine.root}/tables/t/lock")
    monkeypatch.setattr(store.Store, "STALE", 0.2)
    engine.sql("INSERT INTO t VALUES (1)")
    assert rows(engine.sql("SELECT * FROM t")) == [(1,)]


def test_composite_keys_and_unique(engine):
    engine.sql("CREATE TABLE p (a INT, b INT, m INT UNIQUE, x INT, y INT, PRIMARY KEY (a, b), UNIQUE (x, y))")
    engine.sql("INSERT INTO p VALUES (1, 1, 10, 1, 1), (1, 2, 20, 1, 2), (2, 1, 30, 2, 1)")
    for bad in ("(1, 1, 40, 9, 9)", "(3, 3, 10, 9, 9)", "(3, 3, 40, 1, 2)"):
        with pytest.raises(EngineError):
            engine.sql(f"INSERT INTO p VALUES {bad}")
    engine.sql("INSERT INTO p VALUES (3, 3, NULL, 1, NULL), (3, 4, NULL, 1, NULL)")
    engine.sql("UPDATE p SET a = 5 WHERE a = 1")
    assert [r[:3] for r in rows(engine.sql("SELECT * FROM p WHERE a = 5"))] == [(5, 1, 10), (5, 2, 20)]
    engine.sql("UPDATE p SET b = b + 1 WHERE a = 5")  # keys that move over each other
    assert [r[1] for r in rows(engine.sql("SELECT * FROM p WHERE a = 5"))] == [2, 3]
    with pytest.raises(EngineError, match="not unique"):
        engine.sql("UPDATE p SET m = 30 WHERE a = 5 AND b = 2")


def test_dropped_columns_stay_dropped(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT, w INT)")
    engine.sql("INSERT INTO t VALUES (1, 10, 100), (2, 20, 200)")
    engine.sql("ALTER TABLE t DROP COLUMN v")
    engine.sql("ALTER TABLE t ADD COLUMN v INT")
    assert rows(engine.sql("SELECT id, v, w FROM t")) == [(1, None, 100), (2, None, 200)]
    engine.sql("ALTER TABLE t RENAME COLUMN w TO z")
    engine.sql("UPDATE t SET v = 7 WHERE id = 1")
    engine.patch("t", engine.spark.createDataFrame([(2, 201)], "id long, z int"))
    assert rows(engine.sql("SELECT id, v, z FROM t")) == [(1, 7, 100), (2, None, 201)]
    engine.snapshot("t")
    engine.sql("ALTER TABLE t RENAME COLUMN z TO w")
    engine.sql("ALTER TABLE t ADD COLUMN z INT DEFAULT 4")
    assert rows(engine.sql("SELECT id, v, w, z FROM t")) == [(1, 7, 100, 4), (2, None, 201, 4)]
    engine.compact("t")
    assert rows(engine.sql("SELECT id, v, w, z FROM t")) == [(1, 7, 100, 4), (2, None, 201, 4)]


def test_exists_clauses_and_views_leave_nothing_behind(spark, engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    engine.sql("CREATE TABLE IF NOT EXISTS t (id BIGINT PRIMARY KEY)")
    engine.sql("DROP VIEW IF EXISTS nothing")
    before = len(spark.catalog.listTables())
    for _ in range(3):
        engine.sql("SELECT count(*) FROM t FOR SYSTEM_TIME AS OF @SEQ:1").collect()
    assert len(spark.catalog.listTables()) == before


def test_values_in_policies_and_statements_are_only_values(spark, engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, m TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 'ann'), (2, 'bob')")
    engine.policies.add(Policy("own", "t", "m = $user"))
    for user in ("nobody", "x\\' OR 1=1)) --", "' OR ''='", "$user", "\\"):
        engine.user = user
        assert rows(engine.sql("SELECT * FROM t")) == []
    engine.user = "ann"
    assert rows(engine.sql("SELECT * FROM t")) == [(1, "ann")]
    engine.policies = type(engine.policies)()
    nasty = ["x\\' OR 1=1)) --", "a'b", "$1", 'q"', "\\", "é\n"]
    got = spark.sql("SELECT " + ", ".join(map(literal, [*nasty, None, True, 1.5, -3, float("nan")]))).first()
    assert list(got)[:-1] == [*nasty, None, True, 1.5, -3] and got[-1] != got[-1]
    assert bind("SELECT '$1', $1, $2", ("$2", 3)).startswith("SELECT '$1', decode(")
    assert spark.sql(bind("SELECT '$1', $1, $2", ("$2", 3))).first()[1:] == ("$2", 3)
    with pytest.raises(ValueError):
        filled("$other", {})
    engine.sql("PREPARE q AS SELECT id FROM t WHERE m = $1")
    assert rows(engine.sql("EXECUTE q ('bob')")) == [(2,)] and rows(engine.sql(r"EXECUTE q ('x\' OR 1=1 --')")) == []


def test_bounds_of_now_and_mixed_ones(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    engine.sql("INSERT INTO t VALUES (1, 1)")
    engine.sql("UPDATE t SET v = 2")
    n = lambda clause: engine.sql(f"SELECT * FROM t FOR SYSTEM_TIME {clause}").count()
    assert n("BETWEEN '2000-01-01' AND CURRENT_TIMESTAMP") == n("BETWEEN '2000-01-01' AND '2999-01-01'") == 2
    assert n("FROM '2000-01-01' TO CURRENT_TIMESTAMP") == n("BETWEEN @SEQ:1 AND CURRENT_TIMESTAMP") == n("FROM @SEQ:1 TO CURRENT_TIMESTAMP") == 2
    assert n("BETWEEN CURRENT_TIMESTAMP AND CURRENT_TIMESTAMP") == 1
    with pytest.raises(EngineError):
        n("BETWEEN @SEQ:1 AND '2999-01-01'")


@pytest.mark.parametrize("low,high", [(0, 5), (3, 40), (17, 17), (30, 500), (0, 500)])
def test_pruned_versions_are_those_of_the_whole_log(spark, low, high):
    import random

    r = random.Random(low)
    events = []
    for seq in range(1, 121):
        op = r.choice(("INSERT", "PATCH", "PATCH", "SOFT_DELETE"))
        keys = r.choice((None, ["a"], ["b"])) if op == "PATCH" else None
        events.append((seq, seq, op, keys, r.randint(1, 6), r.choice((None, r.randint(0, 9))), r.randint(0, 9)))
    log = spark.createDataFrame(events, "seq long, ts long, op string, keys array<string>, k int, a int, b int")
    whole = fold.between(fold.versions(log, ["k"], ["a", "b"]), low, high)
    assert rows(fold.versions_between(log, ["k"], ["a", "b"], low, high)) == rows(whole)


def test_foreign_keys_over_levels(engine):
    engine.sql("CREATE TABLE a (x INT, y INT, PRIMARY KEY (x, y))")
    engine.sql("CREATE TABLE b (id INT PRIMARY KEY, x INT, y INT, FOREIGN KEY (x, y) REFERENCES a (x, y) ON DELETE CASCADE)")
    engine.sql("CREATE TABLE c (id INT PRIMARY KEY, b INT REFERENCES b (id) ON DELETE SET NULL)")
    engine.sql("CREATE TABLE d (id INT PRIMARY KEY, b INT REFERENCES b)")
    engine.sql("INSERT INTO a VALUES (1, 1), (1, 2)")
    engine.sql("INSERT INTO b VALUES (10, 1, 1), (11, 1, 2), (12, NULL, 2)")
    engine.sql("INSERT INTO c VALUES (100, 10), (101, 11)")
    engine.sql("INSERT INTO d VALUES (7, 11)")
    with pytest.raises(EngineError, match="no parent"):
        engine.sql("INSERT INTO b VALUES (13, 2, 2)")
    with pytest.raises(EngineError, match="still referred to by d"):
        engine.sql("DELETE FROM a WHERE y = 2")
    assert len(rows(engine.sql("SELECT * FROM a"))) == 2 and len(rows(engine.sql("SELECT * FROM b"))) == 3
    engine.sql("DELETE FROM a WHERE y = 1")
    assert rows(engine.sql("SELECT id FROM b")) == [(11,), (12,)]
    assert rows(engine.sql("SELECT * FROM c")) == [(100, None), (101, 11)]


def test_sequences_and_triggers_outlive_the_process(spark, engine):
    engine.sql("CREATE SEQUENCE s START WITH 5 INCREMENT BY 5 MAXVALUE 20 CYCLE")
    assert [engine.next_value("s")[0] for _ in range(5)] == [5, 10, 15, 20, 5]
    engine.sql("CREATE TABLE t (id SERIAL PRIMARY KEY, v INT)")
    engine.sql("CREATE TABLE trail (id BIGINT PRIMARY KEY, v INT)")
    engine.sql("CREATE TRIGGER note AFTER INSERT ON t WHEN (v > 1) DO INSERT INTO trail SELECT id, v FROM changed")
    engine.sql("CREATE TRIGGER guard BEFORE INSERT ON t WHEN (v < 0) DO RAISE 'no negative values'")
    engine.sql("CREATE TRIGGER twice BEFORE UPDATE ON t DO SELECT id, v * 2 AS v FROM changed")
    other = Engine(spark, engine.root)
    other.sql("INSERT INTO t (v) VALUES (1), (2), (3)")
    assert sorted(r.id for r in other.sql("SELECT id FROM t").collect()) == [1, 2, 3]
    assert sorted(r.v for r in other.sql("SELECT v FROM trail").collect()) == [2, 3]
    with pytest.raises(EngineError, match="no negative"):
        other.sql("INSERT INTO t (v) VALUES (-1)")
    other.sql("UPDATE t SET v = 10 WHERE v = 1")
    assert 20 in [r.v for r in other.sql("SELECT v FROM t").collect()]
    third = Engine(spark, engine.root)
    third.sql("DROP TRIGGER note")
    third.sql("INSERT INTO t (v) VALUES (9)")
    assert third.sql("SELECT max(id) FROM t").first()[0] >= 4 and third.sql("SELECT * FROM trail").count() == 2
    third.sql("ALTER SEQUENCE s RESTART WITH 15")
    assert third.next_value("s")[0] == 15


def test_explain_runs_history_and_reads_are_told(engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    engine.sql("INSERT INTO t VALUES (1), (2)")
    engine.sql("INSERT INTO t VALUES (3)")
    assert "Rows: 3" in engine.sql("EXPLAIN ANALYZE SELECT * FROM t").first()[0]
    made = json.loads(engine.sql("EXPLAIN (ANALYZE, FORMAT JSON) SELECT * FROM t").first()[0])
    assert made["rows"] == 3 and made["plan"][0]["class"]
    with pytest.raises(Exception):
        engine.sql("SELECT nothing FROM t")
    assert engine.history[-1]["error"] and len(engine.slow(0)) == len(engine.history)
    info = engine.read_info("t", 2)
    assert (info["as_of_sequence"], info["versions_scanned"]) == (2, 2)
    assert sorted(r["id"] for r in engine.rows("t")) == [1, 2, 3]


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple pie and red wine"), (2, "green apple tart"), (3, "red car far from any apple"), (4, None)], "id long, text string")
    path = f"{tmp_path.as_uri()}/index"
    fulltext.store(docs, "id", "text", path)
    index, plain = fulltext.stored(spark, path), fulltext.postings(docs, "id", "text")
    for i in (index, plain):
        assert sorted(r.doc for r in fulltext.boolean_search(i, docs.select(F.col("id").alias("doc")), ("not", ("term", "red"))).collect()) == [2, 4]
        assert sorted(r.doc for r in fulltext.boolean_search(i, docs.select(F.col("id").alias("doc")), ("and", ("term", "apple"), ("not", ("phrase", ["red", "apple"])))).collect()) == [2, 3]
        assert rows(fulltext.near_search(i, "red", "apple", 2)) == [(1, 1)] and rows(fulltext.near_search(i, "red", "red", 9)) == [(1, 3)]
        assert rows(fulltext.phrase_search(i, ["red", "apple"])) == [(1, 1)]
    scan = fulltext.text_search(index, 4, ["pie"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan or "bucket#" in scan
    fulltext.store(spark.createDataFrame([(9, "pie chart")], "id long, text string"), "id", "text", path, mode="append")
    assert sorted(r.doc for r in fulltext.text_search(fulltext.stored(spark, path), 5, ["pie"]).collect()) == [1, 9]


def test_late_rows_and_a_restart(spark, tmp_path):
    from datetime import datetime

    from palimpsest.streaming import state

    schema = spark.createDataFrame([], "ts timestamp, event_type string").schema
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    d = tmp_path.as_uri()
    batches = [frame((at(1, 5), "a"), (at(3, 0), "a")), frame((at(1, 50), "late"), (at(2, 55), "b"), (at(3, 10), "a"))]
    state.windowed_stream(spark, f"{d}/in", schema, f"{d}/out", f"{d}/check", batches)
    got = {(r.window_start.hour, r.event_type): r.n for r in spark.read.parquet(f"{d}/out").collect()}
    assert got == {(1, "a"): 1, (2, "b"): 1, (3, "a"): 2}


def test_migrations(spark, engine):
    from palimpsest.operators.migrations import MigrationError, Migrations

    def known(second="ALTER TABLE t ADD COLUMN v INT DEFAULT 3"):
        m = Migrations(engine)
        m.add(2, "value", [second], ["ALTER TABLE t DROP COLUMN v"])
        m.add(1, "table", ["CREATE TABLE t (id BIGINT PRIMARY KEY)", "INSERT INTO t VALUES (1)"], ["DROP TABLE t"])
        return m

    m = known()
    assert len(m.apply(dry_run=True)) == 3 and engine.tables() == []
    assert len(m.apply(to=1)) == 2 and [x.version for x in m.pending()] == [2]
    m.apply()
    assert rows(engine.sql("SELECT id, v FROM t")) == [(1, 3)] and m.apply() == []
    with pytest.raises(MigrationError, match="changed"):
        known("ALTER TABLE t ADD COLUMN v BIGINT").apply()
    late = known()
    late.add(0, "late", ["CREATE TABLE u (id BIGINT PRIMARY KEY)"])
    with pytest.raises(MigrationError, match="before"):
        late.apply()
    m.rollback(1)
    assert engine.table("t").schema.names == ["id"] and [d["version"] for d in m.applied()] == [1]
    m.rollback(0)
    assert engine.tables() == []


def test_procedures_of_sql(spark, engine):
    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY, v INT)")
    engine.sql("""CREATE PROCEDURE fill(IN n INT, OUT total INT) AS BEGIN
        DECLARE i INT DEFAULT 0;
        WHILE $i < $n DO
            IF $i % 2 = 0 THEN INSERT INTO t VALUES ($i, $i * 10);
            ELSEIF $i = 1 THEN INSERT INTO t VALUES ($i, -1);
            ELSE SET i = $i; END IF;
            SET i = $i + 1;
        END WHILE;
        SET total = (SELECT CAST(sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS INT) FROM t);
    END""")
    other = Engine(spark, engine.root)
    assert other.sql("CALL fill(4)").first().total == 20
    assert rows(other.sql("SELECT * FROM t")) == [(0, 0), (1, -1), (2, 20)]
    other.sql("CREATE PROCEDURE sign(IN x INT) AS BEGIN IF $x < 0 THEN RETURN 'minus; or so'; END IF; RETURN 'plus'; END")
    assert [other.call("sign", x) for x in (-1, 1)] == ["minus; or so", "plus"]
    with pytest.raises(EngineError):
        other.call("nothing")


def test_functions_cache_limits_and_filters(spark, engine):
    from palimpsest.operators import audit
    from palimpsest.operators.stats import Bloom

    engine.sql("CREATE TABLE t (id BIGINT PRIMARY KEY)")
    engine.sql("INSERT INTO t VALUES (1), (2)")
    engine.sql("CREATE FUNCTION twice(x BIGINT) RETURNS BIGINT RETURN x * 2")
    assert rows(engine.sql("SELECT twice(id) FROM t")) == [(2,), (4,)]
    first = engine.cached("SELECT count(*) AS n FROM t")
    assert first.first().n == 2 and engine.cached("SELECT count(*) AS n FROM t").inputFiles() == first.inputFiles()
    engine.sql("INSERT INTO t VALUES (3)")
    assert engine.cached("SELECT count(*) AS n FROM t").first().n == 3
    engine.cached("SELECT 1 AS one", most=1)
    assert len(engine.results) == 1 and len(engine.files.names(f"{engine.root}/results")) == 1
    assert audit.limited(spark, 30, lambda: spark.range(10).count()) == 10
    b = Bloom(spark.range(0, 1000, 2), "id", 1000).more(Bloom(spark.range(5000, 5010), "id", 1000))
    assert all(b.may_contain(k) for k in range(0, 1000, 2)) and b.may_contain(5003) and sum(b.may_contain(k) for k in range(1, 1000, 2)) < 50
