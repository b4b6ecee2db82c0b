"""Queries over past states, writes, search, views and policies. The table `events` serves as the log: event_id numbers
it, user_id is the key; signup inserts, error deletes, everything else patches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.text import BREAKS, LONGEST, SHORTEST, STOP_WORDS, SUFFIXES
from ..operators import fold, fulltext
from ..operators.builder import Query
from ..operators.migrations import Migrations
from ..operators.policies import Policy
from ..operators.recursive import fixed_point
from ..operators.stats import analyze
from ..sources.store import shared_dir, write_json
from ..streaming import state

KEY, VALUES = ["user_id"], ["value", "props"]
N = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str, partial: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", fold.INSERT).when(F.col("event_type") == "error", fold.DELETE).otherwise(fold.PATCH)
    value = F.when((F.col("event_type") == "purchase") & (F.col("value") < 20), None).otherwise(F.col("value")) if partial else F.col("value")
    out = e.select(F.col("event_id").alias("seq"), "ts", op.alias("op"), "user_id", value.alias("value"), "props")
    if partial:  # views supply the value alone, clicks the props alone
        keys = F.when(e.event_type == "view", F.array(F.lit("value"))).when(e.event_type == "click", F.array(F.lit("props")))
        out = e.select(F.col("event_id").alias("seq"), "ts", op.alias("op"), keys.alias("keys"), "user_id", value.alias("value"), "props")
    return out


_MADE: dict[tuple, str] = {}  # what queries share: by application, input and kind, the folder


def scratch(spark: SparkSession) -> Engine:
    """An engine in a folder of its own."""
    return Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}")


def once(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[str], None]) -> str:
    """A folder that is made the first time an application asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MADE:
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        make(path)
        _MADE[key] = path
    return _MADE[key]


def imported(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the event log, which is written once."""
    whole = log(spark, sf_dir).withColumn("keys", F.lit(None).cast("array<string>"))
    path = once(spark, sf_dir, "log", lambda to: whole.repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(to))
    e = scratch(spark)
    e.attach_log("users", path, KEY)
    return e


def _state(where: str, last: bool = False) -> str:
    return f"""
WITH e AS (SELECT * FROM events WHERE {where}),
r AS (SELECT user_id, max(event_id) AS s FROM e WHERE event_type IN ('signup', 'error') GROUP BY user_id),
live AS (SELECT r.user_id, r.s FROM r JOIN e ON e.event_id = r.s WHERE e.event_type = 'signup')
SELECT l.user_id, arg_max(e.value, e.event_id) AS value, arg_max(e.props, e.event_id) AS props{", max(e.event_id) AS last_seq" if last else ""}
FROM live l JOIN e ON e.user_id = l.user_id AND e.event_id >= l.s GROUP BY l.user_id"""


_VERSIONS = """
WITH x AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM events),
real AS (SELECT * FROM x WHERE o = 'signup' OR event_type = 'error'),
v AS (SELECT user_id, value, props, event_type, event_id AS start_seq, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS end_seq,
 ts AS system_time_start, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS system_time_end FROM real),
versions AS (SELECT user_id, value, props, start_seq, end_seq, system_time_start, system_time_end FROM v WHERE event_type <> 'error')
SELECT * FROM versions"""


def flagship(spark: SparkSession, sf_dir: str, seq: int = N) -> DataFrame:
    return fold.fold(fold.as_of(log(spark, sf_dir), seq=seq), KEY, VALUES, meta=True).drop("last_ts")


def _ts(spark, d):
    return fold.fold(fold.as_of(log(spark, d), ts=_TS), KEY, VALUES)


_TS = "2024-01-05 00:00:00"


def _snapshot(spark, d):
    e = log(spark, d)
    snap = fold.fold(fold.as_of(e, seq=N // 2), KEY, VALUES)
    return fold.fold_from(snap, N // 2, e, KEY, VALUES, seq=N)


def _compacted(spark, d):
    return fold.fold(fold.compact(log(spark, d), KEY, VALUES), KEY, VALUES)


def _retained(spark, d):
    return fold.fold(fold.as_of(fold.compact(log(spark, d), KEY, VALUES, retain_after=N // 2), seq=N), KEY, VALUES)


def _asof_join(spark, d):
    e = log(spark, d)
    a = fold.fold(fold.as_of(e, seq=N // 2), KEY, VALUES).select("user_id", F.col("value").alias("old_value"))
    b = fold.fold(fold.as_of(e, seq=N), KEY, VALUES).select("user_id", F.col("value").alias("new_value"))
    return a.join(b, "user_id", "full")


def _diff(spark, d):
    e = log(spark, d)
    a, b = (fold.fold(fold.as_of(e, seq=n), KEY, VALUES) for n in (N // 2, N))
    return fold.diff(a, b, KEY, VALUES)


def _partial(spark, d):
    return fold.fold(fold.as_of(log(spark, d, True), seq=N), KEY, VALUES)


_PARTIAL = f"""
WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' AND value < 20 THEN NULL ELSE value END AS v FROM events WHERE event_id <= {N}),
r AS (SELECT user_id, max(event_id) AS s FROM e WHERE event_type IN ('signup', 'error') GROUP BY user_id),
live AS (SELECT r.user_id, r.s FROM r JOIN e ON e.event_id = r.s WHERE e.event_type = 'signup'),
x AS (SELECT e.* FROM live l JOIN e ON e.user_id = l.user_id AND e.event_id >= l.s),
a AS (SELECT user_id, v AS value FROM x WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
b AS (SELECT user_id, props FROM x WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT user_id, value, props FROM a JOIN b USING (user_id)"""


def _sql(text):
    return lambda spark, d: imported(spark, d).sql(text)


def _customers(spark, d) -> Engine:
    e = scratch(spark)
    e.sql("CREATE TABLE cust (c_custkey BIGINT PRIMARY KEY, c_name TEXT NOT NULL, c_acctbal DOUBLE, c_mktsegment VARCHAR(20), CHECK (c_custkey >= 0))")
    e.insert("cust", table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    return e


def _update(spark, d):
    e = _customers(spark, d)
    e.sql("UPDATE cust SET c_acctbal = c_acctbal + 1000, c_mktsegment = 'VIP' WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
    return e.sql("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM cust")


def _delete(spark, d):
    e = _customers(spark, d)
    e.sql("DELETE FROM cust WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
    return e.sql("SELECT c_custkey, c_name FROM cust")


def _deleted_before(spark, d):
    e = _customers(spark, d)
    at = e.table("cust").last_seq()
    e.sql("TRUNCATE TABLE cust")
    return e.sql(f"SELECT c_custkey, c_acctbal FROM cust FOR SYSTEM_TIME AS OF @SEQ:{at} WHERE c_acctbal > 9000")


def _insert_select(spark, d):
    e = _customers(spark, d)
    e.sql("CREATE TABLE rich (id BIGINT PRIMARY KEY, name TEXT, note TEXT DEFAULT 'new')")
    e.sql("INSERT INTO rich (id, name) SELECT c_custkey, c_name FROM cust WHERE c_acctbal > 9000")
    return e.sql("SELECT id, name, note FROM rich")


def _pk_change(spark, d):
    e = _customers(spark, d)
    e.sql("UPDATE cust SET c_custkey = c_custkey + 1000000 WHERE c_custkey <= 10")
    return e.sql("SELECT c_custkey, c_name FROM cust")


def _txn(spark, d):
    e = _customers(spark, d)
    e.script("""
BEGIN;
UPDATE cust SET c_acctbal = 0 WHERE c_custkey <= 5;
SAVEPOINT a;
DELETE FROM cust WHERE c_custkey <= 3;
ROLLBACK TO SAVEPOINT a;
DELETE FROM cust WHERE c_custkey = 4;
COMMIT;
BEGIN;
DELETE FROM cust;
ROLLBACK""")
    return e.sql("SELECT c_custkey, c_acctbal FROM cust")


def _alter(spark, d):
    e = _customers(spark, d)
    e.sql("ALTER TABLE cust ADD COLUMN level INT DEFAULT 7")
    e.sql("ALTER TABLE cust RENAME COLUMN c_name TO label")
    e.sql("ALTER TABLE cust DROP COLUMN c_mktsegment")
    return e.sql("SELECT * FROM cust")


def _view(spark, d):
    e = _customers(spark, d)
    e.sql("CREATE VIEW good AS SELECT * FROM cust WHERE c_acctbal > 0")
    e.sql("CREATE VIEW segments AS SELECT c_mktsegment, count(*) AS n FROM good GROUP BY c_mktsegment")
    return e.sql("SELECT c_mktsegment, n FROM segments WHERE n > 2")


def _mview(spark, d):
    e = _customers(spark, d)
    e.sql("CREATE MATERIALIZED VIEW totals AS SELECT c_mktsegment, count(*) AS n FROM cust GROUP BY c_mktsegment")
    e.sql("DELETE FROM cust WHERE c_custkey <= 100")
    e.sql("REFRESH MATERIALIZED VIEW totals")
    return e.sql("SELECT * FROM totals")


def _rls(spark, d):
    e = _customers(spark, d)
    e.policies.add(Policy("own", "cust", "c_mktsegment = $segment"))
    e.policies.add(Policy("rich", "cust", "c_acctbal > 9500"))
    e.policies.add(Policy("not_first", "cust", "c_custkey > 10", permissive=False))
    e.policies.variables["segment"] = "BUILDING"
    return e.sql("SELECT c_custkey, c_mktsegment FROM cust")


def _prepared(spark, d):
    e = _customers(spark, d)
    e.sql("PREPARE q AS SELECT c_custkey FROM cust WHERE c_acctbal > $1 AND c_mktsegment = $2")
    return e.sql("EXECUTE q (5000, 'BUILDING')")


def _args(spark, d):
    return _customers(spark, d).sql("SELECT c_custkey FROM cust WHERE c_acctbal > :least", {"least": 5000})


def _snapshot_sql(spark, d):
    e = _customers(spark, d)
    e.sql("CHECKPOINT TABLE cust")
    e.sql("UPDATE cust SET c_name = 'x' WHERE c_custkey % 2 = 0")
    e.sql("VACUUM cust")
    return e.sql("SELECT c_custkey, c_name FROM cust")


def _analyze(spark, d):
    return analyze(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), exact=True)


_ANALYZE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus")
)


def _reach(spark, d):
    """Nations reached from nation 0 by steps of 3 and 7, modulo 25: UNION without ALL."""
    anchor = table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_nationkey").cast("long").alias("k"))
    return fixed_point(anchor, lambda new: new.select(((F.col("k") + 3) % 25).alias("k")).union(new.select(((F.col("k") + 7) % 25).alias("k"))))


_TERMS = f"""list_filter(regexp_split_to_array(lower(text), '{BREAKS}'), lambda t: strlen(t) BETWEEN {SHORTEST} AND {LONGEST} AND t NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))"""
_POSTINGS = f"""WITH d AS (SELECT doc_id AS doc, {_TERMS} AS ts FROM documents),
p AS (SELECT doc, unnest(ts) AS term, unnest(range(len(ts))) AS pos, len(ts) AS n_terms FROM d)"""
_STEM = "CASE " + " ".join(
    f"WHEN ends_with(term, '{s}') AND strlen(term) >= {n} THEN " + (f"regexp_replace(left(term, length(term) - {k}), '(" + "|".join(f"({c}{c})" for c in "abcdefghijklmnopqrstuvwxyz0123456789") + ")$', '') || CASE WHEN right(left(term, length(term) - " + f"{k}), 1) = left(right(left(term, length(term) - {k}), 2), 1) AND length(term) - {k} >= 2 AND regexp_matches(right(left(term, length(term) - {k}), 1), '[a-z0-9]') THEN right(left(term, length(term) - {k}), 1) ELSE '' END" if two else f"left(term, length(term) - {k})")
    for s, n, k, two in SUFFIXES
) + " ELSE term END"
_QUERY = ["onthe", "erst", "onst", "stupid", "erst"]


#: What is one edit, or none, away from "erst".
_EDITS = "|".join(["erst", *("erst"[:k] + "erst"[k + 1 :] for k in range(4)), *("erst"[:k] + "." + "erst"[k + 1 :] for k in range(4)), *("erst"[:k] + "." + "erst"[k:] for k in range(5))])


def _index(spark, d, stemmed=False):
    """The stored index, written the first time it is asked for."""
    docs = table(spark, d, "documents")
    return fulltext.stored(spark, once(spark, d, "stems" if stemmed else "terms", lambda to: fulltext.store(docs, "doc_id", "text", to, stemmed)))


def _fts_text(spark, d):
    docs = table(spark, d, "documents")
    return fulltext.text_search(_index(spark, d), docs.count(), _QUERY).select("doc", F.round("score", 9).alias("score"))


_FTS_TEXT = _POSTINGS + f""", tf AS (SELECT term, doc, count(*) / min(n_terms) AS tf FROM p WHERE term IN ({", ".join(f"'{t}'" for t in sorted(set(_QUERY)))}) GROUP BY term, doc),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc, round(sum(CASE WHEN tf.term = 'erst' THEN 2 ELSE 1 END * tf * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 9) AS score FROM tf JOIN df USING (term) GROUP BY doc"""


def _fts_phrase(spark, d):
    return fulltext.phrase_search(_index(spark, d), ["onthe", "erst"]).unionByName(fulltext.phrase_search(_index(spark, d), ["all", "rights", "reserved"]))


_FTS_PHRASE = _POSTINGS + """
SELECT a.doc, count(*) AS places FROM p a JOIN p b ON b.doc = a.doc AND b.pos = a.pos + 1 AND b.term = 'erst' WHERE a.term = 'onthe' GROUP BY a.doc
UNION ALL
SELECT a.doc, count(*) AS places FROM p a JOIN p b ON b.doc = a.doc AND b.pos = a.pos + 1 AND b.term = 'rights' JOIN p c ON c.doc = a.doc AND c.pos = a.pos + 2 AND c.term = 'reserved' WHERE a.term = 'all' GROUP BY a.doc"""


def _fts_boolean(spark, d):
    expr = ("and", ("or", ("term", "onst"), ("phrase", ["all", "rights"])), ("not", ("term", "erst")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    return fulltext.boolean_search(_index(spark, d), docs, expr)


_FTS_BOOLEAN = _POSTINGS + """
SELECT DISTINCT doc FROM (SELECT doc FROM p WHERE term = 'onst' UNION SELECT a.doc FROM p a JOIN p b ON b.doc = a.doc AND b.pos = a.pos + 1 AND b.term = 'rights' WHERE a.term = 'all') t
WHERE doc NOT IN (SELECT doc FROM p WHERE term = 'erst')"""


def _fts_page(spark, d):
    docs = table(spark, d, "documents")
    found = fulltext.text_search(_index(spark, d), docs.count(), _QUERY).withColumn("score", F.round("score", 9))
    return fulltext.page(found, limit=10, offset=5)


def _fts_stem(spark, d):
    return fulltext.document_frequency(_index(spark, d, True))


def _fts_fuzzy(spark, d):
    """Over all terms, in characters; the SQL spells out what one edit makes, as its own distance counts bytes."""
    return fulltext.fuzzy_search(_index(spark, d), "erst", 1)


def _stream_state(spark, d):
    """The state kept by a stream over the log, in one run over what is there."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = log(spark, d)
    e.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(f"{at}/log")
    q = state.maintain(state.read_log(spark, f"{at}/log", e.schema), KEY, VALUES, f"{at}/state", f"{at}/checkpoint")
    q.awaitTermination()
    return state.current(spark, f"{at}/state")


def _composite(spark, d):
    e = scratch(spark)
    e.sql("CREATE TABLE lines (l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, PRIMARY KEY (l_orderkey, l_linenumber))")
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("l_quantity"))
    e.insert("lines", one.select("l_orderkey", F.col("l_linenumber").cast("int"), "l_quantity"))
    e.sql("UPDATE lines SET l_quantity = l_quantity + 1 WHERE l_linenumber = 2")
    e.sql("DELETE FROM lines WHERE l_linenumber = 3")
    return e.sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lines")


def _drop_add(spark, d):
    e = _customers(spark, d)
    e.sql("ALTER TABLE cust RENAME COLUMN c_acctbal TO balance")
    e.sql("ALTER TABLE cust DROP COLUMN c_mktsegment")
    e.sql("ALTER TABLE cust ADD COLUMN c_mktsegment TEXT")
    e.sql("UPDATE cust SET c_mktsegment = 'new' WHERE balance > 0")
    return e.sql("SELECT c_custkey, balance, c_mktsegment FROM cust")


def _keyed_to(action):
    def run(spark, d):
        e = _customers(spark, d)
        e.sql(f"CREATE TABLE ord (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT REFERENCES cust (c_custkey) ON DELETE {action})")
        e.insert("ord", table(spark, d, "orders").select("o_orderkey", "o_custkey"))
        e.sql("DELETE FROM cust WHERE c_acctbal < 0")
        return e.sql("SELECT o_orderkey, o_custkey FROM ord")

    return run


def _serial(spark, d):
    e = scratch(spark)
    e.sql("CREATE TABLE s (id SERIAL PRIMARY KEY, name TEXT)")
    e.insert("s", table(spark, d, "nation").select(F.col("n_name").alias("name")))
    e.insert("s", table(spark, d, "region").select(F.col("r_name").alias("name")))
    return e.sql("SELECT min(id) AS low, max(id) AS high, count(DISTINCT id) AS n, count(*) AS all_rows FROM s")


def _trigger(spark, d):
    e = _customers(spark, d)
    e.sql("CREATE TABLE trail (c_custkey BIGINT PRIMARY KEY, was DOUBLE)")
    e.sql("CREATE TRIGGER note AFTER DELETE ON cust DO INSERT INTO trail SELECT c_custkey, c_acctbal FROM changed")
    e.sql("DELETE FROM cust WHERE c_acctbal < 0")
    return e.sql("SELECT c_custkey, was FROM trail")


def _on_change(spark, d):
    e = _customers(spark, d)
    e.create_view("totals", "SELECT c_mktsegment, count(*) AS n FROM cust GROUP BY c_mktsegment", True, "on_change")
    e.sql("DELETE FROM cust WHERE c_acctbal < 0")
    return e.sql("SELECT * FROM totals")


def _totals(policy: str):
    """A materialized view whose table loses rows after it was made; an interval of an hour is not over yet."""

    def made(spark, d):
        e = _customers(spark, d)
        e.create_view("totals", "SELECT c_mktsegment, count(*) AS n FROM cust GROUP BY c_mktsegment", True, policy, 3600)
        e.sql("DELETE FROM cust WHERE c_acctbal < 0")
        return e.sql("SELECT * FROM totals")

    return made


def _branch(spark, d):
    e = imported(spark, d)
    e.branch("users", "copy", N)
    e.sql("UPDATE copy SET value = value + 1 WHERE value > 50")
    return e.sql("SELECT c.user_id, c.value, u.value AS was FROM copy c JOIN users FOR SYSTEM_TIME AS OF @SEQ:" + str(N) + " u ON c.user_id = u.user_id")


def _builder_join(spark, d):
    e = _customers(spark, d)
    e.script("CREATE TABLE seg (c_mktsegment VARCHAR(20) PRIMARY KEY, code INT); INSERT INTO seg VALUES ('BUILDING', 1), ('MACHINERY', 2)")
    return Query(e, "cust").join("seg", ["c_mktsegment"], "left").where("c_acctbal > 0").select("c_custkey", "coalesce(code, 0) AS code").df()


def _builder_between(spark, d):
    q = Query(imported(spark, d), "users").between("@seq:400", "@seq:900")
    return q.where("value > 50").select("user_id", "value", "start_seq", "end_seq").df()


def _json_lines(spark, d):
    e = _customers(spark, d)
    path = f"{e.root}/customers.json"
    write_json(e.table("cust").df(), path)
    e.sql("CREATE TABLE again (c_custkey BIGINT PRIMARY KEY, c_name TEXT, c_acctbal DOUBLE, c_mktsegment VARCHAR(20))")
    e.ingest_jsonl("again", path)
    return e.sql("SELECT c_custkey, c_name, c_acctbal FROM again")


def _procedure(spark, d):
    e = _customers(spark, d)
    e.sql("""CREATE PROCEDURE raise_by(IN steps INT, IN least DOUBLE, OUT n BIGINT) AS BEGIN
        DECLARE i INT DEFAULT 0;
        WHILE $i < $steps DO
            IF $i % 2 = 0 THEN UPDATE cust SET c_acctbal = c_acctbal + 100 WHERE c_acctbal > $least;
            ELSE DELETE FROM cust WHERE c_acctbal < 0; END IF;
            SET i = $i + 1;
        END WHILE;
        SET n = (SELECT count(*) FROM cust);
    END""")
    e.sql("CALL raise_by(2, 9000)")
    return e.sql("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM cust")


def _migrated(spark, d):
    e = _customers(spark, d)
    m = Migrations(e)
    m.add(1, "level", ["ALTER TABLE cust ADD COLUMN level INT DEFAULT 1"], ["ALTER TABLE cust DROP COLUMN level"])
    m.add(2, "levels", ["UPDATE cust SET level = 2 WHERE c_acctbal > 5000"], ["UPDATE cust SET level = 1 WHERE c_acctbal > 5000"])
    m.add(3, "names", ["ALTER TABLE cust RENAME COLUMN c_name TO label"], ["ALTER TABLE cust RENAME COLUMN label TO c_name"])
    m.apply()
    m.rollback(2)
    return e.sql("SELECT c_custkey, c_name, level FROM cust")


def _view_join(spark, d):
    e = _customers(spark, d)
    e.sql("CREATE VIEW good AS SELECT c_custkey, c_mktsegment FROM cust WHERE c_acctbal > 0")
    return e.sql("SELECT c.c_name, g.c_mktsegment FROM cust c JOIN good g ON g.c_custkey = c.c_custkey")


def _late(spark, d):
    """Counts by the hour of a stream that gets the events in two batches, the earlier half last: with a watermark of 10
    minutes, what comes later than that is left out, so the second batch adds nothing but the hour where they meet."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("ts", "event_type")
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    schema = e.withColumn("ts", F.col("ts").cast("timestamp")).schema
    state.windowed_stream(spark, f"{at}/in", schema, f"{at}/out", f"{at}/checkpoint", [e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut)])
    return spark.read.parquet(f"{at}/out").groupBy("window_start", "event_type").agg(F.sum("n").alias("n")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_ALL_VERSIONS = _VERSIONS.replace("SELECT * FROM versions", "SELECT user_id, value, start_seq, end_seq FROM versions")

#: name: (query, the oracle's SQL or None).
QUERIES = {
    "asof_seq": (flagship, _state(f"event_id <= {N}", last=True)),
    "asof_ts": (_ts, _state(f"ts <= TIMESTAMP '{_TS}'")),
    "asof_before_first": (lambda s, d: fold.fold(fold.as_of(log(s, d), ts="1970-01-01"), KEY, VALUES), _state("false")),
    "current_state": (lambda s, d: fold.fold(log(s, d), KEY, VALUES), _state("true")),
    "pk_fetch_asof": (lambda s, d: fold.fold(fold.as_of(log(s, d).where("user_id = 2"), seq=N), KEY, VALUES), _state(f"event_id <= {N} AND user_id = 2")),
    "tail_read": (lambda s, d: log(s, d).where(f"seq > {N}"), f"SELECT event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'SOFT_DELETE' ELSE 'PATCH' END AS op, user_id, value, props FROM events WHERE event_id > {N}"),
    "history_key": (
        lambda s, d: fold.history(log(s, d), KEY, VALUES, user_id=2),
        "SELECT event_id AS sequence, ts AS timestamp, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'SOFT_DELETE' ELSE 'PATCH' END AS event_type, user_id, value, props FROM events WHERE user_id = 2",
    ),
    "history_all": (
        _sql("SELECT event_type, count(*) AS n FROM users FOR SYSTEM_TIME ALL GROUP BY event_type"),
        "SELECT CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'SOFT_DELETE' ELSE 'PATCH' END AS event_type, count(*) AS n FROM events GROUP BY 1",
    ),
    "versions_all": (lambda s, d: fold.versions(log(s, d), KEY, VALUES), _VERSIONS),
    "versions_between": (lambda s, d: fold.versions_between(log(s, d), KEY, VALUES, 400, 900), _VERSIONS + " WHERE start_seq <= 900 AND (end_seq IS NULL OR end_seq > 400)"),
    "versions_from_to": (lambda s, d: fold.versions_between(log(s, d), KEY, VALUES, 400, 899), _VERSIONS + " WHERE start_seq < 900 AND (end_seq IS NULL OR end_seq > 400)"),
    "versions_valid_at": (
        lambda s, d: fold.versions(log(s, d), KEY, VALUES).where(fold.valid_at(F.col("start_seq"), F.col("end_seq"), F.lit(700))).select("user_id", "value", "start_seq"),
        _VERSIONS.replace("SELECT * FROM versions", "SELECT user_id, value, start_seq FROM versions") + " WHERE start_seq <= 700 AND (end_seq IS NULL OR end_seq > 700)",
    ),
    "asof_join": (_asof_join, f"SELECT user_id, a.value AS old_value, b.value AS new_value FROM ({_state(f'event_id <= {N // 2}')}) a FULL JOIN ({_state(f'event_id <= {N}')}) b USING (user_id)"),
    "asof_diff": (
        _diff,
        f"SELECT CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change, user_id, b.value, b.props FROM ({_state(f'event_id <= {N // 2}')}) a FULL JOIN ({_state(f'event_id <= {N}')}) b USING (user_id) WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.value IS DISTINCT FROM b.value OR a.props IS DISTINCT FROM b.props",
    ),
    "partial_patches": (_partial, _PARTIAL),
    "snapshot_plus_tail": (_snapshot, _state(f"event_id <= {N}")),
    "compact_state": (_compacted, _state("true")),
    "compact_retain": (_retained, _state(f"event_id <= {N}")),
    "sql_asof": (_sql(f"SELECT user_id, value FROM users FOR SYSTEM_TIME AS OF @SEQ:{N} WHERE value > 50"), f"SELECT user_id, value FROM ({_state(f'event_id <= {N}')}) t WHERE value > 50"),
    "sql_asof_ts": (_sql(f"SELECT user_id, value FROM users FOR SYSTEM_TIME AS OF '{_TS}'"), f"SELECT user_id, value FROM ({_state(f"ts <= TIMESTAMP '{_TS}'")}) t"),
    "sql_asof_two_points": (
        _sql(f"SELECT a.user_id, a.value AS old_value, b.value AS new_value FROM users FOR SYSTEM_TIME AS OF @SEQ:{N // 2} a JOIN users FOR SYSTEM_TIME AS OF @SEQ:{N} b ON a.user_id = b.user_id"),
        f"SELECT a.user_id, a.value AS old_value, b.value AS new_value FROM ({_state(f'event_id <= {N // 2}')}) a JOIN ({_state(f'event_id <= {N}')}) b ON a.user_id = b.user_id",
    ),
    "sql_between": (_sql("SELECT user_id, value, start_seq, end_seq FROM users FOR SYSTEM_TIME BETWEEN @SEQ:400 AND @SEQ:900"), _VERSIONS.replace("SELECT * FROM versions", "SELECT user_id, value, start_seq, end_seq FROM versions") + " WHERE start_seq <= 900 AND (end_seq IS NULL OR end_seq > 400)"),
    "sql_from_to": (_sql("SELECT user_id, value, start_seq, end_seq FROM users FOR SYSTEM_TIME FROM @SEQ:400 TO @SEQ:900"), _VERSIONS.replace("SELECT * FROM versions", "SELECT user_id, value, start_seq, end_seq FROM versions") + " WHERE start_seq < 900 AND (end_seq IS NULL OR end_seq > 400)"),
    "sql_between_now": (_sql("SELECT user_id, value, start_seq, end_seq FROM users FOR SYSTEM_TIME BETWEEN '2000-01-01' AND CURRENT_TIMESTAMP"), _ALL_VERSIONS),
    "sql_from_to_now": (_sql("SELECT user_id, value, start_seq, end_seq FROM users FOR SYSTEM_TIME FROM @SEQ:700 TO CURRENT_TIMESTAMP"), _ALL_VERSIONS + " WHERE end_seq IS NULL OR end_seq > 700"),
    "sql_between_ts": (
        _sql(f"SELECT user_id, value, start_seq, end_seq FROM users FOR SYSTEM_TIME BETWEEN '2024-01-02' AND '{_TS}'"),
        _ALL_VERSIONS + f" WHERE system_time_start <= TIMESTAMP '{_TS}' AND (system_time_end IS NULL OR system_time_end > TIMESTAMP '2024-01-02')",
    ),
    "composite_key": (_composite, "SELECT l_orderkey, CAST(l_linenumber AS INT) AS l_linenumber, CAST(max(l_quantity) + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS DOUBLE) AS l_quantity FROM lineitem WHERE l_linenumber <> 3 GROUP BY l_orderkey, l_linenumber"),
    "alter_drop_add": (_drop_add, "SELECT c_custkey, c_acctbal AS balance, CASE WHEN c_acctbal > 0 THEN 'new' END AS c_mktsegment FROM customer"),
    "fk_cascade": (_keyed_to("CASCADE"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
    "fk_set_null": (_keyed_to("SET NULL"), "SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN o_custkey END AS o_custkey FROM orders"),
    "serial_key": (_serial, "SELECT CAST(1 AS BIGINT) AS low, n AS high, n, n AS all_rows FROM (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n) t"),
    "trigger_after": (_trigger, "SELECT c_custkey, c_acctbal AS was FROM customer WHERE c_acctbal < 0"),
    "mview_on_access": (_totals("on_access"), "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment"),
    "mview_interval": (_totals("interval"), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment"),
    "branch_state": (_branch, f"SELECT user_id, CASE WHEN value > 50 THEN value + 1 ELSE value END AS value, value AS was FROM ({_state(f'event_id <= {N}')}) t"),
    "builder_join": (_builder_join, "SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS INT) AS code FROM customer WHERE c_acctbal > 0"),
    "builder_between": (_builder_between, _ALL_VERSIONS + " WHERE start_seq <= 900 AND (end_seq IS NULL OR end_seq > 400) AND value > 50"),
    "json_lines": (_json_lines, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "procedure_effect": (_procedure, "SELECT c_custkey, round(CASE WHEN c_acctbal > 9000 THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS c_acctbal FROM customer WHERE c_acctbal >= 0"),
    "migrations_effect": (_migrated, "SELECT c_custkey, c_name, CAST(CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS INT) AS level FROM customer"),
    "mview_on_change": (_on_change, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment"),
    "view_join": (_view_join, "SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 0"),
    "stream_late_rows": (_late, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2"),
    "stream_state": (_stream_state, _state("true")),
    "stream_windows": (lambda s, d: state.windowed_counts(table(s, d, "events")), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_sessions": (
        lambda s, d: state.sessions(table(s, d, "events"), "6 hours"),
        "WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), c AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM c GROUP BY user_id, g",
    ),
    "dml_update_effect": (_update, "SELECT c_custkey, c_name, round(CASE WHEN c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_acctbal + 1000 ELSE c_acctbal END, 2) AS c_acctbal, CASE WHEN c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_delete_effect": (_delete, "SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')"),
    "dml_truncate_asof": (_deleted_before, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000"),
    "dml_insert_select": (_insert_select, "SELECT c_custkey AS id, c_name AS name, 'new' AS note FROM customer WHERE c_acctbal > 9000"),
    "dml_pk_change": (_pk_change, "SELECT CASE WHEN c_custkey <= 10 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name FROM customer"),
    "txn_savepoints": (_txn, "SELECT c_custkey, CASE WHEN c_custkey <= 5 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey <> 4"),
    "alter_columns": (_alter, "SELECT c_custkey, c_name AS label, c_acctbal, 7 AS level FROM customer"),
    "view_of_view": (_view, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment HAVING count(*) > 2"),
    "mview_refresh": (_mview, "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey > 100 GROUP BY c_mktsegment"),
    "rls_filter": (_rls, "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9500) AND c_custkey > 10"),
    "prepared_statement": (_prepared, "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"),
    "parameters": (_args, "SELECT c_custkey FROM customer WHERE c_acctbal > 5000"),
    "snapshot_vacuum": (_snapshot_sql, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE c_name END AS c_name FROM customer"),
    "analyze_stats": (_analyze, _ANALYZE),
    "cte_recursive_distinct": (_reach, "WITH RECURSIVE t(k) AS (SELECT CAST(0 AS BIGINT) UNION (SELECT (k + 3) % 25 FROM t UNION SELECT (k + 7) % 25 FROM t)) SELECT k FROM t"),
    "fts_text_tfidf": (_fts_text, _FTS_TEXT),
    "fts_phrase": (_fts_phrase, _FTS_PHRASE),
    "fts_boolean": (_fts_boolean, _FTS_BOOLEAN),
    "fts_page": (_fts_page, f"SELECT * FROM ({_FTS_TEXT}) t ORDER BY score DESC, doc LIMIT 10 OFFSET 5"),
    "fts_stem": (_fts_stem, _POSTINGS + f" SELECT {_STEM} AS term, count(DISTINCT doc) AS df FROM p GROUP BY 1"),
    "fts_fuzzy": (_fts_fuzzy, _POSTINGS + f" SELECT DISTINCT doc, term, CASE WHEN term = 'erst' THEN 0 ELSE 1 END AS distance FROM p WHERE regexp_full_match(term, '{_EDITS}')"),
    "fts_near": (lambda s, d: fulltext.near_search(_index(s, d), "erst", "onst", 20), _POSTINGS + " SELECT a.doc, min(abs(a.pos - b.pos)) AS nearest FROM p a JOIN p b ON a.doc = b.doc AND a.term = 'erst' AND b.term = 'onst' GROUP BY a.doc HAVING min(abs(a.pos - b.pos)) <= 20"),
}
