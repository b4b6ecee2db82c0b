"""The engine: event-sourced tables, SQL over any of their past states, transactions, constraints, triggers, views.

Reads are lazy DataFrames that Catalyst plans; writes turn into event DataFrames that one job appends. Only counts,
names and small metadata ever reach the driver.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .operators import fold as folds
from .operators.policies import Policies
from .operators.snapshots import SnapshotPolicy
from .operators.stats import analyze, explain
from .plans.literals import bind
from .plans.temporal_sql import Clause, point, rewrite, statements
from .sources.store import Files, Store, commit_all, read_jsonl


class EngineError(Exception):
    """A statement that cannot be carried out; in a transaction it aborts that."""


@dataclass
class Trigger:
    """timing BEFORE, AFTER or INSTEAD OF; event INSERT, UPDATE, DELETE or TRUNCATE. `action` gets the changed rows: BEFORE it
    may return other rows, raise to abort, or return None to leave them; `when` is a SQL condition on the rows."""

    name: str
    table: str
    timing: str
    event: str
    action: Callable[[DataFrame], DataFrame | None]
    when: str | None = None
    statement: str | None = None  # of a trigger made by SQL


#: Statements whose times are kept.
HISTORY = 1000
LEVELS = ("READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE")


@dataclass
class Txn:
    """level: READ COMMITTED sees what others commit meanwhile; the others see tables as they were when first used. A
    commit is refused if another writer has changed the same keys since, at SERIALIZABLE if one has changed any table
    that was read."""

    level: str = "REPEATABLE READ"
    staged: list[tuple[str, tuple]] = field(default_factory=list)  # (table, what was staged), in order
    marks: list[tuple[str, int]] = field(default_factory=list)  # savepoints: name, how much was staged
    base: dict[str, int] = field(default_factory=dict)  # next number of each table when it was first used
    aborted: bool = False


@dataclass
class Sequence:
    """A counter for keys; whole batches are taken at once."""

    start: int = 1
    step: int = 1
    least: int | None = None
    most: int | None = None
    cycle: bool = False
    at: int | None = None

    def next(self, n: int = 1) -> int:
        """The first of n values."""
        value = self.start if self.at is None else self.at + self.step
        last = value + (n - 1) * self.step
        if (self.most is not None and last > self.most) or (self.least is not None and last < self.least):
            if not self.cycle:
                raise EngineError("the sequence is used up")
            value = (self.least if self.least is not None else self.start) if self.step > 0 else (self.most if self.most is not None else self.start)
            last = value + (n - 1) * self.step
        self.at = last
        return value


class Table:
    """A handle on one table, at one point in time."""

    def __init__(self, engine: Engine, name: str, clause: Clause | None = None):
        self.engine, self.name, self.clause = engine, name, clause or Clause("as_of")
        self.store = engine.store(name)
        meta = self.store.meta
        self.key: list[str] = meta["key"]
        self.schema = StructType.fromJson(meta["schema"])
        self.values = [f.name for f in self.schema if f.name not in self.key]

    def as_of(self, seq: int | None = None, ts: str | None = None) -> Table:
        return Table(self.engine, self.name, Clause("as_of", seq if seq is not None else (None if ts is None else point(ts))))

    def log(self) -> DataFrame:
        """Committed events and those of the open transaction."""
        log, txn = self.store.log(), self.engine.txn
        if not txn:
            return log
        at = self.store.meta["next"]
        base = txn.base.setdefault(self.name, at)
        if txn.level != "READ COMMITTED" and base < at:
            log, at = log.where(F.col("seq") < F.lit(base)), base
        for name, staged in txn.staged:
            if name == self.name and staged[1]:
                events, at = self.store.staged(staged, at)
                log = log.unionByName(self.store._logical(events, self.store.meta), allowMissingColumns=True)
        return log.select("seq", "ts", "op", "keys", *[f"`{f.name}`" for f in self.schema])

    def df(self) -> DataFrame:
        """The rows at this handle's point in time; snapshots spare the older part of the log."""
        at = self.clause.low
        columns = [f"`{f.name}`" for f in self.schema]
        if isinstance(at, str):
            return folds.fold(folds.as_of(self.log(), ts=at), self.key, self.values).select(columns)
        txn = self.engine.txn
        last = txn.base.get(self.name, self.store.meta["next"]) - 1 if txn else None
        near = [s for s in self.store.snapshots() if (at is None or s <= at) and (last is None or s <= last)]
        if near:
            state = folds.fold_from(self.store.read_snapshot(near[-1]), near[-1], self.log(), self.key, self.values, at)
        else:
            state = folds.fold(folds.as_of(self.log(), seq=at), self.key, self.values)
        return state.select(columns)

    def get(self, *key: Any) -> DataFrame:
        return self.df().where(reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.lit(v) for k, v in zip(self.key, key))))

    def history(self, **equal: Any) -> DataFrame:
        return folds.history(self.log(), self.key, self.values, **equal)

    def versions(self) -> DataFrame:
        return folds.versions(self.log(), self.key, self.values)

    def between(self, low: int | str | None, high: int | str | None, inclusive: bool = True) -> DataFrame:
        """Versions valid at some time from low to high, both sequence numbers or both timestamps; None is now."""
        kinds = {type(x) for x in (low, high) if x is not None}
        if len(kinds) > 1:
            raise EngineError("both bounds must be sequence numbers, or both timestamps")
        if str in kinds:
            kind, start, end = "timestamp_ntz", "system_time_start", "system_time_end"
            now = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            lo, hi = (now if x is None else F.lit(x).cast(kind) for x in (low, high))
            begun = F.col(start) <= hi if inclusive else F.col(start) < hi
            return self.versions().where(begun & (F.col(end).isNull() | (F.col(end) > lo)))
        last = self.last_seq()
        # Before now is all that has been written, whether the bound itself counts or not.
        if high is None:
            high, inclusive = last, True
        return folds.versions_between(self.log(), self.key, self.values, last if low is None else low, high if inclusive else high - 1)

    def diff(self, low: int, high: int | None = None) -> DataFrame:
        return folds.diff(self.as_of(low).df(), self.as_of(high).df(), self.key, self.values)

    def last_seq(self) -> int:
        return self.store.meta["next"] - 1


class Engine:
    """Tables live in folders under `root`; views, triggers, policies and procedures in the engine."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)
        self.txn: Txn | None = None
        self.triggers: list[Trigger] = []
        self.changed: DataFrame | None = None  # rows that fired the trigger whose statement runs
        self.history: list[dict] = []  # statements, newest last
        self.results: dict[tuple, tuple[float, str]] = {}  # of `cached`, the one used last at the end
        self.procedures: dict[str, Callable | str] = {}
        self.prepared: dict[str, str] = {}
        self.views: dict[str, dict] = {}
        self.policies = Policies()
        self.user: str | None = None
        self._tag = uuid.uuid4().hex[:8]
        self._made = 0
        if self.files.exists(f"{self.root}/views.json"):
            self.views = json.loads(self.files.read(f"{self.root}/views.json"))
        if self.files.exists(f"{self.root}/triggers.json"):
            self.triggers = [self._stored_trigger(**x) for x in json.loads(self.files.read(f"{self.root}/triggers.json"))]

    # sequences: one file each, read and written under its lock, so that they outlive the process

    def create_sequence(self, name: str, missing_ok: bool = False, **options: Any) -> None:
        at = f"{self.root}/sequences/{name}.json"
        if self.files.exists(at):
            if missing_ok:
                return
            raise EngineError(f"sequence exists: {name}")
        self.files.write(at, json.dumps(vars(Sequence(**options))))

    def drop_sequence(self, name: str) -> None:
        self.files.delete(f"{self.root}/sequences/{name}.json")

    def next_value(self, name: str, n: int = 1) -> tuple[int, int]:
        """The first of n values taken, and the step between them."""
        return self._sequence(name, lambda s: (s.next(n), s.step))

    def set_value(self, name: str, value: int | None) -> None:
        """The next value follows this one; None starts again."""
        self._sequence(name, lambda s: setattr(s, "at", value))

    def restart(self, name: str, value: str | int | None = None) -> None:
        """The next value is this one, or the first."""

        def use(s: Sequence) -> None:
            s.start, s.at = s.start if value is None else int(value), None

        self._sequence(name, use)

    def current_value(self, name: str) -> int | None:
        return self._sequence(name, lambda s: s.at)

    def _sequence(self, name: str, use: Callable[[Sequence], Any]) -> Any:
        at = f"{self.root}/sequences/{name}.json"
        if not self.files.exists(at):
            raise EngineError(f"no sequence {name}")
        with Store(self.spark, f"{self.root}/sequences/{name}").locked():
            s = Sequence(**json.loads(self.files.read(at)))
            out = use(s)
            self.files.write(at, json.dumps(vars(s)))
        return out

    def _numbered(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the sequence's next values, one a row: a count for each partition comes to the driver."""
        marked = df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        counts = sorted((r["__part"], r["count"]) for r in marked.groupBy("__part").count().collect())
        if not counts:
            return df.withColumn(column, F.lit(None).cast("long"))
        at, step = self.next_value(name, sum(n for _, n in counts))
        rows = []
        for part, n in counts:
            rows.append((part, at))
            at += n * step
        place = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
        made = marked.join(F.broadcast(self.spark.createDataFrame(rows, "__part int, __start long")), "__part")
        return made.withColumn(column, F.col("__start") + place * step).drop("__part", "__at", "__start")

    # triggers of SQL

    def create_trigger(self, name: str, table: str, timing: str, event: str, statement: str, when: str | None = None) -> None:
        """A trigger that outlives the process. Its statement sees the rows as the table `changed`: a SELECT before an event
        gives the rows to go on with, RAISE 'message' refuses rows, anything else is carried out."""
        self.table(table)
        if any(t.name == name for t in self.triggers):
            raise EngineError(f"trigger exists: {name}")
        self.triggers.append(self._stored_trigger(name, table, timing, event, statement, when))
        self._save_triggers()

    def drop_trigger(self, name: str, missing_ok: bool = False) -> None:
        if not missing_ok and not any(t.name == name for t in self.triggers):
            raise EngineError(f"no trigger {name}")
        self.triggers = [t for t in self.triggers if t.name != name]
        self._save_triggers()

    def _save_triggers(self) -> None:
        kept = [{"name": t.name, "table": t.table, "timing": t.timing, "event": t.event, "statement": t.statement, "when": t.when} for t in self.triggers if t.statement]
        self.files.write(f"{self.root}/triggers.json", json.dumps(kept))

    def _stored_trigger(self, name: str, table: str, timing: str, event: str, statement: str, when: str | None) -> Trigger:
        def action(rows: DataFrame) -> DataFrame | None:
            if m := re.fullmatch(r"RAISE\s+'(.*)'", statement, re.I | re.S):
                if not rows.isEmpty():
                    raise EngineError(m[1])
                return None
            before, self.changed = self.changed, rows
            try:
                out = self.sql(statement)
            finally:
                self.changed = before
            return out if re.match(r"\s*(SELECT|WITH)\b", statement, re.I) else None

        return Trigger(name, table, timing, event, action, when, statement)

    # tables

    def store(self, name: str) -> Store:
        return Store(self.spark, f"{self.root}/tables/{name}", f"{self.root}/pending")

    def tables(self) -> list[str]:
        return self.files.names(f"{self.root}/tables")

    def table(self, name: str) -> Table:
        if not self.store(name).exists():
            raise EngineError(f"no table {name}")
        return Table(self, name)

    def create_table(self, name: str, columns: str | StructType, key: list[str] | str | None = None, **constraints: Any) -> Table:
        """columns: DDL text or a schema. Without a key the first column is it. Constraints: not_null, unique (lists of
        columns), checks (SQL conditions), defaults (column: SQL expression), foreign (column: (table, column)),
        indexes (metadata alone: statistics, sorting and pruning do the work)."""
        schema = columns if isinstance(columns, StructType) else StructType.fromDDL(columns)
        if not len(schema):
            schema = StructType([StructField("id", LongType())])
        key = [key] if isinstance(key, str) else key or [schema[0].name]
        self.store(name).create(schema, key, **constraints)
        return self.table(name)

    def import_log(self, name: str, events: DataFrame, key: list[str]) -> Table:
        """A table from an existing log (seq, ts, op, optionally keys, key and value columns), with its numbers."""
        fields = [f for f in events.schema if f.name not in ("seq", "ts", "op", "keys")]
        t = self.create_table(name, StructType(fields), key)
        if "keys" not in events.columns:
            events = events.withColumn("keys", F.lit(None).cast("array<string>"))
        to = f"log/{uuid.uuid4().hex}"
        events.repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(f"{t.store.path}/{to}")
        last = self.spark.read.parquet(f"{t.store.path}/{to}").agg(F.max("seq")).first()[0]
        t.store.save(t.store.meta | {"next": (last or 0) + 1, "log": [to]})
        return t

    def attach_log(self, name: str, path: str, key: list[str]) -> Table:
        """A table over a log that is there already, with its numbers (files of seq, ts, op, keys, key and value columns,
        under an absolute path); nothing is copied, and the files are left alone when the table goes."""
        log = self.spark.read.parquet(path)
        t = self.create_table(name, StructType([f for f in log.schema if f.name not in ("seq", "ts", "op", "keys")]), key)
        last = log.agg(F.max("seq")).first()[0]
        t.store.save(t.store.meta | {"next": (last or 0) + 1, "log": [path]})
        return t

    def branch(self, name: str, to: str, seq: int | None = None) -> Table:
        """A new table with the history of another up to seq (None: all that is committed) and its constraints; the two go
        on apart. Serial columns draw from the same sequence, so their values stay distinct."""
        t = self.table(name)
        last = t.last_seq() if seq is None else min(max(seq, 0), t.last_seq())
        made = self.import_log(to, t.store.log().where(F.col("seq") <= F.lit(last)), t.key)
        own = made.store.meta
        made.store.save({k: v for k, v in t.store.meta.items() if k not in own} | own | {"next": last + 1})
        return made

    def drop_table(self, name: str, missing_ok: bool = False) -> None:
        if not self.store(name).exists():
            if missing_ok:
                return
            raise EngineError(f"no table {name}")
        self.store(name).drop()

    # writes

    def insert(self, name: str, rows: DataFrame | list) -> int:
        t = self.table(name)
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, t.schema)
        meta = t.store.meta
        for f in t.schema:
            if f.name not in df.columns:
                default = meta.get("defaults", {}).get(f.name)
                if m := re.fullmatch(r"nextval\s*\(\s*'(\w+)'\s*\)", default or "", re.I):
                    df = self._numbered(df, f.name, m[1])
                    continue
                df = df.withColumn(f.name, (F.expr(default) if default else F.lit(None)).cast(f.dataType))
        unknown = [c for c in df.columns if c not in t.schema.names]
        if unknown:
            raise EngineError(f"no columns {unknown} in {name}")
        df = df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in t.schema])
        return self._apply(t, "INSERT", df, None)

    def update(self, name: str, sets: dict[str, str], where: str | None = None) -> int:
        """sets: column to SQL expression over the old row."""
        t = self.table(name)
        old = self._visible(t).where(where) if where else self._visible(t)
        new = old.select([(F.expr(sets[f.name]) if f.name in sets else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in t.schema])
        return self._apply(t, "UPDATE", new, old if any(k in sets for k in t.key) else None)

    def patch(self, name: str, rows: DataFrame) -> int:
        """Partial events: key columns and some others; only what is supplied changes, and only on live rows."""
        t = self.table(name)
        supplied = [c for c in rows.columns if c not in t.key]
        events = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in t.schema if f.name in rows.columns])
        return self._stage(t, events.withColumn("op", F.lit(folds.PATCH)).withColumn("keys", F.array(*map(F.lit, supplied)).cast("array<string>")))

    def delete(self, name: str, where: str | None = None) -> int:
        t = self.table(name)
        old = self._visible(t).where(where) if where else self._visible(t)
        return self._apply(t, "DELETE", old, None)

    def truncate(self, name: str) -> int:
        t = self.table(name)
        return self._apply(t, "TRUNCATE", self._visible(t), None)

    def _visible(self, t: Table) -> DataFrame:
        return self.policies.filtered(t.df(), t.name, self.user, "write")

    def _fire(self, t: Table, timing: str, event: str, rows: DataFrame) -> DataFrame | None:
        for g in self.triggers:
            if (g.table, g.timing, g.event) == (t.name, timing, event):
                some = rows.where(g.when) if g.when else rows
                new = g.action(some)
                if timing == "INSTEAD OF":
                    return None
                if timing == "BEFORE" and new is not None:
                    rows = new if not g.when else new.unionByName(rows.where(~F.coalesce(F.expr(g.when), F.lit(False))))
        return rows

    def _apply(self, t: Table, event: str, rows: DataFrame, gone: DataFrame | None) -> int:
        if any((g.table, g.timing, g.event) == (t.name, "INSTEAD OF", event) for g in self.triggers):
            self._fire(t, "INSTEAD OF", event, rows)
            return 0
        rows = self._fire(t, "BEFORE", event, rows)
        with ExitStack() as held:
            if not self.txn:  # nobody else may write between the check and the commit
                held.enter_context(t.store.locked())
            work = self._work(t, event, rows, gone)
            staged = [(table, table.store.stage(self._stamped(events))) for table, events in work]
            n = sum(n for _, n in staged[-1][1][1])
            if self.txn:
                for table, s in staged:
                    self.txn.base.setdefault(table.name, table.store.meta["next"])
                    self.txn.staged.append((table.name, s))
            else:
                self._commit(staged, held=t.name)
        self._fire(t, "AFTER", event, rows)
        return n

    def _work(self, t: Table, event: str, rows: DataFrame, gone: DataFrame | None) -> list[tuple[Table, DataFrame]]:
        """Events by table, in order, of a checked statement; those of the table itself come last."""
        key, bad, work = [f"`{k}`" for k in t.key], [], []
        if event in ("INSERT", "UPDATE"):
            bad += self._violations(t, rows, event, gone)
        if event != "INSERT" and (event != "UPDATE" or gone is not None):
            found, work = self._referring(t, gone if gone is not None else rows, rows if gone is not None else None)
            bad += found
        self._refuse(bad)
        if event == "INSERT":
            work.append((t, rows.withColumn("op", F.lit(folds.INSERT))))
        elif event == "UPDATE":
            if gone is not None:  # the old keys go before the new ones come
                work.append((t, gone.select(*key).withColumn("op", F.lit(folds.DELETE))))
            work.append((t, rows.withColumn("op", F.lit(folds.INSERT if gone is not None else folds.PATCH))))
        else:
            work.append((t, rows.select(*key).withColumn("op", F.lit(folds.DELETE))))
        return work

    def _stamped(self, events: DataFrame) -> DataFrame:
        if "keys" not in events.columns:
            events = events.withColumn("keys", F.lit(None).cast("array<string>"))
        return events.withColumn("ts", F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")))

    def _stage(self, t: Table, events: DataFrame) -> int:
        staged = t.store.stage(self._stamped(events))
        if self.txn:
            self.txn.base.setdefault(t.name, t.store.meta["next"])
            self.txn.staged.append((t.name, staged))
        else:
            self._commit([(t, staged)])
        return sum(n for _, n in staged[1])

    def _commit(self, staged: list[tuple[Table, tuple]], held: str | None = None, check: Callable | None = None) -> None:
        """Commits to all tables at once; `held` is one whose lock is held already."""
        by: dict[str, list] = {}
        for table, s in staged:
            by.setdefault(table.name, []).append(s)
        commit_all(self.files, f"{self.root}/pending", [(self.store(n), s) for n, s in by.items()], check, held and self.store(held).path)
        for name in by:
            self._refresh_changed(name)

    def _refuse(self, bad: list[tuple[DataFrame, str]]) -> None:
        """All violations are looked for in one job, before anything is written, so a statement is all or nothing."""
        if not bad:
            return
        found = [df.select(F.lit(k).alias("k"), F.to_json(F.struct("*")).alias("row")).limit(1) for k, (df, _) in enumerate(bad)]
        row = reduce(DataFrame.union, found).orderBy("k").limit(1).collect()
        if row:
            raise EngineError(f"{bad[row[0].k][1]}: {row[0].row}")

    def _violations(self, t: Table, rows: DataFrame, event: str, gone: DataFrame | None) -> list[tuple[DataFrame, str]]:
        meta, bad = t.store.meta, []
        key = [f"`{k}`" for k in t.key]
        bad.append((rows.where(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in key))), "null in the primary key"))
        state = t.df()
        old = gone if gone is not None else rows if event == "UPDATE" else None
        others = state if old is None else state.join(old.select(*key), t.key, "left_anti")
        if event == "INSERT" or gone is not None:
            bad.append((rows.groupBy(*key).count().where("count > 1"), "primary key repeated"))
            bad.append((rows.select(*key).join(others.select(*key), t.key, "left_semi"), "primary key exists"))
        for c in meta.get("not_null", ()):
            bad.append((rows.where(F.col(f"`{c}`").isNull()), f"null in {c}"))
        for cond in meta.get("checks", ()):
            bad.append((rows.where(~F.expr(cond)), f"check failed: {cond}"))
        for u in meta.get("unique", ()):
            u = [u] if isinstance(u, str) else u
            own = rows.select(*[f"`{c}`" for c in u]).dropna()
            bad.append((own.groupBy(*[f"`{c}`" for c in u]).count().where("count > 1"), f"{', '.join(u)} not unique"))
            bad.append((own.join(others.select(*[f"`{c}`" for c in u]), u, "left_semi"), f"{', '.join(u)} not unique"))
        for columns, parent, there, _ in _foreign(meta):
            known = self.table(parent).df().select(*[F.col(f"`{p}`").alias(c) for c, p in zip(columns, there)])
            if parent == t.name:  # a row may point to one that comes with it
                known = known.unionByName(rows.select(*[F.col(f"`{p}`").alias(c) for c, p in zip(columns, there)]))
            bad.append((rows.select(*[f"`{c}`" for c in columns]).dropna().join(known, columns, "left_anti"), f"{', '.join(columns)} has no parent in {parent}"))
        refused = self.policies.refused(rows, t.name, self.user)
        return bad if refused is None else [*bad, (refused, "refused by policy")]

    def _referring(self, t: Table, rows: DataFrame, new: DataFrame | None, seen: tuple = ()) -> tuple[list, list]:
        """What rows that go (new: come back under other keys) mean for those that point to them: what is refused, and
        events by table: SET NULL patches them, CASCADE deletes them and what points to those."""
        bad, work = [], []
        for name in self.tables():
            child = self.table(name) if name != t.name else t
            for columns, parent, there, action in _foreign(child.store.meta):
                if parent != t.name:
                    continue
                lost = rows.select(*[F.col(f"`{p}`").alias(c) for c, p in zip(columns, there)]).dropna().distinct()
                if new is not None:
                    lost = lost.join(new.select(*[F.col(f"`{p}`").alias(c) for c, p in zip(columns, there)]), columns, "left_anti")
                own = child.df()
                if name == t.name:
                    own = own.join(rows.select(*[f"`{k}`" for k in t.key]), t.key, "left_anti")
                hit = own.join(lost, columns, "left_semi").select(*[f"`{f.name}`" for f in child.schema])
                if action == "CASCADE":
                    if name in seen or name == t.name:
                        raise EngineError(f"cascades run in a circle at {name}")
                    more_bad, more = self._referring(child, hit, None, (*seen, t.name))
                    bad, work = bad + more_bad, [*work, *more, (child, hit.select(*[f"`{k}`" for k in child.key]).withColumn("op", F.lit(folds.DELETE)))]
                elif action == "SET NULL":
                    keys = F.array(*map(F.lit, columns))
                    if set(columns) & {*child.key, *child.store.meta.get("not_null", ())}:
                        raise EngineError(f"{', '.join(columns)} can't be null")
                    nulls = [(F.lit(None) if f.name in columns else F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in child.schema if f.name in {*child.key, *columns}]
                    work.append((child, hit.select(*nulls).withColumn("op", F.lit(folds.PATCH)).withColumn("keys", keys)))
                else:
                    bad.append((hit, f"still referred to by {name}"))
        return bad, work

    # transactions

    def begin(self, level: str = "REPEATABLE READ") -> None:
        if self.txn:
            raise EngineError("a transaction is open")
        level = " ".join(level.upper().split())
        level = {"SNAPSHOT": "REPEATABLE READ", "READ UNCOMMITTED": "READ COMMITTED"}.get(level, level)
        if level not in LEVELS:
            raise EngineError(f"unknown isolation level: {level}")
        self.txn = Txn(level)

    def commit(self) -> None:
        if not self.txn:
            raise EngineError("no transaction is open")
        txn = self.txn
        if txn.aborted:
            self.rollback()
            raise EngineError("the transaction was aborted; it is rolled back")
        self.txn = None
        try:
            if txn.staged:
                self._commit([(self.table(n), s) for n, s in txn.staged], check=lambda: self._conflicts(txn))
        except Exception:
            for _, s in txn.staged:
                self.files.delete(s[0])
            raise

    def _conflicts(self, txn: Txn) -> None:
        """Refuses a commit over what others have committed since: to the same keys, to tables with constraints beyond the
        key, or, at SERIALIZABLE, to any table that was read."""
        touched = dict.fromkeys(n for n, _ in txn.staged)
        for name, base in txn.base.items():
            store = self.store(name)
            meta = store.meta
            if meta["next"] == base or (name not in touched and txn.level != "SERIALIZABLE"):
                continue
            if name not in touched or txn.level == "SERIALIZABLE" or meta.get("unique") or _foreign(meta):
                raise EngineError(f"could not serialize: {name} was changed by another writer")
            key = [f"`{k}`" for k in meta["key"]]
            since = store.tail(base - 1).select(*key).distinct()
            for n, s in txn.staged:
                if n == name and s[1] and not store._logical(self.spark.read.parquet(s[0]), meta).select(*key).join(since, meta["key"], "left_semi").isEmpty():
                    raise EngineError(f"could not serialize: another writer changed the same rows of {name}")

    def rollback(self, to: str | None = None) -> None:
        if not self.txn:
            raise EngineError("no transaction is open")
        keep = 0
        if to is not None:
            k = next((k for k in reversed(range(len(self.txn.marks))) if self.txn.marks[k][0] == to), None)
            if k is None:
                raise EngineError(f"no savepoint {to}")
            keep, self.txn.marks, self.txn.aborted = self.txn.marks[k][1], self.txn.marks[: k + 1], False
        for _, staged in self.txn.staged[keep:]:
            self.files.delete(staged[0])
        del self.txn.staged[keep:]
        if to is None:
            self.txn = None

    def savepoint(self, name: str) -> None:
        if not self.txn:
            raise EngineError("no transaction is open")
        self.txn.marks.append((name, len(self.txn.staged)))

    def release(self, name: str) -> None:
        marks = self.txn.marks if self.txn else []
        k = next((k for k in reversed(range(len(marks))) if marks[k][0] == name), None)
        if k is None:
            raise EngineError(f"no savepoint {name}")
        del marks[k:]

    # maintenance

    def snapshot(self, name: str) -> int:
        t = self.table(name)
        seq = t.last_seq()
        t.store.write_snapshot(t.df(), seq)
        return seq

    def snapshot_due(self, name: str, writes: int = 10_000) -> bool:
        """Whether so many events came since the last snapshot."""
        t = self.table(name)
        return t.last_seq() - max(t.store.snapshots(), default=0) >= writes

    def snapshot_by(self, name: str, policy: SnapshotPolicy | None = None) -> int | None:
        """Takes a snapshot if the policy says that one is due; its number, or None. Time counts from the last snapshot, or
        from the first commit where there is none."""
        t = self.table(name)
        last, first = max(t.store.snapshots(), default=0), t.store.paths()[:1]
        since = [f"{t.store.path}/snapshots/{last}"] if last else first
        due = since and (policy or SnapshotPolicy()).due(t.last_seq() - last, self.files.age(since[0]))
        return self.snapshot(name) if due else None

    def compact(self, name: str, retain_after: int | None = None) -> None:
        """Rewrites the log; history up to retain_after (all, if None) becomes one INSERT for each live row."""
        t = self.table(name)
        t.store.rewrite(lambda: folds.compact(t.store.log(), t.key, t.values, retain_after))
        for seq in t.store.snapshots():  # the deletions behind an older snapshot are gone from the log
            if seq <= (t.last_seq() if retain_after is None else retain_after):
                self.files.delete(f"{t.store.path}/snapshots/{seq}")

    def alter(self, name: str, action: str, column: str, to: str | None = None, default: str | None = None) -> None:
        """action add (`to` is its type; with a default existing rows are patched), drop or rename (`to` is the new name).
        Files keep a column's first name; a name that was used before gets another one there."""
        t = self.table(name)
        with t.store.locked():
            meta = t.store.meta
            fields, physical, used = list(t.schema), meta.setdefault("physical", {}), meta.setdefault("used", list(t.schema.names))
            target = column if action == "add" else to
            if action != "drop" and target.lower() in (n.lower() for n in t.schema.names):
                raise EngineError(f"column exists: {target}")
            if action == "add":
                fields.append(StructType.fromDDL(f"`{column}` {to}")[0])
                if column in used:
                    physical[column] = f"{column}__{len(used)}"
                used.append(physical.get(column, column))
                if default is not None:
                    meta.setdefault("defaults", {})[column] = default
            elif column not in t.schema.names or column in t.key:
                raise EngineError(f"can't {action} {column}")
            else:
                own = [*(c for u in meta.get("unique", ()) for c in ([u] if isinstance(u, str) else u)), *(c for f in _foreign(meta) for c in f[0])]
                word = re.compile(rf"\b{re.escape(column)}\b")
                if action == "drop" and (column in own or any(map(word.search, meta.get("checks", ())))):
                    raise EngineError(f"a constraint holds {column}")
                if action == "drop":
                    meta["not_null"] = [c for c in meta.get("not_null", ()) if c != column]
                else:  # constraints follow the name
                    new = lambda c: to if c == column else c
                    meta["not_null"] = [new(c) for c in meta.get("not_null", ())]
                    meta["unique"] = [[new(c) for c in ([u] if isinstance(u, str) else u)] for u in meta.get("unique", ())]
                    meta["foreign"] = [{"columns": [new(c) for c in f[0]], "parent": f[1], "there": f[2], "on_delete": f[3]} for f in _foreign(meta)]
                    meta["checks"] = [word.sub(to, c) for c in meta.get("checks", ())]
                at = physical.pop(column, column)
                if action == "drop":
                    fields = [f for f in fields if f.name != column]
                    meta.get("defaults", {}).pop(column, None)
                else:
                    fields = [StructField(to, f.dataType) if f.name == column else f for f in fields]
                    if to != at:
                        physical[to] = at
                    if column in meta.get("defaults", {}):
                        meta["defaults"][to] = meta["defaults"].pop(column)
            meta["schema"] = StructType(fields).jsonValue()
            t.store.save(meta)
        if action == "add" and default is not None:
            self.patch(name, self.table(name).df().select(*[f"`{k}`" for k in t.key], F.expr(default).alias(column)))

    # views

    def create_view(self, name: str, sql: str, materialized: bool = False, policy: str = "manual", interval_s: float = 300, replace: bool = False) -> None:
        """policy of a materialized view: manual, on_access, interval or on_change (after each commit to a table it names)."""
        if name in self.views and not replace:
            raise EngineError(f"view exists: {name}")
        self.views[name] = {"sql": sql, "materialized": materialized, "policy": policy, "interval_s": interval_s, "at": None, "path": None}
        self._save_views()
        if materialized:
            self.refresh(name)

    def refresh(self, name: str) -> None:
        v = self.views[name]
        to = f"{self.root}/materialized/{name}-{uuid.uuid4().hex}"
        self.sql(v["sql"]).write.parquet(to)
        old, v["path"], v["at"] = v["path"], to, time.time()
        self._save_views()
        if old:
            self.files.delete(old)

    def _refresh_changed(self, table: str) -> None:
        for name, v in list(self.views.items()):
            if v["materialized"] and v["policy"] == "on_change" and re.search(rf"\b{re.escape(table)}\b", v["sql"]):
                self.refresh(name)

    def drop_view(self, name: str, cascade: bool = False, missing_ok: bool = False) -> None:
        if name not in self.views:
            if missing_ok:
                return
            raise EngineError(f"no view {name}")
        for other in [n for n, v in self.views.items() if n != name and re.search(rf"\b{re.escape(name)}\b", v["sql"])]:
            if not cascade:
                raise EngineError(f"{other} depends on {name}")
            if other in self.views:
                self.drop_view(other, True)
        del self.views[name]
        self._save_views()

    def _save_views(self) -> None:
        self.files.write(f"{self.root}/views.json", json.dumps(self.views))

    def _view(self, name: str) -> DataFrame:
        v = self.views[name]
        if not v["materialized"]:
            return self.sql(v["sql"])
        if v["policy"] == "on_access" or (v["policy"] == "interval" and time.time() - v["at"] >= v["interval_s"]):
            self.refresh(name)
        return self.spark.read.parquet(self.views[name]["path"])

    # queries

    def relation(self, name: str, clause: Clause | None = None) -> DataFrame:
        """What a name in FROM stands for, under the user's policies."""
        if name == "changed" and self.changed is not None:
            return self.changed
        if name in self.views:
            if clause:
                raise EngineError("a view has no history of its own")
            return self._view(name)
        t = Table(self, name) if self.store(name).exists() else None
        if t is None:
            raise EngineError(f"no table {name}")
        if clause is None:
            df = t.df()
        elif clause.kind == "as_of":
            df = Table(self, name, clause).df()
        elif clause.kind == "all":
            df = t.history()
        else:
            df = t.between(clause.low, clause.high, clause.kind == "between")
        return self.policies.filtered(df, name, self.user, "read")

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        """A SELECT, with FOR SYSTEM_TIME clauses by relation."""
        made: dict[str, str] = {}
        views: list[str] = []

        def named(name: str, clause: Clause | None) -> str:
            self._made += 1
            views.append(f"_pv_{self._tag}_{self._made}")
            self.relation(name, clause).createOrReplaceTempView(views[-1])
            return views[-1]

        try:
            text = rewrite(sql, lambda n, c: named(n, c))
            plain = re.sub(r"'(?:[^']|'')*'", "''", text)
            for name in [*self.tables(), *self.views, *(["changed"] if self.changed is not None else [])]:
                if re.search(rf"\b{re.escape(name)}\b", plain) and name not in made:
                    made[name] = named(name, None)
            if made:
                # A CTE over the statement keeps the tables' names for it alone, so sessions don't see each other's views.
                cte = ", ".join(f"`{n}` AS (SELECT * FROM {v})" for n, v in made.items())
                m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
                text = f"WITH {m[1] or ''}{cte}, {text[m.end() :]}" if m else f"WITH {cte} {text}"
            return self.spark.sql(text, args) if args else self.spark.sql(text)
        finally:  # the frame is resolved and needs them no more
            for v in views:
                self.spark.catalog.dropTempView(v)

    def cached(self, sql: str, ttl_s: float = 300, most: int = 100) -> DataFrame:
        """A query's rows, kept for the next time as files: as long as no table has changed, for `ttl_s` seconds, for the
        `most` queries used last. Nothing is kept in a transaction, nor where a point in time is named."""
        if self.txn or re.search(r"\bSYSTEM_TIME\b|\bcurrent_timestamp\b|\bnow\s*\(|\brand\s*\(", sql, re.I):
            return self.query(sql)
        state = {n: self.store(n).meta["next"] for n in self.tables()} | {n: v["at"] or v["sql"] for n, v in self.views.items()}
        key = (sql, self.user, json.dumps(state, sort_keys=True))
        held = self.results.pop(key, None)
        if held is None or time.time() - held[0] > ttl_s:
            if held:
                self.files.delete(held[1])
            held = (time.time(), f"{self.root}/results/{uuid.uuid4().hex}")
            self.query(sql).write.parquet(held[1])
        self.results[key] = held
        while len(self.results) > most:
            self.files.delete(self.results.pop(next(iter(self.results)))[1])
        return self.spark.read.parquet(held[1])

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """One statement; commands return one row with a message."""
        text = text.strip().rstrip(";")
        verb = text.split(None, 1)[0].upper() if text else ""
        if self.txn and self.txn.aborted and verb not in ("ROLLBACK", "COMMIT", "END"):
            raise EngineError("the transaction is aborted; only ROLLBACK or COMMIT may follow")
        began, error = time.time(), None
        try:
            return self._sql(text, verb, args)
        except Exception as e:
            error = str(e)
            if self.txn and verb not in ("ROLLBACK", "COMMIT", "END"):
                self.txn.aborted = True
            raise
        finally:  # of queries, the time to plan them: they run where their rows are asked for
            self.history.append({"statement": text[:1000], "seconds": time.time() - began, "error": error, "at": began})
            del self.history[:-HISTORY]

    def script(self, text: str) -> list[DataFrame]:
        return [self.sql(s) for s in statements(text)]

    def run_file(self, path: str) -> list[DataFrame]:
        """Statements of a file, one or more a line; a line that begins with `--` is a comment."""
        return [df for line in self.files.read(path).splitlines() for df in self.script(line)]

    def ingest_jsonl(self, name: str, path: str) -> int:
        return self.insert(name, read_jsonl(self.spark, path, self.table(name).schema))

    def create_procedure(self, name: str, parameters: str, body: str, replace: bool = False) -> None:
        """A procedure of SQL that outlives the process (see plans/procedures.py)."""
        from .plans import procedures

        at = f"{self.root}/procedures/{name}.json"
        if self.files.exists(at) and not replace:
            raise EngineError(f"procedure exists: {name}")
        procedures.parse(body), procedures.parameters(parameters)
        self.files.write(at, json.dumps({"parameters": parameters, "body": body}))

    def call(self, name: str, *args: Any) -> Any:
        """A stored procedure: one of SQL, a Python callable (engine, *args), or a script whose $1, $2, ... are literals."""
        from .plans import procedures

        at = f"{self.root}/procedures/{name}.json"
        if name not in self.procedures and self.files.exists(at):
            made = json.loads(self.files.read(at))
            return procedures.run(self, procedures.Procedure(procedures.parameters(made["parameters"]), procedures.parse(made["body"])), args)
        if name not in self.procedures:
            raise EngineError(f"no procedure {name}")
        p = self.procedures[name]
        if callable(p):
            return p(self, *args)
        return self.script(bind(p, args))[-1]

    def _done(self, message: str) -> DataFrame:
        return self.spark.createDataFrame([(message,)], "status string")

    def _sql(self, s: str, verb: str, args: dict | list | None) -> DataFrame:
        from .plans import commands

        if verb in ("SELECT", "WITH", "VALUES", "TABLE", "("):
            return self.query(s, args)
        return commands.run(self, s, verb)

    def analyze(self, name: str) -> DataFrame:
        return analyze(self.table(name).df())

    def explain(self, sql: str, mode: str = "formatted", run: bool = False, as_json: bool = False) -> DataFrame:
        """The plan as text; with run, the query is carried out and its plan is the final one, with rows and time. As JSON:
        an object with the plan's nodes, and with run rows and milliseconds."""
        return explain(self.query(sql), mode, run, as_json)

    def slow(self, least_s: float) -> list[dict]:
        """Statements of the history that took so long, slowest first."""
        return sorted((h for h in self.history if h["seconds"] >= least_s), key=lambda h: -h["seconds"])

    def doctor(self, name: str, repair: bool = False) -> tuple[DataFrame, list[str]]:
        """What is wrong with a table's log, and folders that failed writers left (deleted with repair)."""
        store = self.table(name).store
        return store.check(), store.orphans(repair)

    def read_info(self, name: str, at: int | str | None = None) -> dict[str, Any]:
        """What a read at a point in time is over: as_of_sequence, as_of_timestamp, versions_scanned (events that the fold
        reads, behind the snapshot used if there is one)."""
        t = self.table(name).as_of(at if isinstance(at, int) else None, at if isinstance(at, str) else None)
        log = folds.as_of(t.log(), seq=t.clause.low) if not isinstance(t.clause.low, str) else folds.as_of(t.log(), ts=t.clause.low)
        one = log.agg(F.max("seq").alias("s"), F.max("ts").alias("t")).first()
        near = [] if isinstance(at, str) else [s for s in t.store.snapshots() if at is None or s <= at]
        scanned = log.where(F.col("seq") > near[-1]).count() if near else log.count()
        return {"as_of_sequence": one.s, "as_of_timestamp": one.t, "versions_scanned": scanned, "snapshot": near[-1] if near else None}

    def rows(self, name: str) -> Iterator[dict]:
        """A table's rows one after the other; the driver holds one partition at a time."""
        for row in self.table(name).df().toLocalIterator(prefetchPartitions=False):
            yield row.asDict()


def _foreign(meta: dict) -> list[tuple[list[str], str, list[str], str]]:
    """(columns, parent, its columns, what a deletion does) of a table's foreign keys."""
    out = []
    for f in meta.get("foreign", []) if isinstance(meta.get("foreign"), list) else [{"columns": [c], "parent": p, "there": [x]} for c, (p, x) in meta.get("foreign", {}).items()]:
        out.append((f["columns"], f["parent"], f["there"], f.get("on_delete", "RESTRICT")))
    return out
