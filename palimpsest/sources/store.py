"""Event logs, snapshots and metadata in folders of any file system that Spark reaches."""

from __future__ import annotations

import json
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StringType, StructField, StructType, TimestampNTZType


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one of this machine where it
    is unset and there are no other machines."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, Path(tempfile.mkdtemp()).as_uri())


class Files:
    """Small files and folders through Hadoop's file system, so that paths may be local or remote."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written beside and renamed over what is there, so that a reader finds the old file or the new one."""
        fs, p = self._at(path)
        beside = self._at(f"{path}.{uuid.uuid4().hex}")[1]
        out = fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), how)

    def create(self, path: str) -> bool:
        """Whether the file was made now; False if it was there."""
        fs, p = self._at(path)
        try:
            fs.create(p, False).close()
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def age(self, path: str) -> float:
        """Seconds since a file was touched; 0 if it is not there."""
        fs, p = self._at(path)
        try:
            return time.time() - fs.getFileStatus(p).getModificationTime() / 1000
        except Exception:
            return 0.0

    def touch(self, path: str) -> None:
        fs, p = self._at(path)
        fs.setTimes(p, int(time.time() * 1000), -1)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def event_schema(columns: StructType) -> StructType:
    """Columns of a log over typed rows; keys names what a partial event supplies."""
    head = [StructField("seq", LongType()), StructField("ts", TimestampNTZType()), StructField("op", StringType()), StructField("keys", ArrayType(StringType()))]
    return StructType(head + [StructField(f.name, f.dataType) for f in columns])


class Store:
    """One table: `meta.json`, event files in a folder under log/ for each commit, snapshots under snapshots/<seq>.

    The metadata names the folders that count, so what a failed commit has left is never read. Sequence numbers are given
    by the one writer that holds the lock file; the lock of a writer that has died is taken over after `STALE` seconds.
    `pending` is a folder of commits over several tables: one that is there holds for all its tables, whether their
    metadata has been written yet or not. Columns keep the name they were made with in all files (`physical`), so a
    renamed column keeps its values and a dropped one's never come back."""

    STALE = 120.0

    def __init__(self, spark: SparkSession, path: str, pending: str | None = None):
        self.spark, self.path, self.files, self.pending = spark, path.rstrip("/"), Files(spark), pending

    @property
    def meta(self) -> dict[str, Any]:
        for name in self.files.names(self.pending) if self.pending else ():
            if name.endswith(".json"):
                metas = json.loads(self.files.read(f"{self.pending}/{name}"))
                if self.path in metas:
                    return metas[self.path]
        return json.loads(self.files.read(f"{self.path}/meta.json"))

    def save(self, meta: dict[str, Any]) -> None:
        self.files.write(f"{self.path}/meta.json", json.dumps(meta))

    def schema(self) -> StructType:
        return StructType.fromJson(self.meta["schema"])

    def create(self, schema: StructType, key: list[str], **more: Any) -> None:
        names = [f.name for f in schema]
        if len(set(n.lower() for n in names)) < len(names):
            raise ValueError("duplicate column")
        if not key or any(k not in names for k in key):
            raise ValueError("the primary key must name columns of the table")
        if self.files.exists(f"{self.path}/meta.json"):
            raise ValueError(f"table exists: {self.path}")
        self.save({"schema": schema.jsonValue(), "key": key, "next": 1, "log": [], "physical": {}, "used": names, **more})

    def exists(self) -> bool:
        return self.files.exists(f"{self.path}/meta.json")

    @staticmethod
    def _logical(df: DataFrame, meta: dict[str, Any]) -> DataFrame:
        """Columns under their names of now."""
        renamed = {old: new for new, old in meta.get("physical", {}).items()}
        if not renamed:
            return df
        if "keys" in df.columns:
            names = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
            df = df.withColumn("keys", F.transform("keys", lambda x: F.coalesce(names[x], x)))
        return df.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in df.columns])

    @staticmethod
    def _physical(df: DataFrame, meta: dict[str, Any]) -> DataFrame:
        """Columns under the names that files have."""
        names = meta.get("physical", {})
        if not names:
            return df
        if "keys" in df.columns:
            old = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
            df = df.withColumn("keys", F.transform("keys", lambda x: F.coalesce(old[x], x)))
        return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])

    @staticmethod
    def _files_schema(meta: dict[str, Any]) -> StructType:
        names = meta.get("physical", {})
        return StructType([StructField(names.get(f.name, f.name), f.dataType) for f in StructType.fromJson(meta["schema"])])

    def paths(self) -> list[str]:
        """Folders of the commits that count, oldest first."""
        return [f"{self.path}/{p}" if p.split("/")[0] == "log" else p for p in self.meta["log"]]  # others are attached

    def log(self) -> DataFrame:
        """All events; columns that older files lack are null."""
        meta = self.meta
        schema = event_schema(self._files_schema(meta))
        parts = self.paths()
        if not parts:
            return self._logical(self.spark.createDataFrame([], schema), meta)
        return self._logical(self.spark.read.schema(schema).parquet(*parts), meta)

    def stage(self, events: DataFrame) -> tuple[str, list[tuple[int, int]]]:
        """Writes events without numbers; returns where, and how many each partition has (all that comes to the driver).
        They count once `commit` has numbered them."""
        to = f"{self.path}/staged/{uuid.uuid4().hex}"
        events = self._physical(events, self.meta)
        events.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(to)
        made = self.spark.read.parquet(to).groupBy("__part").count().collect()
        return to, sorted((r["__part"], r["count"]) for r in made)

    def staged(self, staged: tuple[str, list[tuple[int, int]]], base: int) -> tuple[DataFrame, int]:
        """Staged events, numbered from base on without gaps, and the next number."""
        path, counts = staged
        made, rows, at = self.spark.read.parquet(path), [], base
        for part, n in counts:
            rows.append((part, at))
            at += n
        # One row for each partition of the write: small, and sent by its size.
        made = made.join(F.broadcast(self.spark.createDataFrame(rows, "__part int, __start long")), "__part")
        seq = F.col("__start") + F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
        return made.withColumn("seq", seq.cast("long")).drop("__part", "__at", "__start"), at

    def prepare(self, staged: list[tuple[str, list[tuple[int, int]]]], meta: dict[str, Any]) -> dict[str, Any]:
        """Writes staged events in order into a folder of their own, sorted by number so that row groups can be skipped;
        returns the metadata that makes them count. The lock must be held."""
        meta, folder = json.loads(json.dumps(meta)), f"log/{uuid.uuid4().hex}"
        fields, at = event_schema(self._files_schema(meta)), meta["next"]
        for s in staged:
            if not s[1]:
                continue
            events, at = self.staged(s, at)
            cols = [(F.col(f"`{f.name}`") if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
            events.select(cols).sortWithinPartitions("seq").write.mode("append").parquet(f"{self.path}/{folder}")
        if at > meta["next"]:
            meta["log"].append(folder)
        meta["next"] = at
        return meta

    def commit(self, staged: list[tuple[str, list[tuple[int, int]]]]) -> int:
        """Appends staged events; all of them count at once, when the metadata is saved. Returns the last number given."""
        with self.locked():
            meta = self.prepare(staged, self.meta)
            self.save(meta)
        for path, _ in staged:
            self.files.delete(path)
        return meta["next"] - 1

    @contextmanager
    def locked(self, wait_s: float = 60) -> Iterator[None]:
        """Holds the table's lock, touched as long as this process lives."""
        at, until = f"{self.path}/lock", time.time() + wait_s
        while not self.files.create(at):
            if self.files.age(at) > self.STALE:
                self.files.delete(at)
            elif time.time() > until:
                raise TimeoutError(f"another writer holds {at}")
            else:
                time.sleep(0.05)
        done = threading.Event()

        def beat() -> None:
            while not done.wait(self.STALE / 4):
                self.files.touch(at)

        threading.Thread(target=beat, daemon=True).start()
        try:
            self._finish()
            yield
        finally:
            done.set()
            self.files.delete(at)

    def _finish(self) -> None:
        """Saves what a commit over several tables has named but not saved, its writer having died."""
        for name in self.files.names(self.pending) if self.pending else ():
            metas = json.loads(self.files.read(f"{self.pending}/{name}")) if name.endswith(".json") else {}
            if self.path in metas:
                for path in metas:
                    if path != self.path:
                        with Store(self.spark, path).locked():
                            Store(self.spark, path).save(metas[path])
                self.save(metas[self.path])
                self.files.delete(f"{self.pending}/{name}")

    def tail(self, after: int) -> DataFrame:
        """Events behind a number; row groups before it are skipped by their statistics."""
        return self.log().where(F.col("seq") > F.lit(after))

    def snapshots(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.path}/snapshots") if n.isdigit())

    def write_snapshot(self, state: DataFrame, seq: int) -> None:
        beside = f"{self.path}/snapshots/.{uuid.uuid4().hex}"
        self._physical(state, self.meta).write.parquet(beside)
        fs, p = self.files._at(beside)
        self.files.delete(f"{self.path}/snapshots/{seq}")
        fs.rename(p, self.files._at(f"{self.path}/snapshots/{seq}")[1])

    def read_snapshot(self, seq: int) -> DataFrame:
        meta = self.meta
        return self._logical(self.spark.read.schema(self._files_schema(meta)).parquet(f"{self.path}/snapshots/{seq}"), meta)

    def rewrite(self, make: Callable[[], DataFrame]) -> None:
        """Replaces the log (compaction) by what `make` gives while the lock is held: the new files are complete before the
        metadata names them."""
        with self.locked():
            meta = self.meta
            to = f"log/{uuid.uuid4().hex}"
            self._physical(make(), meta).sortWithinPartitions("seq").write.parquet(f"{self.path}/{to}")
            old, meta["log"] = meta["log"], [to]
            self.save(meta)
            for p in old:
                if p.split("/")[0] == "log":
                    self.files.delete(f"{self.path}/{p}")

    def check(self) -> DataFrame:
        """Doctor: problem, n of what is wrong with the log (numbers given twice, missing or beyond the next one, unknown
        operations, events without a key); no rows if all is well."""
        meta = self.meta
        log = self.log()
        last = meta["next"] - 1
        key = [F.col(f"`{k}`").isNull() for k in meta["key"]]
        one = log.agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("d"), F.coalesce(F.sum((F.col("seq") > last).cast("long")), F.lit(0)).alias("beyond"),
            F.coalesce(F.sum((~F.col("op").isin("INSERT", "PATCH", "SOFT_DELETE")).cast("long")), F.lit(0)).alias("unknown"),
            F.coalesce(F.sum(F.greatest(F.lit(0), *[k.cast("int") for k in key])), F.lit(0)).cast("long").alias("keyless"),
        )
        rows = [("number given twice", F.col("n") - F.col("d")), ("number beyond the last", F.col("beyond")), ("unknown operation", F.col("unknown")), ("no key", F.col("keyless"))]
        found = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("problem"), b.alias("n")) for a, b in rows])).alias("r")).select("r.*")
        return found.where("n > 0")

    def orphans(self, delete: bool = False) -> list[str]:
        """Folders that failed writers have left; no reader looks at them."""
        with self.locked():
            meta = self.meta
            left = [f"log/{n}" for n in self.files.names(f"{self.path}/log") if f"log/{n}" not in meta["log"] and not n.startswith((".", "_"))]
            left += [f"staged/{n}" for n in self.files.names(f"{self.path}/staged")]
            for p in left if delete else ():
                self.files.delete(f"{self.path}/{p}")
        return left

    def drop(self) -> None:
        self.files.delete(self.path)


def commit_all(files: Files, pending: str, work: list[tuple[Store, list[tuple[str, list[tuple[int, int]]]]]], check: Any = None, held: str | None = None) -> None:
    """Commits to several tables at once: their locks are taken in one order, `check` may refuse, all events are written,
    and the file that names every table's new metadata makes all of them count. Whoever next holds one of the locks
    finishes it, should its writer have died."""
    with ExitStack() as locks:
        for store, _ in sorted(work, key=lambda w: w[0].path):
            if store.path != held:  # its lock is held already
                locks.enter_context(store.locked())
        if check:
            check()
        metas = {store.path: store.prepare(staged, store.meta) for store, staged in work}
        if len(work) > 1:
            name = f"{pending}/{uuid.uuid4().hex}.json"
            files.write(name, json.dumps(metas))
        for store, _ in work:
            store.save(metas[store.path])
        if len(work) > 1:
            files.delete(name)
    for store, staged in work:
        for path, _ in staged:
            files.delete(path)


def backup(store: Store, to: str, since: int = 0) -> int:
    """Copies events behind `since` (0: a full backup) and the metadata; returns the last number in it."""
    last = store.meta["next"] - 1
    store._physical(store.tail(since), store.meta).write.parquet(f"{to}/log")
    store.files.write(f"{to}/meta.json", json.dumps(store.meta | {"log": ["log"], "since": since}))
    return last


def restore(spark: SparkSession, parts: list[str], path: str) -> Store:
    """A table from a full backup and the incremental ones that follow it."""
    files = Files(spark)
    metas = [json.loads(files.read(f"{p}/meta.json")) for p in parts]
    if metas[0]["since"] != 0 or any(b["since"] != a["next"] - 1 for a, b in zip(metas, metas[1:])):
        raise ValueError("backups must begin with a full one and follow each other")
    for p in parts:
        spark.read.parquet(f"{p}/log").write.mode("append").parquet(f"{path}/log")
    made = Store(spark, path)
    made.save({k: v for k, v in metas[-1].items() if k != "since"})
    return made


def read_jsonl(spark: SparkSession, path: str, schema: DataType | str | None = None) -> DataFrame:
    """Rows of a JSON-lines file."""
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
