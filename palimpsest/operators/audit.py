"""An audit trail as an append-only table, its search and export; cancelling what a user runs."""

from __future__ import annotations

import threading
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Files, write_csv, write_json

SCHEMA = "at timestamp, user string, action string, table_name string, statement string, ok boolean, message string"


class Audit:
    """Entries are gathered and appended as one file a `flush`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.waiting = spark, path, []

    def note(self, user: str | None, action: str, table: str | None, statement: str, ok: bool = True, message: str | None = None) -> None:
        self.waiting.append((datetime.now(timezone.utc), user, action, table, statement, ok, message))

    def flush(self) -> None:
        if self.waiting:
            self.spark.createDataFrame(self.waiting, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.waiting = []

    def entries(self, since=None, until=None, user: str | None = None, table: str | None = None, action: str | None = None, ok: bool | None = None, limit: int | None = None) -> DataFrame:
        """Entries that match all given, newest first."""
        self.flush()
        found = self.spark.read.schema(SCHEMA).parquet(self.path) if Files(self.spark).exists(self.path) else self.spark.createDataFrame([], SCHEMA)
        for column, value in (("user", user), ("table_name", table), ("action", action), ("ok", ok)):
            if value is not None:
                found = found.where(F.col(column) == F.lit(value))
        if since is not None:
            found = found.where(F.col("at") >= F.lit(since))
        if until is not None:
            found = found.where(F.col("at") <= F.lit(until))
        found = found.orderBy(F.desc("at"))
        return found.limit(limit) if limit is not None else found

    def export(self, to: str, kind: str = "json") -> None:
        """All entries as JSON lines or CSV."""
        if kind not in ("json", "csv"):
            raise ValueError(f"unknown kind: {kind}")
        (write_json if kind == "json" else write_csv)(self.entries(), to)


def tagged(spark: SparkSession, tag: str, action, *args):
    """Runs an action whose jobs `cancel(spark, tag)` ends, from any thread."""
    spark.addTag(tag)
    try:
        return action(*args)
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.interruptTag(tag)


def limited(spark: SparkSession, seconds: float, action, *args):
    """Runs an action whose jobs end after so many seconds, with a TimeoutError."""
    tag, late = f"limit-{uuid.uuid4().hex}", threading.Event()

    def end() -> None:
        late.set()
        cancel(spark, tag)

    timer = threading.Timer(seconds, end)
    timer.start()
    try:
        return tagged(spark, tag, action, *args)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from e
        raise
    finally:
        timer.cancel()
