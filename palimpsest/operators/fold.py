"""The state of event-sourced rows: folds of a log of INSERT, PATCH and SOFT_DELETE events.

A log is a DataFrame with seq (long), ts, op, key columns, value columns and, if patches may be partial, keys (an array
of the value columns an event supplies; null: all of them). An INSERT replaces a row, a PATCH sets what it supplies if
the row is live, a SOFT_DELETE removes the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, PATCH, DELETE = "INSERT", "PATCH", "SOFT_DELETE"


def as_of(log: DataFrame, seq: int | None = None, ts: str | None = None) -> DataFrame:
    """Events up to a sequence number or a timestamp, inclusive; the filter reaches the Parquet scan."""
    if seq is not None:
        log = log.where(F.col("seq") <= F.lit(int(seq)))
    if ts is not None:
        kind = dict(log.dtypes)["ts"]
        log = log.where(F.col("ts") <= F.lit(str(ts)).cast(kind))
    return log


def _supplies(log: DataFrame, column: str) -> Column:
    reset = F.col("op") != PATCH
    if "keys" not in log.columns:
        return F.lit(True)
    return reset | F.col("keys").isNull() | F.array_contains("keys", column)


def fold(log: DataFrame, key: Sequence[str], values: Sequence[str], meta: bool = False) -> DataFrame:
    """One row for each live key: key and value columns, and with meta last_seq and last_ts.

    One aggregation, combined before its shuffle, so a key with very many events costs one row for each map task. An
    INSERT or SOFT_DELETE supplies every column (what it lacks is null), hence the newest event that supplies a column
    is never older than the row's last INSERT, and no window over a key's events is needed.
    """
    reset = F.when(F.col("op") != PATCH, F.col("seq"))
    aggs = [F.max_by("op", reset).alias("__op")]
    for c in values:
        full = F.when(F.col("op") != DELETE, F.col(f"`{c}`"))
        if "keys" in log.columns:
            full = F.when(F.col("op") == PATCH, F.col(f"`{c}`")).when((F.col("op") == INSERT) & (F.col("keys").isNull() | F.array_contains("keys", c)), F.col(f"`{c}`"))
        aggs.append(F.max_by(full, F.when(_supplies(log, c), F.col("seq"))).alias(c))
    if meta:
        aggs += [F.max("seq").alias("last_seq"), F.max_by("ts", "seq").alias("last_ts")]
    state = log.groupBy(*[f"`{k}`" for k in key]).agg(*aggs).where(F.col("__op") == INSERT)
    return state.drop("__op")


def fold_from(snapshot: DataFrame, at: int, log: DataFrame, key: Sequence[str], values: Sequence[str], seq: int | None = None) -> DataFrame:
    """The state as of seq from a snapshot taken at `at` and the events behind it; the log's older part is not read."""
    tail = as_of(log, seq).where(F.col("seq") > F.lit(int(at)))
    base = snapshot.select(F.lit(int(at)).cast("long").alias("seq"), F.lit(INSERT).alias("op"), *[f"`{c}`" for c in (*key, *values)])
    return fold(base.unionByName(tail, allowMissingColumns=True), key, values)


def versions(log: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Every version of every row: key, values, start_seq, end_seq, system_time_start, system_time_end (the ends are
    exclusive and null for what is current); a version begins with each event that leaves the row live."""
    w = Window.partitionBy(*[f"`{k}`" for k in key]).orderBy("seq")
    reset = F.when(F.col("op") != PATCH, F.col("op"))
    out = log.withColumn("__op", F.last(reset, ignorenulls=True).over(w))
    for c in values:
        own = F.when(F.col("op") != DELETE, F.col(f"`{c}`"))
        if "keys" in log.columns:
            own = F.when(F.col("keys").isNull() | F.array_contains("keys", c), own)
        out = out.withColumn(f"__{c}", F.last(F.when(_supplies(log, c), F.struct(own.alias("v"))), ignorenulls=True).over(w)["v"])
    live = (F.col("__op") == INSERT) & (F.col("op") != DELETE)
    # PATCHes of rows that are not live change nothing, so they neither begin nor end a version.
    real = out.where((F.col("__op") == INSERT) | (F.col("op") == DELETE))
    real = real.withColumn("end_seq", F.lead("seq").over(w)).withColumn("system_time_end", F.lead("ts").over(w)).where(live)
    return real.select(
        *[F.col(f"`{k}`") for k in key], *[F.col(f"`__{c}`").alias(c) for c in values], F.col("seq").alias("start_seq"), "end_seq", F.col("ts").alias("system_time_start"), "system_time_end"
    )


def versions_between(log: DataFrame, key: Sequence[str], values: Sequence[str], low: int, high: int) -> DataFrame:
    """What `between(versions(log), low, high)` gives, from the state at `low`, the events behind it up to `high`, and each
    row's first event behind `high`, so that a window goes over no more than the range asked for."""
    state = fold(as_of(log, low), key, values, meta=True)
    keys = [F.lit(None).cast("array<string>").alias("keys")] if "keys" in log.columns else []
    ordered = [F.col(f"`{c}`") for c in (*key, *values)]
    base = state.select(F.col("last_seq").alias("seq"), F.col("last_ts").alias("ts"), F.lit(INSERT).alias("op"), *keys, *ordered)
    names = base.columns
    later = log.where(F.col("seq") > F.lit(int(high))).groupBy(*[f"`{k}`" for k in key]).agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))
    nothing = [F.lit(None).cast(log.schema[c].dataType).alias(c) for c in values]
    ends = later.select("seq", "ts", F.lit(DELETE).alias("op"), *keys, *[F.col(f"`{k}`") for k in key], *nothing)
    within = as_of(log, high).where(F.col("seq") > F.lit(int(low))).select(*[f"`{n}`" for n in names])
    made = versions(base.unionByName(within).unionByName(ends), key, values)
    return between(made, low, high)


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Whether a version is valid at a point: it has begun and not ended."""
    return (start <= at) & (end.isNull() | (end > at))


def between(made: DataFrame, low: int, high: int, inclusive: bool = True) -> DataFrame:
    """Versions whose interval meets [low, high], or [low, high) if not inclusive."""
    begun = F.col("start_seq") <= F.lit(high) if inclusive else F.col("start_seq") < F.lit(high)
    return made.where(begun & (F.col("end_seq").isNull() | (F.col("end_seq") > F.lit(low))))


def history(log: DataFrame, key: Sequence[str], values: Sequence[str], **equal) -> DataFrame:
    """sequence, timestamp, event_type, keys and values of all events, or of one key's."""
    cond = reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.lit(v) for k, v in equal.items()), F.lit(True))
    return log.where(cond).select(F.col("seq").alias("sequence"), F.col("ts").alias("timestamp"), F.col("op").alias("event_type"), *[f"`{c}`" for c in (*key, *values)])


def diff(before: DataFrame, after: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """change (added, removed, changed), keys and the new values between two states."""
    a, b = before.withColumn("__a", F.lit(True)).alias("a"), after.withColumn("__b", F.lit(True)).alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in key))
    equal = reduce(lambda x, y: x & y, (F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in values), F.lit(True))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~equal, "changed")
    joined = a.join(b, same, "full").withColumn("change", change).where("change is not null")
    return joined.select("change", *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[F.col(f"b.`{c}`").alias(c) for c in values])


def compact(log: DataFrame, key: Sequence[str], values: Sequence[str], retain_after: int | None = None) -> DataFrame:
    """The log rewritten: the state as of retain_after (now, if None) as INSERTs, then all later events."""
    old = log if retain_after is None else as_of(log, retain_after)
    state = fold(old, key, values, meta=True)
    base = state.select(F.col("last_seq").alias("seq"), F.col("last_ts").alias("ts"), F.lit(INSERT).alias("op"), *[f"`{c}`" for c in (*key, *values)])
    if retain_after is None:
        return base
    return base.unionByName(log.where(F.col("seq") > F.lit(retain_after)), allowMissingColumns=True)
