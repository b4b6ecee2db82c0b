"""Queries of the engine's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import relational, temporal

flagship = temporal.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name, sql in relational.QUERIES.items():
        text = sql if isinstance(sql, str) else sql[0]
        found[name] = lambda spark, sf_dir, text=text: relational.run(spark, sf_dir, text)
    return found | {name: q for name, (q, _) in temporal.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql if isinstance(sql, str) else sql[1] for name, sql in relational.QUERIES.items()}
    return found | {name: sql for name, (_, sql) in temporal.QUERIES.items() if sql}
