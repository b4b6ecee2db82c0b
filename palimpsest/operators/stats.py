"""Statistics of tables and plans as query results."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def analyze(df: DataFrame, exact: bool = False) -> DataFrame:
    """column_name, row_count, distinct_count, null_count, min_value, max_value: one pass over all columns.

    Distinct values are counted by a sketch unless exact; bounds are given as text.
    """
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggs += [count(c).alias(f"d{k}"), F.sum(c.isNull().cast("long")).alias(f"z{k}")]
        ordered = f.dataType.typeName() not in ("map", "variant")
        aggs += [(F.min(c) if ordered else F.lit(None)).cast("string").alias(f"a{k}"), (F.max(c) if ordered else F.lit(None)).cast("string").alias(f"b{k}")]
    one = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column_name"), F.col("n").alias("row_count"), F.col(f"d{k}").alias("distinct_count"),
                    F.coalesce(F.col(f"z{k}"), F.lit(0)).alias("null_count"), F.col(f"a{k}").alias("min_value"), F.col(f"b{k}").alias("max_value"),
                )
                for k, f in enumerate(df.schema)
            ]
        )
    )
    return one.select(rows.alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, buckets: int = 100) -> DataFrame:
    """bucket, bound: equi-depth bounds of a numeric column, from a sketch of fixed size."""
    if not isinstance(df.schema[column].dataType, NumericType):
        raise ValueError(f"{column} is not numeric")
    at = [k / buckets for k in range(buckets + 1)]
    bounds = df.agg(F.percentile_approx(F.col(f"`{column}`"), at, 10_000).alias("b"))
    return bounds.select(F.posexplode("b").alias("bucket", "bound"))


def explain(df: DataFrame, mode: str = "formatted", run: bool = False, as_json: bool = False) -> DataFrame:
    """The plan as one row of text, or of JSON; with run, after the query has been carried out (its rows go nowhere), as
    adaptive execution left it, with the number of rows and the time."""
    execution, rows, took = df._jdf.queryExecution(), None, 0.0
    if run:
        began = time.perf_counter()
        rows = int(execution.toRdd().count())
        took = (time.perf_counter() - began) * 1000
    text = df._sc._jvm.PythonSQLUtils.explainString(execution, mode)
    if as_json:
        made = {"plan": [json.loads(x) if x.startswith(("[", "{")) else x for x in [execution.optimizedPlan().toJSON()]][0]}
        if run:
            made |= {"rows": rows, "milliseconds": round(took, 3)}
        text = json.dumps(made)
    elif run:
        text += f"\nRows: {rows}\nExecution time: {took:.3f} ms"
    return df.sparkSession.createDataFrame([(text,)], "`QUERY PLAN` string")


def suggest_indexes(df: DataFrame, least: float = 0.1) -> DataFrame:
    """column_name, distinct_share: columns whose values are distinct enough that sorting or bloom filters pay."""
    share = F.col("distinct_count") / F.greatest(F.col("row_count"), F.lit(1))
    return analyze(df).withColumn("distinct_share", share).where(F.col("distinct_share") >= least).select("column_name", "distinct_share")


class Bloom:
    """A Bloom filter of a column's values, built where they are and merged on the way; of integers or strings. Scalable:
    `more` merges another one of the same size."""

    def __init__(self, df: DataFrame, column: str, expected: int, rate: float = 0.01):
        self.filter = df._jdf.stat().bloomFilter(column, expected, rate)

    def may_contain(self, value) -> bool:
        """False means that the value is not there for certain."""
        return self.filter.mightContain(value)

    def more(self, other: Bloom) -> Bloom:
        self.filter.mergeInPlace(other.filter)
        return self
