"""Recursion beyond what WITH RECURSIVE covers: UNION without ALL, to a fixed point."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.store import shared_dir


def fixed_point(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000) -> DataFrame:
    """Rows of the anchor and of all steps, each once. `step` gets the rows new in the last round.

    Each round is written to the shared folder (spark.checkpoint.dir), so neither lineage nor a lost executor makes
    earlier rounds run again; new rows are found by an anti join, so rounds may be of any size.
    """
    spark = anchor.sparkSession
    root = f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}"
    names = anchor.columns
    anchor.distinct().write.parquet(f"{root}/r0")
    schema = anchor.schema
    for k in range(1, most + 1):
        new = spark.read.schema(schema).parquet(f"{root}/r{k - 1}")
        seen = spark.read.schema(schema).parquet(*[f"{root}/r{j}" for j in range(k)])
        made = step(new).toDF(*names)
        made = made.select([made[f.name].cast(f.dataType) for f in schema]).distinct().subtract(seen)
        made.write.parquet(f"{root}/r{k}")
        if spark.read.schema(schema).parquet(f"{root}/r{k}").isEmpty():
            return seen
    raise RuntimeError(f"no fixed point after {most} rounds")
