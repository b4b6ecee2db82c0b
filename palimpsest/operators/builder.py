"""A fluent query over one engine's tables, at any point in time."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.temporal_sql import Clause, point

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class Query:
    """Steps are kept and planned when `df` is asked for; values become literals, so no text is quoted by hand."""

    engine: Any
    table: str
    clause: Clause | None = None
    columns: tuple = ()
    filters: tuple = ()
    joins: tuple = ()
    order: tuple = ()
    most: int | None = None
    skip: int = 0

    def select(self, *columns: str) -> Query:
        return replace(self, columns=self.columns + columns)

    def where(self, condition: str | None = None, **equal: Any) -> Query:
        return replace(self, filters=self.filters + ((condition, tuple(equal.items())),))

    def join(self, table: str, on: str | list[str] | None = None, kind: str = "inner", as_of: str | None = None) -> Query:
        """on: a condition, or column names both sides have. Columns of a condition are named alias-free or `table.column`."""
        return replace(self, joins=self.joins + ((table, tuple(on) if isinstance(on, list) else on, KINDS[kind], as_of),))

    def order_by(self, column: str, descending: bool = False) -> Query:
        return replace(self, order=self.order + ((column, descending),))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def as_of(self, text: str) -> Query:
        """`@seq:N`, `@now` or a timestamp."""
        return replace(self, clause=Clause("as_of", point(text)))

    def between(self, low: str, high: str, inclusive: bool = True) -> Query:
        """Versions valid at some time from low to high, both written as for `as_of`."""
        return replace(self, clause=Clause("between" if inclusive else "from_to", point(low), point(high)))

    def all_versions(self) -> Query:
        return replace(self, clause=Clause("all"))

    def df(self) -> DataFrame:
        out = self.engine.relation(self.table, self.clause).alias(self.table)
        for table, on, kind, as_of in self.joins:
            other = self.engine.relation(table, Clause("as_of", point(as_of)) if as_of else None).alias(table)
            out = out.crossJoin(other) if kind == "cross" else out.join(other, list(on) if isinstance(on, tuple) else F.expr(on), kind)
        for condition, equal in self.filters:
            if condition:
                out = out.where(condition)
            for c, v in equal:
                out = out.where(F.col(c) == F.lit(v))
        if self.order:  # nulls last going up, first going down
            out = out.orderBy(*[F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in self.order])
        if self.columns:
            out = out.selectExpr(*self.columns)
        if self.skip:
            out = out.offset(self.skip)
        return out.limit(self.most) if self.most is not None else out
