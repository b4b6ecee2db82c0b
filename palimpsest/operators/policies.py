"""Row-level policies: predicates that are put into the plan wherever a table is read or written."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.literals import filled


@dataclass
class Policy:
    """using: SQL condition on rows that may be seen; check: condition on rows that may be written (using, if None).
    `$user` and `$name` for each variable stand for string literals. Permissive policies are OR-ed, restrictive ones
    AND-ed. users: for whom (None: everyone); action: read, write or all."""

    name: str
    table: str
    using: str
    check: str | None = None
    permissive: bool = True
    users: list[str] | None = None
    action: str = "all"


@dataclass
class Policies:
    made: list[Policy] = field(default_factory=list)
    enabled: set[str] = field(default_factory=set)
    superusers: set[str] = field(default_factory=set)
    variables: dict[str, str] = field(default_factory=dict)

    def add(self, policy: Policy) -> None:
        self.made.append(policy)
        self.enabled.add(policy.table)

    def drop(self, name: str, table: str) -> None:
        self.made = [p for p in self.made if (p.name, p.table) != (name, table)]

    def condition(self, table: str, user: str | None, action: str, check: bool = False) -> str | None:
        """The condition for a user, None where no policy holds; a protected table without a permissive policy for the
        user shows nothing."""
        if table not in self.enabled or user in self.superusers:
            return None
        own = [p for p in self.made if p.table == table and p.action in ("all", action) and (p.users is None or user in p.users)]

        def text(p: Policy) -> str:
            sql = p.check if check and p.check is not None else p.using
            return f"({filled(sql, {'user': user or '', **self.variables})})"

        some = [text(p) for p in own if p.permissive]
        every = [text(p) for p in own if not p.permissive]
        return " AND ".join(["(" + " OR ".join(some) + ")" if some else "false", *every])

    def filtered(self, df: DataFrame, table: str, user: str | None, action: str) -> DataFrame:
        cond = self.condition(table, user, action)
        return df if cond is None else df.where(cond)

    def refused(self, rows: DataFrame, table: str, user: str | None) -> DataFrame | None:
        """New rows that the user must not write; None where no policy holds."""
        cond = self.condition(table, user, "write", check=True)
        return None if cond is None else rows.where(~F.coalesce(F.expr(cond), F.lit(False)))
