"""Table definitions: types, NOT NULL, primary keys, defaults, generated columns, CHECKs and the policy for unknown columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT, DYNAMIC, IGNORED = "strict", "dynamic", "ignored"


@dataclass
class Column:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    generated: str | None = None


@dataclass
class Table:
    """columns by name; key: the primary key; checks: SQL conditions by name (unknown passes)."""

    columns: list[Column]
    key: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    policy: str = DYNAMIC

    def conform(self, rows: DataFrame) -> DataFrame:
        """rows as the table takes them: cast, defaults and generated columns filled in; a row that breaks NOT NULL or a
        CHECK fails the job. Unknown columns are added (dynamic), kept out (ignored) or rejected (strict)."""
        known = {c.name for c in self.columns}
        extra = [c for c in rows.columns if c not in known]
        if extra and self.policy == STRICT:
            raise ValueError(f"unknown columns {extra}")
        out = rows.select(
            *[(F.col(c.name) if c.name in rows.columns else F.expr(c.default) if c.default else F.lit(None)).cast(c.type).alias(c.name) for c in self.columns if not c.generated],
            *[F.col(c) for c in extra if self.policy == DYNAMIC],
        )
        for c in self.columns:
            if c.generated:
                out = out.withColumn(c.name, F.expr(c.generated).cast(c.type))
        for c in self.columns:
            if c.not_null or c.name in self.key:
                out = out.withColumn(c.name, F.coalesce(c.name, F.raise_error(F.lit(f"{c.name} must not be null")).cast(c.type)))
        broken = None
        for name, condition in self.checks.items():
            test = F.when(~F.expr(condition), name)
            broken = test if broken is None else F.coalesce(broken, test)
        if broken is not None:
            out = out.where(F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("failed check "), broken)).cast("boolean")).otherwise(True))
        order = [c.name for c in self.columns]
        return out.select(*order, *[c for c in out.columns if c not in order])

    def add_column(self, column: Column) -> None:
        if any(c.name == column.name for c in self.columns):
            raise ValueError(f"{column.name} exists")
        self.columns.append(column)

    def drop_column(self, name: str) -> None:
        if name in self.key:
            raise ValueError("a column of the primary key stays")
        self.columns = [c for c in self.columns if c.name != name]

    def rename_column(self, old: str, new: str) -> None:
        for c in self.columns:
            if c.name == old:
                c.name = new
        self.key = [new if k == old else k for k in self.key]

    def set_default(self, name: str, default: str | None) -> None:
        next(c for c in self.columns if c.name == name).default = default

    def like(self, defaults: bool = True, checks: bool = True) -> Table:
        """CREATE TABLE LIKE: the same columns and key, INCLUDING (or not) defaults and checks."""
        columns = [replace(c, default=c.default if defaults else None) for c in self.columns]
        return Table(columns, list(self.key), dict(self.checks) if checks else {}, self.policy)

    def drop_check(self, name: str) -> None:
        if self.checks.pop(name, None) is None:
            raise ValueError(f"no constraint {name}")

    def show_create(self, name: str) -> str:
        parts = [f"{c.name} {c.type}" + (f" default {c.default}" if c.default else "") + (f" generated always as ({c.generated})" if c.generated else "") + " not null" * c.not_null for c in self.columns]
        parts += [f"primary key ({', '.join(self.key)})"] * bool(self.key) + [f"constraint {k} check ({v})" for k, v in self.checks.items()]
        return f"create table {name} ({', '.join(parts)}) with (column_policy = '{self.policy}')"
