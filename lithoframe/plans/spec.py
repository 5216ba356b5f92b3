"""Query specifications and their translation into DataFrame plans.

A specification names columns of tables, never SQL text. What can't be answered
safely is refused with its reasons instead of being answered approximately.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import GRAINS, grain

# What a filter may do, and the most rows of an answer.
COMPARISONS = ("=", "!=", ">", ">=", "<", "<=", "LIKE", "NOT LIKE", "IN", "BETWEEN", "IS NULL", "IS NOT NULL")
MAX_ROWS = 1000
MAX_ENTITY_COLUMNS = 25
_UNSAFE = re.compile(r";|--|/\*|\*/|\b(drop|delete|insert|update|alter|create|truncate|exec|execute|merge|grant|revoke)\b", re.IGNORECASE)
_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


class Refused(ValueError):
    """A specification that won't be run, with its reasons."""

    def __init__(self, *reasons: str):
        super().__init__("; ".join(reasons))
        self.reasons = reasons


@dataclass(frozen=True)
class Derived:
    """The label of the first (present, absent) pair of columns of which one is null and the other isn't, else ``otherwise``."""

    branches: tuple[tuple[str, str, str], ...]  # (null column, column with a value, label)
    otherwise: str = "Other"


@dataclass(frozen=True)
class Field:
    table: str
    column: str | None = None
    aggregation: str | None = None
    alias: str | None = None
    distinct: bool = False
    grain: str | None = None
    derived: Derived | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        if self.aggregation:
            return f"{self.aggregation.lower()}_{self.column}" if self.column else "row_count"
        if self.grain:
            stem = re.sub(r"_?date$", "", self.column or "", flags=re.IGNORECASE)
            return f"{stem}_{self.grain}"
        return self.column or ""


@dataclass(frozen=True)
class Condition:
    table: str
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class Edge:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    join_type: str = "INNER"
    fanout_risk: str = "LOW"
    confidence: int = 100


@dataclass(frozen=True)
class Order:
    alias: str
    descending: bool = True


@dataclass
class QuerySpec:
    base: str
    select: list[Field]
    joins: list[Edge] = field(default_factory=list)
    where: list[Condition] = field(default_factory=list)
    having: list[tuple[str, str, Any]] = field(default_factory=list)
    order_by: list[Order] = field(default_factory=list)
    limit: int | None = None
    distinct: bool = False
    offset: int = 0


_JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}


def _col(table: str, column: str) -> Column:
    return F.col(f"`{table}__{column}`")


def join_tree(tables: dict[str, DataFrame], base: str, edges: list[Edge]) -> DataFrame:
    """The tables joined along the edges, columns named table__column. Edges join whichever side is missing; one whose sides are both there is skipped."""

    def named(name: str) -> DataFrame:
        if name not in tables:
            raise Refused(f"unknown table {name}")
        return tables[name].select(*[F.col(f"`{c}`").alias(f"{name}__{c}") for c in tables[name].columns])

    out, present, waiting = named(base), {base}, list(edges)
    while waiting:
        ready = next((e for e in waiting if (e.left_table in present) or (e.right_table in present)), None)
        if ready is None:
            raise Refused(*[f"{e.left_table} and {e.right_table} are not connected to {base}" for e in waiting])
        waiting.remove(ready)
        if ready.left_table in present and ready.right_table in present:
            continue
        new = ready.right_table if ready.left_table in present else ready.left_table
        how = _JOINS.get(ready.join_type.upper(), "inner")
        if new == ready.left_table:
            how = {"left": "right", "right": "left"}.get(how, how)
        out = out.join(named(new), _col(ready.left_table, ready.left_column) == _col(ready.right_table, ready.right_column), how)
        present.add(new)
    return out


def condition(c: Condition) -> Column:
    """A whitelisted comparison with bound values; anything else is refused."""
    op = c.operator.upper()
    if op not in COMPARISONS:
        raise Refused(f"operator {c.operator} is not allowed")
    values = c.value if isinstance(c.value, (list, tuple)) else [c.value]
    if any(isinstance(v, str) and _UNSAFE.search(v) for v in values):
        raise Refused(f"unsafe value for {c.column}")
    col = _col(c.table, c.column)
    if op == "IN":
        return col.isin(list(values))
    if op == "BETWEEN":
        return col.between(values[0], values[1] if len(values) == 2 else values[0])
    if op in ("IS NULL", "IS NOT NULL"):
        return col.isNull() if op == "IS NULL" else col.isNotNull()
    if op in ("LIKE", "NOT LIKE"):
        return col.like(c.value) if op == "LIKE" else ~col.like(c.value)
    v = F.lit(c.value)
    return {"=": col == v, "!=": col != v, ">": col > v, ">=": col >= v, "<": col < v, "<=": col <= v}[op]


def _expression(f: Field) -> Column:
    if f.derived:
        out = None
        for absent, present, label in f.derived.branches:
            test = _col(f.table, absent).isNull() & _col(f.table, present).isNotNull()
            out = F.when(test, label) if out is None else out.when(test, label)
        return F.lit(f.derived.otherwise) if out is None else out.otherwise(f.derived.otherwise)
    if f.column is None:
        return F.lit(1)
    col = _col(f.table, f.column)
    if f.grain:
        if f.grain not in GRAINS:
            raise Refused(f"unknown grain {f.grain}")
        return grain(col, f.grain)
    return col


def _aggregate(f: Field) -> Column:
    kind = f.aggregation.upper()
    if kind == "DISTINCT_COUNT":
        return F.count_distinct(_expression(f))
    if kind not in _AGGREGATES:
        raise Refused(f"aggregation {f.aggregation} is not allowed")
    if f.column is None and kind != "COUNT":
        raise Refused(f"{kind} needs a column")
    if f.distinct:
        return {"COUNT": F.count_distinct, "SUM": F.sum_distinct}.get(kind, _AGGREGATES[kind])(_expression(f))
    return _AGGREGATES[kind](_expression(f))


def validate(spec: QuerySpec) -> list[str]:
    """Reasons against running the specification."""
    reasons = []
    if not spec.select:
        reasons.append("nothing is selected")
    present = {spec.base} | {t for e in spec.joins for t in (e.left_table, e.right_table)}
    reasons += [f"{x.table} is not joined" for x in [*spec.select, *spec.where] if x.table not in present]
    reasons += [f"relationship {e.left_table}.{e.left_column} = {e.right_table}.{e.right_column} is not trusted" for e in spec.joins if e.confidence < 50]
    for f in spec.select:
        risky = any(e.fanout_risk in ("MEDIUM", "HIGH") for e in spec.joins)
        if f.aggregation and f.aggregation.upper() == "COUNT" and risky and not (f.distinct and f.column):
            reasons.append(f"counting {f.table} over a join that repeats rows needs COUNT(DISTINCT key)")
    if spec.limit is not None and spec.limit > MAX_ROWS:
        reasons.append(f"a limit of {spec.limit} rows is above {MAX_ROWS}")
    names = [f.name for f in spec.select]
    reasons += [f"{n} is selected twice" for n in sorted({n for n in names if names.count(n) > 1})]
    return reasons


def build(spec: QuerySpec, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a specification; at most its limit in rows, if it has one; a limit above ``MAX_ROWS`` is refused. Raises ``Refused``."""
    if reasons := validate(spec):
        raise Refused(*reasons)
    df = join_tree(tables, spec.base, spec.joins)
    for c in spec.where:
        df = df.filter(condition(c))
    measures = [f for f in spec.select if f.aggregation]
    keys = [f for f in spec.select if not f.aggregation]
    if measures:
        df = df.groupBy(*[_expression(f).alias(f.name) for f in keys]).agg(*[_aggregate(f).alias(f.name) for f in measures])
        for alias, op, value in spec.having:
            col, v = F.col(alias), F.lit(value)
            df = df.filter({"=": col == v, "!=": col != v, ">": col > v, ">=": col >= v, "<": col < v, "<=": col <= v}[op])
    else:
        df = df.select(*[_expression(f).alias(f.name) for f in keys])
        if spec.distinct:
            df = df.distinct()
    order = [F.desc(o.alias) if o.descending else F.asc(o.alias) for o in spec.order_by if o.alias in df.columns]  # an unknown column leaves the rows unsorted
    if order:
        df = df.orderBy(*order)
    if spec.offset:
        df = df.offset(spec.offset)
    return df if spec.limit is None else df.limit(spec.limit)


def entity_list(table: str, columns: list[str], restricted: set[str], limit: int = MAX_ROWS) -> QuerySpec:
    """Up to 25 columns of one table that aren't restricted."""
    safe = [c for c in dict.fromkeys(columns) if c not in restricted][:MAX_ENTITY_COLUMNS]
    return QuerySpec(table, [Field(table, c) for c in safe], limit=limit)


def multi_entity(base: str, edges: list[Edge], columns: dict[str, list[str]], limit: int = MAX_ROWS) -> QuerySpec:
    """Columns of two or three joined tables, named table__column."""
    if not 2 <= len(columns) <= 3:
        raise Refused("two or three entities are joined")
    return QuerySpec(base, [Field(t, c, alias=f"{t}__{c}") for t, cs in columns.items() for c in dict.fromkeys(cs)], joins=edges, limit=limit)


def mask(df: DataFrame, restricted: set[str]) -> DataFrame:
    """Restricted columns as ***, nulls too."""
    return df.select(*[F.lit("***").alias(c) if c in restricted else F.col(f"`{c}`") for c in df.columns])
