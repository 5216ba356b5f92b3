"""Read-only SQL: text limits, an allow-list on the parsed plan, and join authorisation on the analysed plan.

Works on classic sessions, whose plans can be walked.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .spec import MAX_ROWS, Refused

# Limits of a statement.
LIMITS = {"characters": 8000, "nodes": 500, "ctes": 10, "joins": 15, "objects": 20}
_ALLOWED = {
    "UnresolvedWith", "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "LateralJoin", "Generate", "UnresolvedHaving", "WithWindowDefinition", "Window", "Pivot", "Unpivot", "UnresolvedTableValuedFunction", "Range", "WithCTE", "CTERelationDef", "CTERelationRef",
}


def _children(plan) -> Iterator:
    for seq in (plan.children(), plan.innerChildren()):
        it = seq.iterator()
        while it.hasNext():
            yield it.next()


def _walk(plan) -> Iterator:
    yield plan
    for child in _children(plan):
        if "plans.logical" in child.getClass().getName() or "analysis.Unresolved" in child.getClass().getName():
            yield from _walk(child)


def _name(plan) -> str:
    return plan.getClass().getSimpleName()


def check(spark: SparkSession, sql: str) -> None:
    """Raise ``Refused`` unless the text is one bounded SELECT."""
    if len(sql) > LIMITS["characters"]:
        raise Refused("the statement is too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("the statement can't be parsed") from e
    nodes = list(_walk(plan))
    names = [_name(n) for n in nodes]
    if bad := sorted(set(names) - _ALLOWED):
        raise Refused(*[f"{n} is not allowed" for n in bad])
    for limit, kind in (("joins", ("Join", "LateralJoin")), ("objects", ("UnresolvedRelation",))):
        if sum(n in kind for n in names) > LIMITS[limit]:
            raise Refused(f"too many {limit}")
    if len(names) > LIMITS["nodes"]:
        raise Refused("the statement is too large")


def _conjuncts(e) -> Iterator:
    if e.getClass().getSimpleName() == "And":
        yield from _conjuncts(e.left())
        yield from _conjuncts(e.right())
    else:
        yield e


def _sources(plan) -> dict[int, tuple[str, str]]:
    """Expression id -> (table, column) of the outputs of named tables and views."""
    out = {}
    for n in _walk(plan):
        if _name(n) == "SubqueryAlias" and _name(n.child()) in ("View", "LogicalRelation"):
            name = n.child().desc().identifier().table() if _name(n.child()) == "View" else n.alias()
            it = n.child().output().iterator()
            while it.hasNext():
                a = it.next()
                out[a.exprId().id()] = (name, a.name())
    return out


def check_joins(spark: SparkSession, sql: str, confirmed: set[tuple[str, str, str, str]]) -> None:
    """Raise ``Refused`` unless each join of two named tables compares a confirmed pair (table, column, table, column)."""
    check(spark, sql)
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    sources = _sources(plan)
    pairs = confirmed | {(c, d, a, b) for a, b, c, d in confirmed}
    for n in _walk(plan):
        if _name(n) != "Join":
            continue
        condition = n.condition()
        good = False
        for e in _conjuncts(condition.get()) if condition.isDefined() else ():
            if e.getClass().getSimpleName() == "EqualTo" and all(x.getClass().getSimpleName() == "AttributeReference" for x in (e.left(), e.right())):
                left, right = (sources.get(x.exprId().id()) for x in (e.left(), e.right()))
                good |= left is None or right is None or (*left, *right) in pairs
        if not good:
            raise Refused("a join has no confirmed pair of columns")


def run(spark: SparkSession, sql: str, confirmed: set[tuple[str, str, str, str]] | None = None, max_rows: int | None = MAX_ROWS, args: dict | None = None) -> DataFrame:
    """The checked statement's rows, one more than ``max_rows`` at most: if that row is there, the answer is truncated. None: all rows."""
    check(spark, sql)
    if confirmed is not None:
        check_joins(spark, sql, confirmed)
    rows = spark.sql(sql, args=args or {})
    return rows if max_rows is None else rows.limit(max_rows + 1)
