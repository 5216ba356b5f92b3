"""Join planning: cardinality, fan-out risk, join type, quality and paths between tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spec import Edge, Refused

# Limits of the search and weights of join quality.
MAX_HOPS, MAX_PATHS = 5, 8
FANOUT_RATIO, UNIQUE, LOW_CONFIDENCE = 10, 0.95, 70
QUALITY_WEIGHTS = {"confidence": 30, "cardinality": 20, "governance": 15, "key": 15, "dictionary": 10, "domain": 5, "profiling": 5}
CARDINALITY_SHARE = {"ONE_TO_ONE": 1.0, "MANY_TO_ONE": 0.75, "ONE_TO_MANY": 0.75, "MANY_TO_MANY": 0.40, "UNKNOWN": 0.25}
_RISK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}


@dataclass(frozen=True)
class Relation:
    """A confirmed pair of columns with what is known of it."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    confidence: int = 100
    cardinality: str = "MANY_TO_ONE"
    rows_ratio: float | None = None
    null_percent: float = 0.0
    quality: int = 0

    def turned(self) -> Relation:
        back = {"MANY_TO_ONE": "ONE_TO_MANY", "ONE_TO_MANY": "MANY_TO_ONE"}.get(self.cardinality, self.cardinality)
        ratio = 1 / self.rows_ratio if self.rows_ratio else None
        return replace(self, from_table=self.to_table, from_column=self.to_column, to_table=self.from_table, to_column=self.from_column, cardinality=back, rows_ratio=ratio, null_percent=0.0)

    def edge(self) -> Edge:
        return Edge(self.from_table, self.from_column, self.to_table, self.to_column, join_type(self), fanout_risk(self), self.confidence)


def cardinality(from_unique: bool, to_unique: bool) -> str:
    return {(True, True): "ONE_TO_ONE", (False, True): "MANY_TO_ONE", (True, False): "ONE_TO_MANY", (False, False): "MANY_TO_MANY"}[from_unique, to_unique]


def fanout_risk(r: Relation) -> str:
    if r.cardinality in ("ONE_TO_ONE", "MANY_TO_ONE"):
        return "LOW"
    if r.cardinality == "MANY_TO_MANY" or r.cardinality == "ONE_TO_MANY" and (r.rows_ratio or 0) >= FANOUT_RATIO:
        return "HIGH"
    return "MEDIUM"


def join_type(r: Relation) -> str:
    if r.cardinality == "MANY_TO_MANY" or r.cardinality == "UNKNOWN" and r.confidence < LOW_CONFIDENCE:
        return "FULL"
    return "LEFT" if r.null_percent > 0 else "INNER"


def join_quality(confidence: Column, kind: Column, key_score: Column, dictionary_approved: Column, domain_confidence: Column, profiled: Column) -> Column:
    """0 to 100 for each pair; ``dictionary_approved`` and ``profiled`` count the tables (0 to 2) for which it holds, nulls count as 0. Halves go to the even number."""
    w = QUALITY_WEIGHTS
    share = F.coalesce(*[F.when(kind == k, x) for k, x in CARDINALITY_SHARE.items()], F.lit(0.0))
    zero = F.lit(0.0)
    points = [w["confidence"] * confidence / 100, w["cardinality"] * share, F.lit(float(w["governance"])), w["key"] * key_score / 100, w["dictionary"] * dictionary_approved / 2, w["domain"] * domain_confidence, w["profiling"] * profiled / 2]
    return F.least(F.lit(100), sum(F.bround(F.coalesce(x.cast("double"), zero)).cast("int") for x in points))


def paths(relations: list[Relation], start: str, end: str, blocked: set[str] = frozenset()) -> list[list[Relation]]:
    """Simple paths of at most 5 hops, shortest first, at most 8; blocked tables may be ends but not waypoints."""
    around: dict[str, list[Relation]] = {}
    for r in relations:
        around.setdefault(r.from_table, []).append(r)
        around.setdefault(r.to_table, []).append(r.turned())
    found: list[list[Relation]] = []
    level: list[list[Relation]] = [[]]
    for _ in range(MAX_HOPS):
        grown = []
        for path in level:
            at = path[-1].to_table if path else start
            seen = {start} | {r.to_table for r in path}
            for r in sorted(around.get(at, []), key=lambda r: (r.to_table, r.from_column, r.to_column)):
                if r.to_table == end:
                    found.append([*path, r])
                elif r.to_table not in seen and r.to_table not in blocked:
                    grown.append([*path, r])
        level = grown
    return sorted(found, key=len)[:MAX_PATHS]


def _rank(path: list[Relation]) -> tuple:
    conf = [r.confidence for r in path]
    return len(path), max(_RISK[fanout_risk(r)] for r in path), -min(conf), -sum(r.quality for r in path) / len(path), -sum(conf) / len(path), -sum(CARDINALITY_SHARE.get(r.cardinality, 0) for r in path)


def best_path(relations: list[Relation], start: str, end: str, blocked: set[str] = frozenset()) -> list[Relation]:
    """Fewest hops, then least fan-out, then confidence, quality and cardinality. Refused if there is no path, or if the two best differ in nothing."""
    found = sorted(paths(relations, start, end, blocked), key=_rank)
    if not found:
        raise Refused(f"no trusted path from {start} to {end}")
    if len(found) > 1 and _rank(found[0]) == _rank(found[1]):
        raise Refused(f"several equal paths from {start} to {end}")
    return found[0]


def hubs(relations: list[Relation], least: int = 4) -> set[str]:
    """Lookup tables that many tables point at: no waypoints."""
    inbound: dict[str, set[str]] = {}
    for r in relations:
        inbound.setdefault(r.to_table, set()).add(r.from_table)
    return {t for t, sources in inbound.items() if len(sources) >= least}


def star(relations: list[Relation], primary: str, others: list[str], blocked: set[str] = frozenset()) -> list[Edge]:
    """Edges of the best path from the primary table to each other one."""
    out: dict[tuple, Edge] = {}
    for other in others:
        for r in best_path(relations, primary, other, blocked):
            e = r.edge()
            out.setdefault((e.left_table, e.left_column, e.right_table, e.right_column), e)
    return list(out.values())


def coverage(source: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """source_nonnull, source_distinct, matched_distinct, coverage. Targets are reduced to distinct keys, so repeated keys don't inflate the counts."""
    values = source.select(F.col(column).alias("k"))
    keys = target.select(F.col(key).alias("k")).filter("k is not null").distinct().withColumn("hit", F.lit(1))
    grouped = values.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(keys, "k", "left")
    out = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("source_nonnull"), F.count(F.lit(1)).alias("source_distinct"), F.count("hit").alias("matched_distinct"))
    return out.withColumn("coverage", F.round(F.col("matched_distinct") / F.nullif(F.col("source_distinct"), F.lit(0)), 3))


def orphans(source: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """total, unmatched, unmatched_percent, severity (HIGH over 10 %, MEDIUM over 1 %)."""
    values = source.filter(F.col(column).isNotNull()).select(F.col(column).alias("k"))
    keys = target.select(F.col(key).alias("k")).distinct().withColumn("hit", F.lit(1))
    out = values.join(keys, "k", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNull()).alias("unmatched"))
    percent = 100.0 * F.col("unmatched") / F.nullif(F.col("total"), F.lit(0))
    return out.withColumn("unmatched_percent", percent).withColumn("severity", F.when(percent > 10, "HIGH").when(percent > 1, "MEDIUM").when(percent > 0, "LOW").otherwise("NONE"))


def shortest_paths(spark: SparkSession, edges: DataFrame, start: str, max_hops: int = 10) -> DataFrame:
    """node, hops, path of the shortest undirected paths from ``start`` over edges (a, b); of equal lengths the least path.

    One round for each hop; a node keeps the least path of the round that reaches it
    first, and goes on from there. The rounds end when no node is new.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    seen = front = spark.createDataFrame([(start, 0, start)], "node string, hops int, path string")
    for hop in range(1, max_hops + 1):
        met = front.join(both, front.node == both.a).select(F.col("b").alias("node"), F.concat_ws(">", "path", "b").alias("path"))
        front = met.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).select("node", F.lit(hop).alias("hops"), "path").cache()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
