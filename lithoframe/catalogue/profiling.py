"""Column and table profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tiers import cardinality_tier, currency, distribution_shape, percentage, quality_grade, row_tier, weighted_quality
from ..operators import profile as p
from ..plans.joins import coverage, join_quality, orphans
from ..sources.scans import table
from ..sources.types import catalog_columns
from .registry import Registry
from .relational import RELATIONS

add = Registry()
QUERIES, SQL = add.queries, add.sql


def _union(columns, each: str) -> str:
    return " UNION ALL ".join(each.format(c=c) for c in columns)


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@add(_union(_NUM, "SELECT '{c}' AS column_name, count(*) AS total, count(nullif({c}, 0)) AS populated, count(*) - count(nullif({c}, 0)) AS nulls, count(DISTINCT nullif({c}, 0)) AS distinct_values, round(avg(nullif({c}, 0)), 6) AS mean_value, round(stddev_samp(nullif({c}, 0)), 6) AS stddev_value, count(*) FILTER (nullif({c}, 0) = 0) AS zero_count, round(100.0 * (count(*) - count(nullif({c}, 0))) / count(*), 6) AS null_percentage, round(count(DISTINCT nullif({c}, 0)) / count(nullif({c}, 0)), 6) AS uniqueness FROM lineitem"))
def profile_numeric(spark, d):
    df = table(spark, d, "lineitem").select(*[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in _NUM])
    out = p.derived_rates(p.column_stats(df))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("column_name", "total", "populated", "nulls", "distinct_values", r("mean_value"), r("stddev_value"), "zero_count", r("null_percentage"), r("uniqueness"))


_TEXT = ("p_name", "p_brand", "p_type")


@add(_union(_TEXT, "SELECT '{c}' AS column_name, 'TEXT' AS logical_type, count({c}) AS populated, count(DISTINCT {c}) AS distinct_values, min({c}) AS min_value, max({c}) AS max_value, count(*) FILTER (length(trim({c})) = 0) AS blank_count, CAST(min(length({c})) AS INTEGER) AS min_length, CAST(max(length({c})) AS INTEGER) AS max_length, round(avg(length({c})), 6) AS avg_length FROM part"))
def profile_text(spark, d):
    out = p.column_stats(table(spark, d, "part"), list(_TEXT))
    return out.select("column_name", "logical_type", "populated", "distinct_values", "min_value", "max_value", "blank_count", "min_length", "max_length", F.round("avg_length", 6).alias("avg_length"))


@add("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest, CAST(greatest(0, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE))) AS INTEGER) AS span_days, CASE WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') < 30 THEN 'ACTIVE' WHEN date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-01') <= 180 THEN 'RECENT' ELSE 'HISTORICAL' END AS currency FROM orders")
def profile_datetime(spark, d):
    lo, hi = F.min("o_orderdate"), F.max("o_orderdate")
    ends = table(spark, d, "orders").agg(lo.alias("lo"), hi.alias("hi"))
    return ends.select(F.date_format("lo", "yyyy-MM-dd").alias("earliest"), F.date_format("hi", "yyyy-MM-dd").alias("latest"), F.greatest(F.lit(0), F.datediff("hi", "lo")).alias("span_days"), currency(F.col("hi"), F.lit("2001-12-01").cast("date")).alias("currency"))


@add(_union(_NUM, "SELECT '{c}' AS column_name, " + ", ".join(f"round(quantile_cont({{c}}, {q / 100}), 6) AS p{q}" for q in (5, 25, 50, 75, 95)) + " FROM lineitem"))
def percentiles_numeric(spark, d):
    out = p.percentiles(table(spark, d, "lineitem"), list(_NUM))
    return out.select("column_name", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@add("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(greatest(0, least(9, floor((o_totalprice - lo) / ((hi - lo) / 10)))) AS INTEGER) AS bucket, count(*) AS n FROM orders, e GROUP BY 1) SELECT CAST(g AS INTEGER) AS bucket, round(lo + g * ((hi - lo) / 10), 4) AS low, round(lo + (g + 1) * ((hi - lo) / 10), 4) AS high, coalesce(n, 0) AS n FROM generate_series(0, 9) s(g) CROSS JOIN e LEFT JOIN b ON b.bucket = g")
def histogram_price(spark, d):
    return p.histogram(table(spark, d, "orders"), "o_totalprice").select("bucket", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@add("SELECT * FROM (" + _union(("o_orderstatus", "o_orderpriority", "o_custkey"), "SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS place FROM orders GROUP BY {c}") + ") WHERE place <= 10")
def top_values_with_pct(spark, d):
    return p.top_values(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]).withColumn("percent", F.round("percent", 6))


_TIER = "CASE WHEN d = 1 THEN 'CONSTANT' WHEN d = 2 THEN 'BINARY' WHEN d >= n THEN 'UNIQUE' WHEN d / n > 0.95 THEN 'HIGH' WHEN d / n > 0.10 THEN 'MEDIUM' ELSE 'LOW' END"
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@add(f"SELECT column_name, {_TIER} AS tier FROM (" + _union(_ORDERS, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d, count({c}) AS n FROM orders") + ")")
def cardinality_tiers(spark, d):
    return p.column_stats(table(spark, d, "orders"), list(_ORDERS)).select("column_name", cardinality_tier(F.col("distinct_values"), F.col("populated")).alias("tier"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@add(_union(_TABLES, "SELECT '{c}' AS table_name, count(*) AS n, CASE WHEN count(*) = 0 THEN 'EMPTY' WHEN count(*) < 1000 THEN 'TINY' WHEN count(*) < 100000 THEN 'SMALL' WHEN count(*) < 1000000 THEN 'MEDIUM' WHEN count(*) < 10000000 THEN 'LARGE' ELSE 'VERY_LARGE' END AS tier FROM {c}"))
def row_tiers(spark, d):
    out = None
    for name in _TABLES:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("tier", row_tier(F.col("n")))


@add("SELECT column_name, CASE WHEN dv <= 1 THEN 'constant' WHEN np > 80 THEN 'sparse' WHEN p75 = p25 THEN 'constant' WHEN abs((p75 - 2 * p50 + p25) / (p75 - p25)) > 0.5 THEN 'highly_skewed' WHEN (p75 - 2 * p50 + p25) / (p75 - p25) > 0.1 THEN 'right_skewed' WHEN (p75 - 2 * p50 + p25) / (p75 - p25) < -0.1 THEN 'left_skewed' ELSE 'symmetric' END AS shape FROM (" + _union(_NUM, "SELECT '{c}' AS column_name, count(DISTINCT {c}) AS dv, 0 AS np, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM lineitem") + ")")
def shape_label(spark, d):
    df = table(spark, d, "lineitem")
    s = p.derived_rates(p.column_stats(df, list(_NUM))).join(p.percentiles(df, list(_NUM)), "column_name")
    return s.select("column_name", distribution_shape(F.col("distinct_values"), F.col("null_percentage"), F.col("p25"), F.col("p50"), F.col("p75")).alias("shape"))


@add(_union(("c_name", "c_mktsegment"), "SELECT '{c}' AS column_name, round(100.0 * count(*) FILTER (regexp_matches(trim({c}), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}$')) / count(*), 6) AS email_rate, round(100.0 * count(*) FILTER (regexp_matches(trim({c}), '^-?\\d+(\\.\\d+)?$')) / count(*), 6) AS numeric_rate, round(100.0 * count(*) FILTER (regexp_matches(trim({c}), '^(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\d{{2}}-\\d{{2}}-\\d{{4}}|[A-Za-z]{{3}}\\s+\\d{{1,2}})')) / count(*), 6) AS date_rate FROM customer WHERE trim({c}) <> ''"))
def pattern_rates(spark, d):
    out = p.pattern_rates(table(spark, d, "customer"), ["c_name", "c_mktsegment"])
    return out.select("column_name", *[F.round(c, 6).alias(c) for c in ("email_rate", "numeric_rate", "date_rate")])


@add("WITH s AS (SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(c_name), '[^\\p{L}\\p{Nd}]', chr(1), 'g'), '\\p{L}', 'A', 'g'), '\\p{Nd}', '9', 'g'), chr(1), 'X', 'g') AS pattern FROM customer) SELECT 'c_name' AS column_name, pattern, round(100.0 * count(*) / (SELECT count(*) FROM s), 6) AS coverage FROM s GROUP BY pattern ORDER BY count(*) DESC, pattern LIMIT 1")
def dominant_pattern(spark, d):
    return p.dominant_patterns(table(spark, d, "customer"), ["c_name"]).withColumn("coverage", F.round("coverage", 6))


@add("SELECT event_type, round(completeness, 4) AS completeness, round(q, 4) AS quality, CASE WHEN q >= 90 THEN 'A' WHEN q >= 75 THEN 'B' WHEN q >= 60 THEN 'C' WHEN q >= 40 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, (completeness * 0.4 + validity * 0.3) / 0.7 AS q FROM (SELECT event_type, greatest(0, 100 - 100.0 * count(*) FILTER (value < 20) / count(*)) AS completeness, 100.0 * count(*) FILTER (value >= 20 AND value < 80) / count(*) FILTER (value >= 20) AS validity FROM events GROUP BY 1))")
def quality_score(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("value") >= 20, F.col("value")))
    g = e.groupBy("event_type").agg(F.greatest(F.lit(0.0), 100 - percentage(F.count_if(F.col("v").isNull()), F.count(F.lit(1)))).alias("completeness"), percentage(F.count_if(F.col("v") < 80), F.count("v")).alias("validity"))
    q = weighted_quality(F.col("completeness"), F.lit(None).cast("double"), F.col("validity"))
    return g.select("event_type", F.round("completeness", 4).alias("completeness"), F.round(q, 4).alias("quality"), quality_grade(q).alias("grade"))


@add("SELECT count(l_orderkey) AS source_nonnull, count(DISTINCT l_orderkey) AS source_distinct, count(DISTINCT o_orderkey) AS matched_distinct, round(count(DISTINCT o_orderkey) / count(DISTINCT l_orderkey), 3) AS coverage FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_totalprice > 60000) ON l_orderkey = o_orderkey")
def referential_coverage(spark, d):
    return coverage(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").filter("o_totalprice > 60000"), "o_orderkey")


@add("SELECT total, unmatched, round(100.0 * unmatched / total, 6) AS unmatched_percent, CASE WHEN 100.0 * unmatched / total > 10 THEN 'HIGH' WHEN 100.0 * unmatched / total > 1 THEN 'MEDIUM' WHEN unmatched > 0 THEN 'LOW' ELSE 'NONE' END AS severity FROM (SELECT count(*) AS total, count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)) AS unmatched FROM orders)")
def orphan_keys(spark, d):
    return orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey").withColumn("unmatched_percent", F.round("unmatched_percent", 6))


@add("SELECT 'orders.o_custkey' AS edge, CASE WHEN count(DISTINCT o_custkey) / count(*) >= 0.95 THEN 'ONE_TO_ONE' ELSE 'MANY_TO_ONE' END AS cardinality, count(*) / count(DISTINCT o_custkey) >= 10 AS large FROM orders")
def cardinality_inference(spark, d):
    o = table(spark, d, "orders").agg((F.count_distinct("o_custkey") / F.count(F.lit(1))).alias("u"), (F.count(F.lit(1)) / F.count_distinct("o_custkey")).alias("ratio"))
    return o.select(F.lit("orders.o_custkey").alias("edge"), F.when(F.col("u") >= 0.95, "ONE_TO_ONE").otherwise("MANY_TO_ONE").alias("cardinality"), (F.col("ratio") >= 10).alias("large"))


#: Foreign keys judged: edge, source, its column, target, its column, which targets count.
_EDGES = (
    ("lineitem-orders", "lineitem", "l_orderkey", "orders", "o_orderkey", "o_totalprice > 60000"),
    ("orders-customer", "orders", "o_custkey", "customer", "c_custkey", "c_acctbal > 0"),
    ("customer-nation", "customer", "c_nationkey", "nation", "n_nationkey", "true"),
    ("nation-region", "nation", "n_regionkey", "region", "r_regionkey", "r_regionkey < 3"),
)


@add(
    "SELECT edge, CAST(least(100, round_even(0.3 * confidence, 0) + round_even(20 * CASE WHEN u >= 0.95 THEN 1.0 ELSE 0.75 END, 0) + 15 + 15 + 5 * approved + 5) AS INTEGER) AS quality FROM ("
    + " UNION ALL ".join(f"SELECT '{e}' AS edge, {k % 3} AS approved, 100 * round(count(DISTINCT {tc}) / count(DISTINCT {sc}), 3) AS confidence, count(DISTINCT {sc}) / count({sc}) AS u FROM {st} LEFT JOIN (SELECT DISTINCT {tc} FROM {tt} WHERE {where}) ON {sc} = {tc}" for k, (e, st, sc, tt, tc, where) in enumerate(_EDGES))
    + ")"
)
def join_quality_scores(spark, d):
    pairs = None
    for k, (edge, st, sc, tt, tc, where) in enumerate(_EDGES):
        one = coverage(table(spark, d, st), sc, table(spark, d, tt).filter(where), tc).select(F.lit(edge).alias("edge"), F.lit(k % 3).alias("approved"), (100 * F.col("coverage")).alias("confidence"), (F.col("source_distinct") / F.col("source_nonnull")).alias("u"))
        pairs = one if pairs is None else pairs.unionByName(one)
    kind = F.when(F.col("u") >= 0.95, "ONE_TO_ONE").otherwise("MANY_TO_ONE")
    return pairs.select("edge", join_quality(F.col("confidence"), kind, F.lit(100), F.col("approved"), F.lit(None).cast("double"), F.lit(2)).alias("quality"))


#: Columns made of customer to be judged: name, semantic type, Spark expression, SQL.
_JUDGED = (
    ("email", "EMAIL", "if(c_custkey % 40 = 0, c_name, concat('u', c_custkey, '@example.com'))", "CASE WHEN c_custkey % 40 = 0 THEN c_name ELSE 'u' || c_custkey || '@example.com' END"),
    ("phone", "PHONE", "if(c_custkey % 5 < 3, '555-010-1234', c_name)", "CASE WHEN c_custkey % 5 < 3 THEN '555-010-1234' ELSE c_name END"),
    ("guid", "TEXT", "if(c_custkey % 5 < 3, concat(lpad(cast(c_custkey as string), 8, '0'), '-0000-4000-8000-000000000000'), c_name)", "CASE WHEN c_custkey % 5 < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000' ELSE c_name END"),
    ("joined", "TEXT", "if(c_custkey % 20 < 17, '2020-01-05', c_name)", "CASE WHEN c_custkey % 20 < 17 THEN '2020-01-05' ELSE c_name END"),
    ("broken", "EMAIL", "if(c_custkey % 5 = 0, 'a@b.cd', c_name)", "CASE WHEN c_custkey % 5 = 0 THEN 'a@b.cd' ELSE c_name END"),
    ("c_name", "TEXT", "c_name", "c_name"),
)
_SHAPES = {"email": "^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$", "phone": "^[+\\d\\s\\-().]+$", "guid": "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", "dated": "^\\d{4}-\\d{2}-\\d{2}"}
_SHARES = ", ".join(f"100.0 * count(*) FILTER (regexp_matches(trim(v), '{x}'){' AND length(regexp_replace(v, $$[^0-9]$$, $$$$, $$g$$)) BETWEEN 7 AND 15' if k == 'phone' else ''}) / count(*) AS {k}" for k, x in _SHAPES.items())


@add(
    "SELECT column_name, round(r, 6) AS validator, CASE WHEN r >= 95 THEN 'valid' WHEN r >= 50 THEN 'partially_valid' WHEN r IS NOT NULL THEN 'invalid' ELSE 'unknown' END AS status FROM (SELECT column_name, coalesce(CASE kind WHEN 'EMAIL' THEN email WHEN 'PHONE' THEN phone WHEN 'ID' THEN guid END, CASE WHEN guid >= 50 THEN guid END, CASE WHEN dated >= 80 THEN dated END) AS r FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS column_name, '{kind}' AS kind, {_SHARES} FROM (SELECT {sql} AS v FROM customer) WHERE trim(v) <> ''" for n, kind, _, sql in _JUDGED)
    + "))"
)
def validity_rules(spark, d):
    rates = p.pattern_rates(table(spark, d, "customer").select(*[F.expr(e).alias(n) for n, _, e, _ in _JUDGED]), [n for n, *_ in _JUDGED])
    kind = F.coalesce(*[F.when(F.col("column_name") == n, k) for n, k, *_ in _JUDGED])
    v = p.validator_rate(kind)
    return rates.select("column_name", F.round(v, 6).alias("validator"), p.validity_status(v).alias("status"))


#: Tables with what is known of them: class, number of key columns.
_KNOWN = (("region", "Reference", 1), ("nation", "Reference", 1), ("customer", "Master", 1), ("supplier", "Master", 1), ("part", "Master", 1), ("orders", "Transactional", 1), ("lineitem", "Transactional", 0), ("events", "Audit", 1), ("tmp_orders", "Transactional", 0))
_FK = "(VALUES " + ", ".join(f"('{r.from_table}', '{r.to_table}')" for r in RELATIONS) + ") e(a, b)"


@add(
    "WITH k AS (SELECT table_name, count(*) AS n, bool_or(data_type LIKE 'TIMESTAMP%') AS dated FROM duckdb_columns() GROUP BY 1), c AS (SELECT * FROM k UNION ALL SELECT 'tmp_orders', n, dated FROM k WHERE table_name = 'orders'), "
    f"x AS (SELECT c.*, kind, pks, (SELECT count(*) FROM {_FK} WHERE e.a = c.table_name) AS fks, (SELECT count(*) FROM {_FK} WHERE e.b = c.table_name) AS refs FROM c JOIN (VALUES {', '.join(map(str, _KNOWN))}) t(name, kind, pks) ON name = c.table_name) "
    "SELECT table_name, CAST(CASE kind WHEN 'Master' THEN 50 WHEN 'Transactional' THEN 40 WHEN 'Reference' THEN 25 ELSE -25 END + CASE WHEN refs >= 5 THEN 20 ELSE 0 END + CASE WHEN fks > 0 THEN 15 ELSE 0 END + CASE WHEN dated THEN 10 ELSE 0 END + CASE WHEN pks > 0 THEN 10 ELSE 0 END - CASE WHEN table_name[1:4] = 'tmp_' THEN 50 ELSE 0 END AS INTEGER) AS priority, "
    "CASE WHEN fks >= 2 AND n <= fks + 2 THEN 'junction' WHEN fks = 0 THEN 'root' WHEN refs = 0 THEN 'leaf' ELSE 'inner' END AS role FROM x"
)
def table_priorities(spark, d):
    tables = {n: table(spark, d, n.removeprefix("tmp_")) for n, *_ in _KNOWN}
    columns = catalog_columns(spark, tables).groupBy("table_name").agg(F.count(F.lit(1)).cast("int").alias("columns"), F.bool_or(F.col("logical_type") == "DATETIME").alias("has_date"))
    links = spark.createDataFrame([(r.from_table, r.to_table) for r in RELATIONS], "a string, b string")
    count = lambda end, name: links.groupBy(F.col(end).alias("table_name")).agg(F.count(F.lit(1)).alias(name))
    known = spark.createDataFrame(list(_KNOWN), "table_name string, kind string, pks int").join(columns, "table_name")
    df = known.join(count("a", "fks"), "table_name", "left").join(count("b", "inbound"), "table_name", "left").na.fill(0, ["fks", "inbound"])
    score = p.table_priority(F.col("kind"), F.col("inbound"), F.col("fks"), F.col("has_date"), F.col("pks"), F.col("table_name"))
    return df.select("table_name", score.alias("priority"), p.table_role(F.col("fks"), F.col("columns"), F.col("inbound")).alias("role"))


@add("SELECT table_name, CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'INTEGER' WHEN data_type IN ('FLOAT', 'DOUBLE') THEN 'DECIMAL' WHEN data_type = 'VARCHAR' THEN 'TEXT' WHEN data_type LIKE 'TIMESTAMP%' THEN 'DATETIME' ELSE 'OTHER' END AS logical_type, count(*) AS n FROM duckdb_columns() WHERE table_name IN ('nation', 'region', 'events', 'embeddings') GROUP BY ALL")
def catalog_types(spark, d):
    return catalog_columns(spark, {n: table(spark, d, n) for n in ("nation", "region", "events", "embeddings")}).groupBy("table_name", "logical_type").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, event_type[1:2000] AS event_type, props[1:2000] AS props FROM events", also="normalized_cells_all")
def normalized_cells(spark, d):
    return p.normalize_cells(table(spark, d, "events").select("event_id", "ts", "event_type", "props"))
