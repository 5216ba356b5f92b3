"""Columns and tables classified from their profiles, and changes between two states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tiers import cardinality_tier, currency, row_tier
from ..operators import classify as c
from ..operators import lifecycle
from ..operators import profile as p
from ..operators import semantics as s
from ..sources.scans import table
from ..sources.types import catalog_columns
from .profiling import _TIER
from .registry import Registry
from .reports import _LINK_SQL, _LINKS, _LIST, _NAMED, _TABLES

add = Registry()
QUERIES, SQL = add.queries, add.sql

#: Customers with columns of every kind: name, Spark expression, DuckDB expression, logical type.
_CONTACTS = (
    ("customer_id", "c_custkey", "c_custkey", "INTEGER"),
    ("email", "if(c_custkey % 10 = 0, c_name, concat('u', c_custkey, '@example.com'))", "CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE 'u' || c_custkey || '@example.com' END", "TEXT"),
    ("mobilePhone", "concat('555-010-', 1000 + c_custkey % 1000)", "'555-010-' || (1000 + c_custkey % 1000)", "TEXT"),
    ("contactName", "c_name", "c_name", "TEXT"),
    ("account_balance", "c_acctbal", "c_acctbal", "DECIMAL"),
    ("score", "abs(c_acctbal)", "abs(c_acctbal)", "DECIMAL"),
    ("order_count", "c_nationkey", "c_nationkey", "INTEGER"),
    ("is_rich", "if(c_acctbal > 0, 1, 0)", "CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END", "INTEGER"),
    ("status", "if(c_acctbal > 0, 'open', if(c_acctbal < -900, null, 'owing'))", "CASE WHEN c_acctbal > 0 THEN 'open' WHEN c_acctbal < -900 THEN NULL ELSE 'owing' END", "TEXT"),
    ("marketGroup", "c_mktsegment", "c_mktsegment", "TEXT"),
    ("joined", "concat('2020-01-', lpad(1 + c_custkey % 28, 2, '0'))", "'2020-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0')", "TEXT"),
    ("ssn", "cast(100000000 + c_custkey as string)", "CAST(100000000 + c_custkey AS VARCHAR)", "TEXT"),
    ("accountKey", "concat('k', c_custkey)", "'k' || c_custkey", "TEXT"),
    ("empty", "cast(null as string)", "CAST(NULL AS VARCHAR)", "TEXT"),
)
_SPLIT = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_HAS = lambda words: f"list_has_any(w, {_LIST(words)})"
_RATE = lambda e, pattern: f"count(*) FILTER (trim({e}) <> '' AND regexp_matches(trim({e}), '{pattern}')) / nullif(count(*) FILTER (trim({e}) <> ''), 0)"


def _profile_sql(name: str, expression: str, kind: str) -> str:
    v = f"CAST({expression} AS VARCHAR)"
    return (
        f"SELECT '{name}' AS column_name, '{kind}' AS kind, {'true' if name == 'customer_id' else 'false'} AS key, count(DISTINCT {expression}) AS d, count({expression}) AS n, "
        + (f"{_RATE(v, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{2,}$')} AS email, " if kind == "TEXT" else "NULL AS email, ")
        + (f"count(*) FILTER (regexp_matches(trim({v}), '^[+\\d\\s\\-().]+$') AND length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN 7 AND 15) / nullif(count(*) FILTER (trim({v}) <> ''), 0) AS phone, " if kind == "TEXT" else "NULL AS phone, ")
        + (f"{_RATE(v, '^(\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4}|\\d{2}-\\d{2}-\\d{4}|[A-Za-z]{3}\\s+\\d{1,2})')} AS dated, " if kind == "TEXT" else "NULL AS dated, ")
        + (f"CAST(min({expression}) AS DOUBLE) AS lo, CAST(max({expression}) AS DOUBLE) AS hi" if kind != "TEXT" else "NULL AS lo, NULL AS hi")
        + " FROM customer"
    )


_PII = f"(list_has_any(w, {_LIST(s.PII_TOKENS)}) OR len(list_filter({_LIST(s.PII_PARTS)}, lambda x: contains(array_to_string(w, ''), x))) > 0 OR (list_position(w, 'name') > 0 AND kind = 'TEXT' AND (list_position(w, 'name') = 1 OR list_contains({_LIST(s.PERSONS)}, w[list_position(w, 'name') - 1]))))"
_FEW = "tier IN ('BINARY', 'LOW', 'CONSTANT')"
_SCORES = (
    ("EMAIL", "CASE WHEN email IS NULL THEN CASE WHEN pii AND list_contains(w, 'email') THEN 0.55 ELSE 0 END WHEN pii AND email >= 0.7 THEN 0.95 WHEN email >= 0.85 THEN 0.9 WHEN email >= 0.5 THEN 0.7 ELSE 0 END"),
    ("PHONE", f"CASE WHEN phone IS NULL THEN CASE WHEN pii AND {_HAS(c.PHONE_TOKENS)} THEN 0.55 ELSE 0 END WHEN pii AND phone >= 0.6 THEN 0.9 WHEN phone >= 0.75 THEN 0.85 ELSE 0 END"),
    ("SSN", f"CASE WHEN {_HAS(c.SSN_TOKENS)} THEN 0.92 ELSE 0 END"),
    ("ID", f"CASE WHEN key THEN 1 WHEN {_HAS(c.ID_ANYWHERE)} THEN 0.9 WHEN tier IN ('UNIQUE', 'HIGH') AND {_HAS(c.ID_SUFFIX)} THEN 0.8 ELSE 0 END"),
    ("AMOUNT", f"CASE WHEN kind <> 'TEXT' AND {_HAS(c.AMOUNT_TOKENS)} THEN 0.9 WHEN kind = 'DECIMAL' AND lo >= 0 AND hi < 10000000 THEN 0.68 ELSE 0 END"),
    ("COUNT", f"CASE WHEN kind = 'INTEGER' AND {_HAS(c.COUNT_TOKENS)} THEN 0.88 ELSE 0 END"),
    ("DATE", "CASE WHEN dated >= 0.9 THEN 0.85 WHEN dated >= 0.7 THEN 0.65 ELSE 0 END"),
    ("STATUS", f"CASE WHEN kind = 'TEXT' AND {_FEW} THEN 0.72 + CASE WHEN {_HAS(c.STATUS_TOKENS)} THEN 0.12 ELSE 0 END ELSE 0 END"),
    ("CODE", f"CASE WHEN {_FEW} AND kind IN ('TEXT', 'INTEGER') AND NOT key AND NOT {_HAS(c.ID_ANYWHERE)} THEN CASE WHEN {_HAS(c.CODE_TOKENS)} THEN 0.82 ELSE 0.62 END ELSE 0 END"),
    ("FLAG", f"CASE WHEN kind = 'INTEGER' AND d = 2 AND {_HAS(c.FLAG_PREFIXES)} THEN 0.96 WHEN kind = 'INTEGER' AND d = 2 THEN 0.88 WHEN {_HAS(c.FLAG_PREFIXES)} THEN 0.8 ELSE 0 END"),
    ("NAME", "CASE WHEN kind = 'TEXT' AND pii AND list_contains(w, 'name') THEN 0.82 ELSE 0 END"),
    ("TEXT", "CASE WHEN kind = 'TEXT' THEN 0.42 ELSE 0 END"),
)


@add(
    "WITH a AS ("
    + " UNION ALL ".join(_profile_sql(name, sql, kind) for name, _, sql, kind in _CONTACTS)
    + f"), b AS (SELECT *, {_SPLIT.format(c='column_name')} AS w, CASE WHEN n > 0 THEN {_TIER} END AS tier FROM a), e AS (SELECT *, coalesce({_PII}, false) AS pii FROM b), f AS ("
    + " UNION ALL ".join(f"SELECT column_name, '{kind}' AS semantic_type, CAST(coalesce({score}, 0) AS DOUBLE) AS score, {k} AS place FROM e" for k, (kind, score) in enumerate(_SCORES))
    + "), g AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY score DESC, place) AS r FROM f WHERE score > 0) "
    "SELECT column_name, max(semantic_type) FILTER (r = 1) AS semantic_type, round(max(score), 4) AS confidence, coalesce(string_agg(semantic_type, ',' ORDER BY r) FILTER (r > 1 AND score >= 0.4), '') AS competing FROM g GROUP BY 1"
)
def column_semantic_types(spark, d):
    df = table(spark, d, "customer").select(*[F.expr(e).alias(name) for name, e, _, _ in _CONTACTS])
    texts = [name for name, _, _, kind in _CONTACTS if kind == "TEXT"]
    stats = p.column_stats(df).withColumnRenamed("logical_type", "data_type")
    rates = p.pattern_rates(df, texts).select("column_name", *[(F.col(k) / 100).alias(k) for k in ("email_rate", "phone_rate", "guid_rate", "numeric_rate", "date_rate")])
    known = stats.join(rates, "column_name", "left").withColumns({
        "cardinality": cardinality_tier(F.col("distinct_values"), F.col("populated")),
        "is_primary_key": F.col("column_name") == "customer_id",
        "pii_name": s.pii_tier(F.col("column_name"), F.col("data_type")) > 0,
    })
    return c.classify_columns(known).select("column_name", "semantic_type", "confidence", F.array_join("competing", ",").alias("competing"))


_KINDS = "CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'INTEGER' WHEN data_type IN ('FLOAT', 'DOUBLE') THEN 'DECIMAL' WHEN data_type = 'VARCHAR' THEN 'TEXT' WHEN data_type LIKE 'TIMESTAMP%' THEN 'DATETIME' ELSE 'OTHER' END"
_ROW_TIER = "CASE WHEN n = 0 THEN 'EMPTY' WHEN n < 1000 THEN 'TINY' WHEN n < 100000 THEN 'SMALL' WHEN n < 1000000 THEN 'MEDIUM' WHEN n < 10000000 THEN 'LARGE' ELSE 'VERY_LARGE' END"
_AGES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
_AGE = "CASE WHEN latest IS NULL THEN 'UNKNOWN' WHEN date_diff('day', latest, DATE '2001-12-01') < 30 THEN 'ACTIVE' WHEN date_diff('day', latest, DATE '2001-12-01') <= 180 THEN 'RECENT' ELSE 'HISTORICAL' END"


@add(
    "WITH a AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, {f'CAST(max({_AGES[t]}) AS DATE)' if t in _AGES else 'CAST(NULL AS DATE)'} AS latest FROM {t}" for t in _TABLES)
    + f"), k AS (SELECT table_name, kind, {_SPLIT.format(c='column_name')} AS w FROM (SELECT table_name, column_name, {_KINDS} AS kind FROM duckdb_columns() WHERE table_name IN ({_NAMED}))), "
    f"f AS (SELECT table_name, bool_or(kind = 'DATETIME') AS dated, count(*) FILTER (kind IN ('INTEGER', 'DECIMAL') AND {_HAS(c.AMOUNT_TOKENS)}) AS amounts FROM k GROUP BY 1), "
    f"g AS (SELECT a.table_name, {_ROW_TIER} AS tier, {_AGE} AS age, dated, amounts, {_SPLIT.format(c='a.table_name')} AS w, (SELECT count(*) FROM {_LINK_SQL} WHERE e.a = a.table_name) AS fk, (SELECT count(*) FROM {_LINK_SQL} WHERE e.b = a.table_name) AS refs FROM a JOIN f ON a.table_name = f.table_name), "
    f"h AS (SELECT *, CASE WHEN {_HAS(c.AUDIT_TOKENS)} THEN 0.58 + 0.08 * CAST(refs = 0 AS INTEGER) + 0.05 * CAST(dated AS INTEGER) + 0.15 * CAST(age = 'ACTIVE' AND tier IN ('LARGE', 'VERY_LARGE') AS INTEGER) ELSE 0 END AS audit, "
    f"CASE WHEN dated AND fk >= 1 AND {_HAS(c.TRANSACTIONAL_TOKENS)} THEN 0.42 + 0.22 * CAST(age = 'ACTIVE' AS INTEGER) + 0.18 * CAST(tier IN ('MEDIUM', 'LARGE', 'VERY_LARGE') AS INTEGER) + 0.15 * CAST(amounts >= 1 AS INTEGER) + 0.12 * CAST(fk >= 2 AS INTEGER) ELSE 0 END AS deals, "
    f"CASE WHEN refs >= 1 AND {_HAS(c.MASTER_TOKENS)} THEN 0.42 + 0.18 * CAST(refs BETWEEN 4 AND 9 AS INTEGER) + 0.15 + 0.06 * CAST(age = 'ACTIVE' AS INTEGER) + 0.05 * CAST(tier IN ('SMALL', 'MEDIUM') AS INTEGER) ELSE 0 END AS master FROM g) "
    "SELECT table_name, CASE WHEN greatest(audit, deals, master) = 0 THEN 'Unknown' WHEN audit >= greatest(deals, master) THEN 'Audit' WHEN deals >= master THEN 'Transactional' ELSE 'Master' END AS table_class, round(CAST(greatest(audit, deals, master) AS DOUBLE), 4) AS confidence FROM h"
)
def table_classes(spark, d):
    tables = {t: table(spark, d, t) for t in _TABLES}
    columns = catalog_columns(spark, tables).select("table_name", "column_name", F.col("logical_type").alias("data_type"))
    features = c.table_features(c.classify_columns(columns))
    sizes = None
    for name, df in tables.items():
        latest = F.to_date(F.max(_AGES[name])) if name in _AGES else F.lit(None).cast("date")
        one = df.agg(F.count(F.lit(1)).alias("n"), latest.alias("latest")).select(F.lit(name).alias("table_name"), "n", "latest")
        sizes = one if sizes is None else sizes.unionByName(one)
    links = spark.createDataFrame(_LINKS, "a string, b string")
    out = links.groupBy(F.col("a").alias("table_name")).agg(F.count(F.lit(1)).alias("fk_count"))
    into = links.groupBy(F.col("b").alias("table_name")).agg(F.count(F.lit(1)).alias("referenced_by"))
    known = features.join(sizes, "table_name").join(out, "table_name", "left").join(into, "table_name", "left")
    known = known.withColumns({"row_tier": row_tier(F.col("n")), "currency": currency(F.col("latest"), F.lit("2001-12-01").cast("date")), "has_identity": F.lit(True), "is_junction": F.lit(False), "completeness": F.lit(None).cast("double")})
    return c.classify_tables(known).select("table_name", "table_class", "confidence")


#: Two states of a classification of customers, some not in one of them.
_STATES = "before AS (SELECT c_name AS table_name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS v FROM customer WHERE c_custkey % 5 <> 0), after AS (SELECT c_name AS table_name, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_acctbal > 5000 THEN 'MOVED' ELSE c_mktsegment END END AS v FROM customer WHERE c_custkey % 3 <> 0)"


def _states(spark, d):
    t = table(spark, d, "customer")
    v = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    w = F.when(F.col("c_custkey") % 7 != 0, F.when(F.col("c_acctbal") > 5000, "MOVED").otherwise(F.col("c_mktsegment")))
    return t.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("table_name"), v.alias("value")), t.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("table_name"), w.alias("value"))


@add(f"WITH {_STATES} SELECT coalesce(b.table_name, a.table_name) AS table_name, CASE WHEN b.table_name IS NULL THEN 'added' WHEN a.table_name IS NULL THEN 'removed' ELSE 'modified' END AS change FROM before b FULL JOIN after a ON b.table_name = a.table_name WHERE b.table_name IS NULL OR a.table_name IS NULL OR a.v IS DISTINCT FROM b.v")
def classification_diff(spark, d):
    before, after = (x.withColumnRenamed("value", "table_class") for x in _states(spark, d))
    return lifecycle.classification_diff(before, after)


@add(
    f"WITH {_STATES} SELECT 'domain.assignment' AS object_type, a.table_name, '' AS column_name, 'changed from ' || b.v || ' to ' || coalesce(a.v, 'nothing') AS signal FROM before b JOIN after a ON a.table_name = b.table_name WHERE b.v IS NOT NULL AND a.v IS DISTINCT FROM b.v "
    "UNION ALL SELECT 'pii.new', a.table_name, 'c', 'pii_risk flagged' FROM after a LEFT JOIN before b ON a.table_name = b.table_name WHERE a.v = 'MOVED' AND NOT coalesce(b.v = 'BUILDING', false) "
    "UNION ALL SELECT 'schema.drift', b.table_name, '', 'table removed' FROM before b LEFT JOIN after a ON a.table_name = b.table_name WHERE a.table_name IS NULL"
)
def impact_items(spark, d):
    before, after = _states(spark, d)
    pii = lambda x, value: x.select("table_name", F.lit("c").alias("column_name"), (F.col("value") == value).alias("pii"))
    gone = lifecycle.classification_diff(*(x.withColumnRenamed("value", "table_class") for x in (before, after))).filter("change = 'removed'")
    drift = lifecycle.drift_items(gone.select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("table_removed").alias("change")))
    return lifecycle.reclassified(before, after, "domain.assignment").unionByName(lifecycle.new_pii(pii(before, "BUILDING"), pii(after, "MOVED"))).unionByName(drift)


_RULES = ((1, "PREFIX", "BUILDING"), (2, "PREFIX", "FURNITURE"), (3, "TOKEN", "MACHINERY"), (4, "TOKEN", "nothing"))


@add(
    "WITH a AS (SELECT c_mktsegment AS pattern, CASE WHEN c_custkey % 9 = 0 THEN 'Unknown' ELSE c_mktsegment END AS domain, 0.4 + (c_custkey % 50) / 100.0 AS confidence, c_nationkey AS generic, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 END AS rule_id FROM customer), "
    "m AS (SELECT rule_id, count(*) AS n, round(avg(confidence), 3) AS mean, count(DISTINCT generic) AS spread FROM a WHERE rule_id IS NOT NULL GROUP BY 1), t AS (SELECT count(*) FILTER (domain <> 'Unknown') AS assigned FROM a), "
    "r AS (SELECT unnest([1, 2, 3, 4]) AS rule_id), j AS (SELECT r.rule_id, coalesce(n, 0) AS tables_matched, coalesce(mean, 0) AS confidence_avg, coalesce(spread, 0) AS unique_generic_domains, coalesce(n, 0) / assigned AS s FROM r LEFT JOIN m ON r.rule_id = m.rule_id CROSS JOIN t) "
    "SELECT CAST(rule_id AS INTEGER) AS rule_id, tables_matched, CAST(confidence_avg AS DOUBLE) AS confidence_avg, unique_generic_domains, round(s, 6) AS share, concat_ws(',', CASE WHEN tables_matched > 100 THEN 'high_coverage' END, CASE WHEN unique_generic_domains > 3 THEN 'domain_spread' END, CASE WHEN tables_matched > 0 AND confidence_avg < 0.6 THEN 'low_confidence' END, CASE WHEN s > 0.25 THEN 'high_share' END) AS flags FROM j"
)
def domain_rule_quality(spark, d):
    t = table(spark, d, "customer")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "TOKEN").otherwise("PREFIX")
    mark = F.concat(F.lit("learned rule ["), kind, F.lit("] '"), "c_mktsegment", F.lit("' of a segment"))
    rows = t.select(F.col("c_name").alias("table_name"), F.when(F.col("c_custkey") % 9 == 0, "Unknown").otherwise(F.col("c_mktsegment")).alias("domain"), (0.4 + (F.col("c_custkey") % 50) / 100.0).alias("confidence"), F.array(F.lit("seen"), mark).alias("evidence"), F.col("c_nationkey").alias("generic_domain"))
    rules = spark.createDataFrame(list(_RULES), "rule_id int, pattern_type string, pattern_value string")
    return lifecycle.rule_quality(rules, rows).withColumn("flags", F.array_join("flags", ","))
