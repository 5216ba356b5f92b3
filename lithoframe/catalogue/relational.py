"""Projection, filters, joins, aggregation, windows, sorting and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import make_date, named_range
from ..operators.analytics import leader_gap, period_over_period, row_budget, share_of_total
from ..plans import guard
from ..plans.joins import Relation, star
from ..plans.spec import Condition, Derived, Edge, Field, Order, QuerySpec, build, entity_list, mask, multi_entity
from ..sources.scans import head, register, sample_rows, table
from ..sources.sinks import insert_ignore, latest_per_key, upsert
from .registry import Registry

add = Registry()
QUERIES, SQL = add.queries, add.sql

#: Foreign keys of the test tables.
RELATIONS = [
    Relation("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relation("orders", "o_custkey", "customer", "c_custkey"),
    Relation("customer", "c_nationkey", "nation", "n_nationkey"),
    Relation("supplier", "s_nationkey", "nation", "n_nationkey"),
    Relation("nation", "n_regionkey", "region", "r_regionkey"),
    Relation("lineitem", "l_partkey", "part", "p_partkey"),
    Relation("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
CONFIRMED = {(r.from_table, r.from_column, r.to_table, r.to_column) for r in RELATIONS}
AS_OF = date(2001, 8, 1)


def tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


def sales(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order's date, customer's region and the net price."""
    t = tables(spark, d, "lineitem", "orders", "customer", "nation", "region")
    df = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    df = df.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return df.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@add("SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY revenue DESC LIMIT 5")
def revenue_by_region_top(spark, d):
    return sales(spark, d).groupBy("r_name").agg(F.round(F.sum("net"), 2).alias("revenue")).orderBy(F.desc("revenue"), "r_name").limit(5)


@add("SELECT r_name, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def planned_star_join(spark, d):
    edges = star([r for r in RELATIONS if r.from_table not in ("lineitem", "supplier")], "orders", ["region"])
    spec = QuerySpec("orders", [Field("region", "r_name"), Field("orders", "o_orderkey", "COUNT", "orders", distinct=True)], joins=edges)
    return build(spec, tables(spark, d, "orders", "customer", "nation", "region"))


@add("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority <> '5-LOW' AND o_orderpriority LIKE '%-H%'", also="orders_filters_mixed_all")
def orders_filters_mixed(spark, d):
    where = [Condition("orders", "o_orderstatus", "IN", ["O", "F"]), Condition("orders", "o_totalprice", "BETWEEN", [1000, 90000]), Condition("orders", "o_orderpriority", "!=", "5-LOW"), Condition("orders", "o_orderpriority", "LIKE", "%-H%"), Condition("orders", "o_orderkey", "IS NOT NULL")]
    return build(QuerySpec("orders", [Field("orders", c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")], where=where), tables(spark, d, "orders"))


def _by_grain(grain: str, part: str):
    @add(f"SELECT CAST({part} AS INTEGER) AS o_order_{grain}, count(*) AS row_count FROM orders GROUP BY 1")
    def query(spark, d):
        spec = QuerySpec("orders", [Field("orders", "o_orderdate", grain=grain, alias=f"o_order_{grain}"), Field("orders", None, "COUNT")])
        return build(spec, tables(spark, d, "orders"))

    name = f"orders_by_{grain}"
    QUERIES[name], SQL[name] = QUERIES.pop("query"), SQL.pop("query")


for _grain, _part in (("year", "year(o_orderdate)"), ("quarter", "quarter(o_orderdate)"), ("month", "month(o_orderdate)"), ("week", "week(o_orderdate)"), ("day", "day(o_orderdate)")):
    _by_grain(_grain, _part)


@add("SELECT CASE WHEN o_totalprice < 20000 THEN 'small' WHEN o_totalprice < 100000 THEN 'medium' ELSE 'large' END AS size_label, count(*) AS n FROM orders GROUP BY 1")
def order_size_case(spark, d):
    label = F.when(F.col("o_totalprice") < 20000, "small").when(F.col("o_totalprice") < 100000, "medium").otherwise("large")
    return table(spark, d, "orders").groupBy(label.alias("size_label")).agg(F.count(F.lit(1)).alias("n"))


@add("SELECT CASE WHEN u IS NULL AND p IS NOT NULL THEN 'paid only' WHEN p IS NULL AND u IS NOT NULL THEN 'open only' ELSE 'Other' END AS kind, count(*) AS row_count FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS p, CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS u FROM orders) GROUP BY 1")
def derived_category_count(spark, d):
    o = table(spark, d, "orders").select(F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS p"), F.expr("CASE WHEN o_orderstatus = 'O' THEN o_orderkey END AS u"))
    kind = Field("t", alias="kind", derived=Derived((("u", "p", "paid only"), ("p", "u", "open only"))))
    return build(QuerySpec("t", [kind, Field("t", None, "COUNT")]), {"t": o})


@add("SELECT count(DISTINCT o_custkey) AS customers FROM orders")
def distinct_customers_with_orders(spark, d):
    return build(QuerySpec("orders", [Field("orders", "o_custkey", "COUNT", "customers", distinct=True)]), tables(spark, d, "orders"))


@add("SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def fanout_safe_customer_count(spark, d):
    edge = Relation("orders", "o_custkey", "customer", "c_custkey", rows_ratio=10).turned().edge()
    spec = QuerySpec("customer", [Field("customer", "c_mktsegment"), Field("customer", "c_custkey", "COUNT", "customers", distinct=True)], joins=[edge])
    return build(spec, tables(spark, d, "customer", "orders"))


@add("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON c_custkey = o_custkey GROUP BY 1")
def customers_left_orders(spark, d):
    t = tables(spark, d, "customer", "orders")
    many = t["orders"].filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return t["customer"].join(many, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@add("SELECT coalesce(a.k, b.k) AS nationkey, a.n AS suppliers, b.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 5000 GROUP BY 1) b ON a.k = b.k")
def full_join_supplier_customer_nation(spark, d):
    t = tables(spark, d, "supplier", "customer")
    a = t["supplier"].filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = t["customer"].filter("c_acctbal < 5000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "nationkey", "full")


@add("SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 10")
def right_join_regions(spark, d):
    t = tables(spark, d, "nation", "region")
    edge = Edge("nation", "n_regionkey", "region", "r_regionkey", "RIGHT")
    return build(QuerySpec("nation", [Field("nation", "n_name"), Field("region", "r_name")], joins=[edge]), t | {"nation": t["nation"].filter("n_nationkey < 10")})


@add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-06-01')")
def customers_without_orders_since(spark, d):
    t = tables(spark, d, "customer", "orders")
    return t["customer"].join(t["orders"].filter("o_orderdate >= timestamp '2000-06-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@add("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def customers_with_orders(spark, d):
    register(spark, d, ("customer", "orders"))
    return guard.run(spark, "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", CONFIRMED, max_rows=None)


@add("SELECT count(*) AS frequent_parts FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30)")
def having_frequent_parts(spark, d):
    spec = QuerySpec("lineitem", [Field("lineitem", "l_partkey"), Field("lineitem", None, "COUNT")], having=[("row_count", ">=", 30)])
    return build(spec, tables(spark, d, "lineitem")).agg(F.count(F.lit(1)).alias("frequent_parts"))


@add("SELECT n_name, direction FROM (SELECT DISTINCT c_nationkey AS k, 'customer' AS direction FROM customer UNION ALL SELECT DISTINCT s_nationkey, 'supplier' FROM supplier) JOIN nation ON k = n_nationkey")
def union_tagged_nations(spark, d):
    t = tables(spark, d, "customer", "supplier", "nation")
    a = t["customer"].select(F.col("c_nationkey").alias("k")).distinct().withColumn("direction", F.lit("customer"))
    b = t["supplier"].select(F.col("s_nationkey").alias("k")).distinct().withColumn("direction", F.lit("supplier"))
    return a.unionAll(b).join(t["nation"], F.col("k") == F.col("n_nationkey")).select("n_name", "direction")


_SETS = {
    "union_nations": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
    "except_nations": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "intersect_nations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
}


def _raw(name: str, sql: str, *views: str, confirmed=None, also=None):
    """A guarded SQL statement that reads alike in both dialects."""

    def query(spark, d):
        register(spark, d, views)
        return guard.run(spark, sql, confirmed, max_rows=None)

    query.__name__ = name
    add(sql, also=also)(query)


for _name, _sql in _SETS.items():
    _raw(_name, _sql, "customer", "supplier")
_raw("cte_top_segments", "WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, n FROM s WHERE n > (SELECT avg(n) FROM s)", "customer")
_raw("correlated_average", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > 1.9 * (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)", "orders")
_raw("window_rank_customers", "SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer", "customer")
_raw("running_order_count", "SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS so_far FROM orders", "orders")
_raw("lateral_largest_order", "SELECT c.c_custkey, x.o_orderkey FROM customer c, LATERAL (SELECT max(o.o_orderkey) AS o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey) x", "customer", "orders", also="lateral_largest_order_all")
_raw("guarded_join_count", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "customer", "nation", confirmed=CONFIRMED)


@add("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) WHERE p = 1")
def latest_order_per_customer(spark, d):
    return latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_of_orders(spark, d):
    spec = QuerySpec("orders", [Field("orders", "o_orderkey"), Field("orders", "o_custkey")], order_by=[Order("o_orderkey", False)], limit=50, offset=100)
    return build(spec, tables(spark, d, "orders"))


@add("SELECT c_mktsegment, round(sum(o_totalprice), 2) AS value, round(100 * sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def share_of_total_by_segment(spark, d):
    t = tables(spark, d, "orders", "customer")
    g = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("o_totalprice").alias("value"))
    return share_of_total(g, "value").select("c_mktsegment", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))


@add("SELECT n_name AS leader, n AS leader_value, n2 AS runner_up, gap FROM (SELECT n_name, count(*) AS n, lead(n_name) OVER (ORDER BY count(*) DESC, n_name) AS n2, count(*) - lead(count(*)) OVER (ORDER BY count(*) DESC, n_name) AS gap FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 1)")
def leader_gap_by_nation(spark, d):
    t = tables(spark, d, "customer", "nation")
    return leader_gap(t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")), "n_name", "n")


@add("SELECT month, n, lag(n) OVER (ORDER BY month) AS previous, round(100.0 * (n - lag(n) OVER (ORDER BY month)) / nullif(lag(n) OVER (ORDER BY month), 0), 6) AS change_percent FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)")
def monthly_orders_pop_change(spark, d):
    g = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return period_over_period(g, "month", "n").withColumn("change_percent", F.round("change_percent", 6))


@add("SELECT o_orderkey, strftime(make_date(year(o_orderdate), month(o_orderdate), 1), '%Y-%m-%d') AS month_start FROM orders", also="synthesized_dates_all")
def synthesized_dates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", make_date(F.year("o_orderdate"), F.month("o_orderdate")).cast("string").alias("month_start"))


@add("SELECT c_custkey, '***' AS c_name, c_mktsegment FROM customer", also="masked_customers_all")
def masked_customers(spark, d):
    return mask(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name"})


@add("SELECT s_suppkey, s_nationkey FROM supplier LIMIT 1000")
def safe_entity_list(spark, d):
    return build(entity_list("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], {"s_name", "s_acctbal"}), tables(spark, d, "supplier"))


@add("SELECT n_name AS nation__n_name, r_name AS region__r_name FROM nation JOIN region ON n_regionkey = r_regionkey LIMIT 1000")
def multi_entity_list(spark, d):
    return build(multi_entity("nation", [RELATIONS[4].edge()], {"nation": ["n_name"], "region": ["r_name"]}), tables(spark, d, "nation", "region"))


@add("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def distinct_priorities(spark, d):
    return build(QuerySpec("orders", [Field("orders", "o_orderpriority"), Field("orders", "o_orderstatus")], distinct=True), tables(spark, d, "orders"))


@add("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, count(DISTINCT o_custkey) AS c, count(*) FILTER (o_totalprice > 100000) AS big FROM orders GROUP BY 1")
def multi_measure_kpi(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("s"), F.round(F.avg("o_totalprice"), 4).alias("a"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c"), F.count_if(F.col("o_totalprice") > 100000).alias("big"))


@add("SELECT sum(o_totalprice) AS s, count(*) AS n, coalesce(sum(o_totalprice), 0) AS z FROM orders WHERE o_totalprice < -1")
def empty_global_aggregate(spark, d):
    return table(spark, d, "orders").filter("o_totalprice < -1").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("z"))


@add("SELECT round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS avg_days, max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS max_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def shipping_delay(spark, d):
    t = tables(spark, d, "lineitem", "orders")
    days = F.datediff("l_shipdate", "o_orderdate")
    return t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).agg(F.round(F.avg(days), 6).alias("avg_days"), F.max(days).cast("bigint").alias("max_days"))


@add("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-08-01'")
def last_month_orders(spark, d):
    start, end = named_range("last month", AS_OF)
    return table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit(start)) & (F.col("o_orderdate") < F.date_add(F.lit(end), 1))).agg(F.count(F.lit(1)).alias("n"))


@add("SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND (p_type LIKE '%S%' OR p_brand LIKE '%1%')")
def like_block_parts(spark, d):
    has = lambda c, t: F.col(c).contains(t)
    return table(spark, d, "part").filter(has("p_name", "a") & (has("p_type", "S") | has("p_brand", "1"))).select("p_partkey")


@add("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (1, 2, 3)")
def not_in_list(spark, d):
    return table(spark, d, "nation").filter(~F.col("n_nationkey").isin(1, 2, 3))


@add("SELECT c_nationkey, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def superlative_top_customers(spark, d):
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select("c_nationkey", "c_custkey")


@add("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def most_recent_orders(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10).select("o_orderkey")


@add("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS label FROM customer UNION ALL SELECT -1 - n_nationkey, 'new' FROM nation", also="upserted_customers_all")
def upserted_customers(spark, d):
    c = table(spark, d, "customer")
    fresh = table(spark, d, "nation").select((F.lit(-1) - F.col("n_nationkey")).cast("bigint").alias("c_custkey"), F.lit("new").alias("label"))
    return upsert(c.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("label")), c.filter("c_custkey % 3 = 0 or c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("label")).unionByName(fresh), ["c_custkey"])


@add("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'late' END AS label FROM customer", also="insert_ignored_customers_all")
def insert_ignored_customers(spark, d):
    c = table(spark, d, "customer")
    return insert_ignore(c.filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("label")), c.filter("c_custkey % 3 = 0 or c_custkey % 2 = 0").select("c_custkey", F.lit("late").alias("label")), ["c_custkey"])


@add("SELECT o_orderkey, o_custkey, total_chars FROM (SELECT o_orderkey, o_custkey, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR))) OVER (ORDER BY o_orderkey) AS BIGINT) AS total_chars FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)) WHERE total_chars <= 2000")
def budget_prefix(spark, d):
    rows = table(spark, d, "orders").orderBy("o_orderkey").limit(1000).select("o_orderkey", "o_custkey")
    return row_budget(rows, [F.col("o_orderkey")], 2000)


@add()
def head_of_customers(spark, d):
    """Which rows come first isn't fixed, so there is no SQL."""
    return head(table(spark, d, "customer"))


@add()
def sampled_orders(spark, d):
    """Rows chosen by a hash that SQL doesn't share."""
    return sample_rows(table(spark, d, "orders"), 5, 20, ["o_orderkey"]).select("o_orderkey")


@add("SELECT o_orderpriority, month, n FROM (SELECT o_orderpriority, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM orders i GROUP BY i.o_orderpriority, month(i.o_orderdate)))")
def busiest_priority_month(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.max("n").alias("n"))), "n").select("o_orderpriority", "month", "n")  # one row


@add("SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 15")
def window_count_customers(spark, d):
    return table(spark, d, "orders").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))).filter("n >= 15").select("o_custkey", "o_orderkey", "n")
