"""Column types, table classes, changes and rules on small cases: nulls, ties, empty tables, columns that are not there."""

from pyspark.sql import functions as F

from lithoframe.operators import classify, lifecycle
from lithoframe.plans.joins import join_quality


def kinds(spark, rows, schema):
    return {r.column_name: (r.semantic_type, r.confidence, list(r.competing)) for r in classify.classify_columns(spark.createDataFrame(rows, schema)).collect()}


def test_types_without_any_measure(spark):
    got = kinds(spark, [("created", "DATETIME"), ("blob", "BINARY"), ("thing", "OTHER"), ("paid", "BOOLEAN"), ("note", "TEXT"), (None, None), ("", "TEXT")], "column_name string, data_type string")
    assert got["created"][:2] == ("DATE", 1.0) and got["blob"][:2] == ("BINARY", 1.0) and got["paid"][:2] == ("FLAG", 1.0)
    assert got["thing"] == got[None] == ("UNKNOWN", 0.0, []) and got["note"] == got[""] == ("TEXT", 0.42, [])


def test_ties_go_to_the_type_named_first(spark):
    # An id with an amount's word: both 0.90.
    assert kinds(spark, [("payment_id", "INTEGER")], "column_name string, data_type string")["payment_id"] == ("ID", 0.9, ["AMOUNT"])


def test_email_rates(spark):
    rows = [("a", "TEXT", True, 0.7), ("b", "TEXT", False, 0.85), ("c", "TEXT", False, 0.5), ("d", "OTHER", False, 0.5), ("user_email", "TEXT", True, None)]
    got = kinds(spark, rows, "column_name string, data_type string, pii_name boolean, email_rate double")
    assert [got[c][:2] for c in ("a", "b", "c", "d", "user_email")] == [("EMAIL", 0.95), ("EMAIL", 0.9), ("EMAIL", 0.7), ("UNKNOWN", 0.0), ("EMAIL", 0.55)]


def test_ssn_by_length_and_amount_by_range(spark):
    schema = "column_name string, data_type string, pii_name boolean, numeric_rate double, min_length int, max_length int, min_value string, max_value string"
    got = kinds(spark, [("number", "TEXT", True, 0.9, 9, 11, "1", "2"), ("x", "DECIMAL", False, None, None, None, "0.5", "100"), ("y", "DECIMAL", False, None, None, None, "-1", "100"), ("z", "DECIMAL", False, None, None, None, "a", None)], schema)
    assert got["number"][:2] == ("SSN", 0.8) and got["x"][:2] == ("AMOUNT", 0.68) and got["y"][0] == got["z"][0] == "UNKNOWN"


FEATURES = "table_name string, n_columns bigint, has_date boolean, n_name bigint, n_amount bigint, n_count bigint, n_status bigint, audit_columns boolean, row_tier string, currency string, fk_count int, referenced_by int, has_identity boolean, is_junction boolean, completeness double"


def test_table_classes(spark):
    rows = [
        ("stg_orders", 5, True, 0, 1, 0, 0, False, "EMPTY", "HISTORICAL", 0, 0, False, False, None),
        ("lookup_country", 3, False, 0, 0, 0, 0, False, "TINY", None, 0, 5, True, False, None),
        ("lookup_wide", 9, False, 0, 0, 0, 0, False, "TINY", None, 0, 5, True, False, None),
        ("Customers", 9, True, 1, 0, 0, 0, False, "MEDIUM", "ACTIVE", 0, 12, True, False, 0.9),
        ("order_items", 9, True, 0, 2, 0, 1, False, "LARGE", "ACTIVE", 2, 0, True, False, None),
        ("audit_log", 9, True, 0, 0, 0, 0, True, "LARGE", "ACTIVE", 0, 0, True, False, None),
        ("fact_sales", 10, True, 0, 3, 1, 0, False, "LARGE", None, 4, 0, False, False, None),
        ("thing", 2, None, 0, 0, 0, 0, False, None, None, None, None, None, None, None),
    ]
    got = {r.table_name: (r.table_class, r.confidence) for r in classify.classify_tables(spark.createDataFrame(rows, FEATURES)).collect()}
    assert got == {
        "stg_orders": ("Staging", 1.0), "lookup_country": ("Reference", 0.92), "lookup_wide": ("Unknown", 0.0), "Customers": ("Master", 1.0),
        "order_items": ("Transactional", 1.0), "audit_log": ("Audit", 1.0), "fact_sales": ("Reporting", 1.0), "thing": ("Unknown", 0.0),
    }


def test_empty_tables(spark):
    typed = classify.classify_columns(spark.createDataFrame([], "table_name string, column_name string, data_type string"))
    assert typed.columns == ["table_name", "column_name", "data_type", "semantic_type", "confidence", "competing"] and typed.count() == 0
    assert classify.table_features(typed).count() == 0 and classify.classify_tables(spark.createDataFrame([], FEATURES)).count() == 0
    states = spark.createDataFrame([], "table_name string, table_class string")
    assert lifecycle.classification_diff(states, states).count() == 0 and lifecycle.classification_diff(None, states).count() == 0


def test_changes_and_their_union(spark):
    state = lambda rows: spark.createDataFrame(rows, "table_name string, table_class string")
    before, after = state([("a", "Master"), ("b", None), ("c", None), ("gone", "Audit")]), state([("a", "Audit"), ("b", None), ("c", "Master"), ("new", None)])
    diff = lifecycle.classification_diff(before, after)
    assert {tuple(r) for r in diff.collect()} == {("a", "modified"), ("c", "modified"), ("gone", "removed"), ("new", "added")}
    assert {tuple(r) for r in lifecycle.classification_diff(None, after).collect()} == {(t, "added") for t in ("a", "b", "c", "new")}
    schema = spark.createDataFrame([("a", "modified"), ("old", "removed")], "table_name string, change string")
    assert sorted(map(tuple, lifecycle.merge_changes(schema, diff).collect())) == [("a", "modified"), ("c", "modified"), ("new", "added"), ("old", "removed")]


def test_review_items(spark):
    pii = lambda rows: spark.createDataFrame(rows, "table_name string, column_name string, pii boolean")
    got = lifecycle.new_pii(pii([("t", "a", True), ("t", "b", False), ("t", "c", None)]), pii([("t", "a", True), ("t", "b", True), ("t", "c", True), ("t", "d", True), ("t", "e", None)]))
    assert sorted(r.column_name for r in got.collect()) == ["b", "c", "d"]
    value = lambda rows: spark.createDataFrame(rows, "table_name string, value string")
    moved = lifecycle.reclassified(value([("t", "x"), ("u", None), ("v", "x")]), value([("t", "y"), ("u", "y"), ("v", "x"), ("w", "z")]), "entity.assignment").collect()
    assert [(r.object_type, r.table_name, r.signal) for r in moved] == [("entity.assignment", "t", "changed from x to y")]


def test_rules_without_matches_or_assignments(spark):
    rules = spark.createDataFrame([(1, "PREFIX", "edu"), (2, "TOKEN", "x")], "rule_id int, pattern_type string, pattern_value string")
    schema = "table_name string, domain string, confidence double, evidence array<string>, generic_domain string"
    none = {r.rule_id: r for r in lifecycle.rule_quality(rules, spark.createDataFrame([], schema)).collect()}
    assert none[1].tables_matched == 0 and none[1].share == 0.0 and none[1].flags == []
    rows = [(f"t{k}", "Ops", 0.5, ["other", "learned rule [PREFIX] 'edu' to Ops", "learned rule [TOKEN] 'x' to Ops"], None) for k in range(3)] + [("u", "Unknown", None, None, None)]
    some = {r.rule_id: r for r in lifecycle.rule_quality(rules, spark.createDataFrame(rows, schema)).collect()}
    assert (some[1].tables_matched, some[1].confidence_avg, some[1].flags) == (3, 0.5, ["low_confidence", "high_share"]) and some[2].tables_matched == 0


def test_join_quality(spark):
    df = spark.createDataFrame([(100, "MANY_TO_ONE", 100, 0, None, 2), (60, "MANY_TO_MANY", 0, 1, None, 0), (100, "ONE_TO_ONE", 100, 2, 1.0, 2), (0, None, None, None, None, None)], "c int, k string, s int, a int, d double, p int")
    assert [r[0] for r in df.select(join_quality(*map(F.col, ("c", "k", "s", "a", "d", "p")))).collect()] == [80, 46, 100, 15]
