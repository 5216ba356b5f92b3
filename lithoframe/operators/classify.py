"""What a column holds and what a table is for, scored from names and profiles: every kind gets a confidence, the highest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import name_tokens

# Words of column names.
ID_ANYWHERE = ("id", "uuid", "guid", "pk", "fk")
ID_SUFFIX = ("id", "uuid", "guid", "pk", "fk", "key", "num", "no", "ref", "seq")
AMOUNT_TOKENS = (
    "amount", "amt", "price", "cost", "revenue", "balance", "total", "fee", "tax", "discount", "salary", "wage", "income", "earnings",
    "payment", "charge", "sum", "rate", "value", "val",
)
COUNT_TOKENS = ("count", "cnt", "qty", "quantity", "units", "volume", "size")
FLAG_PREFIXES = ("is", "has", "was", "can", "did", "will", "should")
STATUS_TOKENS = ("status", "state", "stage", "phase", "condition")
CODE_TOKENS = ("code", "cd", "type", "typ", "category", "class", "kind", "group", "grp")
PHONE_TOKENS = ("phone", "mobile", "cell", "tel", "fax", "pager")
SSN_TOKENS = ("ssn", "sin", "nino")
# Prefixes and words of table names, words of audit columns.
STAGING_PREFIXES = ("stg_", "tmp_", "temp_", "stage_", "import_", "load_", "bak_", "backup_", "arc_", "archive_", "old_")
STAGING_TOKENS = ("stg", "tmp", "temp", "stage", "import", "bak", "backup", "arc", "archive", "old", "test", "copy", "mock", "sample")
DATE_STAMP = r"_\d{6,8}$|_\d{4}[_\-]\d{2}"
REFERENCE_PREFIXES = ("ref_", "lkp_", "lookup_", "code_", "type_", "status_", "config_", "param_")
REFERENCE_TOKENS = (
    "ref", "lookup", "lkp", "code", "codes", "type", "types", "status", "statuses", "config", "param", "params",
    "setting", "settings", "option", "options", "category", "categories", "enum", "enums",
)
MASTER_TOKENS = (
    "student", "students", "customer", "customers", "client", "clients", "employee", "employees", "staff", "user", "users", "person", "people",
    "contact", "contacts", "account", "accounts", "member", "members", "alumni", "alumna", "graduate", "graduates", "applicant", "applicants",
    "patient", "patients", "vendor", "vendors", "supplier", "suppliers", "instructor", "faculty", "worker", "workers", "agent", "agents",
    "candidate", "candidates", "participant", "participants",
)
TRANSACTIONAL_TOKENS = (
    "order", "orders", "payment", "payments", "transaction", "transactions", "enrollment", "enrollments", "registration", "registrations",
    "charge", "charges", "invoice", "invoices", "receipt", "receipts", "purchase", "purchases", "sale", "sales", "booking", "bookings",
    "application", "applications", "request", "requests", "disbursement", "disbursements", "deposit", "deposits",
)
AUDIT_TOKENS = ("audit", "audits", "log", "logs", "history", "trail", "trails", "change", "changes", "event", "events", "activity", "activities", "tracking", "changelog", "changeset")
AUDIT_COLUMN_TOKENS = ("oldvalue", "newvalue", "before", "after", "actiontype", "changedby", "modifiedby", "action", "operation", "changedfield")
REPORTING_PREFIXES = ("fact_", "dim_", "report_", "summary_", "agg_", "rpt_", "kpi_", "metric_", "stats_", "snap_")
REPORTING_TOKENS = ("fact", "dim", "summary", "summaries", "aggregate", "agg", "report", "reports", "kpi", "metric", "metrics", "snapshot", "snapshots", "stat", "stats")
LEAST_COMPETING = 0.40

#: Columns of a column's profile; rates and shares are fractions, and null where nothing was measured.
COLUMN_PROFILE = (
    "column_name", "data_type", "is_primary_key", "is_identity", "pii_name", "email_rate", "phone_rate", "guid_rate", "numeric_rate", "date_rate",
    "uniqueness", "cardinality", "distinct_values", "min_value", "max_value", "min_length", "max_length", "top_coverage",
)


def _any(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


def _first(*cases: tuple[Column, float]) -> Column:
    """The score of the first condition that holds, else 0; a null condition doesn't hold."""
    out = F.when(cases[0][0], cases[0][1])
    for condition, score in cases[1:]:
        out = out.when(condition, score)
    return out.otherwise(0.0)


def _raised(start: Column, *bonuses: tuple[Column, float]) -> Column:
    """A score above 0 with what its bonuses add, 1 at most."""
    added = start
    for condition, points in bonuses:
        added = added + F.when(condition, points).otherwise(0.0)
    return F.when(start > 0, F.least(F.lit(1.0), added)).otherwise(0.0)


def _prefixed(name: Column, prefixes: tuple[str, ...]) -> Column:
    return name.rlike("^(" + "|".join(prefixes) + ")")


def _strongest(rows: DataFrame, scores: dict[str, Column], label: str, unknown: str) -> DataFrame:
    """The rows with the label of the highest score (ties: the one named first), its confidence, and the labels beside it that reach LEAST_COMPETING."""
    rated = F.array(*[F.struct(score.alias("confidence"), F.lit(-k).alias("place"), F.lit(name).alias("name")) for k, (name, score) in enumerate(scores.items())])
    best = F.get("__ranked", F.lit(0))
    others = F.filter(F.slice("__ranked", 2, len(scores)), lambda s: s["confidence"] >= LEAST_COMPETING)
    ranked = rows.withColumn("__ranked", F.sort_array(F.filter(rated, lambda s: s["confidence"] > 0), asc=False))
    return ranked.withColumns({label: F.coalesce(best["name"], F.lit(unknown)), "confidence": F.coalesce(F.round(best["confidence"], 4), F.lit(0.0)), "competing": F.transform(others, lambda s: s["name"])}).drop("__ranked")


def column_scores() -> dict[str, Column]:
    """The confidence of each semantic type, over the columns of COLUMN_PROFILE."""
    c = {name: F.col(name) for name in COLUMN_PROFILE}
    words, kind = name_tokens(F.coalesce("column_name", F.lit(""))), F.coalesce("data_type", F.lit("OTHER"))
    pii, key = F.coalesce("pii_name", F.lit(False)), F.coalesce("is_primary_key", F.lit(False))
    text, integer, is_id = kind == "TEXT", kind == "INTEGER", _any(words, ID_ANYWHERE)
    few = c["cardinality"].isin("BINARY", "LOW", "CONSTANT")
    low, high = c["min_value"].try_cast("double"), c["max_value"].try_cast("double")
    email, phone = c["email_rate"], c["phone_rate"]
    nine = (c["numeric_rate"] > 0.85) & c["min_length"].isin(9, 11) & c["max_length"].isin(9, 11)
    binary = integer & (c["cardinality"] == "BINARY") & (c["distinct_values"] <= 2)
    flagged = _any(words, FLAG_PREFIXES)
    return {
        "EMAIL": _first((email.isNull() & pii & F.array_contains(words, "email"), 0.55), (pii & (email >= 0.70), 0.95), (email >= 0.85, 0.90), (text & (email >= 0.50), 0.70)),
        "PHONE": _first((phone.isNull() & pii & _any(words, PHONE_TOKENS), 0.55), (pii & (phone >= 0.60), 0.90), (phone >= 0.75, 0.85)),
        "SSN": _first((_any(words, SSN_TOKENS), 0.92), (pii & text & nine, 0.80)),
        "ID": _first((key, 1.0), ((c["uniqueness"] >= 0.99) & c["is_identity"], 0.98), (c["guid_rate"] >= 0.90, 0.92), (is_id, 0.90), (c["cardinality"].isin("UNIQUE", "HIGH") & _any(words, ID_SUFFIX), 0.80)),
        "AMOUNT": _first((kind.isin("DECIMAL", "INTEGER") & _any(words, AMOUNT_TOKENS), 0.90), ((kind == "DECIMAL") & (low >= 0) & (high < 10_000_000), 0.68)),
        "COUNT": _first((integer & _any(words, COUNT_TOKENS), 0.88)),
        "DATE": _first((kind == "DATETIME", 1.0), (text & (c["date_rate"] >= 0.90), 0.85), (text & (c["date_rate"] >= 0.70), 0.65)),
        "STATUS": _raised(_first((few & text, 0.72)), (_any(words, STATUS_TOKENS), 0.12), (c["top_coverage"] >= 0.95, 0.05)),
        "CODE": F.when(few & kind.isin("TEXT", "INTEGER") & ~key & ~is_id, F.when(_any(words, CODE_TOKENS), 0.82).otherwise(0.62)).otherwise(0.0),
        "FLAG": _first((kind == "BOOLEAN", 1.0), (binary & flagged, 0.96), (binary, 0.88), (flagged, 0.80)),
        "NAME": _first((text & pii & F.array_contains(words, "name"), 0.82)),
        "TEXT": _first((text, 0.42)),
        "BINARY": _first((kind == "BINARY", 1.0)),
    }


def classify_columns(profile: DataFrame) -> DataFrame:
    """The rows of a profile (COLUMN_PROFILE; absent columns count as not measured) with semantic_type, confidence and competing; UNKNOWN where nothing speaks for a type."""
    types = {"column_name": "string", "data_type": "string", "is_primary_key": "boolean", "is_identity": "boolean", "pii_name": "boolean", "cardinality": "string", "min_value": "string", "max_value": "string"}
    absent = {c: F.lit(None).cast(types.get(c, "double")) for c in COLUMN_PROFILE if c not in profile.columns}
    full = profile.withColumns(absent) if absent else profile
    return _strongest(full, column_scores(), "semantic_type", "UNKNOWN").drop(*absent)


def table_features(columns: DataFrame) -> DataFrame:
    """table_name, n_columns, has_date, n_name, n_amount, n_count, n_status, audit_columns of typed columns (classify_columns with table_name)."""
    of = lambda kind: F.count_if(F.col("semantic_type") == kind)
    return columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.coalesce(F.bool_or(F.col("data_type") == "DATETIME"), F.lit(False)).alias("has_date"),
        *[of(k.upper()).alias(f"n_{k}") for k in ("name", "amount", "count", "status")],
        F.coalesce(F.bool_or(_any(name_tokens(F.col("column_name")), AUDIT_COLUMN_TOKENS)), F.lit(False)).alias("audit_columns"),
    )


def table_scores() -> dict[str, Column]:
    """The confidence of each table class; see classify_tables."""
    words, lower = name_tokens(F.coalesce("table_name", F.lit(""))), F.lower(F.coalesce("table_name", F.lit("")))
    tier, age, keys, uses = F.col("row_tier"), F.col("currency"), F.coalesce("fk_count", F.lit(0)), F.coalesce("referenced_by", F.lit(0))
    identity, junction, date = (F.coalesce(c, F.lit(False)) for c in ("has_identity", "is_junction", "has_date"))
    big = tier.isin("LARGE", "VERY_LARGE")
    small = tier.isNull() | tier.isin("EMPTY", "TINY", "SMALL")
    metrics = (F.col("n_amount") + F.col("n_count")) / F.nullif(F.col("n_columns").cast("double"), F.lit(0.0))
    staging = _first((_prefixed(lower, STAGING_PREFIXES), 0.68), (lower.rlike(DATE_STAMP), 0.62), (_any(words, STAGING_TOKENS), 0.55))
    reference = _first((~small | (F.col("n_columns") > 8), 0.0), (_prefixed(lower, REFERENCE_PREFIXES), 0.52), (_any(words, REFERENCE_TOKENS), 0.45))
    reporting = _first((_prefixed(lower, REPORTING_PREFIXES), 0.58), (_any(words, REPORTING_TOKENS), 0.50))
    dated = date & ((keys >= 1) | junction)
    return {
        "Staging": _raised(staging, (tier == "EMPTY", 0.15), ((keys == 0) & (uses == 0), 0.10), (age == "HISTORICAL", 0.08)),
        "Reference": _raised(reference, (uses >= 5, 0.30), (uses.between(2, 4), 0.15), (keys == 0, 0.10), (age == "HISTORICAL", 0.08)),
        "Audit": _raised(_first((_any(words, AUDIT_TOKENS), 0.58)), (F.col("audit_columns"), 0.25), ((age == "ACTIVE") & big, 0.15), (uses == 0, 0.08), (date, 0.05)),
        "Reporting": _raised(reporting, (metrics >= 0.30, 0.20), (keys >= 4, 0.18), (~identity, 0.08)),
        "Transactional": _raised(_first((dated & junction, 0.52), (dated & _any(words, TRANSACTIONAL_TOKENS), 0.42)), (age == "ACTIVE", 0.22), (big | (tier == "MEDIUM"), 0.18), (F.col("n_amount") >= 1, 0.15), (keys >= 2, 0.12), (F.col("n_status") >= 1, 0.08)),
        "Master": _raised(_first((~junction & (uses >= 1) & _any(words, MASTER_TOKENS), 0.42)), (uses >= 10, 0.30), (uses.between(4, 9), 0.18), (identity, 0.15), (F.col("n_name") >= 1, 0.12), (F.col("completeness") >= 0.85, 0.08), (age == "ACTIVE", 0.06), (tier.isin("SMALL", "MEDIUM"), 0.05)),
    }


def classify_tables(features: DataFrame) -> DataFrame:
    """The rows with table_class, confidence and competing.

    ``features``: those of table_features, and row_tier, currency, fk_count, referenced_by,
    has_identity, is_junction, completeness (a fraction). Null row_tier, currency and
    completeness speak for nothing, null counts are 0, null booleans are false.
    """
    return _strongest(features, table_scores(), "table_class", "Unknown")
