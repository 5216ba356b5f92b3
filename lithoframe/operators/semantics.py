"""What a column's name, type and profile say about it: personal data, and whether it can be a KPI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name tokens and parts of names that tell personal data and secrets.
PII_TOKENS = (
    "email", "phone", "mobile", "cell", "fax", "pager", "ssn", "sin", "nino", "passport", "ein", "tin",
    "password", "passwd", "pwd", "passphrase", "secret", "credential", "credentials", "pin", "otp", "token",
    "cvv", "cvc", "iban", "pan", "dob", "gender", "sex", "race", "ethnicity", "nationality",
    "salary", "wage", "wages", "income", "earnings", "latitude", "longitude", "lat", "lng", "lon", "fname", "lname", "mname",
)
PII_PARTS = (
    "email", "phone", "mobile", "cellphone", "address", "streetaddr", "zipcode", "postalcode", "postcode", "passport", "socialsecurity", "nationalid",
    "drivinglicense", "driverslicense", "taxid", "taxnumber", "password", "passwd", "passphrase", "apikey", "secretkey", "privatekey", "accesskey",
    "authtoken", "accesstoken", "refreshtoken", "bearertoken", "jwttoken", "creditcard", "cardnumber", "cardnum", "ccnumber",
    "bankaccount", "bankacct", "accountnumber", "routingnumber", "ipaddress", "ipaddr", "macaddress", "macaddr", "geolocation", "gpscoord", "geocoord",
    "firstname", "lastname", "fullname", "middlename", "givenname", "familyname", "maidenname", "surname", "username",
    "birthdate", "dateofbirth", "birthday", "birthyear", "birthmonth", "salary", "income", "wage", "earnings", "compensation", "payrate", "payroll",
    "healthid", "medicalid", "insuranceid",
)
PERSONS = (
    "person", "individual", "human", "student", "instructor", "teacher", "professor", "employee", "staff", "user", "customer", "client", "contact", "member", "guest", "patient",
    "applicant", "candidate", "recruiter", "vendor", "supplier", "parent", "guardian", "spouse", "dependent", "beneficiary", "owner", "holder", "author", "creator", "signer", "agent",
    "representative", "nickname", "alias", "signatory", "attendee", "participant", "visitor", "subscriber",
)
SECRET_TOKENS = ("password", "passwd", "pwd", "passphrase", "secret", "credential", "credentials", "pin", "otp", "token", "cvv", "cvc")
SECRET_PARTS = (
    "drivinglicense", "driverslicense", "password", "passwd", "passphrase", "apikey", "secretkey", "privatekey", "accesskey",
    "authtoken", "accesstoken", "refreshtoken", "bearertoken", "jwttoken", "connectionstring", "connstring", "connstr",
    "securityanswer", "securityquestion", "encryptionkey", "masterkey",
)
# Least completeness of each metric role; other roles need 0.40.
LEAST_COMPLETE = {"MONEY": 0.50, "COUNT": 0.50}
DIMENSION_VALUES = (2, 500)
# Role, aggregation, label, format, priority, whether more is better, most cards.
METRIC_ROLES = (
    ("MONEY", "sum", "Total {col}", "currency", "executive", True, 3),
    ("MONEY", "mean", "Avg {col}", "currency", "executive", True, 1),
    ("COUNT", "sum", "Total {col}", "number", "operational", True, 2),
    ("COUNT", "mean", "Avg {col}", "decimal", "operational", True, 1),
    ("PERCENT", "mean", "Avg {col}", "percent", "operational", True, 1),
    ("RATIO", "mean", "Avg {col}", "percent", "operational", True, 1),
    ("SCORE", "mean", "Avg {col}", "decimal", "operational", True, 2),
    ("DURATION", "mean", "Avg {col}", "decimal", "operational", False, 1),
    ("DISTANCE", "mean", "Avg {col}", "decimal", "operational", True, 1),
    ("WEIGHT", "sum", "Total {col}", "number", "operational", True, 1),
    ("RISK", "mean", "Avg Risk: {col}", "decimal", "risk", False, 1),
    ("DIMENSION", "dominant", "Top {col}", "percent", "operational", True, 3),
    ("GENERIC_MEASURE", "mean", "Avg {col}", "decimal", "operational", True, 8),
)


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name, cut at case changes and punctuation; digits stay with their word."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda t: t != "")


def _any_part(collapsed: Column, parts: tuple[str, ...]) -> Column:
    return collapsed.rlike("|".join(parts))


def pii_tier(name: Column, logical_type: Column) -> Column:
    """0: none; 1: a token that always tells personal data; 2: such a part of the name; 3: a text column called name, or the name of a person."""
    tokens = name_tokens(name)
    at = F.array_position(tokens, "name")
    before = F.when(at > 1, F.element_at(tokens, (at - 1).cast("int")))
    named = (at > 0) & (logical_type == "TEXT") & (before.isNull() | before.isin(*PERSONS))
    tier = F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, PII_TOKENS))), 1).when(_any_part(F.array_join(tokens, ""), PII_PARTS), 2).when(named, 3).otherwise(0)
    return F.when(F.coalesce(name, F.lit("")) == "", 0).otherwise(tier)


def is_secret(name: Column) -> Column:
    """Columns that authenticate: blocked for everyone."""
    tokens = name_tokens(name)
    return F.coalesce(F.arrays_overlap(tokens, F.array(*map(F.lit, SECRET_TOKENS))) | _any_part(F.array_join(tokens, ""), SECRET_PARTS), F.lit(False))


def classify_pii(columns: DataFrame, name: str = "column_name", kind: str = "logical_type") -> DataFrame:
    """The rows with pii_tier, secret and decision: CONFIRMED (tiers 1 and 2), UNCERTAIN (3) or NONE."""
    tier = pii_tier(F.col(name), F.col(kind))
    return columns.withColumn("pii_tier", tier).withColumn("secret", is_secret(F.col(name))).withColumn("decision", F.when(F.col("pii_tier").isin(1, 2), "CONFIRMED").when(F.col("pii_tier") == 3, "UNCERTAIN").otherwise("NONE"))


def kpi_eligibility(profile: DataFrame) -> DataFrame:
    """The rows of a profile with completeness, eligible, eligibility_score and reason_excluded.

    ``profile``: column_name, role, role_confidence, n_rows, null_count, unique_count,
    sum_value, mean_value, filled_bins (of the histogram; null: it has none).
    """
    role, low, high = F.col("role"), *DIMENSION_VALUES
    complete = F.when(F.col("n_rows") <= 0, 0.0).when(F.col("null_count").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("null_count") / F.col("n_rows")))
    complete = F.when(role.isin("IDENTIFIER", "TEMPORAL_AXIS"), 1.0).otherwise(complete)
    least = F.coalesce(*[F.when(role == r, x) for r, x in LEAST_COMPLETE.items()], F.lit(0.40))
    has_value = F.col("mean_value").isNotNull() | role.isin("MONEY", "COUNT") & F.col("sum_value").isNotNull()
    of_dimension = F.when(F.col("unique_count").isNull(), "unique_count_missing").when(F.col("unique_count") < low, "unique_count_too_low").when(F.col("unique_count") > high, "unique_count_too_high")
    of_number = (
        F.when(complete < least, F.concat(F.lit("completeness_below_"), (100 * least).cast("int").cast("string"), F.lit("pct")))
        .when(F.col("filled_bins") == 0, "histogram_bins_all_zero")
        .when(~has_value, "required_stat_missing")
    )
    reason = F.when(role.isin("IDENTIFIER", "TEMPORAL_AXIS"), F.concat(F.lit("role_"), F.lower(role), F.lit("_excluded"))).when(role == "ATTRIBUTE", "attribute_excluded").when(role == "DIMENSION", of_dimension).otherwise(of_number)
    score = F.when(reason.isNull(), F.round(complete * F.least(F.lit(1.0), F.coalesce("role_confidence", F.lit(0.0))), 3)).otherwise(0.0)
    return profile.withColumn("completeness", F.round(complete, 3)).withColumn("reason_excluded", reason).withColumn("eligible", reason.isNull()).withColumn("eligibility_score", score)
