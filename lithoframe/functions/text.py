"""Text patterns, shapes, tokens and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of values.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"
GUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE = r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|[A-Za-z]{3}\s+\d{1,2})"
NUMBER = r"^-?\d+(\.\d+)?$"
PHONE = r"^[+\d\s\-().]+$"
MASKED = r"(?i)^(\*{2,}[-\s\d*]*|X{3,}[-\s\dX]*|\[REDACTED\]|REDACTED)$"


def is_email(c: Column) -> Column:
    return F.trim(c).rlike(EMAIL)


def is_phone(c: Column) -> Column:
    """7 to 15 digits among phone punctuation."""
    digits = F.length(F.regexp_replace(c, r"[^0-9]", ""))
    return F.trim(c).rlike(PHONE) & digits.between(7, 15)


def matches(c: Column, pattern: str) -> Column:
    return F.trim(c).rlike(pattern)


def rate(flag: Column) -> Column:
    """Percent of the rows with a value that fit; null if there are none."""
    return 100.0 * F.count_if(flag) / F.nullif(F.count(flag), F.lit(0))


def shape(c: Column) -> Column:
    """Letters as A, digits as 9, everything else as X."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", "\u0001"), r"\p{L}", "A"), r"\p{Nd}", "9"), "\u0001", "X")


def tokens(c: Column) -> Column:
    """Lower-case words of a name: cut at case changes, digits and punctuation."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " "), r"[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " "), lambda t: t != "")


def singular(token: str) -> str:
    if len(token) > 3 and token.endswith("ies"):
        return token[:-3] + "y"
    if len(token) > 3 and token.endswith(("ses", "xes", "ches", "shes")):
        return token[:-2]
    return token[:-1] if len(token) > 2 and token.endswith("s") and not token.endswith(("ss", "us", "is")) else token


def humanize(name: str) -> str:
    """A label for a column name: order_date or OrderDate -> Order Date."""
    parts = re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+", name)
    return " ".join(p if p.isupper() and len(p) > 1 else p.capitalize() for p in parts)


def normalize_intent(c: Column) -> Column:
    """A question without filler words, lower case, spaces single."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\b(please|show|me|the|a|an|can|you|could|give|get|i|want|to|see)\b", " "), r"[^a-z0-9]+", " "))
