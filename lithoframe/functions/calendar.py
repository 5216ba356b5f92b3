"""Calendar grains, named date ranges and comparison periods."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth}


def grain(column: Column, name: str) -> Column:
    """year, quarter, month, week (ISO) or day of a date."""
    return GRAINS[name](column)


def make_date(year: Column, month: Column, day: Column | None = None) -> Column:
    """A date from its parts; null unless year is 1000-9999, month 1-12 and day 1-31 and the day exists."""
    day = F.lit(1) if day is None else day
    fine = year.between(1000, 9999) & month.between(1, 12) & day.between(1, 31)
    return F.when(fine, F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), F.lit("yyyy-MM-dd"))))


def _month_start(d: date, back: int = 0) -> date:
    k = d.year * 12 + d.month - 1 - back
    return date(k // 12, k % 12 + 1, 1)


def named_range(name: str, today: date) -> tuple[date, date] | None:
    """First and last day of today, yesterday, this/last week (from Monday), month, quarter or year."""
    if name in ("today", "yesterday"):
        d = today - timedelta(days=name == "yesterday")
        return d, d
    which, _, unit = name.partition(" ")
    last = which == "last"
    if which not in ("this", "last"):
        return None
    if unit == "week":
        start = today - timedelta(days=today.weekday() + 7 * last)
        return start, start + timedelta(days=6)
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        return None
    inside = (today.month - 1) % months
    start = _month_start(today, inside + months * last)
    return start, _month_start(start, -months) - timedelta(days=1)


def explicit_range(start: str, end: str) -> tuple[date, date] | None:
    """Both dates as YYYY-MM-DD or MM/DD/YYYY; anything else gives no range."""
    out = []
    for text in (start, end):
        for pattern in ("%Y-%m-%d", "%m/%d/%Y"):
            try:
                out.append(datetime.strptime(text.strip(), pattern).date())
                break
            except ValueError:
                continue
    return (out[0], out[1]) if len(out) == 2 else None


def comparison_periods(kind: str, today: date) -> tuple[tuple[date, date], tuple[date, date]]:
    """Current period to date and the part of the previous one that had elapsed as long."""
    months = {"month_over_month": 1, "quarter_over_quarter": 3, "year_over_year": 12}[kind]
    start = _month_start(today, (today.month - 1) % months)
    before = _month_start(start, months)
    end = before + (today - start)
    if months < 12:
        end = min(end, start - timedelta(days=1))
    return (start, today), (before, end)


def preceding_period(start: date, end: date) -> tuple[date, date]:
    """The equally long period just before."""
    days = (end - start).days + 1
    return start - timedelta(days=days), start - timedelta(days=1)
