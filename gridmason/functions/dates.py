"""Dates out of text, month buckets, ages. Everything relative takes an explicit as_of."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmason.functions.text import clean, empty_to_null

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_YEAR = r"(?i)(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)[\s,'`-]*(\d{2,4})"


def possession_date(c: Column) -> Column:
    """The first of the month named, or of the year."""
    text = clean(c)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(F.regexp_extract(text, MONTH_YEAR, 1), 1, 3)))
    year = empty_to_null(F.regexp_extract(text, MONTH_YEAR, 2)).try_cast("int")
    year = F.when(year < 100, year + 2000).otherwise(year)
    plain = empty_to_null(F.regexp_extract(text, r"\b(20\d{2})\b", 1)).try_cast("int")
    return F.when(year.isNotNull() & (month > 0), F.make_date(year, month.cast("int"), F.lit(1))).otherwise(F.make_date(plain, F.lit(1), F.lit(1)))


# Days that a unit of age stands for; minutes and hours count as now.
AGE_DAYS = (("min", 0), ("hour", 0), ("hr", 0), ("day", 1), ("week", 7), ("month", 30), ("year", 365))


@F.pandas_udf(T.TimestampType())
def _fuzzy(s: pd.Series) -> pd.Series:
    from dateutil import parser

    def one(x: str | None):
        try:
            found = parser.parse(x, fuzzy=True, dayfirst=True) if x else None
            return found.replace(tzinfo=None) if found and 1900 <= found.year <= 2200 else None
        except (ValueError, OverflowError, TypeError):
            return None

    return pd.to_datetime(s.map(one))


def listing_date(c: Column, as_of: Column, fuzzy: bool = False) -> Column:
    """today, yesterday, "n units ago"; with ``fuzzy`` other forms too, day first, years 2000 to ten from as_of."""
    text = clean(c)
    ago = r"(?i)(\d+)\s*(min(?:ute)?s?|hours?|hrs?|days?|weeks?|months?|years?)\s*ago"
    n, unit = empty_to_null(F.regexp_extract(text, ago, 1)).try_cast("int"), F.lower(F.regexp_extract(text, ago, 2))
    days = F.lit(None).cast("int")
    for name, d in reversed(AGE_DAYS):
        days = F.when(unit.startswith(name), d).otherwise(days)
    out = F.when(text.rlike(r"(?i)\btoday\b|\bjust now\b"), as_of).when(text.rlike(r"(?i)\byesterday\b"), F.date_trunc("day", as_of) - F.expr("INTERVAL 1 DAY"))
    out = out.when(n.isNotNull(), as_of - F.make_dt_interval(n * days))
    if fuzzy:
        guess = _fuzzy(text)
        out = out.when(F.year(guess).between(2000, F.year(as_of) + 10), guess)
    return out


def month(c: Column) -> Column:
    return F.date_trunc("month", c)


def days_between(later: Column, earlier: Column) -> Column:
    """As a fraction."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)
