"""Money: amounts in rupees out of free text, display forms, price segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmason.functions.text import clean

# Unit words and their factors, tried in this order.
UNITS = (("cr(?:ore)?s?|crs", "10000000"), ("lakhs?|lacs?|la[ck]|l", "100000"), ("thousand|k", "1000"), ("million|mn", "1000000"), ("billion|bn", "1000000000"))
ON_REQUEST = r"(?i)price\s*on\s*request|on\s*request|call\s*for\s*price|p\.?o\.?r\.?\b|ask\s*price"
TOKEN = r"(?i)(₹|rs\.?|inr)?\s*(\d[\d,]*\.?\d*)\s*(cr(?:ore)?s?|crs?|lakh?s?|lacs?|lakhs?|thousand|million|mn|billion|bn|[lk])?\b"
PER_AREA = r"(?i)(per|/)\s*(sq\.?\s*(ft|feet|yd|yard|m)|sqft|sqyd)"
AMOUNT = "decimal(30,6)"


def is_on_request(c: Column) -> Column:
    return F.coalesce(c.rlike(ON_REQUEST), F.lit(False))


def _factor(unit: Column) -> Column:
    out = F.lit(None).cast("decimal(12,0)")
    for pattern, factor in reversed(UNITS):
        out = F.when(unit.rlike(f"(?i)^({pattern})$"), F.lit(factor).cast("decimal(12,0)")).otherwise(out)
    return out


def _candidates(text: Column) -> Column:
    """array<struct<amount, unit factor, has currency>> of the numbers of a text, in order, without zeros."""
    found = [F.regexp_extract_all(text, F.lit(TOKEN), F.lit(i)) for i in (1, 2, 3)]
    rows = F.arrays_zip(*[x.alias(n) for x, n in zip(found, "cnu", strict=True)])
    rows = F.transform(rows, lambda r: F.struct(F.replace(r["n"], F.lit(","), F.lit("")).cast(AMOUNT).alias("amount"), _factor(r["u"]).alias("factor"), (r["c"] != "").alias("currency")))
    return F.filter(rows, lambda r: r["amount"] > 0)


def _best(rows: Column) -> Column:
    """struct<amount, has_unit>: a number with a unit, else one after a currency sign, else the first."""
    unit = F.get(F.filter(rows, lambda r: r["factor"].isNotNull()), F.lit(0))
    money = F.get(F.filter(rows, lambda r: r["currency"]), F.lit(0))
    first = F.get(rows, F.lit(0))
    return F.struct(F.coalesce((unit["amount"] * unit["factor"]).cast(AMOUNT), money["amount"], first["amount"]).alias("amount"), unit["amount"].isNotNull().alias("has_unit"))


def _parts(c: Column) -> tuple[Column, Column]:
    text = clean(c)
    text = F.when(~is_on_request(text), text)
    rows = _candidates(text)
    return _best(rows), rows


def price(c: Column) -> Column:
    """Whole rupees (half to even), null where nothing is priced."""
    return F.bround(_parts(c)[0]["amount"], 0).cast("decimal(24,0)")


def price_range(c: Column) -> Column:
    """struct<low, high>; a unit that only the right side has applies to the left side too. The separator may be a bare "to" within a word."""
    text = clean(c)
    sides = F.split(text, r"\s*(?:-|–|—|to)\s*", 2)
    left, _ = _parts(F.get(sides, F.lit(0)))
    right, rows = _parts(F.get(sides, F.lit(1)))
    borrowed = F.get(F.filter(rows, lambda r: r["factor"].isNotNull()), F.lit(0))["factor"]
    low = F.when(~left["has_unit"] & right["amount"].isNotNull() & borrowed.isNotNull(), (left["amount"] * borrowed).cast(AMOUNT)).otherwise(left["amount"])
    return F.struct(F.bround(low, 0).cast("decimal(24,0)").alias("low"), F.bround(right["amount"], 0).cast("decimal(24,0)").alias("high"))


def price_per_sqft(c: Column) -> Column:
    """Only for text that says per area."""
    return F.when(clean(c).rlike(PER_AREA), price(c))


def derived_ppsf(amount: Column, area: Column) -> Column:
    return F.when((amount > 0) & (area > 0), F.bround(amount / area, 0))


def display(amount: Column) -> Column:
    """1.25 Cr, 85 L or 45,000."""

    def short(unit: str, name: str) -> Column:
        x = F.regexp_replace((amount.cast("decimal(24,2)") / F.lit(unit).cast("decimal(12,0)")).cast("decimal(24,8)").cast("string"), r"\.?0+$", "")
        return F.concat(x, F.lit(f" {name}"))

    return F.when(amount >= 10_000_000, short("10000000", "Cr")).when(amount >= 100_000, short("100000", "L")).when(amount.isNotNull(), F.format_number(F.floor(amount).cast("bigint"), 0))


# Upper bounds of price segments.
SALE_SEGMENTS = ((4_500_000, "affordable"), (15_000_000, "mid"), (40_000_000, "premium"), (100_000_000, "luxury"))
RENT_SEGMENTS = ((25_000, "affordable"), (75_000, "mid"), (200_000, "premium"), (500_000, "luxury"))


def segment(amount: Column, listing_type: Column) -> Column:
    def bands(table: tuple) -> Column:
        out = F.lit("ultra_luxury")
        for bound, name in reversed(table):
            out = F.when(amount < bound, name).otherwise(out)
        return out

    return F.when(amount.isNull() | (amount <= 0), "unknown").when(listing_type == "rent", bands(RENT_SEGMENTS)).otherwise(bands(SALE_SEGMENTS))
