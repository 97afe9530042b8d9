"""Areas, distances, room configurations, floors, plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmason.functions.text import clean, empty_to_null

# Unit patterns in order, and square feet per unit.
UNITS = (
    ("sqft", r"(?i)\bsq\.?\s*(ft|feet|foot)\b|\bsqft\b|\bft2\b|\bsft\b", 1.0),
    ("sqyd", r"(?i)\bsq\.?\s*(yd|yds|yard|yards)\b|\bsqyd\b|\bgaj\b|\bgajj?\b", 9.0),
    ("sqm", r"(?i)\bsq\.?\s*(m|mt|mtr|meter|metre)s?\b|\bsqm\b|\bm2\b", 10.7639),
    ("acre", r"(?i)\bacres?\b", 43560.0),
    ("hectare", r"(?i)\bhectares?\b|\bha\b", 107639.0),
    ("marla", r"(?i)\bmarlas?\b", 272.25),
    ("kanal", r"(?i)\bkanals?\b", 5445.0),
)
NUMBER = r"(\d[\d,]*\.?\d*)"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return empty_to_null(F.regexp_extract(text, pattern, group))


def number(c: Column) -> Column:
    """The first number of a text, thousands separators dropped."""
    return F.replace(_found(clean(c), NUMBER), F.lit(","), F.lit("")).try_cast("double")


def integer(c: Column) -> Column:
    return F.replace(_found(clean(c), r"(\d[\d,]*)"), F.lit(","), F.lit("")).try_cast("int")


def area(c: Column) -> Column:
    """struct<value, unit>; square feet where no unit is named, null for no or zero area."""
    text, value = clean(c), number(c)
    unit = F.lit("sqft")
    for name, pattern, _ in reversed(UNITS):
        unit = F.when(text.rlike(pattern), name).otherwise(unit)
    ok = value > 0
    return F.struct(F.when(ok, value).alias("value"), F.when(ok, unit).alias("unit"))


def to_sqft(value: Column, unit: Column) -> Column:
    factor = F.lit(1.0)
    for name, _, x in UNITS:
        factor = F.when(unit == name, x).otherwise(factor)
    return F.bround(value * factor, 2)


def km(c: Column) -> Column:
    """A distance text in kilometres; metres converted, 3 places."""
    text = F.lower(clean(c))
    return F.when(text.rlike(r"\d\s*(m|mt|mtr|mtrs|meter|meters|metre|metres)\b"), F.bround(number(c) / 1000, 3)).otherwise(number(c))


def bedrooms(c: Column) -> Column:
    text = clean(c)
    n = _found(text, r"(?i)(\d+(?:\.\d+)?)\s*(?:\+\s*\d+\s*)?\s*(bhk|bed|bedroom|rk)\b")
    return F.when(n.isNotNull(), F.floor(n.try_cast("double")).cast("int")).when(text.rlike(r"(?i)\bstudio\b"), F.lit(0))


def configuration(c: Column) -> Column:
    """3bhk+study -> 3 BHK + Study; text without rooms stays."""
    text, beds = clean(c), bedrooms(c)
    label = F.when(text.rlike(r"(?i)\brk\b"), "RK").otherwise("BHK")
    extras = [F.when(text.rlike(p), name) for p, name in ((r"(?i)\bstudy\b", "Study"), (r"(?i)\bservant\b|\bsq\b", "Servant"), (r"(?i)\bpooja\b|\bpuja\b", "Pooja"), (r"(?i)\butility\b", "Utility"))]
    return F.when(beds.isNull(), text).when(beds == 0, "Studio").otherwise(F.concat_ws(" + ", F.concat_ws(" ", beds.cast("string"), label), *extras))


def floors(c: Column) -> Column:
    """struct<floor, total>; ground is 0, basement -1."""
    text = F.lower(clean(c))
    n = F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    low = text.rlike(r"\bground\b|\bgf\b|\bbasement\b")
    floor = F.when(text.rlike(r"\bground\b|\bgf\b"), F.lit(0)).when(text.rlike(r"\bbasement\b"), F.lit(-1)).otherwise(F.get(n, F.lit(0)))
    return F.struct(floor.alias("floor"), F.when(low, F.get(n, F.lit(0))).otherwise(F.get(n, F.lit(1))).alias("total"))
