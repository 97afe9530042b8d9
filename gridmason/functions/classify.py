"""Classes out of free text, by ordered patterns: property, listing and seller type, possession; registrations and contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmason.functions.text import clean, empty_to_null

# The first pattern that fits decides.
PROPERTY_TYPES = (
    ("builder_floor", r"(?i)builder\s*floor|independent\s*floor"),
    ("villa", r"(?i)\bvilla\b|row\s*house|town\s*house"),
    ("farmhouse", r"(?i)farm\s*house"),
    ("penthouse", r"(?i)penthouse"),
    ("studio", r"(?i)studio"),
    ("independent_house", r"(?i)independent\s*house|\bkothi\b|\bbungalow\b"),
    ("plot", r"(?i)\bplot\b|\bland\b|residential\s*plot"),
    ("office", r"(?i)\boffice\b|office\s*space|\bit\s*space\b"),
    ("retail_shop", r"(?i)\bshop\b|retail|\bsco\b"),
    ("showroom", r"(?i)showroom"),
    ("warehouse", r"(?i)warehouse|godown|industrial"),
    ("co_working", r"(?i)co\s*-?\s*working"),
    ("serviced_apartment", r"(?i)service[d]?\s*apartment"),
    ("apartment", r"(?i)apartment|\bflat\b|multistorey"),
)
COMMERCIAL_TYPES = ("office", "retail_shop", "showroom", "warehouse", "co_working")
LISTING_TYPES = (
    ("pg", r"\bpg\b|paying\s*guest|\bhostel\b"),
    ("rent", r"for\s*rent|\brent(al)?\b|\blease\b|/rent"),
    ("new_launch", r"new\s*launch|pre\s*-?launch"),
    ("resale", r"\bresale\b"),
    ("sale", r"for\s*sale|\bbuy\b|/sale|\bsell\b"),
    ("project", r"\bproject\b"),
)
SELLER_TYPES = (("owner", "owner"), ("builder", "builder|developer"), ("agent", "agent|broker|dealer|consultant|realtor"))
POSSESSION = (
    ("ready_to_move", r"(?i)ready\s*to\s*move|ready\s*possession|immediate\s*possession|rtm\b"),
    ("under_construction", r"(?i)under\s*construction|u/?c\b|ongoing"),
    ("new_launch", r"(?i)new\s*launch|pre\s*launch|newly\s*launched"),
    ("upcoming", r"(?i)upcoming|announced"),
    ("completed", r"(?i)completed|delivered|occupied"),
)
REGISTRATIONS = (r"(?i)\b(?:RC/)?(?:REP/)?HARERA[/\-][A-Z0-9/\-]{6,40}", r"(?i)\bUPRERA(?:PRJ|AGT)?[A-Z0-9]{4,20}\b", r"(?i)\bDLRERA[A-Z0-9/\-]{4,30}\b", r"(?i)\b\d{1,4}\s*OF\s*20\d{2}\b")


def first_class(text: Column, table: tuple, default: str | Column) -> Column:
    out = default if isinstance(default, Column) else F.lit(default)
    for name, pattern in reversed(table):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def blob(*cs: Column) -> Column:
    return F.concat_ws(" ", *[clean(c) for c in cs])


def property_type(*cs: Column) -> Column:
    return first_class(blob(*cs), PROPERTY_TYPES, "other")


def is_commercial(kind: Column, *cs: Column) -> Column:
    return kind.isin(*COMMERCIAL_TYPES) | blob(*cs).rlike(r"(?i)\bcommercial\b|\boffice space\b|\bretail\b")


def listing_type(*cs: Column) -> Column:
    return first_class(F.lower(blob(*cs)), LISTING_TYPES, "unknown")


def seller_type(c: Column) -> Column:
    return first_class(F.lower(F.coalesce(clean(c), F.lit(""))), SELLER_TYPES, "unknown")


def possession_status(c: Column, as_of: Column) -> Column:
    """By pattern, else by a date named: after ``as_of`` under construction, before it completed."""
    from gridmason.functions.dates import possession_date

    day = possession_date(c)
    dated = F.when(day > as_of, "under_construction").when(day.isNotNull(), "completed").otherwise("unknown")
    return first_class(F.coalesce(clean(c), F.lit("")), POSSESSION, dated)


def registration(c: Column) -> Column:
    text = clean(c)
    return F.trim(F.upper(F.coalesce(*[empty_to_null(F.regexp_extract(text, p, 0)) for p in REGISTRATIONS])), F.lit(" .,"))


def phone(c: Column) -> Column:
    digits = F.regexp_extract(F.translate(clean(c), " -", ""), r"(?:\+91)?([6-9]\d{9})\b", 1)
    return F.when(digits != "", F.concat(F.lit("+91"), digits))


def email(c: Column) -> Column:
    return F.lower(empty_to_null(F.regexp_extract(clean(c), r"[\w.+-]+@[\w-]+\.[\w.-]+", 0)))
