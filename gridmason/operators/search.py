"""Filtered, ranked, paged search; weighted text match; suggestions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmason.functions.places import within
from gridmason.functions.text import contains_ci, tokens

MAX_PAGE = 100
# Sort modes.
SORTS: dict[str, list[tuple[str, bool]]] = {
    "newest": [("listed_at", False), ("first_seen_at", False)],
    "price_asc": [("price", True)],
    "price_desc": [("price", False)],
    "ppsf_asc": [("price_per_sqft", True)],
    "area_desc": [("area_sqft", False)],
    "investment": [("investment_score", False)],
    "lowest_risk": [("risk_score", True)],
}
#: Text fields, their weights, and whether a word may differ by one letter after its second.
FIELDS = (("project_name", 10, True), ("builder_name", 10, True), ("society_name", 8, False), ("sector", 6, False), ("locality", 6, False), ("micro_market", 6, False), ("configuration", 4, False), ("title", 3, False), ("amenities", 2, False), ("tags", 2, False), ("description", 1, False))


@dataclass
class Query:
    """A search. Lists mean any of, but for amenities, all of which are asked for."""

    q: str | None = None
    city: str | None = None
    sector: str | None = None
    locality: str | None = None
    micro_market: str | None = None
    builder: str | None = None
    project: str | None = None
    listing_type: str | None = None
    property_type: list[str] = field(default_factory=list)
    configuration: str | None = None
    possession_status: list[str] = field(default_factory=list)
    segment: list[str] = field(default_factory=list)
    amenities: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    is_commercial: bool | None = None
    has_rera: bool | None = None
    bedrooms_min: float | None = None
    bedrooms_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    price_min: float | None = None
    price_max: float | None = None
    min_investment_score: float | None = None
    max_risk_score: float | None = None
    near_lat: float | None = None
    near_lng: float | None = None
    radius_km: float | None = None
    include_duplicates: bool = False
    sort: str = "relevance"
    page: int = 1
    limit: int = 20

    # What makes two searches the same.
    IDENTITY = ("q", "city", "sector", "locality", "micro_market", "builder", "project", "listing_type", "property_type", "configuration", "bedrooms_min", "bedrooms_max", "price_min", "price_max", "possession_status", "segment")

    def fingerprint(self) -> str:
        """The same for the same filters, whatever page, order or case; "empty" without any."""
        given = []
        for name in self.IDENTITY:
            v = getattr(self, name)
            if v not in (None, "", []):
                given.append(f"{name}={(','.join(sorted(map(str, v))) if isinstance(v, list) else str(v)).strip().lower()}")
        return hashlib.sha1("|".join(sorted(given)).encode()).hexdigest()[:24] if given else "empty"

    def window(self) -> tuple[int, int]:
        """(offset, limit), the page's size held to 1 .. MAX_PAGE."""
        size = min(max(1, self.limit), MAX_PAGE)
        return (max(1, self.page) - 1) * size, size


def _between(c: Column, low: float | None, high: float | None) -> list[Column]:
    return ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])


def condition(query: Query, columns: list[str]) -> Column:
    """The filters; those on columns that the table lacks match nothing."""
    col = lambda n: F.col(n) if n in columns else F.lit(None)
    all_of = [col("is_active")]
    if not query.include_duplicates:
        all_of.append(col("canonical_id").isNull())
    all_of += [col(n) == v for n, v in (("city", query.city), ("listing_type", query.listing_type)) if v]
    all_of += [contains_ci(col(n), v) for n, v in (("sector", query.sector), ("locality", query.locality), ("micro_market", query.micro_market), ("builder_name", query.builder), ("project_name", query.project), ("configuration", query.configuration)) if v]
    all_of += [col(n).isin(v) for n, v in (("property_type", query.property_type), ("possession_status", query.possession_status), ("segment", query.segment)) if v]
    if query.amenities:
        all_of.append(F.size(F.array_except(F.array(*map(F.lit, query.amenities)), col("amenities"))) == 0)
    if query.keywords:
        words = F.array(*map(F.lit, query.keywords))
        all_of.append(F.coalesce(F.arrays_overlap(col("keywords"), words), F.lit(False)) | F.coalesce(F.arrays_overlap(col("tags"), words), F.lit(False)))
    if query.is_commercial is not None:
        all_of.append(col("is_commercial") == query.is_commercial)
    if query.has_rera is not None:
        all_of.append(col("rera_number").isNotNull() if query.has_rera else col("rera_number").isNull())
    all_of += _between(col("bedrooms"), query.bedrooms_min, query.bedrooms_max) + _between(col("area_sqft"), query.area_min, query.area_max)
    all_of += _between(col("investment_score"), query.min_investment_score, None) + _between(col("risk_score"), None, query.max_risk_score)
    budget = [reduce(lambda a, b: a & b, _between(col(n), query.price_min, query.price_max)) for n in ("price", "rent_monthly") if query.price_min is not None or query.price_max is not None]
    if budget:
        all_of.append(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), budget))
    if None not in (query.near_lat, query.near_lng) and query.radius_km:
        all_of.append(within(col("latitude"), col("longitude"), query.near_lat, query.near_lng, query.radius_km))
    return reduce(lambda a, b: a & b, all_of)


def _one_edit(word: str):
    return lambda t: t.startswith(word[:2]) & (F.levenshtein(t, F.lit(word)) <= 1)


def text_score(q: str, df: DataFrame) -> Column:
    """Sum over fields of weight x matched query words; a fuzzy field also matches a word one edit away that begins with the same two letters. Own
    formula: no index statistics, so a row's score doesn't depend on the others."""
    words = sorted(set(w for w in "".join(c if c.isalnum() else " " for c in q.lower()).split()))
    total = F.lit(0)
    for name, weight, fuzzy in FIELDS:
        if name not in df.columns:
            continue
        text = F.array_join(name, " ") if df.schema[name].dataType.typeName() == "array" else F.col(name)
        have = F.array_distinct(tokens(text))
        for w in words:
            hit = F.array_contains(have, w)
            if fuzzy and len(w) > 2:
                hit = hit | F.exists(have, _one_edit(w))
            total = total + F.when(hit, weight).otherwise(0)
    return total


def search(listings: DataFrame, query: Query, as_of: Column, key: str = "id") -> DataFrame:
    """A page of hits with score, rank and total (of all hits). Ties by key, so that pages don't overlap. Relevance blends the text
    score with freshness (half at 60 days, full for what is seen after as_of); without words it is newest first."""
    rows = listings.filter(condition(query, listings.columns))
    rows = rows.withColumn("score", text_score(query.q, rows)).filter("score > 0") if query.q else rows.withColumn("score", F.lit(0))
    if query.sort == "relevance" and query.q:
        age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_seen_at").cast("timestamp"))) / F.lit(5_184_000_000_000.0)
        order = [F.desc(F.col("score") + 1 / (1 + F.greatest(age, F.lit(0.0))))]
    else:
        order = [F.asc(c) if up else F.desc(c) for c, up in SORTS.get(query.sort, SORTS["newest"]) if c in rows.columns]
    offset, limit = query.window()
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order, key).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(total))  # one row


def suggest(listings: DataFrame, term: str, limit: int = 10, fuzzy: bool = False) -> DataFrame:
    """(value, kind): project names, then builders, then places that begin with the term (or, fuzzy, whose first word is one edit away), one spelling each."""
    t = term.lower()
    kinds = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(k).alias("kind"), F.col(c).alias("value")) for i, (k, c) in enumerate((("project", "project_name"), ("builder", "builder_name"), ("locality", "place")))])
    rows = listings.filter("is_active").withColumn("place", F.coalesce("sector", "locality")).select(F.explode(kinds).alias("s")).select("s.*").filter("value is not null")
    low = F.lower("value")
    hit = low.startswith(t)
    if fuzzy:
        hit = hit | (F.levenshtein(F.substring(low, 1, len(t)), F.lit(t)) <= 1)
    one = rows.filter(hit).groupBy("o", "kind", F.lower("value").alias("k")).agg(F.min("value").alias("value"))
    return one.orderBy("o", "k").limit(limit).select("value", "kind")


def top_per_group(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def pages(total: Column, limit: int) -> Column:
    return F.floor((total + limit - 1) / limit)


def given(query: Query) -> dict:
    """What a search asks for, for a task that fills its gap."""
    return {f.name: getattr(query, f.name) for f in fields(query) if f.name in Query.IDENTITY and getattr(query, f.name) not in (None, "", [])}


def primary_image(images: str = "images") -> Column:
    """The address of the first image, null if there is none."""
    return F.get(F.col(images), F.lit(0))["url"]
