"""Feed records for the site: display fields, amenity and image groups, segments, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmason.functions.money import display

# Cities and categories of the site, labels, amenity groups in order.
CITY_KEYS = {"gurgaon": "ggn", "delhi": "delhi", "faridabad": "faridabad", "greater_noida": "gNoida", "noida": "noida"}
PROJECT_CATEGORIES = ("Residential", "Commercial")
LISTING_CATEGORIES = {"sale": "Sale", "resale": "Sale", "new_launch": "Sale", "project": "Sale", "rent": "Rent", "pg": "Pg", "commercial": "Commercial"}
STATUS_LABELS = {"ready_to_move": "Ready to Move", "under_construction": "Under Construction", "new_launch": "New Launch", "upcoming": "Upcoming", "completed": "Completed"}
AMENITY_GROUPS = (
    ("Sports", r"(?i)gym|swim|pool|court|football|cricket|jogging|cycling|yoga|skating|golf"),
    ("Safety", r"(?i)security|cctv|surveillance|fire|intercom|guard|access control"),
    ("Convenience", r"(?i)lift|elevat|power backup|water|parking|atm|shopping|laundry|maintenance|waste|sewage|rain"),
    ("Leisure", r"(?i)club|party|theatre|lounge|cafe|restaurant|amphi|library|spa|sauna|banquet"),
    ("Environment", r"(?i)park|garden|green|landscap|open space|terrace|lawn"),
    ("Kids", r"(?i)kid|child|play|creche|sand pit"),
)
INTERIOR = r"(?i)interior|apartment-interior|room|kitchen|bedroom|bathroom"
MASTER_PLAN = r"(?i)master-?plan|layout|site-?plan"
PROSE = r"(?i)\b(explore|view|know|check|discover|offers?|project|floor plans?|reviews?|amenities|rera|details|status|price)\b"


def labelled(c: Column, table: dict[str, str], default: str | None = "") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def price_line(low: Column, high: Column) -> Column:
    return F.when(low.isNull() & high.isNull(), "Price on Request").when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(display(low), F.lit(" - "), display(high))).otherwise(display(F.coalesce(low, high)))


def rent_line(rent: Column) -> Column:
    return F.when(rent.isNull(), "Price on Request").otherwise(F.concat(display(rent), F.lit("/month")))


def possession_line(day: Column, status: Column) -> Column:
    return F.coalesce(F.date_format(day, "MMM yyyy"), labelled(status, STATUS_LABELS))


def place_line(sector: Column, sub_locality: Column, locality: Column, city: Column) -> Column:
    """Parts that look like places (short, no marketing words), each once, then the city."""
    parts = F.array_compact(F.transform(F.array(F.coalesce(sector, sub_locality), locality), lambda p: F.nullif(F.trim(p, F.lit(" ,")), F.lit(""))))
    parts = F.filter(parts, lambda p: (F.length(p) <= 40) & (F.size(F.split(p, r"\s+")) <= 4) & ~p.rlike(PROSE))
    town = F.when(city != "unknown", F.initcap(F.replace(city, F.lit("_"), F.lit(" "))))
    every = F.array_compact(F.concat(parts, F.array(town)))
    low = F.transform(every, F.lower)
    return F.array_join(F.filter(every, lambda p, i: F.array_position(low, F.lower(p)) == i + 1), ", ")


def rooms_line(configurations: Column) -> Column:
    """1 BHK, 2 BHK -> 1, 2 BHK; other labels listed."""
    names = F.filter(F.transform(configurations, lambda c: c["configuration"]), lambda n: n.isNotNull() & (n != ""))
    numbers = F.filter(F.transform(names, lambda n: F.regexp_extract(n, r"(?i)^\s*(\d+)\s*BHK", 1)), lambda n: n != "")
    return F.when(F.size(names) <= 0, "").when(F.size(numbers) == F.size(names), F.concat(F.array_join(F.array_distinct(numbers), ", "), F.lit(" BHK"))).otherwise(F.array_join(F.array_distinct(names), ", "))


def size_line(configurations: Column) -> Column:
    areas = F.filter(F.transform(configurations, lambda c: c["area_sqft"]), lambda a: a > 0)
    text = lambda x: F.bround(x, 0).cast("bigint").cast("string")
    low, high = F.array_min(areas), F.array_max(areas)
    return F.when(F.size(areas) <= 0, "").when(low == high, text(low)).otherwise(F.concat(text(low), F.lit(" to "), text(high)))


def price_list(configurations: Column) -> Column:
    rows = F.filter(configurations, lambda c: c["configuration"] != "")
    price = lambda c: F.coalesce(F.nullif(c["price_display"], F.lit("")), display(c["price_min"]), F.lit("Price on Request"))
    return F.transform(rows, lambda c: F.struct(c["configuration"].alias("bhkType"), F.coalesce(F.floor(c["area_sqft"]).cast("bigint").cast("string"), F.lit("")).alias("size"), price(c).alias("price")))


def flats(configurations: Column, hero: Column) -> Column:
    """map<configuration, array<struct>>."""
    rows = price_list(configurations)
    names = F.array_distinct(F.transform(rows, lambda r: r["bhkType"]))
    unit = lambda r: F.struct(F.when(r["size"] != "", F.concat(r["size"], F.lit(" sq.ft"))).otherwise("").alias("size"), r["price"].alias("price"), F.coalesce(hero, F.lit("")).alias("image"))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(rows, lambda r: r["bhkType"] == n), unit).alias("value"))))


def amenity_group(amenity: Column) -> Column:
    out = F.lit("Others")
    for name, pattern in reversed(AMENITY_GROUPS):
        out = F.when(amenity.rlike(pattern), name).otherwise(out)
    return out


def amenity_groups(amenities: Column) -> Column:
    """array<struct<category, amenities>>, groups by their first amenity."""
    tagged = F.transform(amenities, lambda a: F.struct(amenity_group(a).alias("g"), a.alias("a")))
    names = F.array_distinct(F.transform(tagged, lambda t: t["g"]))
    return F.transform(names, lambda n: F.struct(n.alias("category"), F.transform(F.filter(tagged, lambda t: t["g"] == n), lambda t: t["a"]).alias("amenities")))


def landmark_groups(landmarks: Column) -> Column:
    names = F.array_distinct(F.transform(landmarks, lambda x: x["category"]))
    far = lambda x: F.coalesce(F.nullif(x["raw_distance"], F.lit("")), F.concat(x["distance_km"].cast("string"), F.lit(" KM")), F.lit(""))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(landmarks, lambda x: x["category"] == n), lambda x: F.struct(x["name"].alias("name"), far(x).alias("distance"))).alias("value"))))


def images(urls: Column) -> Column:
    """struct<gallery, interior, master_plan>: the first plan is the plan, later ones go by the other rules; only interiors are a gallery."""
    plans = F.filter(urls, lambda u: u.rlike(MASTER_PLAN))
    first = F.get(plans, F.lit(0))
    rest = F.filter(urls, lambda u, i: first.isNull() | (i + 1 != F.array_position(urls, first)))
    interior, gallery = F.filter(rest, lambda u: u.rlike(INTERIOR)), F.filter(rest, lambda u: ~u.rlike(INTERIOR))
    swap = (F.size(gallery) == 0) & (F.size(interior) > 0)
    return F.struct(F.when(swap, interior).otherwise(gallery).alias("gallery"), F.when(swap, F.array().cast("array<string>")).otherwise(interior).alias("interior"), first.alias("master_plan"))


def paragraphs(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, r"\r?\n\s*\r?\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)


def publishable_project(low: Column, high: Column, configurations: Column, amenities: Column) -> Column:
    return low.isNotNull() | high.isNotNull() | (F.coalesce(F.size(configurations), F.lit(0)) > 0) | (F.coalesce(F.size(amenities), F.lit(0)) > 0)


def publishable_listing(price: Column, rent: Column, configuration: Column, amenities: Column) -> Column:
    return price.isNotNull() | rent.isNotNull() | (F.coalesce(configuration, F.lit("")) != "") | (F.coalesce(F.size(amenities), F.lit(0)) > 0)


def listing_segments(listings: DataFrame, publishable: Column, city: str = "city", kind: str = "listing_type") -> DataFrame:
    """(segment, total, withheld): all segments, empty ones too; withheld counts unpublishable and unclassed rows of the site's cities, under the segment null.
    Rows of other cities count under "no_segment"."""
    key, category = labelled(F.col(city), CITY_KEYS, None), labelled(F.col(kind), LISTING_CATEGORIES, None)
    ok = category.isNotNull() & publishable
    name = F.when(key.isNull(), "no_segment").when(ok, F.concat(key, category, F.lit("Properties")))
    counts = listings.select(name.alias("segment")).groupBy("segment").agg(F.count("*").alias("total"))
    spark = listings.sparkSession
    every = spark.createDataFrame([(f"{k}{c}Properties",) for k in CITY_KEYS.values() for c in sorted(set(LISTING_CATEGORIES.values()))] + [("no_segment",), (None,)], "segment string")
    return F.broadcast(every).join(counts, every["segment"].eqNullSafe(counts["segment"]), "left").select(every["segment"], F.coalesce("total", F.lit(0)).alias("total"))


def project_record() -> Column:
    """One project as the site's record, as JSON; expects the project table's columns."""
    c = F.col
    shown = images(F.transform("images", lambda i: i["url"]))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return F.struct(
        c("name").alias("projectTitle"), place_line(c("location.sector"), c("location.sub_locality"), c("location.locality"), c("location.city")).alias("location"),
        price_line(c("price_min"), c("price_max")).alias("price"), size_line(c("configurations")).alias("size"), rooms_line(c("configurations")).alias("BHKType"), text(c("rera_number")).alias("reraId"),
        labelled(c("status"), STATUS_LABELS).alias("projectStatus"), possession_line(c("possession_date"), c("status")).alias("possession"), F.when(c("total_units") > 0, text(c("total_units"))).otherwise("").alias("numberOfUnits"),
        F.when(c("project_area_acres") > 0, F.concat(text(c("project_area_acres")), F.lit(" Acres"))).otherwise("").alias("totalArea"), text(c("builder_name")).alias("builderDescription"), paragraphs(c("description")).alias("aboutProject"),
        amenity_groups(c("amenities")).alias("amenities"), price_list(c("configurations")).alias("priceList"), flats(c("configurations"), F.get(shown["gallery"], F.lit(0))).alias("flats"), landmark_groups(c("landmarks")).alias("landmarks"),
        F.transform(F.map_entries("specifications"), lambda e: F.struct(e["key"].alias("heading"), e["value"].alias("value"))).alias("specifications"), c("construction_updates").alias("recentUpdates"),
        shown["gallery"].alias("images"), shown["interior"].alias("interiorImages"), shown["master_plan"].alias("masterPlan"), c("project_url").alias("projectUrl"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updatedAt"),
    )


def listing_record() -> Column:
    """One listing as the site's record; expects the listing table's columns."""
    c = F.col
    shown = images(F.transform("images", lambda i: i["url"]))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    rent = c("listing_type") == "rent"
    return F.struct(
        c("id"), F.coalesce(F.nullif(c("title"), F.lit("")), c("project_name"), F.lit("")).alias("title"), place_line(c("location.sector"), c("location.sub_locality"), c("location.locality"), c("location.city")).alias("location"),
        F.when(rent, rent_line(c("rent_monthly"))).otherwise(price_line(c("price"), c("price_max"))).alias("price"), F.when(~rent, c("price")).alias("priceValue"), F.when(rent, c("rent_monthly")).alias("rentMonthly"),
        F.when(c("area_sqft") > 0, F.concat(F.floor("area_sqft").cast("string"), F.lit(" sq.ft"))).otherwise("").alias("size"), c("area_sqft").alias("areaValue"), text(c("configuration")).alias("configuration"), c("bedrooms"),
        c("property_type").alias("propertyType"), c("listing_type").alias("listingType"), c("is_commercial").alias("isCommercial"), text(c("rera_number")).alias("reraId"), labelled(c("possession_status"), STATUS_LABELS).alias("projectStatus"),
        possession_line(c("possession_date"), c("possession_status")).alias("possession"), text(c("builder_name")).alias("builderDescription"), paragraphs(c("description")).alias("aboutProject"), amenity_groups(c("amenities")).alias("amenities"),
        F.transform(F.map_entries("specifications"), lambda e: F.struct(e["key"].alias("heading"), e["value"].alias("value"))).alias("specifications"), shown["gallery"].alias("images"), shown["interior"].alias("interiorImages"),
        shown["master_plan"].alias("masterPlan"), landmark_groups(c("landmarks")).alias("landmarks"), c("listing_url").alias("listingUrl"), F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updatedAt"),
        c("investment_score").alias("investmentScore"), c("risk_score").alias("riskScore"), c("location_score").alias("locationScore"),
    )


def project_segments(projects: DataFrame, publishable: Column, commercial: Column, city: str = "city") -> DataFrame:
    """(segment, total) of projects by city and category, as ``listing_segments``."""
    key = labelled(F.col(city), CITY_KEYS, None)
    name = F.when(key.isNull(), "no_segment").when(publishable, F.concat(key, F.when(commercial, "Commercial").otherwise("Residential"), F.lit("Projects")))
    counts = projects.select(name.alias("segment")).groupBy("segment").agg(F.count("*").alias("total"))
    every = projects.sparkSession.createDataFrame([(f"{k}{c}Projects",) for k in CITY_KEYS.values() for c in PROJECT_CATEGORIES] + [("no_segment",), (None,)], "segment string")
    return F.broadcast(every).join(counts, every["segment"].eqNullSafe(counts["segment"]), "left").select(every["segment"], F.coalesce("total", F.lit(0)).alias("total"))


def export(records: DataFrame, segment: Column, path: str) -> None:
    """One JSON line per record, a folder per segment."""
    records.select(segment.alias("segment"), F.to_json("record").alias("value")).write.mode("overwrite").partitionBy("segment").text(path)


# ---------------------------------------------------------------- labels of the client


def indian_digits(n: Column) -> Column:
    """1234567 -> 12,34,567."""
    digits = n.cast("bigint").cast("string")
    head, tail = F.substring(digits, F.lit(1), F.length(digits) - 3), F.substring(digits, F.length(digits) - 2, F.lit(3))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    return F.when(F.length(digits) > 3, F.concat(grouped, F.lit(","), tail)).otherwise(digits)


def ago(at: Column, as_of: Column) -> Column:
    """today, 3d ago, 2mo ago, 1y ago."""
    days = F.datediff(as_of.cast("date"), at.cast("date"))
    return F.when(days <= 0, "today").when(days < 30, F.concat(days.cast("string"), F.lit("d ago"))).when(days < 360, F.concat(F.floor(days / 30).cast("string"), F.lit("mo ago"))).otherwise(F.concat(F.floor(F.floor(days / 30) / 12).cast("string"), F.lit("y ago")))


def envelope(records: DataFrame, segment: str, page: int = 1, limit: int = 500, order: str = "id") -> DataFrame:
    """(segment, page, limit, total, results): one page of records(id, record) as a row."""
    total = records.count()
    rows = records.orderBy(order).offset(max(page - 1, 0) * limit).limit(limit)
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)  # noqa: E731  records hold maps, which don't sort
    out = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "record")), by_key), lambda r: r["record"]).alias("results"))
    return out.select(F.lit(True).alias("success"), F.lit(segment).alias("city"), F.lit(page).alias("page"), F.lit(limit).alias("limit"), F.lit(total).alias("total"), "results")
