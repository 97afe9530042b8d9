import json
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmason import api
from gridmason.operators import feed, posts
from gridmason.sources import html

NOW = datetime(2026, 7, 1)


def test_parse_listing(spark):
    post = lambda **k: {"data": {"id": "a", "title": "t", "created_utc": 1767225600, "score": 1, **k}}
    pages = [json.dumps({"data": {"children": [post(), post(score=5, author="AutoModerator", upvote_ratio=0.12345), post(id="b", created_utc=0)]}}), "broken"]
    got = posts.parse_listing(spark.createDataFrame([(p,) for p in pages], "json string")).orderBy("source_id").collect()
    assert [(r["source_id"], r["score"], r["author"], r["created_utc"]) for r in got] == [("a", 5, None, datetime(2026, 1, 1)), ("b", 1, None, None)]
    assert got[0]["upvote_ratio"] == 0.123


def test_enrich_and_search(spark):
    df = spark.createDataFrame([("1", "DLF flat in Sector 49", "Great builder, rent is fine", "gurgaon", ["metro near"], 5, NOW), ("2", "food", None, "delhi", None, 1, NOW)], "source_id string, title string, body string, subreddit string, comments array<string>, score int, created_utc timestamp")
    rich = posts.enrich(df, ["DLF Camellias"])
    r = {x["source_id"]: x for x in rich.collect()}
    assert r["1"]["detected_builders"] == ["DLF"] and r["1"]["detected_sectors"] == ["Sector 49"] and r["1"]["detected_city"] == "gurgaon" and r["1"]["relevance_score"] == 96
    assert r["2"]["detected_city"] == "delhi" and r["2"]["sentiment"] == "neutral" and "metro" in r["1"]["topics"]
    assert [(x["source_id"], x["total"]) for x in posts.search(rich, "dlf", min_score=2).collect()] == [("1", 1)]
    assert [x["source_id"] for x in posts.search(rich, builder="DLF").collect()] == ["1"] and posts.search(rich, town="noida").count() == 0
    assert posts.search(rich, page=2, size=1).count() == 1


LOCATION = T.StructType([T.StructField(n, T.StringType()) for n in ("sector", "sub_locality", "locality", "city")])


def test_feed_records(spark, tmp_path):
    s = ("id string, name string, title string, project_name string, location struct<sector:string,sub_locality:string,locality:string,city:string>, price double, price_max double, price_min double, rent_monthly double, area_sqft double,"
         "configuration string, bedrooms int, property_type string, listing_type string, is_commercial boolean, rera_number string, possession_status string, status string, possession_date date, builder_name string, description string, amenities array<string>,"
         "specifications map<string,string>, images array<struct<url:string>>, landmarks array<struct<category:string,name:string,distance_km:double,raw_distance:string>>, listing_url string, project_url string, scraped_at timestamp, investment_score double,"
         "risk_score double, location_score double, configurations array<struct<configuration:string,area_sqft:double,price_min:double,price_display:string>>, total_units int, project_area_acres double, construction_updates array<string>")  # fmt: skip
    row = dict(id="s:1", name="Godrej Aristocrat", title=None, project_name="P", location=("Sector 49", None, "Sector 49", "gurgaon"), price=3.5e7, price_max=None, price_min=2.85e7, rent_monthly=None, area_sqft=2100.0, configuration="3 BHK", bedrooms=3,
               property_type="apartment", listing_type="sale", is_commercial=False, rera_number=None, possession_status="completed", status="completed", possession_date=None, builder_name="B", description="a\n\nb", amenities=["Gym"], specifications={"k": "v"},
               images=[("http://i/1.jpg",)], landmarks=[("metro", "M", 1.5, None)], listing_url="u", project_url="u", scraped_at=NOW, investment_score=1.0, risk_score=2.0, location_score=3.0,
               configurations=[("3 BHK", 1900.0, 2.85e7, None)], total_units=10, project_area_acres=2.5, construction_updates=[])
    names = [p.strip().split(" ")[0] for p in ("id name title project_name location price price_max price_min rent_monthly area_sqft configuration bedrooms property_type listing_type is_commercial rera_number possession_status status possession_date builder_name description amenities specifications images landmarks listing_url project_url scraped_at investment_score risk_score location_score configurations total_units project_area_acres construction_updates").split()]
    df = spark.createDataFrame([tuple(row[n] for n in names)], s)
    p = df.select(feed.project_record().alias("r")).first()["r"].asDict(True)
    assert len(p) == 23 and p["location"] == "Sector 49, Gurgaon" and p["price"] == "2.85 Cr" and p["BHKType"] == "3 BHK" and p["possession"] == "Completed" and p["totalArea"] == "2.5 Acres"
    assert p["flats"] == {"3 BHK": [{"size": "1900 sq.ft", "price": "2.85 Cr", "image": "http://i/1.jpg"}]} and p["landmarks"] == {"metro": [{"name": "M", "distance": "1.5 KM"}]}
    r = df.select(feed.listing_record().alias("r")).first()["r"].asDict(True)
    assert r["title"] == "P" and r["price"] == "3.5 Cr" and r["rentMonthly"] is None and r["size"] == "2100 sq.ft" and r["aboutProject"] == ["a", "b"]
    records = df.select("id", feed.listing_record().alias("record"))
    page = feed.envelope(records, "ggnSaleProperties").first()
    assert (page["total"], len(page["results"]), page["city"]) == (1, 1, "ggnSaleProperties") and feed.envelope(records, "x", page=2).first()["results"] == []
    feed.export(records, F.lit("ggnSaleProperties"), str(tmp_path / "feed"))
    assert json.loads(spark.read.text(str(tmp_path / "feed")).first()["value"])["id"] == "s:1"


def test_labels(values):
    assert values(feed.indian_digits, [7, 1000, 1234567, None], "long") == ["7", "1,000", "12,34,567", None]
    assert values(lambda c: feed.ago(c, F.lit(NOW)), [datetime(2026, 7, 1), datetime(2026, 6, 28), datetime(2026, 4, 1), datetime(2024, 7, 1)], "timestamp") == ["today", "3d ago", "3mo ago", "2y ago"]


def test_html_tables():
    page = "<link rel=next href=x><table><tr><th>Plan</th></tr><tr><td>3 BHK</td><td data-sqft=1900>176 sq yd</td><td>₹ 2.85 Cr</td></tr></table><ul><li>Metro Station - 1.5 km</li><li>City Hospital (500 m)</li><li>Gym</li></ul>"
    root = html.parse(page)
    assert html.unit_tables(root) == [{"configuration": "3 BHK", "area_text": "1900 sqft", "price_text": "₹ 2.85 Cr"}]
    assert [(x["category"], x["distance_km"]) for x in html.landmarks(root)] == [("metro", 1.5), ("hospital", 0.5)]
    assert html.has_next(root) and not html.has_next(html.parse("<p>x"))


def test_search_urls(values):
    url = lambda deal, page: lambda c: html.search_url(c, F.lit("Greater Noida "), F.lit(deal), F.lit(page))
    assert values(url("sale", 1), ["magicbricks", "squareyards", "housing", "x"]) == ["https://www.magicbricks.com/property-for-sale-in-greater-noida-pppfs", "https://www.squareyards.com/new-projects-in-greater-noida", "https://housing.com/in/buy/greater-noida", None]
    assert values(url("rent", 2), ["magicbricks", "squareyards"]) == ["https://www.magicbricks.com/property-for-rent-in-greater-noida-pppfr?page=2", "https://www.squareyards.com/greater-noida/property-for-rent?page=2"]


def test_search_urls_of_cities_and_kinds(values):
    url = lambda portal, deal="sale", page=1, kind=None: lambda c: html.search_url(F.lit(portal), c, F.lit(deal), F.lit(page), None if kind is None else F.lit(kind))
    mb = "https://www.magicbricks.com/"
    assert values(url("magicbricks"), ["delhi", "New Delhi", "Gurugram", "Gurgaon"]) == [f"{mb}property-for-sale-in-{c}-pppfs" for c in ("new-delhi", "new-delhi", "gurgaon", "gurgaon")]
    assert values(url("magicbricks", kind="shop"), ["Gurgaon"]) == [f"{mb}shops-for-sale-in-gurgaon-pppfs"]
    assert values(url("magicbricks", "rent", kind="office"), ["Gurgaon"]) == [f"{mb}office-space-for-rent-in-gurgaon-pppfr"]
    assert values(url("magicbricks", kind="something-new"), ["Gurgaon"]) == [f"{mb}property-for-sale-in-gurgaon-pppfs"]
    assert values(url("housing", "rent", 3, "flats"), ["Delhi"]) == ["https://housing.com/in/rent/delhi/flats?page=3"]


def test_scoring_jobs(spark):
    s = "builder_id long, name string, established_year int"
    table = spark.createDataFrame([(1, "A", 2016), (2, "B", None)], s)
    card = spark.createDataFrame([(1, "A", 10, 10, 0, 0, 0, 0, 0)], "builder_id long, name string, project_count long, completed_count long, ongoing_count long, positive_mentions long, negative_mentions long, delay_mentions long, fraud_mentions long")
    got = {r["builder_id"]: r for r in api.score_builders(table, card, F.lit(NOW)).collect()}
    assert got[1]["trust_score"] == 50 + 15 + 4 and got[1]["risk_score"] == 31 and got[2]["trust_score"] == 50 and "low-confidence" in got[2]["reputation_summary"]
    rows = spark.createDataFrame([("a", True, "g", None, "sale", 2, 1, 100.0, "completed", NOW), ("b", False, "g", "", "sale", 2, 1, 100.0, "completed", NOW)], "id string, is_active boolean, city string, sector string, listing_type string, bedrooms int, builder_id long, price_per_sqft double, possession_status string, first_seen_at timestamp")
    trends = spark.createDataFrame([("g", "", "sale", NOW, 100.0, 40, "m", "t"), ("g", None, "sale", datetime(2025, 1, 1), 1.0, 99, "m", "t")], "city string, sector string, listing_type string, period timestamp, median_price_per_sqft double, listing_count long, micro_market string, property_type string")
    yields = spark.createDataFrame([("g", None, 2, 4.0)], "city string, sector string, bedrooms int, rental_yield_pct double")
    out = api.score_properties(rows, spark.createDataFrame([(1, 80.0)], "builder_id long, trust_score double"), trends, yields, F.lit(NOW)).collect()
    location, risk = 55 * 0.6 + 2, 5 + 12 + 5
    assert [(r["id"], r["location_score"], r["risk_score"]) for r in out] == [("a", location, risk)]
    assert out[0]["investment_score"] == round(location * 0.3 + 25 + 14 + 5 + 4 + 4 - risk * 0.3, 2)
