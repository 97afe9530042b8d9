from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridmason.functions import area, classify, dates, hashing, money, places, text, urls

def AS_OF():  # noqa: N802
    return F.lit(datetime(2026, 7, 22, 10, 0))



def test_text(values):
    assert values(text.clean, ["  a \n b ", "", None, " "]) == ["a b", None, None, None]
    assert values(lambda c: text.clean(c, unicode=True), ["ﬁne", None]) == ["fine", None]
    assert values(lambda c: text.slug(c, unicode=True), ["Café del Mar!", None, "--"]) == ["cafe-del-mar", "", ""]
    assert values(text.normal_name, ["M3M India Pvt. Ltd.", "M3M INDIA", "Godrej Properties Limited", "", None]) == ["m3m", "m3m", "godrej", None, None]
    assert values(text.tokens, ["A1, b!", None]) == [["a1", "b"], []]
    assert values(text.distinct_ci, [["A", " a ", "", "B"], None], "array<string>") == [["A", "B"], None]


def test_money(values):
    cases = {"₹ 1.25 Cr": 12500000, "85 Lac": 8500000, "Rs. 45,00,000": 4500000, "₹ 32,000/month": 32000, "3 BHK in Sector 82 for 1.2 Cr": 12000000, "Price on Request": None, None: None, "0": None}
    assert [x and int(x) for x in values(money.price, list(cases))] == list(cases.values())
    ranges = {"1.2 - 2.4 Cr": (12000000, 24000000), "₹85 Lac - ₹1.2 Cr": (8500000, 12000000), "50 L": (5000000, None), None: (None, None)}
    assert [tuple(v and int(v) for v in r) if r else (None, None) for r in values(money.price_range, list(ranges))] == list(ranges.values())
    assert [x and int(x) for x in values(money.price_per_sqft, ["₹12,500 per sq.ft", "₹12,500"])] == [12500, None]
    assert values(money.display, [12500000, 8500000, 45000, None], "bigint") == ["1.25 Cr", "85 L", "45,000", None]
    assert values(lambda c: money.segment(c, F.lit("sale")), [3_500_000, 90_000_000, 0, None, 200_000_000], "bigint") == ["affordable", "luxury", "unknown", "unknown", "ultra_luxury"]
    assert values(lambda c: money.segment(c, F.lit("rent")), [20_000, 250_000], "bigint") == ["affordable", "luxury"]


def test_area(values):
    got = values(area.area, ["145 sq yards", "200 gaj", "2.5 Acres", "1200", "0", None])
    assert [(a["value"], a["unit"]) for a in got] == [(145, "sqyd"), (200, "sqyd"), (2.5, "acre"), (1200, "sqft"), (None, None), (None, None)]
    assert values(lambda c: area.to_sqft(F.lit(100.0), c), ["sqm", "sqyd", None]) == [1076.39, 900.0, 100.0]
    assert values(area.bedrooms, ["1 RK", "Studio Apartment", "3 BHK", "villa", None]) == [1, 0, 3, None, None]
    assert values(area.configuration, ["3bhk+study", "studio", "x", None]) == ["3 BHK + Study", "Studio", "x", None]
    assert [(f["floor"], f["total"]) for f in values(area.floors, ["5 out of 14", "Ground Floor of 4", "basement", None])] == [(5, 14), (0, 4), (-1, None), (None, None)]
    assert values(area.km, ["1.5 km", "500 m", "800 metre", None]) == [1.5, 0.5, 0.8, None]


def test_classify(values):
    assert values(classify.property_type, ["Builder Floor Apartment", "Residential Plot", "", None]) == ["builder_floor", "plot", "other", "other"]
    assert values(classify.listing_type, ["PG for girls", "flat for rent", "new launch", "", None]) == ["pg", "rent", "new_launch", "unknown", "unknown"]
    assert values(classify.seller_type, ["Owner", "Builder", "Broker", "x", None]) == ["owner", "builder", "agent", "unknown", "unknown"]
    assert values(lambda c: classify.possession_status(c, AS_OF().cast("date")), ["Immediate Possession", "December '27", "2020", None]) == ["ready_to_move", "under_construction", "completed", "unknown"]
    assert values(classify.registration, ["RC/REP/HARERA/GGM/812/544/2024/45", "id UPRERAPRJ123456.", "none"]) == ["RC/REP/HARERA/GGM/812/544/2024/45", "UPRERAPRJ123456", None]
    assert values(classify.phone, ["Call 98765 43210", "12345", None]) == ["+919876543210", None, None]
    assert values(classify.email, ["write A.B@x.com now", None]) == ["a.b@x.com", None]


def test_dates(values):
    assert values(dates.possession_date, ["December '27", "2028", "Sept 2026", "soon", None]) == [date(2027, 12, 1), date(2028, 1, 1), date(2026, 9, 1), None, None]
    got = values(lambda c: dates.listing_date(c, AS_OF(), fuzzy=True), ["3 days ago", "today", "yesterday", "2 hours ago", "Posted on 12 Jan 2026", "Sector 4599", None])
    assert got == [datetime(2026, 7, 19, 10), datetime(2026, 7, 22, 10), datetime(2026, 7, 21), datetime(2026, 7, 22, 10), datetime(2026, 1, 12), None, None]


def test_places(values):
    assert values(places.sector, ["Sec-102", "sector 37c", "no", None]) == ["Sector 102", "Sector 37C", None, None]
    assert values(places.city, ["Greater Noida", "Noida", "Dwarka", "Dwarka Expressway", None]) == ["greater_noida", "noida", "delhi", "gurgaon", "unknown"]
    assert values(places.locality, ["3 BHK Flat in Sector 82, Gurgaon", "Sushant Lok Phase 1, Gurgaon", None]) == ["Sector 82", "Sushant Lok Phase 1", None]
    assert len(places.sector_table()) == 76
    got = values(lambda c: places.location(c, lat=F.lit(0.0), lng=F.lit(0.0)), ["Sector 49, Gurgaon 122018"])[0]
    assert (got["city"], got["sector"], got["pincode"], got["state"], got["geo"]) == ("gurgaon", "Sector 49", "122018", "Haryana", None)
    assert values(lambda c: F.round(places.distance_km(F.lit(28.0), F.lit(77.0), c, F.lit(77.0)), 1), [29.0], "double") == [111.3]


def test_urls(values, spark):
    assert values(urls.canonical, ["https://X.com/a/?utm_source=1&b=2&a=1#f", "http://x.com", None]) == ["https://x.com/a?a=1&b=2", "http://x.com/", None]
    assert values(lambda c: urls.absolute(F.lit("https://x.com/a/b"), c), ["../c#d", "mailto:x", "", None, "//y.com/z"]) == ["https://x.com/c", None, None, None, "https://y.com/z"]
    assert values(urls.sitemap_locations, ["<loc> http://a </loc>\n<loc>http://b</loc>"]) == [["http://a", "http://b"]]
    assert values(lambda c: urls.in_city(c, "noida", "greater"), ["/flats-noida/", "/flats-greater-noida/"]) == [True, False]
    assert values(lambda c: urls.first_id(c, [r"id=(\d+)"]), ["http://a/x?id=7", "http://a/slug-9/"]) == ["7", "slug-9"]


@pytest.mark.parametrize(
    ("status", "body", "retry", "kind", "wait"),
    [(429, "", "120", "rate_limited", 120.0), (503, "", None, "rate_limited", 30.0), (401, "", None, "login_required", None), (403, "hcaptcha", None, "captcha", None), (403, "no", None, "forbidden", None),
     (200, " ", None, "empty_shell", None), (200, "<html>tiny</html>", None, "empty_shell", 15.0), (200, "x" * 900, None, "none", None), (200, "<title>Just a moment", None, "waf", None)],
)
def test_block_kind(spark, status, body, retry, kind, wait):
    df = spark.createDataFrame([(status, body, retry)], "s int, b string, r string")
    got = df.select(urls.block_kind(F.col("s"), F.col("b"), F.col("r")).alias("k")).first()["k"]
    assert (got["kind"], got["wait_s"]) == (kind, wait)


def test_hashing(values, spark):
    def by_hand(tokens):
        total = [0] * 64
        for t in tokens:
            h = hashing._fnv(t)
            for i in range(64):
                total[i] += 1 if h >> i & 1 else -1
        x = sum(1 << i for i in range(64) if total[i] > 0)
        return x - (1 << 64) if x >> 63 else x

    words = [["godrej", "aristocrat"], ["a", "a", "b"], [], None]
    assert values(hashing.simhash, words, "array<string>") == [by_hand(w) if w else 0 for w in words]
    assert values(lambda c: hashing.hamming(c, F.lit(0).cast("bigint")), [7, -1], "bigint") == [3, 64]
    assert hashing._fnv("a") == 0xAF63DC4C8601EC8C
