import json
from datetime import date, datetime

from pyspark.sql import functions as F

from gridmason.sources import archive, html

PAGE = """<html><head><title>3 BHK</title><link rel="canonical" href="/c"><script type="application/ld+json">{"@graph": [{"geo": {"latitude": 28.5, "longitude": 77.1}, "offers": {"price": "1.2 Cr",}}]}</script></head>
<body><h1>Flat <b>here</b></h1><p>one<p>two<table><tr><td>Area:</td><td>1200 sqft</td></tr></table><dl><dt>Floor</dt><dd>5</dd></dl><ul><li>Facing: East</li></ul>
<img src="/placeholder.png"><img data-src="/a.jpg" alt="front"><img src="/a.jpg"><img src="http://x.com/b.webp"><a href="../d#e">x</a><a href="mailto:q">y</a></body></html>"""


def test_extract():
    got = html.extract("http://x.com/p/q", PAGE)
    assert (got["title"], got["heading"], got["canonical"], got["price_text"], got["latitude"]) == ("3 BHK", "Flat here", "/c", "1.2 Cr", 28.5)
    assert got["specifications"] == {"Area": "1200 sqft", "Floor": "5", "Facing": "East"}
    assert [i["url"] for i in got["images"]] == ["http://x.com/a.jpg", "http://x.com/b.webp"] and got["images"][0]["is_primary"]
    assert html.extract("", None)["title"] is None


def test_json_helpers():
    assert html.assigned_json('window.S = {"a": {"b": "}"}} ; x', "window.S") == {"a": {"b": "}"}}
    assert html.assigned_json("nothing", "window.S") is None
    assert html.find_keys({"a": [{"k": 1}], "k": 2}, "k") == [2, 1]
    assert html.deep_get({"a": [{"b": 3}]}, "a.0.b") == 3 and html.deep_get({"a": 1}, "a.b") is None
    assert html.landmark("City Hospital", "500 m") == {"category": "hospital", "name": "City Hospital", "distance_km": 0.5, "raw_distance": "500 m"}


def test_pages(spark):
    df = spark.createDataFrame([(1, "http://x.com/p/q", PAGE), (2, None, None)], "page_id int, url string, html string")
    assert [r["l"] for r in df.select("page_id", html.page_links("url", "html").alias("l")).orderBy("page_id").collect()] == [["http://x.com/d"], []]
    assert [r["h"] for r in html.read_pages(df).select("page_id", F.col("page.heading").alias("h")).orderBy("page_id").collect()] == ["Flat here", None]


def test_archive(spark, tmp_path):
    path = str(tmp_path / "raw")
    df = spark.createDataFrame([("s", "u1", "b", datetime(2026, 1, 2)), ("s", "u2", "b", datetime(2026, 3, 2))], "source string, url string, body string, fetched_at timestamp")
    archive.put(df, path)
    back = archive.replay(spark, path, "s")
    assert back.count() == 2 and back.filter("url = 'u1'").first()["key"].startswith("s/2026/01/02/")
    assert [r["url"] for r in archive.kept(back, F.lit(date(2026, 3, 10)), 30).collect()] == ["u2"] and archive.kept(back, F.lit(date(2026, 3, 10)), 0).count() == 2
    assert archive.usage(spark, path).first()["bytes"] > 0


def test_feed_and_records(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"total": 3, "results": [{"id": 1}, {"id": 2}, {"id": 3}]}))
    got = archive.read_feed(spark, str(tmp_path / "f.json"), 2, 2).first()
    assert got["total"] == 3 and [r["id"] for r in got["results"]] == [3]
    raw = spark.createDataFrame([("r", 0, '{"id": 1}'), ("r", 1, "{broken"), ("r", 500, '{"id": 2}')], "request string, index int, json string")
    ok, bad = archive.parse_records(raw, "id int")
    assert [(r["index"], r["id"]) for r in ok.collect()] == [(0, 1)] and sorted(r["reason"] for r in bad.collect()) == ["malformed record", "too many records"]


def test_comments(spark):
    reply = {"data": {"children": [{"kind": "t1", "data": {"id": "c2", "body": "b", "score": 5, "author": "[deleted]", "replies": ""}}, {"kind": "more", "data": {"id": "m"}}]}}
    tree = [{}, {"data": {"children": [{"kind": "t1", "data": {"id": "c1", "body": "a", "score": 2, "author": "u", "replies": reply}}, {"kind": "t1", "data": {"id": "c3", "body": "[removed]", "score": 9}}]}}]
    got = archive.comments(spark.createDataFrame([("p", json.dumps(tree))], "post_id string, json string")).orderBy("rank").collect()
    assert [(r["id"], r["depth"], r["author"]) for r in got] == [("c2", 1, None), ("c1", 0, "u")]


def test_backlog(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "source_id string")
    assert [r["source_id"] for r in archive.backlog(ids("a", "b", "c"), ids("a"), ids("c", "a")).collect()] == ["b"]
    xml = spark.createDataFrame([("<loc>http://x/noida</loc><loc>http://x/delhi</loc>",)], "xml string")
    assert [r["url"] for r in archive.sitemap(xml, F.col("url").contains("noida")).collect()] == ["http://x/noida"]
