from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridmason.operators import duplicates, entities, feed, history, merge, queue, rollups, scoring, search

NOW = datetime(2026, 7, 1)
def AS_OF():  # noqa: N802
    return F.lit(NOW)



def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_price_changes(spark):
    log = [("a", datetime(2026, 1, d), p) for d, p in ((1, 23_500_000.0), (2, 21_000_000.0), (3, 21_000_000.0), (4, None), (5, 22_000_000.0))]
    got = history.price_changes(spark.createDataFrame(log, "property_id string, observed_at timestamp, price double"))
    assert [(r["price"], r["previous_price"], r["change_pct"]) for r in got.orderBy("observed_at").collect()] == [(23.5e6, None, None), (21e6, 23.5e6, -10.638), (22e6, 21e6, 4.762)]


def test_upsert(spark):
    s = "id string, price double, title string, tags array<string>, seen int, at int"
    old = spark.createDataFrame([("a", 1.0, "old", ["x"], 1, 0), ("b", 2.0, "b", None, 1, 0)], s)
    new = spark.createDataFrame([("a", None, "", ["y"], 9, 1), ("a", 5.0, "later", ["z"], 9, 2), ("c", 3.0, None, None, 9, 1)], s)
    got = merge.upsert(old, new, "id", ["price"], ["title"], ["seen"], ["tags"], [F.desc("at")])
    assert rows(got, "id") == [("a", 5.0, "later", 1, ["x", "z"]), ("b", 2.0, "b", 1, []), ("c", 3.0, None, 9, [])]
    got = merge.upsert(old, new.filter("at = 1"), "id", ["price"], ["title"])
    assert rows(got, "id")[0] == ("a", None, "old")


def test_merge_helpers(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(merge.replace_groups(t, spark.createDataFrame([("a", 9)], "k string, v int"), "k", True), "k") == [("a", 9), ("b", 2)]
    assert rows(merge.update_existing(t, spark.createDataFrame([("a", 7), ("z", 1)], "k string, v int"), "k", ["v"]), "k") == [("a", 7), ("b", 2)]
    assert rows(merge.find_or_create(t, spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "k string"), "k"), "k") == [("c",)]
    live = spark.createDataFrame([("a", True, datetime(2026, 6, 1), None), ("b", True, datetime(2026, 6, 30), None), ("c", True, None, None)], "id string, is_active boolean, last_seen_at timestamp, delisted_at timestamp")
    assert [(r["id"], r["is_active"], r["delisted_at"]) for r in merge.mark_stale(live, AS_OF()).orderBy("id").collect()] == [("a", False, NOW), ("b", True, None), ("c", True, None)]
    ok, bad = merge.accept_reject(t, {"positive": F.col("v") > 1})
    assert rows(ok, "k") == [("b", 2)] and bad.first()["reasons"] == ["positive"]


def test_rollups_edge(spark):
    s = "city string, sector string, micro_market string, property_type string, listing_type string, price double, price_per_sqft double, rent_monthly double, area_sqft double, bedrooms int, is_active boolean, canonical_id string, listed_at timestamp, first_seen_at timestamp, location_id string"
    row = lambda t, p, r=None: ("g", None, None, "flat", t, p, None, r, 1.0, 2, True, None, None, datetime(2026, 5, 3), "l")
    df = spark.createDataFrame([row("sale", p) for p in (None, 0.0)], s)
    t = rollups.locality_trends(df).first()
    assert (t["max_price"], t["min_price"], t["median_price"], t["key"]) == (0.0, None, None, "g|||flat|sale|2026-05")
    df = spark.createDataFrame([row("sale", p * 1e6) for p in (1, 2, 3, 4)] + [row("rent", None, r) for r in (10.0, 20.0, 30.0)], s)
    y = rollups.rental_yield(df).first()
    assert (y["median_price"], y["median_rent"], y["sale_sample"], y["rent_sample"], y["rental_yield_pct"]) == (2.5e6, 20.0, 4, 3, 0.01)
    assert rollups.rental_yield(df.limit(0)).count() == 0
    assert rows(rollups.facets(df, {"listing_type": 1, "sector": 3}), "facet") == [("listing_type", "sale", 4)]


def test_search(spark):
    q = search.Query(q="x", city="Noida", page=3, sort="newest")
    assert q.fingerprint() == search.Query(q="X ", city="noida").fingerprint() and search.Query(page=2).fingerprint() == "empty"
    assert search.Query(page=0, limit=500).window() == (0, 100)
    s = "id string, is_active boolean, canonical_id string, project_name string, price double, rent_monthly double, amenities array<string>, keywords array<string>, tags array<string>, last_seen_at timestamp, sector string, locality string, builder_name string"
    df = spark.createDataFrame([
        ("a", True, None, "Godrej Aristocrat", 5.0, None, ["gym", "pool"], None, None, NOW, "Sector 1", None, "Godrej"), ("b", True, "a", "Godrej Aristocrat", 5.0, None, None, None, None, NOW, None, "Sushant", None),
        ("c", False, None, "Godrej", 5.0, None, None, None, None, NOW, None, None, None), ("d", True, None, "Other", None, 5.0, ["gym"], ["metro"], None, NOW, None, None, None),
    ], s)
    ids = lambda query: [r["id"] for r in df.filter(search.condition(query, df.columns)).orderBy("id").collect()]
    assert ids(search.Query()) == ["a", "d"] and ids(search.Query(include_duplicates=True)) == ["a", "b", "d"]
    assert ids(search.Query(amenities=["gym", "pool"])) == ["a"] and ids(search.Query(keywords=["metro"])) == ["d"]
    assert ids(search.Query(price_min=1, price_max=9)) == ["a", "d"] and ids(search.Query(price_min=6)) == []
    assert ids(search.Query(near_lat=1.0, near_lng=1.0, radius_km=5.0)) == []
    hits = search.search(df, search.Query(q="godrej aristocrot"), AS_OF()).collect()
    assert [(r["id"], r["score"], r["total"]) for r in hits] == [("a", 30, 1)]
    assert rows(search.suggest(df, "god"), "kind") == [("Godrej", "builder"), ("Godrej Aristocrat", "project")]


def test_duplicates(spark):
    s = "id string, source string, source_id string, name string, title_hash bigint, area_sqft double, price double, rent_monthly double, configuration string, sector string, locality string, city string, listing_type string, images array<string>"
    base = ("Godrej Air", 0, 1500.0, 1e7, None, "3 BHK", "Sector 1", None, "g", "sale", None)
    df = spark.createDataFrame([
        ("a", "x", "1", *base), ("b", "y", "1", *base), ("c", "y", "2", "Godrej Air", -1, 2500.0, 2e7, None, "3 BHK", "Sector 1", None, "g", "sale", ["http://i/1.jpg?w=2"]),
        ("d", "z", "2", "Other", 255, 9000.0, 9e7, None, "3 BHK", "Sector 1", None, "g", "sale", ["http://i/1.jpg"]), ("e", "y", "3", *base[:7], None, "noida", "sale", None),
    ], s)
    got = {(r["left"], r["right"]): (r["score"], r["reason"]) for r in duplicates.find_duplicates(df).collect()}
    assert set(got) == {("a", "b"), ("c", "d")} and got[("a", "b")][0] == 1.0 and got[("c", "d")][0] == 0.95 and "shared image" in got[("c", "d")][1]
    many = spark.createDataFrame([(f"k{i:02}", "x", str(i), *base) for i in range(60)] + [("s1", "x", "9", "One", 0, 100.0, 1e6, None, "1 BHK", "Sector 9", None, "g", "sale", None), ("s2", "x", "9", "Two", -1, 900.0, 9e6, None, "1 BHK", "Sector 9", None, "g", "sale", None)], s)
    got = duplicates.find_duplicates(many).collect()
    assert sorted((r["left"], r["right"]) for r in got) == sorted([("k00", f"k{i:02}") for i in range(1, 60)] + [("s1", "s2")])  # one pair for each copy
    assert {(r["score"], r["reason"]) for r in got if r["left"] == "s1"} == {(1.0, "same source id")}
    with pytest.raises(ValueError, match="threshold"):
        duplicates.find_duplicates(df, threshold=0.5)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "canonical string, duplicate string")
    linked = duplicates.link(spark.createDataFrame([("a", None), ("b", None), ("c", None)], "id string, canonical_id string"), edges)
    assert rows(linked, "id") == [("a", None, 2), ("b", "a", 0), ("c", "a", 0)]


def test_scores(spark):
    none = lambda t: F.lit(None).cast(t)
    one = spark.range(1)
    loc = one.select(scoring.location(F.lit("Golf Course Road"), F.array(F.struct(F.lit("Metro").alias("category"), F.lit(1.0).alias("distance_km")), F.struct(F.lit("metro").alias("category"), F.lit(9.0).alias("distance_km")), F.struct(F.lit("mall").alias("category"), F.lit(4.0).alias("distance_km"))), F.lit(True), F.lit(100)).alias("s")).first()["s"]
    assert loc["value"] == round(92 * 0.6 + 12 + 3.6 + 5 + 3, 2)

    def risk(status="ready_to_move", due=None, reg="R", trust=100.0, ppsf=100.0, median=100.0, neg=0, n=0, age=0):
        s = scoring.risk(F.lit(status), F.lit(due).cast("date"), F.lit(reg), F.lit(trust).cast("double"), F.lit(ppsf).cast("double"), F.lit(median).cast("double"), F.lit(neg), F.lit(n), F.lit(age), AS_OF())
        return one.select(s.alias("s")).first()["s"]["value"]

    assert risk() == 5.0 and risk(reg=None) == 17.0 and risk(trust=None) == 20.0 and risk(ppsf=200.0) == 20.0 and risk(ppsf=50.0) == 11.0
    assert risk("under_construction", "2026-04-02") == 25 + 4.5 and risk(neg=4, n=4) == 20.0 and risk(age=300) == 7.0
    trust = scoring.builder_trust(F.lit(10), F.lit(0), F.lit(20), F.lit(2016), none("double"), none("int"), F.lit(0), F.lit(4), F.lit(1), F.lit(2), F.lit(90.0), AS_OF())
    hard = 50 + 15 * 0.75 + 4 - 12 - 2 - 8
    assert one.select(trust.alias("s")).first()["s"]["value"] == pytest.approx(hard * 0.7 + 27, abs=0.01)
    inv = scoring.investment(F.lit(100.0), F.lit(0.0), F.lit(10.0), F.lit(50.0), F.lit(100.0), F.lit(50.0), F.lit("new_launch"), F.lit("mid"), F.lit(10.0))
    assert one.select(inv.alias("s")).first()["s"]["value"] == 30 + 25 + 15 + 15 + 4 + 8


def test_queue(spark):
    s = "fingerprint string, status string, requested_at timestamp, claimed_at timestamp, claimed_by string, expires_at timestamp, cooldown_until timestamp, completed_at timestamp, created_at timestamp, records_written int, last_error string, attempts int"
    t = lambda h: datetime(2026, 6, 30, h)
    late = datetime(2026, 7, 2)
    tasks = spark.createDataFrame([("a", "pending", t(2), None, None, late, None, None, t(2), None, None, 0), ("b", "claimed", t(1), t(3), "w", late, None, None, t(1), None, None, 1), ("c", "pending", t(0), None, None, t(5), None, None, t(0), None, None, 0), ("d", "done", t(0), None, None, late, late, None, t(0), None, None, 1)], s)
    claimed = queue.claim(tasks, "me", AS_OF(), 1)
    assert [(r["fingerprint"], r["status"], r["claimed_by"], r["attempts"]) for r in claimed.orderBy("fingerprint").collect()] == [("a", "pending", None, 0), ("b", "claimed", "me", 2), ("c", "pending", None, 0), ("d", "done", None, 1)]
    done = queue.complete(claimed, spark.createDataFrame([("b", 3, None), ("a", 0, "x")], "fingerprint string, records_written int, error string"), AS_OF())
    assert [(r["status"], r["cooldown_until"]) for r in done.orderBy("fingerprint").limit(2).collect()] == [("failed", datetime(2026, 7, 1, 0, 30)), ("done", datetime(2026, 7, 1, 6))]
    asked = spark.createDataFrame([("a", 0), ("d", 0), ("n", 0), ("n2", 9), ("empty", 0)], "fingerprint string, result_count int")
    why = {r["fingerprint"]: r["reason"] for r in queue.decide(asked, tasks, AS_OF()).collect()}
    assert why == {"a": "already queued", "d": "cooling down", "n": "queued for backfill", "n2": "enough results", "empty": "unfiltered query"}
    assert dict(rows(queue.stats(tasks, AS_OF()), "name"))["budget_remaining"] == 496
    ev = spark.createDataFrame([("k", i) for i in range(5)] + [("k", 70)], "k string, s long")
    assert [r["admitted"] for r in queue.admit(ev, "k", "s", 3).orderBy("s").collect()] == [True, True, True, False, False, True]


def test_feed(values, spark):
    assert values(lambda c: feed.amenity_groups(c), [["Kids' Pool", "CCTV", "Gym", "Helipad"], []], "array<string>")[0][0]["amenities"] == ["Kids' Pool", "Gym"]
    got = values(feed.images, [["a/gallery1.jpg", "a/kitchen.jpg", "a/master-plan.jpg"], ["a/kitchen.jpg"], []], "array<string>")
    assert (got[0]["gallery"], got[0]["interior"], got[0]["master_plan"]) == (["a/gallery1.jpg"], ["a/kitchen.jpg"], "a/master-plan.jpg") and got[1]["gallery"] == ["a/kitchen.jpg"]
    assert values(feed.paragraphs, ["a\n\n b \n\n", "", None]) == [["a", "b"], [], []]
    c = "array<struct<configuration:string,area_sqft:double,price_min:double,price_display:string>>"
    rooms = [[("3 BHK", 1900.0, 2.85e7, None), ("4 BHK", 2400.0, None, "3.15 Cr")], []]
    assert values(feed.rooms_line, rooms, c) == ["3, 4 BHK", ""] and values(feed.size_line, rooms, c) == ["1900 to 2400", ""]
    assert [p["price"] for p in values(feed.price_list, rooms, c)[0]] == ["2.85 Cr", "3.15 Cr"]
    place = lambda c: feed.place_line(c, F.lit(None).cast("string"), F.lit("sector 80"), F.lit("greater_noida"))
    assert values(place, ["Sector 80", "Explore the project and its details today"]) == ["Sector 80, Greater Noida", "sector 80, Greater Noida"]
    assert values(lambda c: feed.price_line(c, F.lit(3.15e7)), [2.85e7, None, 3.15e7], "double") == ["2.85 Cr - 3.15 Cr", "3.15 Cr", "3.15 Cr"]


def test_entities(values, spark):
    assert values(entities.builders, ["DLF and signatureglobal, not atsx", None]) == [["DLF", "Signature Global"], []]
    assert values(lambda c: entities.projects(c, ["DLF Camellias"]), ["dlf-camellias"]) == [["DLF Camellias"]]
    assert values(entities.sectors, ["sec 82, sector-102 and Sector 37c, sec 82", None]) == [["Sector 82", "Sector 102", "Sector 37C"], []]
    assert values(entities.topics, ["rent, tenant and landlord; metro", None]) == [["renting", "metro"], []]
    got = values(entities.sentiment, ["good", "not good", "", None, "great but delay"])
    assert [g["label"] for g in got] == ["positive", "negative", "neutral", "neutral", "mixed"]
    assert values(entities.only_builder, ["DLF Crest", "DLF and M3M"]) == ["DLF", None]
    terms = entities.keyword_terms(spark.createDataFrame([(1, "builder metro flatty flatty flatty with")], "i int, t string"), "i", "t")
    assert [(r["term"], r["n"]) for r in rollups.term_counts(terms, "i", 2).orderBy("rank").collect()] == [("builder", 6), ("metro", 6)]


def test_every_pair_over_the_threshold_is_found(spark):
    """Against all pairs of a block: names of few and of many words, near in price, area, both or neither, at several thresholds."""
    import random

    r = random.Random(3)
    words = "red old hot new blue bolt ring plate anvil widget tower court".split()
    long = [f"w{i}" for i in range(9)]
    names = [" ".join(r.sample(words, r.randint(1, 3))) for _ in range(5)] + [" ".join(long), " ".join([*long[1:], "x"]), " ".join(long[:-1]), "Red  BOLT red", "", None]
    data = [(f"{i:03}", "s", str(i), r.choice(names), r.choice([None, 0.0, 1000.0, 1028.0, 1075.0]), r.choice([None, 0.0, 5e6, 5.09e6, 5.3e6]), None, "2 BHK", "s1", "c", "sale", r.choice([0, 1, 3, 2**40 - 1]), r.choice([[], [], [], ["u?1"]])) for i in range(160)]
    s = "id string, source string, source_id string, name string, area_sqft double, price double, rent_monthly double, configuration string, sector string, city string, listing_type string, title_hash long, images array<string>"
    df = spark.createDataFrame(data, s).dropDuplicates(["name", "area_sqft", "price", "title_hash", "images"]).withColumn("locality", F.lit(None).cast("string"))
    df = spark.createDataFrame(df.collect(), df.schema)
    every = df.withColumn("images", F.transform("images", lambda u: F.substring_index(u, "?", 1)))
    score, _ = duplicates._similarity()
    pairs = [(x["a"], x["b"], x["s"]) for x in every.alias("l").join(every.alias("r"), F.col("l.id") < F.col("r.id")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), score.alias("s")).collect()]
    for threshold in (0.61, 0.65, 0.75, 0.85):
        got = {(x["left"], x["right"]) for x in duplicates.find_duplicates(df, threshold).collect()}
        assert got == {(a, b) for a, b, p in pairs if p >= threshold} and got


def test_listings_of_one_block_and_area_are_not_compared_all_with_all(spark):
    """Other prices and names: nothing can match, so the join of listings makes no candidates."""
    s = "id string, source string, source_id string, name string, area_sqft double, price double, configuration string, sector string, city string, listing_type string"
    df = spark.createDataFrame([(f"{i}", "s", str(i), f"n{i} m{i}", 1000.0, 1e6 * 1.1**i, "2 BHK", "s1", "c", "sale") for i in range(120)], s)
    df = df.withColumns({"locality": F.lit(None).cast("string"), "rent_monthly": F.lit(None).cast("double"), "title_hash": F.lit(0).cast("long"), "images": F.array().cast("array<string>")})
    marks = []
    join = type(df).join
    try:
        type(df).join = lambda self, other, on=None, how=None: (marks.append((self, other)), join(self, other, on, how))[1]
        assert duplicates.find_duplicates(df).count() == 0
    finally:
        type(df).join = join
    left, right = next(x for x in marks if "mark" in x[0].columns)
    assert join(left.select("l.block", "l.mark", F.col("l.id").alias("x")), right.select("r.block", "r.mark", F.col("r.id").alias("y")), ["block", "mark"]).filter("x < y").count() == 0


def test_duplicates_with_a_shared_folder(spark, tmp_path, monkeypatch):
    """The listings are worked out once, not by each part of the result; repeated ids and source ids, copies and nulls give the same rows."""
    import random

    r = random.Random(5)
    names = ["red bolt", "old ring", "new anvil", None]
    data = [(f"{i % 70:03}", r.choice(["s", None]), str(i % 70) if i % 9 else "same", r.choice(names), r.choice([1000.0, 1028.0]), r.choice([None, 5e6]), None, "2 BHK", "s1", None, "c", "sale", r.choice([0, 1]), r.choice([[], ["u?1"]])) for i in range(120)]
    s = "id string, source string, source_id string, name string, area_sqft double, price double, rent_monthly double, configuration string, sector string, locality string, city string, listing_type string, title_hash long, images array<string>"
    for part, repeats in ((data, True), ([(*x[:2], x[0], *x[3:]) for x in data], False)):
        path = f"{tmp_path}/listings{int(repeats)}"
        spark.createDataFrame(part, s).write.parquet(path)
        df = spark.read.parquet(path)
        plain = rows(duplicates.find_duplicates(df), "left", "right")
        assert any(x[3] == "same source id" for x in plain) == repeats
        with monkeypatch.context() as m:
            m.setattr(duplicates, "_shared", lambda s: f"file://{tmp_path}/shared")
            for most in (duplicates.BROADCAST_FIRSTS, 0):
                m.setattr(duplicates, "BROADCAST_FIRSTS", most)
                got = duplicates.find_duplicates(df)
                assert rows(got, "left", "right") == plain
                assert not any(f"/listings{int(repeats)}/" in f for f in got.inputFiles())
