"""What the service's endpoints and jobs compute, as functions that return DataFrames. Paged ones carry the total on each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmason.operators import duplicates, history, rollups, scoring, search


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value).limit(1)


def _page(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    size = max(1, min(size, search.MAX_PAGE))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def properties(listings: DataFrame, query: search.Query, as_of: Column) -> DataFrame:
    return search.search(listings, query, as_of)


def property_facets(listings: DataFrame, query: search.Query) -> DataFrame:
    """Facets of what the query's words, city and listing type leave."""
    narrow = search.Query(q=query.q, city=query.city, listing_type=query.listing_type)
    rows = listings.filter(search.condition(narrow, listings.columns))
    return rollups.facets(rows.filter(search.text_score(query.q, rows) > 0) if query.q else rows)


def property_detail(listings: DataFrame, prices: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One listing with its last 50 prices and 20 duplicates, each aggregated before it is joined."""
    one = by_id(listings, "id", key)
    last = history.series(prices.filter(F.col("property_id") == key), 50).groupBy("property_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "observed_at", "price"))), lambda r: F.struct(r["observed_at"].alias("observed_at"), r["price"].alias("price"))).alias("prices"))
    same = edges.filter(F.col("canonical") == key).join(listings.select(F.col("id").alias("duplicate"), "source", "price"), "duplicate")
    same = same.orderBy(F.desc("score"), "duplicate").limit(20).groupBy("canonical").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "duplicate", "source", "price"))).alias("duplicates"))
    return one.join(F.broadcast(last), one["id"] == last["property_id"], "left").join(F.broadcast(same), one["id"] == same["canonical"], "left").drop("property_id", "canonical")  # one row each


def builders(table: DataFrame, scorecard: DataFrame, name: str | None = None, min_trust: float | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """Builders with their card, most trusted first."""
    rows = table.filter(F.lower("name").contains(name.lower())) if name else table
    rows = rows.filter(F.col("trust_score") >= min_trust) if min_trust is not None else rows
    card = scorecard.select("builder_id", "mentions", "positive_mentions", "negative_mentions", "listing_count", "avg_price_per_sqft")
    return _page(rows.join(card, "builder_id", "left"), [F.desc("trust_score"), F.desc("total_projects"), F.col("builder_id")], page, size)


def builder_detail(table: DataFrame, projects: DataFrame, posts: DataFrame, key) -> DataFrame:
    """One builder with up to 100 projects and 40 posts that name it."""
    one = by_id(table, "builder_id", key)
    p = projects.filter(F.col("builder_id") == key).orderBy(F.desc("possession_date"), "project_id").limit(100).groupBy("builder_id").agg(F.collect_list(F.struct("project_id", "name", "status")).alias("projects"))
    said = posts.select(F.explode(F.array_distinct("detected_builders")).alias("name"), "source_id", "title", "score").join(F.broadcast(one.select("name")), "name")  # one row
    said = said.orderBy(F.desc("score"), "source_id").limit(40).groupBy("name").agg(F.collect_list(F.struct("source_id", "title", "score")).alias("posts"))
    return one.join(F.broadcast(p), "builder_id", "left").join(F.broadcast(said), "name", "left")


def projects(table: DataFrame, town: str | None = None, name: str | None = None, status: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    rows = table
    for c, v in (("city", town), ("status", status)):
        rows = rows.filter(F.col(c) == v) if v else rows
    rows = rows.filter(F.lower("name").contains(name.lower())) if name else rows
    return _page(rows, [F.desc("launch_date"), F.desc("created_at"), F.col("project_id")], page, size)


def top_comments(comments: DataFrame, post: str, limit: int = 200) -> DataFrame:
    return comments.filter(F.col("post_id") == post).orderBy(F.desc("score"), "id").limit(limit)


def market_trends(trends: DataFrame, as_of: Column, town: str | None = None, sector: str | None = None, listing_type: str = "sale", months: int = 12) -> DataFrame:
    rows = trends.filter((F.col("listing_type") == listing_type) & (F.col("period") >= as_of - F.make_dt_interval(F.lit(31 * months))))
    rows = rows.filter(F.col("city") == town) if town else rows
    rows = rows.filter(F.lower("sector").contains(sector.lower())) if sector else rows
    return rows.orderBy("period", F.desc("listing_count"), "key").limit(500)


def market_yield(yields: DataFrame, town: str | None = None, bedrooms: int | None = None) -> DataFrame:
    rows = yields.filter(F.col("city") == town) if town else yields
    rows = rows.filter(F.col("bedrooms") == bedrooms) if bedrooms is not None else rows
    return rows.orderBy(F.desc("rental_yield_pct"), "key").limit(300)


def market_supply(supply: DataFrame, town: str | None = None) -> DataFrame:
    rows = supply.filter(F.col("city") == town) if town else supply
    return rows.orderBy(F.desc("active_supply"), "key").limit(300)


def market_insights(insights: DataFrame, as_of: Column, metric: str | None = None, months: int = 12, limit: int = 100) -> DataFrame:
    rows = insights.filter(F.col("period_end") >= F.date_sub(as_of.cast("date"), 31 * months))
    rows = rows.filter(F.col("metric") == metric) if metric else rows
    return rows.orderBy(F.desc("period_end"), "source_id").limit(min(limit, 500))


def new_launches(table: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Announced projects, and any that came in lately."""
    fresh = F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))
    return table.filter(F.col("status").isin("new_launch", "upcoming") | F.coalesce(fresh, F.lit(False))).orderBy(F.desc("launch_date"), F.desc("created_at"), "project_id").limit(200)


def stats(**tables: DataFrame) -> DataFrame:
    """(collection, rows, active): counts of every table; active only where rows can be inactive."""
    from functools import reduce

    def one(name: str, t: DataFrame) -> DataFrame:
        active = F.count_if("is_active") if "is_active" in t.columns else F.lit(None).cast("long")
        return t.agg(F.count("*").alias("rows"), active.alias("active")).select(F.lit(name).alias("collection"), "rows", "active")

    return reduce(DataFrame.unionByName, [one(n, t) for n, t in tables.items()])


def recent_runs(runs: DataFrame, as_of: Column, keep_days: int = 90, limit: int = 15) -> DataFrame:
    """The newest runs of the log, which expires."""
    return runs.filter(F.col("started_at") > as_of - F.make_dt_interval(F.lit(keep_days))).orderBy(F.desc("started_at"), "run_id").limit(limit)


def score_properties(listings: DataFrame, builder_scores: DataFrame, trends: DataFrame, yields: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Active listings with location, risk and investment scores. The benchmark is the latest trend of the place (null and empty sectors are alike), trust is the builder's."""
    rows = listings.filter("is_active")
    rows = rows if limit is None else rows.orderBy(F.desc("last_seen_at"), "id").limit(limit)
    rows = rows.withColumn("_s", F.coalesce("sector", F.lit("")))
    place = ["city", "_s", "listing_type"]
    latest = history.latest(trends.withColumn("_s", F.coalesce("sector", F.lit(""))), place, F.desc("period"), F.desc("listing_count"), F.col("micro_market"), F.col("property_type"))
    latest = latest.select(*place, F.col("median_price_per_sqft").alias("_median"), F.col("listing_count").alias("_count"))
    y = yields.withColumn("_s", F.coalesce("sector", F.lit(""))).select("city", "_s", "bedrooms", F.col("rental_yield_pct").alias("_yield"))
    rows = rows.join(builder_scores.select("builder_id", F.col("trust_score").alias("_trust")), "builder_id", "left").join(latest, place, "left").join(y, ["city", "_s", "bedrooms"], "left")
    col = lambda n, t: F.col(n) if n in listings.columns else F.lit(None).cast(t)
    none = F.lit(None).cast("double")
    where = scoring.location(col("micro_market", "string"), col("landmarks", "array<struct<category:string,distance_km:double>>"), col("latitude", "double").isNotNull(), F.col("_count"))["value"]
    rows = rows.withColumn("location_score", where)
    age = F.datediff(as_of.cast("date"), F.col("first_seen_at").cast("date"))
    rows = rows.withColumn("risk_score", scoring.risk(F.col("possession_status"), col("possession_date", "date"), col("rera_number", "string"), F.col("_trust"), F.col("price_per_sqft"), F.col("_median"), F.lit(0), F.lit(0), age, as_of)["value"])
    invest = scoring.investment(F.col("location_score"), F.col("risk_score"), F.col("_yield"), F.col("price_per_sqft"), F.col("_median"), none, F.col("possession_status"), col("segment", "string"), F.col("_trust"))["value"]
    return rows.withColumns({"investment_score": invest, "builder_trust_score": F.col("_trust"), "enriched_at": as_of}).drop("_s", "_trust", "_median", "_count", "_yield")


def score_builders(table: DataFrame, scorecard: DataFrame, as_of: Column) -> DataFrame:
    """Builders with trust_score, risk_score (100 less it) and a summary of the first four notes; the card's counts come before the builder's own."""
    rows = table.join(scorecard.drop("name"), "builder_id", "left")
    own = lambda n, t: F.col(n) if n in table.columns else F.lit(None).cast(t)
    first = lambda card, mine: F.coalesce(F.nullif(F.col(card), F.lit(0)), own(mine, "int"))
    s = scoring.builder_trust(first("completed_count", "completed_projects"), first("ongoing_count", "ongoing_projects"), first("project_count", "total_projects"), own("established_year", "int"), own("rating", "double"), own("rating_count", "int"),
                              F.col("positive_mentions"), F.col("negative_mentions"), F.col("delay_mentions"), F.col("fraud_mentions"), F.lit(None).cast("double"), as_of)
    rows = rows.withColumn("_s", s)
    return rows.withColumns({"trust_score": F.col("_s.value"), "risk_score": F.round(100 - F.col("_s.value"), 2), "reputation_summary": F.nullif(F.array_join(F.slice("_s.notes", 1, 4), "; "), F.lit("")), "enriched_at": as_of}).drop("_s")


def resolve_project(names: DataFrame, table: DataFrame) -> DataFrame:
    """names(name_key, city) -> project_id: the same normalized name in the same city, or in none; the same city first."""
    rows = names.withColumnRenamed("city", "_city").join(table.select("name_key", "project_id", "city"), "name_key", "left").filter(F.col("city").isNull() | (F.col("city") == F.col("_city")))
    return history.latest(rows, ["name_key", "_city"], F.col("city").isNull().cast("int"), F.col("project_id")).select("name_key", F.col("_city").alias("city"), "project_id")


def exact_duplicates(listings: DataFrame) -> DataFrame:
    """Edges (canonical, duplicate, score 1) of listings with the same dedupe key."""
    rows = duplicates.key_clusters(listings)
    return rows.filter(F.col("id") != F.col("canonical")).select("canonical", F.col("id").alias("duplicate"), F.lit(1.0).alias("score"))
