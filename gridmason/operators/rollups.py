"""Market rollups over listings: one grouped aggregation each, exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALE = ("sale", "resale", "new_launch")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def group_key(*cs: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])


def locality_trends(listings: DataFrame) -> DataFrame:
    """By place, types and month, of active originals. max_price is 0, not null, where nothing has a price; min_price is null there."""
    rows = listings.filter("is_active and canonical_id is null").withColumn("period", F.date_trunc("month", F.coalesce("listed_at", "first_seen_at")))
    keys = ["city", "sector", "micro_market", "property_type", "listing_type", "period"]
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("listing_count"), F.median(positive(F.col("price_per_sqft"))).alias("median_price_per_sqft"), F.avg(positive(F.col("price_per_sqft"))).alias("avg_price_per_sqft"),
        F.median(positive(F.col("price"))).alias("median_price"), F.min(positive(F.col("price"))).alias("min_price"), F.max(F.coalesce("price", F.lit(0.0))).alias("max_price"),
        F.avg("rent_monthly").alias("avg_rent"), F.avg("area_sqft").alias("avg_area_sqft"),
    )
    return out.withColumn("key", group_key(*[F.col(k) for k in keys[:5]], F.coalesce(F.date_format("period", "yyyy-MM"), F.lit("none"))))


def rental_yield(listings: DataFrame, min_sample: int = 3, originals_only: bool = False) -> DataFrame:
    """Median rent of a year over median sale price, where both sides have enough; duplicates count unless asked otherwise."""
    rows = listings.filter("is_active and bedrooms is not null")
    rows = rows.filter("canonical_id is null") if originals_only else rows
    sale = F.when(F.col("listing_type").isin(*SALE), positive(F.col("price")))
    rent = F.when(F.col("listing_type") == "rent", positive(F.col("rent_monthly")))
    out = rows.groupBy("city", "sector", "bedrooms").agg(F.median(sale).alias("median_price"), F.median(rent).alias("median_rent"), F.count(sale).alias("sale_sample"), F.count(rent).alias("rent_sample"))
    out = out.filter((F.col("sale_sample") >= min_sample) & (F.col("rent_sample") >= min_sample))
    return out.withColumn("rental_yield_pct", F.bround(F.col("median_rent") * 12 / F.col("median_price") * 100, 3)).withColumn("key", group_key(F.col("city"), F.col("sector"), F.col("bedrooms")))


def builder_scorecard(builders: DataFrame, projects: DataFrame, listings: DataFrame, posts: DataFrame) -> DataFrame:
    """builders(builder_id, name) with counts of projects, active listings and mentions. Each side is aggregated to one row per builder before
    its join. A listing without a price per area counts as 0 in the average."""
    p = projects.groupBy("builder_id").agg(F.count("*").alias("project_count"), F.count_if(F.col("status") == "completed").alias("completed_count"), F.count_if(F.col("status") == "under_construction").alias("ongoing_count"))
    live = listings.filter("is_active").groupBy("builder_id").agg(F.count("*").alias("listing_count"), F.avg(F.coalesce("price_per_sqft", F.lit(0.0))).alias("avg_price_per_sqft"))
    said = posts.select(F.explode(F.array_distinct("detected_builders")).alias("name"), "sentiment", "sentiment_score", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
    m = said.groupBy("name").agg(
        F.count("*").alias("mentions"), F.count_if(F.col("sentiment") == "positive").alias("positive_mentions"), F.count_if(F.col("sentiment") == "negative").alias("negative_mentions"),
        F.avg("sentiment_score").alias("avg_sentiment"), F.count_if(F.arrays_overlap("topics", F.array(F.lit("construction_delay"), F.lit("possession_issue")))).alias("delay_mentions"),
        F.count_if(F.array_contains("topics", "builder_fraud")).alias("fraud_mentions"),
    )
    out = builders.select("builder_id", "name").join(p, "builder_id", "left").join(live, "builder_id", "left").join(m, "name", "left")
    return out.fillna(0, ["project_count", "completed_count", "ongoing_count", "listing_count", "mentions", "positive_mentions", "negative_mentions", "delay_mentions", "fraud_mentions"])


def supply_demand(listings: DataFrame, as_of: Column) -> DataFrame:
    """By city and sector, of originals: what came, went and stays."""
    d30, d90 = as_of - F.expr("INTERVAL 30 DAYS"), as_of - F.expr("INTERVAL 90 DAYS")
    gone = ~F.col("is_active")
    age = (F.unix_micros(F.coalesce("delisted_at", as_of).cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    out = listings.filter("canonical_id is null").groupBy("city", "sector").agg(
        F.count_if(F.col("first_seen_at") > d30).alias("new_last_30d"), F.count_if(F.col("first_seen_at") > d90).alias("new_last_90d"),
        F.count_if(gone & (F.coalesce(F.col("delisted_at"), d90) > d90)).alias("delisted_last_90d"), F.count_if(F.col("is_active")).alias("active_supply"),
        F.count_if(F.col("is_active") & (F.col("possession_status") == "new_launch")).alias("new_launches"), F.avg(F.when(gone, age)).alias("avg_days_on_market"),
    )
    return out.withColumn("key", group_key(F.col("city"), F.col("sector")))


def locality_aggregates(listings: DataFrame) -> DataFrame:
    """By location; a missing price or rent counts as 0."""
    out = listings.filter("is_active and location_id is not null").groupBy("location_id").agg(
        F.avg(F.coalesce("price_per_sqft", F.lit(0.0))).alias("avg_price_per_sqft"), F.avg(F.coalesce("rent_monthly", F.lit(0.0))).alias("avg_rent_per_month"), F.count("*").alias("listing_count")
    )
    both = (F.col("avg_price_per_sqft") > 0) & (F.col("avg_rent_per_month") > 0)
    return out.withColumn("rental_yield_pct", F.when(both, F.bround(F.col("avg_rent_per_month") * 12 / (F.col("avg_price_per_sqft") * 1000) * 100, 3)))


FACETS = {"city": 12, "sector": 40, "micro_market": 20, "property_type": 15, "possession_status": 6, "segment": 6, "builder_name": 30, "configuration": 15}


def facets(listings: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(facet, value, count): the most frequent values of each column in one pass (grouping sets), nulls left out, ties by value."""
    from pyspark.sql.window import Window

    limits = limits or FACETS
    cols = [c for c in limits if c in listings.columns]
    rows = listings.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])).alias("f")).select("f.*")
    counts = rows.filter("value is not null").groupBy("facet", "value").agg(F.count("*").alias("count"))
    top = F.create_map(*[F.lit(x) for c in cols for x in (c, limits[c])])
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value")))
    return ranked.filter(F.col("r") <= top[F.col("facet")]).select("facet", "value", "count")


def term_counts(items: DataFrame, key: str, k: int) -> DataFrame:
    """items(key, term, pos): the k most frequent terms of each key, ties to the earlier first place."""
    from pyspark.sql.window import Window

    counts = items.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first_pos", "term")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def run_status(pages: Column, errors: Column, blocked: Column) -> Column:
    return F.when((blocked > 0) & (pages == 0), "blocked").when((errors > 0) & (pages == 0), "failed").when((errors > 0) | (blocked > 0), "partial").otherwise("success")
