"""Price history: change log, series, movement between windows, insights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def price_changes(snapshots: DataFrame, key: str = "property_id", at: str = "observed_at", price: str = "price") -> DataFrame:
    """The rows at which a key's price is new or differs from the one before, with the change; rows without a price don't count."""
    w = Window.partitionBy(key).orderBy(at, price)
    rows = snapshots.filter(F.col(price).isNotNull()).withColumn("previous_price", F.lag(price).over(w))
    rows = rows.filter(F.col("previous_price").isNull() | (F.col(price) != F.col("previous_price")))
    change = F.col(price) - F.col("previous_price")
    return rows.withColumn("change_amount", change).withColumn("change_pct", F.when(F.col("previous_price") > 0, F.bround(change / F.col("previous_price") * 100, 3)))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order given."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def series(history: DataFrame, limit: int = 100, key: str = "property_id", at: str = "observed_at", *tie: str) -> DataFrame:
    """The newest rows of each key, newest first."""
    w = Window.partitionBy(key).orderBy(F.desc(at), *tie)
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def price_movement(history: DataFrame, as_of: Column, days: int = 90, min_sample: int = 5, limit: int | None = 500) -> DataFrame:
    """Median price per area of the last ``days`` against the ``days`` before, one conditional aggregation; both sides need min_sample rows."""
    recent, older = as_of - F.make_dt_interval(F.lit(days)), as_of - F.make_dt_interval(F.lit(2 * days))
    x, now = F.col("price_per_sqft"), F.col("observed_at") >= recent
    out = history.filter((F.col("observed_at") >= older) & (x > 0)).groupBy("city", "sector", "listing_type").agg(
        F.median(F.when(now, x)).alias("current_ppsf"), F.median(F.when(~now, x)).alias("previous_ppsf"), F.count_if(now).alias("current_sample"), F.count_if(~now).alias("previous_sample")
    )
    out = out.filter((F.col("current_sample") >= min_sample) & (F.col("previous_sample") >= min_sample))
    out = out.withColumn("change_pct", F.bround((F.col("current_ppsf") - F.col("previous_ppsf")) / F.col("previous_ppsf") * 100, 2))
    return out if limit is None else out.orderBy(F.desc("change_pct"), "city", "sector", "listing_type").limit(limit)


def market_insights(movement: DataFrame, supply: DataFrame, yields: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """The three rollups as one long table with a deterministic key."""
    day = F.date_format(as_of, "yyyy-MM-dd")
    place = [F.col("city"), F.coalesce("sector", F.lit("all"))]
    start = F.date_sub(as_of.cast("date"), days)

    def rows(df: DataFrame, name: str, key: list[Column], metric: str, value: Column, unit: str, change: Column, sample: Column) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(name), *key, day).alias("source_id"), F.lit(metric).alias("metric"), "city", "sector", start.alias("period_start"), as_of.cast("date").alias("period_end"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), change.cast("double").alias("change_pct"), sample.cast("long").alias("sample_size"))

    none = F.lit(None)
    return reduce(DataFrame.unionByName, [
        rows(movement, "ppsf", [*place, F.col("listing_type")], "avg_price_per_sqft", F.col("current_ppsf"), "INR/sqft", F.col("change_pct"), F.col("current_sample")),
        rows(supply, "supply", place, "listing_supply", F.col("active_supply"), "listings", none, F.col("active_supply")),
        rows(yields, "yield", [*place, F.col("bedrooms").cast("string")], "rental_yield", F.col("rental_yield_pct"), "percent", none, F.least("sale_sample", "rent_sample")),
    ])


def known_runs(visits: DataFrame, key: str, at: str, known: str) -> DataFrame:
    """Adds run_length: how many known pages in a row end at this visit (0 at an unknown one)."""
    w = Window.partitionBy(key).orderBy(at)
    rows = visits.withColumn("_g", F.sum(F.when(F.col(known), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("run_length", F.sum(F.col(known).cast("int")).over(Window.partitionBy(key, "_g").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))).drop("_g")


def rate_window(events: DataFrame, key: str, seconds: str, span: int = 60) -> DataFrame:
    """Adds hits: events of the key within the last ``span`` seconds, this one included."""
    return events.withColumn("hits", F.count("*").over(Window.partitionBy(key).orderBy(seconds).rangeBetween(-span, 0)))
