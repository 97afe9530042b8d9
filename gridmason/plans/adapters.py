"""Domain views over the driver's tables. The view texts are SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

LISTINGS = """
SELECT 'src:' || l_orderkey || '-' || l_linenumber AS id, 'src' AS source, l_orderkey || '-' || l_linenumber AS source_id, n_name AS city,
  nullif(p_brand, 'Brand#3') AS sector, CAST(NULL AS {text}) AS locality, r_name AS micro_market, lower(p_type) AS property_type,
  CASE WHEN o_orderpriority LIKE '1%' THEN 'rent' WHEN o_orderpriority LIKE '2%' THEN 'new_launch' ELSE 'sale' END AS listing_type,
  l_extendedprice AS price, CASE WHEN o_orderpriority LIKE '1%' THEN l_extendedprice END AS rent_monthly, l_quantity * 50 AS area_sqft,
  l_extendedprice / (l_quantity * 50) AS price_per_sqft, p_size % 5 AS bedrooms, (p_size % 5) || ' BHK' AS configuration,
  CAST(NULL AS TIMESTAMP) AS listed_at, CAST(o_orderdate AS TIMESTAMP) AS first_seen_at, CAST(l_shipdate AS TIMESTAMP) AS last_seen_at, l_linestatus = 'O' AS is_active,
  CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS TIMESTAMP) END AS delisted_at, CASE WHEN l_returnflag = 'R' THEN 'src:' || l_orderkey END AS canonical_id,
  l_suppkey AS builder_id, s_name AS builder_name, p_name AS project_name, p_name || ' in ' || p_brand AS title, 'loc' || n_nationkey AS location_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'under_construction' ELSE 'new_launch' END AS possession_status,
  CASE WHEN l_extendedprice < 20000 THEN 'affordable' WHEN l_extendedprice < 60000 THEN 'mid' ELSE 'premium' END AS segment,
  p_type = 'ECONOMY' AS is_commercial, CASE WHEN l_tax > 0.04 THEN 'R' || l_orderkey END AS rera_number, l_discount * 1000 AS investment_score, l_tax * 1000 AS risk_score,
  27.5 + n_nationkey * 0.04 AS latitude, 76.2 + p_size * 0.04 AS longitude
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
PRICE_LOG = "SELECT CAST(user_id AS BIGINT) AS property_id, CAST(ts AS TIMESTAMP) AS observed_at, event_id, value AS price, value AS price_per_sqft, 'city' || (user_id % 7) AS city, event_type AS sector, 'sale' AS listing_type FROM events"
BUILDERS = "SELECT s_suppkey AS builder_id, s_name AS name, 1950 + s_suppkey % 70 AS established_year FROM supplier"
PROJECTS = "SELECT p_partkey AS project_id, p_partkey % (SELECT count(*) FROM supplier) AS builder_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'completed' WHEN p_size % 3 = 1 THEN 'under_construction' ELSE 'new_launch' END AS status FROM part"


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions join by broadcast while Spark's statistics say they are small; the rest is shuffled by order."""
    tables(spark, sf_dir, "lineitem", "orders", "part", "supplier", "nation", "region")
    return spark.sql(LISTINGS.format(text="STRING"))


def price_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(PRICE_LOG)


def builders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "supplier")
    return spark.sql(BUILDERS)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "part", "supplier")
    return spark.sql(PROJECTS)
