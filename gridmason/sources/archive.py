"""Raw archive of pages as a partitioned table: content addresses, replay, pruning, usage; JSON feeds, record ingest, sitemaps, discussion threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmason.functions.urls import sitemap_locations


def archive_key(source: Column, url: Column, body: Column, at: Column, extension: str = "html") -> Column:
    """source/yyyy/mm/dd/aa/sha1.ext, by url and body."""
    digest = F.sha1(F.concat(url, body))
    return F.concat_ws("/", source, F.date_format(at, "yyyy/MM/dd"), F.substring(digest, 1, 2), F.concat(digest, F.lit(f".{extension}")))


def put(pages: DataFrame, path: str) -> None:
    """Appends pages(source, url, body, fetched_at, ...), partitioned by source and day."""
    rows = pages.withColumns({"key": archive_key(F.col("source"), F.col("url"), F.col("body"), F.col("fetched_at")), "day": F.to_date("fetched_at")})
    rows.write.mode("append").partitionBy("source", "day").option("compression", "gzip").parquet(path)


def replay(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if source is None else rows.filter(F.col("source") == source)


def kept(archive: DataFrame, as_of: Column, days: int) -> DataFrame:
    """What pruning leaves: days from as_of - days on; days <= 0 keeps all. The predicate is on the partition column."""
    return archive if days <= 0 else archive.filter(F.col("day") >= F.date_sub(as_of, days))


def usage(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of a folder, from metadata only."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_feed(spark: SparkSession, path: str, page: int = 1, limit: int = 500) -> DataFrame:
    """A JSON feed file with its results cut to a page; total stays the file's."""
    feed = spark.read.json(path, multiLine=True)
    return feed.withColumn("results", F.slice("results", F.lit(max(page - 1, 0) * limit + 1), F.lit(limit)))


def parse_records(raw: DataFrame, schema: str, column: str = "json", most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of JSON texts of one request (``request``, ``index``): malformed ones, and those past ``most``, are rejected with a reason."""
    rows = raw.withColumn("r", F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    reason = F.when(F.col("index") >= most, "too many records").when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), "malformed record")
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").select("request", "index", "r.*").drop("_corrupt"), rows.filter("reason is not null").select("request", "index", "reason")


def sitemap(xml: DataFrame, keep: Column | None = None, column: str = "xml") -> DataFrame:
    rows = xml.select(F.explode(sitemap_locations(F.col(column))).alias("url")).distinct()
    return rows if keep is None else rows.filter(keep)


def backlog(urls: DataFrame, *known: DataFrame) -> DataFrame:
    """urls(source_id, ...) that none of the known tables (source_id) has."""
    ids = known[0].select("source_id")
    for k in known[1:]:
        ids = ids.union(k.select("source_id"))
    return urls.join(ids.distinct(), "source_id", "left_anti")


COMMENT = "struct<kind:string,data:struct<id:string,body:string,score:int,author:string,created_utc:double,replies:string>>"


def comments(threads: DataFrame, column: str = "json", depth: int = 4, limit: int = 50, body_chars: int = 10_000) -> DataFrame:
    """threads(post_id, json: the listing that holds the comments) -> comments with their depth, deleted and empty ones and scores under 1 dropped, best first, at most ``limit`` a post.
    One explode per level of the tree."""
    from functools import reduce

    from pyspark.sql.window import Window

    listing = f"struct<data:struct<children:array<{COMMENT}>>>"
    at = threads.select("post_id", F.explode(F.from_json(F.get_json_object(column, "$[1]"), listing)["data"]["children"]).alias("c")).filter("c.kind = 't1'")
    levels = []
    for d in range(depth + 1):
        levels.append(at.select("post_id", F.lit(d).alias("depth"), "c.data.id", F.substring("c.data.body", 1, body_chars).alias("body"), "c.data.score", "c.data.author"))
        at = at.select("post_id", F.explode(F.from_json("c.data.replies", listing)["data"]["children"]).alias("c")).filter("c.kind = 't1'")
    rows = reduce(DataFrame.unionByName, levels).filter(~F.col("body").isin("[deleted]", "[removed]", "") & (F.col("score") >= 1))
    rows = rows.withColumn("author", F.when(~F.col("author").isin("[deleted]", "AutoModerator"), F.col("author")))
    w = Window.partitionBy("post_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
