"""Discussion posts: parsing, rule-tier enrichment, full text, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmason.functions.places import city
from gridmason.functions.text import tokens
from gridmason.operators import entities

# What makes a post one about property.
RELEVANT = (
    r"(?i)\bproperty\b|\bflat\b|\bapartment\b|\bbuilder\b|\bbuilders\b|\brera\b|\bpossession\b|\bsociety\b|\bbroker\b|\brent(al)?\b|\blandlord\b|\btenant\b|\bsector\s*\d+"
    r"|\bbhk\b|\bcarpet area\b|\bhome ?loan\b|\bstamp duty\b|\bregistry\b|\bregistration\b|\bmaintenance\b|\bdlf\b|\bm3m\b|\bgodrej\b|\bsobha\b|\bsignaturre?\b|\bemaar\b"
    r"|\bexpressway\b|\bproject\b|\binvest(ment|ing)?\b|\bresale\b|\bplot\b|\bvilla\b|\bfloor\b|\breal ?estate\b|\bhousing\b|\bsq\.? ?ft\b"
)
POST = "struct<id:string,subreddit:string,title:string,selftext:string,author:string,created_utc:double,score:int,num_comments:int,upvote_ratio:double,url:string,permalink:string>"


def parse_listing(raw: DataFrame, column: str = "json") -> DataFrame:
    """Posts of listing pages, each id once (its highest score)."""
    kids = F.from_json(column, f"struct<data:struct<children:array<struct<data:{POST}>>>>")["data"]["children"]
    rows = raw.select(F.explode(kids).alias("c")).select("c.data.*").filter("id is not null")
    rows = rows.select(
        F.col("id").alias("source_id"), "subreddit", "title", F.col("selftext").alias("body"), F.when(~F.col("author").isin("[deleted]", "AutoModerator", ""), F.col("author")).alias("author"),
        F.timestamp_micros((F.when(F.col("created_utc") != 0, F.col("created_utc")) * 1_000_000).cast("long")).alias("created_utc"), "score", "num_comments", F.bround("upvote_ratio", 3).alias("upvote_ratio"), "permalink",
    )
    best = F.struct(F.coalesce("score", F.lit(0)), F.col("num_comments"), F.col("title"))
    return rows.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source_id"]), best).alias("p")).select("source_id", "p.*")


def relevance(title: Column, body: Column) -> Column:
    return entities.relevance(title, body, RELEVANT)


def full_text(title: Column, body: Column, comments: Column, most: int = 12_000) -> Column:
    """Title, body and up to 25 comment bodies (array<string>), cut to a length."""
    said = F.slice(F.filter(F.coalesce(comments, F.array().cast("array<string>")), lambda c: c != ""), 1, 25)
    return F.substring(F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(body, F.lit("")), F.array_join(said, "\n")), 1, most)


def enrich(posts: DataFrame, project_names: list[str]) -> DataFrame:
    """posts(title, body, subreddit, comments array<string>) with what they name; the city falls back to the subreddit's."""
    text = F.concat_ws("\n", "title", "body", F.array_join(F.slice(F.coalesce("comments", F.array().cast("array<string>")), 1, 20), "\n"))
    rows = posts.withColumn("_text", text)
    t = F.col("_text")
    own = city(t)
    rows = rows.withColumns({
        "detected_builders": entities.builders(t), "detected_projects": entities.projects(t, project_names), "detected_sectors": entities.sectors(t), "topics": entities.topics(t),
        "detected_city": F.when(own != "unknown", own).otherwise(city(F.col("subreddit"))), "relevance_score": relevance(F.col("title"), F.col("body")), "_s": entities.sentiment(t),
    })
    return rows.withColumns({"sentiment": F.col("_s.label"), "sentiment_score": F.col("_s.score")}).drop("_text", "_s")


def search(posts: DataFrame, q: str | None = None, *, builder: str | None = None, project: str | None = None, sector: str | None = None, town: str | None = None, topics: list[str] | None = None,
           sentiment: str | None = None, min_score: int | None = None, subreddit: str | None = None, page: int = 1, size: int = 25) -> DataFrame:
    """A page of posts with text_score and total: words in the title weigh 5, in names 4, in the body 1; without words the newest first. Bodies are cut to 2000 characters."""
    all_of = [F.array_contains(c, v) for c, v in (("detected_builders", builder), ("detected_projects", project), ("detected_sectors", sector)) if v]
    all_of += [F.col(c) == v for c, v in (("detected_city", town), ("sentiment", sentiment), ("subreddit", subreddit)) if v]
    if topics:
        all_of.append(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    if min_score is not None:
        all_of.append(F.col("score") >= min_score)
    rows = posts.filter(reduce(lambda a, b: a & b, all_of)) if all_of else posts
    score = F.lit(0)
    if q:
        names = F.array_join(F.concat("detected_builders", "detected_projects"), " ")
        for text, weight in ((F.col("title"), 5), (names, 4), (F.col("body"), 1)):
            have = tokens(text)
            for w in sorted(set("".join(c if c.isalnum() else " " for c in q.lower()).split())):
                score = score + F.when(F.array_contains(have, w), weight).otherwise(0)
    rows = rows.withColumns({"text_score": score, "body": F.substring(F.coalesce("body", F.lit("")), 1, 2000)})
    rows = rows.filter("text_score > 0") if q else rows
    size = max(1, min(size, 100))
    total = rows.agg(F.count("*").alias("total"))
    order = [F.desc("text_score")] if q else [F.desc("created_utc")]
    return rows.orderBy(*order, "source_id").offset((max(1, page) - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row
