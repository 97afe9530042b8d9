"""URL filters with redirect equivalence.

Rules decide by host and path. URLs that redirects or canonical links tie together are one class (distributed connected components); a block
of any member reaches every alias that no rule of its own decides. An explicit allow of a page's own url precedes such a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmason.llm.common import components, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(__u, locate('://', __u) + 3)"))


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (lower-cased A-Z) and path; both empty for a null url or one without ``://``."""
    df = df.withColumn("__u", F.col(url)).withColumn("__r", F.coalesce(_rest(F.col("__u")), F.lit("")))
    return df.withColumns({
        "host": F.translate(F.regexp_extract("__r", "^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract("__r", "^[^/?#]*([^?#]*)", 1),
    }).drop("__u", "__r")


def node_of(url: Column, host: Column, path: Column) -> Column:
    """The name under which a url is known: no scheme, no fragment, no tracking parameters, host lower-cased; null if it has no host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    args = F.filter(F.split(query, "&"), lambda a: (a != "") & ~a.rlike("^(utm_[^=]*|ref|gclid|fbclid)(=|$)"))
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(args), "&"))).otherwise(F.lit(""))))


def links_of(html: Column, url: Column) -> Column:
    """Targets of a page's canonical link and of its meta refresh, as absolute urls (an array)."""
    tag = F.regexp_extract(html, r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)", 1)
    href = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(html, r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)", 1)
    to = F.regexp_extract(meta, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1)
    scheme, site = F.regexp_extract(url, "^([^:/?#]+):", 1), F.regexp_extract(url, "^([^:/?#]+://[^/?#]*)", 1)
    base = F.regexp_replace(F.regexp_extract(url, "^([^?#]*)", 1), "([^/:])/[^/]*$", "$1")

    def absolute(x: Column) -> Column:
        return F.when(x == "", None).when(F.instr(x, "://") > 0, x).when(x.startswith("//"), F.concat(scheme, F.lit(":"), x)).when(x.startswith("/"), F.concat(site, x)).otherwise(F.concat(base, F.lit("/"), x))

    return F.array_compact(F.array(absolute(href), absolute(to)))


def apply_rules(df: DataFrame, rules: DataFrame, key: str, n_rules: int) -> DataFrame:
    """(key, rule, action) of the rows that a rule fits: the longest rule, at equal length allow before block. Hosts are matched by joining
    each of a host's suffixes, paths by their start."""
    labels = F.split("host", r"\.")
    suffixes = df.select(key, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("__h"))
    r = rules.select(F.translate("host", UPPER, LOWER).alias("__h"), F.col("path").alias("__p"), "action").withColumn("rule", F.concat("__h", "__p"))
    found = suffixes.join(F.broadcast(r) if n_rules <= BROADCAST_RULES else r, "__h").filter("startswith(path, __p)")
    rank = F.struct(F.length("rule"), (F.col("action") == "allow").cast("int"), F.col("rule"), F.col("action"))
    return found.groupBy(key).agg(F.max(rank).alias("m")).select(key, F.col("m.rule").alias("rule"), F.col("m.action").alias("action"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` -> page_id, host, path, rule, verdict, propagated.

    rules: (host, path, "allow" or "block"). redirects: further ``(source, target)`` urls. A page that no rule fits is blocked if a rule blocks any url of
    its class (targets that are not pages included), else allowed. Null or malformed urls have empty host and path, no
    rule and no class. Null html has no links. Repeated rows and ids are rows of their own. No rows give no rows.
    """
    spark = pages.sparkSession
    rule_rows = spark.createDataFrame([(h, p, a) for h, p, a in rules], "host string, path string, action string")
    held = host_and_path(pages.select("page_id", "url", links_of(F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))).alias("links")))
    held = stash(held.withColumn("node", node_of(F.col("url"), F.col("host"), F.col("path"))).withColumn("uid", F.monotonically_increasing_id()), "pages")
    decided = apply_rules(held.select("uid", "host", "path"), rule_rows, "uid", len(rules))
    edges = held.select("url", F.explode("links").alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source").alias("url"), "target"))
    edges = stash(edges.filter("url is not null and target is not null"), "links")
    urls = host_and_path(held.select("url").unionAll(edges.select("url")).unionAll(edges.select(F.col("target").alias("url"))).filter("url is not null").distinct())
    urls = urls.withColumn("node", node_of(F.col("url"), F.col("host"), F.col("path"))).filter("node is not null")
    ties = edges.join(urls.select("url", F.col("node").alias("a")), "url").select("target", "a").join(urls.select(F.col("url").alias("target"), F.col("node").alias("b")), "target").select("a", "b")
    classes = components(ties, "redirects")
    blocked = apply_rules(urls.select("node", "host", "path").distinct(), rule_rows, "node", len(rules)).filter("action = 'block'").select("node").distinct()
    bad_class = blocked.join(classes, "node").select("component").distinct()
    bad_nodes = classes.join(bad_class, "component").select("node").unionAll(blocked).distinct().withColumn("bad", F.lit(True))
    out = held.join(decided, "uid", "left").join(bad_nodes, "node", "left")
    propagated = F.col("action").isNull() & F.coalesce("bad", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), propagated.alias("propagated"))
