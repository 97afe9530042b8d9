"""Thin queries over whole tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cross_parsing_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gridmason.llm.common import crc_mod
    from gridmason.llm.langid import fit, identify

    docs = _t(spark, sf_dir, "documents")
    remainder = F.coalesce(crc_mod(F.col("doc_id").cast("string"), 4), F.lit(0))
    model = fit(docs.filter(remainder != 2))
    return identify(docs.select("doc_id", (remainder == 2).alias("held_out"), "text"), model, keep_text=False)


def op2_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.packing import pack

    return pack(_t(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op3_hamming_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.neardup import link

    return link(_t(spark, sf_dir, "documents"), num=75, den=100)


def op4_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gridmason.llm.common import crc_mod
    from gridmason.llm.toxicity import fit, score

    docs, labels = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels")
    remainder = F.coalesce(crc_mod(F.col("doc_id").cast("string"), 3), F.lit(0))
    model = fit(docs.filter(remainder != 1), labels.filter(remainder != 1))
    return score(docs.select("doc_id", (remainder == 1).alias("held_out"), "text"), model, keep_text=False)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.tokenfile import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(_t(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.winnow import compare_edits

    return compare_edits(_t(spark, sf_dir, "documents"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.urlfilter import judge

    return judge(_t(spark, sf_dir, "pages"), RULES)


def op8_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.topk import top_k

    return top_k(_t(spark, sf_dir, "embeddings"), k=10, scale=1024.0, query_mod=100)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from gridmason.llm.suffixdedup import dedup

    found = dedup(_t(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Target shares of tokens by domain.
WEIGHTS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def op10_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmason.llm.mixing import label_domains, mix

    return mix(_t(spark, sf_dir, "documents"), label_domains(_t(spark, sf_dir, "labels")), WEIGHTS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_cross_parsing_langid, op2_bin_completion_packing, op3_hamming_neardup, op4_weak_toxicity, op5_token_files, op6_winnowing, op7_redirect_url_filter, op8_pivot_topk, op9_suffix_dedup, op10_soft_mixing)}


_URL_PARTS = """
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {src})
"""
_NODE = """
  CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END ||
    CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) > 0
    THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&')
    ELSE '' END END
"""
_ABSOLUTE = """
  CASE WHEN {x} = '' THEN NULL WHEN instr({x}, '://') > 0 THEN {x} WHEN starts_with({x}, '//') THEN regexp_extract(url, '^([^:/?#]+):', 1) || ':' || {x}
       WHEN starts_with({x}, '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || {x}
       ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '([^/:])/[^/]*$', '\\1') || '/' || {x} END
"""
_OP7 = f"""
WITH RECURSIVE rules(h, p, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)}),
held AS (SELECT row_number() OVER () AS uid, page_id, url, html FROM pages),
own AS ({_URL_PARTS.format(src="held")}),
fits AS (SELECT uid, first(h || p ORDER BY length(h || p) DESC, action) AS rule, first(action ORDER BY length(h || p) DESC, action) AS action
  FROM own JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY uid),
tags AS (SELECT url, regexp_extract(regexp_extract(coalesce(html, ''), '(?is)(<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>)', 1), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS href,
  regexp_extract(regexp_extract(coalesce(html, ''), '(?is)(<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>)', 1), '(?is)\\burl\\s*=\\s*[''"]?([^"''\\s>]+)', 1) AS meta
  FROM held WHERE url IS NOT NULL),
links AS (SELECT url, {_ABSOLUTE.format(x="href")} AS target FROM tags UNION ALL SELECT url, {_ABSOLUTE.format(x="meta")} FROM tags),
urls AS (SELECT DISTINCT url, host, path, {_NODE} AS node FROM ({_URL_PARTS.format(src="(SELECT url FROM held UNION SELECT url FROM links UNION SELECT target FROM links)")}) WHERE url IS NOT NULL),
ties AS (SELECT DISTINCT a.node AS a, b.node AS b FROM links JOIN urls a ON a.url = links.url JOIN urls b ON b.url = links.target WHERE a.node <> b.node),
blocked AS (SELECT node FROM (SELECT node, host, path, first(action ORDER BY length(h || p) DESC, action) AS action FROM urls
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) WHERE node IS NOT NULL GROUP BY ALL) WHERE action = 'block'),
bad(node) AS (SELECT DISTINCT node FROM blocked UNION SELECT CASE WHEN ties.a = bad.node THEN ties.b ELSE ties.a END FROM bad JOIN ties ON bad.node = ties.a OR bad.node = ties.b)
SELECT page_id, own.host, own.path, rule, coalesce(action, CASE WHEN bad.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, action IS NULL AND bad.node IS NOT NULL AS propagated
FROM own LEFT JOIN fits ON own.uid = fits.uid LEFT JOIN (SELECT DISTINCT url, node FROM urls) u ON u.url = own.url LEFT JOIN (SELECT DISTINCT node FROM bad) bad ON bad.node = u.node
"""
_OP8 = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.uid <> c.uid AND q.vec_id % 100 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_redirect_url_filter": _OP7, "op8_pivot_topk": _OP8}
