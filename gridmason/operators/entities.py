"""Rule-tier text analytics: companies, projects, sectors, topics, keywords, sentiment, relevance."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmason.functions import vocab
from gridmason.functions.places import SECTOR, sector_form
from gridmason.functions.text import clean, normal_name


def _builder_pattern(aliases: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(rf"\b{re.escape(a)}\b" for a in aliases)


def project_pattern(name: str) -> str:
    """Hyphens and runs of spaces between the words are alike."""
    return r"(?i)\b" + r"[-\s]+".join(re.escape(p) for p in name.split()) + r"\b"


def _found(text: Column, patterns: dict[str, str]) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))))


def builders(text: Column) -> Column:
    return _found(text, {n: _builder_pattern(a) for n, a in vocab.BUILDERS.items()})


def projects(text: Column, names: list[str]) -> Column:
    """Project names, given as a parameter."""
    return _found(text, {n: project_pattern(n) for n in names})


def sectors(text: Column, limit: int = 10) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTOR), F.lit(1)), sector_form)), 1, limit)


def topic_hits(text: Column, form: Callable[[str], str] = "(?i){}".format) -> Column:
    """array<struct<n, i, name>> of the topics that a text hits, n the negated number of hits: sorted by rank. form: makes a pattern of a topic's."""
    text = F.coalesce(text, F.lit(""))
    rows = F.array(*[F.struct((-F.regexp_count(text, F.lit(form(p)))).alias("n"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(vocab.TOPICS.items())])
    return F.array_sort(F.filter(rows, lambda r: r["n"] < 0))


def topics(text: Column, limit: int = 12) -> Column:
    """Topics by falling number of hits; equally frequent ones in their own order."""
    return F.transform(F.slice(topic_hits(text), 1, limit), lambda r: r["name"])


def keyword_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, pos): content words, a boosted one with five more places (at its first)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-zA-Z][a-zA-Z0-9'-]{2,}"), F.lit(0))
    rows = docs.select(key, F.posexplode(words).alias("pos", "term")).filter((F.length("term") > 3) & ~F.col("term").isin(*vocab.STOPWORDS))
    boosted = rows.filter(F.col("term").isin(*vocab.BOOSTED)).groupBy(key, "term").agg(F.min("pos").alias("pos"))
    return rows.unionByName(boosted.select(key, "pos", "term", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("_")).drop("_"))


@F.pandas_udf(T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]))
def sentiment(text: pd.Series) -> pd.DataFrame:
    """Counts of terms; a positive one with a negator in the 30 characters before it is negative. mixed if near balance, else by 0.15."""
    negator = re.compile(vocab.NEGATORS, re.I)

    def one(t: str | None) -> tuple[str, float]:
        t = (t or "").lower()
        good = bad = 0
        for term in vocab.POSITIVE:
            at = t.find(term)
            while at >= 0:
                if negator.search(t[max(0, at - 30) : at]):
                    bad += 1
                else:
                    good += 1
                at = t.find(term, at + len(term))
        bad += sum(t.count(term) for term in vocab.NEGATIVE)
        if not good + bad:
            return "neutral", 0.0
        score = round((good - bad) / (good + bad), 3)
        if good and bad and abs(score) < 0.2:
            return "mixed", score
        return "positive" if score > 0.15 else "negative" if score < -0.15 else "neutral", score

    return pd.DataFrame([one(t) for t in text], columns=["label", "score"])


def canonical_builder(name: Column) -> Column:
    out = clean(name)
    for n, a in reversed(vocab.BUILDERS.items()):
        out = F.when(name.rlike(_builder_pattern(a)), F.lit(n)).otherwise(out)
    return out


def builder_key(name: Column) -> Column:
    return normal_name(canonical_builder(name))


def only_builder(text: Column) -> Column:
    """The company a text names, if it names exactly one."""
    found = builders(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def relevance(title: Column, body: Column, pattern: str) -> Column:
    """0 to 100: hits in the title count twice, the body's first 5000 characters once, 12 points each."""
    hits = 2 * F.regexp_count(F.coalesce(title, F.lit("")), F.lit(pattern)) + F.regexp_count(F.substring(F.coalesce(body, F.lit("")), 1, 5000), F.lit(pattern))
    return F.least(F.lit(100), 12 * hits)


def merge_results(rows: DataFrame, results: DataFrame, key: str, fill: list[str], bounded: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Model results fill what is missing and never overwrite; bounded ones are kept within their limits."""
    r = results.select(key, *[F.col(c).alias(f"_{c}") for c in fill])
    bounded = bounded or {}

    def kept(c: str) -> Column:
        x = F.col(f"_{c}")
        return F.greatest(F.lit(bounded[c][0]), F.least(F.lit(bounded[c][1]), x)) if c in bounded else x

    return rows.join(r, key, "left").withColumns({c: F.coalesce(c, kept(c)) for c in fill}).drop(*[f"_{c}" for c in fill])
