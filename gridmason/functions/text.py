"""Text cleaning, names, lists: Column -> Column; null in, null out. Only NFKC and NFKD need Python (Spark has no normalize)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about which company or project a name means.
NAME_NOISE = (
    r"\b(pvt\.?|private|ltd\.?|limited|llp|inc\.?|corp\.?|co\.?|builders?|developers?|group|infra(structure)?|realty|realtors?|"
    r"propert(y|ies)|projects?|estates?|homes?|housing|constructions?|buildtech|infratech|lifespaces?|india)\b"
)
SPACE = r"[\s  - 　]+"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean(c: Column, unicode: bool = False) -> Column:
    """White space collapsed and trimmed, empty to null; with ``unicode``, compatibility characters folded first."""
    c = _nfkc(c) if unicode else c
    return empty_to_null(F.trim(F.regexp_replace(c, SPACE, " ")))


def slug(c: Column, unicode: bool = False) -> Column:
    """ASCII letters and digits joined by hyphens; null gives the empty string."""
    c = _ascii(c) if unicode else c
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))


def normal_name(c: Column) -> Column:
    """Key under which spellings of a company or project name meet."""
    c = F.regexp_replace(F.lower(clean(c)), NAME_NOISE, " ")
    return clean(F.regexp_replace(c, "[^a-z0-9 ]+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


#: What a token of a pattern means to RE2 where Java differs, case left aside: word edges and white space are ASCII, a dot stops at a line feed only, and s and k have a third form.
_RE2 = {r"\b": r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))", r"\s": r"[\t\n\f\r ]", ".": r"[^\n]", "s": "[s\u017f]", "k": "[k\u212a]", r"\w": r"[\w\u017f\u212a]"}


def re2(pattern: str) -> str:
    """A pattern in lower case for Java that matches regardless of case what RE2 (DuckDB's SQL) matches with (?i). Bracketed sets stay as they are."""
    return "(?i)" + re.sub(r"\\.|\[[^\]]*\]|[sk.]", lambda m: _RE2.get(m[0], m[0]), pattern)


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor the empty string."""
    return F.coalesce(*[empty_to_null(c) for c in cs])


def contains_ci(c: Column, value: str) -> Column:
    return F.lower(c).contains(value.lower())


def distinct_ci(items: Column) -> Column:
    """Cleaned items, the first of each spelling regardless of case, in order; empty ones dropped."""
    items = F.filter(F.transform(items, lambda x: clean(x)), lambda x: x.isNotNull())
    keys = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def title_label(c: Column) -> Column:
    """under_scored values as words with capitals."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
