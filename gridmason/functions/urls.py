"""URLs: canonical and absolute forms, identifiers inside them, sitemaps, blocked responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmason.functions.text import empty_to_null

# Parameters that only track.
TRACKING = r"(?i)^(utm_|gclid|fbclid|_ga|mc_)"


def canonical(c: Column) -> Column:
    """No tracking parameters, no fragment, parameters sorted, empty ones dropped, host lower-cased, no slash at the end of the path."""
    scheme, host = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(c, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    args = F.filter(F.split(F.regexp_extract(c, r"\?([^#]*)", 1), "&"), lambda a: a.rlike("^[^=]+=.+") & ~a.rlike(TRACKING))
    query = F.array_join(F.array_sort(args), "&")
    head = F.when(host != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(host))).otherwise(F.lit(""))
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


@F.pandas_udf(T.StringType())
def absolute(base: pd.Series, href: pd.Series) -> pd.Series:
    """href resolved against base, without its fragment; null unless http(s)."""
    from urllib.parse import urljoin, urlsplit, urlunsplit

    def one(b: str | None, h: str | None) -> str | None:
        h = " ".join((h or "").split())
        if not h or h.startswith(("javascript:", "mailto:", "tel:", "#")):
            return None
        p = urlsplit(urljoin(b or "", h))
        return urlunsplit((p.scheme, p.netloc, p.path, p.query, "")) if p.scheme in ("http", "https") else None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


def first_id(c: Column, patterns: list[str]) -> Column:
    """The first pattern's group, else the last part of the path."""
    tail = F.regexp_extract(c, r"([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.coalesce(*[empty_to_null(F.regexp_extract(c, p, 1)) for p in patterns], empty_to_null(tail))


def in_city(c: Column, slug: str, not_after: str | None = None) -> Column:
    """The slug between slashes or hyphens, unless only as part of a longer one (noida in greater-noida)."""
    text = F.lower(c) if not_after is None else F.replace(F.lower(c), F.lit(f"{not_after}-{slug}"), F.lit(""))
    return text.rlike(rf"(^|[/-]){slug}([/\-?#.]|$)")


def sitemap_locations(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?s)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))


# Marks of pages that are not content.
CAPTCHA = (
    r"(?i)g-recaptcha|recaptcha/api\.js|grecaptcha\.|\bhcaptcha\b|hcaptcha\.com|cf-turnstile|challenges\.cloudflare\.com|px-captcha|_pxhd|perimeterx"
    r"|verify (you are|you're) (a )?human|are you a robot|unusual traffic from your computer network"
)
FIREWALL = (
    r"(?i)attention required!\s*\|\s*cloudflare|access denied.*(akamai|reference\s*#)|request unsuccessful\.\s*incapsula|<title>\s*just a moment"
    r"|radware|distil|imperva|blocked by (our )?security"
)
LOGIN = r"(?i)please (log ?in|sign ?in) to (continue|view)|session (has )?expired.*log ?in"


def block_kind(status: Column, body: Column, retry_after: Column, min_chars: int = 800) -> Column:
    """struct<kind, wait_s> of an archived response, decided in order on the first 200 000 characters."""
    head = F.substring(F.coalesce(body, F.lit("")), 1, 200_000)
    wait = retry_after.try_cast("double")
    wait = F.when(wait != 0, wait)
    tiny = (status == 200) & (F.length(head) < min_chars) & F.lower(head).contains("<html")
    kind = (
        F.when(status.isin(429, 503), "rate_limited").when(status == 401, "login_required")
        .when((status == 403) & head.rlike(CAPTCHA), "captcha").when(status == 403, "forbidden")
        .when(F.trim(head) == "", "empty_shell").when(head.rlike(CAPTCHA), "captcha").when(head.rlike(FIREWALL), "waf")
        .when(head.rlike(LOGIN), "login_required").when(tiny, "empty_shell").otherwise("none")
    )
    seconds = F.when(status == 429, F.coalesce(wait, F.lit(60.0))).when(status == 503, F.coalesce(wait, F.lit(30.0))).when((kind == "empty_shell") & tiny & (F.trim(head) != ""), F.lit(15.0))
    return F.struct(kind.alias("kind"), seconds.alias("wait_s"))
