"""Pages to records: a standard-library HTML tree with the few lookups that listing pages need, run over Arrow batches."""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                todo += list(reversed(n.children))
        return " ".join(" ".join(out).split())

    def raw(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def select(self, selector: str) -> list[Node]:
        """Comma-separated alternatives of tag, .class, #id and [attr], [attr=value], [attr*=part]; descendants by spaces."""
        out: list[Node] = []
        for alternative in selector.split(","):
            found = [self]
            for step in alternative.split():
                test = _matcher(step)
                found = list(dict.fromkeys(n for top in found for n in top.walk() if n is not top and test(n)))
            out += [n for n in found if n not in out]
        return out

    def first(self, *selectors: str) -> Node | None:
        return next((n for s in selectors for n in self.select(s)[:1]), None)


def _matcher(step: str) -> Callable[[Node], bool]:
    tag = re.match(r"[a-zA-Z0-9]*", step)[0].lower()
    classes, ids = re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", step)), re.findall(r"#([\w-]+)", step)
    attrs = re.findall(r"\[([\w-]+)(?:(\*?=)[\"']?([^\"'\]]*)[\"']?)?\]", step)

    def test(n: Node) -> bool:
        have = (n.attrs.get("class") or "").split()
        return (
            (not tag or n.tag == tag) and all(c in have for c in classes) and all(n.attrs.get("id") == i for i in ids)
            and all(a in n.attrs and (not op or (v == n.attrs[a] if op == "=" else v in (n.attrs[a] or ""))) for a, op, v in attrs)
        )

    return test


class _Builder(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        while self.at.tag in CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str | None) -> Node:
    b = _Builder()
    b.feed(page or "")
    b.close()
    return b.root


def json_ld(root: Node) -> list[dict]:
    """Objects of all JSON-LD blocks: lists and @graph flattened, trailing commas mended, broken blocks skipped."""
    out: list[dict] = []
    for n in root.select("script[type=application/ld+json]"):
        for text in (n.raw(), re.sub(r",\s*([}\]])", r"\1", n.raw())):
            try:
                todo = [json.loads(text)]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo = x + todo
                elif isinstance(x, dict):
                    out.append(x)
                    todo = (x["@graph"] if isinstance(x.get("@graph"), list) else []) + todo
            break
    return out


def assigned_json(page: str, name: str):
    """The object literal after ``name =``, by balanced braces."""
    m = re.search(rf"{re.escape(name)}\s*=\s*(?=[{{\[])", page)
    if not m:
        return None
    depth, quoted, i = 0, "", m.end()
    for j in range(i, len(page)):
        c = page[j]
        if quoted:
            if c == quoted and page[j - 1] != "\\":
                quoted = ""
        elif c == '"':
            quoted = c
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                try:
                    return json.loads(page[i : j + 1])
                except ValueError:
                    return None
    return None


def next_data(root: Node):
    n = root.first("script#__NEXT_DATA__")
    try:
        return json.loads(n.raw()) if n else None
    except ValueError:
        return None


def find_keys(value, key: str, depth: int = 12) -> list:
    """Values under a key anywhere, last branches first."""
    out, todo = [], [(value, 0)]
    while todo:
        v, d = todo.pop()
        if d > depth:
            continue
        if isinstance(v, dict):
            if key in v:
                out.append(v[key])
            todo += [(x, d + 1) for x in v.values()]
        elif isinstance(v, list):
            todo += [(x, d + 1) for x in v]
    return out


def deep_get(value, path: str):
    for part in path.split("."):
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def label_values(root: Node) -> dict[str, str]:
    """Label -> value of tables, definition lists, and items with a colon; the first of a label counts."""
    out: dict[str, str] = {}
    for row in root.select("tr"):
        cells = [c.text() for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
        if len(cells) == 2 and cells[0]:
            out.setdefault(cells[0].rstrip(":"), cells[1])
    for dt in root.select("dt"):
        siblings = [c for c in dt.parent.children if isinstance(c, Node)]
        after = siblings[siblings.index(dt) + 1 : siblings.index(dt) + 2]
        if after and after[0].tag == "dd":
            out.setdefault(dt.text().rstrip(":"), after[0].text())
    for li in root.select("li"):
        label, colon, value = li.text().partition(":")
        if colon and 0 < len(label) <= 40 and value.strip():
            out.setdefault(label.strip(), value.strip())
    return out


def images(root: Node, base: str, limit: int = 40) -> list[dict]:
    """Pictures with lazy attributes first, placeholders skipped, each path once; the first is primary."""
    out, seen = [], set()
    for n in root.select("img"):
        a = n.attrs
        lazy = a.get("data-src") or a.get("data-original") or a.get("data-lazy") or a.get("src") or (a.get("srcset", "").split(",")[-1].split() or [""])[0]
        url = urljoin(base, lazy.strip()) if lazy else ""
        path = urlsplit(url).path.lower()
        if not url.startswith("http") or re.search(r"placeholder|blank|spacer|1x1|loading", url, re.I) or not (re.search(r"\.(jpe?g|png|webp|avif)$", path) or "image" in path) or path in seen:
            continue
        seen.add(path)
        out.append({"url": url, "caption": a.get("alt") or None, "is_primary": not out})
        if len(out) >= limit:
            break
    return out


# Words that tell a landmark's category.
LANDMARK_WORDS = (("metro", "metro|rrts"), ("transport", "airport|railway|bus|station"), ("school", "school|college|university"), ("hospital", "hospital|clinic"), ("mall", "mall|market|shopping"), ("business", "business|office|cyber|tech"))


def landmark(name: str, distance: str | None) -> dict:
    low = name.lower()
    m = re.search(r"(\d+(?:\.\d+)?)\s*(km|m)\b", (distance or "").lower())
    km = None if not m else float(m[1]) if m[2] == "km" else round(float(m[1]) / 1000, 3)
    return {"category": next((c for c, p in LANDMARK_WORDS if re.search(p, low)), "other"), "name": name, "distance_km": km, "raw_distance": distance}


LINKS = T.ArrayType(T.StringType())


@F.pandas_udf(LINKS)
def page_links(url: pd.Series, page: pd.Series) -> pd.Series:
    """Absolute http(s) links of a page without fragments, each once, in order."""

    def one(u: str | None, p: str | None) -> list[str]:
        out = dict.fromkeys(urljoin(u or "", n.attrs["href"]).split("#")[0] for n in parse(p).select("a[href]") if not n.attrs["href"].startswith(("#", "javascript:", "mailto:", "tel:")))
        return [x for x in out if x.startswith("http")]

    return pd.Series([one(u, p) for u, p in zip(url, page, strict=True)])


PAGE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("text", T.StringType()), T.StructField("canonical", T.StringType()),
    T.StructField("specifications", T.MapType(T.StringType(), T.StringType())), T.StructField("json_ld", T.StringType()),
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("is_primary", T.BooleanType())]))),
    T.StructField("price_text", T.StringType()), T.StructField("area_text", T.StringType()), T.StructField("address", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
])


def extract(url: str, page: str | None) -> dict:
    """What a page says of one listing, as text: structured data first, then the markup."""
    root = parse(page)
    text = lambda *s: (n.text() or None) if (n := root.first(*s)) else None
    blocks = json_ld(root)
    found = lambda *paths: next((str(v) for b in blocks for p in paths if (v := deep_get(b, p)) not in (None, "")), None)
    number = lambda x: float(x) if x and re.fullmatch(r"-?\d+(\.\d+)?", x) else None
    canonical = root.first("link[rel=canonical]")
    address = [v for k in ("address.streetAddress", "address.addressLocality", "address.addressRegion") if (v := found(k))]
    return {
        "title": text("title"), "heading": text("h1"), "text": text("article", "main", "body"), "canonical": canonical.attrs.get("href") if canonical else None,
        "specifications": label_values(root), "json_ld": json.dumps(blocks) if blocks else None, "images": images(root, url),
        "price_text": found("offers.price", "offers.lowPrice") or text("[class*=price]", "[itemprop=price]"), "area_text": found("floorSize.value") or text("[class*=area]", "[class*=size]"),
        "address": ", ".join(address) or text("address", "[class*=address]", "[class*=location]"), "latitude": number(found("geo.latitude")), "longitude": number(found("geo.longitude")),
    }


def read_pages(pages: DataFrame, parsers: dict[str, Callable[[str, str | None], dict]] | None = None, source: str | None = None) -> DataFrame:
    """pages(url, html, ...) with ``page``: the struct that the parser of the row's source makes of it (the general one if there is none)."""
    parsers = parsers or {}
    by = F.col(source) if source else F.lit("")

    @F.pandas_udf(PAGE)
    def run(url: pd.Series, html_: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsers.get(k, extract)(u or "", h) for u, h, k in zip(url, html_, kind, strict=True)], columns=PAGE.names)

    return pages.withColumn("page", run("url", "html", by))


# Address patterns, where a portal's city pages lie. {prefix}: property, or the kind of commercial space.
SEARCH_URLS = {
    "magicbricks": ("https://www.magicbricks.com/{prefix}-for-{deal}-in-{city}-{suffix}", "?page={page}"),
    "squareyards": ("https://www.squareyards.com/new-projects-in-{city}", "?page={page}"),
    "housing": ("https://housing.com/in/{section}/{city}", "?page={page}"),
}


# What a portal calls a city, and the first word of its addresses for kinds of commercial space.
CITY_SLUGS = {"delhi": "new-delhi", "new delhi": "new-delhi", "gurugram": "gurgaon", "greater noida": "greater-noida"}
COMMERCIAL_PREFIXES = {
    "shop": "shops", "office": "office-space", "showroom": "showroom", "commercial-land": "commercial-land", "industrial-land": "industrial-land",
    "commercial-real-estate": "office-space",
}


def _named(x: Column, names: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x), otherwise)


def search_url(source: Column, town: Column, deal: Column, page: Column, kind: Column | None = None) -> Column:
    """The search page of a city: sale and rent have addresses of their own; the first page has no number. ``kind``: a kind of property, which chooses
    the prefix of one portal's addresses (an unknown one: property) and is a folder of another's."""
    plain = F.lower(F.trim(town))
    slug, rent = F.replace(plain, F.lit(" "), F.lit("-")), deal == "rent"
    kind = F.lit(None).cast("string") if kind is None else kind
    prefix = _named(kind, COMMERCIAL_PREFIXES, F.lit("property"))
    out = F.lit(None).cast("string")
    for name, (path, _) in SEARCH_URLS.items():
        url = F.lit(path)
        own = _named(plain, CITY_SLUGS, slug) if name == "magicbricks" else slug
        for key, value in (("prefix", prefix), ("deal", F.when(rent, "rent").otherwise("sale")), ("suffix", F.when(rent, "pppfr").otherwise("pppfs")), ("section", F.when(rent, "rent").otherwise("buy")), ("city", own)):
            url = F.replace(url, F.lit("{" + key + "}"), value)
        if name == "squareyards":
            url = F.when(rent, F.concat(F.lit("https://www.squareyards.com/"), slug, F.lit("/property-for-rent"))).otherwise(url)
        if name == "housing":
            url = F.concat(url, F.coalesce(F.concat(F.lit("/"), F.nullif(kind, F.lit(""))), F.lit("")))
        out = F.when(source == name, url).otherwise(out)
    return F.concat(out, F.when(page > 1, F.concat(F.lit("?page="), page.cast("string"))).otherwise(F.lit("")))


# Where a listing's id stands in a portal's addresses.
ID_PATTERNS = {
    "magicbricks": [r"(?i)pdpid[-_]?([A-Za-z0-9]+)", r"(?i)/propertyDetails/[^?]*?-(\d{6,})", r"(?i)[?&]id=([A-Za-z0-9]+)"],
    "housing": [r"(?i)/(?:page|projects/page)/(\d+)", r"(?i)[?&]id=([A-Za-z0-9]+)"],
}


def unit_tables(root: Node) -> list[dict]:
    """Rows of price tables: configuration, area and price as text; an attribute with the area in square feet comes before the text."""
    out = []
    for row in root.select("tr"):
        cells = [c for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")]
        text = [c.text() for c in cells]
        plan = next((t for t in text if re.search(r"\b(bhk|rk|studio|plot|villa)\b", t, re.I)), None)
        if plan and len(cells) >= 2:
            sqft = next((n.attrs["data-sqft"] for n in row.walk() if "data-sqft" in n.attrs), None)
            size = f"{sqft} sqft" if sqft else next((t for t in text if re.search(r"sq|acre|gaj", t, re.I)), None)
            out.append({"configuration": plan, "area_text": size, "price_text": next((t for t in text if re.search(r"₹|rs|cr|lac|lakh|request", t, re.I)), None)})
    return out


def landmarks(root: Node) -> list[dict]:
    """Places nearby, from lists whose items end in a distance; the first of each name."""
    seen: dict[str, dict] = {}
    for n in root.select("li, [data-attribute]"):
        m = re.match(r"(.+?)[\s:(,-]+(\d+(?:\.\d+)?\s*(?:km|m)s?)\b", n.text(), re.I)
        if m and len(m[1]) <= 60:
            seen.setdefault(m[1].lower(), landmark(m[1].strip(), m[2]))
    return list(seen.values())


def has_next(root: Node) -> bool:
    """Whether a search page has another: a rel=next link, or any card."""
    return root.first("link[rel=next]", "a[rel=next]", "[class*=card]") is not None


def record_kind(url: Column, source: Column) -> Column:
    """project or property."""
    return F.when(F.lower(url).contains("/project") | (source == "squareyards"), "project").otherwise("property")
