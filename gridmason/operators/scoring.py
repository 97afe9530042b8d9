"""Explainable scores, 0 to 100: location, risk, investment, builder trust. Columns in, struct<value, components, notes> out; as_of is explicit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of corridors, amenities nearby, construction stages and segments.
CORRIDOR_WEIGHTS = {
    "Golf Course Road": 92.0, "Cyber City": 90.0, "Golf Course Extension Road": 84.0, "Dwarka Expressway": 82.0, "Noida Expressway": 80.0,
    "Southern Peripheral Road": 76.0, "MG Road": 74.0, "New Gurgaon": 70.0, "Sohna Road": 68.0, "Greater Noida West": 62.0, "Dwarka": 72.0,
    "Yamuna Expressway": 58.0, "Indirapuram": 62.0, "Neharpar": 55.0, "NH-24 / NH-9": 58.0,
}
LANDMARK_WEIGHTS = {"metro": 12.0, "transport": 6.0, "school": 8.0, "hospital": 8.0, "mall": 6.0, "business": 5.0}
STAGE_RISK = {"ready_to_move": 5.0, "completed": 5.0, "under_construction": 25.0, "new_launch": 32.0, "upcoming": 38.0, "unknown": 20.0}
STAGE_UPSIDE = {"new_launch": 8.0, "under_construction": 7.0, "upcoming": 6.0, "ready_to_move": 5.0, "completed": 4.0, "unknown": 4.0}
SEGMENT_POINTS = {"affordable": 7.0, "mid": 8.0, "premium": 6.0, "luxury": 4.0, "ultra_luxury": 2.0, "unknown": 4.0}
EARLY = ("under_construction", "new_launch", "upcoming")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def capped(x: Column, most: float) -> Column:
    """At most ``most``; 0 for null (least alone skips nulls)."""
    return F.when(x.isNull(), 0.0).otherwise(F.least(F.lit(most), x))


def looked_up(c: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _score(parts: dict[str, Column], notes: list[Column], value: Column | None = None) -> Column:
    total = sum(parts.values(), F.lit(0.0)) if value is None else value
    components = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.bround(v.cast("double"), 2))])
    return F.struct(F.bround(clamp(total), 2).alias("value"), components.alias("components"), F.array_compact(F.array(*notes)).alias("notes"))


def location(corridor: Column, landmarks: Column, has_coordinates: Column, listings: Column) -> Column:
    """landmarks array<struct<category, distance_km>>: the first of each category counts, by its distance."""
    base = looked_up(corridor, CORRIDOR_WEIGHTS, 55.0)
    near = F.transform(F.coalesce(landmarks, F.array().cast("array<struct<category:string,distance_km:double>>")), lambda x: F.struct(F.lower(x["category"]).alias("category"), x["distance_km"].alias("d")))
    categories = F.transform(near, lambda x: x["category"])
    first = F.filter(near, lambda x, i: F.array_position(categories, x["category"]) == i + 1)
    reach = lambda d: F.when(d.isNull() | (d <= 2), 1.0).when(d <= 5, 0.6).otherwise(0.3)
    points = F.aggregate(F.transform(first, lambda x: looked_up(x["category"], LANDMARK_WEIGHTS, 0.0) * reach(x["d"])), F.lit(0.0), lambda a, b: a + b)
    parts = {"micro_market": base, "landmarks": F.least(points, F.lit(30.0)), "market_depth": F.least(F.lit(10.0), F.coalesce(listings, F.lit(0)) / 20.0), "geo_precision": F.when(has_coordinates, 3.0).otherwise(0.0)}
    notes = [F.when(corridor.isNull(), "no micro-market resolved; regional baseline"), F.when(F.size(near) == 0, "no landmark data on this listing")]
    return _score(parts, notes, base * 0.6 + parts["landmarks"] + parts["market_depth"] + parts["geo_precision"])


def _ratio(price: Column, median: Column) -> Column:
    return F.when((price != 0) & (median != 0), price.cast("double") / median.cast("double"))


def risk(status: Column, due: Column, registration: Column, trust: Column, ppsf: Column, median: Column, negative: Column, mentions: Column, age_days: Column, as_of: Column) -> Column:
    """Higher is riskier."""
    late = F.when(status.isin(*EARLY), F.datediff(as_of.cast("date"), due) / 30.0)
    late = F.when(late > 0, late)
    ratio = _ratio(ppsf, median)
    registered = F.coalesce(registration != "", F.lit(False))
    enough = F.coalesce(mentions, F.lit(0)) >= 3
    share = F.when(enough, negative / mentions)
    old = F.when(age_days > 180, age_days)
    parts = {
        "construction_stage": looked_up(status, STAGE_RISK, 20.0),
        "possession_slip": capped(late * 1.5, 25.0),
        "rera": F.when(registered, 0.0).otherwise(12.0),
        "builder": F.when(trust.isNull(), 15.0).otherwise((100.0 - trust) * 0.25),
        "price_dislocation": F.when(ratio > 1.35, F.least(F.lit(15.0), (ratio - 1.35) * 40)).when(ratio < 0.65, F.least(F.lit(15.0), (0.65 - ratio) * 40)).otherwise(0.0),
        "public_sentiment": F.coalesce(share * 15.0, F.lit(0.0)),
        "staleness": capped((old - 180) / 60.0, 8.0),
    }
    notes = [
        F.when(late.isNotNull(), F.concat(F.lit("possession date passed ~"), F.floor(late).cast("string"), F.lit(" months ago"))), F.when(~registered, "no RERA number found on the listing"),
        F.when(trust.isNull(), "builder trust unknown; using neutral prior"), F.when(ratio > 1.35, "priced above locality median"), F.when(ratio < 0.65, "priced below locality median; verify title"),
        F.when(share > 0.5, "public mentions are mostly negative"), F.when(old.isNotNull(), F.concat(F.lit("listed for "), age_days.cast("string"), F.lit(" days"))),
    ]
    return _score(parts, notes)


def investment(location_value: Column, risk_value: Column, yield_pct: Column, ppsf: Column, median: Column, trend_pct: Column, status: Column, segment: Column, trust: Column) -> Column:
    ratio = _ratio(ppsf, median)
    stage = looked_up(status, STAGE_UPSIDE, 4.0)
    weak = F.coalesce((trust < 40) & (stage > 5), F.lit(False))
    parts = {
        "location": location_value * 0.30,
        "relative_value": F.when(ratio > 0, F.least(F.lit(25.0), clamp(25.0 * (2 - ratio)))).otherwise(12.0),
        "rental_yield": F.when(yield_pct.isNull(), 6.0).otherwise(F.least(F.lit(15.0), F.greatest(F.lit(0.0), yield_pct * 3.5))),
        "price_momentum": F.when(trend_pct.isNull(), 5.0).otherwise(F.least(F.lit(15.0), clamp(5.0 + trend_pct * 0.8))),
        "stage_upside": F.when(weak, stage * 0.5).otherwise(stage),
        "segment_liquidity": looked_up(segment, SEGMENT_POINTS, 4.0),
        "risk_penalty": -(risk_value * 0.30),
    }
    notes = [
        F.when(ratio < 0.9, "priced below locality median"), F.when(ratio.isNull(), "no locality benchmark available; value component is neutral"), F.when(yield_pct >= 4, "strong rental yield"),
        F.when(trend_pct > 8, "locality prices rising"), F.when(weak, "early-stage upside discounted for weak builder record"),
    ]
    return _score(parts, notes)


def builder_trust(completed: Column, ongoing: Column, total: Column, since_year: Column, rating: Column, rating_count: Column, positive: Column, negative: Column, delays: Column, fraud: Column, model_trust: Column, as_of: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0))
    done = z(completed) > 0
    delivery = F.least(F.lit(20.0), z(completed) * 1.5) * F.when(total > 0, 0.5 + z(completed) / total * 0.5).otherwise(1.0)
    years = F.when((since_year > 1900) & (since_year <= F.year(as_of)), F.year(as_of) - since_year)
    mentions = z(positive) + z(negative)
    parts = {
        "base": F.lit(50.0),
        "delivery_record": F.when(done, delivery).otherwise(0.0),
        "longevity": capped(years * 0.4, 10.0),
        "portal_rating": F.coalesce((rating - 3.0) * 5.0 * F.greatest(F.least(F.lit(1.0), z(rating_count) / 50.0), F.lit(0.2)), F.lit(0.0)),
        "public_sentiment": F.when(mentions >= 3, (z(positive) - z(negative)) / mentions * 12.0).otherwise(0.0),
        "complaint_penalty": -F.least(F.lit(15.0), z(delays) * 2.0) - F.least(F.lit(20.0), z(fraud) * 4.0),
    }
    hard = clamp(sum(parts.values(), F.lit(0.0)))
    notes = [
        F.when(done & (total > 0), F.concat(z(completed).cast("string"), F.lit("/"), total.cast("string"), F.lit(" projects delivered"))), F.when(~done & (z(ongoing) > 0), "only ongoing projects on record; no delivery history yet"),
        F.when(years.isNotNull(), F.concat(F.lit("operating for "), years.cast("string"), F.lit(" years"))), F.when(rating.isNotNull() & (z(rating_count) < 10), "portal rating based on a small sample"),
        F.when(z(delays) > 0, F.concat(z(delays).cast("string"), F.lit(" public reports of delays"))), F.when(z(fraud) > 0, F.concat(z(fraud).cast("string"), F.lit(" public allegations of malpractice (unverified)"))),
        F.when((mentions < 3) & ~done, "low-confidence score: little public data on this builder"),
    ]
    return _score(parts, notes, F.when(model_trust.isNull(), hard).otherwise(hard * 0.7 + model_trust * 0.3))


def confidence(n: Column) -> Column:
    return F.when(n >= 30, "strong").when(n >= 10, "moderate").when(n >= 3, "weak").otherwise("insufficient")


def band(score: Column, inverted: bool = False) -> Column:
    """good, mid, bad or none; ``inverted`` for scores where low is good."""
    good, bad = (score <= 30, score >= 60) if inverted else (score >= 70, score <= 35)
    return F.when(score.isNull(), "none").when(good, "good").when(bad, "bad").otherwise("mid")
