"""Streaming forms of the stateful operators: price changes, seen-sets, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def price_changes(stream: DataFrame, key: str = "property_id", at: str = "observed_at", price: str = "price") -> DataFrame:
    """Rows at which a key's price is new or other than the last one seen; state: that price."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).dropna(subset=[price]).sort_values([at, price])
        out = []
        for t, p in zip(rows[at], rows[price], strict=True):
            if last is None or p != last:
                out.append((k[0], t, float(p), last, None if last is None else float(p) - last))
                last = float(p)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["property_id", "observed_at", "price", "previous_price", "change_amount"])

    kinds = dict(stream.dtypes)
    schema = f"property_id {kinds[key]}, observed_at timestamp, price double, previous_price double, change_amount double"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "price double", "append", GroupStateTimeout.NoTimeout)


def unseen(stream: DataFrame, keys: list[str], at: str, within: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, group: str, value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows per group; rows later than the watermark are dropped."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, size), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), group, "n", "total")
