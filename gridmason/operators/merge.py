"""Keyed merges: partial updates that never erase, batches with repeated keys, stale rows, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmason.operators.history import latest


def upsert(old: DataFrame, new: DataFrame, key: str, always: list[str], preserve: list[str], insert_only: list[str] = (), append_to: list[str] = (), order: list[Column] | None = None) -> DataFrame:
    """The table after the batch: ``always`` columns are overwritten, ``preserve`` ones only by a filled value, ``insert_only`` ones kept once
    set, ``append_to`` arrays joined as sets. Of a key's rows in the batch the first by ``order`` counts. One shuffle of both sides by key; ``old`` may
    be any size."""
    new = latest(new, [key], *order) if order else new
    o, n = old.alias("o"), new.alias("n")
    has_new = F.col(f"n.{key}").isNotNull()

    def filled(c: str) -> Column:
        kind = new.schema[c].dataType.simpleString()
        x = F.col(f"n.{c}")
        return F.when(x != "", x) if kind == "string" else F.when(F.size(x) > 0, x) if kind.startswith("array") else x

    out = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    out += [F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in always]
    out += [F.coalesce(filled(c), F.col(f"o.{c}")).alias(c) for c in preserve]
    out += [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in insert_only]
    out += [F.array_union(F.coalesce(f"o.{c}", F.array()), F.coalesce(f"n.{c}", F.array())).alias(c) for c in append_to]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*out)


def replace_groups(old: DataFrame, new: DataFrame, key: str, retain_stale: bool = False) -> DataFrame:
    """A refreshed rollup; with ``retain_stale`` groups that vanished stay."""
    return new.unionByName(old.join(new.select(key), key, "left_anti")) if retain_stale else new


def update_existing(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns overwritten where the key has a change; no rows are added."""
    c = changes.select(key, *[F.col(x).alias(f"_{x}") for x in columns])
    out = table.join(c, key, "left")
    return out.withColumns({x: F.coalesce(f"_{x}", x) if x in table.columns else F.col(f"_{x}") for x in columns}).drop(*[f"_{x}" for x in columns])


def find_or_create(table: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows of names whose key the table lacks, one per key."""
    return names.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(table.select(key), key, "left_anti")


def mark_stale(listings: DataFrame, as_of: Column, days: int = 21) -> DataFrame:
    """Active rows not seen for ``days`` become inactive, delisted now."""
    stale = F.col("is_active") & (F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(days)))
    return listings.withColumns({"delisted_at": F.when(stale, as_of).otherwise(F.col("delisted_at")), "is_active": F.col("is_active") & ~F.coalesce(stale, F.lit(False))})


def touch(listings: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Skipped as unchanged, but seen: last_seen_at moves on."""
    s = seen.groupBy(key).agg(F.max("seen_at").alias("_seen"))
    return listings.join(s, key, "left").withColumn("last_seen_at", F.greatest("last_seen_at", "_seen")).drop("_seen")


def unknown_only(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return batch.join(seen.select(*keys).distinct(), keys, "left_anti")


def expire(rows: DataFrame, at: str, as_of: Column, days: int) -> DataFrame:
    return rows.filter(F.col(at) > as_of - F.make_dt_interval(F.lit(days)))


def accept_reject(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the reasons): each check is a condition that has to hold."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    judged = rows.withColumn("reasons", reasons)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def pending(rows: DataFrame, version: int, force: bool = False) -> DataFrame:
    """Active rows never enriched, or by an older version (an unknown one is not older); with ``force`` all active rows."""
    due = F.lit(True) if force else F.col("enriched_at").isNull() | F.coalesce(F.col("enrichment_version") < version, F.lit(False))
    return rows.filter(F.coalesce("is_active", F.lit(False)) & due)


#: Fixed value: a description has to be longer to be worth a model's reading.
LEAST_DESCRIPTION = 120


def unresolved(rows: DataFrame, wanted: tuple[str, ...] = ("builder_name", "project_name", "summary")) -> DataFrame:
    """Active rows with a description and something wanted still missing."""
    missing = F.array_contains(F.array(*[F.col(c).isNull() for c in wanted]), True)
    return rows.filter(F.coalesce("is_active", F.lit(False)) & (F.length("description") > LEAST_DESCRIPTION) & missing)


def first_of(key: str, *sources: DataFrame) -> DataFrame:
    """The union of sources of the same columns, one row per key: of the first source that has it (its smallest row)."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("_source"), *sources[0].columns)
        out = part if out is None else out.unionByName(part)
    rest = [c for c in sources[0].columns if c != key]
    best = out.groupBy(key).agg(F.min(F.struct("_source", *rest)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest]).select(*sources[0].columns)
