"""Backfill queue as pure table transitions, a rate limiter, expiry. Every transition takes as_of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Defaults of the queue.
COOLDOWN_MIN, RETRY_MIN, LEASE_MIN, TTL_HOURS, DAILY_BUDGET, MIN_RESULTS = 360, 30, 30, 24, 500, 5


def minutes(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))


def decide(requests: DataFrame, tasks: DataFrame, as_of: Column, min_results: int = MIN_RESULTS, budget: int = DAILY_BUDGET, enabled: bool = True) -> DataFrame:
    """requests(fingerprint, result_count) + reason, should_fill: disabled, enough, unfiltered, queued, cooling, over budget, or queue it."""
    today = tasks.agg(F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 1 DAY")).alias("_today"))
    known = tasks.select("fingerprint", "status", "cooldown_until")
    rows = requests.join(known, "fingerprint", "left").crossJoin(F.broadcast(today))  # one row
    reason = (
        F.when(F.lit(not enabled), "ondemand disabled").when(F.col("result_count") >= min_results, "enough results").when(F.col("fingerprint") == "empty", "unfiltered query")
        .when(F.col("status").isin("pending", "claimed"), "already queued").when(F.col("cooldown_until") > as_of, "cooling down").when(F.col("_today") >= budget, "daily budget exhausted")
        .otherwise("queued for backfill")
    )
    return rows.withColumn("reason", reason).withColumn("should_fill", F.col("reason") == "queued for backfill").drop("_today")


def claim(tasks: DataFrame, worker: str, as_of: Column, limit: int = 1) -> DataFrame:
    """The queue after a worker took up to ``limit`` (1 to 25) tasks: pending ones and abandoned leases, oldest request first."""
    free = (F.col("status") == "pending") | ((F.col("status") == "claimed") & (F.col("claimed_at") < as_of - minutes(LEASE_MIN)))
    taken = tasks.filter(free & (F.col("expires_at") > as_of)).orderBy("requested_at", "fingerprint").limit(max(1, min(limit, 25))).select("fingerprint", F.lit(True).alias("_t"))
    rows = tasks.join(F.broadcast(taken), "fingerprint", "left")  # at most 25 rows
    return rows.withColumns({
        "status": F.when(F.col("_t"), "claimed").otherwise(F.col("status")), "claimed_by": F.when(F.col("_t"), worker).otherwise(F.col("claimed_by")),
        "claimed_at": F.when(F.col("_t"), as_of).otherwise(F.col("claimed_at")), "attempts": F.coalesce("attempts", F.lit(0)) + F.when(F.col("_t"), 1).otherwise(0),
    }).drop("_t")


def complete(tasks: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """results(fingerprint, records_written, error): done or failed; a failure may be tried again sooner."""
    r = results.select("fingerprint", F.lit(True).alias("_r"), F.col("records_written").alias("_n"), F.substring("error", 1, 500).alias("_e"))
    failed = F.col("_e").isNotNull()
    pick = lambda new, old: F.when(F.col("_r"), new).otherwise(F.col(old))
    return tasks.join(r, "fingerprint", "left").withColumns({
        "status": pick(F.when(failed, "failed").otherwise("done"), "status"), "completed_at": pick(as_of, "completed_at"), "records_written": pick(F.col("_n"), "records_written"),
        "last_error": pick(F.col("_e"), "last_error"), "cooldown_until": pick(as_of + F.when(failed, minutes(RETRY_MIN)).otherwise(minutes(COOLDOWN_MIN)), "cooldown_until"),
    }).drop("_r", "_n", "_e")


def stats(tasks: DataFrame, as_of: Column, budget: int = DAILY_BUDGET) -> DataFrame:
    """(name, value): tasks by status, made in a day, budget left."""
    day = F.count_if(F.col("created_at") >= as_of - F.expr("INTERVAL 1 DAY"))
    today = tasks.agg(day.alias("n")).select(F.explode(F.create_map(F.lit("created_last_24h"), F.col("n"), F.lit("budget_remaining"), F.greatest(F.lit(0), F.lit(budget) - F.col("n")))).alias("name", "value"))
    return tasks.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("value")).unionByName(today)


def admit(events: DataFrame, key: str, seconds: str, limit: int = 120, span: int = 60) -> DataFrame:
    """Adds admitted: a sliding window of admitted hits, refused ones not counted. Sequential by key, so one task per key, streamed: it holds the window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for f in frames:
            out = []
            for k, t in zip(f[key], f[seconds], strict=True):
                if k != last:
                    last, held = k, []
                held = [h for h in held if h > t - span]
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(t)
            yield f.assign(admitted=out)

    rows = events.repartition(F.col(key)).sortWithinPartitions(key, seconds)
    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", admitted boolean")
