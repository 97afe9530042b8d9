"""What the training-data operators share: the shared folder, tables that cut lineage, connected components."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where it is unset, a plain local session (tests) gets
    one under /tmp/checkpoints; a cluster without the setting is an error, since a machine-local folder loses data there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


_made: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder for one table; the default ones of local sessions go when Python ends, others by ``clear``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this process has written to the shared folder: once no result of these operators is read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _clear_local() -> None:
    for path in _made:
        if path.startswith("file:///tmp/checkpoints/"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Documents can be long: holds Arrow batches of this session to so many rows, in the JVM and in Python."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release() -> None:
    """Gives memory that a Python worker no longer uses back to the machine: workers live on between tasks, beside the JVM's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest(df: DataFrame, by: str, h: str, k: int, counts: dict[str, int]) -> DataFrame:
    """At most k rows of df for each value of ``by`` (a class of which there are few), those with the smallest ``h``: 64-bit hashes, all different. ``counts``: rows by class.

    A class with more rows is first cut at the hash under which about twice as many rows are as are wanted, so that the window sorts
    a bounded number of rows of a class, whatever its size. (Should too few hashes lie there, fewer rows than k come out.)"""
    cut = [(c, int(-(1 << 63) + min(1.0, (2 * k + 50) / n) * ((1 << 64) - 1025))) for c, n in counts.items()]
    cuts = df.sparkSession.createDataFrame(cut, f"{by} string, _cut bigint")
    under = df.join(F.broadcast(cuts), by).filter(F.col(h) <= F.col("_cut")).drop("_cut")
    return under.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(h))).filter(F.col("_r") <= k).drop("_r")


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """The join, never by broadcast: for tables that grow with the documents. Spark takes a table for as large as its compressed files, and an exploded array for one element, and so would
    send through the driver what it cannot hold."""
    return left.hint("merge").join(right, on, how)


#: The most masks of 64 ids that are broadcast to filter a scan; beyond it the same join is shuffled. A relation takes about 75 bytes a mask in the driver, and a copy while it is sent.
BROADCAST_MASKS = 250_000


def masks(ids: DataFrame, on: str) -> DataFrame:
    """The ids (a long column ``on``, of any sign; nulls are left out) as bits: (_run, _mask), one row for each run of 64 values that has any."""
    bit = F.expr(f"shiftleft(1L, cast(`{on}` & 63 as int))")
    return ids.filter(F.col(on).isNotNull()).groupBy(F.shiftright(on, 6).alias("_run")).agg(F.bit_or(bit).alias("_mask"))


def by_ids(df: DataFrame, ids: DataFrame, on: str, anti: bool = False) -> DataFrame:
    """df's rows whose long ``on`` is in ids (with anti: is not, or is null). Ids may repeat. They are broadcast as masks, of which dense ids take one for 64,
    while these are at most BROADCAST_MASKS (19 MB); else the join is shuffled."""
    packed = stash(masks(ids, on), "masks")
    if packed.count() > BROADCAST_MASKS:
        return shuffled(df, ids.select(on).distinct(), on, "left_anti" if anti else "left_semi").select(*df.columns)
    rows = df.withColumn("_run", F.shiftright(on, 6)).join(F.broadcast(packed), "_run", "left" if anti else "inner")
    has = F.expr(f"coalesce(getbit(_mask, cast(`{on}` & 63 as int)), 0) = 1")
    return rows.filter(~has if anti else has).select(*df.columns)


def lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of the nodes 0 to n - 1 reaches by the edges a-b."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # roots under smaller ones
        while ((up := low[low]) != low).any():
            low = up


#: The most edges between long ids (16 MB) that one task settles; more of them, or ids of any length, take rounds over all tasks.
AT_ONCE = 1_000_000


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b) of longs, in one task and one shuffle: a round of plans costs the driver more memory than these edges take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            n = sum(len(a) for a, _ in held)
            nodes, at = np.unique(np.concatenate([x[0] for x in held] + [x[1] for x in held]), return_inverse=True)
            low = nodes[lowest(at[:n], at[n:], len(nodes))]
            for k in range(0, len(nodes), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000]), pa.array(low[k : k + 10_000])], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, label: str = "cc", max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """Connected components of ``edges(a, b)`` (any type that sorts, a != b): one row (node, component) for each node that
    has an edge; component is the smallest node reachable.

    Up to ``at_once`` edges between longs are settled in one task. More, or others: alternating large-star and small-star steps; each is a grouped minimum (combined before its shuffle, so that a node
    with a large share of all edges is one row per task) joined back by key (an inner join that AQE splits when skewed).
    Every round ends in a table in the shared folder. Edges with a null end are left out; no edges give no rows.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select("a", "b") if small else e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        low = low.select("k", F.least("m", "k").alias("m"))
        linked = shuffled(both, low, F.col("a") == F.col("k"))
        if small:  # a > b in every row: b and a itself hang under the smallest neighbour
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        else:  # neighbours above a hang under the smallest of a and its neighbours
            out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.filter(F.col("a") > F.col("b")).distinct()

    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stash(edges, label)
    if {t for _, t in now.dtypes} == {"bigint"} and now.count() <= at_once:
        return stash(_at_once(now), label)
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s"), F.countDistinct("a").alias("d")).first()
    seen = None
    for _ in range(max_rounds):
        now = stash(star(star(now, False), True), label)
        mark = print_of(now)
        if mark["n"] == 0 or tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 150, memory: int = 8, enough: float = 1e-8) -> np.ndarray:
    """The minimum of a convex f (value and gradient) by limited-memory quasi-Newton steps."""
    value, slope = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, parts = slope.copy(), []
        for dx, dg in reversed(moves):
            parts.append((dx @ step) / (dx @ dg))
            step -= parts[-1] * dg
        step *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (dx, dg), a in zip(moves, reversed(parts), strict=True):
            step += dx * (a - (dg @ step) / (dx @ dg))
        t, down = 1.0, float(step @ slope)
        while True:
            there = x - t * step
            new, new_slope = f(there)
            if new <= value - 1e-4 * t * down or t < 1e-9:
                break
            t /= 2
        if (there - x) @ (new_slope - slope) > 1e-12:
            moves = [*moves, (there - x, new_slope - slope)][-memory:]
        settled = abs(value - new) < enough * max(1.0, abs(value))
        x, value, slope = there, new, new_slope
        if settled:
            break
    return x


def crc_mod(col: Column | str, m: int) -> Column:
    """crc32 of the value as text, modulo m."""
    return F.pmod(F.crc32(F.col(col) if isinstance(col, str) else col), F.lit(m))
