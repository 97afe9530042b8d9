"""Exact top-k inner products through a pivot-distance index.

With M the largest norm, a vector x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0): the highest inner products are then the
smallest distances, |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Every vector is keyed by its nearest pivot (cell) and its distance to it;
a cell is cut into bands of that distance, and a band dealt into blocks of bounded size. A query reads its home block first, which bounds
its k-th score; then, of every band whose distances the triangle inequality doesn't exclude, annuli around its
own distance to the pivot, outwards until the bound stops it. Vectors travel to a block that some query reads, once for so many of its queries;
blocks that none reads stay where they are. Bounds carry a slack for rounding; scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmason.llm.common import stash


def _usable(vec: str) -> str:
    return f"{vec} is not null and size({vec}) > 0 and not exists({vec}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"


def _scaled(rows, scale: float) -> np.ndarray:
    return np.floor(scale * np.array(rows.tolist(), np.float64)) if len(rows) else np.zeros((0, 0))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact x @ q for integers held as doubles."""
    if x.size == 0 or float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2**52:
        return (x @ q).astype(np.int64)
    return np.array([int(sum(int(a) * int(b) for a, b in zip(row, q, strict=True))) for row in x], dtype=object).astype(np.int64)


def _pivots(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """Centres of the sample: farthest first, then a few k-means rounds."""
    n = max(1, min(n, len(sample)))
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].copy()
    for _ in range(rounds):
        home = ((sample[:, None, :] - centres[None]) ** 2).sum(2).argmin(1) if len(sample) * n * sample.shape[1] < 3e7 else _nearest(sample, centres)[0]
        for c in range(n):
            if (home == c).any():
                centres[c] = sample[home == c].mean(0)
    return centres


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.maximum((x**2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(1)[None], 0)
    home = d.argmin(1)
    return home, np.sqrt(((x - pivots[home]) ** 2).sum(1))


def top_k(vectors: DataFrame, k: int = 10, scale: float = 1024.0, query_mod: int = 100, id_col: str = "vec_id", vec: str = "embedding", **index: int) -> DataFrame:
    """For each row whose id is divisible by ``query_mod``: the k highest integer inner products of floor(scale * x) with
    every other row, ties to the smaller id: query_id, rank, vec_id, score.

    Rows with a null id, or whose vector is null, empty, or holds a null or non-finite component, take no part; vectors of different lengths have
    no product: each length is searched by itself. Rows that repeat an id are rows of their own: each is a candidate, and each a
    query if its id qualifies. Fewer than k other rows: all of them. Scores must fit a long. ``index``: see ``top_k_of_length``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("e")).filter(f"vec_id is not null and {_usable('e')}")
    lengths = sorted(r["d"] for r in rows.select(F.size("e").alias("d")).distinct().collect())
    out = [top_k_of_length(rows.filter(F.size("e") == d), d, k, scale, query_mod, **index) for d in lengths]
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def top_k_of_length(rows: DataFrame, dim: int, k: int, scale: float, query_mod: int, n_pivots: int = 32, bands: int = 64, block_rows: int = 4096, block_queries: int = 4096, sample: int = 2048) -> DataFrame:
    """``top_k`` of rows(vec_id, e) with usable vectors of one length. Pivots come from at most ``sample`` rows; every row is
    indexed. A cell is cut into bands of about ``block_rows`` rows each, ``bands`` at most; ``block_rows`` and ``block_queries`` meet in a task at most."""
    norm2 = F.expr(f"aggregate(e, 0D, (s, x) -> s + floor({scale}D * x) * floor({scale}D * x))")
    m2 = float(rows.agg(F.max(norm2)).first()[0])
    some = rows.orderBy(F.xxhash64("vec_id"), "e").limit(sample).select("e").toPandas()["e"]
    lift = lambda x: np.column_stack([x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0))])
    pivots = _pivots(lift(_scaled(some, scale)), n_pivots)
    slack = 1e-6 * max(1.0, np.sqrt(m2))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _scaled(f["e"], scale)
                home, dist = _nearest(lift(x), pivots)
                yield pd.DataFrame({"uid": f["uid"], "vec_id": f["vec_id"], "cell": home.astype(np.int32), "dist": dist, "x": [r.tobytes() for r in x]})

    index = stash(rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "vec_id", "e").mapInPandas(assign, "uid long, vec_id long, cell int, dist double, x binary"), "pivot-index")
    cuts = index.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / bands for i in range(1, bands)], 10_000).alias("cuts")).collect()
    wanted = {r["cell"]: min(bands, -(-r["n"] // block_rows)) for r in cuts}  # a band of fewer rows than a block would only be one more place to ask
    used = {r["cell"]: sorted({r["cuts"][i * bands // wanted[r["cell"]] - 1] for i in range(1, wanted[r["cell"]])}) for r in cuts}
    of_cell = F.create_map(*[x for c, at in used.items() for x in (F.lit(c), F.array(*[F.lit(d) for d in at]).cast("array<double>"))])
    dealt = index.withColumn("band", F.size(F.filter(of_cell[F.col("cell")], lambda c: c < F.col("dist"))))
    held = {(r["cell"], r["band"]): r for r in dealt.groupBy("cell", "band").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    blocks = {key: -(-r["n"] // block_rows) for key, r in held.items()}
    per_band = F.create_map(*[F.lit(x) for (c, b), n in blocks.items() for x in (c * bands + b, n)])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("uid"), per_band[F.col("cell") * bands + F.col("band")]).cast("int"))
    queries = dealt.filter(F.pmod("vec_id", F.lit(query_mod)) == 0)
    where = ["cell", "band", "block"]

    def meet(asked: DataFrame, label: str) -> DataFrame:
        """Each block with the queries that read it, at most ``block_queries`` in a task; a block is copied only where it has more, and not sent if it has none."""
        asked = stash(asked, label)
        chunks = asked.groupBy(*where).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("chunks"))
        asked = asked.join(chunks, where).withColumn("chunk", F.pmod(F.xxhash64("uid", F.lit(5)), F.col("chunks")).cast("int"))
        sent = dealt.join(chunks, where).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        at = [*where, "chunk"]
        return sent.select(*at, "uid", "vec_id", "dist", "x").groupBy(*at).cogroup(asked.select(*at, "uid", "vec_id", "x", "bound").groupBy(*at)).applyInPandas(search, "uid long, query_id long, vec_id long, score long")

    def search(_key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Best k of a block for each query; asked.bound: a k-th score found elsewhere."""
        got: list[tuple] = []
        if len(held) and len(asked):
            held = held.sort_values(["dist", "uid"])
            x = np.frombuffer(b"".join(held["x"]), np.float64).reshape(len(held), dim)
            dist, ids, uids = held["dist"].to_numpy(), held["vec_id"].to_numpy(), held["uid"].to_numpy()
            pivot = pivots[int(held["cell"].iloc[0])]
            for quid, qid, raw, bound in zip(asked["uid"], asked["vec_id"], asked["x"], asked["bound"], strict=True):
                q = np.frombuffer(raw, np.float64)
                lifted = np.append(q, 0.0)
                at = float(np.sqrt(((lifted - pivot) ** 2).sum()))
                q2 = float((q**2).sum())
                best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                low = hi = int(np.searchsorted(dist, at))
                floor = bound
                while True:  # the next annulus, on the side that is nearer
                    radius = np.sqrt(max(q2 + m2 - 2 * floor, 0)) + slack if floor > -np.inf else np.inf
                    left = at - dist[low - 1] if low > 0 else np.inf
                    right = dist[hi] - at if hi < len(dist) else np.inf
                    if min(left, right) > radius or left == right == np.inf:
                        break
                    if left <= right:
                        new = max(0, low - 1024)
                        part, low = slice(new, low), new
                    else:
                        new = min(len(dist), hi + 1024)
                        part, hi = slice(hi, new), new
                    s = _scores(x[part], q)
                    keep = (uids[part] != quid) & (s >= floor)
                    s, i = np.concatenate([best[0][0], s[keep]]), np.concatenate([best[0][1], ids[part][keep]])
                    order = np.lexsort((i, -s))[:k]
                    best = [(s[order], i[order])]
                    if len(order) == k:
                        floor = max(floor, float(s[order[-1]]))
                got += [(quid, qid, int(i), int(s)) for s, i in zip(*best[0], strict=True)]
        return pd.DataFrame(got, columns=["uid", "query_id", "vec_id", "score"]).astype("int64")

    first = stash(meet(queries.select("uid", "vec_id", "x", F.lit(float("-inf")).alias("bound"), *where), "topk-asked-home"), "topk-home")
    bounds = first.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("bound"))
    ranges = [(c, b, r["lo"], r["hi"]) for (c, b), r in held.items()]

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The other blocks that a query has to read."""
        cell, band, lo, hi = (np.array(x) for x in zip(*ranges, strict=True))
        for f in frames:
            for r in f.itertuples(index=False):
                q = np.frombuffer(r.x, np.float64)
                radius = np.sqrt(max(float((q**2).sum()) + m2 - 2 * r.bound, 0)) + slack if r.bound > -np.inf else np.inf
                at = np.sqrt(((np.append(q, 0.0) - pivots) ** 2).sum(1))[cell]
                near = np.flatnonzero(np.maximum(at - hi, lo - at) <= radius)
                todo = [(c, b, i) for c, b in zip(cell[near].tolist(), band[near].tolist(), strict=True) for i in range(blocks[c, b]) if (c, b, i) != (r.cell, r.band, r.block)]
                if todo:
                    c, b, i = (np.array(x, np.int32) for x in zip(*todo, strict=True))
                    yield pd.DataFrame({"uid": r.uid, "vec_id": r.vec_id, "x": [r.x] * len(todo), "bound": r.bound, "cell": c, "band": b, "block": i})

    asked = queries.join(bounds, "uid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    asked = asked.select("uid", "vec_id", "x", "bound", *where).mapInPandas(probe, "uid long, vec_id long, x binary, bound double, cell int, band int, block int")
    second = meet(asked, "topk-asked")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    best = first.unionAll(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
