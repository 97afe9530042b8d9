"""Best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens; pieces go into as few sequences as a branch-and-bound search finds.
Lengths are integers up to the capacity, so the whole problem is the histogram of lengths, at most ``capacity`` rows however
many documents there are. The driver solves that; executors then number the pieces of each length and look up their place.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmason.llm.common import stash

Filling = tuple[int, ...]


def _dominates(a: Filling, b: Filling) -> bool:
    """Whether b's items fit into a's items as bins (so that using a leaves nothing worse), by Martello and Toth."""
    room = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[j] -= b[i]
                if place(i + 1):
                    return True
                room[j] += b[i]
        return False

    return sum(b) <= sum(a) and place(0)


def fullest(gap: int, counts: dict[int, int]) -> Filling:
    """A filling of ``gap`` with the highest sum that the lengths that remain can reach, by however many items."""
    mask = (1 << (gap + 1)) - 1
    reach, before = 1, []  # sums so far, as a bit set; (length, items taken at once, sums without them)
    for s in sorted((s for s, n in counts.items() if n > 0 and s <= gap), reverse=True):
        left, k = min(counts[s], gap // s), 1
        while left and not reach >> gap & 1:
            k = min(k, left)
            before.append((s, k, reach))
            reach |= reach << (s * k) & mask
            left, k = left - k, 2 * k
    total, out = reach.bit_length() - 1, []
    for s, k, sums in reversed(before):
        if not sums >> total & 1:
            out += [s] * k
            total -= s * k
    return tuple(sorted(out, reverse=True))


def every_filling(gap: int, counts: dict[int, int]) -> Iterator[Filling]:
    """All undominated fillings of ``gap`` from the lengths that remain, by any number of items, by falling sum."""
    sizes = sorted((s for s, n in counts.items() if n > 0 and s <= gap), reverse=True)
    mask = (1 << (gap + 1)) - 1
    reach = [1]  # from the smallest length on: the sums that these lengths reach
    for s in reversed(sizes):
        bits, left, k = reach[-1], min(counts[s], gap // s), 1
        while left:
            k = min(k, left)
            bits |= bits << (s * k) & mask
            left, k = left - k, 2 * k
        reach.append(bits)
    reach.reverse()

    def build(i: int, total: int, taken: Filling) -> Iterator[Filling]:
        if not total:
            yield taken
        elif i < len(sizes):
            for k in range(min(counts[sizes[i]], total // sizes[i]), -1, -1):
                if reach[i + 1] >> (total - k * sizes[i]) & 1:
                    yield from build(i + 1, total - k * sizes[i], taken + (sizes[i],) * k)

    found: list[Filling] = []
    for total in range(gap, -1, -1):
        if reach[0] >> total & 1:
            for f in build(0, total, ()):
                if not any(_dominates(g, f) for g in found):
                    found.append(f)
                    yield f


def likely_fillings(gap: int, counts: dict[int, int], most_items: int = 4, most: int = 6, sums: int = 40) -> list[Filling]:
    """The fillings of ``gap`` that are tried first, about ``most``: undominated ones of at most ``most_items`` items among the ``sums`` highest sums, topped up
    with what their gap still holds; where none of these fills it, the fullest of any number of items comes first. ``every_filling`` has the rest.

    Sums that k items reach are a bit set; the highest reachable one is the best fit. Fillings are tried by falling sum and
    falling largest item: an item in place of several with its sum dominates them, and what is hard to place goes first.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= gap), reverse=True)
    if not sizes:
        return [()]
    mask = (1 << (gap + 1)) - 1
    reach = [1]
    for _ in range(most_items):
        bits = 0
        for s in sizes:
            bits |= reach[-1] << s
        reach.append(bits & mask)
        if reach[-1] >> gap & 1 or not reach[-1]:
            break
    every = 0
    for r in reach:
        every |= r
    found: list[Filling] = []

    def build(total: int, k: int, last: int, taken: list[int]) -> Iterator[Filling]:
        if k == 0:
            if total == 0:
                yield tuple(taken)
            return
        for s in sizes:
            if s <= last and s <= total and s * k >= total and reach[k - 1] >> (total - s) & 1 and taken.count(s) < counts[s]:
                yield from build(total - s, k - 1, s, [*taken, s])

    total = every.bit_length() - 1
    tries = 0
    while total > 0 and len(found) < most and tries < sums:
        if every >> total & 1:
            tries += 1
            for first, k in ((s, k) for s in sizes for k in range(1, len(reach)) if s <= total and reach[k - 1] >> (total - s) & 1):
                f = next(build(total - first, k - 1, first, [first]), None)
                if f and not any(_dominates(g, f) for g in found):
                    found.append(f)
                if len(found) >= most:
                    break
        total -= 1
    out = []
    for f in found:
        if sum(f) < gap:
            f = tuple(sorted((*f, *fullest(gap - sum(f), {s: n - f.count(s) for s, n in counts.items()})), reverse=True))
        out.append(f)
    if not found or sum(found[0]) < gap:
        out.append(fullest(gap, counts))
    return sorted(dict.fromkeys(out), key=sum, reverse=True)


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing over a histogram: bins with the same content are one entry [room -> {filling: bins}].

    An item goes to the smallest room that holds it, and the next of its length to the room that this leaves, as long as that holds one: so each bin
    taken gets as many as fit, or what is left of them.
    """
    rooms: dict[int, dict[Filling, int]] = {}

    def put(room: int, f: Filling, s: int, k: int, n: int) -> None:
        to = rooms.setdefault(room - k * s, {})
        to[(*f, *(s,) * k)] = to.get((*f, *(s,) * k), 0) + n

    for s in sorted(hist, reverse=True):
        left = hist[s]
        for room in sorted(r for r in rooms if r >= s):
            fs = rooms.pop(room)
            for f, bins in fs.items():
                k = room // s
                n = min(left // k, bins)
                if n:
                    put(room, f, s, k, n)
                    left -= n * k
                if n < bins and left:  # the last bin taken gets fewer
                    put(room, f, s, left, 1)
                    n, left = n + 1, 0
                if n < bins:
                    put(room, f, s, 0, bins - n)
            if not left:
                break
        k = capacity // s
        if left // k:
            put(capacity, (), s, k, left // k)
        if left % k:
            put(capacity, (), s, left % k, 1)
    return [(n, f) for fs in rooms.values() for f, n in fs.items()]


def _options(top: int, gap: int, counts: dict[int, int], first: list[Filling], full: bool) -> Iterator[tuple[Filling, int]]:
    """(filling around top, how often): the likely ones as often as the counts last; with ``full``, then these fewer times, then every other one, each time from often to once."""

    def most(f: Filling) -> int:
        return min(counts[s] // f.count(s) for s in set(f))

    whole = [(top, *f) for f in first]
    times = {f: most(f) for f in whole}
    yield from times.items()
    if not full:
        return
    for f, n in times.items():
        yield from ((f, k) for k in range(n - 1, 0, -1))
    counts = {**counts, top: counts[top] - 1}
    for f in every_filling(gap, counts):
        f = (top, *f)
        if f not in times:
            counts[top] += 1
            n = most(f)
            counts[top] -= 1
            yield from ((f, k) for k in range(n, 0, -1))


def complete_bins(hist: dict[int, int], capacity: int = 1024, nodes: int | None = 8_000, restarts: int = 10) -> list[tuple[int, Filling]]:
    """Bin completion: [(times, filling)] that uses every length of hist as often as it occurs.

    Depth first: around the largest remaining length, undominated fillings are applied. The
    best-fit completion comes first. Best-fit decreasing is the first incumbent; a branch whose waste so far leaves no chance
    of beating the incumbent is cut, and the search ends once the lower bound is met or ``nodes`` fillings have been applied. These are shared
    by ``restarts`` searches. Those before the last keep to the likely fillings, as often as the counts last, all but the first with now and then another one tried first (seeded:
    the plan is the same each time); the last goes through every undominated filling, and applies each as often as the counts last, then fewer times. With nodes of
    None there is only that one and no limit: the result is the fewest bins there can be.
    """
    hist = {s: n for s, n in hist.items() if n}
    total = sum(s * n for s, n in hist.items())
    bound = max(-(-total // capacity), sum(n for s, n in hist.items() if 2 * s > capacity))
    best = best_fit(hist, capacity)
    best_bins = sum(n for n, _ in best)
    if best_bins <= bound:
        return best

    def options(counts: dict[int, int], rng: random.Random | None, full: bool) -> Iterator[tuple[Filling, int]]:
        top = max(counts)
        counts[top] -= 1
        found = likely_fillings(capacity - top, counts)
        counts[top] += 1
        if rng and len(found) > 1 and rng.random() < 0.2:
            found.insert(0, found.pop(rng.randrange(1, len(found))))
        return _options(top, capacity - top, dict(counts), found, full)

    for restart in range(restarts if nodes is not None else 1):
        full = nodes is None or restart == restarts - 1
        rng = random.Random(restart) if restart and not full else None
        counts, path = dict(hist), []
        frames: list[list] = []  # [what to try, what is applied]
        waste = bins = visited = 0
        while best_bins > bound:
            # even without further waste, a branch needs ceil((total + waste) / capacity) bins
            if counts and -(-(total + waste) // capacity) < best_bins:
                frames.append([options(counts, rng, full), None])
            elif not counts and bins < best_bins:
                best, best_bins = list(path), bins
            step = None
            while frames and step is None:
                untried, applied = frames[-1]
                if applied:
                    times, f = applied
                    for s in f:
                        counts[s] = counts.get(s, 0) + times
                    waste -= times * (capacity - sum(f))
                    bins -= times
                    path.pop()
                    frames[-1][1] = None
                step = next(untried, None)
                if step is None:
                    frames.pop()
            visited += 1
            if step is None or (nodes is not None and visited > nodes // restarts):
                break
            f, times = step
            for s in f:
                counts[s] -= times
            for s in set(f):
                if not counts[s]:
                    del counts[s]
            waste += times * (capacity - sum(f))
            bins += times
            frames[-1][1] = (times, f)
            path.append((times, f))
    return best


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut where longer than the capacity; the
    first piece takes the remainder. Texts are read where they lie, without a shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridmason.llm.tokens import bunches, encoder

        enc = encoder(tokenizer)
        for doc_ids, texts in bunches(batches):
            ids, sizes = enc.ids(texts)
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4")
            sizes = sizes + 1
            count = -(-sizes // capacity)  # pieces of each document, in one run of places
            owner = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            first = (sizes - 1) % capacity + 1
            start = np.where(piece == 0, 0, first[owner] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[owner], capacity)
            at = (np.cumsum(sizes) - sizes)[owner] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, nodes: int = 4_000, bucket_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to ``pieces(docs)``.

    Pieces of a length are interchangeable; each gets a number among them (a window over hashed buckets of about
    ``bucket_rows``, plus what the buckets before hold: a length that a third of all pieces have is many groups). The plan, broadcast, has at
    most ``capacity`` fillings, since each uses up a length, of at most 45 different lengths each. Null text is empty text (one end id); repeated and null ids are documents like others; no rows give no rows.
    """
    spark = docs.sparkSession
    held = stash(pieces(docs, tokenizer, end_id, capacity), "pieces")
    hist = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, base = [], 0
    used = dict.fromkeys(hist, 0)
    for times, filling in complete_bins(hist, capacity, nodes):
        offset = 0
        for size in sorted(set(filling), reverse=True):
            k = filling.count(size)
            plan.append((size, used[size], used[size] + times * k, base, k, offset))
            used[size] += times * k
            offset += k * size
        base += times
    buckets = max(1, -(-sum(hist.values()) // bucket_rows))
    rows = held.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(within) - 1).join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    places = spark.createDataFrame(plan, "size long, lo long, hi long, base long, k int, at long")
    j = F.col("rank") - F.col("lo")
    return (
        numbered.join(F.broadcast(places), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(j / F.col("k"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(j, F.col("k").cast("long")) * F.col("length")).cast("long").alias("offset"))
    )
