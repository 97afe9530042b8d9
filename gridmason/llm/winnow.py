"""Document fingerprints by winnowing.

Every window of ``window`` successive k-gram hashes gives its smallest, of equals the rightmost; the positions are kept. Two texts
that share a run of at least window + k - 1 code points share a fingerprint hash from inside it, at positions that tell where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmason.llm.common import parts, release, small_batches
from gridmason.llm.rolling import gram_hashes, minima, mix

K, WINDOW = 16, 32


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a whole text. A text shorter than k is one gram; the empty text has none."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(units) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = gram_hashes(units, min(k, len(units)))
    if len(units) < k:
        hashes = mix(hashes + np.uint64(len(units)))
    at = minima(hashes, window)
    return (hashes[at] >> np.uint64(32)).astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hash sets; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def to_text(hashes: np.ndarray) -> str:
    """Eight hex digits a hash, in text order."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, hashes array<long>, positions array<long>; null text is empty. No shuffle."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [fingerprint(t, k, window) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "hashes": pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), "positions": pa.array([p for _, p in found], pa.list_(pa.int64()))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame, run, schema: str, buckets_per_part: int = 3) -> DataFrame:
    """Calls run(iterator of (doc_id, text, next text)) in descending order of doc_id, where the next of the last is the first; for the
    only document it is itself. Rows with a null doc_id are left out; equal ids follow each other by text.

    Ranges of ids (bounds: approximate percentiles, a few longs per task) are dealt out by hash, so that one shuffle of
    the texts is enough; the first document of each range is also sent to the range before.
    """
    small_batches(docs.sparkSession)
    n = max(1, parts(docs.sparkSession)) * buckets_per_part
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c < F.col("doc_id")))
    heads = {r["b"]: r["m"] for r in rows.select("doc_id").groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("m")).collect()}
    order = sorted(heads, reverse=True)
    tails = [(heads[nxt], b) for b, nxt in zip(order, [*order[1:], *order[:1]], strict=True)]  # id of the next range's first -> this range
    to = F.create_map(*[F.lit(x) for pair in tails for x in pair]) if tails else None
    own = F.struct(bucket.alias("bucket"), F.lit(0).alias("tail"))
    dealt = rows.withColumn("to", F.array(own) if to is None else F.array_compact(F.array(own, F.when(to[F.col("doc_id")].isNotNull(), F.struct(to[F.col("doc_id")].alias("bucket"), F.lit(1).alias("tail"))))))
    dealt = dealt.select("doc_id", "text", F.explode("to").alias("to")).select("to.bucket", "to.tail", "doc_id", "text")
    dealt = dealt.repartition(parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "tail", F.desc("doc_id"), "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[int, str, str]]:
            held = None
            for b in batches:
                for bucket, tail, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held is not None and held[0] == bucket:
                        yield held[1], held[2], text
                    held = None if tail else (bucket, doc, text)

        yield from run(pairs())

    return dealt.mapInArrow(walk, schema)


def compare_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint against that of its edited text (its last half replaced from the next document's start)
    and of the next document; see ``with_next`` for the order, nulls and repeated ids."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split(" ")[0] for c in schema.split(", ")]  # positions: where each hash of the fingerprint starts, in code points

    def run(pairs: Iterator[tuple[int, str, str]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        places: list[np.ndarray] = []
        held = 0
        last = ("", fingerprint("", k, window))

        def batch() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, places)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places).astype(np.int32)))
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], lists], names=names)

        for doc, text, after in pairs:
            own, at = last[1] if last[0] == text else fingerprint(text, k, window)
            last = (after, fingerprint(after, k, window))
            following = last[1][0]
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            changed = fingerprint(edited, k, window)[0]
            rows.append((doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(changed), likeness(own, changed), likeness(own, following)))
            places.append(at)
            held += len(own) + len(changed)
            if len(rows) >= 1000 or held >= 200_000:
                yield batch()
                rows, places, held = [], [], 0
        if rows:
            yield batch()
        release()

    return with_next(docs, run, schema)
