"""Suffix-array deduplication: removes every byte of a ``length``-byte string that also starts earlier.

Only suffixes that can matter are sorted. In each window of ``length`` bytes the smallest GRAM-byte hash marks an anchor, so
that equal windows have equal anchors at equal places; windows with the same anchor form a record, a stretch of text around
it. (1) Records meet by their anchor's hash: of equal stretches all but the first are removed at once, and stretches whose
anchor no other has drop out. (2) What is left, different stretches around equal grams, is a sparse suffix array, sorted by
a merge sort that knows common prefixes: each task sorts the suffixes from its anchors, front-codes the run (common
prefix with the one before, then the rest) and sends it by the hash of its leading gram; a loser tree merges the runs and compares
two suffixes only beyond what they are known to share. (3) The merged common prefixes say which windows agree to the right
of an anchor, hashes of the bytes before it say which agree to the left; of those the first in (doc_id, start) stays.
(4) The removed stretches go back to the documents.

Records and texts travel as packed binary rows, one for each task and target. Positions are judged on the input, matches never
cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmason.llm.common import parts, release, stash
from gridmason.llm.rolling import gram_hashes, mix, sliding_min

GRAM = 24
ROW = "bucket int, kind int, blob binary"
RECORD = np.dtype([("gram", "<u8"), ("stretch", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("lo", "<i4"), ("wins", "u1"), ("off", "u1")])
CAND = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("lo", "<i4"), ("wins", "u1"), ("off", "u1"), ("hot", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<u8"), ("start", "<i4"), ("end", "<i4")])
WINDOW = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("tag", "<u8"), ("start", "<i4")])
#: Kinds of packed rows: records, spans on their way to a document, candidates, marks of hot grams, runs, windows, documents.
RECORDS, SPANS, CANDS, MARKS, RUNS, WINDOWS, DOCS = 1, 2, 3, 4, 5, 6, 9


def _tag(text: bytes) -> int:
    """Tells rows that repeat a doc_id apart."""
    return xxhash.xxh3_64_intdigest(text)


def _packed(a: np.ndarray) -> bytes:
    """Columns one after another: like bytes lie together for the compressor."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a[n]).tobytes() for n in a.dtype.names))


def _unpacked(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // dtype.itemsize
    out, at = np.zeros(n, dtype), 0
    for name in dtype.names:
        size = dtype[name].itemsize * n
        out[name] = np.frombuffer(raw, dtype[name], n, at)
        at += size
    return out


def _to_buckets(a: np.ndarray, bucket: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    a, bucket = a[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part, b in zip(np.split(a, cuts), bucket[np.r_[0, cuts]] if len(bucket) else (), strict=False):
        yield int(b), kind, _packed(part)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _of_doc(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _of_gram(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def records(texts: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """All records of some documents; those shorter than ``length`` have none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    use = np.flatnonzero(sizes >= length)
    if not len(use):
        return np.zeros(0, RECORD)
    units = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    sizes = sizes[use]
    ends = np.cumsum(sizes)
    grams = gram_hashes(units, GRAM)
    w = length - GRAM + 1
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    anchor = np.int64(0xFFFFFFFF) - (sliding_min(keys, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each window start
    inside = np.zeros(len(units) + 1, np.int8)
    inside[ends - sizes] = 1
    inside[ends - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[: len(anchor)], dtype=np.int8))  # windows that end in their document
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    lo, hi, at = start[first], start[last], anchor[first]
    out = np.zeros(len(first), RECORD)
    owner = np.searchsorted(ends, lo, "right")
    out["gram"], out["doc"], out["lo"] = grams[at], docs[use][owner], lo - (ends - sizes)[owner]
    out["tag"] = np.array([_tag(texts[i]) for i in use], np.uint64)[owner]
    out["wins"], out["off"] = hi - lo + 1, at - lo
    # a stretch lo .. hi + length is the windows at its ends, which cover it, and its shape
    whole = gram_hashes(units, length)
    out["stretch"] = mix(whole[lo] + np.uint64(3) * mix(whole[hi]) + out["wins"].astype(np.uint64) * np.uint64(256) + out["off"])
    return out


def lcp_merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of (strings, common prefix of each with the one before; 0 for the first) with a loser tree.
    Returns run, place in the run, and common prefix with the string before, in merged order.

    ``known[r]`` is what the head of run r shares with the last string that went out. Of two heads the one that shares more comes
    first; if both share as much, only the bytes after are compared, and the loser keeps what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    place, known = [0] * k, [0] * k
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        h = known[a]
        if h != known[b]:
            return (a, b) if h > known[b] else (b, a)
        n = min(len(x), len(y))
        step = 8
        while h < n and x[h : h + step] == y[h : h + step]:
            h += step
        h = min(h, n)
        while h < n and x[h] == y[h]:
            h += 1
        if (h == len(x)) if h == n else x[h] < y[h]:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    if not runs:
        return [], [], []
    winner = build(1) if k > 1 else 0
    out_run, out_at, out_lcp = [], [], []
    while heads[winner] is not None:
        r = winner
        strings, lcps = runs[r]
        at = place[r]
        out_run.append(r)
        out_at.append(at)
        out_lcp.append(known[r])
        at += 1
        place[r] = at
        if at < len(strings):
            heads[r], known[r] = strings[at], lcps[at]
        else:
            heads[r] = None
        node = (r + k) >> 1
        while node:
            other = tree[node]
            winner, loser = play(winner, other)
            tree[node] = loser
            node >>= 1
    return out_run, out_at, out_lcp


def _front_code(cands: np.ndarray, contexts: np.ndarray, right: np.ndarray, length: int) -> bytes:
    """A sorted run: contexts (rows: the bytes before the anchor from nearest to farthest, then from the anchor on, zero-padded) as common
    prefixes, rests and the bytes before."""
    keys = np.ascontiguousarray(contexts[:, length:])
    order = np.lexsort((right, keys.view(f"S{length}").reshape(-1)))
    cands, keys, left, right = cands[order], keys[order], contexts[order, :length], right[order]
    lcp = np.zeros(len(keys), np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), length)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(right[1:], right[:-1]))
    columns = np.arange(length)[None]
    rest = keys[(columns >= lcp[:, None]) & (columns < right[:, None])]
    before = left[columns < cands["off"].astype(np.int64)[:, None]]
    body = b"".join((lcp.tobytes(), right.astype(np.uint8).tobytes(), rest.tobytes(), before.tobytes()))
    pieces = [_packed(cands), zstandard.ZstdCompressor(level=1).compress(body)]
    return len(pieces[0]).to_bytes(4, "little") + b"".join(pieces)


def _decode_run(blob: bytes, length: int) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(candidates, suffixes, common prefixes, bytes before the anchor, nearest first, zero-padded)."""
    cut = 4 + int.from_bytes(blob[:4], "little")
    cands = _unpacked(blob[4:cut], CAND)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[cut:]), np.uint8)
    n = len(cands)
    lcp, right = body[:n].astype(np.int64), body[n : 2 * n].astype(np.int64)
    rest = right - lcp
    tails = body[2 * n : 2 * n + int(rest.sum())].tobytes()
    suffixes, at, last = [], 0, b""
    for share, more in zip(lcp.tolist(), rest.tolist(), strict=True):
        last = last[:share] + tails[at : at + more]
        at += more
        suffixes.append(last)
    left = np.zeros((n, length), np.uint8)
    left[np.arange(length)[None] < cands["off"].astype(np.int64)[:, None]] = body[2 * n + at :]
    return cands, suffixes, lcp, left


def resolve(runs: list[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """The stretches to remove among candidates that share a leading gram."""
    run, place, lcp = lcp_merge([(s, c.tolist()) for _, s, c, _ in runs])
    base = np.cumsum([0] + [len(r[0]) for r in runs])
    order = base[np.array(run, np.int64)] + np.array(place, np.int64)
    cands = np.concatenate([r[0] for r in runs])[order]
    left = np.concatenate([r[3] for r in runs])[order]
    lcp = np.array(lcp, np.int64)
    n = len(cands)
    at = cands["lo"].astype(np.int64) + cands["off"]
    rank = np.zeros(n, np.int64)
    by_place = np.lexsort((at, cands["doc"]))
    step = np.ones(n, np.int64)
    step[1:] = (np.diff(cands["doc"][by_place]) != 0) | (np.diff(at[by_place]) != 0)
    rank[by_place] = np.cumsum(step)  # equal for a repeated (doc_id, start)
    high = cands["off"].astype(np.int64)  # a window starts this far before the anchor at most, and low at least
    low = high - cands["wins"].astype(np.int64) + 1
    gone = np.zeros((n, length + 1), bool)
    hashed = np.zeros(n, np.uint64)
    for o in range(int(high.max()) + 1):
        if o:
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15 | 1) + left[:, o - 1].astype(np.uint64) + np.uint64(1)
        here = np.flatnonzero((low <= o) & (o <= high))
        if not len(here):
            continue
        same_right = np.cumsum(lcp < length - o)
        key = mix(mix(hashed[here]) + same_right[here].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        sort = np.lexsort((rank[here], key))
        k, r = key[sort], rank[here][sort]
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        first = r[np.flatnonzero(head)][np.cumsum(head) - 1]
        gone[here[sort], o] = r > first
    edge = np.diff(gone.astype(np.int8), axis=1, prepend=0)
    who, begin = np.nonzero(edge == 1)
    _, until = np.nonzero(edge == -1)
    out = np.zeros(len(who), SPAN)
    out["doc"], out["tag"], out["start"], out["end"] = cands["doc"][who], cands["tag"][who], at[who] - until + 1, at[who] - begin + length
    return out


def _spans(r: np.ndarray, length: int) -> np.ndarray:
    """The stretches that records or windows cover."""
    out = np.zeros(len(r), SPAN)
    out["doc"], out["tag"] = r["doc"], r["tag"]
    out["start"] = r["lo"] if "lo" in r.dtype.names else r["start"]
    out["end"] = out["start"] + (r["wins"].astype(np.int64) - 1 if "wins" in r.dtype.names else 0) + length
    return _merged(out)


def _firsts(r: np.ndarray, at: str, *names: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows alike in names: the first by (doc_id, place) of each kind (sorted by kind), and all that come later."""
    r = r[np.lexsort((r[at], r["doc"], *[r[n] for n in reversed(names)]))]
    head = np.ones(len(r), bool)
    head[1:] = np.any([r[n][1:] != r[n][:-1] for n in names], axis=0)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    return r[head], r[(r["doc"] != r["doc"][lead]) | (r[at] != r[at][lead])]


def _as_cands(r: np.ndarray, hot: np.ndarray) -> np.ndarray:
    out = np.zeros(len(r), CAND)
    for n in ("gram", "doc", "tag", "lo", "wins", "off"):
        out[n] = r[n]
    out["hot"] = hot
    return out


def windows(cands: np.ndarray, raw: np.ndarray, length: int) -> np.ndarray:
    """Every window of some candidates of one text, by two hashes."""
    one, half = gram_hashes(raw, length), gram_hashes(raw, length // 2)
    n = cands["wins"].astype(np.int64)
    start = np.repeat(cands["lo"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out = np.zeros(len(start), WINDOW)
    out["one"], out["two"] = one[start], mix(half[start] + np.uint64(3) * mix(half[start + length - length // 2]))
    out["doc"], out["tag"], out["start"] = np.repeat(cands["doc"], n), np.repeat(cands["tag"], n), start
    return out


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]], Iterator[bytes]]]:
    """Buckets in order: (bucket, {kind: blobs} of the other kinds, documents as they come)."""
    flat = ((b, k, x) for batch in batches for b, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(flat, None)
    while row is not None:
        bucket, small = row[0], {}
        while row is not None and row[0] == bucket and row[1] < DOCS:
            small.setdefault(row[1], []).append(row[2])
            row = next(flat, None)

        def large() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[0] == bucket and row[1] == DOCS:
                yield row[2]
                row = next(flat, None)

        yield bucket, small, large()
        for _ in large():
            pass
        release()


def _dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartitionById(parts(df.sparkSession), F.col("bucket")).sortWithinPartitions("bucket", "kind")


def dedup(docs: DataFrame, length: int = 100, text: str = "text", kept: str = "kept", hot_in_task: int = 1000, hot_in_all: int = 20_000) -> DataFrame:
    """docs (doc_id, text and any further columns) with ``kept`` binary (the remaining bytes), n_bytes, n_removed, n_spans and
    spans array<struct<start, end>> (maximal removed runs). Columns of docs with these names are replaced.

    Null text is empty text. Rows with a null doc_id are left out. Rows that repeat a doc_id are the same document as to order: of equal
    strings at equal starts neither is earlier. Texts shorter than ``length`` lose nothing. No rows give no rows. ``length``: 48 to 200.

    What repeats within a task is settled there, so that a text or passage in a third of all rows sends one record a task. A gram with more than
    ``hot_in_task`` different stretches in a task (a quarter of a million records), or ``hot_in_all`` altogether, takes another exact way: its windows, by
    128-bit hashes, the first of each kind in the task, are dealt out by window instead of by gram.
    """
    spark = docs.sparkSession
    docs = docs.drop(kept, "n_bytes", "n_removed", "n_spans", "spans").filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    buckets = max(1, parts(spark)) * 2
    columns = docs.columns

    def to_docs(spans: np.ndarray, kind: int = SPANS) -> Iterator[tuple[int, int, bytes]]:
        return _to_buckets(spans, _of_doc(spans["doc"], buckets), kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridmason.llm.tokens import blocks

        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            """What repeats within the task is settled here; a gram with very many different stretches goes on as a mark, its records by their documents."""
            heads, later = _firsts(np.concatenate(held), "lo", "gram", "stretch")
            gram, place, many = np.unique(heads["gram"], return_inverse=True, return_counts=True)
            hot = (many > hot_in_task)[place]
            rows = [*to_docs(_spans(later, length)), *to_docs(_as_cands(heads[hot], np.ones(int(hot.sum()))), CANDS)]
            marks = np.zeros(int((many > hot_in_task).sum()), [("gram", "<u8")])
            marks["gram"] = gram[many > hot_in_task]
            return _rows([*rows, *_to_buckets(marks, _of_gram(marks["gram"], buckets), MARKS), *_to_buckets(heads[~hot], _of_gram(heads["gram"][~hot], buckets), RECORDS)])

        held: list[np.ndarray] = []
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            held += [r for lo, hi in blocks(texts, 500_000) if len(r := records(texts[lo:hi], ids[lo:hi], length))]
            if sum(map(len, held)) > 250_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs, _ in _by_bucket(batches):
            rows = [(bucket, k, x) for k in (SPANS, CANDS) for x in blobs.get(k, [])]
            r = np.concatenate([_unpacked(x, RECORD) for x in blobs.get(RECORDS, [])] or [np.zeros(0, RECORD)])
            marks = np.unique(np.concatenate([_unpacked(x, np.dtype([("gram", "<u8")]))["gram"] for x in blobs.get(MARKS, [])] or [np.zeros(0, np.uint64)]))
            r = r[np.argsort(r["gram"], kind="stable")]
            marked = np.isin(r["gram"], marks)
            twin = marked.copy()
            same = r["gram"][1:] == r["gram"][:-1]
            twin[1:] |= same
            twin[:-1] |= same
            heads, later = _firsts(r[twin], "lo", "gram", "stretch")
            _, place, many = np.unique(heads["gram"], return_inverse=True, return_counts=True)
            hot = np.isin(heads["gram"], marks) | (many[place] > hot_in_all)
            use = hot | (many[place] > 1)
            rows += [*to_docs(_spans(later, length)), *to_docs(_as_cands(heads[use], hot[use]), CANDS)]
            if rows:
                yield _rows(rows)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by bucket, whole rows as compressed Arrow streams."""
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            bucket = _of_doc(table.column("doc_id").to_numpy(zero_copy_only=False), buckets)
            for k in np.unique(bucket).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=options) as w:
                    w.write_table(table.take(pa.array(np.flatnonzero(bucket == k))))
                yield _rows([(k, DOCS, sink.getvalue().to_pybytes())])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(h.nbytes for h in held) > 16_000_000:
                yield from packed(held)
                held = []
                release()
        if held:
            yield from packed(held)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates' suffixes, as one front-coded sorted run for each target; windows of hot grams, the first of each kind."""
        held: list[tuple] = []
        seen: list[np.ndarray] = []

        def runs() -> Iterator[pa.RecordBatch]:
            cands, contexts, right = (np.concatenate(x) for x in zip(*held, strict=True))
            target = _of_gram(cands["gram"], buckets)
            yield _rows([(t, RUNS, _front_code(cands[m], contexts[m], right[m], length)) for t in np.unique(target).tolist() for m in [target == t]])

        def firsts() -> Iterator[pa.RecordBatch]:
            heads, later = _firsts(np.concatenate(seen), "start", "one", "two")
            yield _rows([*to_docs(_spans(later, length)), *_to_buckets(heads, _of_gram(heads["one"], buckets), WINDOWS)])

        for _, blobs, large in _by_bucket(batches):
            cands = np.concatenate([_unpacked(x, CAND) for x in blobs.get(CANDS, [])] or [np.zeros(0, CAND)])
            cands = cands[np.argsort(cands["doc"], kind="stable")]
            for blob in large:
                table = pa.ipc.open_stream(blob).read_all().select(["doc_id", text])
                for doc, t in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                    mine = cands[np.searchsorted(cands["doc"], doc) : np.searchsorted(cands["doc"], doc, "right")]
                    if not len(mine):
                        continue
                    body = (t or "").encode("utf-8", "surrogatepass")
                    mine = mine[mine["tag"] == _tag(body)]
                    raw = np.frombuffer(body, np.uint8)
                    if (mine["hot"] == 1).any():
                        seen.append(windows(mine[mine["hot"] == 1], raw, length))
                        mine = mine[mine["hot"] == 0]
                    if not len(mine):
                        continue
                    at = mine["lo"].astype(np.int64) + mine["off"]
                    right = np.minimum(length, mine["lo"].astype(np.int64) + mine["wins"] - 1 + length - at)
                    padded = np.concatenate([np.zeros(length, np.uint8), raw, np.zeros(length, np.uint8)])
                    context = np.zeros((len(mine), 2 * length), np.uint8)
                    context[:, :length] = padded[(at + length)[:, None] - 1 - np.arange(length)[None]]
                    context[:, length:] = padded[(at + length)[:, None] + np.arange(length)[None]]
                    context[:, length:][np.arange(length)[None] >= right[:, None]] = 0
                    held.append((mine, context, right))
                if sum(len(h[0]) for h in held) > 50_000:
                    yield from runs()
                    held = []
                if sum(map(len, seen)) > 250_000:
                    yield from firsts()
                    seen = []
        if held:
            yield from runs()
        if seen:
            yield from firsts()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blobs, _ in _by_bucket(batches):
            rows = [(bucket, SPANS, x) for x in blobs.get(SPANS, [])]
            if RUNS in blobs:
                rows += to_docs(_merged(resolve([_decode_run(x, length) for x in blobs[RUNS]], length)))
            if WINDOWS in blobs:
                _, later = _firsts(np.concatenate([_unpacked(x, WINDOW) for x in blobs[WINDOWS]]), "start", "one", "two")
                rows += to_docs(_spans(later, length))
            if rows:
                yield _rows(rows)

    schema = T.StructType(list(docs.schema.fields))
    for part in ((kept, "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(*part)
    schema = schema.add("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs, large in _by_bucket(batches):
            spans = _merged(np.concatenate([_unpacked(x, SPAN) for x in blobs.get(SPANS, [])] or [np.zeros(0, SPAN)]))
            for blob in large:
                table = pa.ipc.open_stream(blob).read_all()
                new: list[list] = [[], [], [], [], []]
                for doc, t in zip(table.column("doc_id").to_pylist(), table.column(text).to_pylist(), strict=True):
                    raw = (t or "").encode("utf-8", "surrogatepass")
                    own = spans[np.searchsorted(spans["doc"], doc) : np.searchsorted(spans["doc"], doc, "right")]
                    own = own[own["tag"] == _tag(raw)] if len(own) else own
                    mine = list(zip(own["start"].tolist(), own["end"].tolist(), strict=True))
                    keep, at = [], 0
                    for s, e in mine:
                        keep.append(raw[at:s])
                        at = e
                    keep.append(raw[at:])
                    for col, v in zip(new, (b"".join(keep), len(raw), sum(e - s for s, e in mine), len(mine), [{"start": s, "end": e} for s, e in mine]), strict=True):
                        col.append(v)
                types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                table = table.select(columns)
                for name, col, kind in zip((kept, "n_bytes", "n_removed", "n_spans", "spans"), new, types, strict=True):
                    table = table.append_column(name, pa.array(col, kind))
                yield from table.to_batches()

    met = stash(_dealt(docs.select("doc_id", text).mapInArrow(find, ROW), buckets).mapInArrow(meet, ROW), "stretches")
    texts = docs.select("doc_id", text).mapInArrow(carry, ROW)
    runs = _dealt(texts.unionAll(met.filter(F.col("kind") == CANDS)), buckets).mapInArrow(collect, ROW)
    merged = stash(_dealt(runs, buckets).mapInArrow(merge, ROW), "suffix-spans")
    return _dealt(docs.mapInArrow(carry, ROW).unionAll(met.filter(F.col("kind") == SPANS)).unionAll(merged), buckets).mapInArrow(cut, schema)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans joined where they touch or overlap, by document and start."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"]))]
    doc, tag, start, end = spans["doc"], spans["tag"], spans["start"].astype(np.int64), spans["end"].astype(np.int64)
    change = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    lift = np.cumsum(change) << 32  # a running maximum within documents
    far = np.maximum.accumulate(end + lift) - lift
    head = change.copy()
    head[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(head)
    out = spans[at].copy()
    out["end"] = far[np.r_[at[1:], len(spans)] - 1]
    return out
