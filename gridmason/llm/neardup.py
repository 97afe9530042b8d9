"""MinHash near-duplicate detection by a multi-index Hamming join.

A document's five-word shingles become a signature of 64 b-bit MinHash symbols, which agree in a share of places near the
Jaccard similarity. Two signatures are close if they differ in at most ``radius`` places: 31 by default, half of them less one. The signature is split into
16 chunks of 4: by the pigeonhole principle a pair within 31 = 2 * 16 - 1 differences has a chunk with at most one, so enumerating one
allowed error per chunk (each symbol left out in turn) gives 64 keys of which every pair within the radius shares one for certain. A pair of
similarity 0.75 is farther apart with a probability of 1e-5. Links are confirmed on the full shingle sets.

Documents with equal sets are one class before any of this. Pairs within a bucket are never listed: each class is first held
against its buckets' smallest members only, and linked to the nearest if the full sets agree. Only components that this leaves apart are
looked at again: those with near members in a bucket make a cluster, and within it the full sets of different components are
compared block by block, which tells links as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmason.llm.common import by_ids, components, parts, shuffled, stash
from gridmason.llm.rolling import mix

WORDS, CHUNKS, WIDTH = 5, 16, 4
SYMBOLS = CHUNKS * WIDTH
_RNG = np.random.default_rng(20240229)
_PLACE = _RNG.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RNG.integers(1, 2**31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _RNG.integers(0, 2**32, SYMBOLS, np.uint32)


class Shingler:
    """shingles(texts) -> (hash of each different shingle, text by text; how many each text has)."""

    def __init__(self, remember: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.remember = remember

    def shingles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        if len(self.known) > self.remember:
            self.known.clear()
        words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z, and ASCII white space
        n = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        h = np.fromiter(map(self.known.get, flat, repeat(0)), np.uint64, len(flat))
        new = np.flatnonzero(h == 0).tolist()
        if new:
            self.known.update((w, xxhash.xxh64_intdigest(w) | 1) for w in {flat[i] for i in new})
            h[new] = np.fromiter(map(self.known.__getitem__, (flat[i] for i in new)), np.uint64, len(new))
        owner = np.repeat(np.arange(len(words)), n)
        last = np.cumsum(n)
        s = np.zeros(len(h), np.uint64)
        left = last[owner] - np.arange(len(h))  # words from here to the text's end
        for j in range(WORDS):
            part = np.zeros(len(h), np.uint64)
            part[: max(0, len(h) - j)] = h[j:] * _PLACE[j]
            s += np.where(left > j, part, np.uint64(0))
        short = n[owner] < WORDS
        whole = np.where(short, left == n[owner], left >= WORDS)
        s = mix(s + np.where(short, n[owner], WORDS).astype(np.uint64))[whole]
        owner = owner[whole]
        order = np.lexsort((s, owner))
        s, owner = s[order], owner[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
        s, owner = s[first], owner[first]
        return s, np.bincount(owner, minlength=len(words)).astype(np.int64)


def signatures(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """16-bit symbols (texts x SYMBOLS) and a 128-bit name of each set. Empty sets: zeros, and an empty name."""
    out = np.zeros((len(n), SYMBOLS), np.uint16)
    has = np.flatnonzero(n)
    names = [b""] * len(n)
    if len(has):
        starts = (np.cumsum(n) - n)[has]
        x = (s >> np.uint64(32)).astype(np.uint32)
        for i in range(SYMBOLS):
            low = np.minimum.reduceat((x ^ _FLIP[i]) * _TIMES[i], starts)
            out[has, i] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
        one, two = np.add.reduceat(mix(s), starts), np.add.reduceat(mix(s ^ np.uint64(0x5DEECE66D)), starts)
        both = np.column_stack([one, two]).astype("<u8")
        for k, i in enumerate(has.tolist()):
            names[i] = both[k].tobytes()
    return out, names


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    from gridmason.llm.tokens import blocks

    return blocks(texts, 700_000)


def describe(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, name (of the set), sig. Whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                s, n = shingler.shingles(texts[lo:hi])
                sig, names = signatures(s, n)
                flat = pa.array(sig.astype(np.int16).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SYMBOLS, dtype=np.int32)), flat)],
                    names=["doc_id", "n_shingles", "name", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(run, "doc_id long, n_shingles long, name binary, sig array<smallint>")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, cid): for each chunk, its symbols with each one left out in turn."""
    keys = []
    for c in range(CHUNKS):
        for left_out in range(WIDTH):
            at = [c * WIDTH + i for i in range(WIDTH) if i != left_out]
            keys.append(F.xxhash64(F.lit(c * WIDTH + left_out), *[F.col("sig")[i] for i in at]))
    return classes.select("cid", F.explode(F.array(*keys)).alias("key"))


def _similar_size(a: str, b: str, num: int, den: int) -> str:
    return f"{den} * least({a}, {b}) >= {num} * greatest({a}, {b})"


def _texts_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(name, blob): one compressed text for each of the classes (rep, name)."""
    asked = by_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), classes.select(F.col("rep").alias("doc_id")), "doc_id")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, zipper = Shingler(), zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _blocks(texts):
                _, names = signatures(*shingler.shingles(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([zipper.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts[lo:hi]], pa.binary())], names=["name", "blob"])

    return stash(asked.mapInArrow(squeeze, "name binary, blob binary").groupBy("name").agg(F.min("blob").alias("blob")), "asked-texts")


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of class ids whose full shingle sets reach num / den. Texts travel compressed, only those of the classes asked for."""
    named = classes.select("cid", "rep", "name")
    both = stash(shuffled(shuffled(pairs, named.toDF("a", "rep_a", "name_a"), "a"), named.toDF("b", "rep_b", "name_b"), "b"), "pairs")
    texts = _texts_of(both.select(F.col("rep_a").alias("rep")).unionAll(both.select("rep_b")), docs)
    rows = shuffled(both.select("a", "b", "name_a", "name_b"), texts.toDF("name_a", "blob_a"), "name_a")
    rows = shuffled(rows, texts.toDF("name_b", "blob_b"), "name_b").select("a", "b", "blob_a", "blob_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, unzip = Shingler(), zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, b.num_rows, 300):
                part = b.slice(lo, 300)
                raw = part.column(2).to_pylist() + part.column(3).to_pylist()
                s, n = shingler.shingles([unzip.decompress(x).decode("utf-8", "surrogatepass") for x in raw])
                ends = np.cumsum(n)
                half = part.num_rows
                keep = []
                for i in range(half):
                    x, y = s[ends[i] - n[i] : ends[i]], s[ends[half + i] - n[half + i] : ends[half + i]]
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(den * common >= num * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stash(rows.mapInArrow(compare, "a long, b long"), "links")


class _Forest:
    """Union-find over any ids, looked up many at a time."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.parent = np.zeros(0, np.int64)

    def places(self, ids: np.ndarray) -> np.ndarray:
        for i in np.unique(ids).tolist():
            self.place.setdefault(i, len(self.place))
        grown = np.arange(len(self.place))
        grown[: len(self.parent)] = self.parent
        self.parent = grown
        return np.fromiter(map(self.place.__getitem__, ids.tolist()), np.int64, len(ids))

    def roots(self, places: np.ndarray) -> np.ndarray:
        r = self.parent[places]
        while True:
            up = self.parent[r]
            if (up == r).all():
                return r
            r = up

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        p = self.parent
        while p[a] != a:
            p[a] = a = p[p[a]]
        while p[b] != b:
            p[b] = b = p[p[b]]
        if a != b:
            p[max(a, b)] = min(a, b)
        return a != b


def _bucket_ties(rows: DataFrame, radius: int, num: int, den: int) -> DataFrame:
    """rows(key, i, j, cid, comp, block, n, sig), all of a (key, i, j) in one partition and in a row -> (a, b): components some of whose members
    in blocks i and j are near in signature and size. Only what a task's earlier ties don't connect is compared and told, so that
    a task tells less than one tie a component, however many pairs its buckets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def near(c: dict, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            ok = c["comp"][x] != c["comp"][y]
            ok &= den * np.minimum(c["n"][x], c["n"][y]) >= num * np.maximum(c["n"][x], c["n"][y])
            ok &= (c["i"][x] == c["j"][x]) | (c["block"][x] != c["block"][y])
            x, y = x[ok], y[ok]
            for k in range(0, len(x), 20_000):
                p, q = x[k : k + 20_000], y[k : k + 20_000]
                apart = forest.roots(c["place"][p]) != forest.roots(c["place"][q])
                p, q = p[apart], q[apart]
                ok = (c["sig"][p] != c["sig"][q]).sum(1) <= radius
                told = [(a, b) for a, b, u, v in zip(c["comp"][p][ok].tolist(), c["comp"][q][ok].tolist(), c["place"][p][ok].tolist(), c["place"][q][ok].tolist(), strict=True) if forest.join(u, v)]
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64())], names=["a", "b"])

        def bunch(c: dict) -> Iterator[pa.RecordBatch]:
            c["place"] = forest.places(c["comp"])
            group = np.cumsum(np.r_[False, (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])])
            size = np.bincount(group)
            at = np.arange(len(group))
            for lag in range(1, min(int(size.max()), 33)):
                x = at[:-lag][group[lag:] == group[:-lag]]
                yield from near(c, x, x + lag)
            for g in np.flatnonzero(size > 33).tolist():  # larger ones: the lags beyond, member by member
                lo = int(np.searchsorted(group, g))
                hi = lo + int(size[g])
                for x in range(lo, hi - 33):
                    yield from near(c, np.full(hi - x - 33, x), np.arange(x + 33, hi))

        held = []
        for b in batches:
            cols = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "i", "j", "cid", "comp", "block", "n")}
            cols["sig"] = b.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(-1, SYMBOLS)
            held.append(cols)
            if sum(len(c["cid"]) for c in held) > 40_000:
                c = {k: np.concatenate([h[k] for h in held]) for k in cols}
                same = (c["key"] == c["key"][-1]) & (c["i"] == c["i"][-1]) & (c["j"] == c["j"][-1])
                cut = int(np.argmax(same))
                if cut:
                    yield from bunch({k: v[:cut] for k, v in c.items()})
                held = [{k: v[cut:] for k, v in c.items()}]
        if held and sum(len(c["cid"]) for c in held):
            yield from bunch({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    return rows.mapInArrow(run, "a long, b long")


def _links_in_clusters(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows(cluster, i, j, block, cid, comp, blob), all of a (cluster, i, j) in one partition and in a row -> links (a, b) between components,
    confirmed on the full sets, of which a task tells as many as connect what they connect. Common shingles are counted through an
    inverted list of block j, one member of block i at a time; a task holds two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, unzip, forest = Shingler(), zstandard.ZstdDecompressor(), _Forest()

        def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
            i, j = group[0][1], group[0][2]
            s, n = shingler.shingles([unzip.decompress(r[6]).decode("utf-8", "surrogatepass") for r in group])
            start = np.cumsum(n) - n
            cid, comp, block = (np.array([r[k] for r in group], np.int64) for k in (4, 5, 3))
            place = forest.places(comp)
            _, term = np.unique(s, return_inverse=True)
            owner = np.repeat(np.arange(len(group)), n)
            held = block[owner] == j  # the inverted list
            order = np.argsort(term[held], kind="stable")
            post = owner[held][order]
            first = np.searchsorted(term[held][order], np.arange(int(term.max(initial=-1)) + 2))
            for x in np.flatnonzero(block == i).tolist():
                mine = term[start[x] : start[x] + n[x]]
                lo, many = first[mine], first[mine + 1] - first[mine]
                at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                common = np.bincount(post[at], minlength=len(group))
                hit = np.flatnonzero((den * common >= num * (n[x] + n - common)) & (comp != comp[x]) & (block == j))
                for y in hit[forest.roots(place[hit]) != forest.roots(place[[x]])].tolist():
                    if forest.join(int(place[x]), int(place[y])):
                        yield int(cid[x]), int(cid[y])

        def told(group: list[tuple]) -> Iterator[pa.RecordBatch]:
            found = list(links(group))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

        group: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield from told(group)
                    group = []
                group.append(row)
        if group:
            yield from told(group)

    return rows.mapInArrow(run, "a long, b long")


def _in_blocks(rows: DataFrame, key: str, block_rows: int) -> DataFrame:
    """rows with block, i and j: groups by key of more than block_rows rows are dealt into blocks, each row once for every other block, so that
    any two rows of a group meet under one (key, i, j) and none holds more than two blocks. Only sizes of larger groups are joined, by broadcast: at most
    one for block_rows rows, and a large group's rows stay dealt as they are."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(sizes.filter("blocks > 1")), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


#: Differences within which a pair shares a key for certain.
RADIUS = 2 * CHUNKS - 1
#: A component's classes find their smallest doc_id by so many keys: one component may hold a third of all classes.
SALTS = 16


def link(docs: DataFrame, num: int = 75, den: int = 100, radius: int = RADIUS, block_rows: int = 4096) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, kept: documents whose shingle sets reach a Jaccard
    similarity of num / den are linked; component_id is the smallest doc_id of what links reach.

    Null, empty and wordless texts have an empty set and are linked with nothing. Fewer than five words are one shingle. Rows with a null doc_id
    are left out; rows that repeat an id are documents of their own. Equal sets are linked whatever their number. No rows give no rows.
    """
    if radius > RADIUS:
        raise ValueError(f"a pair more than {RADIUS} places apart may share no key")
    spark = docs.sparkSession
    told = stash(describe(docs), "shingled")
    classes = told.filter("n_shingles > 0").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stash(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = _keys(classes)
    shared = keys.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).filter("lead < last").select("key", "lead")
    members = stash(shuffled(keys, shared, "key").select("key", "cid", "lead"), "buckets")

    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    star = members.filter("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct()
    star = shuffled(shuffled(star, side("a"), "a"), side("b"), "b").filter(_similar_size("n_a", "n_b", num, den))
    star = star.withColumn("far", F.expr("size(filter(zip_with(sig_a, sig_b, (x, y) -> x <> y), d -> d))")).filter(F.col("far") <= radius)
    star = stash(star.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "star")
    links = confirm(star, docs, classes, num, den)

    found = components(links, "classes-linked")
    placed = shuffled(members, found.toDF("cid", "comp"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    placed = stash(shuffled(placed, open_keys, "key"), "open-buckets")
    rows = _in_blocks(shuffled(placed, classes.select("cid", "n", "sig"), "cid"), "key", block_rows).select("key", "i", "j", "cid", "comp", "block", "n", "sig")
    rows = rows.repartition(parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")
    clusters = components(_bucket_ties(rows, radius, num, den), "clusters").toDF("comp", "cluster")
    asked = shuffled(shuffled(placed.select("cid", "comp").distinct(), clusters, "comp"), classes.select("cid", "rep", "name"), "cid")
    asked = stash(asked, "clustered")
    if not asked.isEmpty():
        rows = _in_blocks(shuffled(asked.select("cluster", "cid", "comp", "name"), _texts_of(asked, docs), "name"), "cluster", block_rows // 4)
        rows = rows.select("cluster", "i", "j", "block", "cid", "comp", "blob").repartition(parts(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block")
        links = links.unionAll(stash(_links_in_clusters(rows, num, den), "more-links"))
        found = components(links, "classes-linked")
    of_class = shuffled(classes.select("cid", "name", "rep"), found.toDF("cid", "comp"), "cid", "left").withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    lowest = of_class.filter("comp is not null").groupBy("comp").agg(F.min("rep").alias("component_id"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    linked = shuffled(of_class.filter("comp is not null"), lowest, ["comp", "salt"]).select("name", "component_id")
    labels = linked.unionAll(of_class.filter("comp is null").select("name", F.col("rep").alias("component_id")))
    out = shuffled(told.select("doc_id", "n_shingles", "name"), labels, "name", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
