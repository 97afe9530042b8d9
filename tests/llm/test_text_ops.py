import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmason.llm import common, langid, mixing, neardup, packing, rolling, suffixdedup, tokenfile, tokens, toxicity, winnow
from gridmason.llm.common import components, crc_mod
from tests.llm.util import corpus, frame, words

P = pytest.importorskip("public_tokenizers")


def ids_of(name, text, end=2):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids, end]


# ------------------------------------------------------------ tokens, files, packing


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_exact(name):
    import random

    from tokenizers import Tokenizer

    r = random.Random(3)
    alphabet = "ab éÉÇñ \n\t .,'’\"!?-_<|endoftext|>Σσ İıß²½Ⅷ́\xa0  12 don't it's 漢字 <|ENDOFTEXT|> J̌ ſ K Å %%% :) |"
    texts = [t or "" for _, t in corpus()] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    enc, whole, at = tokens.Encoder(P.path(name)), Tokenizer.from_file(P.path(name)), 0
    for lo, hi in tokens.blocks(texts, 5000):
        ids, sizes = enc.ids(texts[lo:hi])
        at = 0
        for t, n in zip(texts[lo:hi], sizes, strict=True):
            assert ids[at : at + n].tolist() == whole.encode(t, add_special_tokens=False).ids, t
            at += n


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_file_round_trip(mode):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 2 ** int(r.integers(1, 32)), int(n), dtype=np.uint32) for n in [0, 1, 700, 0, 3000, 5]]
    f = io.BytesIO()
    w = tokenfile.Writer(f, chunk_ids=512, mode=mode)
    for i, d in enumerate(docs):
        w.add(np.array([i]), np.array([len(d)]), d)
    w.close()
    got = tokenfile.Reader(f)
    assert all(i == k and np.array_equal(x, d) for (i, x), (k, d) in zip(got.documents(), enumerate(docs), strict=True))
    every = np.concatenate(docs)
    assert np.array_equal(got.ids(500, 1000), every[500:1500]) and len(got.ids(0, 0)) == 0
    broken = bytearray(f.getvalue())
    broken[got.foot["chunks"][0]["at"] + 6] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        tokenfile.Reader(io.BytesIO(bytes(broken))).chunk(0)


def test_token_files(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    got = tokenfile.read_tokens(spark, tokenfile.write_tokens(frame(spark), P.path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in rows)
    at, want = 0, Counter()
    for i, t in rows:
        ids = ids_of("word_bpe_49k.json", t)
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    with_ids = tokenfile.read_tokens(spark, tokenfile.write_tokens(frame(spark, [(1, "a b")]), P.path("word_bpe_49k.json")), with_ids=True).first()
    assert with_ids["ids"] == ids_of("word_bpe_49k.json", "a b")
    assert tokenfile.read_tokens(spark, tokenfile.write_tokens(frame(spark, []), P.path("word_bpe_49k.json"))).count() == 0


def test_packing(spark):
    got = packing.pack(frame(spark), P.path("byte_bpe_50k.json"), capacity=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    n_rows = Counter(i for i, _ in corpus())
    for i, t in dict(corpus()).items():
        ids = ids_of("byte_bpe_50k.json", t)
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i])
        assert len(pieces) == n_rows[i] * -(-len(ids) // 256)
        for p, start, length, crc in pieces:
            assert length <= 256 and (length == 256 or p == 0) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 256
    assert packing.pack(frame(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def exact_bins(sizes, capacity):
    """Fewest bins, by trying everything."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                left = list(rooms)
                left.remove(r)
                go(i + 1, [*left, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_bin_completion_is_near_exact():
    import random

    off = 0
    for seed in range(40):
        r = random.Random(seed)
        sizes = [r.randint(1, 60) for _ in range(9)]
        plan = packing.complete_bins(Counter(sizes), 100)
        used = Counter()
        for times, f in plan:
            assert sum(f) <= 100
            for s in f:
                used[s] += times
        assert used == Counter(sizes)
        off += sum(t for t, _ in plan) - exact_bins(sizes, 100)
    assert off <= 2
    assert packing.complete_bins({}, 100) == []
    big = Counter(random.Random(5).randint(1, 1023) for _ in range(20_000))
    assert sum(t for t, _ in packing.complete_bins(big)) <= sum(t for t, _ in packing.best_fit(big, 1024))


def test_bin_completion_without_a_limit_is_exact():
    import random

    for seed in range(60):
        r = random.Random(seed)
        sizes = [r.choice([r.randint(1, 60), r.randint(5, 30), 17]) for _ in range(9)]
        plan = packing.complete_bins(Counter(sizes), 100, nodes=None)
        assert sum(t for t, _ in plan) == exact_bins(sizes, 100)


def test_every_undominated_filling_is_found():
    import itertools
    import random

    for seed in range(20):
        r = random.Random(seed)
        items = [r.randint(1, 20) for _ in range(8)]
        got = list(packing.every_filling(40, Counter(items)))
        sets = {tuple(sorted(c, reverse=True)) for k in range(9) for c in itertools.combinations(items, k) if sum(c) <= 40}
        assert set(got) <= sets and [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
        assert all(any(packing._dominates(g, f) for g in got) for f in sets)


def test_packing_is_no_worse_than_best_fit_decreasing():
    import bisect
    import random

    def plain(hist, capacity):
        rooms = []
        for s in sorted(hist, reverse=True):
            for _ in range(hist[s]):
                i = bisect.bisect_left(rooms, s)
                bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - s)
        return len(rooms)

    hists = [({824: 10, 30: 60}, 1024)]
    for seed in range(60):
        r = random.Random(seed)
        hist = Counter(r.choice([r.randint(1, 200), r.randint(1, 20)]) for _ in range(r.randint(1, 200)))
        hist[r.randint(1, 15)] += r.randint(50, 400)  # a hot short length
        hists.append((hist, 200))
    for hist, capacity in hists:
        for plan in (packing.best_fit(hist, capacity), packing.complete_bins(hist, capacity, nodes=200)):
            used = Counter()
            for times, f in plan:
                assert sum(f) <= capacity
                used.update({s: times * f.count(s) for s in set(f)})
            assert used == Counter(hist) and sum(t for t, _ in plan) <= plain(hist, capacity)


def test_fillings_take_as_many_items_as_fit():
    assert packing.likely_fillings(200, {30: 60})[0] == (30,) * 6
    assert sum(packing.likely_fillings(200, {33: 60, 17: 60})[0]) == 200
    assert packing.fullest(100, {30: 2, 7: 3}) == (30, 30, 7, 7, 7) and packing.fullest(5, {6: 1}) == ()


def test_fillings_are_undominated():
    found = packing.likely_fillings(10, {7: 1, 3: 2, 6: 1, 4: 1, 1: 5})
    assert found[0] in ((7, 3), (6, 4)) and all(sum(f) <= 10 for f in found)
    assert packing._dominates((5, 5), (3, 2, 4)) and not packing._dominates((5, 4), (3, 3, 3))


# ------------------------------------------------------------ near-duplicates


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    parent[root(a)] = root(b)
    low = {}
    for a, (i, _) in enumerate(rows):
        low[root(a)] = min(low.get(root(a), i), i)
    return Counter((i, len(sets[a]), low[root(a)], i == low[root(a)]) for a, (i, _) in enumerate(rows))


def family(n, edits, seed=4):
    """Near copies of one text, at every similarity around the threshold."""
    import random

    r = random.Random(seed)
    base = words(seed, 120).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append((10_000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("rows", [corpus(), family(150, 9), [], [(1, None), (2, "")]], ids=["corpus", "family", "empty", "no words"])
def test_near_duplicates(spark, rows):
    rows = [(i, t) for i, t in rows]
    got = neardup.link(frame(spark, rows), block_rows=40).collect()
    assert Counter(tuple(r) for r in got) == groups([(i, t) for i, t in rows if i is not None])


def test_near_duplicates_broadcasts_no_table_of_documents(spark, monkeypatch):
    """Whatever size Spark takes a table for: here all are small. Only the masks of the texts to compare and the sizes of groups over a block are broadcast."""
    plans, stash = {}, neardup.stash
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(neardup, "stash", lambda df, label: plans.setdefault(label, told(df)) and stash(df, label))
    plans["result"] = told(neardup.link(frame(spark, family(150, 9)), block_rows=40))
    assert {"buckets", "star", "pairs", "links", "open-buckets", "clustered", "more-links"} <= set(plans)
    assert not [k for k, p in plans.items() if "Broadcast" in p and k not in ("asked-texts", "more-links")]
    ids = spark.range(3).select(F.col("id").alias("doc_id"))
    monkeypatch.setattr(common, "BROADCAST_MASKS", 0)
    assert "Broadcast" not in told(common.by_ids(frame(spark), ids, "doc_id"))


def test_pairs_within_the_radius_share_a_key(spark):
    """Differences spread over the chunks as evenly as can be, and at random: 31 of 64 always leave a key, and more can leave none."""
    import random

    r = random.Random(1)
    base = [r.randrange(-(2**15), 2**15) for _ in range(neardup.SYMBOLS)]

    def changed(places):
        return [x ^ 1 if i in places else x for i, x in enumerate(base)]

    two_each = [c * neardup.WIDTH + k for c in range(neardup.CHUNKS) for k in (0, 1)]
    cases = [set(two_each[:31]), *[set(r.sample(range(neardup.SYMBOLS), 31)) for _ in range(200)], set(two_each)]
    rows = [(0, base), *[(i + 1, changed(p)) for i, p in enumerate(cases)]]
    keys = {}
    for x in neardup._keys(spark.createDataFrame(rows, "cid long, sig array<smallint>")).collect():
        keys.setdefault(x["cid"], set()).add(x["key"])
    shared = [bool(keys[0] & keys[i + 1]) for i in range(len(cases))]
    assert all(shared[:-1]) and not shared[-1]
    with pytest.raises(ValueError, match="share no key"):
        neardup.link(frame(spark), radius=32)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.75 to 0.80, the farthest that count: all are found."""
    import random

    r = random.Random(8)
    rows, linked = [], {}
    for i in range(300):
        w = words(70_000 + i, 200).split()
        v = list(w)
        while True:  # one edited word costs five shingles of either text
            v[r.randrange(len(v))] = f"z{r.randrange(10**9)}"
            a, b = ({" ".join(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))
            if len(a & b) / len(a | b) < 0.78:
                break
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        linked[i] = 100 * len(a & b) >= 75 * len(a | b)
    got = {x["doc_id"]: x["component_id"] for x in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(linked.values()) > 200 and all((got[2 * i + 1] == 2 * i) == want for i, want in linked.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 499)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in got.collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_components_at_once_and_in_rounds(spark, at_once):
    """Both ways tell the same of random edges, of long paths and of a hub with the largest id."""
    import random

    r = random.Random(4)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1200)] + [(5000 + i * 7 % 101, 5000 + (i + 1) * 7 % 101) for i in range(100)] + [(9999, i) for i in range(6000, 6050)]
    edges += [(-5, 2**62), (7, 7), (None, 3)]
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(len(low)):
        if all(low[a] == low[b] for a, b in edges if a in low and a != b):
            break
        for a, b in edges:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = components(spark.createDataFrame(edges, "a long, b long"), at_once=at_once).collect()
    assert len(got) == len(low) and {x["node"]: x["component"] for x in got} == low


def test_few_links_take_few_shuffles(spark):
    """A chain of links is settled in one job's shuffle: rounds of plans fill the driver, whatever little they hold."""
    jobs = spark.sparkContext.statusTracker()
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    try:
        assert components(edges).select("component").distinct().count() == 1
        assert len(jobs.getJobIdsForGroup("few")) <= 12
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# ------------------------------------------------------------ suffix dedup


def removed(rows, length):
    seen, out = {}, Counter()
    rows = sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda r: r[0])
    for i, b in rows:
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            seen[k] = min(seen.get(k, (i, s)), (i, s))
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [48, 100])
def test_suffix_dedup(spark, length):
    rows = corpus() + [(6000 + k, words(50 + k, 20) + " " + words(77, 45) + " " + words(60 + k, 20)) for k in range(30)] + [(6100, "ab" * 400), (6101, "a" * 99), (6102, "a" * 350), (6103, "x" + "a" * 300)]
    found = suffixdedup.dedup(frame(spark, rows), length=length)
    assert {"lang", "source", "score", "name", "spans"} <= set(found.columns)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found.collect())
    assert got == removed(rows, length)


def test_suffix_dedup_empty(spark):
    assert suffixdedup.dedup(frame(spark, [])).count() == 0
    assert [tuple(r) for r in suffixdedup.dedup(frame(spark, [(1, None)])).select("n_bytes", "n_removed", "n_spans").collect()] == [(0, 0, 0)]


def test_merge_with_known_prefixes():
    import os
    import random

    r = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            s = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 40)))
            runs.append((s, [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(s, s[1:], strict=False))][: len(s)]))
        run, at, lcp = suffixdedup.lcp_merge(runs)
        out = [runs[i][0][j] for i, j in zip(run, at, strict=True)]
        assert out == sorted(x for s, _ in runs for x in s)
        assert lcp == [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(out, out[1:], strict=False))][: len(out)]
    assert suffixdedup.lcp_merge([]) == ([], [], [])


# ------------------------------------------------------------ winnowing


def test_winnow_matches_brute_force():
    for seed in range(5):
        text = words(seed, 200, "ab")
        h = rolling.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), 24)
        assert len({text[i : i + 24] for i in range(len(h))}) == len(set(h.tolist()))
        top = (h >> np.uint64(32)).tolist()
        want = sorted({max(j for j in range(i, i + 64) if top[j] == min(top[i : i + 64])) for i in range(max(1, len(top) - 63))})
        hashes, at = winnow.fingerprint(text, 24, 64)
        assert at.tolist() == want and hashes.tolist() == [top[i] for i in want]
    assert [len(winnow.fingerprint(t)[0]) for t in ("", "a", "x" * 30)] == [0, 1, 1]
    a, b = words(1, 100), words(2, 100)
    shared = words(3, 40)[: winnow.K + winnow.WINDOW - 1]
    assert set(winnow.fingerprint(a + shared)[0].tolist()) & set(winnow.fingerprint(shared + b)[0].tolist())


def test_compare_edits(spark):
    rows = sorted(((i, t or "") for i, t in corpus() if i is not None), key=lambda r: (-r[0], r[1]))
    got = winnow.compare_edits(frame(spark)).collect()
    want = Counter()
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (own, at), changed, following = winnow.fingerprint(t), winnow.fingerprint(edited)[0], winnow.fingerprint(after)[0]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnow.to_text(own), winnow.to_text(changed), winnow.likeness(own, changed), winnow.likeness(own, following), tuple(at.tolist()))] += 1
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    assert Counter((*[r[n] for n in names], tuple(r["positions"])) for r in got) == want
    one = winnow.compare_edits(frame(spark, [(1, "abc")])).first()
    assert (one["near_next"], one["fingerprint"] == winnow.to_text(winnow.fingerprint("abc")[0])) == (1.0, True)
    assert winnow.compare_edits(frame(spark, [])).count() == 0
    prints = winnow.fingerprints(frame(spark, [(1, None), (2, "abc")])).orderBy("doc_id").collect()
    assert [len(r["hashes"]) for r in prints] == [0, 1] and prints[1]["positions"] == [0]


# ------------------------------------------------------------ language, toxicity, mixing


def phrases_by_hand(text, sample, classes):
    n = at = 0
    text = [classes[ord(c)] for c in text]
    key = lambda xs: "".join(map(chr, xs))
    held = key([classes[ord(c)] for c in sample])
    while at < len(text):
        k = 1
        while at + k <= len(text) and key(text[at : at + k]) in held:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_counts_greedy_phrases():
    m = langid.Model({"a": words(1, 200, "abcd"), "b": words(2, 200, "cdef")})
    texts = [words(i, 20, "abcdefz1,") for i in range(6)] + ["q", "abab", ""]
    classes = m.tables()[3]
    for block in (1024, 16, 3, 1):
        got = m.phrases(texts, block)
        for i, t in enumerate(texts):
            for j, s in enumerate(m.samples):
                assert int(got[i, j]) == phrases_by_hand(t, s, classes[j])


def test_phrases_cross_blocks():
    """Long texts: a text against itself is one phrase, and blocks change nothing."""
    long = words(5, 3000, "abcdefgh")
    m = langid.Model({"a": long, "b": words(6, 3000, "abcdefgh"), "c": "ab" * 700})
    texts = [long, long[100:9000], words(7, 2000, "abcdefgh"), "ab" * 4000, "abc" * 3000, ""]
    got = m.phrases(texts)
    assert got[0, 0] == got[1, 0] == 1
    assert (got == m.phrases(texts, 1 << 20)).all() and (got == m.phrases(texts, 50)).all()


def test_large_scripts_are_told_apart():
    import random

    r = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(3000)]
    a, b = han[:1500], han[1500:]
    text = lambda x, n: "".join(r.choice(x) for _ in range(n))
    m = langid.Model({"a": text(a, 12_000), "b": text(b, 12_000)})
    got, _, _ = m.predict([text(a, 300), text(b, 300), text(a, 300)])
    assert got == ["a", "b", "a"]


def test_langid_repeated_rows_and_ties(spark):
    rows = [(1, "same words here", "en"), (1, "same words here", "en"), (2, "same words here", "fr"), (3, "same words here", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df.unionAll(df), langid.fit(df)).collect()
    assert len(got) == 8 and {r["lang_pred"] for r in got} == {"en"} and len({r["score"] for r in got}) == 1  # a tie goes to the first by name


def test_language(spark):
    kinds = {"de": "aber über schön ich nicht", "fr": "être où garçon je ne pas", "en": "the quick with and of"}
    import random

    r = random.Random(0)
    text = lambda k, n: " ".join(r.choice(kinds[k].split()) for _ in range(n))
    train = spark.createDataFrame([(text(k, 60), k) for k in kinds for _ in range(5)] + [(None, "en"), ("x", None), ("", "fr")], "text string, lang string")
    model = langid.fit(train)
    rows = [(i, text(k, 12), k) for i, k in enumerate(list(kinds) * 4)] + [(100, None, "und"), (101, "", "und"), (102, "123 !?", "und"), (103, words(1, 20_000) + " the", None)]
    df = spark.createDataFrame([(i, t, "zz", 9.0, k) for i, t, k in rows], "doc_id long, text string, lang_pred string, score double, want string")
    got = langid.identify(df, model).collect()
    assert all(g["lang_pred"] == g["want"] for g in got if g["want"]) and all(0 <= g["score"] <= 1 for g in got)
    assert langid.identify(df, langid.fit(train.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0
    assert "text" not in langid.identify(df, model, keep_text=False).columns


def test_toxicity(spark):
    import random

    r = random.Random(1)
    bad = ["vile", "rotten", "filthscum", "gruntle"]
    rows = []
    for i in range(400):
        w = words(3000 + i, 60).split()
        y = int(i % 6 == 0)
        for _ in range(3 * y):
            w[r.randrange(len(w))] = r.choice(bad)
        rows.append((i, " ".join(w), y))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(9001, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if i >= 300]
    assert sum(p != y for p, y in held) <= 2 and got[9001]["predicted"] == got[9002]["predicted"] == 0
    assert len(model.voters) == len(model.accuracies) > 2
    none = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_awkward_rows(spark):
    docs = frame(spark)  # nulls, empties, a very long text, repeated rows, a column named score
    bad = spark.createDataFrame([(20_000 + i, words(500 + i, 40) + " vilest rotten", "en", "s", 1, "x", 0.1, 1, "n") for i in range(12)], docs.schema)
    docs = docs.unionAll(bad)
    labels = docs.select("doc_id", (F.col("doc_id") >= 20_000).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns.count("score") == 1 and got.count() == docs.count()
    rows = got.collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert all(r["predicted"] == int((r["doc_id"] or 0) >= 20_000) for r in rows)
    by_text = {}
    assert all(by_text.setdefault(r["text"], r["score"]) == r["score"] for r in rows)  # repeated rows and ties score alike
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs.limit(0), labels)
    assert {r["predicted"] for r in toxicity.score(docs, empty).collect()} == {0}
    assert "text" not in toxicity.score(docs, model, keep_text=False).columns


def test_features_found_together():
    import random

    r = random.Random(3)
    pool = ["".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(400)]
    features = sorted({f for w in pool[:200] for f in toxicity.features_of_word(w)})[::3]
    m = toxicity.Model({(f, 1): 1.0 for f in features}, 0.0, 1.0, 0.0, [], [])
    assert all(sorted(m._in(w)) == sorted(set(toxicity.features_of_word(w)) & set(features)) for w in pool)


def test_label_model_sums_over_the_table(spark):
    """EM over the table of vote patterns of all different texts, against EM over the votes of each text in one array."""
    bad = ["vile", "rotten", "gruntle"]
    texts = [words(i, 40) + (" " + " ".join(bad[: i % 4]) if i % 5 == 0 else "") for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string")
    lex = toxicity.Lexicons([[(f"w:{b}", 1)] for b in bad], 0.1, 1.0)
    voters, far, near = lex.voters(), toxicity.LabelModel(0.1), toxicity.LabelModel(0.1)
    sums = toxicity.Sums(toxicity.patterns(docs, lex), len(lex.keys))
    far.fit_sums(lambda f: sums(lambda keys, long, n: f(voters.votes(keys, long), n)))
    keys = np.array([[b in t.split() for b in bad] for t in texts])
    near.fit(voters.votes(keys, np.ones(len(texts), bool)))
    assert np.allclose(far.table, near.table) and np.allclose(far.weight, near.weight) and np.allclose(far.silence, near.silence)
    assert sums(lambda keys, long, n: np.array([n.sum()]))[0] == len(texts)


def test_label_model_discounts_copies():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.2
    votes = np.where(y[:, None], r.random((4000, 3)) < 0.6, r.random((4000, 3)) < 0.02).astype(int) * 2 - 1
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])
    m = toxicity.LabelModel(0.2)
    q = m.fit(votes)
    assert ((q > 0.5) == y).mean() > 0.9 and m.weight[1] > m.weight[0] and abs(m.table[1][1] - 0.6) < 0.15


def test_mixing(spark):
    rows = []
    for i in range(300):
        kind = ("clean", "low", "toxic")[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]
        extra = {"clean": "good fine nice", "low": "%%% ### ***", "toxic": "vile rotten"}[kind]
        rows.append((i, words(i, 30) + " " + " ".join([extra] * 4), kind))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (None, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, k) for i, _, k in rows if i % 2] + [(3, None), (None, "low")], "doc_id long, domain string")
    weights = {"clean": 0.6, "low": 0.3, "toxic": 0.1}
    got = mixing.mix(docs, labelled, weights).collect()
    assert len(got) == 302 and all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 for r in got)
    right = [r["domain"] == dict((i, k) for i, _, k in rows)[r["doc_id"]] for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert sum(right) / len(right) > 0.95
    total = sum(r["tokens"] for r in got)
    for j, d in enumerate(("clean", "low", "toxic")):
        assert sum(r["rate"] * r["tokens"] * r["p"][j] for r in got) == pytest.approx(weights[d] * total, rel=2e-3)
    thin = mixing.mix(docs, labelled, {"clean": 0.9, "low": 0.05, "toxic": 0.05}, whole="clean").collect()
    assert all(r["rate"] > 0.98 for r in thin if r["domain"] == "clean" and r["doc_id"] is not None and r["doc_id"] < 1000) and max(r["rate"] for r in thin) < 1.01
    assert {r["rate"] for r in mixing.mix(docs, labelled.limit(0), weights).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, weights).count() == 0


def test_rates_match_numpy(spark):
    r = np.random.default_rng(3)
    p, n = r.dirichlet([1, 1, 1], 200), r.integers(1, 500, 200)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "tokens long, p array<double>")
    aims = np.array([0.5, 0.3, 0.2]) * n.sum()
    table = table.withColumn("i", F.monotonically_increasing_id())
    fitted, off = mixing.rates(table, aims.tolist(), max_steps=60, tolerance=1e-4)
    fitted = fitted.orderBy("i").collect()
    got = np.array([x["rate"] for x in fitted])
    n, p = np.array([x["tokens"] for x in fitted]), np.array([x["p"] for x in fitted])
    present = (n[:, None] * p).sum(0) / n.sum()
    gram = (p.T * n / n.sum()) @ p / np.sqrt(np.outer(present, present))
    step, rate = 1 / np.linalg.eigvalsh(gram)[-1], np.ones(200)
    for _ in range(20_000):  # plain projected gradient
        rate = np.maximum(0, rate - p @ (step * ((n * rate) @ p - aims) / n.sum() / present))
    assert max(off) < 1e-4 and got.min() >= 0
    assert np.allclose(n * got @ p, aims, atol=1e-4 * n.sum()) and np.allclose(n * rate @ p, aims, rtol=1e-5)


@pytest.mark.parametrize(("spread", "shares", "tolerance"), [(1, [0.7, 0.25, 0.05], 1e-6), (0.1, [0.9, 0.0992, 0.0008], 1e-4)])
def test_small_targets_are_met(spark, spread, shares, tolerance):
    """Also one that is less than a thousandth of all tokens."""
    r = np.random.default_rng(3)
    p, n = r.dirichlet([spread] * 3, 200), r.integers(1, 500, 200)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "tokens long, p array<double>")
    aims = np.array(shares) * n.sum()
    fitted, off = mixing.rates(table, aims.tolist(), tolerance=tolerance)
    got = fitted.collect()
    sums = sum(x["rate"] * x["tokens"] * np.array(x["p"]) for x in got)
    assert max(off) < tolerance and min(x["rate"] for x in got) >= 0 and np.allclose(sums, aims, rtol=tolerance, atol=0)


@pytest.mark.parametrize("most", [float("inf"), 1.0])
def test_rates_are_the_nearest_to_one(spark, most):
    """Against plain gradient steps in numpy on the multipliers of: least change of the rates, in tokens, that meets the targets; some documents keep a rate of 1."""
    r = np.random.default_rng(5)
    p, n = r.dirichlet([0.3] * 3, 300), r.integers(1, 500, 300)
    held = np.arange(300) % 7 == 0
    table = spark.createDataFrame([(i, int(a), [float(x) for x in b], bool(h)) for i, (a, b, h) in enumerate(zip(n, p, held, strict=True))], "i int, tokens long, p array<double>, h boolean")
    now = n @ p
    aims = now * np.array([0.9, 0.8, 0.5])
    fitted, off = mixing.rates(table, aims.tolist(), tolerance=1e-6, fixed=F.col("h"), most=most)
    got = np.array([x["rate"] for x in fitted.orderBy("i").collect()])
    multipliers = np.zeros(3)
    for _ in range(40_000):
        rate = np.where(held, 1, np.clip(1 - p @ multipliers, 0, most))
        multipliers += ((n * rate) @ p - aims) / now
    assert max(off) < 1e-6 and (got[held] == 1).all() and got.max() <= most
    assert np.allclose(got, rate, atol=1e-4)


def test_mixing_awkward_rows(spark):
    docs = frame(spark).withColumn("tokens", F.lit("x")).withColumn("rate", F.lit(-1)).withColumn("domain", F.lit("none"))
    ids = [r["doc_id"] for r in docs.collect()]
    labelled = spark.createDataFrame([(i, "abc"[k % 3]) for k, i in enumerate(ids)] + [(ids[0], "a"), (None, "b"), (12345678, "c")], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"a": 0.4, "b": 0.3, "c": 0.3}).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got if r["doc_id"] is not None) == sorted((i is None, i) for i in ids if i is not None) and len(got) == len(ids)
    assert all(r["rate"] >= 0 and abs(sum(r["p"]) - 1) < 1e-9 and set(r["misfit"]) == {"a", "b", "c"} for r in got)
    by_id = {}
    for r in got:  # repeated rows are judged alike
        assert by_id.setdefault((r["doc_id"], r["tokens"]), (r["p"], r["rate"])) == (r["p"], r["rate"])
    assert max(r["tokens"] for r in got) >= 30_000
    same = spark.createDataFrame([(i, "one text") for i in range(6)], "doc_id long, text string")
    even = mixing.mix(same, same.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a").alias("domain")), {"a": 0.5, "b": 0.5}).collect()
    assert all(abs(r["p"][0] - 0.5) < 1e-3 for r in even) and len({r["domain"] for r in even}) == 1


def test_classifier_learns_rare_domains(spark):
    """Domains of few documents, inflected words, held-out rows."""
    import random

    r = random.Random(2)
    rows = []
    for i in range(600):
        kind = "toxic" if i % 20 == 0 else "clean"
        w = words(8000 + i, 40).split()
        if kind == "toxic":
            w = [*w, "vilest" + r.choice(["er", "ing", "ed"]), "GRUNTLE,"]
        rows.append((i, " ".join(w), kind))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, k) for i, _, k in rows if i < 400], "doc_id long, domain string")
    told = {x["doc_id"]: x["p"][1] > 0.5 for x in mixing.posteriors(docs, mixing.fit(docs, labelled)).collect()}
    assert all(told[i] == (k == "toxic") for i, _, k in rows if i >= 400)


def test_smallest(spark):
    from gridmason.llm.common import smallest

    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("c"), F.xxhash64("id").alias("h"))
    got = smallest(df, "c", "h", 100, {"x": 2000, "y": 18_000}).collect()
    rows = df.collect()
    for c in "xy":
        assert sorted(r["h"] for r in got if r["c"] == c) == sorted(r["h"] for r in rows if r["c"] == c)[:100]
    assert smallest(df, "c", "h", 5000, {"x": 2000, "y": 18_000}).filter("c = 'x'").count() == 2000


def test_missed_targets_are_told(spark):
    docs = spark.createDataFrame([(i, f"same words in each {i}") for i in range(40)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "clean" if i % 2 else "toxic") for i in range(40)], "doc_id long, domain string")
    weights = {"clean": 0.99, "toxic": 0.01}
    with pytest.warns(UserWarning, match="toxic"):
        got = mixing.mix(docs, labelled, weights).collect()
    off = got[0]["misfit"]
    total = sum(x["tokens"] for x in got)
    for j, d in enumerate(("clean", "toxic")):
        aim = weights[d] * total
        assert off[d] == pytest.approx(abs(sum(x["rate"] * x["tokens"] * x["p"][j] for x in got) - aim) / aim) and off[d] > 0.01


def test_crc_mod(spark):
    got = [r["m"] for r in spark.createDataFrame([("12",), (None,)], "x string").select(crc_mod(F.col("x"), 4).alias("m")).collect()]
    assert got == [zlib.crc32(b"12") % 4, None]
