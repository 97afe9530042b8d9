"""Language identification by cross-parsing entropy.

A suffix automaton of each language's sample text tells how far any text can be followed inside that sample. A document
is cut into phrases, each the longest match from where the last one ended; the language that needs the fewest phrases, in bits
(phrases x log2 of its sample's size), wins.

Matching runs for many documents at once: an automaton becomes a table next[state, character class], in which a
missing step restarts at the root and counts a phrase, so that a character costs one look-up per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmason.llm.common import small_batches, smallest, stash

SPACE, DIGIT, MARK, LETTER = 1, 2, 3, 4
SCHEMA = "lang_pred string, score double, phrases_per_char double"


@lru_cache(1)
def _kinds() -> np.ndarray:
    """By code point: 1 white space, 2 digit, 3 mark, 4 letter; unassigned and other symbols are marks."""
    out = np.full(0x110000, MARK, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = LETTER
        elif c.isspace():
            out[i] = SPACE
        elif c.isdigit():
            out[i] = DIGIT
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Letters with a class of their own in a language, and classes that the further letters of its sample share by code point.
OWN, SHARED = 200, 32


def _classes(sample: str) -> tuple[np.ndarray, int]:
    """The class of each code point, and their number: the sample's OWN commonest letters have one each, in either case; its further letters one of SHARED;
    letters that it lacks have one that nothing follows; the rest goes by kind."""
    counts: dict[str, int] = {}
    for c in sample.lower():
        if c.isalpha() and len(c.upper()) == 1:
            counts[c] = counts.get(c, 0) + 1
    common = sorted(counts, key=lambda c: (-counts[c], c))
    alphabet, further = sorted(common[:OWN]), common[OWN:]
    kinds, first = _kinds(), 4 + len(alphabet)
    out = np.where(kinds == LETTER, 3, kinds - 1).astype(np.uint8)
    for group, of in ((alphabet, lambda i, c: 4 + i), (further, lambda i, c: first + ord(c) % SHARED)):
        for i, c in enumerate(group):
            for x in {c, c.upper(), c.lower()}:
                if len(x) == 1:
                    out[ord(x)] = of(i, c)
    return out, first + (SHARED if further else 0)


def suffix_automaton(seq: list[int], width: int) -> np.ndarray:
    """next[state, class] of the suffix automaton of seq; -1 where there is no step. State 0 is the root."""
    step = [dict()]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(step), width), -1, np.int32)
    for s, d in enumerate(step):
        for c, t in d.items():
            table[s, c] = t
    return table


class Model:
    """``samples``: text of each language. Pickles as those; the tables are built where they are used."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        self.samples = [samples[k] for k in self.langs]
        self.built = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"built": None}

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One flat table of all languages; entries are (row of the next state << 1) | whether a phrase starts with this character. Also where texts
        start in it, the bits of a phrase, and the class of each code point, by language."""
        if self.built is None:
            flat, roots, bits, classes, base = [], [], [], [], 0
            for text in self.samples:
                cls, width = _classes(text)
                seq = cls[_points(text)]
                table = suffix_automaton(seq.tolist(), width)
                fresh = len(table)  # where a text starts, and what follows a character that the sample lacks
                again = np.where(table[0] >= 0, table[0], fresh)
                table = np.vstack([table, np.full((1, width), -1, np.int32)])
                to, starts = np.where(table >= 0, table, again), table < 0
                flat.append((((to.astype(np.int64) * width + base) << 1) | starts).reshape(-1))
                roots.append(fresh * width + base)
                bits.append(np.log2(max(2, len(seq))))
                classes.append(cls)
                base += table.size
            kind = np.int32 if base < 1 << 30 else np.int64
            self.built = np.concatenate(flat).astype(kind), np.array(roots, kind), np.array(bits), np.stack(classes)
        return self.built

    def phrases(self, texts: list[str], block: int = 1024) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns).

        Texts are matched in blocks, many in step, each from the start state; then the first characters of every later block are matched again from
        the state in which the block before it ends, until both ways are in the same state: from there on they are one. A block that ends
        in another state than thought sends the next one through this once more. The result is that of one pass over the whole text.
        """
        table, roots, _, classes = self.tables()
        points = [_points(t) for t in texts]
        codes = np.ascontiguousarray(classes[:, np.concatenate(points)]) if points else np.zeros((len(roots), 0), np.uint8)
        size = np.array([len(p) for p in points], np.int64)
        n_blocks = -(-size // block)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = (np.cumsum(size) - size)[owner] + k * block
        length = np.minimum(block, size[owner] - k * block)
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.where(k > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        start, length, owner = start[order], length[order], owner[order]
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        at = np.repeat(roots[:, None] << 1, len(owner), 1)
        count = np.zeros((len(roots), len(owner)), np.int32)
        for t, m in enumerate(active.tolist()):
            now = at[:, :m]
            np.right_shift(now, 1, out=now)
            now += codes[:, start[:m] + t]
            np.take(table, now, out=now, mode="clip")
            count[:, :m] += now & 1
        alone, alone_ends, ends, after = count.copy(), at >> 1, at >> 1, np.full(len(owner), -1)
        after[before[before >= 0]] = np.flatnonzero(before >= 0)
        todo = np.flatnonzero(before >= 0)
        while len(todo):
            which, extra = todo, np.zeros((len(roots), len(todo)), np.int32)
            slot = np.arange(len(todo))
            true, fresh = ends[:, before[which]], np.repeat(roots[:, None], len(which), 1)
            changed = []
            for t in range(block + 1):
                met, out_of = (true == fresh).all(0), t >= length[which]
                for done, end in ((which[met], alone_ends[:, which[met]]), (which[out_of & ~met], true[:, out_of & ~met])):
                    new = (end != ends[:, done]).any(0)
                    ends[:, done] = end
                    changed.append(done[new])
                going = ~(met | out_of)
                if not going.all():
                    which, slot, true, fresh = which[going], slot[going], true[:, going], fresh[:, going]
                if not len(which):
                    break
                code = codes[:, start[which] + t]
                true, fresh = table[true + code], table[fresh + code]
                extra[:, slot] += (true & 1) - (fresh & 1)
                true, fresh = true >> 1, fresh >> 1
            count[:, todo] = alone[:, todo] + extra
            todo = after[np.concatenate(changed)]
            todo = todo[todo >= 0]
        out = np.zeros((len(texts), len(roots)), np.int64)
        np.add.at(out, owner, count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        has_letter = np.array([bool((_kinds()[_points(t)] == 4).any()) for t in texts], bool)
        n = np.maximum(1, [len(t) for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        found = self.phrases(texts)
        bits = found * self.tables()[2]
        best = bits.argmin(1)
        weight = np.exp2(-np.clip((bits - bits.min(1, keepdims=True)) / 8, 0, 200))
        score = np.where(has_letter, 1 / weight.sum(1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)], score, found.min(1) / n


def fit(train: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 200, chars: int = 24_000) -> Model:
    """From labelled rows: for each language, the ``per_lang`` different texts with the smallest hashes, each of which gives an equal share of ``chars`` characters, from a
    place in it that its hash tells: a bounded sample, whatever the table's size. Null text or language is left out; no labelled row gives a model that predicts "und"."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null and trim(text) <> ''").withColumn("h", F.xxhash64("text"))
    keys = stash(rows.select("lang", "h").distinct(), "langid-keys")
    counts = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, max(1, chars // min(n, per_lang)))])
    rows = rows.join(F.broadcast(smallest(keys, "lang", "h", per_lang, counts)), ["lang", "h"]).withColumn("n", F.try_element_at(share, "lang"))
    place = F.pmod(F.xxhash64("h", F.lit(5)), F.greatest(F.length("text") - F.col("n"), F.lit(0)) + 1) + 1
    picked = rows.select("lang", "h", F.substring(F.col("text"), place.cast("int"), F.col("n")).alias("text")).dropDuplicates(["lang", "h"])
    got: dict[str, dict[int, str]] = {}
    for r in picked.collect():
        got.setdefault(r["lang"], {})[r["h"]] = r["text"]
    return Model({k: "\n".join(t for _, t in sorted(v.items())) for k, v in got.items()})


def identify(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs (without its text, if that isn't to be kept) with lang_pred ("und" for null text or text without a letter), score (0 to 1; tempered share of the winner against the other
    languages) and phrases_per_char. Ties go to the first language by name. Whole texts, no shuffle. A column of docs with one of these names is replaced."""
    new = SCHEMA.replace(" string", "").replace(" double", "").split(", ")
    old = [c for c in docs.columns if c not in new and c != text] + [text]
    out = old if keep_text else old[:-1]
    schema = docs.select(*out).schema
    for part in SCHEMA.split(", "):
        schema = schema.add(*part.split(" "))
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)
    which = old.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gridmason.llm.tokens import blocks

        for batch in batches:
            texts = batch.column(which).to_pylist()
            for a, b in blocks(texts, 1_500_000):
                found = model.value.predict(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(out)], pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2])], names=[*out, *new])

    return docs.select(*old).mapInArrow(run, schema)
