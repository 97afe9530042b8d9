"""Toxicity by weak supervision.

Voters (lexicons of words, patterns inside words, repetition of suspicious ones) look at a document and vote toxic,
clean or abstain. A generative label model estimates each voter's accuracy, and which voters repeat each other, from
their agreement alone, over all documents; its posteriors train a linear classifier over word features. Labelled rows serve to
choose the lexicons, to tell the share of toxic texts, and to calibrate the scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmason.llm.common import minimise, small_batches, smallest, stash

_WORD = re.compile(r"[^\W\d_]+")


def features_of_word(word: str) -> list[str]:
    """The word, what it starts with (p: there is more) and its parts of 4 to 7 letters: what invented or inflected words share."""
    w = f"^{word}$"
    out = {f"w:{word}"}
    out.update(f"p:{word[:n]}" for n in range(4, min(len(word), 10)))
    for n in (4, 5, 6, 7):
        out.update(f"g:{w[i : i + n]}" for i in range(len(w) - n + 1))
    return list(out)


#: Penalty of the classifier's squared weights, against the mean loss of a document.
RIDGE = 3e-4

Key = tuple[str, int]  # a feature, and in how many places a document must have it at least


class Voters:
    """Voters over keys: voter j votes toxic if a document has at least ``least[j]`` of its keys (``holds``: key x voter), clean if the document is long and no voter votes toxic, else abstains."""

    def __init__(self, names: list[str], holds: np.ndarray, least: np.ndarray):
        self.names, self.holds, self.least = names, holds.astype(np.float32), least

    def votes(self, keys: np.ndarray, long: np.ndarray) -> np.ndarray:
        """[document, voter]: 1 toxic, -1 clean, 0 abstains."""
        hit = keys.astype(np.float32) @ self.holds >= self.least
        return np.where(hit, 1, np.where((long & ~hit.any(1))[:, None], -1, 0)).astype(np.int8)


class LabelModel:
    """P(toxic | votes): EM for each voter's rate of toxic votes in either class, and for the rate of texts that voters call clean (these are the same texts for all voters, so that
    their clean votes are one). A voter's log-odds are divided by 1 + the sum of its positive
    correlations with other voters given the class, so that copies of a voter count once. The class prior stays as given.

    A round needs sums over the documents only: how many of either class, with a vote of each voter, with those of each pair of voters."""

    def __init__(self, prior: float):
        self.prior = prior
        self.table: np.ndarray | None = None

    def sums(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Toxic and all documents, silent ones, votes by voter, by pair: rows of votes counted ``weight`` times, by the posteriors as they are now."""
        hit = (votes == 1).astype(float)
        out = []
        for c in (weight * self.posterior(votes), weight):
            out.append(np.concatenate([[c.sum(), c @ self._silent(votes)], c @ hit, ((hit * c[:, None]).T @ hit).ravel()]))
        return np.concatenate(out)

    def fit_sums(self, total: Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], np.ndarray], rounds: int = 40) -> None:
        """``total(f)`` adds up f(votes, weight) over all documents."""
        for _ in range(rounds):
            toxic, everything = total(self.sums).reshape(2, -1)
            n = int(round((-1 + math.sqrt(1 + 4 * (len(toxic) - 2))) / 2))
            old = self.table
            parts = [(x[0], x[1], x[2 : 2 + n], x[2 + n :].reshape(n, n)) for x in (everything - toxic, toxic)]
            # toxic votes on clean texts are rare: few seen, few believed
            self.table = np.stack([(hits + s) / (size + 1) for (size, _, hits, _), s in zip(parts, (0.01, 0.5), strict=True)])
            self.silence = [float(np.clip(silent / max(size, 1e-9), 0.01, 0.99)) for size, silent, _, _ in parts]
            self.weight = self._discount(parts)
            if old is not None and np.abs(self.table - old).max() < 1e-5:
                break

    def fit(self, votes: np.ndarray, rounds: int = 40) -> np.ndarray:
        """The posteriors of the rows of votes."""
        self.fit_sums(lambda f: f(votes, np.ones(len(votes))), rounds)
        return self.posterior(votes)

    @staticmethod
    def _silent(votes: np.ndarray) -> np.ndarray:
        return (votes == -1).any(1) & ~(votes == 1).any(1)

    def _discount(self, parts: list[tuple[float, float, np.ndarray, np.ndarray]]) -> np.ndarray:
        total = np.zeros(len(parts[0][2]))
        for size, _, hits, pairs in parts:  # toxic votes only: all abstain together on short texts, which says nothing
            size = max(size, 1e-9)
            cov = pairs / size - np.outer(hits, hits) / size**2
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-4))
            self.correlation = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(self.correlation, 0)
            total += 0.5 * np.where(self.correlation > 0.2, self.correlation, 0).sum(1)
        return 1 / (1 + total)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        if self.table is None:  # where EM starts
            return np.where((votes == 1).any(1), 0.9, self.prior / 10)
        odds = np.maximum(np.log(self.table[1] / self.table[0]), 0) * self.weight
        z = math.log(self.prior / (1 - self.prior)) + (votes == 1) @ odds + self._silent(votes) * math.log(self.silence[1] / self.silence[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """score = sigmoid(slope * (bias + sum of the weights of the keys that a document has) + shift)."""

    def __init__(self, weights: dict[Key, float], bias: float, slope: float, shift: float, voters: list[str], accuracies: list[float]):
        self.weights, self.bias, self.slope, self.shift, self.voters, self.accuracies = weights, bias, slope, shift, voters, accuracies
        self.features = {f for f, _ in weights}
        self.cache: dict[str, tuple[str, ...]] = {}
        self.finder = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}, "finder": None}

    def _in(self, word: str) -> tuple[str, ...]:
        """Those of features_of_word(word) that count: what they are made of is searched for all at once."""
        if self.finder is None:
            parts: dict[str, list[str]] = {}
            for f in self.features:
                parts.setdefault({"w": f"^{f[2:]}$", "p": f"^{f[2:]}", "g": f[2:]}[f[0]], []).append(f)
            self.finder = ahocorasick.Automaton()
            for part, fs in parts.items():
                self.finder.add_word(part, tuple(fs))
            self.finder.make_automaton()
        w = f"^{word}$"
        found = {f for _, fs in self.finder.iter(w) for f in fs}
        return tuple(f for f in found if f[0] != "p" or len(f) - 2 < len(word)) if found else ()

    def _of(self, words: Counter) -> Counter:
        """In how many places the text has each feature that counts."""
        if len(self.cache) > 600_000:
            self.cache.clear()
        get, found = self.cache.get, Counter()
        for w, n in words.items():
            fs = get(w)
            if fs is None:
                fs = self.cache[w] = self._in(w) if self.features else ()
            for f in fs:
                found[f] += n
        return found

    def raw(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            found = self._of(Counter(_WORD.findall((t or "").lower())))
            out[i] = sum(self.weights.get(k, 0.0) for k in keys_of(found))
        return out

    def predict(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * (self.bias + self.raw(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def keys_of(found: Counter) -> set[Key]:
    return {(f, k) for f, n in found.items() for k in (1, 2, 3) if n >= k}


def _marks(words: list[str]) -> list[int]:
    """The two smallest hashes of a text's five-word sequences."""
    grams = {" ".join(words[j : j + 5]) for j in range(max(1, len(words) - 4))}
    return sorted(xxhash.xxh64_intdigest(g) >> 1 for g in grams)[:2]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias of a ridge logistic regression on soft labels of weighted rows, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (w * (y - p)) - penalty * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Lexicons:
    """Groups of keys that tell toxic labelled documents from the others; keys that are parts of each other are one group."""

    def __init__(self, groups: list[list[Key]], base: float, clean_weight: float):
        self.groups, self.base, self.clean_weight = groups, base, clean_weight
        self.keys = [k for g in groups for k in g]
        self.index = {k: i for i, k in enumerate(self.keys)}
        self.probe = Model(dict.fromkeys(self.keys, 0.0), 0.0, 1.0, 0.0, [], [])

    def present(self, words: Counter) -> np.ndarray:
        out = np.zeros(len(self.keys), bool)
        out[[self.index[k] for k in keys_of(self.probe._of(words)) & self.index.keys()]] = True
        return out

    def voters(self) -> Voters:
        holds = np.zeros((len(self.keys), len(self.groups) + 2))
        for j, g in enumerate(self.groups):
            holds[[self.index[k] for k in g], j] = 1
        holds[[self.index[g[0]] for g in self.groups], -2] = holds[:, -1] = 1
        names = [f"{'lexicon' if g[0][0][0] == 'w' else 'pattern'} {g[0][0][2:]} {g[0][1]}" for g in self.groups]
        return Voters([*names, "two groups", "many keys"], holds, np.array([1] * len(self.groups) + [2, 6]))


def lexicons(labelled: list[tuple[int, Counter]], prior: float | None = None) -> Lexicons:
    """From (toxic, words) of labelled documents, in any proportion: every key that three toxic ones have and few others, with more evidence than chance among so many keys gives. prior: the share of toxic texts (default: theirs)."""
    n_toxic = sum(y for y, _ in labelled)
    n_clean = len(labelled) - n_toxic
    if not n_toxic or not n_clean:
        return Lexicons([], min(max(prior or 0.0, 0.001), 0.9), 1.0)
    # toxic rows that have a feature, counted by its hash first, since most occur once
    slots = np.zeros(1 << 24, np.uint16)
    for y, words in labelled:
        if y and words:
            own = {xxhash.xxh64_intdigest(f) & 0xFFFFFF for w in words for f in features_of_word(w)}
            at = np.fromiter(own, np.int64, len(own))
            slots[at] = np.minimum(slots[at], 65_000) + 1
    # what a key must have in evidence, and so many toxic rows at least (were no other to have it)
    need, share = math.log(max(10, int((slots >= 3).sum()))), n_toxic / len(labelled)
    least = max(3, math.floor(need / -math.log(share)))
    often: dict[str, list[str]] = {}

    def present(words: Counter) -> Counter:
        out: Counter = Counter()
        for w, n in words.items():
            if w not in often:
                often[w] = [f for f in features_of_word(w) if slots[xxhash.xxh64_intdigest(f) & 0xFFFFFF] >= least]
            for f in often[w]:
                out[f] += n
        return out

    toxic_df, clean_df = Counter(), Counter()
    for y, words in labelled:
        if y:
            toxic_df.update(keys_of(present(words)))
    wanted = {f for (f, _), n in toxic_df.items() if n >= least}
    for y, words in labelled:
        if not y:
            clean_df.update(keys_of(Counter({f: n for f, n in present(words).items() if f in wanted})))
    base = min(max(prior or n_toxic / len(labelled), 0.001), 0.9)
    clean_weight = (1 - base) / base * n_toxic / n_clean  # clean rows that one in the sample stands for, in toxic ones

    def evidence(f: Key) -> float:
        """Log-likelihood ratio of the toxic share of the sample's documents with the key, against that of all its documents."""
        a, b = toxic_df[f], clean_df[f]
        p = (a + 0.1) / (a + b + 0.2)
        return a * math.log(p / share) + b * math.log((1 - p) / (1 - share)) if p > share else 0.0

    good = [(evidence(f), f) for f, a in toxic_df.items() if a >= least and clean_df[f] * clean_weight <= 0.2 * a]
    good = sorted(((e, f) for e, f in good if e > need), key=lambda x: (-x[0], -len(x[1][0]), x[1]))
    groups: list[list[Key]] = []  # the strongest key leads
    cores: list[str] = []
    for _, f in good:
        core = f[0][2:].strip("^$")
        home = next((i for i, lead in enumerate(cores) if core in lead or lead in core), None)
        if home is None:
            groups.append([f])
            cores.append(core)
        else:
            groups[home].append(f)
    return Lexicons(groups, base, clean_weight)


def _words_of(texts: list[str | None]) -> list[Counter]:
    return [Counter(_WORD.findall((t or "").lower())) for t in texts]


def _labelled_words(rows: DataFrame) -> list[tuple[int, Counter]]:
    """rows(text, toxic) -> (toxic, words): counted where the rows are; of a group of texts that share one of the two smallest of their five-word sequences' hashes
    one stays, since copies would pass for evidence. The driver gets the different words of a bounded number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            marks = [_marks((t or "").lower().split()) for t in texts]
            found = [sorted((w, min(n, 3)) for w, n in c.items()) for c in _words_of(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(marks, pa.list_(pa.int64())), pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32()))], names=["toxic", "marks", "words", "ns"])

    got = rows.select("text", "toxic").mapInArrow(run, "toxic int, marks array<bigint>, words array<string>, ns array<int>").collect()
    seen: set[int] = set()
    out = []
    for r in sorted(got, key=lambda r: (r["marks"], r["toxic"], r["words"])):
        if not seen.intersection(r["marks"]):
            out.append((r["toxic"], Counter(dict(zip(r["words"], r["ns"], strict=True)))))
        seen.update(r["marks"])
    return out


def patterns(docs: DataFrame, lex: Lexicons, clean_from: int = 30) -> DataFrame:
    """(keys: bits of the lexicons' keys, long: whether there are ``clean_from`` words, n: how many different texts) over all rows of docs(text)."""
    small_batches(docs.sparkSession)
    lex = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _words_of(batch.column(1).to_pylist())
            bits = [np.packbits(lex.value.present(w)).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), pa.array([sum(w.values()) >= clean_from for w in words], pa.bool_())], names=["h", "keys", "long"])

    rows = docs.select(F.xxhash64(F.lower("text")).alias("h"), "text").mapInArrow(run, "h long, keys binary, long boolean")
    return stash(rows.dropDuplicates(["h"]).groupBy("keys", "long").agg(F.count("*").alias("n")), "toxicity-patterns")


class Sums:
    """Adds up a function of (keys, long, n) over a table of patterns; at most ``tasks`` partial sums come to the driver."""

    def __init__(self, table: DataFrame, n_keys: int, tasks: int = 64):
        self.table, self.n_keys = table.coalesce(tasks), n_keys

    def __call__(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        n_keys = self.n_keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                keys = np.unpackbits(raw, axis=1)[:, :n_keys].astype(bool)
                part = f(keys, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().astype(float))
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["sums"])

        got = [np.frombuffer(r["sums"], np.float64) for r in self.table.mapInArrow(run, "sums binary").collect()]
        return sum(got[1:], got[0]) if got else f(np.zeros((0, n_keys), bool), np.zeros(0, bool), np.zeros(0))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1200) -> Model:
    """``labels(doc_id, toxic)``: the rows to learn from. Chooses the lexicons from at most ``per_label`` labelled documents of either label, those with the smallest hashes of
    doc_id: a bounded sample of labelled rows. The label model and the classifier then learn from the votes on all different texts of docs, which stay in a table of vote
    patterns; each step is a sum over it. Null labels are left out; of a doc_id with several labels the highest counts. Few or no toxic rows, or an empty table, give a model that scores every text by the prior."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {str(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = shares.get("1", 0) / max(1, sum(shares.values()))
    if not shares:
        return Model({}, 0.0, 1.0, -3.0, [], [])
    small_batches(docs.sparkSession)
    known = known.select("doc_id", F.col("toxic").cast("string").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    picked = smallest(known, "toxic", "h", per_label, shares).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    labelled = _labelled_words(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    lex = lexicons(labelled, prior)
    if not lex.keys:
        return Model({}, 0.0, 1.0, math.log(lex.base / (1 - lex.base)) if prior else -3.0, [], [])
    sums, voters, model = Sums(patterns(docs, lex), len(lex.keys)), lex.voters(), LabelModel(lex.base)
    model.fit_sums(lambda f: sums(lambda keys, long, n: f(voters.votes(keys, long), n)))
    size = sums(lambda keys, long, n: np.array([n.sum()]))[0]

    def loss(beta: np.ndarray) -> tuple[float, np.ndarray]:
        def part(keys: np.ndarray, long: np.ndarray, n: np.ndarray) -> np.ndarray:
            q, z = model.posterior(voters.votes(keys, long)), keys @ beta[:-1] + beta[-1]
            off = n / size * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q)
            return np.concatenate([[(n / size) @ (np.logaddexp(0, z) - q * z)], off @ keys, [off.sum()]])

        got = sums(part)
        return float(got[0] + 0.5 * RIDGE * (beta[:-1] ** 2).sum()), got[1:] + RIDGE * np.append(beta[:-1], 0.0)

    beta = minimise(loss, np.append(np.zeros(len(lex.keys)), math.log(lex.base / (1 - lex.base))), rounds=60, enough=1e-6)
    weight, bias = beta[:-1], float(beta[-1])
    raw = np.array([lex.present(words) @ weight + bias for _, words in labelled])
    y = np.array([y for y, _ in labelled], float)
    slope, shift = _logistic(raw[:, None], y, np.where(y == 1, 1.0, lex.clean_weight), 0.01).tolist()  # calibration on labelled rows
    accuracy = [float(x) for x in model.table[1] / (model.table[1] + model.table[0])]
    return Model({f: float(w) for f, w in zip(lex.keys, weight, strict=True) if w}, bias, float(max(slope, 0.2)), float(shift), voters.names, accuracy)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """docs (without its text, if that isn't to be kept) with score (0 to 1) and predicted (1 from the threshold on). Whole texts, no shuffle; null text is scored as empty. A column of docs with one of these names is replaced."""
    old = [c for c in docs.columns if c not in ("score", "predicted", text)] + [text]
    out = old if keep_text else old[:-1]
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)
    which = old.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.predict(batch.column(which).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*out, "score", "predicted"])

    return docs.select(*old).mapInArrow(run, docs.select(*out).schema.add("score", "double").add("predicted", "integer"))
