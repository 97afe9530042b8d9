"""Soft-membership mixing of sources to target weights, in DataFrame operations only.

A classifier learned from a labelled table (logistic regression over the words, word beginnings and binned text statistics that a
text has) gives each document a posterior over domains. Nonnegative document rates r are then fitted by projected gradient least squares so that the
expected token totals of the domains, sum of r * tokens * posterior, match the targets.

A gradient step needs one number per domain, whatever the number of documents; a document's rate follows from these and its
posterior, so an iteration is one aggregation over the table of posteriors and nothing is written in between.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmason.llm.common import minimise, smallest, stash

BINS = 8
#: What stands between words.
BETWEEN = r"""[ \t\r\n.,;:!?"()\[\]]+"""
#: So many first letters of a longer word are a key of their own: invented and inflected words share them.
BEGINNING = 4
#: Statistics of a text: capitals in a row, digits, symbols, line ends (each as a share of its length), different words (as a share of all), and its length.
STATISTICS = ("capitals", "digits", "symbols", "lines", "different", "size")


def _literal(values: list[float]) -> Column:
    """An array literal, parsed in one call and folded to a constant."""
    return F.expr("array(" + ",".join(f"{v!r}D" if math.isfinite(v) else "0D" for v in map(float, values)) + ")")


def _words(text: Column) -> Column:
    return F.split(F.lower(text), BETWEEN)


def _described(rows: DataFrame, *keep: str) -> DataFrame:
    """rows(text, ...) -> tokens (words), s (array<int>: the bins of STATISTICS), keys (array<long>: hashes of the different words in lower case, and of the different
    beginnings of longer ones; may hold a null). Whole texts; null text is empty (one token)."""
    rows = rows.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text")).select(*keep, "text", _words(F.col("text")).alias("ws"))
    start = lambda w: F.when(F.length(w) > BEGINNING, F.xxhash64(F.substring(w, 1, BEGINNING), F.lit("~")))
    rows = rows.select(*keep, "text", F.size("ws").cast("long").alias("tokens"), F.array_distinct(F.transform("ws", lambda w: F.xxhash64(w))).alias("words"), F.array_distinct(F.transform("ws", start)).alias("starts"))
    n = F.greatest(F.length("text"), F.lit(1))

    def share(x: Column, of: Column) -> Column:
        return F.least(F.floor(F.log2(1 + x / of * 255)), F.lit(BINS - 1)).cast("int")

    counted = [share(F.regexp_count("text", F.lit(p)), n) for p in ("[A-Z][A-Z]", "[0-9]", "[%*#$&|!=_~^]", "\n")]
    s = F.array(*counted, share(F.size("words"), F.col("tokens")), F.least(F.floor(F.log2(n + 1) / 2), F.lit(BINS - 1)).cast("int"))
    return rows.select(*keep, "tokens", s.alias("s"), F.concat("words", "starts").alias("keys"))


class Classifier:
    """For each domain but the first: log-odds against the first of nothing known (``prior``), of each key (``keys``: key -> log-odds) and of each bin of each statistic."""

    def __init__(self, domains: list[str], prior: list[float], keys: dict[int, list[float]], bins: list[list[list[float]]]):
        self.domains, self.prior, self.keys, self.bins = domains, prior, keys, bins


def _softmax_fit(rows: list[list[int]], width: int, label: np.ndarray, weight: np.ndarray, n_labels: int, ridge: float) -> np.ndarray:
    """[feature, label] weights of a multinomial logistic regression; rows: the features (of 0 to width - 1) that each row has, the last one the constant, which bears no penalty."""
    at = np.concatenate([np.array(r, np.int64) for r in rows])
    ends = np.cumsum([len(r) for r in rows])
    owner, starts = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0)), np.concatenate([[0], ends[:-1]])
    aim = np.eye(n_labels)[label]
    penalty = np.full((width, 1), ridge)
    penalty[-1] = 1e-6

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x.reshape(width, n_labels)
        z = np.add.reduceat(w[at], starts)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        total = p.sum(1, keepdims=True)
        off = (p / total - aim) * weight[:, None]
        value = -(weight * ((z * aim).sum(1) - np.log(total[:, 0]))).sum() + 0.5 * (penalty * w * w).sum()
        slope = np.column_stack([np.bincount(at, off[owner, k], width) for k in range(n_labels)]) + penalty * w
        return float(value), slope.ravel()

    return minimise(loss, np.zeros(width * n_labels)).reshape(width, n_labels)


def fit(docs: DataFrame, labelled: DataFrame, per_domain: int = 1500, ridge: float = 1.0) -> Classifier:
    """``labelled(doc_id, domain)``. Learns from at most ``per_domain`` labelled documents of each domain, those with the smallest hashes of
    doc_id: a bounded sample, of whole texts, weighted to the domains' shares among all labelled rows. Null labels are left out; of several labels of a doc_id the first by name counts.

    Of the sample's keys, those count that three documents have at least and whose presence differs between some domain and the rest by more than chance among so many keys would
    (log-likelihood ratio). The driver gets the keys and statistics of the sample's documents."""
    labelled = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    labelled = labelled.select("doc_id", "domain", F.xxhash64("doc_id").alias("h"))
    shares = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    domains = sorted(shares)
    if not domains:
        return Classifier([], [], {}, [])
    picked = smallest(labelled, "domain", "h", per_domain, shares)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "domain")), "doc_id")
    sample = stash(_described(rows.withColumn("row", F.monotonically_increasing_id()), "row", "domain"), "mixing-sample")
    n = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(n.values())
    if not total:
        return Classifier(domains, [math.log(shares[d] / shares[domains[0]]) for d in domains[1:]], {}, [[[0.0] * BINS for _ in STATISTICS] for _ in domains[1:]])

    def part(x: Column, m: float) -> Column:  # log-likelihood of x of m documents at their own share
        return F.when((x > 0) & (x < m), x * F.log(x / m) + (m - x) * F.log(1 - x / m)).otherwise(0.0)

    seen = sample.select("domain", F.explode("keys").alias("key")).filter("key is not null").groupBy("key")
    seen = seen.agg(F.count("*").cast("double").alias("x"), *[F.count_if(F.col("domain") == d).cast("double").alias(f"x{j}") for j, d in enumerate(domains)]).filter("x >= 3")
    ratios = [2 * (part(F.col(f"x{j}"), float(n[d])) + part(F.col("x") - F.col(f"x{j}"), float(total - n[d])) - part(F.col("x"), float(total))) for j, d in enumerate(domains) if 0 < n.get(d, 0) < total]
    seen = stash(seen.select("key", F.greatest(F.lit(0.0), F.lit(0.0), *ratios).alias("ratio")), "mixing-keys")
    need = 2 * math.log(max(10, seen.count()))
    known = seen.filter(F.col("ratio") > need)
    index = {k: i for i, k in enumerate(sorted(r["key"] for r in known.select("key").collect()))}
    hits = sample.select("row", F.explode("keys").alias("key")).join(F.broadcast(known.select("key")), "key").groupBy("row").agg(F.collect_list("key").alias("hits"))
    got = sample.select("row", "domain", "s").join(hits, "row", "left").orderBy("row").collect()
    width = len(index) + len(STATISTICS) * BINS + 1
    features = [[*[index[k] for k in r["hits"] or []], *[len(index) + i * BINS + b for i, b in enumerate(r["s"])], width - 1] for r in got]
    label = np.array([domains.index(r["domain"]) for r in got])
    scale = np.array([shares[d] / n.get(d, 1) for d in domains])
    weight = scale[label] * len(got) / scale[label].sum()
    w = _softmax_fit(features, width, label, weight, len(domains), ridge)
    w = np.round(w - w[:, :1], 5)[:, 1:]
    bins = w[len(index) : -1].reshape(len(STATISTICS), BINS, -1)
    return Classifier(domains, w[-1].tolist(), {k: w[i].tolist() for k, i in index.items()}, [bins[:, :, j].tolist() for j in range(len(domains) - 1)])


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tokens (words), p array<double> in the order of model.domains. Whole texts; null text is empty (one token).

    A row's keys are looked up and summed in the task that reads it, so that what is shuffled is one row of sums for each document. (explode_outer: for an inner
    one the optimizer would work the keys out twice, to leave out empty arrays, of which there are none.)
    """
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    if not model.domains:
        return rows.select("doc_id", F.size(_words(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"), F.array().cast("array<double>").alias("p"))
    rows = _described(rows, "row", "doc_id")
    names = [f"z{j}" for j in range(len(model.prior))]
    given = [sum((F.get(_literal(model.bins[j][i]), F.col("s")[i]) for i in range(len(STATISTICS))), F.lit(model.prior[j])) for j in range(len(names))]
    rows = rows.select("row", "doc_id", "tokens", "keys", *[z.alias(f"b{j}") for j, z in enumerate(given)])
    if names and model.keys:
        table = docs.sparkSession.createDataFrame([(k, *w) for k, w in model.keys.items()], "key bigint, " + ", ".join(f"{n} double" for n in names))
        hits = rows.select("row", "doc_id", "tokens", *[f"b{j}" for j in range(len(names))], F.explode_outer("keys").alias("key")).join(F.broadcast(table), "key", "left")  # as many keys as the bounded sample gives
        rows = hits.groupBy("row", "doc_id", "tokens", *[f"b{j}" for j in range(len(names))]).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names])
        odds = [F.col(f"b{j}") + F.col(n) for j, n in enumerate(names)]
    else:
        odds = [F.col(f"b{j}") for j in range(len(names))]
    rows = rows.select("doc_id", "tokens", F.array(F.lit(0.0), *odds).alias("o")).withColumn("o", F.transform("o", lambda x: F.exp(F.greatest(x - F.array_max("o"), F.lit(-60.0)))))
    return rows.select("doc_id", "tokens", F.transform("o", lambda x: x / F.aggregate("o", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def rates(table: DataFrame, targets: list[float], max_steps: int = 60, tolerance: float = 1e-4, fixed: Column | None = None, most: float = math.inf) -> tuple[DataFrame, list[float]]:
    """``table(tokens, p, ...)`` with a rate for each row, and the misfit of each domain relative to its target.

    Minimises half the sum over domains of (total - target)^2 / (all tokens * present total), in the metric that weights a document by its tokens, by a
    projected gradient step from rates of 1 whose gradient is that at its own end: rate = max(0, 1 - g . p). The longer the step, the closer the
    minimum; g is found by Newton steps while the step is lengthened, each one aggregation that tries three parts of the step. Ends when every domain is within ``tolerance`` of its target, as a
    share of that target, or after ``max_steps`` aggregations (no rates may meet the targets): then the best rates seen are returned, and their misfits tell what is missed.
    Rows where ``fixed`` holds count with a rate of 1 and keep it; the others are fitted around them, with rates of at most ``most``.
    """
    d = len(targets)
    if not d:
        return table.withColumn("rate", F.lit(1.0)), []
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    held = F.coalesce(fixed, F.lit(False)) if fixed is not None else F.lit(False)
    first = None

    def rate(g: np.ndarray) -> Column:
        free = F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(float(x)) * F.col("p")[i] for i, x in enumerate(g)), F.lit(0.0)))
        return F.when(held, 1.0).otherwise(F.least(free, F.lit(most)) if most < math.inf else free)

    def sums(gs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each g the domains' totals, and the products of the posteriors over the free documents whose rate is at no bound (at g = 0, over all free ones)."""
        nonlocal first
        rows = table.select("p", "tokens", held.alias("held"), *[rate(g).alias(f"r{k}") for k, g in enumerate(gs)])
        wanted = [F.sum("tokens").alias("all")]
        for k in range(len(gs)):
            inside = (F.col(f"r{k}") > 0) & ((F.col(f"r{k}") < most) if most < math.inf and gs[k].any() else F.lit(True))
            on = F.when(inside & ~F.col("held"), F.col("tokens")).otherwise(0)
            wanted += [F.sum(F.col("tokens") * F.col(f"r{k}") * F.col("p")[i]).alias(f"t{k}_{i}") for i in range(d)] + [F.sum(on * F.col("p")[i] * F.col("p")[j]).alias(f"m{k}_{i}_{j}") for i, j in pairs]
        got = rows.agg(*wanted).first()
        first = float(got["all"] or 0) if first is None else first
        return [(np.array([got[f"t{k}_{i}"] or 0.0 for i in range(d)]), np.array([[got[f"m{k}_{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])) for k in range(len(gs))]

    g = np.zeros(d)
    [(at, gram)] = sums([g])
    total = first
    if not total:
        return table.withColumn("rate", F.lit(1.0)), []
    aims, at, gram = np.array(targets) / total, at / total, gram / total
    present = np.maximum(at, 1e-12)

    def size(v: np.ndarray) -> float:
        return math.sqrt(float((v * v / present).sum()))

    best, length, steps = (size(at - aims), g, at), 1.0, 1
    while steps < max_steps and (np.abs(at - aims) >= tolerance * np.maximum(aims, 1e-9)).any():
        off = present * g / length - (at - aims)
        move = -np.linalg.solve(np.diag(present) / length + gram, off)
        part, old = 1.0, g
        while True:
            tried = [old + part / 3**k * move for k in range(3)]
            found = [(x, t / total, m / total) for x, (t, m) in zip(tried, sums(tried), strict=True)]
            steps += 1
            ends = [size(present * x / length - (t - aims)) for x, t, _ in found]
            k = next((k for k in range(3) if ends[k] <= size(off) * (1 - 0.1 * part / 3**k)), None)
            if k is not None or part < 0.01 or steps >= max_steps:
                k = int(np.argmin(ends)) if k is None else k
                g, at, gram = found[k]
                break
            part /= 27
        best = min([best, *[(size(t - aims), x, t) for x, t, _ in found]], key=lambda x: x[0])
        if ends[k] < max(0.05 * size(at - aims), 1e-12):
            length = min(10 * length, 1e12)
    if (np.abs(at - aims) >= tolerance * np.maximum(aims, 1e-9)).any():
        _, g, at = best
    return table.withColumn("rate", rate(g)), [float(x) for x in np.abs(at - aims) / np.maximum(aims, 1e-9)]


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], per_domain: int = 1500, whole: str | None = None, tolerance: float = 1e-4) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, tokens, domain (the likeliest), p (posteriors, by domain name in order), rate, misfit (map: by how much of its target each
    domain's expected total misses it; the same in every row). Warns of misfits of ``tolerance`` or more: no rates may meet the targets.

    Targets are ``weights`` (scaled to sum 1) times all tokens. With ``whole``, a domain's name, documents likeliest of that domain keep a rate of 1, and
    the others are fitted so that the domains' totals over all documents stand to each other as the weights do, but none rises above its present total: rates then only
    drop what there is too much of. Domains without a weight have target 0; weights of unknown domains are ignored; no labelled rows give rates of 1 and no misfits.
    Rows with null text have the empty text; null and repeated ids are kept, row by row; ties of the likeliest domain go to the first by name; an empty table gives no rows.
    """
    model = fit(docs, labelled, per_domain)
    names = F.array(*[F.lit(d) for d in model.domains])
    table = stash(posteriors(docs, model), "posteriors")
    given = [weights.get(d, 0.0) for d in model.domains]
    misfit = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    if not sum(given):
        return table.select("doc_id", "tokens", F.lit(None).cast("string").alias("domain"), "p", F.lit(1.0).alias("rate"), misfit.alias("misfit"))
    table = table.withColumn("domain", F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1))
    sums = table.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col("p")[i]), F.lit(0.0)).alias(f"t{i}") for i in range(len(given))]).first()
    present = [sums[f"t{i}"] for i in range(len(given))]
    fixed = None
    if whole in model.domains:
        k, fixed = model.domains.index(whole), F.col("domain") == whole
        targets = [min(p, present[k] * w / max(given[k], 1e-9)) for p, w in zip(present, given, strict=True)]
    else:
        targets = [w / sum(given) * sum(present) for w in given]
    table, off = rates(table, targets, tolerance=tolerance, fixed=fixed, most=math.inf if fixed is None else 1.0)
    if missed := {d: m for d, m in zip(model.domains, off, strict=False) if m >= tolerance}:
        warnings.warn("targets not met, by a share of each: " + ", ".join(f"{d} {m:.2g}" for d, m in missed.items()), stacklevel=2)
    if off:
        misfit = F.create_map(*[x for d, m in zip(model.domains, off, strict=True) for x in (F.lit(d), F.lit(m))])
    return table.select("doc_id", "tokens", "domain", "p", "rate", misfit.alias("misfit"))


def label_domains(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` -> (doc_id, domain): toxic, else low, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality").isNotNull(), "clean")
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
