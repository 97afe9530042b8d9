"""Small corpora with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, bucket int, name string"


def words(seed, n, alphabet="abcdefghij"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))


def corpus(n=60, seed=1):
    """(doc_id, text): copies, near copies, shared passages, repeats within a text, nulls, empties, one very long text, a null id, repeated rows."""
    r = random.Random(seed)
    passage = words(99, 60)
    out = []
    for i in range(n):
        t = words(1000 + i, r.randint(3, 150))
        if i % 5 == 1:
            t = t + "\n" + passage
        if i % 7 == 2 and out:
            t = out[r.randrange(len(out))][1]
        if i % 9 == 4 and out:
            w = (out[i - 1][1] or "x").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        out.append((i * 3 - 20, t))
    out += [(5001, None), (5002, ""), (5003, "  \n"), (5004, "one"), (5005, "One two"), (5006, "one  TWO"), (5007, words(7, 30_000)), (5008, passage + " " + passage), (None, "no id"), (5009, "é" * 300), (5010, "ümlaut \x00 nul " * 40)]
    return [*out, out[3], out[3]]


def frame(spark, rows=None):
    rows = corpus() if rows is None else rows
    full = [(i, t, "en", "src", len(t or ""), "x", 0.5, 1, "n") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
