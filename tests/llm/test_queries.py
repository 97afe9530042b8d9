"""Each opN query itself, over a small data set: its contract, against SQL or brute force where the operator's own tests do not look."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridmason.llm import queries as q
from tests.conftest import SF
from tests.llm.test_text_ops import groups, removed


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def ids_of(name, text):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in q.op1_cross_parsing_langid(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in docs} and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (crc(i, 4) == 2) for i, r in got.items())
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in docs if r["lang"] and got[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_op2(spark, docs):
    got = q.op2_bin_completion_packing(spark, SF).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d in docs:
        ids, at = ids_of("byte_bpe_50k.json", d["text"]), 0
        for n, r in enumerate(sorted(by_doc.pop(d["doc_id"]), key=lambda r: r["piece"])):
            part = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(np.array(part, "<u4").tobytes())) and (n == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or n == 0)
    assert not by_doc
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r["length"] for r in got) // 1024) * 1.02 + 1


def test_op3(spark, docs):
    got = q.op3_hamming_neardup(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(tuple(r) for r in got) == groups([(r["doc_id"], r["text"]) for r in docs])


def test_op4(spark, docs):
    got = q.op4_weak_toxicity(spark, SF).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs}
    assert all(r["held_out"] == (crc(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_op5(spark, docs):
    got, at = q.op5_token_files(spark, SF).orderBy("start").collect(), 0
    for r, d in zip(got, sorted(docs, key=lambda d: d["doc_id"]), strict=True):
        ids = ids_of("word_bpe_49k.json", d["text"])
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6(spark, docs):
    got = {r["doc_id"]: r for r in q.op6_winnowing(spark, SF).collect()}
    rows = sorted(docs, key=lambda d: -d["doc_id"])
    for k, d in enumerate(rows):
        t, after = d["text"] or "", rows[(k + 1) % len(rows)]["text"] or ""
        r, half = got[d["doc_id"]], len(t) // 2
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert len(r["fingerprint"]) == 8 * len(r["positions"]) and 0 <= r["near_next"] <= 1 and (0 < r["near_edited"] <= 1 or len(t) < 100)
    same = {}
    assert all(same.setdefault(d["text"], got[d["doc_id"]]["fingerprint"]) == got[d["doc_id"]]["fingerprint"] for d in docs)


@pytest.mark.parametrize("name", ["op7_redirect_url_filter", "op8_pivot_topk"])
def test_op7_and_op8_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = [tuple(r[c] for c in columns) for r in q.queries()[name](spark, SF).collect()]
    assert Counter(rows) == Counter(want.fetchall())


def test_op9(spark, docs):
    got = q.op9_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == removed([(r["doc_id"], r["text"]) for r in docs], 100)


def test_op10(spark, docs):
    got = q.op10_soft_mixing(spark, SF).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs)
    total = sum(r["tokens"] for r in got)
    for j, d in enumerate(sorted(q.WEIGHTS)):
        aim = q.WEIGHTS[d] * total
        assert got[0]["misfit"][d] == pytest.approx(abs(sum(r["rate"] * r["tokens"] * r["p"][j] for r in got) - aim) / aim, abs=1e-6) and got[0]["misfit"][d] < 1e-3
