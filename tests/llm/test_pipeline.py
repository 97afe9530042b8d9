import importlib

import pytest

from gridmason.llm import common
from tests.llm.util import corpus, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows if i is not None], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    d = str(tmp_path)
    passage = words(5, 60)
    rows = [*corpus(80), (9001, words(71, 80) + " " + passage), (9002, words(72, 80) + " " + passage)]
    rows = list(dict(rows).items())
    docs_of(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), int(i % 10 == 0)) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "mixing", "best_fit_packing"]
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == COLUMNS
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {5001, 5002, 5003} & set(texts["language_id"]) and 5004 in texts["language_id"]
    assert 5005 in texts["minhash_near_dedup"] and 5006 not in texts["minhash_near_dedup"]
    assert passage in texts["minhash_near_dedup"][9002] and passage not in texts["suffix_array_dedup"][9002]
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    packed = corpus_pipeline.run(spark, d)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns) and {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts["mixing"])


def test_repeated_rows_and_null_ids_in_stages(spark, tmp_path):
    a, b, c = words(201, 60), words(202, 60), words(203, 60)
    near = a.split()
    near[3] = "other"
    rows = [(5, a), (5, a), (7, " ".join(near)), (None, a), (None, b), (9, c), (9, words(204, 60)), (11, c), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (None, b), (9, c), (9, words(204, 60)), (3, None), (4, "")], key=str)


def test_what_near_duplicates_broadcasts(spark, tmp_path, monkeypatch):
    """Kept rows are nearly all rows: the driver holds bits, not a relation of their ids."""
    rows = [(i, words(20_000 + i, 8)) for i in range(640)]
    sent, broadcast = [], common.F.broadcast
    monkeypatch.setattr(common.F, "broadcast", lambda df: sent.append(df.count()) or broadcast(df))
    got = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows).coalesce(1), str(tmp_path))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(640))
    assert max(sent) <= 10 + 1


def test_near_duplicates_joins_rows_without_broadcast(spark, tmp_path, monkeypatch):
    plans, stash = {}, corpus_pipeline.stash
    monkeypatch.setattr(corpus_pipeline, "stash", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and stash(df, label))
    corpus_pipeline.near_duplicates(spark, docs_of(spark, [(i, words(i, 9)) for i in range(20)]), str(tmp_path))
    assert "Join" in plans["kept"] and "Broadcast" not in plans["kept"]


@pytest.mark.parametrize("most", [0, 10**6])
def test_rows_by_ids(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_MASKS", most)
    ids = [-(2**63), -65, -64, -1, 0, 63, 64, 129, 2**40 + 7, 2**63 - 1]
    rows = [*ids, -66, -2, 1, 62, 65, 128, 2**40 + 8, 2**63 - 2, 0, 1, None]
    docs = spark.createDataFrame([(i, str(i)) for i in rows], "doc_id long, text string")
    asked = spark.createDataFrame([(i,) for i in [*ids, 63, 63, None]], "doc_id long")
    found, rest = common.by_ids(docs, asked, "doc_id"), common.by_ids(docs, asked, "doc_id", anti=True)
    assert found.columns == rest.columns == ["doc_id", "text"]
    assert sorted(r["text"] for r in found.collect()) == sorted(str(i) for i in rows if i in ids)
    assert sorted(r["text"] for r in rest.collect()) == sorted(str(i) for i in rows if i not in ids)
    assert common.by_ids(docs, asked.limit(0), "doc_id").count() == 0 and common.by_ids(docs, asked.limit(0), "doc_id", anti=True).count() == len(rows)


def test_passages_leave_replacement_characters(spark, tmp_path):
    passage = words(55, 60, "éàüöñ")
    texts = [(1, "x" + passage + " end"), (2, "a\ufffdb " + passage + " \ufffd rest")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs_of(spark, texts), str(tmp_path)).collect()}
    assert got[1] == texts[0][1] and got[2].startswith("a\ufffdb") and got[2].endswith("\ufffd rest") and got[2].count("\ufffd") == 2 and "ü" not in got[2]
    assert corpus_pipeline.repeated_passages(spark, docs_of(spark, [(None, "x")]).limit(0), str(tmp_path)).count() == 0


def test_mixture_thins_what_is_not_clean(spark, tmp_path):
    rows, labels = [], []
    for i in range(400):
        kind = "toxic" if i % 4 == 0 else "low" if i % 4 == 1 else "clean"
        rows.append((i, words(9000 + i, 40) + {"toxic": " vile rotten scum", "low": " %%% ### ***", "clean": ""}[kind]))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.mixture(spark, docs_of(spark, rows), str(tmp_path)).collect()}
    assert {i for i in range(400) if i % 4 >= 2} <= got
    assert sum(i % 4 == 0 for i in got) < 20 and 5 < sum(i % 4 == 1 for i in got) < 50


def test_empty_documents(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
