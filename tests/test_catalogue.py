import duckdb
import pandas as pd
import pytest

from gridmason.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(p: pd.DataFrame):
    def v(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return x if isinstance(x, bool) else float(x) if isinstance(x, int | float) else str(x)

    cols = sorted(p.columns)
    return cols, sorted((tuple(v(x) for x in r) for r in p[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert plain(got) == plain(con.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_topics_of_odd_texts_and_repeated_ids(spark, tmp_path):
    """RE2 and Java differ in word edges, white space, line ends and in what has a case; the SQL ranks all rows of an id together."""
    texts = ["agent", "builder\x0bquality", "recommend the\nsector", "recommend a\u2028sector", "recommend a\rsector", "booking", "should i buy", "purchas", "emi", "home loan", "registry", "sohna\u3000road", "golf course\x0broad"]
    texts += [x for t in texts for x in (f"é{t}", f"{t}é", f"{t}\u0301", f"{t}٣", t.replace("s", "ſ"), t.replace("k", "\u212a"), t.replace("i", "ı"), t.replace("i", "İ"), f"{t}ſ", f"{t}\u212a", t.replace(" ", "\x0b"), t.upper())]
    rows = [*enumerate(texts), (9001, "rent rent metro"), (9001, "metro society rent"), (None, "rent"), (None, "metro metro"), (None, None), (9002, " ".join(catalogue.TOPICS).replace("_", " ")), (9002, "stamp duty stamp duty")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert plain(catalogue.doc_topics(spark, str(tmp_path)).toPandas()) == plain(c.sql(catalogue.ORACLES["doc_topics"]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns and set(entry.oracle_sql()) <= set(entry.queries())
