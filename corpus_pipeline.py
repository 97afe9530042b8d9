"""Corpus pipeline over documents: language ID, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmason.llm import langid, mixing, neardup, packing, suffixdedup
from gridmason.llm.common import by_ids, shuffled, stash
from gridmason.llm.queries import WEIGHTS, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: rejects text without a letter (null and empty text too), and long text that no language follows for even two characters on average.

    Each row by itself: null ids, repeated rows and ties stay as they are; without any labelled row all text is rejected; no rows give no rows.
    """
    told = langid.identify(docs.select(*COLUMNS), langid.fit(docs))
    return told.filter("lang_pred <> 'und' and not (length(text) >= 200 and phrases_per_char > 0.5)").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id (null last; of rows alike in it, any one).

    Rows are told apart by a key of their own, so that repeated rows and ids are copies like others, and rows with a null id stay if nothing
    else is like them. Null, empty and wordless texts are like nothing and stay. No rows give no rows.
    """
    rows = stash(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed")
    groups = neardup.link(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = shuffled(groups, rows.select("row", "doc_id"), "row").groupBy("component_id").agg(first.alias("m")).select(F.col("m.row").alias("row"))
    return by_ids(rows, stash(kept, "kept"), "row").select(*COLUMNS)


#: Noncharacters: stand for a U+FFFD of the text itself while broken characters are taken out.
OWN_MARK = "\ufdd0\ufdd1"


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occur earlier (a character cut at an edge goes whole); a text that is all repetition goes.

    Rows with a null id are left out by the operator and put back as they are. Null and short texts stay. Rows that repeat an id count as one document as to order. No rows give no rows.
    """
    found = suffixdedup.dedup(docs.select(*COLUMNS), length=100)
    text = F.replace(F.col("kept").cast("string"), F.lit("\ufffd"), F.lit(OWN_MARK))
    text = F.replace(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")), F.lit(OWN_MARK), F.lit("\ufffd"))
    text = F.when(F.col("n_removed") > 0, text).otherwise(F.col("text"))
    rows = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return rows.filter("not (n_removed > 0 and trim(text) = '')").select(*COLUMNS).unionAll(docs.filter("doc_id is null").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins the domains that exceed their weight beside clean text: documents likeliest clean stay and count in full; the rates of the others are fitted around them, and such a
    document stays if its hash, as a share of 1, is below its rate.

    Rows that repeat an id go or stay together; rows with a null id stay. No labelled rows: all stay. No rows give no rows. A target that cannot be met is warned of.
    """
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    told = mixing.mix(docs, labels, WEIGHTS, whole="clean")
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    gone = stash(told.filter((F.col("domain") != "clean") & (F.col("rate") < 0.999) & (share >= F.col("rate"))).select("doc_id").distinct(), "thinned")
    return by_ids(docs.select(*COLUMNS), gone, "doc_id", anti=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 1024 tokens. Null text is empty: a piece of one token; each row is packed, whatever its id. No rows give no rows."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]

#: Iterative and hashed stages: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
