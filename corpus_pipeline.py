"""A corpus pipeline of five stages, each on all that the one before kept.

Defined results: null and empty texts go in the first stage, which has no language for
them; a null source is a source; rows without an id stay as they are; of repeated rows
one stays; texts of any length pass whole; ties are those of the operators; an empty table
gives an empty result; columns beyond those of documents are kept up to the last stage,
whatever their names, and change nothing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import langid, minhash, mixing, secret_scan, sentencepiece_bpe
from callweave.llm.common import fresh, shared_dir, table


#: Clean labelled texts of fewer letters come down to a cosine of 0.1, as do texts of other languages: they say too little.
#: Of longer labelled texts only such as repeat one or two words (0.09 to 0.2) fell below the bar in the tables looked at.
COSINE, LETTERS = 0.2, 60


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; learnt from the labelled ones. Undetermined texts go, and those far from all languages."""
    (mark,) = fresh(docs, "_lang_id")
    found = langid.predict(docs, langid.learn(docs), out_col=mark)
    near = (F.col(f"{mark}.score") >= COSINE) | (F.regexp_count("text", F.lit(r"\p{L}")) < LETTERS)
    return found.where((F.col(f"{mark}.lang") != "und") & near).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets struck out."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the whole text, their number, and the digest of the text decoded from them."""
    return sentencepiece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
