"""The domain's tables from documents and labels: a line of text is a sequence, a word an operation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import coded

CATALOG = 426


def samples(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(labels, "doc_id", "left").select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("label"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, seqs): the words of each line of a sample, one row for a sample; tokenised once in a session.

    Only runs of a to z count as words, so accented and other letters part them, as in the queries' SQL.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("sample_id"), "text").where("text is not null")
    words = F.transform(F.split("text", "\n"), lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0)))
    return docs.select("sample_id", words.alias("seqs")).persist()


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, seq_id, pos, api)."""
    rows = lines(spark, d).select("sample_id", F.posexplode("seqs").alias("i", "ws"))
    return rows.select("sample_id", (F.col("i") + 1).alias("seq_id"), F.posexplode("ws").alias("p", "api")).select("sample_id", "seq_id", (F.col("p") + 1).alias("pos"), "api")


def texts(spark: SparkSession, d: str, by_line: bool = False) -> DataFrame:
    """(sample_id, text): one row for a sample, so that what works on whole texts needs no shuffle.

    Rows that share an id are one sample: their lines follow each other or, ``by_line``, those of one number are one line.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("long").alias("sample_id"), "text")
    if docs.groupBy("sample_id").count().where("count > 1").isEmpty():
        return docs
    if by_line:
        parts = docs.select("sample_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x"))
        parts = parts.groupBy("sample_id", "i").agg(F.concat_ws(" ", F.collect_list("x")).alias("x"))
        sorted_ = F.array_sort(F.collect_list(F.struct("i", "x")))
        return parts.groupBy("sample_id").agg(F.array_join(F.transform(sorted_, lambda r: r["x"]), "\n").alias("text"))
    return docs.groupBy("sample_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """The words of most samples."""
    top = coded.words_of_samples(texts(spark, d)).orderBy(F.desc("n"), "api").limit(CATALOG)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "api")).alias("api_id"), "api").persist()


def known(spark: SparkSession, d: str) -> list[str]:
    """The catalogue's words by their ids: CATALOG at the most."""
    return [r["api"] for r in catalog(spark, d).orderBy("api_id").collect()]


def items(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, seq_id, pos, api_id)."""
    apis = F.broadcast(catalog(spark, d))  # CATALOG rows
    return tokens(spark, d).join(apis, "api").select("sample_id", "seq_id", "pos", "api_id").persist()


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, src, dst), distinct: words that follow each other, paired inside the row, so without a join or a shuffle."""

    def pairs(ws):
        return F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.size(ws)), lambda a, b: F.concat_ws(" ", a, b))

    both = F.array_distinct(F.flatten(F.transform("seqs", pairs)))
    rows = lines(spark, d).select("sample_id", F.explode(both).alias("e"))
    return rows.select("sample_id", F.substring_index("e", " ", 1).alias("src"), F.substring_index("e", " ", -1).alias("dst"))
