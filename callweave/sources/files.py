"""Readers and writers of the domain's files; Parquet is the exchange format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import label_nearest, sample_stem

_GRAPH = "graph struct<nodes struct<node array<struct<_id string, _label string>>>, edges struct<edge array<struct<_source string, _target string>>>>, bad string"


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), "value").withColumn("sample_id", sample_stem(F.col("path")))


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of plain and gzipped graphs."""
    raw = _files(spark, path, "*.[gG][eE][xX][fF]*")
    parsed = raw.withColumn("x", F.from_xml("value", _GRAPH, {"columnNameOfCorruptRecord": "bad"}))
    fine = parsed.where("x.bad is null and x.graph is not null").withColumn("label", label_nearest(F.col("path")))
    nodes = fine.select("sample_id", "label", F.posexplode("x.graph.nodes.node").alias("node_ord", "n")).select("sample_id", "label", "node_ord", F.col("n._id").alias("node"))
    edges = fine.select("sample_id", F.explode("x.graph.edges.edge").alias("e")).select("sample_id", F.col("e._source").alias("src"), F.col("e._target").alias("dst")).distinct()
    return nodes, edges, parsed.where("x.bad is not null or x.graph is null").select("sample_id", "path")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(api_id, api): trimmed, no blanks; the first occurrence keeps the id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.array_distinct(F.filter(F.transform(F.split("value", r"\r?\n"), F.trim), lambda x: x != ""))).alias("i", "api"))
    return lines.select((F.col("i") + 1).alias("api_id"), "api")


def read_sequences(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(sample_id, label, seq_id, api_ids); the first path of a sample wins; samples without lines keep one null row."""
    raw = _files(spark, path, "*.txt")
    # The scan leaves out empty files; the driver's file index, which it holds anyway, names them.
    named = spark.createDataFrame([(p,) for p in raw.inputFiles()], "path string")
    named = named.select("path", sample_stem(F.col("path")).alias("sample_id"), label_nearest(F.col("path")).alias("label"))
    plain = F.regexp_replace("path", "^([a-z0-9]+:)/+", "$1/").alias("path")  # file:/x and file:///x are one
    named = named.select(plain, "sample_id", "label")
    raw = named.join(raw.select(plain, "value"), "path", "left").withColumn("value", F.coalesce("value", F.lit("")))
    one = raw.groupBy("sample_id").agg(F.min(F.struct("path", "label", "value")).alias("f")).select("sample_id", "f.label", "f.value")
    lines = one.select("sample_id", "label", F.posexplode(F.split("value", "\n")).alias("seq_id", "line"))
    ids = F.transform(F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t.rlike("^[0-9]{1,9}$")), lambda t: t.cast("int"))
    kept = lines.select("sample_id", "seq_id", F.filter(ids, lambda i: (i >= 1) & (i <= size)).alias("api_ids")).where(F.size("api_ids") > 0)
    return one.select("sample_id", "label").join(kept, "sample_id", "left")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(api, weight): separator by the first line, any letter case in the header, bad numbers 0, the last row wins."""
    first = (spark.read.text(path).first() or [""])[0]
    sep = max(",;\t", key=first.count)
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    if not {"api", "weight"} <= names.keys():
        raise ValueError("api and weight are needed")
    rows = raw.select(F.trim(F.col(f"`{names['api']}`")).alias("api"), F.coalesce(F.col(f"`{names['weight']}`").try_cast("double"), F.lit(0.0)).alias("weight"), F.monotonically_increasing_id().alias("i"))
    return rows.where("api <> ''").groupBy("api").agg(F.max_by("weight", "i").alias("weight"))


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, values, label) of a table with a JSON array cell; elements that are no numbers are dropped."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    cells = F.try_parse_json("seq_values").try_cast("array<variant>")
    numbers = F.array_compact(F.transform(cells, lambda v: F.try_variant_get(v, "$", "double")))
    return raw.select(F.col("sha256").alias("sample_id"), F.coalesce(numbers, F.array().cast("array<double>")).alias("values"), F.coalesce(F.col("label").try_cast("int"), F.lit(-1)).alias("label"))


def write_sequences(seqs: DataFrame, path: str) -> None:
    seqs.select("sample_id", F.array_join("api_ids", " ").alias("value")).write.partitionBy("sample_id").text(path)


def write_wide(long: DataFrame, path: str, names: list[str], key: str = "sample_id", attr: str = "attr", value: str = "value") -> None:
    """Pivot over stated names and write CSV; missing cells are 0."""
    long.groupBy(key).pivot(attr, names).agg(F.first(value)).na.fill(0.0).write.option("header", True).csv(path)


def write_values(values: DataFrame, samples: DataFrame, path: str) -> None:
    got = values.groupBy("sample_id").agg(F.sort_array(F.collect_list("value"), asc=False).alias("v"))
    cell = F.to_json(F.coalesce("v", F.array().cast("array<double>")))
    samples.join(got, "sample_id", "left").select(F.col("sample_id").alias("sha256"), cell.alias("seq_values"), F.coalesce("label", F.lit(-1)).alias("label")).write.option("header", True).csv(path)


def pending(found: DataFrame, done: DataFrame, limit: int = 5000) -> DataFrame:
    """Samples not done yet, the first ``limit`` by id; 0 is no limit."""
    left = found.join(done.select("sample_id"), "sample_id", "left_anti").orderBy("sample_id")
    return left.limit(limit) if limit else left


def valid_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of application archives by their first bytes; nothing is deleted."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[aA][pP][kK]").load(path)
    rows = raw.select(sample_stem(F.col("path")).alias("sample_id"), "path", (F.substring("content", 1, 4) == F.lit(b"PK\x03\x04")).alias("ok"))
    return rows.where("ok").drop("ok"), rows.where("not ok").drop("ok")
