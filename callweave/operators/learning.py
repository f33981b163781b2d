"""Clustering of values, joins of feature sources, folds, classifiers and metrics."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType
from pyspark.sql.window import Window

from ..functions.names import normal_label


#: Training vectors from which kNN takes the bounds of its cells; all rows are searched.
KNN_SAMPLE = 20_000


def fit_centers(values: DataFrame, k: int = 2000, seed: int = 42) -> list[float]:
    """Ascending centres; k bounds what returns."""
    rows = values.groupBy("value").agg(F.count("*").cast("double").alias("n"))
    model = KMeans(k=k, seed=seed, weightCol="n").fit(VectorAssembler(inputCols=["value"], outputCol="features").transform(rows))
    return sorted(float(c[0]) for c in model.clusterCenters())


def assign_cluster(values: DataFrame, centers: list[float]) -> DataFrame:
    """Nearest centre by midpoints; ties go to the lower one."""
    mids = F.array(*[F.lit((a + b) / 2) for a, b in zip(centers, centers[1:], strict=False)]) if len(centers) > 1 else F.array().cast("array<double>")
    return values.withColumn("cluster", F.size(F.filter(mids, lambda m: m < F.col("value"))))


def histogram(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("sample_id", "cluster").agg(F.count("*").alias("n"))


def cluster_summary(assigned: DataFrame, centers: list[float]) -> DataFrame:
    spark = assigned.sparkSession
    all_ = spark.createDataFrame(list(enumerate(centers)), "cluster int, center double")
    per = assigned.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("value").alias("avg_value"))
    return all_.join(per, "cluster", "left").select("cluster", F.coalesce("size", F.lit(0)).alias("size"), F.round("avg_value", 6).alias("avg_value"), F.round("center", 6).alias("center"))


def _running(df: DataFrame, group: str, bucket: str, order: list, total: str | None = None, count: str | None = None) -> DataFrame:
    """``df`` with ``i`` (place in the group, from 1) and, of ``total``, the running sum ``s``; a row stands for ``count`` ones.

    ``bucket`` follows the order and parts a group, so a large group is dealt over tasks: its buckets' counts and sums, few
    rows, carry over.
    """
    n = F.col(count) if count else F.lit(1)
    sums = [F.sum(n).alias("bn")] + ([F.sum(n * F.col(total)).alias("bt")] if total else [])
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(group, bucket).agg(*sums)
    base = base.select(group, bucket, F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bi"), *([F.coalesce(F.sum("bt").over(before), F.lit(0.0)).alias("bs")] if total else []))
    by = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("i", F.sum(n).over(by))
    if total:
        out = out.withColumn("s", F.sum(n * F.col(total)).over(by))
    out = out.join(F.broadcast(base), [group, bucket]).withColumn("i", F.col("i") + F.col("bi")).drop("bi")  # groups x 1,024 rows
    return (out.withColumn("s", F.col("s") + F.col("bs")).drop("bs") if total else out).drop(bucket)


def silhouette(assigned: DataFrame) -> DataFrame:
    """(silhouette): exact mean over all values; clusters are intervals, so neighbours decide.

    Equal values have one score, so each is ranked once, whatever its number.
    """
    values = assigned.groupBy("cluster", "value").agg(F.count("*").alias("n")).persist()
    per = values.groupBy("cluster").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("value")).alias("t"), F.min("value").alias("least"), F.max("value").alias("most"))
    order = Window.orderBy("cluster")  # as many rows as clusters
    mean = F.col("t") / F.col("m")
    per = per.withColumn("lo", F.lag(mean).over(order)).withColumn("hi", F.lead(mean).over(order))
    part = F.coalesce(F.floor(F.try_divide((F.col("value") - F.col("least")) * 1023, F.col("most") - F.col("least"))), F.lit(0)).cast("int")
    x = values.join(F.broadcast(per), "cluster").withColumn("part", part)
    x = _running(x, "cluster", "part", ["value"], "value", "n")
    v = F.col("value")
    a = ((2 * F.col("i") - F.col("m")) * v + F.col("t") - 2 * F.col("s")) / (F.col("m") - 1)
    b = F.least(v - F.col("lo"), F.col("hi") - v)
    score = F.when(F.col("m") == 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    return x.select(score.alias("z"), "n").agg(F.try_divide(F.sum(F.col("z") * F.col("n")), F.sum(F.when(F.col("z").isNotNull(), F.col("n")))).alias("silhouette"))


def choose_k(values: DataFrame, least: int, most: int, sample: int = 20_000, seed: int = 42) -> int:
    """k of the best silhouette on a bounded sample; ties keep the smaller k."""
    few = values.orderBy(F.xxhash64("value", F.lit(seed))).limit(sample).select("value").cache()
    n = few.count()
    if n < 3:
        return max(1, min(least, n))
    best = (-math.inf, max(2, least))
    for k in range(max(2, least), min(most, n - 1) + 1):
        z = silhouette(assign_cluster(few, fit_centers(few, k, seed))).first()["silhouette"]
        if z is not None and z > best[0]:
            best = (z, k)
    few.unpersist()
    return best[1]


def join_features(sources: list[DataFrame], policy: str = "first", drop_unlabeled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(joined, conflicts) of sources (sample_id, label, features...) with one row per id each."""
    how = {"inner": "inner", "outer": "full", "first": "left"}[policy]
    out, conflicts = sources[0], None
    for i, right in enumerate(sources[1:], 1):
        both = out.join(right.withColumnRenamed("label", "_new"), "sample_id", how)
        a, b = normal_label(F.col("label")), normal_label(F.col("_new"))
        bad = both.where(a != b).select("sample_id", a.alias("label"), b.alias("label_new"), F.lit(i).alias("source"))
        conflicts = bad if conflicts is None else conflicts.unionByName(bad)
        out = both.withColumn("label", F.coalesce("label", "_new")).drop("_new")
    features = [c for c in out.columns if c not in ("sample_id", "label")]
    out = out.withColumn("label", normal_label(F.col("label")))
    if policy == "first":
        out = out.na.fill(0, features)
    return (out.where("label is not null") if drop_unlabeled else out), conflicts


def first_rows(df: DataFrame, order: str) -> DataFrame:
    by = Window.partitionBy("sample_id").orderBy(order)
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def folds(samples: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(sample_id, label, fold): stratified, by hash order; a class is ranked in 1,024 parts of the hash's range."""
    mark = F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(f"#{seed}")).cast("binary"))
    rows = samples.where("label in (0, 1)").select("sample_id", "label", mark.alias("mark"))
    rows = rows.withColumn("part", F.floor(F.conv(F.substring("mark", 1, 3), 16, 10).cast("int") / 4).cast("int"))
    return _running(rows, "label", "part", ["mark", "sample_id"]).select("sample_id", "label", ((F.col("i") - 1) % k).cast("int").alias("fold"))


def fold_average(rates: DataFrame) -> DataFrame:
    """One row: the mean of each column over folds, without null and NaN; null where no fold has a value."""
    return rates.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(c) for c in rates.columns if c != "fold"])


def _cells(sample: np.ndarray, cells: int) -> list:
    """Nodes (axis, threshold, left, right), of a leaf (-1, 0, its number, 0): halves at medians, widest axis first."""
    nodes, todo, leaves = [(-1, 0.0, 0, 0)], deque([(0, sample)]), 1
    while todo and leaves < cells:
        at, x = todo.popleft()
        wide = np.ptp(x, axis=0) if len(x) > 1 and x.shape[1] else np.zeros(1)
        axis = int(np.argmax(wide))
        if not wide[axis] > 0:
            continue
        v = np.sort(x[:, axis])
        edge = float(v[(len(v) - 1) // 2])
        edge = edge if edge < v[-1] else float(v[v < v[-1]][-1])
        n = len(nodes)
        nodes += [(-1, 0.0, nodes[at][2], 0), (-1, 0.0, leaves, 0)]
        nodes[at] = (axis, edge, n, n + 1)
        leaves += 1
        left = x[:, axis] <= edge
        todo += [(n, x[left]), (n + 1, x[~left])]
    return nodes


def _place(nodes: list, x: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        axis, edge, left, right = nodes[at]
        if axis < 0:
            out[rows] = left
        elif len(rows):
            low = x[rows, axis] <= edge
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _reached(nodes: list, x: np.ndarray, most: np.ndarray, own: np.ndarray) -> list[list[int]]:
    """Of each row, the other cells that may hold a point as near as ``most``."""
    out, todo = [[] for _ in x], [(0, np.arange(len(x)), np.zeros(x.shape))]
    while todo:
        at, rows, off = todo.pop()
        axis, edge, left, right = nodes[at]
        if axis < 0:
            for i in rows[own[rows] != left].tolist():
                out[i].append(left)
            continue
        for to, gap in ((left, x[rows, axis] - edge), (right, edge - x[rows, axis])):
            far = off.copy()
            far[:, axis] = np.maximum(far[:, axis], gap)
            near = np.sqrt((far**2).sum(axis=1)) <= most[rows] * (1 + 1e-9)
            if near.any():
                todo.append((to, rows[near], far[near]))
    return out


def _nearest(train: DataFrame, asked: DataFrame, k: int, block: int) -> DataFrame:
    """(v, part, best): for each distinct (v, part) of ``asked`` the k nearest of ``train`` (part, v, id, y) of other parts, ties by id.

    Training vectors lie in cells of about ``block``, bounded by a sample. Each asked vector searches its own cell, then those
    that may hold one as near as its k-th so far, so the result is exact. Of equal training vectors k of each part are kept.
    """
    by = Window.partitionBy("v", "part").orderBy("id", "y")
    few = train.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k).groupBy("v", "part").agg(F.collect_list(F.struct("id", "y")).alias("ids")).persist()
    n = few.count()
    sample = [r["v"] for r in few.select("v").orderBy(F.xxhash64("v"), "v").limit(KNN_SAMPLE).collect()] if n > block else []
    nodes = _cells(np.array(sample, float), -(-n // block)) if sample else [(-1, 0.0, 0, 0)]
    cell = F.pandas_udf(lambda v: pd.Series(_place(nodes, np.stack(v.to_numpy()) if len(v) else np.empty((0, 0)))), "int")
    few, todo = few.withColumn("cell", cell("v")), asked.select("v", "part").distinct().withColumn("cell", cell("v"))
    kind = "v array<double>, part int, best array<struct<d:double,id:string,y:int>>"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"v": right["v"], "part": right["part"], "best": pd.Series([[] for _ in range(len(right))], right.index, object)})
        own = np.repeat(np.arange(len(left)), [len(r) for r in left["ids"]])
        ids, y = [r["id"] for rs in left["ids"] for r in rs], [r["y"] for rs in left["ids"] for r in rs]
        x, part = np.stack(left["v"].to_numpy())[own], left["part"].to_numpy()[own]
        step, out = max(1, 2_000_000 // len(own)), []
        for lo in range(0, len(right), step):
            some = right.iloc[lo : lo + step]
            v, q = np.stack(some["v"].to_numpy()), some["part"].to_numpy()
            d = sum(((x[:, j] - v[:, j, None]) ** 2 for j in range(x.shape[1])), np.zeros((len(v), len(x))))
            d = np.where(part == q[:, None], np.inf, np.sqrt(d))
            edges = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            for row, edge in zip(d, edges, strict=True):
                got = sorted((float(row[j]), ids[j], int(y[j])) for j in np.flatnonzero((row <= edge) & (row < np.inf)))[:k]
                out.append([{"d": a, "id": b, "y": c} for a, b, c in got])
        return pd.DataFrame({"v": right["v"], "part": right["part"], "best": pd.Series(out, right.index, object)})

    def further(batches):
        for b in batches:
            if len(b):
                most = np.array([r[-1]["d"] if len(r) >= k else np.inf for r in b["best"]])
                x = np.stack(b["v"].to_numpy())
                b["cells"] = pd.Series(_reached(nodes, x, most, _place(nodes, x)), b.index, object)
                yield b[["v", "part", "cells"]]

    with_cell = lambda df: few.groupBy("cell").cogroup(df.groupBy("cell")).applyInPandas(search, kind)
    first = with_cell(todo).persist()
    more = first.mapInPandas(further, "v array<double>, part int, cells array<int>").select("v", "part", F.explode("cells").alias("cell"))
    found = first.unionByName(with_cell(more)) if len(nodes) > 1 else first
    return found.groupBy("v", "part").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _voted(train: DataFrame, test: DataFrame, features: list[str], k: int, block: int, part: str | None = None) -> DataFrame:
    """``test``'s sample_id, label, prediction and score, and ``part``: rows of its own part are no neighbours."""

    def fine(df: DataFrame, own: Column) -> DataFrame:
        v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).cast("array<double>")
        return df.where("label in (0, 1)").select("sample_id", F.col("label").cast("int").alias("label"), v.alias("v"), own.cast("int").alias("part"))

    base = fine(train, F.col(part) if part else F.lit(-1))
    asked = fine(test, F.col(part) if part else F.lit(-2)).persist()
    finite = F.forall("v", lambda x: F.abs(x) < float("inf"))
    points = base.where(finite).select("v", "part", F.col("sample_id").cast("string").alias("id"), F.col("label").alias("y"))
    near = _nearest(points, asked.where(finite), k, block)
    found = asked.join(near, ["v", "part"], "left").withColumn("best", F.coalesce("best", F.array().cast("array<struct<d:double,id:string,y:int>>")))
    same = F.filter("best", lambda r: r["d"] == 0)
    votes = F.when(F.size(same) > 0, F.transform(same, lambda r: F.struct(F.lit(1.0).alias("w"), r["y"].alias("y")))).otherwise(F.transform("best", lambda r: F.struct((1 / r["d"]).alias("w"), r["y"].alias("y"))))
    found = found.withColumn("votes", votes)
    total = lambda f: F.aggregate(f, F.lit(0.0), lambda a, r: a + r["w"])
    share = F.coalesce(F.try_divide(total(F.filter("votes", lambda r: r["y"] == 1)), total(F.col("votes"))), F.lit(0.0))
    return found.select("sample_id", "label", (share > 0.5).cast("int").alias("prediction"), share.alias("score"), *([F.col("part").alias(part)] if part else []))


def knn(train: DataFrame, test: DataFrame, features: list[str], k: int = 3, block: int = 2000) -> DataFrame:
    """(sample_id, label, prediction, score) of test rows by their k nearest train rows, each voting by inverse distance.

    A row at distance 0 leaves the vote to those at 0. Ties of distance go to the smaller id, of votes to class 0. Rows with
    a feature that is not finite are no neighbours and get 0. Any number of rows: see ``_nearest``.
    """
    return _voted(train, test, features, k, block)


def cross_validate(rows: DataFrame, fit_and_rate, k: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rates by fold, their average): ``fit_and_rate(train, test)`` gives a row of metrics; folds whose train part lacks a class are skipped.

    With "knn" for it, all folds are searched at once.
    """
    rows = rows.persist()
    dealt = rows.join(folds(rows, k, seed).select("sample_id", "fold"), "sample_id").persist()
    sizes = {(r["fold"], r["label"]): r["count"] for r in dealt.groupBy("fold", "label").count().collect()}
    all_ = sorted({f for f, _ in sizes})
    good = [f for f in all_ if len({y for g, y in sizes if g != f}) > 1]
    out = None
    if fit_and_rate == "knn" and good:
        out = metrics(_voted(dealt, dealt.where(F.col("fold").isin(good)), _numeric(dealt.drop("fold")), 3, 2000, "fold"), "fold")
    for f in good if out is None else ():
        one = fit_and_rate(dealt.where(F.col("fold") != f).drop("fold"), dealt.where(F.col("fold") == f).drop("fold")).withColumn("fold", F.lit(f))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = metrics(rows.where("false").select("label", F.col("label").alias("prediction"))).where("false").withColumn("fold", F.lit(0))
    return out, fold_average(out)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in ("sample_id", "label") and isinstance(f.dataType, (NumericType, BooleanType))]


def metrics(predicted: DataFrame, *by: str) -> DataFrame:
    """The eight rates of (label, prediction), and then ``by``; the four rates of classes are null without a case."""
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("prediction") == p))
    c = predicted.groupBy(*by).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))
    d = lambda a, b: F.try_divide(F.expr(a), F.expr(b))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return c.select(
        d("tp + tn", "tp + tn + fp + fn").alias("acc"), d("tp", "tp + fn").alias("tpr"), d("tn", "tn + fp").alias("tnr"), d("fp", "tn + fp").alias("fpr"),
        d("fn", "tp + fn").alias("fnr"), z(d("tp", "tp + fp")).alias("precision"), z(d("tp", "tp + fn")).alias("recall"), z(d("2 * tp", "2 * tp + fp + fn")).alias("f1"), *by,
    )


def classifier(kind: str = "xgb", seed: int = 42):
    made = {
        "rf": lambda: RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed),
        "et": lambda: RandomForestClassifier(numTrees=100, maxDepth=30, bootstrap=False, maxBins=8, seed=seed),
        "gbdt": lambda: GBTClassifier(maxIter=100, stepSize=0.1, maxDepth=3, seed=seed),
        "xgb": lambda: GBTClassifier(maxIter=300, stepSize=0.08, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed),
    }
    if kind not in made:
        raise ValueError(f"unknown model {kind}")
    return made[kind]()


def evaluate(train: DataFrame, test: DataFrame, kind: str = "xgb", seed: int = 42) -> DataFrame:
    """Fit on train's numeric features, missing test columns are 0, and give the metrics of test."""
    names = _numeric(train)
    for c in names:
        if c not in test.columns:
            test = test.withColumn(c, F.lit(0.0))
    if kind == "knn":
        return metrics(knn(train, test, names))
    make = VectorAssembler(inputCols=names, outputCol="features").transform
    fine = lambda df: make(df.where("label in (0, 1)").na.fill(0, names))
    return metrics(classifier(kind, seed).fit(fine(train)).transform(fine(test)))
