import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callweave.operators import coded, graph, learning, sequences
from callweave.plans import adapter, catalog_queries

ODD = [None, "", "1 2\n3", "One", "a a a", "abcdefghij abcdefghi abcdefgh\nabcdefghij\n\nabcdefghijklmnopqrst x abcdefghijklmnopqrsu", "é aKb", "x\ry z", "\n\nb"]


def texts(n: int = 6, words: int = 250, size: int = 400) -> list:
    """Odd texts, and some of more known words than are searched at once."""
    deal = random.Random(5)
    pool = ["".join(deal.choices("abcde", k=deal.choice((1, 2, 8, 9, 17)))) for _ in range(words)]
    return ODD + [" ".join(deal.choices(pool, k=size)).replace(f" {pool[0]} ", "\n") for _ in range(n)]


def plain(text: str | None) -> list[list[str]]:
    return [re.findall("[a-z]+", x.lower()) for x in (text or "").split("\n")]


def known(rows: list, every: int = 2) -> list[str]:
    return sorted({x for t in rows for ws in plain(t) for x in ws})[::every]


def pairs(text: str | None) -> list[tuple[str, str]]:
    return sorted({p for ws in plain(text) for p in zip(ws, ws[1:], strict=False)})


def table(spark, tmp_path, rows: list, labels: tuple = ()):
    """A folder of documents and labels; ``rows`` hold texts or (id, text)."""
    docs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_words_and_distances():
    rows = texts()
    w = coded.Words(pa.array([(t or "").lower() for t in rows]), known(rows))
    got = [[] for _ in rows]
    for d, line, name in zip(w.doc, w.line, w.names(w.code), strict=True):
        got[d].append((line, name))
    assert got == [[(i, x) for i, ws in enumerate(plain(t), 1) for x in ws] for t in rows]
    g = coded.Graphs(w)
    assert g.rank.max() > 64
    close, harm = coded.distances(g)
    names = known(rows)
    for d, t in enumerate(rows):
        pdf = pd.DataFrame(pairs(t), columns=["src", "dst"])
        mine = g.doc[g.wanted] == d
        if not len(pdf):
            assert not mine.any()
            continue
        nodes, s, e = graph._index(pdf)
        want = [dict(zip(nodes, v, strict=True)) for v in graph._distances(len(nodes), s, e)]
        found = [names[i] for i in g.api[g.wanted[mine]]]
        assert sorted(found) == sorted(set(nodes) & set(names))
        assert close[mine].tolist() == [want[0][x] for x in found] and harm[mine].tolist() == [want[1][x] for x in found]


@pytest.mark.parametrize("metric", ["closeness", "harmonic"])
def test_distance_queries(spark, tmp_path, metric):
    """Against the general operator; the query shuffles no graph. Rows of one id are one sample."""
    rows = texts(2)
    d = table(spark, tmp_path, [*enumerate(rows), (len(rows) - 1, "one more\nline one")])
    got = catalog_queries.queries()[f"centrality_{metric}"](spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    edges = [(i, *p) for i, t in enumerate(rows) for p in pairs(f"{t}\none more\nline one" if i == len(rows) - 1 else t)]
    edges = spark.createDataFrame(edges, "sample_id long, src string, dst string")
    want = graph.features(edges, adapter.catalog(spark, d), spark.range(len(rows)).withColumnRenamed("id", "sample_id"), metric)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, round(c, 9)) for a, b, c in want.collect())


def test_harmonic_of_many_callers():
    """More than 255 nodes of a sample come at one step; their counters are bytes."""
    names = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(700)]
    text = "\n".join(f"x{n} hub" for n in names) + "\nhub tail"
    w = coded.Words(pa.array([text, "hub hub", text]), ["hub", "tail"])
    close, harm = coded.distances(coded.Graphs(w))
    assert harm.tolist() == [700, 351, 0, 700, 351]
    assert close.tolist() == [700 / 700 * 700 / 701, 701 / 1401 * 701 / 701, 0, 700 / 700 * 700 / 701, 701 / 1401 * 701 / 701]


def test_path_cover_query(spark, tmp_path):
    """Against contraction and cover of the general operators; the query shuffles no graph."""
    rows = texts(2)
    d = table(spark, tmp_path, [*enumerate(rows), (0, "one 2 two")])
    got = catalog_queries.queries()["path_cover"](spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan
    edges = [(i, *p) for i, t in enumerate(rows) for p in pairs("one 2 two" if i == 0 else t)]
    edges, cat = spark.createDataFrame(edges, "sample_id long, src string, dst string"), adapter.catalog(spark, d)
    want = graph.path_cover(graph.contract(edges, cat), graph.present(edges, cat))
    assert sorted(map(tuple, got.collect())) == sorted((r[0], " ".join(map(str, r[1]))) for r in want.collect())


def test_contraction_in_parts():
    """More known words than are searched at once, half of the words outside."""
    rows = texts()
    names = known(rows)
    g = coded.Graphs(coded.Words(pa.array([(t or "").lower() for t in rows]), names))
    got, ids = list(zip(*(x.tolist() for x in coded.contracted(g)), strict=True)), {x: i for i, x in enumerate(names)}
    want = []
    for i, t in enumerate(rows):
        if e := pairs(t):
            pdf = pd.DataFrame([(i, a, b, ids.get(a), ids.get(b)) for a, b in e], columns=["sample_id", "src", "dst", "src_id", "dst_id"])
            want += graph._contract(pdf).itertuples(index=False, name=None)
    assert got == sorted(want)


@pytest.mark.parametrize("share", [1, 5])
def test_values_of_similar_lines(spark, share):
    """Against the general operator, with copies of lines, also such as are not similar to themselves, and many lines."""
    deal = random.Random(share)
    names = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(40)]
    draw = lambda: " ".join(deal.choices(names, k=deal.choice((1, 1, 2, 6))))
    rows = ["\n".join(draw() for _ in range(n)) for n in (1, 3, 20, 90, 400)] + ["b b b b\nb b b b\nc", "\n".join(["b b b b", "c", "c b"] * 40), "\n".join(["b b b b", "c c c c"] * 40), "?", ""]
    weights = [deal.choice((0, 3, 10, 500 // share)) for _ in names]
    got = coded.merged_values(spark.createDataFrame(list(enumerate(rows)), "sample_id long, text string"), names, weights)
    ids = {x: i + 1 for i, x in enumerate(names)}
    items = [(d, i, p, ids[x]) for d, t in enumerate(rows) for i, ws in enumerate(plain(t), 1) for p, x in enumerate(ws) if x in ids]
    items = spark.createDataFrame(items, "sample_id long, seq_id int, pos int, api_id int")
    want = sequences.merged_values(items, spark.createDataFrame(list(enumerate(weights, 1)), "api_id int, w long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silhouette_of_equal_values(spark):
    """A value of most rows is ranked once, not sorted in one task; the mean is over all rows."""
    rows = spark.createDataFrame([(c, float(v)) for c, vs in enumerate(([1] * 500 + [2, 4, 4], [10, 11, 15, 15], [30])) for v in vs], "cluster int, value double")
    c, v = (np.array([r[i] for r in rows.collect()]) for i in (0, 1))
    far = abs(v[:, None] - v)
    mean = np.array([far[:, c == k].sum(axis=1) / (c == k).sum() for k in range(3)])
    a, b = (far * (c[:, None] == c)).sum(axis=1) / np.maximum(np.bincount(c)[c] - 1, 1), np.where(np.arange(3)[:, None] == c, np.inf, mean).min(axis=0)
    got = learning.silhouette(rows)
    assert got.first()[0] == pytest.approx(np.where(np.bincount(c)[c] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())
    few = learning._running(rows.groupBy("cluster", "value").agg(F.count("*").alias("n")).withColumn("part", F.lit(0)), "cluster", "part", ["value"], "value", "n")
    assert sorted((r["value"], r["i"], r["s"]) for r in few.where("cluster = 0").collect()) == [(1, 500, 500), (2, 501, 502), (4, 503, 510)]


def test_knn_by_cells(spark):
    """Many training vectors, copies and ties, in many cells or one; all folds at once as one by one. No bound on rows."""
    deal = random.Random(3)
    rows = [(i, deal.randrange(2), float(deal.choice((1, deal.randrange(30), deal.randrange(900)))), float(deal.randrange(12))) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id long, label int, x double, y double")
    assert not hasattr(learning, "KNN_ROWS")

    def votes(test, train):
        out = {}
        for i, _, *v in test:
            near = sorted((float(np.sqrt((v[0] - r[2]) ** 2 + (v[1] - r[3]) ** 2)), str(r[0]), r[1]) for r in train)[:3]
            w = [(float(d == 0), y) for d, _, y in near] if near[0][0] == 0 else [(1 / d, y) for d, _, y in near]
            out[i] = sum(a for a, y in w if y) / sum(a for a, _ in w)
        return out

    want = votes(rows[:80], rows[80:])
    got = learning.knn(df.where("sample_id >= 80"), df.where("sample_id < 80"), ["x", "y"], 3, 20)
    assert {r["sample_id"]: r["score"] for r in got.collect()} == pytest.approx(want)
    fold = {r["sample_id"]: r["fold"] for r in learning.folds(df, 3).collect()}
    each = {r["fold"]: r["acc"] for r in learning.cross_validate(df, "knn", k=3)[0].collect()}
    for f in range(3):
        found = votes([r for r in rows if fold[r[0]] == f], [r for r in rows if fold[r[0]] != f])
        assert each[f] == pytest.approx(np.mean([(found[i] > 0.5) == rows[i][1] for i in found]))
