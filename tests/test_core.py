import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.functions.names import suffix
from callweave.operators import graph, learning, sequences
from callweave.plans import catalog_queries


def test_names(spark):
    got = {r["node"]: (r["seq_name"], r["feature_name"]) for r in catalog_queries.queries()["names"](spark, "").collect()}
    assert got["La/b/C;->access$12(I)I"] == ("a.b.C.access", "a.b.C.access$12")
    assert got["La/b/C;->m"] == (None, "a.b.C.m")


def test_suffix():
    assert [suffix(x) for x in ("a-b.csv", "--")] == ["a_b_csv", "src"]


def test_contraction_and_cover(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "api_id int, api string")
    edges = spark.createDataFrame([(1, *e) for e in ("ax", "xb", "xy", "yc", "ya", "bc")], "sample_id long, src string, dst string")
    small = graph.contract(edges, cat)
    assert sorted((r["src"], r["dst"]) for r in small.collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(r["api_ids"] for r in graph.path_cover(small).collect()) == [[1, 2, 3], [1, 3]]
    values = {m: [r["value"] for r in graph.centrality(small, m).orderBy("node").collect()] for m in ("katz", "pagerank", "authority", "harmonic", "closeness")}
    assert values["katz"] == pytest.approx([0.33665556, 0.33332233, 0.33002211], abs=1e-6)
    assert values["pagerank"] == pytest.approx([0.19757965, 0.28155100, 0.52086935], abs=1e-5)
    assert values["authority"] == pytest.approx([0, 0.38196601, 0.61803399], abs=1e-6)
    assert values["harmonic"] == [0, 1, 2] and values["closeness"] == [0, 0.5, 1]


def test_features_of_the_whole_graph(spark):
    """Nodes outside the catalogue count; names not in the graph and samples without edges get 0."""
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "api_id int, api string")
    edges = spark.createDataFrame([(1, *e) for e in ("ax", "xb", "xy", "yc", "ya", "bc")], "sample_id long, src string, dst string")
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    got = {m: [tuple(r) for r in graph.features(edges, cat, samples, m).orderBy("sample_id", "api_id").collect()] for m in ("degree", *graph.METRICS)}
    assert all(v[3:] == [(1, 4, 0.0)] + [(2, i, 0.0) for i in (1, 2, 3, 4)] for v in got.values())
    values = {m: [r[2] for r in v[:3]] for m, v in got.items()}
    assert values["degree"] == [0.5, 0.5, 0.5]
    # Distances to a: y 1, x 2; to b: x 1, a 2, y 3; to c: y 1, b 1, x 2, a 3.
    assert values["harmonic"] == pytest.approx([1.5, 11 / 6, 17 / 6])
    assert values["closeness"] == pytest.approx([2 / 3 * 2 / 4, 3 / 6 * 3 / 4, 4 / 7])
    x = np.linalg.solve(np.eye(5) - 0.01 * np.array([[0, 0, 0, 1, 0], [0, 0, 1, 0, 0], [0] * 5, [0, 1, 0, 0, 1], [1, 0, 1, 0, 0]]), np.ones(5))
    assert values["katz"] == pytest.approx((x / x.sum())[:3], abs=1e-6)


def test_features_of_one_name(spark):
    """Of two methods with one name the later node counts."""
    cat = spark.createDataFrame([(1, "a.B.m")], "api_id int, api string")
    edges = spark.createDataFrame([(1, "La/B;->m(I)V", "x"), (1, "y", "La/B;->m()V"), (1, "z", "La/B;->m()V")], "sample_id long, src string, dst string")
    nodes = spark.createDataFrame([(1, "La/B;->m(I)V", 9), (1, "La/B;->m()V", 2)], "sample_id long, node string, node_ord long")
    samples = edges.select("sample_id").distinct()
    assert [graph.features(edges, cat, samples, "harmonic", o).first()["value"] for o in (nodes, nodes.withColumn("node_ord", -F.col("node_ord")))] == [0.0, 2.0]


def test_isolated_nodes(spark):
    """Case 2.3 of FIXTURES with d isolated, and a sample whose catalogue nodes reach no other one."""
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "api_id int, api string")
    edges = [(1, *e) for e in ("ax", "xb", "xy", "yc", "ya", "bc")] + [(2, "a", "x"), (2, "a", "a"), (2, "y", "c")]
    edges = spark.createDataFrame(edges, "sample_id long, src string, dst string")
    nodes = spark.createDataFrame([(1, v) for v in "abcdxy"], "sample_id long, node string")
    there = graph.present(edges, cat, nodes)
    assert sorted(map(tuple, there.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 3)]
    cover = graph.path_cover(graph.contract(edges, cat), there)
    assert sorted((r["sample_id"], r["api_ids"]) for r in cover.collect()) == [(1, [1, 2, 3]), (1, [1, 3]), (1, [4]), (2, [1]), (2, [3])]


def test_prune(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (1, [1, 3]), (1, [2, 3]), (1, [12, 3])], "sample_id long, api_ids array<int>")
    assert sorted(r["api_ids"] for r in graph.prune(rows).collect()) == [[1, 2, 3], [1, 3], [12, 3]]


def test_merge(spark):
    items = spark.createDataFrame([(1, s, p, i) for s, ids in enumerate(([1, 2], [2, 3], [4], [1, 1, 3])) for p, i in enumerate(ids)], "sample_id long, seq_id int, pos int, api_id int")
    w = spark.createDataFrame([(1, 500), (2, 300), (3, 100), (4, 0)], "api_id int, w long")
    assert sorted((r["a"], r["b"]) for r in sequences.similar(items, w).collect()) == [(0, 1), (0, 3)]
    assert sorted(r["value"] for r in sequences.merged_values(items, w).collect()) == [0, 900]


def test_silhouette(spark):
    rows = spark.createDataFrame([(c, float(v)) for c, vs in enumerate(([1, 2, 4], [10, 11, 15], [30, 31])) for v in vs], "cluster int, value double")
    assert learning.silhouette(rows).first()[0] == pytest.approx(0.776558205)


def test_kmeans_histogram(spark, monkeypatch):
    """The query fits its centres to the values: here one for each of three groups."""
    rows = spark.createDataFrame([(s, float(v)) for s in (1, 2) for v in (1, 2, 10, 11, 30, 31)[: 6 if s == 1 else 3]], "sample_id long, value double")
    fit = learning.fit_centers
    monkeypatch.setattr(catalog_queries, "_values", lambda s, d: rows)
    monkeypatch.setattr(learning, "fit_centers", lambda values: fit(values, 3))
    got = catalog_queries.queries()["kmeans_histogram"](spark, "")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2), (1, 1, 2), (1, 2, 2), (2, 0, 2), (2, 1, 1)]


def test_metrics(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] + [(1, 0)] * 2 + [(1, 1)] * 4
    m = learning.metrics(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (m["acc"], m["precision"], round(m["f1"], 6)) == (0.75, 0.8, 0.727273)
    none = learning.metrics(spark.createDataFrame([(0, 0)], "label int, prediction int")).first()
    assert none["tpr"] is None and none["recall"] == 0


def test_knn(spark):
    """Against a vote counted by hand, with a row at distance 0 and a tie of distances."""
    train = spark.createDataFrame([(1, 0, 0.0), (2, 1, 2.0), (3, 1, 4.0), (4, 0, 100.0), (5, None, 3.0)], "sample_id long, label int, x double")
    test = spark.createDataFrame([(10, 1, 3.0), (11, 0, 0.0), (12, 1, 60.0)], "sample_id long, label int, x double")
    for block in (1, 2, 2000):
        got = {r["sample_id"]: (r["prediction"], round(r["score"], 6)) for r in learning.knn(train, test, ["x"], 3, block).collect()}
        # 10: distances 1, 1 (class 1) and 3 (class 0); 12: 40 (0), 56 (1), 58 (1).
        assert got == {10: (1, round(2 / (2 + 1 / 3), 6)), 11: (0, 0.0), 12: (1, round((1 / 56 + 1 / 58) / (1 / 40 + 1 / 56 + 1 / 58), 6))}


def test_folds_and_average(spark):
    samples = spark.createDataFrame([(i, i % 3 if i % 3 < 2 else None) for i in range(300)], "sample_id long, label int")
    got = learning.folds(samples, 10).groupBy("label", "fold").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {10}
    rates = spark.createDataFrame([(0, 0.5, None), (1, float("nan"), None), (2, 1.0, None)], "fold int, acc double, f1 double")
    assert tuple(learning.fold_average(rates).first()) == (0.75, None)
    rows = samples.withColumn("x", F.coalesce("label", F.lit(0)).cast("double"))
    each, mean = learning.cross_validate(rows.where("label is not null"), lambda a, b: learning.evaluate(a, b, "knn"), k=2)
    assert {r["acc"] for r in each.collect()} == {1.0} and mean.first()["acc"] == 1.0


def test_join(spark):
    p = spark.createDataFrame([("s1", 1, 1), ("s2", -1, 2)], "sample_id string, label int, f int")
    q = spark.createDataFrame([("s1", 0, 5), ("s3", 1, 7)], "sample_id string, label int, g int")
    got, bad = learning.join_features([p, q], "first")
    assert sorted(got.select("sample_id", "label", "f", "g").collect()) == [("s1", 1, 1, 5), ("s2", None, 2, 0)]
    assert [tuple(r) for r in bad.collect()] == [("s1", 1, 0, 1)]
    assert learning.join_features([p, q], "outer")[0].count() == 3


def test_readers(spark, tmp_path):
    from callweave.sources import files

    d = tmp_path / "x" / "malware"
    d.mkdir(parents=True)
    (d / "s1.txt").write_text("1 2\nfoo 9\n2\n")
    (d / "s2.txt").write_text("")
    got = files.read_sequences(spark, str(tmp_path), 3)
    assert sorted((r["sample_id"], r["label"], r["api_ids"]) for r in got.collect() if r["api_ids"]) == [("s1", 1, [1, 2]), ("s1", 1, [2])]
    assert {r["sample_id"] for r in got.collect()} == {"s1", "s2"}
    (d / "g.gexf").write_text('<gexf><graph><nodes><node id="a" label="a"/><node id="b" label="b"/></nodes><edges><edge source="a" target="b"/></edges></graph></gexf>')
    nodes, edges, rejects = files.read_gexf(spark, str(tmp_path))
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("a", "b")] and nodes.where(F.col("label") == 1).count() == 2 and rejects.count() == 0
