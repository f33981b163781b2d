"""Queries over the adapter's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import feature_name, label_any, label_nearest, seq_name
from ..operators import coded, graph, learning, sequences
from . import adapter

CENTERS = [0.0, 5e6, 2e7, 5e7, 1e8, 2e8, 4e8]
NODES = ["La/b/C;->m(I)V", "La/b/C$D;-><init>()V", "La/b/C;-><clinit>()V", "La/b/C;->access$12(I)I", " La/b/C;->m()V", "[La/b/C;->clone()Ljava/lang/Object;", "La/b/C;->m"]
PATHS = ["x/benign/a", "x/Malware/a", "x/malware/benign/a", "x/benign/malware/a", "x/other/a"]


def _weights(s: SparkSession, d: str) -> DataFrame:
    apis = coded.apis_of_samples(adapter.texts(s, d), adapter.known(s, d))
    return sequences.api_weights(apis.select("sample_id", "api_ids"), adapter.samples(s, d))


def _w(s: SparkSession, d: str) -> DataFrame:
    return sequences.quantised(_weights(s, d))


def _values(s: SparkSession, d: str) -> DataFrame:
    known, weights = adapter.known(s, d), {r["api_id"]: r["w"] for r in _w(s, d).collect()}
    return coded.merged_values(adapter.texts(s, d, by_line=True), known, [weights.get(i + 1, 0) for i in range(len(known))])


def _assigned(s: SparkSession, d: str) -> DataFrame:
    return learning.assign_cluster(_values(s, d).select("sample_id", F.col("value").cast("double").alias("value")), CENTERS)


def _fitted_histogram(s: SparkSession, d: str) -> DataFrame:
    values = _values(s, d).select("sample_id", F.col("value").cast("double").alias("value")).cache()
    return learning.histogram(learning.assign_cluster(values, learning.fit_centers(values)))


def _contracted(s: SparkSession, d: str) -> DataFrame:
    return graph.contract(adapter.edges(s, d), adapter.catalog(s, d))


def _features(s: SparkSession, d: str, metric: str) -> DataFrame:
    if metric in ("closeness", "harmonic"):
        return coded.centrality(adapter.texts(s, d), adapter.known(s, d), metric)
    return graph.features(adapter.edges(s, d), adapter.catalog(s, d), adapter.samples(s, d), metric)


def _present(s: SparkSession, d: str) -> DataFrame:
    return graph.present(adapter.edges(s, d), adapter.catalog(s, d))


def _ids(s: SparkSession, d: str) -> DataFrame:
    rows = adapter.items(s, d).groupBy("sample_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "api_id"))).alias("x"))
    return rows.select("sample_id", "seq_id", F.col("x.api_id").alias("api_ids"))


def _lines(df: DataFrame) -> DataFrame:
    return df.withColumn("api_ids", F.array_join("api_ids", " "))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sources(s: SparkSession, d: str) -> list[DataFrame]:
    size = coded.apis_of_samples(adapter.texts(s, d), adapter.known(s, d)).select("sample_id", "n_items")
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("sample_id"), "n_chars")
    labels = s.read.parquet(f"{d}/labels.parquet")
    left = labels.select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("label")).join(docs, "sample_id")
    right = size.join(labels.select(F.col("doc_id").alias("sample_id"), (1 - F.col("quality")).alias("label")), "sample_id", "left")
    return [left, right]


def _joined(policy: str):
    return lambda s, d: learning.join_features(_sources(s, d), policy)[0]


def _predicted(s: SparkSession, d: str) -> DataFrame:
    labels = s.read.parquet(f"{d}/labels.parquet")
    return labels.select(F.col("toxic").alias("label"), (1 - F.col("quality")).alias("prediction"))


def _classified(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = _known(s, d)
        return learning.evaluate(rows.where("pmod(sample_id, 5) <> 0"), rows.where("pmod(sample_id, 5) = 0"), kind)

    return run


def _known(s: SparkSession, d: str) -> DataFrame:
    return learning.join_features(_sources(s, d), "first", drop_unlabeled=True)[0].persist()


def _knn_vote(s: SparkSession, d: str) -> DataFrame:
    rows = _known(s, d)
    return _rounded(learning.knn(rows.where("pmod(sample_id, 5) <> 0"), rows.where("pmod(sample_id, 5) = 0"), ["n_chars", "n_items"]))


def queries() -> dict:
    out = {
        "catalog": adapter.catalog,
        "api_weights": lambda s, d: _rounded(_weights(s, d)),
        "sequence_ids": lambda s, d: _lines(_ids(s, d)),
        "sequence_weights": lambda s, d: sequences.sequence_weights(adapter.items(s, d), _w(s, d)),
        "similar_sequences": lambda s, d: sequences.similar(adapter.items(s, d), _w(s, d)),
        "merged_values": _values,
        "cluster_histogram": lambda s, d: learning.histogram(_assigned(s, d)),
        "cluster_summary": lambda s, d: learning.cluster_summary(_assigned(s, d), CENTERS),
        "kmeans_histogram": _fitted_histogram,
        "silhouette": lambda s, d: _rounded(learning.silhouette(_assigned(s, d))),
        "graph_edges": lambda s, d: graph.collapse(adapter.edges(s, d)),
        "contraction": _contracted,
        "degree": lambda s, d: _rounded(graph.degree(_contracted(s, d))),
        "pruned_sequences": lambda s, d: _lines(graph.prune(_ids(s, d))),
        "contraction_nodes": _present,
        "path_cover": lambda s, d: _lines(coded.path_cover(adapter.texts(s, d), adapter.known(s, d))),
        "join_inner": _joined("inner"),
        "join_outer": _joined("outer"),
        "join_first": _joined("first"),
        "label_conflicts": lambda s, d: learning.join_features(_sources(s, d), "outer")[1],
        "folds": lambda s, d: learning.folds(adapter.samples(s, d)),
        "metrics": lambda s, d: _rounded(learning.metrics(_predicted(s, d))),
        "names": lambda s, d: s.createDataFrame([(n,) for n in NODES], "node string").select("node", seq_name(F.col("node")).alias("seq_name"), feature_name(F.col("node")).alias("feature_name")),
        "path_labels": lambda s, d: s.createDataFrame([(p,) for p in PATHS], "path string").select("path", label_any(F.col("path")).alias("any_label"), label_nearest(F.col("path")).alias("nearest_label")),
        "classify_gbdt": _classified("gbdt"),
        "classify_rf": _classified("rf"),
        "classify_et": _classified("et"),
        "classify_xgb": _classified("xgb"),
        "classify_knn": _classified("knn"),
        "knn_vote": _knn_vote,
        "fold_metrics": lambda s, d: _rounded(learning.cross_validate(_known(s, d), "knn")[0]),
        "fold_average": lambda s, d: _rounded(learning.cross_validate(_known(s, d), "knn")[1]),
    }
    for metric in ("degree", *graph.METRICS):
        out[f"centrality_{metric}"] = lambda s, d, m=metric: _rounded(_features(s, d, m))
    return out


_BASE = """WITH RECURSIVE lines AS (SELECT doc_id AS sample_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq_id FROM documents WHERE text IS NOT NULL),
words AS (SELECT sample_id, seq_id, regexp_extract_all(lower(line), '[a-z]+') AS ws FROM lines),
tokens AS (SELECT sample_id, seq_id, unnest(ws) AS api, generate_subscripts(ws, 1) AS pos FROM words),
catalog AS (SELECT row_number() OVER (ORDER BY n DESC, api) AS api_id, api FROM (SELECT api, count(DISTINCT sample_id) AS n FROM tokens GROUP BY api ORDER BY n DESC, api LIMIT 426)),
items AS (SELECT sample_id, seq_id, pos, api_id FROM tokens JOIN catalog USING (api)),
samples AS (SELECT doc_id AS sample_id, toxic AS label FROM documents LEFT JOIN labels USING (doc_id)),
sizes AS (SELECT count(*) FILTER (label = 1) AS nm, count(*) FILTER (label = 0) AS nb FROM samples),
counts AS (SELECT api_id, count(DISTINCT sample_id) FILTER (label = 1) AS count_malware, count(DISTINCT sample_id) FILTER (label = 0) AS count_benign FROM items JOIN samples USING (sample_id) WHERE label IN (0, 1) GROUP BY api_id),
rates AS (SELECT api_id, count_malware, count_benign, count_malware + count_benign AS total_count, count_malware / nm AS pm_raw, count_benign / nb AS pb_raw, (count_malware + 2) / (nm + 4) AS pm, (count_benign + 2) / (nb + 4) AS pb FROM counts, sizes WHERE count_malware + count_benign >= 2),
ent AS (SELECT *, pm / (pm + pb) AS p, -(pm / (pm + pb)) * ln(pm / (pm + pb)) - (1 - pm / (pm + pb)) * ln(1 - pm / (pm + pb)) AS entropy FROM rates),
weights AS (SELECT *, p * (1 - entropy / ln(2.0)) AS weight FROM ent),
w AS (SELECT api_id, CAST(round(weight * 1e9) AS BIGINT) AS w FROM weights),
totals AS (SELECT sample_id, seq_id, CAST(sum(coalesce(w, 0)) AS BIGINT) AS total FROM items LEFT JOIN w USING (api_id) GROUP BY ALL),
idx AS (SELECT DISTINCT sample_id, seq_id, api_id, w, total FROM items JOIN w USING (api_id) JOIN totals USING (sample_id, seq_id) WHERE w > 0),
shared AS (SELECT a.sample_id, a.seq_id AS a, b.seq_id AS b, sum(a.w) AS s, max(greatest(a.total, b.total)) AS m FROM idx a JOIN idx b ON a.sample_id = b.sample_id AND a.api_id = b.api_id AND a.seq_id < b.seq_id GROUP BY ALL),
linked AS (SELECT sample_id, a, b FROM shared WHERE 10 * s >= 3 * m),
reach AS (SELECT sample_id, a, b FROM (SELECT sample_id, a, b FROM linked UNION SELECT sample_id, b, a FROM linked) UNION SELECT r.sample_id, r.a, l.b FROM reach r JOIN (SELECT sample_id, a, b FROM linked UNION SELECT sample_id, b, a FROM linked) l ON r.sample_id = l.sample_id AND r.b = l.a),
comps AS (SELECT sample_id, a AS seq_id, min(least(a, b)) AS comp_id FROM reach GROUP BY sample_id, a),
merged AS (SELECT sample_id, comp_id, CAST(sum(coalesce(w, 0)) AS BIGINT) AS value FROM (SELECT DISTINCT i.sample_id, coalesce(comp_id, i.seq_id) AS comp_id, api_id FROM items i LEFT JOIN comps c ON i.sample_id = c.sample_id AND i.seq_id = c.seq_id) LEFT JOIN w USING (api_id) GROUP BY ALL),
centers AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS cluster, unnest([0.0, 5e6, 2e7, 5e7, 1e8, 2e8, 4e8]) AS center),
assigned AS (SELECT sample_id, CAST(value AS DOUBLE) AS value, len(list_filter([2500000.0, 12500000.0, 35000000.0, 75000000.0, 150000000.0, 300000000.0], lambda m: m < value)) AS cluster FROM merged),
edges AS (SELECT DISTINCT a.sample_id, a.api AS src, b.api AS dst FROM tokens a JOIN tokens b ON a.sample_id = b.sample_id AND a.seq_id = b.seq_id AND b.pos = a.pos + 1),
walk AS (SELECT e.sample_id, c.api_id AS src, e.dst FROM edges e JOIN catalog c ON c.api = e.src UNION SELECT k.sample_id, k.src, e.dst FROM walk k JOIN edges e ON e.sample_id = k.sample_id AND e.src = k.dst WHERE k.dst NOT IN (SELECT api FROM catalog)),
contracted AS (SELECT DISTINCT sample_id, src, api_id AS dst FROM walk JOIN catalog ON api = dst WHERE src <> api_id),
seqs AS (SELECT sample_id, seq_id, string_agg(CAST(api_id AS VARCHAR), ' ' ORDER BY pos) AS api_ids FROM items GROUP BY ALL),
per AS (SELECT sample_id, count(*) AS n_items FROM items GROUP BY ALL),
p_src AS (SELECT doc_id AS sample_id, toxic AS label, n_chars FROM labels JOIN documents USING (doc_id)),
q_src AS (SELECT sample_id, 1 - quality AS label, n_items FROM per LEFT JOIN labels ON doc_id = sample_id)
"""


_KNN = (
    _BASE
    + """, rows AS (SELECT sample_id, coalesce(p.label, q.label) AS label, coalesce(n_chars, 0) AS a, coalesce(n_items, 0) AS b FROM p_src p LEFT JOIN q_src q USING (sample_id)),
dist AS (SELECT t.sample_id, t.label, r.label AS y, sqrt((t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b)) AS d, row_number() OVER (PARTITION BY t.sample_id ORDER BY sqrt((t.a - r.a) * (t.a - r.a) + (t.b - r.b) * (t.b - r.b)), CAST(r.sample_id AS VARCHAR)) AS k FROM rows t, rows r WHERE t.sample_id % 5 = 0 AND r.sample_id % 5 <> 0 AND t.label IN (0, 1) AND r.label IN (0, 1)),
three AS (SELECT *, min(d) OVER (PARTITION BY sample_id) AS least FROM dist WHERE k <= 3),
near AS (SELECT sample_id, label, y, CASE WHEN least = 0 THEN CAST(d = 0 AS INT) ELSE 1 / d END AS w FROM three)
"""
)


def oracle_sql() -> dict[str, str]:
    names = [("a.b.C.m", "a.b.C.m"), ("a.b.C$D.init", "a.b.C$D.init"), ("a.b.C.clinit", "a.b.C.<clinit>"), ("a.b.C.access", "a.b.C.access$12"), ("a.b.C.m", NODES[4]), (None, NODES[5]), (None, "a.b.C.m")]
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    metric = "count(*) FILTER (toxic = {} AND quality = {})"
    tn, fp, fn, tp = metric.format(0, 1), metric.format(0, 0), metric.format(1, 1), metric.format(1, 0)
    return {
        "catalog": _BASE + "SELECT * FROM catalog",
        "api_weights": _BASE + "SELECT api_id, count_malware, count_benign, total_count, round(pm_raw, 9) AS pm_raw, round(pb_raw, 9) AS pb_raw, round(pm, 9) AS pm, round(pb, 9) AS pb, round(p, 9) AS p, round(entropy, 9) AS entropy, round(weight, 9) AS weight FROM weights",
        "sequence_ids": _BASE + "SELECT * FROM seqs",
        "sequence_weights": _BASE + "SELECT * FROM totals",
        "similar_sequences": _BASE + "SELECT * FROM linked",
        "merged_values": _BASE + "SELECT * FROM merged",
        "cluster_histogram": _BASE + "SELECT sample_id, cluster, count(*) AS n FROM assigned GROUP BY ALL",
        "cluster_summary": _BASE + "SELECT c.cluster, count(a.value) AS size, round(avg(a.value), 6) AS avg_value, CAST(center AS DOUBLE) AS center FROM centers c LEFT JOIN assigned a ON a.cluster = c.cluster GROUP BY c.cluster, center",
        "graph_edges": _BASE + "SELECT * FROM edges",
        "contraction": _BASE + "SELECT * FROM contracted",
        "contraction_nodes": _BASE + "SELECT DISTINCT sample_id, api_id AS node FROM (SELECT sample_id, src AS api FROM edges UNION SELECT sample_id, dst FROM edges) JOIN catalog USING (api)",
        "degree": _BASE + ", ends AS (SELECT sample_id, src AS node FROM contracted UNION ALL SELECT sample_id, dst FROM contracted), k AS (SELECT sample_id, node, count(*) AS k FROM ends GROUP BY ALL) SELECT sample_id, node, round(CASE WHEN count(*) OVER (PARTITION BY sample_id) > 1 THEN k / (count(*) OVER (PARTITION BY sample_id) - 1) ELSE 1 END, 9) AS value FROM k",
        "centrality_degree": _BASE + ", ends AS (SELECT sample_id, src AS node FROM edges UNION ALL SELECT sample_id, dst FROM edges), k AS (SELECT sample_id, node, count(*) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM ends GROUP BY sample_id, node) SELECT s.sample_id, c.api_id, round(CASE WHEN k IS NULL THEN 0 WHEN n > 1 THEN k / (n - 1) ELSE 1 END, 9) AS value FROM (SELECT DISTINCT sample_id FROM samples) s CROSS JOIN catalog c LEFT JOIN k ON k.sample_id = s.sample_id AND k.node = c.api",
        "pruned_sequences": _BASE + ", u AS (SELECT DISTINCT sample_id, api_ids FROM seqs) SELECT * FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.sample_id = x.sample_id AND length(y.api_ids) > length(x.api_ids) AND contains(' ' || y.api_ids || ' ', ' ' || x.api_ids || ' '))",
        "join_inner": _BASE + "SELECT sample_id, coalesce(p.label, q.label) AS label, n_chars, n_items FROM p_src p JOIN q_src q USING (sample_id)",
        "join_outer": _BASE + "SELECT sample_id, coalesce(p.label, q.label) AS label, n_chars, n_items FROM p_src p FULL JOIN q_src q USING (sample_id)",
        "join_first": _BASE + "SELECT sample_id, coalesce(p.label, q.label) AS label, coalesce(n_chars, 0) AS n_chars, coalesce(n_items, 0) AS n_items FROM p_src p LEFT JOIN q_src q USING (sample_id)",
        "label_conflicts": _BASE + "SELECT sample_id, p.label, q.label AS label_new, 1 AS source FROM p_src p JOIN q_src q USING (sample_id) WHERE p.label <> q.label",
        "folds": _BASE + "SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || '#42'), sample_id) - 1) % 10 AS INT) AS fold FROM samples WHERE label IN (0, 1)",
        "knn_vote": _KNN + "SELECT sample_id, label, CAST(score > 0.5 AS INT) AS prediction, round(score, 9) AS score FROM (SELECT t.sample_id, t.label, coalesce(sum(w) FILTER (y = 1) / sum(w), 0) AS score FROM near t GROUP BY t.sample_id, t.label)",
        "metrics": f"SELECT round(({tp} + {tn}) / count(*), 9) AS acc, round({tp} / ({tp} + {fn}), 9) AS tpr, round({tn} / ({tn} + {fp}), 9) AS tnr, round({fp} / ({tn} + {fp}), 9) AS fpr, round({fn} / ({tp} + {fn}), 9) AS fnr, round({tp} / ({tp} + {fp}), 9) AS precision, round({tp} / ({tp} + {fn}), 9) AS recall, round(2 * {tp} / (2 * {tp} + {fp} + {fn}), 9) AS f1 FROM labels",
        "names": " UNION ALL ".join(f"SELECT {quote(n)} AS node, {quote(a)} AS seq_name, {quote(b)} AS feature_name" for n, (a, b) in zip(NODES, names, strict=True)),
        "path_labels": " UNION ALL ".join(f"SELECT {quote(p)} AS path, {a} AS any_label, {b} AS nearest_label" for p, a, b in zip(PATHS, (0, 1, 1, 1, "NULL"), (0, 1, 0, 1, "NULL"), strict=True)),
    }
