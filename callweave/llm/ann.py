"""Nearest neighbours: a forest of random-projection trees and exact reranking.

Trees are built on a bounded sample (``SAMPLE`` vectors by hash); every row is then
routed to one leaf of each tree. A query takes the leaves of all trees from one queue, by
nearest margin, until they hold ``SHARE`` of the sample and ``SEARCH`` of its vectors at
least (or are all there are). All rows of those leaves are candidates and are ranked by
their exact distance. Queries come in blocks of bounded size; a block's leaves are looked
up on the executors, its broadcast is taken back and its answers are written before the
next one starts, so the driver holds one block. Each block scans the table once.

Defined results: vectors that are null, zero, of another length than most of the table,
or hold null or non-finite components take no part, nor do rows without an id; of an id
with several rows the smallest vector counts; ties go to the smaller id; with fewer
candidates than asked for, all of them return; an empty table gives no rows; only id and
vector are read, whatever the other columns' names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, drop

TREES, LEAF, SAMPLE, SEARCH, SHARE, BLOCK = 16, 32, 20_000, 3_000, 0.6, 4_000


class Forest:
    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11):
        self.normals, self.cuts, self.kids, self.roots = [], [], [], []
        self.home = np.empty((len(points), trees), np.int64)
        rng = np.random.default_rng(seed)
        for t in range(trees):
            self.roots.append(self._grow(points, np.arange(len(points)), leaf, rng, self.home[:, t]))
        self.normals = np.array(self.normals, np.float32).reshape(len(self.cuts), -1)
        self.cuts, self.kids = np.array(self.cuts, np.float32), np.array(self.kids, np.int64).reshape(-1, 2)
        self.leaf = np.cumsum(self.kids[:, 0] < 0) - 1
        self.levels, at = [], np.array(self.roots)
        while len(at := at[self.kids[at, 0] >= 0]):
            self.levels.append(at)
            at = self.kids[at].ravel()

    def _grow(self, points: np.ndarray, ids: np.ndarray, leaf: int, rng, home: np.ndarray) -> int:
        at = len(self.cuts)
        self.normals.append(np.zeros(points.shape[1]))
        self.cuts.append(0.0)
        self.kids.append([-1, -1])
        if len(ids) > leaf:
            for _ in range(3):
                a, b = rng.choice(len(ids), 2, replace=False)
                normal = points[ids[a]] - points[ids[b]]
                norm = np.linalg.norm(normal)
                if norm < 1e-12:
                    normal = rng.standard_normal(points.shape[1])
                    norm = np.linalg.norm(normal)
                normal = (normal / norm).astype(np.float32)
                side = points[ids].astype(np.float32) @ normal
                cut = np.float32(np.median(side))
                right = side > cut
                if right.any() and not right.all():
                    self.normals[at], self.cuts[at] = normal, cut
                    lo = self._grow(points, ids[~right], leaf, rng, home)
                    hi = self._grow(points, ids[right], leaf, rng, home)
                    self.kids[at] = [lo, hi]
                    return at
        home[ids] = at
        return at

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree."""
        x = x.astype(np.float32)
        out = np.tile(np.array(self.roots), (len(x), 1))
        for t in range(len(self.roots)):
            at, live = out[:, t], np.arange(len(x))
            while True:
                live = live[self.kids[at[live], 0] >= 0]
                if not len(live):
                    break
                node = at[live]
                right = np.einsum("ij,ij->i", x[live], self.normals[node]) > self.cuts[node]
                at[live] = self.kids[node, right.astype(int)]
        return out

    def probe(self, q: np.ndarray, want: int) -> np.ndarray:
        """Leaves by nearest margin over all trees, until they hold ``want`` sample vectors."""
        margins = self.normals @ q.astype(np.float32) - self.cuts
        key = np.full(len(self.cuts), -np.inf, np.float32)
        for at in self.levels:
            lo, hi = self.kids[at].T
            key[lo], key[hi] = np.maximum(key[at], margins[at]), np.maximum(key[at], -margins[at])
        leaves = np.flatnonzero(self.kids[:, 0] < 0)
        near, n, least = key[self.home].min(axis=1), min(want, len(self.home)), len(self.roots)
        far = max(np.partition(near, n - 1)[n - 1], np.partition(key[leaves], least - 1)[least - 1])
        return leaves[key[leaves] <= far]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.coalesce(F.exists(v, lambda x: x != 0) & ~bad, F.lit(False))
    return df.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _top(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], d[keep], ids[keep]


def search(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, want: int = SEARCH, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): ``queries`` are rows of ``df``'s shape, each left out of its own answer."""
    spark = df.sparkSession
    rows, asked = usable(df, id_col, vec_col), usable(queries, id_col, vec_col)
    schema = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    rows, asked = rows.where(F.size("v") == dims["n"]), asked.where(F.size("v") == dims["n"])
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    # Of equal vectors only the k + 1 smallest ids can be in an answer; the hot ones are cut in two steps.
    mark = F.array(F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))
    slim = rows.select("id", mark.alias("m"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    for keys in (["m", "salt"], ["m"]):
        by = Window.partitionBy(*keys).orderBy("id")
        slim = slim.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).drop("r")
    rows = cut(rows.join(slim.select("id"), "id", "left_semi"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    forest = spark.sparkContext.broadcast(Forest(np.array([r["v"] for r in sample])))
    want = max(1, want, int(np.ceil(share * len(sample))))
    blocks = max(1, -(-asked.count() * 2 // BLOCK))
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf = forest.value.leaf
        for b in batches:
            out = []
            for q in b["v"]:
                bits = np.zeros(leaf[-1] + 1, bool)
                bits[leaf[forest.value.probe(np.asarray(q), want)]] = True
                out.append(np.packbits(bits).tobytes())
            yield b.assign(leaves=out)

    parts = []
    for i in range(blocks):
        found = asked.where(block == i).repartition(16).mapInPandas(look_up, "id long, v array<double>, leaves binary")
        got = sorted(found.collect(), key=lambda r: r["id"])
        if not got:
            continue
        qid, qv = np.array([r["id"] for r in got]), np.array([r["v"] for r in got])
        asks = np.unpackbits(np.array([np.frombuffer(r["leaves"], np.uint8) for r in got]), axis=1, count=forest.value.leaf[-1] + 1).T
        sent = spark.sparkContext.broadcast((qid, qv, np.packbits(asks, axis=1)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qid, qv, asks = sent.value
            bq, bd, bi = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
            q2, bound = (qv**2).sum(axis=1), np.full(len(qid), np.inf)
            for whole in batches:
                for lo in range(0, len(whole), 1000):
                    b = whole.iloc[lo : lo + 1000]
                    x, ids = np.stack(b["v"].to_numpy()), b["id"].to_numpy()
                    met = np.zeros((len(x), asks.shape[1]), np.uint8)
                    for t in forest.value.route(x).T:
                        met |= asks[forest.value.leaf[t]]
                    on = np.unpackbits(met, axis=1, count=len(qid)).astype(bool) & (ids[:, None] != qid)
                    # Squares by product tell who cannot be among the k; the others get their exact distance.
                    both = (x**2).sum(axis=1)[:, None] + q2
                    rough = np.where(on, both - 2 * (x @ qv.T), np.inf)
                    if len(x) > k:
                        bound = np.fmin(bound, np.partition(rough + 1e-9 * both, k - 1, axis=0)[k - 1])
                    r, q = np.nonzero(on & ~(rough - 1e-9 * both > bound))
                    d = np.empty(len(q))
                    for s in range(0, len(q), 100_000):
                        d[s : s + 100_000] = np.sqrt(((qv[q[s : s + 100_000]] - x[r[s : s + 100_000]]) ** 2).sum(axis=1))
                    bq, bd, bi = _top(np.concatenate([bq, q]), np.concatenate([bd, d]), np.concatenate([bi, ids[r]]), k)
                    full = np.flatnonzero(np.bincount(bq, minlength=len(qid)) >= k)
                    bound[full] = np.fmin(bound[full], bd[np.searchsorted(bq, full, "right") - 1] ** 2 * (1 + 1e-9))
            yield pd.DataFrame({"query_id": qid[bq], "vec_id": bi, "score": bd})

        parts.append(cut(rows.mapInPandas(run, "query_id long, vec_id long, score double")))
        sent.destroy()
    forest.destroy()
    drop(rows)
    if not parts:
        return spark.createDataFrame([], schema)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    from .common import table

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")
