"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are its own and its neighbours' character and
word rates; forward-backward gives each line's marginal; the marginals, weighted by line
length, give the document's quality, mapped to a probability by a logistic step.

Only documents are labelled, so lines get weak labels: first each has its document's,
then a fit on these tells which lines look like the other class; they change sides as long
as most of the document, by length, keeps its label (``KEPT``). The second fit is on chains
whose lines differ, so transitions are learnt as well. Learning takes a bounded sample of
labelled rows (``LEARN_ROWS``, in hash order) and all lines of their texts; chains longer
than ``PIECE`` lines enter the likelihood in pieces. Scoring reads whole texts as one chain.

Defined results: null and empty texts are one empty line; texts of any length are read
whole; with no labels, or labels of one kind only, every score is 0.5; repeated rows each
give their score, and count as one when learnt from; labels that contradict each other on
one id both count; ties (equal hashes) go to the smaller id; rows without an id are scored
and never learnt from; an empty table gives no rows; other columns are kept, and an output
name that is taken is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import refuse, table

LEARN_ROWS, PIECE = 4000, 128
#: Share of a document's length that keeps the document's label, for bad and for good ones.
KEPT = (0.5, 0.75)
_SIGNS = b"*#$%&!?^~|<>{}[]=+_\\@/"
_STOPS = b".,;:'\"()-"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
WIDTH = 10


def own_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a whole text."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()] or [b""]
    rows, seen = [], {}
    for b in lines:
        n = len(b) or 1
        words = b.split()
        k = len(words) or 1
        seen[b] = again = seen.get(b, -1) + 1
        low = b.rstrip()[-1:]
        rows.append((
            math.log1p(len(b)) / 5, len(b) / k / 8, 4 * (n - len(b.translate(None, _SIGNS))) / n, 4 * (n - len(b.translate(None, _STOPS))) / n,
            4 * (n - len(b.translate(None, _DIGITS))) / n, 2 * (n - len(b.translate(None, _UPPER))) / n, len(set(words)) / k, float(low in (b".", b"!", b"?")),
            float(again > 0), min(k, 60) / 30,
        ))
    return np.array(rows), np.array([len(b) + 1.0 for b in lines])


def with_neighbours(own: np.ndarray) -> np.ndarray:
    none = np.zeros((1, own.shape[1]))
    return np.hstack([np.ones((len(own), 1)), own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none])])


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features with neighbours, line lengths) of a whole text."""
    own, lengths = own_features(text)
    return with_neighbours(own), lengths


def marginals(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line; ``emit`` are log odds per line, ``trans`` a 2 x 2 log table."""
    up, e = np.exp(np.clip(trans, -30, 30)).tolist(), np.exp(np.clip(emit, -30, 30)).tolist()
    (t00, t01), (t10, t11) = up
    n = len(e)
    f, b = [0.0] * n, [0.0] * n
    p = f[0] = e[0] / (1 + e[0])
    for i in range(1, n):
        g, h = (p * t11 + (1 - p) * t01) * e[i], p * t10 + (1 - p) * t00
        p = f[i] = g / (g + h)
    q = b[n - 1] = 0.5
    for i in range(n - 1, 0, -1):
        good, bad = q * e[i], 1 - q
        g, h = t11 * good + t10 * bad, t01 * good + t00 * bad
        q = b[i - 1] = g / (g + h)
    fa, ba = np.array(f), np.array(b)
    good = fa * ba
    return good / (good + (1 - fa) * (1 - ba))


class Chains:
    """Pieces of at most ``PIECE`` lines, laid out by place in the piece, longest pieces first."""

    def __init__(self, lengths: list[int], piece: int = PIECE):
        spans, at = [], 0
        for n in lengths:
            spans += [(at + lo, min(piece, n - lo)) for lo in range(0, n, piece)]
            at += n
        spans.sort(key=lambda s: -s[1])
        starts, sizes = np.array([s for s, _ in spans]), np.array([n for _, n in spans])
        self.steps, self.order, done = [], [], 0
        for i in range(sizes.max()):
            live = int((sizes > i).sum())
            self.order.append(starts[:live] + i)
            self.steps.append((done, live))
            done += live
        self.order = np.concatenate(self.order)
        #: Place, in this layout, of the line before each line that is not a piece's first.
        self.later = np.arange(self.steps[0][1], done)
        self.before = np.concatenate([np.arange(self.steps[i - 1][0], self.steps[i - 1][0] + self.steps[i][1]) for i in range(1, len(self.steps))] or [np.empty(0, np.int64)])

    def expect(self, e: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, joint table of each line and the one before); ``e``, ``k`` are not logs."""
        (t00, t01), (t10, t11) = k
        f, q = np.empty(len(e)), np.full(len(e), 0.5)
        p = None
        for at, live in self.steps:
            x = e[at : at + live]
            g, h = (x, 1.0) if p is None else ((p[:live] * t11 + (1 - p[:live]) * t01) * x, p[:live] * t10 + (1 - p[:live]) * t00)
            p = f[at : at + live] = g / (g + h)
        for i in range(len(self.steps) - 1, 0, -1):
            (at, live), lower = self.steps[i], self.steps[i - 1][0]
            good, bad = q[at : at + live] * e[at : at + live], 1 - q[at : at + live]
            g, h = t11 * good + t10 * bad, t01 * good + t00 * bad
            q[lower : lower + live] = g / (g + h)
        good = f * q
        one = good / (good + (1 - f) * (1 - q))
        p, x, r = f[self.before], e[self.later], q[self.later]
        pair = np.stack([(1 - p) * t00 * (1 - r), (1 - p) * t01 * x * r, p * t10 * (1 - r), p * t11 * x * r], 1)
        return one, pair / pair.sum(1, keepdims=True)


def _fit(xs: np.ndarray, chains: Chains, y: np.ndarray, weight: np.ndarray, rounds: int, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and then the four transitions, by gradient ascent on the likelihood of line labels ``y``."""
    x, y, weight = xs[chains.order], y[chains.order], weight[chains.order]
    d = x.shape[1]
    theta = np.zeros(d + 4) if start is None else start.copy()
    m, v = np.zeros(d + 4), np.zeros(d + 4)
    kind = 2 * y[chains.before] + y[chains.later]
    live = weight[chains.later]
    seen = np.bincount(kind, live, 4)
    for step in range(1, rounds + 1):
        e, k = np.exp(np.clip(x @ theta[:d], -30, 30)), np.exp(theta[d:].reshape(2, 2))
        one, pair = chains.expect(e, k)
        g = np.concatenate([((y - one) * weight) @ x, seen - live @ pair]) - 0.02 * np.concatenate([theta[:d], 20 * theta[d:]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        theta[d:] = np.clip(theta[d:], -2, 2)
    return theta


def weak_labels(logits: np.ndarray, lengths: np.ndarray, label: int) -> np.ndarray:
    """Line labels of a document: its own, but for lines that look like the other class, within ``KEPT``."""
    sign = 1 if label else -1
    order = np.argsort(-sign * logits, kind="stable")
    firm = np.empty(len(order), bool)
    firm[order] = np.cumsum(lengths[order]) - lengths[order] < KEPT[label] * lengths.sum()
    return np.where(firm | (sign * logits > 0), label, 1 - label)


def raw_quality(x: np.ndarray, lengths: np.ndarray, w: np.ndarray, tr: np.ndarray) -> float:
    p = float((marginals(x @ w, tr) * lengths).sum() / lengths.sum())
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def fit(data: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple | None:
    """Model of (features with neighbours, line lengths, label) of documents."""
    y = np.array([label for *_, label in data])
    if len(set(y.tolist())) < 2:
        return None
    sizes = [len(n) for _, n, _ in data]
    xs, chains = np.vstack([x for x, _, _ in data]), Chains(sizes)
    share = (y == 1).mean()
    weight = np.repeat(np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / np.array(sizes), sizes)
    first = _fit(xs, chains, np.repeat(y, sizes), weight, 100)
    d = xs.shape[1]
    logits = np.split(xs @ first[:d], np.cumsum(sizes)[:-1])
    lines = np.concatenate([weak_labels(z, n, label) for z, (_, n, label) in zip(logits, data, strict=True)])
    theta = _fit(xs, chains, lines, weight, 100, first)
    w, tr = theta[:d], theta[d:].reshape(2, 2)
    z = np.array([raw_quality(x, n, w, tr) for x, n, _ in data])
    a, c = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((y - p) * z).mean() - 1e-3 * a, (y - p).mean()])
        hess = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-6]])
        a, c = np.array([a, c]) + 0.5 * np.linalg.solve(hess, grad)
    return w, tr, float(a), float(c)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple | None:
    """Model from labelled ids and their texts: ids are picked first, so one scan of the texts, without a shuffle, finds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, y in zip(b["i"], b["text"], b["y"], strict=True):
                x, n = own_features(text)
                out.append((i, int(y), x.astype(np.float32).ravel().tolist(), n.tolist()))
            yield pd.DataFrame(out, columns=["i", "y", "x", "n"])

    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).distinct()
    picked = known.where("i is not null").orderBy(F.xxhash64("i"), "i", "y").limit(LEARN_ROWS)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(picked), "i")  # LEARN_ROWS at the most
    kind = rows.schema["i"].dataType.simpleString()
    got = rows.select("i", "text", "y").mapInPandas(run, f"i {kind}, y int, x array<float>, n array<double>").collect()
    once = {(r["i"], r["y"], tuple(r["n"]), tuple(r["x"])) for r in got}
    return fit([(with_neighbours(np.array(x).reshape(len(n), -1)), np.array(n), y) for _, y, n, x in sorted(once)]) if once else None


def score(df: DataFrame, model: tuple | None, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add ``out_col``: the probability of label 1."""
    refuse(df, out_col)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([0.5] * len(texts))
        w, tr, a, c = model
        return pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, a * raw_quality(*line_features(t), w, tr) + c)))) for t in texts], dtype=float)

    return df.withColumn(out_col, run(F.col(text_col)))


def op7(spark, sf_dir):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
