"""Samples taken by batches of texts: words become numbers, and the graphs or sequences of many samples are worked on at once.

A text's lines are sequences, its runs of a to z (after lower-casing) operations. A row is one whole sample, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text worked on at once; a longer text is taken alone and whole.
SLICE = 2 << 20
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Words:
    """The words of some texts in their order: ``doc`` and ``line`` (from 1) of each, and ``code``, which numbers words.

    The words of ``known`` have the codes 0, 1, ..., whether they occur or not; ``names`` gives the word of every code.
    """

    def __init__(self, texts: pa.Array, known: list[str]):
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
        head = np.frombuffer("".join(f"{w}\n" for w in known).encode(), np.uint8)
        buf = np.concatenate([head, body, np.zeros(16, np.uint8)])
        at = at - at[0] + len(head)
        letter = buf - np.uint8(97) < 26
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        first[at] = letter[at]
        last[at[at > 0] - 1] = letter[at[at > 0] - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        code = self._codes(buf, start, end - start)
        lead = len(known)
        breaks = np.flatnonzero(buf == 10)
        self.n, self.known, self.top = len(texts), lead, int(code.max(initial=-1)) + 1
        self._buf, self._start, self._end, self._all = buf, start, end, code
        start = start[lead:]
        self.code = code[lead:]
        self.doc = np.searchsorted(at[1:], start, side="right")
        self.line = np.searchsorted(breaks, start) - np.searchsorted(breaks, at[self.doc]) + 1

    @staticmethod
    def _codes(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Equal words, equal numbers, by order of appearance: eight letters at a time, so words of any length are told apart."""
        eight = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        code = pd.factorize(eight[start] & _MASKS[np.minimum(size, 8)])[0].astype(np.int64)
        done, todo = 8, np.flatnonzero(size > 8)
        while len(todo):
            part = pd.factorize(eight[start[todo] + done] & _MASKS[np.minimum(size[todo] - done, 8)])[0].astype(np.int64)
            code[todo] = pd.factorize(code[todo] << 32 | part)[0] + code.max() + 1
            done += 8
            todo = todo[size[todo] > done]
        return pd.factorize(code)[0].astype(np.int64)

    def names(self, codes: np.ndarray) -> list[str]:
        where = np.empty(self.top, np.int64)
        where[self._all[::-1]] = np.arange(len(self._all))[::-1]
        data = self._buf.tobytes()
        return [data[self._start[i] : self._end[i]].decode() for i in where[codes]]


class Graphs:
    """The call graphs of some texts: nodes by sample, distinct edges by their source; ``api`` is a node's code if known, else -1."""

    def __init__(self, w: Words):
        pair = (w.doc[1:] == w.doc[:-1]) & (w.line[1:] == w.line[:-1])
        used = np.zeros(len(w.doc), bool)
        used[:-1] |= pair
        used[1:] |= pair
        node, key = pd.factorize(w.doc[used] * max(1, w.top) + w.code[used])
        place = np.cumsum(used) - 1
        i = np.flatnonzero(pair)
        self.samples, self.n = w.n, len(key)
        edge = _distinct(node[place[i]].astype(np.int64) * self.n + node[place[i + 1]])
        self.src, self.dst = edge // max(1, self.n), edge % max(1, self.n)
        self.doc, code = key // max(1, w.top), key % max(1, w.top)
        self.api = np.where(code < w.known, code, -1)
        self.sizes = np.bincount(self.doc, minlength=self.samples)
        self.wanted = np.flatnonzero(self.api >= 0)
        doc = self.doc[self.wanted]
        #: Place of a wanted node among those of its sample; 64 places are searched at once.
        self.rank = np.arange(len(doc)) - np.searchsorted(doc, doc)

    def planes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(wanted nodes, their bits), at most 64 of a sample at once."""
        for lo in range(0, int(self.rank.max(initial=-1)) + 1, 64):
            some = (self.rank >= lo) & (self.rank < lo + 64)
            yield self.wanted[some], self.rank[some] - lo

    def back(self, nodes: np.ndarray, bit: np.ndarray, seen: np.ndarray, through: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By steps against the edges from ``nodes``: (nodes, bits) of what comes anew, which is added to ``seen``.

        Bits go on from nodes marked in ``through`` only. Edges of samples where nothing comes any more are left aside.
        """
        src, dst, live = self.src, self.dst, self.samples
        front, on = np.zeros(self.n, np.uint64), np.zeros(self.n, bool)
        front[nodes], on[nodes] = np.uint64(1) << bit.astype(np.uint64), True
        last = nodes
        while True:
            some = np.flatnonzero(on[dst])
            at, bits = src[some], front[dst[some]]
            starts = _starts(at)
            at = at[starts]
            new = np.bitwise_or.reduceat(bits, starts) & ~seen[at] if len(at) else np.empty(0, np.uint64)
            at, new = at[new != 0], new[new != 0]
            seen[at] |= new
            if len(at):
                yield at, new
            front[last], on[last] = 0, False
            if through is not None:
                at, new = at[through[at]], new[through[at]]
            if not len(at):
                return
            front[at], on[at], last = new, True, at
            docs = self.doc[at[_starts(self.doc[at])]]
            if 2 * len(docs) < live:
                left, live = np.zeros(self.samples, bool), len(docs)
                left[docs] = True
                kept = left[self.doc[src]]
                src, dst = src[kept], dst[kept]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_starts(x)]


def _counts(doc: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, counts by bit): how many of a sample's rows have each of 64 bits; rows are in order of their samples."""
    starts = _starts(doc)
    size = np.diff(np.r_[starts, len(doc)])
    # Eight counters of a byte each are added at once, so of 255 rows at the most.
    parts = starts if size.max() <= 255 else np.flatnonzero((np.arange(len(doc)) - np.repeat(starts, size)) % 255 == 0)
    eight = np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    out = np.add.reduceat(eight, parts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    if len(parts) > len(starts):
        out = np.add.reduceat(out, _starts(doc[parts]), axis=0)
    return doc[starts], out


def distances(g: Graphs) -> tuple[np.ndarray, np.ndarray]:
    """(closeness, harmonic) over incoming paths of each wanted node."""
    close, harm = np.zeros(len(g.wanted)), np.zeros(len(g.wanted))
    for nodes, bit in g.planes():
        seen = np.zeros(g.n, np.uint64)
        seen[nodes] = np.uint64(1) << bit.astype(np.uint64)
        r, total, sums = (np.zeros((g.samples, 64)) for _ in range(3))
        for k, (at, new) in enumerate(g.back(nodes, bit, seen), 1):
            docs, hits = _counts(g.doc[at], new)
            r[docs] += hits
            total[docs] += k * hits
            sums[docs] += hits / k
        doc = g.doc[nodes]
        r, total = r[doc, bit], total[doc, bit]
        put = np.searchsorted(g.wanted, nodes)
        close[put], harm[put] = r / np.maximum(total, 1) * r / np.maximum(1, g.sizes[doc] - 1), sums[doc, bit]
    return close, harm


def contracted(g: Graphs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, source, target): distinct edges between known codes joined by a path outside them, in that order."""
    found = []
    base = np.zeros((g.samples, 64), np.int64)
    outside = g.api < 0
    for nodes, bit in g.planes():
        seen = np.zeros(g.n, np.uint64)
        base[g.doc[nodes], bit] = g.api[nodes]
        for _ in g.back(nodes, bit, seen, outside):
            pass
        ends = seen[g.wanted]
        i, j = np.nonzero(np.unpackbits(ends.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64))
        doc = g.doc[g.wanted[i]]
        found.append((doc, g.api[g.wanted[i]], base[doc, j]))
    doc, s, t = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
    doc, s, t = doc[s != t], s[s != t], t[s != t]
    order = np.lexsort((t, s, doc))
    return doc[order], s[order], t[order]


def cover(src: list[int], dst: list[int]) -> list[list[int]]:
    """Paths that hold every edge once: from sources, then other nodes that do not lie on a line, then the rest, lowest first.

    Edges are distinct and sorted. A path goes on while its end has one edge out, not yet used.
    """
    first, out, into = {}, {}, {}
    for i, (a, b) in enumerate(zip(src, dst, strict=True)):
        first.setdefault(a, i)
        out[a] = out.get(a, 0) + 1
        into[b] = into.get(b, 0) + 1
    sources = [v for v in out if v not in into]
    forks = [v for v in out if v in into and (into[v] != 1 or out[v] != 1)]
    lines = [v for v in out if into.get(v) == 1 and out[v] == 1]
    used, paths = bytearray(len(src)), []
    for v in sources + forks + lines:
        at = first[v]
        for i in range(at, at + out[v]):
            if used[i]:
                continue
            used[i] = 1
            w = dst[i]
            path = [v, w]
            while out.get(w) == 1 and not used[j := first[w]]:
                used[j] = 1
                w = dst[j]
                path.append(w)
            paths.append(path)
    return paths


def values(w: Words, weight: np.ndarray, tenths: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, class, value): the weight of the distinct known words of each class of similar lines; its id is the least line.

    Lines are similar if the weight of words in both is at least tenths/10 of the larger line's weight, repeats counted there.
    """
    on = w.code < w.known
    line, code = w.line[on], w.code[on]
    key, row = np.unique(w.doc[on] * (int(line.max(initial=0)) + 1) + line, return_inverse=True)
    doc, line = np.divmod(key, int(line.max(initial=0)) + 1)
    total = np.bincount(row, weight[code], len(key))  # whole numbers under 2**53
    width = max(1, w.known)
    cells = _distinct(row * width + code)
    row, code = cells // width, cells % width
    up = np.arange(len(key))
    begin = np.searchsorted(row, np.arange(len(key) + 1))
    edges = []
    starts = _starts(doc)
    for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(doc)].tolist(), strict=True):
        if hi - lo > 1:
            a, b = begin[lo], begin[hi]
            edges += _similar(hi - lo, row[a:b] - lo, code[a:b], weight, total[lo:hi], tenths, lo)
    if edges:
        _join(up, *(np.concatenate(x) for x in zip(*edges, strict=True)))
    cells = _distinct(up[row] * width + code)
    value = np.bincount(cells // width, weight[cells % width], len(key)).astype(np.int64)
    root = np.flatnonzero(up == np.arange(len(key)))
    return doc[root], line[root], value[root]


def _join(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Classes of linked rows in ``up``: each row's least row."""
    while len(a):
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up[:] = up[up]
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]


def _similar(n: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray, total: np.ndarray, tenths: int, base: int) -> list:
    """Pairs of one sample's lines that suffice for its classes. Copies of a line are compared once, in blocks of bounded size."""
    apis, col = np.unique(code, return_inverse=True)
    has = np.zeros((n, len(apis)), bool)
    has[row, col] = True
    if n > 64:
        marks = [(h.tobytes(), t) for h, t in zip(np.packbits(has, axis=1), total.tolist(), strict=True)]
        seen: dict = {}
        like = np.array([seen.setdefault(m, i) for i, m in enumerate(marks)])
    else:
        like = np.arange(n)
    kept = np.flatnonzero(like == np.arange(n))
    has, sums = has[kept].astype(float), total[kept]
    heavy, out = has * weight[apis], []
    linked = np.zeros(n, bool)
    up = np.arange(len(kept))
    for lo in range(0, len(kept), 1024):
        shared = heavy[lo : lo + 1024] @ has.T
        hit = (10 * shared >= tenths * np.maximum(sums[lo : lo + 1024, None], sums)) & (shared > 0)
        i, j = np.nonzero(hit)
        linked[kept[i + lo]] = True  # with another line or with its own copies
        more = i + lo < j
        i, j = i[more] + lo, j[more]
        if len(kept) > 1024:
            _join(up, i, j)
        else:
            out.append((kept[i] + base, kept[j] + base))
    if len(kept) > 1024:
        out.append((kept + base, kept[up] + base))
    copy = np.flatnonzero((like != np.arange(n)) & linked[like])
    out.append((copy + base, like[copy] + base))
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE`` bytes of text."""
    text = batch.column(1)
    sizes = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SLICE, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def over(texts: DataFrame, known: list[str], schema: str, work: Callable[[pa.Array, Words], list[pa.Array]]) -> DataFrame:
    """``work(ids, words)`` of slices of ``texts`` (sample_id, text), giving the columns of ``schema``; null texts are empty."""
    names = [c.split()[0] for c in schema.split(", ")]
    if len(set(known)) < len(known) or not all(re.fullmatch("[a-z]+", x) for x in known):
        raise ValueError("known words must be distinct runs of a to z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                ids, text = part.columns
                yield pa.RecordBatch.from_arrays(work(ids, Words(text.fill_null(""), known)), names)

    return texts.select("sample_id", F.lower("text").alias("text")).mapInArrow(run, schema)


def words_of_samples(texts: DataFrame) -> DataFrame:
    """(api, n): the number of samples that have a word."""

    def work(ids: pa.Array, w: Words) -> list[pa.Array]:
        pairs = pd.unique(w.doc * max(1, w.top) + w.code)
        n = np.bincount(pairs % max(1, w.top), minlength=w.top)
        return [pa.array(w.names(np.arange(w.top)), pa.string()), pa.array(n, pa.int64())]

    return over(texts, [], "api string, n bigint", work).groupBy("api").agg(F.sum("n").alias("n"))


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, kind))


def apis_of_samples(texts: DataFrame, known: list[str]) -> DataFrame:
    """(sample_id, n_items, api_ids): the number of known words of a sample and the distinct ones; samples without one are left out."""

    def work(ids: pa.Array, w: Words) -> list[pa.Array]:
        on = w.code < w.known
        n = np.bincount(w.doc[on], minlength=w.n)
        cells = _distinct(w.doc[on] * max(1, w.known) + w.code[on])
        doc = cells // max(1, w.known)
        some = np.flatnonzero(n)
        return [ids.take(pa.array(some)), pa.array(n[some], pa.int64()), _lists(cells % max(1, w.known) + 1, np.bincount(doc, minlength=w.n)[some], pa.int32())]

    return over(texts, known, "sample_id bigint, n_items bigint, api_ids array<int>", work)


def centrality(texts: DataFrame, known: list[str], metric: str) -> DataFrame:
    """(sample_id, api_id, value): closeness or harmonic of the whole graph at every known word, numbered from 1, else 0."""
    pick, width = ("closeness", "harmonic").index(metric), len(known)

    def work(ids: pa.Array, w: Words) -> list[pa.Array]:
        g = Graphs(w)
        full = np.zeros((w.n, width))
        full[g.doc[g.wanted], g.api[g.wanted]] = distances(g)[pick]
        return [ids, _lists(full.ravel(), np.full(w.n, width), pa.float64())]

    rows = over(texts, known, "sample_id bigint, found array<double>", work)
    return rows.select("sample_id", F.posexplode("found").alias("_i", "value")).select("sample_id", (F.col("_i") + 1).alias("api_id"), "value")


def path_cover(texts: DataFrame, known: list[str]) -> DataFrame:
    """(sample_id, api_ids): paths that hold every edge of the contracted graph once; known nodes without an edge are paths of their own."""

    def work(ids: pa.Array, w: Words) -> list[pa.Array]:
        g = Graphs(w)
        doc, s, t = contracted(g)
        begin = np.searchsorted(doc, np.arange(w.n + 1)).tolist()
        s_, t_ = (s + 1).tolist(), (t + 1).tolist()
        at, paths = [], []
        for d, (lo, hi) in enumerate(zip(begin, begin[1:], strict=False)):
            if hi > lo:
                got = cover(s_[lo:hi], t_[lo:hi])
                paths += got
                at += [d] * len(got)
        width = max(1, w.known)
        alone = np.setdiff1d(g.doc[g.wanted] * width + g.api[g.wanted], np.r_[doc * width + s, doc * width + t])
        flat = np.r_[np.array([v for p in paths for v in p], np.int64), alone % width + 1]
        sizes = np.r_[np.array([len(p) for p in paths], np.int64), np.ones(len(alone), np.int64)]
        return [ids.take(pa.array(np.r_[np.array(at, np.int64), alone // width])), _lists(flat, sizes, pa.int32())]

    return over(texts, known, "sample_id bigint, api_ids array<int>", work)


def merged_values(texts: DataFrame, known: list[str], weights: list[int], tenths: int = 3) -> DataFrame:
    """(sample_id, comp_id, value) as of ``sequences.merged_values``, with whole weights by known word."""
    weight = np.array(weights, float)

    def work(ids: pa.Array, w: Words) -> list[pa.Array]:
        doc, line, value = values(w, weight, tenths)
        return [ids.take(pa.array(doc)), pa.array(line, pa.int32()), pa.array(value, pa.int64())]

    return over(texts, known, "sample_id bigint, comp_id int, value bigint", work)
