"""MinHash near-duplicate classes.

Each text becomes its set of distinct word shingles. One hash per shingle feeds a
one-permutation sketch whose empty bins are filled by optimal densification; bands
of the sketch are the buckets. Inside a bucket only stars are compared: the head
against the others. Members of buckets that do not become one class by that are dealt
anew, by their rarest shingles: texts that are similar enough share one among so many of
the rarest of each that the sizes allow no pair without (prefix filtering, which is exact).
In these buckets further stars open, ever more each round, until a bucket holds one
class or every pair in it was looked at. So no bucket is capped, and only texts that share
even their rare shingles are ever compared in all pairs. Every link is confirmed on the
full sets. Equal sets are folded into one representative beforehand.

Only sketches are made of all texts. Sets are made of texts that share a bucket, once, and
each round ships the sets of its own pairs and open texts only. Sets hold 64-bit hashes of shingles: that
two different shingles of one pair of texts get one hash has odds of n * n / 2e19 for n
shingles, 1 in 4e10 for texts of 20,000 words. A pair at the bar of 0.8 misses all first
buckets with odds of 1 in 2e7.

Defined results: null, empty and blank texts have no shingles and link with nothing;
texts shorter than a shingle are one shingle as a whole; texts of any length are read
whole; rows of one id are one class, each gives a row with its own set size, and the
text of each is compared; rows without an id have no class (null) and link with nothing; of tied heads
the smaller id counts; an empty table gives no rows; other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import at_work, cut, drop, fresh, only, perhaps_in, small_batches, table

BINS = 128
#: Bins of a bucket's key.
ROWS = 4
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ATTEMPTS = np.random.default_rng(7).integers(0, BINS, (4096, BINS), dtype=np.int64)
_BAND = np.arange(1, BINS // ROWS + 1, dtype=np.uint64) * _M2
_STARTS = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.array([words[t] for t in tokens], np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        out = _mix(out * _M1 + h[i : i + n])
    return np.unique(out)


def bins(found: np.ndarray) -> np.ndarray:
    """Densified sketch of a sorted, non-empty shingle set."""
    at = np.searchsorted(found, _STARTS)
    value = found[np.minimum(at, len(found) - 1)]
    full = (at < len(found)) & (value >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    empty = np.flatnonzero(~full)
    donors = np.arange(BINS)
    lo, hi = 0, 32
    while len(empty) and lo < len(_ATTEMPTS):
        tries = _ATTEMPTS[lo:hi, empty]
        ok = full[tries]
        first = ok.argmax(axis=0)
        hit = ok[first, np.arange(len(empty))]
        donors[empty[hit]] = tries[first, np.arange(len(empty))][hit]
        empty, lo, hi = empty[~hit], hi, hi * 4
    donors[empty] = np.flatnonzero(full)[0]
    return value[donors]


def bands(found: np.ndarray) -> np.ndarray:
    """Bucket keys of a sorted, non-empty shingle set."""
    v = bins(found).reshape(-1, ROWS)
    key = _BAND.copy()
    for i in range(ROWS):
        key = _mix(key * _M1 + v[:, i])
    return key.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, fp, bands) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        with at_work("minhash"):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part, n, fps, keys = batch.slice(lo, 1024), [], [], []
                    for t in part.column(1):
                        s = shingles(t.as_py(), width, words)
                        n.append(len(s))
                        fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                        keys.append(bands(s) if len(s) else np.empty(0, np.int64))
                    arrays = [part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, ["id", "n", "fp", "bands"])
            words.clear()

    rows = small_batches(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, fp binary, bands array<long>")


def shingle_sets(df: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        with at_work("minhash"):
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    sets = [shingles(t.as_py(), width, words).view(np.int64) for t in part.column(1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
            words.clear()

    return small_batches(df).mapInArrow(run, "id long, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over links (a, b); ids without links are left out. The table is the caller's to drop."""
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        step = label.join(near, "id").select("id", F.least("comp", "m").alias("next"), "comp")
        jump = label.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        step = cut(step.join(jump, "next").select("id", F.col("comp").alias("old"), F.least("next", "far").alias("comp")))
        drop(label)
        label = step
        if step.where("old <> comp").isEmpty():
            drop(both)
            out = step.select("id", "comp")
            out.cut_path = step.cut_path
            return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) whose full sets are similar enough; ships the sets of these pairs."""
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = cut(only(sets, "id", ends, ends.count()))
    left = few.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = few.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    found = pairs.join(right, "b").join(left, "a")
    found = cut(found.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    drop(ends, few)
    return found


def _heads(opened: DataFrame, most: int) -> DataFrame:
    """The first ``most`` early ones of every bucket by ``o``, in two steps, so that a large bucket is nobody's alone."""
    slim = opened.where("early").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["band", "salt"], ["band"]):
        by = Window.partitionBy(*keys).orderBy("o")
        slim = slim.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).drop("r")
    return slim.selectExpr("band", "id AS a", "n AS hn", "comp AS hc", "o AS ho", "reach AS hr", "at AS ha")


def _reach(caps, n, percent: int):
    """Size of the largest text that one of ``n`` shingles can link with if it shares ``caps`` of them at the most."""
    return F.floor(caps * (100 + percent) / percent) - n


def _rare(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Open texts in buckets of their rarest shingles: (band, id, n, reach, at, early).

    Shingles are ordered by how many open texts have them. Of a text as many come first as the smallest possible partner
    must leave out of it, and one (``at`` is the place); ``early`` are those that a partner of its own size or more must leave out, and one.
    """
    ids = cut(opened.select("id").distinct())
    own = only(sets, "id", ids, ids.count()).select("id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s"))
    often = own.groupBy("s").agg(F.count("*").alias("k"))
    rows = own.join(often, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("all"))
    rows = rows.withColumn("u", F.size(F.filter("all", lambda x: x["k"] == 1))).withColumn("reach", _reach(F.col("n") - F.col("u"), F.col("n"), percent))
    far = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    near = F.col("n") - F.ceil(F.col("n") * (2 * percent / (100 + percent)) - 1e-9) + 1
    first = F.slice("all", F.lit(1), F.least(far, F.col("n")).cast("int"))
    rows = rows.where("reach > 0").select("id", "n", "reach", near.alias("near"), F.posexplode(first).alias("at", "x")).where("x.k > 1")
    out = cut(rows.select(F.col("x.s").alias("band"), "id", "n", "reach", "at", (F.col("at") < F.col("near")).alias("early")))
    drop(ids)
    return out


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (band, id, ...) of buckets with two members and more, and ``o``: those in most company come first."""
    stars = rows.groupBy("band").agg(F.count("*").alias("k")).where("k > 1")
    shared = cut(rows.join(stars, "band"))
    rank = shared.groupBy("id").agg((-F.sum("k")).alias("busy"))
    out = cut(shared.join(rank, "id").withColumn("o", F.struct("busy", "id")).drop("k", "busy"))
    drop(shared)
    return out


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members in their classes, of buckets that hold several and an early one (each pair's smaller text is), without those too
    large or too small for all others there."""
    named = cut(members.drop("comp").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    mixed = named.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("lo"), F.max("reach").alias("hi"), F.max("early").alias("e")).where("c0 <> c1 and e")
    out = cut(named.join(mixed, "band").where("n <= hi and reach >= lo").select(*named.columns))
    drop(named)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, comp) per row: the set size and the smallest id of the class."""
    every = cut(sketches(df, id_col, text_col, width))
    known = every.where("id is not null")
    reps = known.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"))
    owner = cut(known.select("id", "n", "fp").join(reps, "fp", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    first = owner.where("id = rep and n > 0").select("id").distinct()
    # An id with several rows ties their sets together; of its equal rows one is enough.
    again = cut(owner.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("k")).where("k > 1"))
    single = again.isEmpty()
    rows = known if single else known.dropDuplicates(["id", "fp"])
    rows = rows.where("n > 0").join(first, "id", "left_semi").select("id", "n", F.explode("bands").alias("band"))
    members = _shared(rows)
    ids = cut(members.select("id").distinct())
    texts = only(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", ids, ids.count())
    sets = cut(shingle_sets(texts if single else texts.dropDuplicates(), width))
    links, tested, most = cut(again.where("a <> b").select("a", "b")), None, 1
    label = components(links)
    opened = _open(members.withColumn("reach", _reach(F.col("n"), F.col("n"), percent)).withColumn("at", F.lit(0)).withColumn("early", F.lit(True)), label)
    while True:
        heads = cut(_heads(opened, most))
        pairs = opened.join(heads, "band").where("(o > ho or not early) and comp <> hc and n <= hr and hn <= reach")
        # What comes before the rarest common shingle is not shared: so much each text may leave out, and no more.
        pairs = pairs.where(f"greatest(at - n, ha - hn) + ceil({percent} * (n + hn) / {100 + percent} - 1e-9) <= 0")
        pairs = pairs.select("a", F.col("id").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        new = _confirm(pairs, sets, percent)
        seen = pairs if tested is None else cut(tested.union(pairs))
        if not new.isEmpty():
            both = cut(links.union(new))
            drop(links, label)
            links, label = both, components(both)
        rest = opened.join(heads.select("band", F.col("a").alias("id")), ["band", "id"], "left_anti")
        left = _open(rest, label)
        drop(new, opened, heads, *([] if tested is None else [pairs, tested]))
        if not left.isEmpty() and tested is None:
            rare = _rare(left, sets, percent)
            dealt = _shared(rare)
            drop(left, rare)
            left = _open(dealt, label)
            drop(dealt)
        most *= 8
        opened, tested = left, seen
        if opened.isEmpty():
            break
    drop(members, sets, ids, links, tested, again, opened)
    linked = owner.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("comp", "rep").alias("comp"))
    return linked.unionByName(every.where("id is null").select("id", "n", F.col("id").alias("comp")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class: that with the smallest id, once; rows without an id stay. Only rows that may go are shuffled."""
    found = near_duplicates(df, id_col, text_col, width, percent).where("id is not null")
    lost = cut(found.where("id <> comp").select("id").distinct())
    again = found.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    both = cut(lost.union(again))
    (mark,) = fresh(df, "_in")
    marked = perhaps_in(df, id_col, both, both.count(), mark).withColumn(mark, F.col(mark) & F.col(id_col).isNotNull())
    rest = marked.where(F.col(mark)).join(lost.select(F.col("id").alias(id_col)), id_col, "left_anti").dropDuplicates([id_col])
    return marked.where(~F.col(mark)).select(*df.columns).unionByName(rest.select(*df.columns))


def op2(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept")
    )
