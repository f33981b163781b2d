"""Mixing sources to target weights by pivotal rounding.

A document's wish is target / source size copies. The whole part is taken; the
fractions are settled by pivotal rounding: two open documents meet, and words pass from
one to the other at random, so that each keeps its expected copies and both together
their words, until one is whole. Large documents meet first. A source is cut into chunks
by hash, and at most one open row of each chunk goes up a reduction tree; only the
root's last open row is rounded at a loss, so a source misses its target by that
document's size at the most.

Targets come from one row for each source, gathered on the driver; more than ``SOURCES``
are refused.

Defined results: null and blank texts have size 0 and are never taken; a null source is
a source; a null id is an id; texts of any length are counted whole; repeated rows are
rows of their own, each with its copies; ties (equal sizes) go by id; an empty table gives
none; only id, text and source are read, whatever the other columns' names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, table

# Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
CHUNK, FAN, SOURCES = 4_000, 64, 1_000_000


def targets(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target): shares by weight, a source's excess over its cap shared again."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    size = np.array([n for _, n in order], float)
    weight = np.array([WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))], float)
    got, open_, left = np.zeros(len(order)), np.ones(len(order), bool), share * size.sum()
    while open_.any():
        wish = left / weight[open_].sum() * weight
        over = open_ & (wish > most * size)
        if not over.any():
            got[open_] = wish[open_]
            break
        got[over] = most * size[over]
        left -= got[over].sum()
        open_ &= ~over
    return [(s, n, t) for (s, n), t in zip(order, got.tolist(), strict=True)]


def _pivot(pdf: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """Settle a chunk; at most one row stays open (taken = -1) unless this is the last level."""
    pdf = pdf.sort_values(["size", "id", "row"], ascending=[False, True, True], kind="stable", ignore_index=True)
    seed = xxhash.xxh64_intdigest(f"{pdf['src'][0]}|{pdf['chunk'][0]}|{level}")
    draws = np.random.default_rng(seed).random(len(pdf) + 1)
    p, size = pdf["p"].tolist(), pdf["size"].tolist()
    hand = -1
    for i in range(len(p)):
        if p[i] <= 1e-9 or p[i] >= 1 - 1e-9:
            continue
        if hand < 0:
            hand = i
            continue
        # Copies that the one in hand can gain or lose while the other one pays with as many words.
        rate = size[i] / size[hand]
        up, down = min(1 - p[hand], p[i] * rate), min(p[hand], (1 - p[i]) * rate)
        change = up if draws[i] * (up + down) < down else -down
        p[hand], p[i] = p[hand] + change, p[i] - change / rate
        open_ = [k for k in (hand, i) if 1e-9 < p[k] < 1 - 1e-9]
        hand = open_[0] if open_ else -1
    if hand >= 0 and last:
        p[hand] = float(draws[-1] < p[hand])
        hand = -1
    done = np.round(p).astype(np.int64)
    pdf["extra"] = done
    if hand >= 0:
        pdf.loc[hand, "extra"] = -1
    pdf["p"] = p
    return pdf[["row", "id", "src", "size", "p", "chunk", "extra"]]


def _settle(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pivot(pdf, level, last)

    return run


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(id, size, source_size, target, copies) per row, and ``row``, if ``row_col`` names a number that tells rows apart."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")))
    spark = df.sparkSession
    totals = [(r["source"], r["n"], r["k"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("k")).limit(SOURCES + 1).collect()]
    if len(totals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    count = {s: k for s, _, k in totals}
    plan = [(s, i, n, t, max(1, -(-count[s] // CHUNK))) for i, (s, n, t) in enumerate(targets([(s, n) for s, n, _ in totals]))]
    goal = spark.createDataFrame(plan, "g_source string, src int, source_size long, target double, chunks int")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("g_source"))).withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    chunk = F.pmod(F.xxhash64("id", "size"), F.col("chunks")).cast("int")
    schema = "row long, id long, src int, size long, p double, chunk int, extra long"
    opened = rows.where("size > 0").select("row", F.col("id").cast("long").alias("id"), "src", "size", "p", chunk.alias("chunk"))
    width, level, settled = max([c for *_, c in plan], default=1), 0, None
    while True:
        last = width == 1
        step = cut(opened.groupBy("src", "chunk").applyInPandas(_settle(level, last), schema))
        done = step.where("extra >= 0").select("row", "extra")
        settled = done if settled is None else settled.union(done)
        if last:
            break
        opened = step.where("extra < 0").select("row", "id", "src", "size", "p", F.floor(F.col("chunk") / FAN).cast("int").alias("chunk"))
        width, level = -(-width // FAN), level + 1
    out = rows.join(settled, "row", "left")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.coalesce("extra", F.lit(0)))
    return out.select("id", "size", "source_size", "target", copies.cast("long").alias("copies"), *["row"] * bool(row_col))


def take(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``df`` as many times as the mix takes it; repeated rows each have their own copies."""
    row, n, i = fresh(df, "_row", "_n", "_i")
    keyed = cut(df.withColumn(row, F.monotonically_increasing_id()))
    found = mix(keyed, id_col, text_col, source_col, row).where("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(n))
    return keyed.join(found, row).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*df.columns)


def op10(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
