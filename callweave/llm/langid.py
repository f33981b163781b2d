"""Language identification with hyperdimensional profiles.

Letters have random bipolar vectors; an n-gram binds its letters, each rotated by its
place; a text bundles its n-grams; a language bundles the normalised vectors of all its
learning texts. The answer is the language with the nearest cosine.

Letters are what Unicode calls so; digits, other numbers, signs and marks part words.

Defined results: null texts and texts without a letter give ``und`` and score 0; with
nothing to learn from every text is ``und``; ties go to the name that sorts first; texts
of any length are read whole; repeated rows each count and each get their answer; an empty
table gives no rows; other columns are kept, and an output name that is taken is refused.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_work, refuse, small_batches, table

DIM, GRAM = 1024, 3


_GAP = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Runs of letters, parted by single blanks, in lower case."""
    flat = _GAP.sub(" ", text or "")
    odd = [c for c in set(flat) if c != " " and not c.isalpha()]  # fractions, Roman numbers and the like, which \w holds as well
    if odd:
        flat = re.sub(f"[ {''.join(odd)}]+", " ", flat)
    return flat.strip().lower()


@functools.lru_cache(maxsize=70_000)
def _letter(code: int) -> np.ndarray:
    return (np.random.default_rng(code).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


class _Grams:
    """Rows of bound vectors for n-grams, each made once; started anew when full."""

    def __init__(self, most: int = 60_000):
        self.most, self.place, self.rows = most, {}, np.zeros((1024, DIM), np.int8)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """One row for each row of letter codes."""
        if len(self.place) + len(codes) > self.most:
            self.place.clear()
        out = np.empty(len(codes), np.int64)
        for j, gram in enumerate(map(tuple, codes.tolist())):
            at = self.place.get(gram)
            if at is None:
                at = self.place[gram] = len(self.place)
                if at == len(self.rows):
                    self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
                v = np.ones(DIM, np.int8)
                for i, code in enumerate(gram):
                    v = v * np.roll(_letter(code), GRAM - 1 - i)
                self.rows[at] = v
            out[j] = at
        return self.rows[out]


_GRAMS = _Grams()


def _let_go() -> None:
    _GRAMS.__init__(_GRAMS.most)
    _letter.cache_clear()


def profile(text: str | None) -> np.ndarray | None:
    """Unit vector of a whole text, or None without a letter."""
    flat = letters(text)
    if not flat:
        return None
    codes = np.frombuffer(f" {flat} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    key = codes[: len(codes) - GRAM + 1]
    for i in range(1, GRAM):
        key = key << 21 | codes[i : len(codes) - GRAM + 1 + i]
    key, counts = np.unique(key, return_counts=True)
    counts = counts.astype(np.float32)
    grams = np.stack([key >> 21 * (GRAM - 1 - i) & 0x1FFFFF for i in range(GRAM)], 1)
    out = np.zeros(DIM, np.float32)
    for lo in range(0, len(grams), 2048):
        out += counts[lo : lo + 2048] @ _GRAMS.find(grams[lo : lo + 2048]).astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else None


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype per language, over all rows; what returns is one vector for each language."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        with at_work("langid", _let_go):
            for b in batches:
                for text, lang in zip(b["text"], b["lang"], strict=True):
                    v = profile(text)
                    if v is not None:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pd.DataFrame({"lang": lang, "at": np.arange(DIM), "v": np.round(v * 1e6).astype(np.int64)})

    rows = small_batches(df).where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sums = rows.mapInPandas(bundle, "lang string, at int, v long").groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs"))
    out = {}
    for r in found.collect():
        v = np.array([x["v"] for x in r["vs"]], np.float64)
        out[r["lang"]] = (v / (np.linalg.norm(v) or 1)).astype(np.float32)
    return dict(sorted(out.items()))


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", out_col: str = "lang_id") -> DataFrame:
    """Add ``out_col``: struct<lang, score>."""
    refuse(df, out_col)
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(-1, DIM)

    def one(text: str | None) -> tuple[str, float]:
        v = profile(text)
        if v is None or not names:
            return "und", 0.0
        cos = matrix @ v
        i = int(cos.argmax())
        return names[i], float(min(1.0, max(0.0, cos[i])))

    @F.pandas_udf("lang string, score double")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with at_work("langid", _let_go):
            for texts in batches:
                yield pd.DataFrame([one(t) for t in texts], columns=["lang", "score"])

    return small_batches(df).withColumn(out_col, best(F.col(text_col)))


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    found = predict(docs.drop("lang"), learn(docs.where(~F.col("held_out"))))
    return found.select("doc_id", "held_out", F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"))
