"""Secret scans with DataFrame functions only.

Base patterns give spans per kind; the entropy scan adds spans: a window slides over
each candidate string, the counts of its characters change by one per step, and the
window's Shannon entropy follows from them. A candidate whose best window reaches
the bar of its character class is a span unless the allow list names it.

Spans are in code points, end exclusive. Defined results: null texts are empty (and
stay null when struck out); empty texts have no spans; texts of any length are read
whole; repeated rows each have their spans; ties (spans at one start) go by kind as
listed; an empty table gives no rows; other columns are kept, and an output name that is
taken is refused (``redact`` adds none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, refuse, table

# The base patterns, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Strings that look random but are not secrets: one letter case or digits alone, UUIDs, rules, paths, samples.
ALLOW = r"^([A-Z]?[a-z]+|[A-Z]+|[0-9]+|[-_=+/]+|[A-Za-z]*[-_=/]{5,}[A-Za-z]*|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(/?[a-z]+){2,}/?|.*(?i:example|sample|dummy|xxxx).*)$"
WINDOW = 20
#: Character classes of a candidate, first match first, and the entropy that a window of it must reach.
BARS = {"hex": ("^[0-9a-fA-F]+$", 3.0), "upper": ("^[A-Z0-9]+$", 3.6), "lower": ("^[a-z0-9]+$", 3.6), "mixed": ("", 3.8)}


def _places(text: Column, pattern: str) -> Column:
    """array<struct<s,e,h>> of the matches; gaps and matches alternate, so lengths give places."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.arrays_zip(gaps.alias("g"), hits.alias("h"))
    init = F.struct(F.lit(0).alias("p"), F.expr("cast(array() as array<struct<s:int,e:int,h:string>>)").alias("o"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["p"] + x["g"]
        e = s + F.char_length(x["h"])
        one = F.struct(s.alias("s"), e.alias("e"), x["h"].alias("h"))
        return F.struct(F.coalesce(e, acc["p"]).alias("p"), F.when(x["h"].isNull(), acc["o"]).otherwise(F.concat(acc["o"], F.array(one))).alias("o"))

    return F.aggregate(steps, init, add, lambda acc: acc["o"])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: an expression inside a lambda would be computed anew at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def best_entropy(text: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of a window over a string.

    The string is split once. A step changes two counts by one, and by them the window's sum of c * log2 c; a count is that of
    its character among the window's, so a step costs the window's width at most, whatever the string's length.
    """

    def f(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def slide(chars: Column) -> Column:
        init = F.struct(F.lit(0.0).alias("s"), F.lit(float("inf")).alias("low"))

        def step(acc: Column, i: Column) -> Column:
            # Between the character that leaves and the one that enters lie window - 1 others, or all so far.
            kept = F.slice(chars, F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1)))

            def count(c: Column) -> Column:
                return F.size(F.filter(kept, lambda x: x == c))

            new, old = F.get(chars, i), F.get(chars, i - window)
            up, down = count(new), count(old)
            out = F.when(i >= window, f(down) - f(down + 1)).otherwise(F.lit(0.0))
            s = acc["s"] + f(up + 1) - f(up) + out
            return F.struct(s.alias("s"), F.when(i >= window - 1, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), init, step, lambda acc: acc["low"])

    low = _let(F.split(text, ""), slide)
    return F.when(F.char_length(text) >= window, F.lit(0.0) + F.log2(F.lit(float(window))) - low / window).otherwise(F.lit(0.0))


def find(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add ``spans_col``: array<struct<s,k,e,kind>> by start, then kind."""
    refuse(df, spans_col)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def tag(spans: Column, k: int, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    assign = F.filter(_places(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["h"], ASSIGN, 2)) >= 12)

    def bar(h: Column) -> Column:
        out = F.lit(BARS["mixed"][1])
        for kind in ("lower", "upper", "hex"):
            out = F.when(h.rlike(BARS[kind][0]), BARS[kind][1]).otherwise(out)
        return out

    random = F.filter(_places(text, CANDIDATE), lambda x: ~x["h"].rlike(ALLOW) & (best_entropy(x["h"]) >= bar(x["h"])))
    parts = [tag(assign, 0, "assign"), tag(_places(text, ACCESS), 1, "access"), tag(_places(text, HEX), 2, "hex"), tag(random, 3, "entropy")]
    return df.withColumn(spans_col, F.array_sort(F.concat(*parts)))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span; null texts stay null, texts without spans stay as they are."""
    (spans,) = fresh(df, "_spans")
    found = find(df, text_col, spans)
    text = F.col(text_col)
    init = F.struct(F.lit(0).alias("p"), F.lit("").alias("o"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["p"] + 1, x["s"] - acc["p"])
        fresh = F.concat(acc["o"], gap, F.lit(mark))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.when(x["s"] >= acc["p"], fresh).otherwise(acc["o"]).alias("o"))

    tail = lambda acc: F.concat(acc["o"], F.substring(text, acc["p"] + 1, F.char_length(text)))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, init, add, tail)).otherwise(text)
    return found.withColumn(text_col, clean).select(*df.columns)


def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, spans_col="all_spans")

    def count(k: int) -> Column:
        return F.size(F.filter("all_spans", lambda x: x["k"] == k)).cast("long")

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    base = F.filter("all_spans", lambda x: x["k"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("all_spans")).alias("spans"),
    )
