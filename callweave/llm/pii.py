"""Surrogates for personal data, with DataFrame functions only.

Entities are mail addresses, card numbers, social security numbers, phone numbers,
network addresses and titled names. Equal entities (after folding case and signs) get
one surrogate everywhere, made from a keyed hash and laid into the mention's own format.
Names are replaced word by word, so that a person stays one with and without the first
name, the title and its dot: a surname keeps its script and length, a first name also the
gender that its title tells. Mailboxes of one domain stay in one domain, card numbers
keep a right check digit. Surrogates are checked against each other and against all
originals; losers are drawn again until all are distinct.

Names without one of the titles below are not found.

Defined results: null texts stay null with no entity; texts without an entity stay as
they are; texts of any length are read whole; repeated rows, and rows without an id, each
get their replacements; of entities that draw the same surrogate the one drawn first, then
the smaller, keeps it; an empty table gives no rows; other columns are kept, and a column
``n_entities`` is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, fresh, perhaps_in, refuse, table

# Patterns by type in order of precedence, titles by gender, name parts by script.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "net": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9A-Za-z])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "name": r"\b(?:Mr|Mrs|Miss|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|Господин|Госпожа)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
MALE = r"^(Mr|Herr|Monsieur|Señor|Господин)\b"
UNTOLD = r"^(Dr|Prof)\b"
PARTS = {"latin": "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split(), "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то".split()}
#: Last letters by script and kind of a name's word.
ENDS = {"latin": {"male": "n", "female": "a", "untold": "e"}, "cyrillic": {"male": "н", "female": "а", "untold": "е"}}
WORDS = ("last", "male", "female", "untold")
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _kind(hit: Column) -> Column:
    out = F.lit("name")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(hit.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _entities(hit: Column) -> Column:
    """array<struct<kind, canon>> of a mention: one, or a name's words."""
    kind = _kind(hit)
    digits = F.regexp_replace(hit, "[^0-9]", "")
    canon = F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "social"), digits).when(kind == "net", hit).otherwise(F.lower(hit))
    words = F.slice(F.split(hit, " "), 2, 2)
    gender = F.when(hit.rlike(UNTOLD), "untold").when(hit.rlike(MALE), "male").otherwise("female")
    named = F.transform(words, lambda w, i: F.struct(F.when(i + 1 < F.size(words), gender).otherwise("last").alias("kind"), F.lower(w).alias("canon")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"))))


def _hash(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    inner = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(f"{key}|"), inner).cast("binary"), 256)


def _byte(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")


def _checked(digits: Column) -> Column:
    """Digits with the last one set so that the sum by alternate doubling ends in 0."""
    n = F.char_length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), add)
    return F.concat(F.substring(digits, F.lit(1), n - 1), ((10 - total % 10) % 10).cast("string"))


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical surrogate: digits, an address, or a word of a name."""
    h = _hash(key, kind, canon, attempt)
    digits = F.substring(F.translate(h, "abcdef", "012345"), F.lit(1), F.char_length(canon))
    net = F.concat_ws(".", *[(_byte(h, i) % 254 + 1).cast("string") for i in range(4)])
    domain = F.substring(_hash(key, F.lit("domain"), F.substring_index(canon, "@", -1), F.lit(0)), 1, 10)
    mail = F.concat(F.lit("user."), F.substring(h, 1, 12), F.lit("@d"), domain, F.lit(".example.net"))

    def word(script: str) -> Column:
        parts = F.array(*[F.lit(x) for x in PARTS[script]])
        syllables = F.array_join(F.array(*[F.get(parts, _byte(h, i) % len(PARTS[script])) for i in range(16)]), "")
        end = F.lit("")
        for k, letter in ENDS[script].items():
            end = F.when(kind == k, F.lit(letter)).otherwise(end)
        # As long as the original; where short words run out, a letter more every eighth time.
        length = F.least(F.greatest(F.char_length(canon) - F.char_length(end), F.lit(3)) + F.floor(attempt / 8).cast("int"), F.lit(32))
        return F.initcap(F.concat(F.substring(syllables, F.lit(1), length), end))

    words = F.when(canon.rlike(r"\p{IsCyrillic}"), word("cyrillic")).otherwise(word("latin"))
    return F.when(kind == "mail", mail).when(kind == "net", net).when(kind.isin(*WORDS), words).when(kind == "card", _checked(digits)).otherwise(digits)


def _lay(hit: Column, kind: Column, new: Column) -> Column:
    """Digits in the format of a mention; a country prefix stays. Others as they are."""
    total = F.char_length(F.regexp_replace(hit, "[^0-9]", ""))
    skip = total - F.char_length(new)

    def put(acc: Column, ch: Column) -> Column:
        digit = ch.rlike("[0-9]")
        k = acc["k"] + digit.cast("int")
        return F.struct(k.alias("k"), F.concat(acc["o"], F.when(digit & (k > skip), F.substring(new, k - skip, F.lit(1))).otherwise(ch)).alias("o"))

    filled = F.aggregate(F.split(hit, ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("o")), put, lambda a: a["o"])
    return F.when(kind.isin("card", "social", "phone"), filled).otherwise(new)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, new) with distinct ``new``, none of them an original, from distinct (kind, canon); words of names are one group."""
    group = F.when(F.col("kind").isin(*WORDS), "name").otherwise(F.col("kind"))
    now = cut(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)))
    while True:
        tried = now.withColumn("new", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("g", group).withColumn("low", F.lower("new"))
        first = tried.groupBy("g", "low").agg(F.min(F.struct("attempt", "kind", "canon")).alias("w")).select("g", "low", F.col("w.kind").alias("wk"), F.col("w.canon").alias("wc"))
        real = now.select(group.alias("g"), F.col("canon").alias("low"), F.lit(True).alias("taken")).distinct()
        seen = tried.join(first, ["g", "low"]).join(real, ["g", "low"], "left")
        lost = (F.col("wc") != F.col("canon")) | (F.col("wk") != F.col("kind")) | F.col("taken").isNotNull()
        seen = cut(seen.select("kind", "canon", "attempt", "new", lost.alias("lost")))
        drop(now)
        if seen.where("lost").isEmpty():
            return seen.select("kind", "canon", "new")
        now = cut(seen.select("kind", "canon", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt")))
        drop(seen)


def replace(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Put surrogates, drawn with ``key``, into ``text_col`` and add ``n_entities``. Only rows with entities are shuffled."""
    refuse(df, "n_entities")
    mark, maps, place = fresh(df, "_text_key", "_names", "_in")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.regexp_extract_all(text, F.lit(ALL), F.lit(0))
    found = df.select(F.xxhash64(text).alias("t"), F.array_distinct(hits).alias("hits")).where(F.size("hits") > 0)
    found = cut(found.select("t", F.explode("hits").alias("hit")).distinct())
    words = found.select("hit").distinct().select("hit", F.posexplode(_entities(F.col("hit"))).alias("at", "e")).select("hit", "at", "e.*")
    words = cut(words)
    given = words.join(assign(words, key), ["kind", "canon"]).select("hit", "at", _lay(F.col("hit"), F.col("kind"), F.col("new")).alias("new"))
    given = given.groupBy("hit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new"))
    title = F.when(_kind(F.col("hit")) == "name", F.regexp_extract("hit", r"^(\S+ )", 1)).otherwise(F.lit(""))
    named = found.join(given, "hit").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("hit", F.concat(title, "new")))).alias(maps))
    texts = cut(named.withColumnRenamed("t", mark))
    ids = texts.select(mark)
    marked = perhaps_in(df.withColumn(mark, F.xxhash64(text)), mark, ids, ids.count(), place)
    plain = marked.where(~F.col(place)).select(*df.columns, F.lit(0).cast("long").alias("n_entities"))
    both = marked.where(F.col(place)).join(texts, mark, "left")
    parts = F.zip_with(F.split(text, ALL, -1), hits, lambda gap, h: F.concat(gap, F.coalesce(F.element_at(maps, h), F.lit(""))))
    n = F.when(F.col(maps).isNull(), 0).otherwise(F.size(hits)).cast("long")
    out = both.withColumn("n_entities", n).withColumn(text_col, F.when(F.col(maps).isNull(), F.col(text_col)).otherwise(F.array_join(parts, "")))
    return plain.unionByName(out.select(*df.columns, "n_entities"))


def op5(spark, sf_dir):
    key = spark.conf.get("spark.callweave.surrogate.key", "a key for tables without real persons")
    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
