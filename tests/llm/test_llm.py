import math
import random
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callweave.llm import ann, common, langid, minhash, mixing, pii, quality_crf, secret_scan, sentencepiece_bpe, warc, webp

TEXTS = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, " ".join(f"w{i}" for i in range(3000))), (5, "é " * 50)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", t) for i, t in TEXTS], "doc_id long, text string, source string, extra string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_minhash(spark, docs, empty):
    base = [f"a{i}" for i in range(100)]
    near = base[:50] + ["zzz"] + base[50:]
    rows = spark.createDataFrame([(7, " ".join(base)), (8, " ".join(near)), (9, "far away from all of this")], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {r["id"]: (r["n"], r["comp"]) for r in minhash.near_duplicates(rows).collect()}
    assert got[8] == (97, 7) and got[9] == (2, 9) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3)
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_families(spark):
    """Families whose members link only in part, against every pair."""
    rng, rows = random.Random(5), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range((40, 90, 160)[family])]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(7)):
                at = rng.randrange(len(words))
                words[at : at + rng.choice((0, 1, 3))] = rng.choice(([], [f"e{rng.randrange(9)}"], [f"u{rng.random()}"]))
            rows.append((len(rows), " ".join(words[: rng.choice((len(words), len(words) * 9 // 10))])))
    grams = [{tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} for w in (t.split() for _, t in rows)]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                lo, hi = sorted((comp[i], comp[j]))
                comp = [lo if c == hi else c for c in comp]
    got = {r["id"]: r["comp"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == dict(enumerate(comp)) and 10 < len(set(comp)) < 170


def test_secrets(spark, docs, empty):
    text = 'é token = "aB3xY9qLm2Zk7Rt5" then deadbeefdeadbeef end'
    row = secret_scan.find(spark.createDataFrame([(text,)], "text string")).first()
    assert {(x["kind"], x["s"]) for x in row["spans"]} == {("assign", 2), ("hex", text.index("dead"))}
    clean = secret_scan.redact(spark.createDataFrame([(text,)], "text string")).first()["text"]
    assert "deadbeef" not in clean and "aB3x" not in clean and clean.endswith(" end")
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.find(empty).count() == 0


def test_entropy(spark):
    """Against counting each window anew; long strings end in time that grows with their length."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcXYZ0189+/"[: rng.randrange(2, 13)]) for _ in range(n)) for n in (1, 19, 20, 21, 57, 300)] + ["a" * 40]

    def brute(t, w=20):
        best = 0.0
        for i in range(len(t) - w + 1):
            counts = [t[i : i + w].count(c) for c in set(t[i : i + w])]
            best = max(best, -sum(c / w * math.log2(c / w) for c in counts))
        return best

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["h"] for r in rows.select("t", secret_scan.best_entropy(F.col("t")).alias("h")).collect()}
    assert got == pytest.approx({t: brute(t) for t in texts}, abs=1e-9)
    long = spark.createDataFrame([("data " + "aB3/" * 50_000,)], "text string")
    start = time.time()
    assert len(secret_scan.find(long).first()["spans"]) == 0 and time.time() - start < 60


def test_secrets_base(spark):
    """Base spans of sf0.01 against plain regular expressions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rules = [(secret_scan.ASSIGN, 12), (r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16)]
    want = {}
    for r in docs.collect():
        spans = []
        for k, (rule, least) in enumerate(rules):
            spans += [(m.start(), k, m.end()) for m in re.finditer(rule, r["text"] or "") if len(m.group(2) if not k else m.group()) >= least]
        want[r["doc_id"]] = sorted(spans)
    got = {r["doc_id"]: [(x["s"], x["k"], x["e"]) for x in r["spans"] if x["k"] < 3] for r in secret_scan.find(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_pii(spark, docs, empty):
    text = "Ask a.b@c.org or A.B@c.org, +1 (743) 555-3824 and 743-555-3824; d@c.org, card 4111 1111 1111 1111"
    people = "Mr Smith and Mr. Smith met Mr John Smith, Mrs Smith, Dr. Jane Smith and Господин Петров."
    rows = spark.createDataFrame([(1, text), (2, "plain"), (3, people), (None, text), (3, people)], "doc_id long, text string")
    out = pii.replace(rows.withColumn("_names", rows.text).withColumn("_i", rows.doc_id), "k").orderBy("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in out}
    one = got[1]["text"]
    assert len(out) == 5 and got[None]["text"] == one and (got[2]["n_entities"], got[2]["text"]) == (0, "plain")
    mails = re.findall(r"\S+@\w+\.example\.net", one)
    phones = [re.sub(r"\D", "", x)[-10:] for x in re.findall(r"(?:\+1 )?\(?\d{3}\)?[ -]\d{3}-\d{4}", one)]
    assert got[1]["n_entities"] == 6 and mails[0] == mails[1] != mails[2] and len({m.split("@")[1] for m in mails}) == 1
    assert phones[0] == phones[1] != "7435553824"
    card = [int(c) for c in re.search(r"card (\d{4} \d{4} \d{4} \d{4})$", one)[1].replace(" ", "")]
    assert sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(card)) % 10 == 0 and "4111" not in one
    m = re.fullmatch(r"Mr (\w+) and Mr\. (\w+) met Mr (\w+) (\w+), Mrs (\w+), Dr\. (\w+) (\w+) and Господин (\w+)\.", got[3]["text"]).groups()
    assert m[0] == m[1] == m[3] == m[4] == m[6] != "Smith" and len(m[0]) == 5 and m[2].endswith("n") and len({m[0], m[2], m[5]}) == 3
    assert re.fullmatch("[А-Я][а-я]+", m[7]) and m[7] != "Петров"
    assert pii.replace(empty, "k").count() == 0 and pii.replace(docs, "k").count() == len(TEXTS)
    other = pii.replace(rows, "other key").where("doc_id = 1").first()["text"]
    assert other != one
    start = time.time()
    assert pii.replace(spark.createDataFrame([(1, "a" * 200_000)], "doc_id long, text string"), "k").first()["n_entities"] == 0 and time.time() - start < 60


def test_pii_collisions(spark):
    """Short names run out of words of their length: still all distinct, and none an original."""
    names = spark.createDataFrame([("last", f"{a}{b}{c}") for a in "bdklmn" for b in "aeio" for c in "bdkl"], "kind string, canon string")
    got = {r["canon"]: r["new"].lower() for r in pii.assign(names, "k").collect()}
    assert len(set(got.values())) == len(got) == 96 and not set(got) & set(got.values())


def test_webp():
    prose = " ".join(f"the word{i % 7} of page{i * i % 31}" for i in range(900))
    for text in (None, "", "é" * 5000, "x" * 192, prose, "ab" * 400_000, "".join(map(chr, range(32, 400)))):
        n, data = webp.store(text)
        raw = webp.payload_of(webp.decode(data))
        assert raw[:n] == (text or "").encode() and raw[n:] == b" " * (len(raw) - n) and len(raw) % 192 == 0
    assert len(webp.store(prose)[1]) < len(prose) / 2
    with pytest.raises(ValueError):
        webp.decode(webp.store("abc")[1][:-10])
    broken = bytearray(webp.store(prose)[1])
    for at in range(40, 200):
        broken[at] ^= 0x5A
    with pytest.raises(ValueError):
        assert webp.payload_of(webp.decode(bytes(broken))) != webp.payload_of(webp.decode(webp.store(prose)[1]))
        raise ValueError("other pixels")


def test_webp_paths():
    """Every transform, the cache, groups of codes and back-references, on noise, slopes and few colours."""
    rng = np.random.default_rng(0)
    for w, h in ((1, 1), (5, 3), (40, 33), (17, 70)):
        noise = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        noise[: h // 2], noise[:, : w // 3] = noise[:1], noise[:, :1]
        slope = (np.add.outer(np.arange(h), np.arange(w))[..., None] // 3 + np.arange(4)).astype(np.uint8)
        few = rng.integers(0, 256, (3, 4)).astype(np.uint8)[rng.integers(0, 3, (h, w))]
        plans = [{}, {"split": 3}, {"palette": False}, {"predict": 2}, {"cross": (5, -7, 100)}, {"green": True}, {"cache": 4}, {"cache": 11, "split": 2, "predict": 3, "cross": (1, 2, 3), "green": True}]
        for image in (noise, slope, few):
            for plan in plans:
                full = plan if plan in ({}, {"split": 3}) else {"palette": False, **plan}
                assert (webp.decode(webp.encode(image, **full))[0] == image).all(), (w, h, plan)


def test_webp_features(spark, docs, empty):
    out = webp.features(webp.media(docs)).collect()
    assert len(out) == len(TEXTS) and webp.features(webp.media(empty)).count() == 0
    assert all(r["px"]["payload_bytes"] >= max(192, r["n_bytes"]) and r["px"]["payload_bytes"] % 192 == 0 for r in out)


def test_webp_parts():
    px = np.array([0xFF010203, 0x01020304], np.uint32)
    assert webp._unpredict(px, 2, 1, 2, np.array([0], np.uint32)).tolist() == [0xFE010203, 0xFF030507]
    bits = webp.Bits(bytes([0b0110]))
    code = webp.Code([1, 2, 2])
    assert [code.read(bits) for _ in range(3)] == [0, 2, 0]


def test_warc(spark):
    pages = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "v", "é"), (5, "w", "twice"), (5, "w", "twice"), (None, "x", "alone"), (None, "x", "same"), (6, None, "y" * 300_000)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = warc.read(warc.archive(pages.withColumn("row", pages.url).withColumn("d", pages.url))).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    assert got == sorted([
        (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "response", None), (4, 2, "response", None), (5, 5, "response", None), (5, 5, "revisit", 5),
        (None, 5, "response", None), (None, 4, "revisit", 2), (6, 300_000, "response", None),
    ], key=str)
    assert {r["payload"] for r in rows} == {b"same", b"", "é".encode(), b"twice", b"alone", b"y" * 300_000, None}
    assert warc.read(warc.archive(pages.where("false"))).count() == 0
    with_least = {(r["page_id"], r["record_type"]) for r in warc.read(warc.archive(pages, least=5)).collect()}
    assert (1, "response") in with_least and (5, "revisit") in with_least
    data = warc.pack([warc.record(1, "u", b"payload", None, False)])
    for broken in (data[:-9], data[:5], b"", data[:-8] + bytes([data[-8] ^ 1]) + data[-7:]):
        with pytest.raises(ValueError):
            list(warc.unpack(broken))


def test_language(spark, docs, empty):
    rows = spark.createDataFrame([("the thing of the land", "en"), ("der und die das ich", "de")], "text string, lang string")
    found = langid.predict(rows, langid.learn(rows)).collect()
    assert [r["lang_id"]["lang"] for r in found] == ["en", "de"]
    assert {r["lang_id"]["lang"] for r in langid.predict(docs.where("doc_id < 3"), langid.learn(rows)).collect()} == {"und"}
    assert langid.learn(rows.where("false")) == {} and langid.predict(empty, {}).count() == 0
    odd = spark.createDataFrame([("½ ² Ⅷ 12 _",), ("№",), ("!?",)], "text string")
    assert {r["lang_id"]["lang"] for r in langid.predict(odd, langid.learn(rows)).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(rows.withColumn("Lang_id", rows.lang), {})
    assert len(langid.predict(docs.withColumn("v", docs.text), langid.learn(rows)).collect()) == len(TEXTS)


def _enumerated(e, t, y=None):
    """P(good) of each line and the likelihood's log normaliser by all labellings."""
    n, total, good = len(e), 0.0, np.zeros(len(e))
    for y in np.ndindex(*[2] * n):
        p = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(1, n)))
        total, good = total + p, good + p * np.array(y)
    return good / total, np.log(total)


def test_quality():
    assert quality_crf.marginals(np.array([0.3, -0.2, 1.0]), np.zeros((2, 2))) == pytest.approx(1 / (1 + np.exp(-np.array([0.3, -0.2, 1.0]))))
    e, t = np.array([0.5, -1.0, 0.2, 0.7]), np.array([[0.7, -0.1], [0.2, 0.9]])
    assert quality_crf.marginals(e, t) == pytest.approx(_enumerated(e, t)[0])
    assert quality_crf.line_features(None)[0].shape == quality_crf.line_features("")[0].shape
    # Expectations of several chains at once, against enumeration; the joint table by a numeric derivative.
    chains = quality_crf.Chains([3, 1, 4], piece=8)
    flat = np.array([0.5, -1.0, 0.2, 0.7, 1.5, -0.3, 0.1, -2.0])
    one, pair = chains.expect(np.exp(flat[chains.order]), np.exp(t))
    back = np.empty(8)
    back[chains.order] = one
    assert back == pytest.approx(np.concatenate([_enumerated(flat[lo:hi], t)[0] for lo, hi in ((0, 3), (3, 4), (4, 8))]))
    for a in (0, 1):
        for b in (0, 1):
            d = np.zeros((2, 2))
            d[a, b] = 1e-5
            slope = sum(_enumerated(flat[lo:hi], t + d)[1] - _enumerated(flat[lo:hi], t - d)[1] for lo, hi in ((0, 3), (4, 8))) / 2e-5
            assert pair[:, 2 * a + b].sum() == pytest.approx(slope, abs=1e-6)


def test_quality_learning(spark, docs, empty):
    """Learnt from bad documents that hold good lines; scores of texts never seen, and transitions that tell staying from changing."""
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(("the", "house", "stood", "near", "water", "under", "old", "trees")) for _ in range(9)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(("BUY", "$$$", "##", "99%", "!!!", "<<", "click")) for _ in range(4))
    texts = ["\n".join(good() if y or 2 <= j < 5 else bad() for j in range(8)) for y in (0, 1) * 60]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _x string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (7, None), (5000, 1)], "doc_id long, quality int")
    model = quality_crf.learn(rows, labels)
    w, tr, *_ = model
    assert tr[0, 0] > tr[0, 1] and tr[1, 1] > tr[1, 0]
    out = {r["doc_id"]: r["score"] for r in quality_crf.score(rows, model).collect()}
    assert all((out[i] > 0.5) == (i % 2 == 1) for i in range(80, 120))
    assert all(0 <= r["score"] <= 1 for r in quality_crf.score(docs, model).collect()) and quality_crf.score(empty, model).count() == 0
    assert quality_crf.learn(rows, labels.where("quality = 1")) is None and quality_crf.learn(empty, labels) is None
    assert {r["score"] for r in quality_crf.score(docs, None).collect()} == {0.5}
    with pytest.raises(ValueError):
        quality_crf.score(docs.withColumn("Score", docs.doc_id), None)


def test_mixing(spark, docs, empty):
    rng = random.Random(4)
    rows = [(i, " ".join(["a"] * int(rng.paretovariate(1.5) * 10)), ("s", "t", "u", None)[i % 4 if i % 3 else 0]) for i in range(3000)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(rows).collect()
    assert len(out) == 3000 and all(0 <= r["copies"] <= 2 for r in out)
    for size in {r["source_size"] for r in out}:
        part = [r for r in out if r["source_size"] == size]
        assert sum(r["size"] for r in part) == size
        assert abs(sum(r["copies"] * r["size"] for r in part) - part[0]["target"]) <= 0.01 * part[0]["target"]
    assert mixing.mix(rows).orderBy("id").collect() == sorted(out)
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.withColumn("copies", docs.text).withColumn("row", docs.text)).count() == len(TEXTS)
    twice = mixing.mix(rows.union(rows)).collect()
    assert len(twice) == 6000 and abs(sum(r["copies"] * r["size"] for r in twice) - 2 * sum(r["copies"] * r["size"] for r in out)) <= 0.02 * sum(r["size"] for r in twice)


def test_mixing_expectation():
    """Each document keeps its expected copies: brute force over many draws."""
    pdf = pd.DataFrame({"row": range(4), "id": range(4), "src": 0, "size": [7, 5, 3, 1], "p": [0.3, 0.6, 0.5, 0.9], "chunk": 0})
    total = np.zeros(4)
    for level in range(4000):
        total += mixing._pivot(pdf, level, True).sort_values("id")["extra"].to_numpy()
    assert total / 4000 == pytest.approx(pdf["p"].to_numpy(), abs=0.03)


def test_targets():
    got = mixing.targets([("b", 100), ("a", 10), (None, 1000)])
    assert [s for s, *_ in got] == ["a", "b", None] and [t for *_, t in got] == pytest.approx([20, 200, 1445])


def test_neighbours(spark):
    rng = random.Random(1)
    vs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0] * 8), (304, [1.0] * 8)]
    rows = spark.createDataFrame(vs, "vec_id long, v array<double>")
    got = ann.search(rows, rows.where("vec_id in (0, 100, 303)"), "vec_id", "v").collect()
    assert len(got) == 30 and [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 303 and r["rank"] == 1] == [(304, 0.0)]
    assert ann.search(rows.where("false"), rows.where("false"), "vec_id", "v").count() == 0
    twice = rows.union(rows).union(spark.createDataFrame([(None, [1.0] * 8)], rows.schema)).withColumn("id", F.lit("x"))
    assert sorted(ann.search(twice, twice.where("vec_id in (0, 100, 303)"), "vec_id", "v").collect()) == sorted(got)


def test_neighbours_exact(spark):
    """Where all leaves are looked at, every answer is that of brute force."""
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((700, 6)), 1)  # with ties
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(rows, rows.where("vec_id % 100 = 0"), "vec_id", "v").collect()}
    want = {}
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        want |= {(q, n): (i, d[i]) for n, i in enumerate(order, 1)}
    assert {k: v[0] for k, v in got.items()} == {k: int(v[0]) for k, v in want.items()} and all(got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_neighbours_recall(spark, tmp_path):
    """Above the fixed budget and above the sample, against brute force."""
    rng = np.random.default_rng(3)
    for n in (5_000, 8_000, 24_000):
        x = rng.standard_normal((n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        pd.DataFrame({"vec_id": np.arange(n), "v": list(x)}).to_parquet(tmp_path / f"{n}.parquet")
        rows = spark.read.parquet(str(tmp_path / f"{n}.parquet"))
        found = {(r["query_id"], r["vec_id"]) for r in ann.search(rows, rows.where("vec_id < 60"), "vec_id", "v").collect()}
        d = ((x[:60, None].astype(float) - x[None]) ** 2).sum(axis=2)
        d[np.arange(60), np.arange(60)] = np.inf
        true = {(q, int(i)) for q in range(60) for i in np.argsort(d[q], kind="stable")[:10]}
        assert len(found) == 600 and len(found & true) >= 540, n


def test_pieces(spark, docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, path), path).collect():
        want = other.encode(r["text"] or "") + [2]
        assert list(r["ids"]) == want and r["decoded"] == other.decode(want)


def test_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, kept in ((str(64 << 20), str(common.BATCH_BYTES)), ("1024", "1024"), ("1g", str(common.BATCH_BYTES))):
            spark.conf.set(name, given)
            common.small_batches(spark.range(1))
            assert spark.conf.get(name).rstrip("b") == kept
    finally:
        spark.conf.set(name, before)
