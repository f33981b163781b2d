import hashlib
import time

import pyarrow as pa
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from callweave.llm import langid, minhash, sentencepiece_bpe  # noqa: E402

SECRET = "aB3xY9qLm2Zk7Rt5"


def test_run(spark, tmp_path):
    """All stages against what can be said of them by hand and the library's ids."""
    words = "the cat and a dog went over to that old house with some of their best friends because it was warm".split()
    texts = {i: " ".join(words[(i * j) % len(words)] for j in range(1, 18)) + f" number{i} {i}" for i in range(2, 12)}
    texts[12] = f'{texts[2]} and token = "{SECRET}" {texts[3]} é'
    copies = {20: texts[4], 21: texts[5]}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in {**texts, **copies, 30: "", 31: None, 32: "12 34"}.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = {i: len(t.split()) for i, t in texts.items()}
    assert set(r["doc_id"] for r in out) <= set(texts)
    assert abs(sum(size[r["doc_id"]] for r in out) - 1.5 * sum(size.values())) <= max(size.values())
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in out:
        text = model.decode(list(r["ids"]))
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if r["doc_id"] == 12:
            assert SECRET not in text and text.startswith(texts[2]) and text.endswith(f"{texts[3]} é")
        else:
            assert list(r["ids"]) == model.encode(texts[r["doc_id"]]) + [2] and text == texts[r["doc_id"]]


def test_unlearnt_language(spark):
    learnt = "the cat and a dog went over to that old house with some of their best friends because it was warm and then they all came back"
    other = "az ember nem tudja, hogy mikor jön el az igazság pillanata, de mindig készen kell állnia a válaszra"
    noise = "xqzv kjwq zzxk qqvw pfgh jkxz wvqk zxcv qwzx kkjq xvbz hjqk zzvw pqxj wkkz qvvx"
    rows = [(1, learnt, "en"), (2, learnt[40:], "en"), (3, other, None), (4, noise, None), (5, learnt[:60], None), (6, "Sí", "en"), (7, "xqzv", None), (8, "12", None), (9, noise[:40], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()) == [1, 2, 5, 6, 7, 9]


def test_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, names that clash, nulls everywhere and an empty table through all stages."""
    names = "doc_id long, text string, lang string, source string, n_chars long, copies long, _spans string, _lang_id string, _row long, _in string, _n int"
    text = "the cat and a dog went over to that old house with some of their best friends because it was warm"
    other = "when many people came along they would talk about things which nobody had ever seen in this town before"
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (2, text, None, None), (None, other, "en", None), (None, None, None, None), (3, other + " again", "en", "s"), (4, "", "en", "t")]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y", 3, "z", 4) for r in rows], names)
    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.secrets, corpus_pipeline.mixture):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and stage(spark, docs.where("false"), "").count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["text"]) == sorted([(1, text), (0, other), (3, other + " again")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 3, None}


def test_caches_of_one_operator(spark):
    """A worker keeps the caches of the operator that ran last in it, not those of all stages."""

    def kept(batches):
        from callweave.llm import langid, sentencepiece_bpe  # the worker's own

        list(batches)
        time.sleep(0.5)  # so that each worker gets a task
        yield pa.RecordBatch.from_pydict({"letters": [langid._letter.cache_info().currsize + len(langid._GRAMS.place)], "models": [sentencepiece_bpe.load.cache_info().currsize]})

    def look():
        return [tuple(r) for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "letters long, models long").collect()]

    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    sentencepiece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert any(models for _, models in look())
    langid.predict(docs, {"en": langid.profile("some words")}).collect()
    found = look()
    assert any(letters for letters, _ in found) and not any(letters and models for letters, models in found)
    for _ in range(2):
        minhash.sketches(docs, "doc_id", "text", 4).collect()
    assert (0, 0) in look()
