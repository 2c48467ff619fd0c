"""Language identification: exact paths, spans, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deedlens.llm import language
from deedlens.llm.queries import QUERIES

from ..conftest import SF

DATA = "/root/testdata/sf0.01"


def one_pass(e, penalty):
    """Viterbi, word by word."""
    v, back = e[0].astype(float), []
    for x in e[1:]:
        b = v.argmax()
        back.append(np.where(v >= v[b] - penalty, np.arange(len(v)), b))
        v = np.maximum(v, v[b] - penalty) + x
    path = [int(v.argmax())]
    for s in back[::-1]:
        path.append(int(s[path[-1]]))
    return np.array(path[::-1])


@pytest.mark.parametrize("kinds", [1, 2, 7])
def test_pieces_give_the_path_of_one_pass(kinds):
    random = np.random.default_rng(kinds)
    e = [random.normal(0, 2, (n, kinds)).astype(np.float32) for n in (1, 0, 5, language.PIECE - 1, language.PIECE, language.PIECE + 1, 10 * language.PIECE)]
    for x, path in zip(e, language.viterbi(e, 3.0)):
        assert path.tolist() == (one_pass(x, 3.0).tolist() if len(x) else [])


def test_scripts_are_ranges_in_order():
    starts = [at for at, _ in language.SCRIPTS]
    assert starts == sorted(set(starts))
    words = ["Straße", "λόγος", "слово", "שלום", "كلمة", "शब्द", "ひらがな", "漢字", "한국어", "ไทย", "ＡＢ"]
    want = ["Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Kana", "Han", "Hangul", "Thai", "Latin"]
    assert [language.NAMES[k] for k in language.grams(words)[2]] == want


def test_words_of_long_texts(monkeypatch):
    text = "Ünïted wörds, a1b " * 50 + "x" * 100
    whole = list(language.words_in(text))
    monkeypatch.setattr(language, "SLICE", 37)
    assert list(language.words_in(text)) == whole and max(map(len, whole)) == language.WORD_LETTERS


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_fit_counts_the_learnable_texts(texts, model):
    """Every bucket's number against counting word by word, without held-out texts."""
    learned = {k: r for k, r in texts.items() if r["lang"] and zlib.crc32(str(k).encode()) % 5}
    seen = np.zeros((language.BUCKETS, len(model.names)))
    for r in learned.values():
        for w in language._WORD.findall(r["text"] or ""):
            np.add.at(seen[:, model.names.index(r["lang"])], language.grams([w])[0], 1)
    want = np.log(seen + 0.5) - np.log(seen.sum(0) + 0.5 * language.BUCKETS)
    assert np.allclose(model.logs, want, atol=1e-4)


def test_held_out(spark, texts):
    got = QUERIES["op11_language_id"](spark, DATA).toPandas()
    assert len(got) == len(texts) and list(got.columns) == ["doc_id", "held_out", "lang_pred", "score", "n_spans"]
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = got[got.held_out]
    assert len(held) > 100 and np.mean([texts[r.doc_id]["lang"] in (None, r.lang_pred) for r in held.itertuples()]) > 0.99


def test_spans_of_mixed_texts(spark, texts, model):
    part = lambda lang, n: next(r["text"][:n].rsplit(" ", 1)[0] for r in texts.values() if r["lang"] == lang and len(r["text"] or "") > 2 * n)
    en, de, fr = part("en", 900), part("de", 900), part("fr", 300)
    mixed = f"12. {en} {de}\n{fr}"
    df = spark.createDataFrame([(1, mixed), (2, en)], "doc_id long, text string")
    a, b = language.language_spans(df, model).orderBy("doc_id").collect()
    assert [s["lang"] for s in a["spans"]] == ["en", "de", "fr"] and a["n_spans"] == 3
    ends = [0, *(s["end"] for s in a["spans"])]
    assert [s["start"] for s in a["spans"]] == ends[:-1] and ends[-1] == len(mixed)
    assert all(abs(x - y) < 30 for x, y in zip(ends[1:], (4 + len(en), 5 + len(en) + len(de))))
    assert a["lang_pred"] in ("en", "de") and a["score"] < 0.6 and (b["lang_pred"], b["score"], b["n_spans"]) == ("en", 1.0, 1)


def test_scripts_narrow_the_candidates(spark):
    rows = [(1, "слово и дело", "ru"), (2, "word and deed", "en"), (3, "mot et acte", "fr"), (6, "слово", "ru")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), modulus=1000, held=999)
    assert model.names == ["en", "fr", "ru"]
    e = model.evidence(["дело", "word", "שלום"])
    assert e[0].tolist() == [-language.LIMIT, -language.LIMIT, 0.0] and e[1][2] == -language.LIMIT and not e[2].any()


def test_odd_rows(spark, model):
    long = "word and deed " * 100_000
    rows = [(1, None), (2, ""), (3, "12 !? 34"), (4, "שלום"), (5, long), (None, "the"), (5, long), (7, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "s", 1, "en") for r in rows], "doc_id long, text string, score string, spans int, lang string")
    got = {r["doc_id"]: r for r in language.language_spans(df, model).collect()}
    assert [(got[k]["lang_pred"], got[k]["score"], got[k]["spans"]) for k in (1, 2, 3)] == [("und", 0.0, [])] * 3
    assert (got[4]["lang_pred"], got[4]["score"]) == (model.names[model.common], 0.0) and got[5]["lang_pred"] == "en" and None in got
    done = language.predicted(df)
    assert done.count() == 8 and done.where("doc_id is null and not held_out").count() == 1
    assert language.predicted(df.limit(0)).count() == 0
    unlabelled = language.predicted(df.withColumn("lang", F.lit(None).cast("string")))
    assert {tuple(r) for r in unlabelled.select("lang_pred", "score").collect()} == {("und", 0.0)}
