import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidemark.llm import langid


@pytest.fixture(scope="module")
def model(sf_dir):
    rows = duckdb.sql(f"select text, lang from '{sf_dir}/documents.parquet' where text is not null and doc_id % 2 = 0").fetchall()
    return langid.Model([langid.WORD.findall(t.lower()) for t, _ in rows], [x for _, x in rows])


def test_levels(model):
    assert {level for level, _, _ in model.pairs} == {"", "germanic", "romance"}
    assert langid.family("pt-BR") == "romance"
    assert langid.family("xx") == "xx"


def test_held_out_accuracy(spark, model, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 2 = 1")
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert sum(got[k] == v for k, v in want.items()) / len(want) > 0.95


def test_odd_rows(spark, model, odd_docs, empty_docs):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, model).collect()}
    assert got[1] == got[2] == got[8] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(empty_docs, model).collect() == []
    digits = spark.createDataFrame([(1, "12 34 !?")], "doc_id long, text string")
    assert langid.predict(digits, model).first()["lang_pred"] == "und"


def test_nothing_learnt(spark, empty_docs, odd_docs):
    assert langid.fit(empty_docs) is None
    assert {r["lang_pred"] for r in langid.predict(odd_docs, None).collect()} == {"und"}


def test_one_language(spark):
    one = langid.Model([["hello", "world"], ["good", "day"]], ["en", "en"])
    assert one.decide(langid.np.zeros(0)) == ("en", 1.0)


def test_query(spark, sf_dir):
    out = langid.op8_language_id(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_only_letters_are_letters(docs_of):
    """Numbers of category No and Nl are no letters; a text of them is und."""
    from tidemark.llm.langid import words_of

    assert words_of("½ ² ① 12 Ⅻ _") == []
    assert words_of("a½b Éte日本ª x_y") == ["a", "b", "éte日本ª", "x", "y"]


def _plain(model, text):
    """Prediction and score by the definitions alone: grams of the whole text
    counted, every machine's margin, then the votes of the two levels."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    if not words:
        return "und", 0.0
    count = Counter(zlib.crc32(f"<{w}>"[i : i + n].encode()) % langid.BUCKETS for w in words for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n))
    total = sum(count.values())
    index, n = np.array(list(count)), np.array(list(count.values()))
    margin = {pair: float(langid.SCALE * (w[index].astype(float) @ n) / total + b) for pair, w, b in zip(model.pairs, model.weights, model.bias, strict=True)}

    def level(at, names):
        if len(names) == 1:
            return names[0], 1.0
        own = {x: [m if a == x else -m for (k, a, b), m in margin.items() if k == at and x in (a, b)] for x in names}
        wins = {x: sum(m > 0 or (m == 0 and (at, x, y) in margin) for y in names if y != x for m in [margin.get((at, x, y), -margin.get((at, y, x), 0.0))]) for x in names}
        best = sorted(names, key=lambda x: (-wins[x], -min(own[x]), x))[0]
        return best, 1 / (1 + np.exp(-2 * min(own[best])))

    name, p = level("", sorted({langid.family(x) for x in model.langs}))
    lang, q = level(name, [x for x in model.langs if langid.family(x) == name])
    return lang, p * q


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fitted = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.op8_language_id(spark, sf_dir).collect()}
    for r in docs.collect():
        mine, (lang, score) = got.pop(r["doc_id"]), _plain(fitted, r["text"])
        assert (mine["lang_pred"], mine["held_out"]) == (lang, zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert mine["score"] == pytest.approx(score, rel=1e-6)
    assert not got


def test_odd_rows_equal_brute_force(model, odd_docs):
    want = sorted(_plain(model, r["text"]) for r in odd_docs.collect())
    got = sorted((r["lang_pred"], r["score"]) for r in langid.predict(odd_docs, model).collect())
    assert [x for x, _ in got] == [x for x, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)


def test_ties_fall_to_the_first(model):
    assert model.decide(np.zeros(len(model.pairs)))[0] == [x for x in model.langs if langid.family(x) == "germanic"][0]
