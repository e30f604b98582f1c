import re
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity

NEUTRAL = [f"{a}{b}{c}" for a in ("ba", "do", "mi", "ru", "te") for b in ("la", "ne", "so", "vi") for c in ("", "n", "r", "ps")]
BAD = ("vexhole", "grimwart", "plunkard")


def _corpus(n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        words = list(rng.choice(NEUTRAL, int(rng.integers(5, 120))))
        toxic = k % 5 == 0
        if toxic:
            words.insert(int(rng.integers(len(words))), str(rng.choice(BAD)))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = _corpus()
    return toxicity.train([t.encode() for _, t, _ in rows], [y for *_, y in rows], 0.2)


def _scores(spark, model, rows):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    return {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}


def test_held_out_accuracy(spark, model):
    rows = _corpus(seed=11)
    got = _scores(spark, model, rows)
    hits = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows]
    assert np.mean(hits) > 0.97


def test_unseen_misspellings_share_ngrams(spark, model):
    rest = " ".join(NEUTRAL[:20])
    rows = [(1, f"{rest} vexxhole"), (2, f"{rest} grimwartt"), (3, rest)]
    got = _scores(spark, model, rows)
    assert got[1] > 10 * got[3] and got[2] > 10 * got[3]


def test_long_text_does_not_bury_an_insult(spark, model):
    clean = " ".join(f"{w}{k}" for k in range(200) for w in NEUTRAL[:10])
    got = _scores(spark, model, [(1, clean + " vexhole " + clean), (2, clean)])
    assert got[1] >= toxicity.THRESHOLD > got[2]


def test_words_seen_earlier_count_again(spark, model):
    clean = " ".join(NEUTRAL)
    spread = f"{clean} vexhole {clean} grimwart {clean} plunkard {clean} "
    rows = [(1, spread), (2, spread + "vexhole grimwart plunkard vexhole grimwart plunkard vexhole grimwart"), (3, clean), (4, "vexhole"), (5, "vexhole vexhole vexhole")]
    got = _scores(spark, model, rows)
    assert got[2] > got[1] and got[5] > got[4] > got[3]
    passages = [toxicity.tokens((clean + " " + clean).encode())[at] for at in toxicity.passage_starts(2 * len(NEUTRAL))]
    assert len(toxicity.tokens((clean + " " + clean).encode())) == 2 * len(NEUTRAL) and len(passages) == 2 * len(NEUTRAL) // toxicity.PASSAGE


def test_odd_rows(spark, model, odd_docs, empty_docs):
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty_docs, model).collect() == []


def test_without_both_classes_nothing_is_toxic(spark, odd_docs):
    labels = spark.createDataFrame([(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    fitted = toxicity.fit(odd_docs, labels)
    assert {r["score"] for r in toxicity.score(odd_docs, fitted).collect()} == {0.0}
    kept = toxicity.keep_clean(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count()


def test_query(spark, sf_dir):
    out = toxicity.op3_toxicity(spark, sf_dir)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def _plain_score(model, text):
    """A score by the definitions alone, without caches or arrays."""
    values, scale, offset = model
    found = re.findall(r"[^\W_](?:\S*[^\W_])?", (text or "").lower())
    means = []
    for token in found:
        marked = f"<{token}>"
        bag = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        means.append(sum(float(values[zlib.crc32(x.encode()) % len(values)]) for x in bag) / len(bag))
    k = -(-len(found) // toxicity.PASSAGE)
    passages = [means[i * len(found) // k : (i + 1) * len(found) // k] for i in range(k)]
    top = max((sum(p) / max(toxicity.LEAST, len(p)) for p in passages), default=0.0)
    return float(1 / (1 + np.exp(-(scale * top + offset))))


def test_query_equals_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, sf_dir).collect()}
    for r in docs.collect():
        mine = got.pop(r["doc_id"])
        assert mine["score"] == pytest.approx(_plain_score(model, r["text"]), rel=1e-6, abs=1e-9)
        assert mine["predicted"] == int(mine["score"] >= 0.3)
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert not got


def test_odd_rows_equal_brute_force(spark, model, odd_docs):
    want = sorted(_plain_score(model, r["text"]) for r in odd_docs.collect())
    assert sorted(r["score"] for r in toxicity.score(odd_docs, model).collect()) == pytest.approx(want, rel=1e-6, abs=1e-9)
