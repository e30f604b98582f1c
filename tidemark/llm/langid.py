"""Language identification by hierarchical discrimination.

The family of a text is predicted first; inside the family, one-versus-one
linear support vector machines separate its closely related languages. Every
machine is linear over hashed character 1- to 4-grams of words (with boundary
marks), averaged over the text, so a word contributes one small vector of
margins that is cached; a text of any length is read whole in one pass.

Machines are trained in numpy (Pegasos with averaged weights) on at most
``TRAIN_ROWS`` documents per language, of at most ``TRAIN_CHARS`` characters
each, taken in the order of a hash of the id outside the held-out split. The
bounds concern the training sample only.

``score`` is the product of the logistic values of the family decision and of
the language decision, each of its weakest pairwise margin.

Defined cases: ``und`` with score 0 for null texts and texts without a letter,
and for every text if nothing could be learnt; a single learned language is
predicted with score 1; null languages are not learnt from; ties fall to the
language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, raw_texts, remainder, slices, table, worker_state

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
#: Languages learnt: the most frequent ones; bounds the pairs of machines.
TRAIN_LANGS = 64
#: Factor on the averaged features, so that margins of 1 are in reach.
SCALE = 10.0
TRAIN_ROWS = 800
TRAIN_CHARS = 50_000
SPLIT, HELD_OUT = 5, 0

#: Language code -> family. A code that is not listed is its own family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
}


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode category L; not fractions or circled
    numbers, which regular expressions count as word characters)."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, codes in FAMILIES.items() if code in codes), code)


def grams(word: str) -> list[int]:
    marked = f"<{word}>"
    found = [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(x.encode("utf-8", "replace")) & (BUCKETS - 1) for x in found]


def features(words: list[str], memo=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, times ``SCALE``."""
    get = memo.__getitem__ if memo is not None else grams
    flat = np.concatenate([np.asarray(get(w), np.int64) for w in words])
    index, n = np.unique(flat, return_counts=True)
    value = SCALE * n / n.sum()
    return index, value


def svm(rows, sign: np.ndarray, epochs: int = 12, penalty: float = 1e-4, seed: int = 5) -> tuple[np.ndarray, float]:
    """A linear SVM by Pegasos steps, weights averaged over the last half."""
    rng = np.random.default_rng(seed)
    w, mean, bias, bias_mean = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    scale, t, kept = 1.0, 0, 0
    balance = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum())) * len(sign)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1.0 / (penalty * (t + 1000))
            scale *= 1 - rate * penalty
            index, value = rows[i]
            if sign[i] * (scale * (w[index] @ value) + bias) < 1:
                w[index] += rate * sign[i] * balance[i] * value / scale
                bias += 0.01 * sign[i] * balance[i]
        if epoch >= epochs // 2:
            mean += scale * w
            bias_mean += bias
            kept += 1
    return mean / kept, bias_mean / kept


class Model:
    """Pairwise machines over families and over the languages of each."""

    def __init__(self, texts: list[list[str]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(x) for x in self.langs})
        self.pairs: list[tuple[str, str, str]] = [("", a, b) for a, b in combinations(self.families, 2)]
        for f in self.families:
            self.pairs += [(f, a, b) for a, b in combinations([x for x in self.langs if family(x) == f], 2)]
        memo = Memo(grams)
        rows = [features(t, memo) for t in texts]
        self.weights = np.zeros((len(self.pairs), BUCKETS), np.float32)
        self.bias = np.zeros(len(self.pairs))
        for k, (level, a, b) in enumerate(self.pairs):
            label = [x if level else family(x) for x in langs]
            used = [i for i in range(len(rows)) if label[i] in (a, b)]
            sign = np.array([1.0 if label[i] == a else -1.0 for i in used])
            w, self.bias[k] = svm([rows[i] for i in used], sign)
            self.weights[k] = w

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """Family first, then a language of it; margins of all machines."""
        name, p = self._vote("", self.families, margins)
        members = [x for x in self.langs if family(x) == name]
        lang, q = self._vote(name, members, margins)
        return lang, p * q

    def _vote(self, level: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, weakest = dict.fromkeys(names, 0), dict.fromkeys(names, np.inf)
        for (at, a, b), m in zip(self.pairs, margins, strict=True):
            if at == level:
                votes[a if m >= 0 else b] += 1
                weakest[a], weakest[b] = min(weakest[a], m), min(weakest[b], -m)
        best = max(names, key=lambda x: (votes[x], weakest[x]))
        return best, float(1 / (1 + np.exp(-np.clip(2 * weakest[best], -50, 50))))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, train_langs: int = TRAIN_LANGS) -> Model | None:
    """Learn from a bounded sample: ``train_rows`` documents of at most
    ``train_chars`` characters for each of the ``train_langs`` most frequent
    languages, in the order of a hash of the id."""
    source = docs.select(docs[id_col].alias("__id"), docs[lang_col].alias("__lang"), docs[text_col].alias("__t"))
    usable = source.filter((remainder("__id", SPLIT) != HELD_OUT) & F.col("__lang").isNotNull() & F.col("__id").isNotNull() & (F.length("__t") <= train_chars))
    counts = usable.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__lang").limit(train_langs).collect()
    if not counts:
        return None
    order = F.xxhash64("__id", F.lit("langid"))
    # thinned first to about twice the number wanted, so that no window is large
    share = F.create_map(*(F.lit(x) for r in counts for x in (r["__lang"], int(min(1.0, 2.0 * train_rows / r["n"]) * (1 << 20)) + 1)))
    thin = usable.filter(F.pmod(F.xxhash64(order), F.lit(1 << 20)) < F.coalesce(F.try_element_at(share, F.col("__lang")), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("__lang").orderBy(order, "__id"))
    ids = thin.select("__id", "__lang").distinct().withColumn("__nth", nth).filter(F.col("__nth") <= train_rows).drop("__nth")
    ids = ids.withColumnsRenamed({"__id": "__i", "__lang": "__l"})  # at most train_langs * train_rows
    rows = usable.join(F.broadcast(ids), (F.col("__id") == F.col("__i")) & (F.col("__lang") == F.col("__l"))).select("__id", "__lang", "__t").dropDuplicates(["__id"]).collect()
    rows = [(words, lang) for words, lang in ((words_of(t), lang) for _, lang, t in sorted(map(tuple, rows))) if words]
    return Model([w for w, _ in rows], [x for _, x in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row; only the text is an input."""
    bounded_batches(docs.sparkSession)
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # machines of a fixed size

    def build() -> Memo:
        columns = shared.value.weights.T.tolist()

        def value(word: str) -> bytes:
            found = grams(word)
            sums = [sum(x) for x in zip(*[columns[k] for k in found], strict=True)] or []
            return np.array([*sums, len(found)], np.float64).tobytes()

        return Memo(value)

    def run(frames):
        m = shared.value
        memo = worker_state(key, build) if m is not None else None
        for b in slices(frames):
            lang, score = [], []
            for raw in raw_texts(b.column(1)):
                words = words_of(raw.decode("utf-8", "replace")) if m is not None else []
                if not words:
                    lang.append("und")
                    score.append(0.0)
                    continue
                each = np.frombuffer(b"".join(map(memo.__getitem__, words)), np.float64).reshape(len(words), -1).sum(0)
                margins = SCALE * each[:-1] / each[-1] + m.bias
                x, p = m.decide(margins)
                lang.append(x)
                score.append(p)
                memo.trim()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", (remainder("doc_id", SPLIT) == HELD_OUT).alias("held_out"), "lang_pred", "score")
