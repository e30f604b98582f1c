"""Toxicity scoring with averaged subword-bag embeddings.

A token's bag holds the token itself and its character 3- to 5-grams with
boundary marks, each hashed to an embedding; misspellings that the training
rows never show still share most n-grams with the word they bend. Token
vectors (mean of their bag) are averaged over a passage of about
``PASSAGE`` tokens and feed a linear softmax; embeddings and softmax are
trained jointly in numpy. A document scores as its highest-scoring passage,
so a long text cannot bury an insult: every token is in exactly one passage.

Training rows: labelled documents outside the held-out split, at most
``TRAIN_ROWS`` per class, taken in the order of a hash of the id, of at most
``TRAIN_CHARS`` characters each (bounds on the training sample only; scoring
reads every text whole). Training runs in two steps: whole-document averages
first, then rounds on each document's currently highest passage plus a random
one. A part of the sample is kept out to fit the final logistic scale, at the
class rates of all labelled rows.

The dense softmax over averages is linear, so inference folds embeddings and
output weights into one number per hash bucket (512 KB, a fixed size). A
token counts wherever it occurs, in training as in scoring.

Defined cases: null or token-free texts score the bias alone; rows repeated
score alike; null labels are no labels, contradicting labels count as toxic;
without labels of both classes every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches, bounded_sample, raw_texts, remainder, slices, table, worker_state

TOKEN = re.compile(r"[^\W_](?:\S*[^\W_])?")
BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
PASSAGE = 16
#: A shorter passage is padded to this many tokens with zero vectors.
LEAST = 8
TRAIN_ROWS = 2500
TRAIN_CHARS = 50_000
THRESHOLD = 0.3
SPLIT, HELD_OUT = 4, 2


def tokens(text: bytes) -> list[str]:
    """All tokens of a text, in text order."""
    return TOKEN.findall(text.decode("utf-8", "replace").lower())


def grams(token: str) -> list[int]:
    """Hash buckets of a token and its character n-grams."""
    marked = f"<{token}>"
    if marked.isascii():
        raw = marked.encode()
        found = [raw, *(raw[i : i + n] for n in GRAMS for i in range(len(raw) - n + 1))]
    else:
        found = [x.encode("utf-8", "replace") for x in (marked, *(marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)))]
    return [zlib.crc32(x) & (BUCKETS - 1) for x in found]


def word_memo(values: np.ndarray) -> Memo:
    """Token -> mean of its bag, cached."""
    flat = values.tolist()

    def value(token: str) -> float:
        found = grams(token)
        return sum([flat[k] for k in found]) / len(found)

    return Memo(value)


def means(values: np.ndarray) -> np.ndarray:
    """Averages of the values of a text's passages."""
    starts = passage_starts(len(values))
    return np.add.reduceat(values, starts) / np.maximum(LEAST, np.diff(starts, append=len(values)))


def passage_starts(n: int, size: int = PASSAGE) -> np.ndarray:
    """Starts of ceil(n / size) passages of nearly equal length."""
    k = max(1, -(-n // size))
    return (np.arange(k) * n) // k


class _Bags:
    """Bags of the sample's vocabulary in one flat array. Of the documents,
    which may come one by one, only the numbers of their tokens are kept."""

    def __init__(self, docs: Iterable[list[str]]):
        index: dict[str, int] = {}
        self.docs = [np.array([index.setdefault(t, len(index)) for t in d], np.int32) for d in docs]
        flat, size = array("i"), array("i")
        for t in index:
            found = grams(t)
            flat.extend(found)
            size.append(len(found))
        self.size = np.array(size, np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        self.flat = np.array(flat, np.int32)

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of ``words`` end to end, and where each word's begin."""
        n = self.size[words]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.repeat(self.start[words] - begin, n) + np.arange(int(n.sum()))
        return self.flat[at], begin


class _Trainer:
    def __init__(self, bags: _Bags, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bags, self.rng = bags, rng
        self.emb = rng.uniform(-0.003, 0.003, (BUCKETS, DIM)).astype(np.float32)
        self.out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.emb_sq = np.full(BUCKETS, 1e-8, np.float32)
        self.out_sq = np.full((DIM, 2), 1e-8, np.float32)

    def step(self, units: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One Adagrad step of the joint softmax on a batch of token lists."""
        words = np.concatenate(units)
        n = np.array([len(u) for u in units])
        div = np.maximum(n, LEAST)
        owner = np.repeat(np.arange(len(units)), n)
        distinct, back = np.unique(words, return_inverse=True)
        buckets, begin = self.bags.gather(distinct)
        vec = np.add.reduceat(self.emb[buckets], begin, axis=0) / self.bags.size[distinct, None]
        mean = np.zeros((len(units), DIM), np.float32)
        for k in range(DIM):
            mean[:, k] = np.bincount(owner, vec[back, k], len(units)) / div
        z = mean @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * weight[:, None]
        g_mean = (g @ self.out.T) / div[:, None]
        g_out = mean.T @ g / len(units)
        g_vec = np.stack([np.bincount(back, g_mean[owner, k], len(distinct)) for k in range(DIM)], 1) / self.bags.size[distinct, None]
        each = np.repeat(g_vec, self.bags.size[distinct], axis=0)
        touched, slot = np.unique(buckets, return_inverse=True)
        g_emb = np.stack([np.bincount(slot, each[:, k], len(touched)) for k in range(DIM)], 1).astype(np.float32)
        self.emb_sq[touched] += (g_emb**2).mean(1)
        self.emb[touched] -= rate * g_emb / np.sqrt(self.emb_sq[touched])[:, None]
        self.out_sq += g_out**2
        self.out -= rate * 0.1 * g_out / np.sqrt(self.out_sq)
        self.bias -= rate * 0.1 * g.mean(0)

    def folded(self) -> tuple[np.ndarray, float]:
        w = self.out[:, 1] - self.out[:, 0]
        return self.emb @ w, float(self.bias[1] - self.bias[0])

    def word_values(self) -> np.ndarray:
        value, _ = self.folded()
        return np.add.reduceat(value[self.bags.flat], self.bags.start) / self.bags.size

    def epoch(self, units, y, weight, rate) -> None:
        batch = min(64, max(8, len(units) // 40))
        order = self.rng.permutation(len(units))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            self.step([units[i] for i in pick], y[pick], weight[pick], rate)


def train(texts: list[bytes], labels: list[int], rate_toxic: float, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """(bucket values, scale, offset): logit = scale * passage mean + offset."""
    bags = _Bags(map(tokens, texts))
    some = [i for i, d in enumerate(bags.docs) if len(d)]
    if len({labels[i] for i in some}) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0, -1e9
    rng = np.random.default_rng(seed)
    some = [some[i] for i in rng.permutation(len(some))]
    bags.docs = [bags.docs[i] for i in some]
    y = np.array([int(labels[i]) for i in some])
    keep_out = np.arange(len(some)) % 5 == 4
    if len(set(y[keep_out])) < 2 or len(set(y[~keep_out])) < 2:
        keep_out[:] = False
    fit = np.flatnonzero(~keep_out)
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)
    model = _Trainer(bags, seed)
    for _ in range(max(2, min(10, 4000 // len(fit)))):
        model.epoch([bags.docs[i] for i in fit], y[fit], weight[fit], 0.3)

    def passages(i: int) -> list[np.ndarray]:
        return np.split(bags.docs[i], passage_starts(len(bags.docs[i]))[1:])

    for _ in range(max(8, min(20, 10_000 // len(fit)))):
        value = model.word_values()
        units, label, w = [], [], []
        for i in fit:
            parts = passages(i)
            best = parts[int(np.argmax(means(value[bags.docs[i]])))]
            units.append(best)
            label.append(y[i])
            w.append(weight[i])
            if y[i] == 0 and len(parts) > 1:
                units.append(parts[int(rng.integers(len(parts)))])
                label.append(0)
                w.append(weight[i])
        model.epoch(units, np.array(label), np.array(w), 0.2)
    value = model.word_values()
    held = np.flatnonzero(keep_out)
    if (y[held] == 1).sum() < 50:  # too few to fit a scale on
        held = np.arange(len(some))
    top = np.array([means(value[bags.docs[i]]).max() for i in held])
    scale, offset = _logistic(top, y[held], rate_toxic)
    return model.folded()[0].astype(np.float32), scale, offset


def _logistic(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Platt's logistic fit with the classes weighted to ``rate``."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    w = np.where(y == 1, rate / n1, (1 - rate) / n0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mid, spread = x.mean(), x.std() + 1e-9
    u, a, b = (x - mid) / spread, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        g, h = w * (p - target), np.maximum(w * p * (1 - p), 1e-9)
        grad = np.array([(g * u).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * u * u).sum() + 1e-4, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(a / spread), float(b - a * mid / spread)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS):
    """Train on a bounded sample of labelled rows outside the held-out split."""
    known = labels.select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("__y"))
    known = known.filter("__id is not null and __y is not null").groupBy("__id").agg(F.max("__y").alias("__y"))
    usable = known.filter(remainder("__id", SPLIT) != HELD_OUT)
    counts = {r["__y"]: r["n"] for r in usable.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [r for v in (0, 1) for r in bounded_sample(usable.filter(F.col("__y") == v), "__id", counts.get(v, 0), train_rows, "toxicity").collect()]
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "__id long, __y int")  # 2 * train_rows rows at most
    text = docs.select(docs[id_col].alias("__d"), F.coalesce(docs[text_col], F.lit("")).alias("__t")).filter(F.length("__t") <= train_chars)
    rows = text.join(F.broadcast(ids), F.col("__d") == F.col("__id")).select("__id", "__t", "__y").dropDuplicates(["__id"]).collect()
    rows.sort(key=lambda r: r["__id"])
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    texts, known = [r["__t"].encode() for r in rows], [r["__y"] for r in rows]
    del rows
    return train(texts, known, min(max(rate, 0.01), 0.99))


def _logits(docs: DataFrame, model):
    """A function from raw texts to logits, for use inside executors."""
    bounded_batches(docs.sparkSession)
    value, scale, offset = model
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(value)  # one float per bucket

    def run(texts: list[bytes]) -> list[float]:
        memo = worker_state(key, lambda: word_memo(shared.value))
        out = []
        for text in texts:
            found = tokens(text)
            top = 0.0
            if found:
                top = float(means(np.fromiter(map(memo.__getitem__, found), np.float64, len(found))).max())
            out.append(scale * top + offset)
            memo.trim()
        return out

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; only the text is an input."""
    logits = _logits(docs, model)

    def run(frames):
        for b in slices(frames):
            p = [0.0 if z < -700 else 1 / (1 + math.exp(-z)) for z in logits(raw_texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored as toxic; all columns kept, in one
    pass over the texts (the score is computed beside them, no join)."""
    logits = _logits(docs, fit(docs, labels, id_col, text_col))
    column = docs.columns.index(text_col)
    cut = math.log(threshold / (1 - threshold))

    def run(frames):
        for b in slices(frames):
            yield b.filter(pa.array([z < cut for z in logits(raw_texts(b.column(column)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (remainder("doc_id", SPLIT) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
