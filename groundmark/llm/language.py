"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL.

Texts become letters in lower case, everything else a space; runs of one to three characters without two adjoining
spaces are hashed to `FEATURES` slots. A feature's weight is its share of the text's runs times the slot's inverse
document frequency. Those frequencies come from all training documents: every partition flags slots per document and
sends one count per slot, so the shuffle is bounded by slots and partitions. The model is fitted on a sample of about
`PER_LANGUAGE` training documents of each language, chosen by a hash of doc_id, whole texts of which are turned into
sparse rows on the executors; a fifth of the sample is not trained on and sets the softmax temperature. Follow the
regularised leader with elastic net leaves exact zeros, and the fitted table is broadcast (slots times languages).

Nulls: a null text or one without a letter is `und` with score 0. A row without doc_id or lang is never trained on, is
not held out, and is predicted. Without any training rows all are `und`. Repeated rows give repeated rows; an empty table
an empty one. Only doc_id, text and lang are read, and lang only of training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, strings, table

FEATURES = 1 << 16
LONGEST = 3
#: Bounds of the sample that the classifier is fitted on: about so many rows of each language, and of all languages.
PER_LANGUAGE, SAMPLE = 1500, 60_000
CHARS = 400_000


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or the space for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            out[c] = ord(x.lower()[0])
    return out


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all runs of all texts, text by text, and how many each text has. Two spaces part the texts."""
    if not texts:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    codes = letters()[np.frombuffer(("  ".join(texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    n, ends = len(codes), np.cumsum(lengths)
    space = codes == 32
    whole = np.zeros(n, bool)  # no two adjoining spaces from here on
    whole[:-1] = ~(space[:-1] & space[1:])
    valid = np.zeros((n, LONGEST), bool)
    slots = np.empty((n, LONGEST), np.uint32)
    valid[:, 0] = ~space
    key = codes + np.uint64(1)
    for k in range(LONGEST):
        m = n - k
        if k:
            valid[:m, k] = whole[:m] if k == 1 else valid[:m, k - 1] & whole[k - 1 : k - 1 + m]
            key = key[:m] * np.uint64(0x110001) + codes[k:] + np.uint64(1)
        slots[:m, k] = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURES.bit_length() + 1)
    valid[ends - 1] = False
    return slots[valid], np.add.reduceat(valid.sum(axis=1), ends - lengths)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(FEATURES, np.int64)
    documents = 0
    seen = np.zeros(FEATURES, bool)
    for batch in batches:
        texts = strings(batch.column("text"))
        for begin, end in slices(texts, CHARS):
            found, counts = runs(texts[begin:end])
            at = 0
            for n in counts.tolist():
                seen[:] = False
                seen[found[at : at + n]] = True
                total += seen
                at += n
            documents += end - begin
    yield pa.record_batch([pa.array(np.append(np.flatnonzero(total), -1)), pa.array(np.append(total[total > 0], documents))], names=["slot", "n"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = strings(batch.column("text"))
        sparse = []
        for text in texts:
            found, _ = runs([text])
            sparse.append(np.unique(found, return_counts=True))
        yield pa.record_batch([
            batch.column("doc_id"), batch.column("lang"),
            pa.array([x.astype(np.int32) for x, _ in sparse], pa.list_(pa.int32())),
            pa.array([(c / c.sum()).astype(np.float32) for _, c in sparse], pa.list_(pa.float32())),
        ], names=["doc_id", "lang", "slots", "shares"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow the regularised leader, proximal form, one weight vector per class, with elastic-net penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) > self.l1, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, table of slot scores (idf times weight), bias and temperature, from the rows of `docs` (doc_id, text, lang)."""
    df = {r["slot"]: r["n"] for r in docs.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    documents = df.pop(-1, 0)
    idf = np.zeros(FEATURES)
    for slot, n in df.items():
        idf[slot] = np.log((1 + documents) / (1 + n)) + 1
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    several = counts.count()
    per_language = max(1, min(per_language, SAMPLE // max(1, several)))
    near = F.broadcast if several <= SAMPLE else (lambda df: df)  # a row a language
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = docs.join(near(counts), "lang").filter(chance < F.lit(float(per_language)) / F.col("n"))
    rows = sample.select("doc_id", "text", "lang").mapInArrow(_rows, "doc_id long, lang string, slots array<int>, shares array<float>").collect()
    rows = sorted((r for r in rows if r["slots"]), key=lambda r: (r["doc_id"], r["lang"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return [], np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0
    scale = 10.0  # shares are small; one constant keeps the penalties' meaning over texts of any length
    data = []
    for r in rows:
        at = np.array(r["slots"], np.int64)
        x = np.array(r["shares"], np.float64) * idf[at] * scale
        data.append((np.append(at, FEATURES), np.append(x, 1.0), languages.index(r["lang"])))
    order = np.random.default_rng(7).permutation(len(data))
    apart = len(data) // 5
    model = Ftrl(FEATURES + 1, len(languages))
    for _ in range(epochs):
        for i in order[apart:]:
            model.learn(*data[i])
    w = model.weights()
    calibration = order[:apart]
    t = 1.0
    if len(calibration):
        t = temperature(np.array([data[i][1] @ w[data[i][0]] for i in calibration]), np.array([data[i][2] for i in calibration]))
    return languages, (w[:-1] * idf[:, None] * scale).astype(np.float32), w[-1], t


def _predict(shared, languages: list[str], bias: np.ndarray, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = shared.value
        for batch in batches:
            texts = strings(batch.column("text"))
            for begin, end in slices(texts, CHARS):
                part = texts[begin:end]
                found, counts = runs(part)
                running = np.zeros((len(found) + 1, len(languages)))
                np.cumsum(scores[found], axis=0, dtype=np.float64, out=running[1:])
                ends = np.cumsum(counts)
                logits = (running[ends] - running[ends - counts]) / np.maximum(counts, 1)[:, None] + bias
                p = softmax(logits / t)
                best = p.argmax(axis=1)
                known = counts > 0
                yield pa.record_batch([
                    batch.column("doc_id")[begin:end], batch.column("held_out")[begin:end],
                    pa.array([languages[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                    pa.array(np.where(known, p[np.arange(len(best)), best], 0.0)),
                ], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the rows with a lang that are not `held_out` are learnt from."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"))
    training = rows.filter(~F.col("held_out") & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).drop("held_out")
    languages, scores, bias, t = fit(training, per_language)
    if not languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(shared, languages, bias, t), "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`identify` over all documents; a quarter of them, by a checksum of doc_id, is held out."""
    return identify(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
