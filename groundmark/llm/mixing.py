"""Mixing by soft membership: domain posteriors for every document, and rates whose expected token totals meet targets.

A labelled table names the domain of some documents. A multinomial logistic regression on which words they have and on
the shares of their words' shapes, trained on a bounded sample of it, gives every document a posterior over the domains. With n tokens and posterior p, a document that
is repeated at rate r is expected to bring r * n * p[k] tokens to domain k. The rates are found by projected gradient
descent on the squared distance of these totals from the targets, measured in the inverse of the totals' second-moment
matrix: where no rate is pressed to zero, one step arrives. A rate depends on a document's own posterior and on the few
numbers by which each step moved, so the state of the descent is that list of steps: every round is one scan of the
written posteriors in which partitions replay the steps and send one sum per domain. Nothing of a document's size
travels, and no domain or source is ever gathered, so a hot one does no harm.

Words are pieces between spaces; tokens are counted under the vocabulary without begin or end tokens. Copies are the
rate rounded up or down by a hash of doc_id, so that their mean is the rate.

Nulls: a null text has no tokens and no words, so its posterior is the prior's, and its rate brings nothing. A null
doc_id is carried through. Label rows with a null are left out, and of labels that share a doc_id the least counts.
Without labels there is one domain. Repeated rows are documents by themselves; empty tables give empty tables.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, strings, sums, table
from .language import Ftrl, softmax
from .tokens import SentenceTable, held, vocabulary

VOCABULARY = "piece_bpe_32k.model"
#: Hashed features: first the words, then the shapes.
WORDS, SHAPES = 1 << 16, 1 << 8
FEATURES = WORDS + SHAPES
#: Bounds of the labelled sample that the classifier is fitted on: about so many rows of each domain, and of all domains.
PER_DOMAIN, SAMPLE = 1500, 60_000
#: The descent ends once no total is further from its target than this share of all tokens, once a step nears them by less
#: than a share of the distance, or once the steps, halved when they went too far, are small.
TOLERANCE, SETTLED, LEAST_SCALE, ROUNDS = 1e-4, 1e-3, 1 / 64, 100
STRIP = ".,;:!?\"'()[]\n\t "

#: Default target shares of tokens by domain of the labels table; domains that are not named get nothing.
TARGETS = {"quality=1,toxic=0": 0.958, "quality=0,toxic=0": 0.02, "quality=1,toxic=1": 0.02, "quality=0,toxic=1": 0.002}
#: Share of the mean moment added to the metric, which keeps steps along rare domains short.
RIDGE = 0.02


class _Kinds(dict):
    """What `str.translate` puts for each character."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        self[code] = "a" if c.isalpha() else "0" if c.isdigit() else code
        return self[code]


_KINDS, _REPEATS = _Kinds(), re.compile(r"(.)\1+", re.DOTALL)


def shape(piece: str) -> str:
    """A piece with letters as `a` and digits as `0`, and repeats of one sign as that sign."""
    return "a" if piece.isalpha() else _REPEATS.sub(r"\1", piece.translate(_KINDS))


class WordTable(SentenceTable):
    """Pieces between spaces with their token counts, a hashed word and a hashed shape each."""

    def _reset(self) -> None:
        super()._reset()
        self.words = np.empty(0, np.int64)
        self.shapes = np.empty(0, np.int64)

    def _keep(self, kept: np.ndarray) -> None:
        self.words, self.shapes = self.words[kept], self.shapes[kept]
        self.lengths[: len(kept)] = self.lengths[kept]

    def encode(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        crc = zlib.crc32
        fresh = np.array([crc(k.strip(STRIP).lower().encode()) for k in keys], np.int64) % WORDS
        self.words = np.concatenate((self.words, fresh))
        letters = crc(b"a")  # most pieces are letters alone
        shapes = np.array([letters if k.isalpha() else crc(shape(k).encode()) for k in keys], np.int64) % SHAPES
        self.shapes = np.concatenate((self.shapes, shapes))
        return np.empty(0, np.int32), self.sizes(keys)[1]

    def _append(self, ids: np.ndarray, lengths: np.ndarray, first: int, end: int) -> None:
        while end > len(self.lengths):
            self.lengths = np.concatenate((self.lengths, np.empty_like(self.lengths)))
        self.lengths[first:end] = lengths

    def sparse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text, and of its features: whose they are, which, and how strong, in order of the texts."""
        codes, counts = self.codes(texts)
        doc = np.repeat(np.arange(len(texts)), counts)
        words = np.unique(doc * WORDS + self.words[codes])
        shapes, times = np.unique(doc * SHAPES + self.shapes[codes], return_counts=True)
        owner = np.concatenate((words // WORDS, shapes // SHAPES))
        feature = np.concatenate((words % WORDS, WORDS + shapes % SHAPES))
        value = np.concatenate((np.ones(len(words)), SCALE * times / np.maximum(counts, 1)[shapes // SHAPES]))
        return sums(self.lengths[codes], counts), owner, feature, value


def word_table(path: str) -> WordTable:
    return held(WordTable, path)


def _sparse(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [word_table(path).sparse([text])[2:] for text in strings(batch.column("text"))]
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("domain"), pa.array([x for x, _ in rows], pa.list_(pa.int64())),
                pa.array([v for _, v in rows], pa.list_(pa.float64())),
            ], names=["doc_id", "domain", "features", "values"])

    return run


SCALE = 4.0


def fit(docs: DataFrame, labels: DataFrame, path: str, per_domain: int = PER_DOMAIN, epochs: int = 4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, table of feature scores and bias, from `labels` (doc_id, domain) and the texts of a sample of them."""
    one = labels.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = one.groupBy("domain").agg(F.count("*").alias("n"))
    several = counts.count()
    per_domain = max(1, min(per_domain, SAMPLE // max(1, several)))
    near = F.broadcast if several <= SAMPLE else (lambda df: df)  # the sample has about SAMPLE rows at most, or one a domain
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = one.join(near(counts), "domain").withColumn("place", place * F.col("n")).filter(F.col("place") < per_domain)
    sample = sample.select("doc_id", "domain")
    texts = docs.select("doc_id", "text").join(near(sample), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_sparse(path), "doc_id long, domain string, features array<long>, values array<double>").collect()
    rows = sorted((r for r in rows if r["features"]), key=lambda r: (r["doc_id"], r["features"]))
    domains = sorted({r["domain"] for r in rows})
    if not domains:
        return ["all"], np.zeros((FEATURES, 1), np.float32), np.zeros(1)
    data = [(np.append(r["features"], FEATURES), np.append(np.array(r["values"]), 1.0), domains.index(r["domain"])) for r in rows]
    model = Ftrl(FEATURES + 1, len(domains), alpha=0.2, l1=1.0, l2=0.1)
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            model.learn(*data[i])
    w = model.weights()
    # the sample holds the domains evenly: back to their shares in the labels
    prior = np.array([{r["domain"]: r["n"] for r in counts.collect()}[d] for d in domains], float)
    drawn = np.bincount([d[2] for d in data], minlength=len(domains))
    return domains, w[:-1].astype(np.float32), w[-1] + np.log(prior / prior.sum()) - np.log(drawn / drawn.sum())


def _posteriors(path: str, shared, bias: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, scores = word_table(path), shared.value
        for batch in batches:
            texts = strings(batch.column("text"))
            for begin, end in slices(texts, 1_000_000):
                tokens, owner, feature, value = words.sparse(texts[begin:end])
                parts = value[:, None] * scores[feature]
                logits = np.stack([np.bincount(owner, parts[:, k], minlength=end - begin) for k in range(parts.shape[1])], axis=1)
                p = softmax(logits + bias)
                yield pa.record_batch([batch.column("doc_id")[begin:end], pa.array(tokens), pa.array(list(p), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    return run


def replay(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors `p` after the steps: each moves by its share of a step, never below zero."""
    rate = np.ones(len(p))
    for step in steps:
        rate = np.maximum(0.0, rate - p @ step)
    return rate


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _totals(steps: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            p, n = _matrix(batch.column("posterior"), width), batch.column("n_tokens").to_numpy()
            total += (replay(p, steps) * n) @ p
        yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    return run


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            p, n = _matrix(batch.column("posterior"), width), batch.column("n_tokens").to_numpy()
            total += (p * n[:, None]).T @ p
        yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["total"])

    return run


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The element-wise sum of the partitions' arrays; one row of `width` numbers reaches the driver."""
    found = parts.agg(*(F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width))).first()
    return np.array([x or 0.0 for x in found])


def descend(rows: DataFrame, shares: np.ndarray, budget: float | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Steps that bring the expected totals of `rows` (n_tokens, posterior) to `shares` of `budget` tokens.

    Without a budget, as many tokens as there are. Targets that no rates reach are neared as far as the descent moves.
    """
    width = len(shares)
    rows = rows.select("n_tokens", "posterior")
    moments = _added(rows.mapInArrow(_moments(width), "total array<double>"), width * width).reshape(width, width)
    tokens = moments.sum()  # posteriors sum to one
    steps = np.empty((0, width))
    if not tokens:
        return steps
    target = shares * (tokens if budget is None else budget)
    metric = np.linalg.inv(moments + RIDGE * tokens / width * np.eye(width))
    least, scale = np.inf, 1.0
    for _ in range(rounds):
        total = _added(rows.mapInArrow(_totals(steps, width), "total array<double>"), width)
        gap = total - target
        if np.abs(gap).max() <= TOLERANCE * tokens:
            break
        distance = float(gap @ metric @ gap)
        if distance >= least:  # the last step went too far
            scale /= 2
            if scale < LEAST_SCALE:
                break
            steps[-1] /= 2
            continue
        if distance > (1 - SETTLED) * least:
            break
        least = distance
        steps = np.vstack((steps, scale * (metric @ gap)))
    else:
        warnings.warn(f"the rates still move after {rounds} rounds; the largest gap is {np.abs(gap).max() / tokens:.2g} of all tokens", stacklevel=2)
    return steps


def _rates(steps: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = replay(_matrix(batch.column("posterior"), width), steps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return run


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None, vocabulary_file: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, posterior, rate, copies) of every row of `docs`.

    `labels` has (doc_id, domain); `targets` gives domains their weights, which are scaled to sum to one. If no domain
    of the labels has a weight, all weigh the same.
    """
    path = vocabulary(vocabulary_file)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    domains, scores, bias = fit(rows, labels.select(F.col("doc_id").cast("long"), "domain"), path)
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    schema = "doc_id long, n_tokens long, posterior array<double>"
    found = materialise(rows.mapInArrow(_posteriors(path, shared, bias), schema), "posteriors")
    shares = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    shares = shares / shares.sum() if shares.sum() > 0 else np.full(len(domains), 1 / len(domains))
    steps = descend(found, shares, budget)
    rated = found.mapInArrow(_rates(steps, len(domains)), f"{schema}, rate double")
    chance = F.pmod(F.xxhash64(F.lit("copies"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return rated.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("long")).cast("long"))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of labels (doc_id, quality, toxic)."""
    return labels.select("doc_id", F.concat(F.lit("quality="), F.col("quality").cast("string"), F.lit(",toxic="), F.col("toxic").cast("string")).alias("domain"))


def op6_domain_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mix` of all documents with the labels table and the default targets."""
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their columns, each as many times as its copies; a row without doc_id once.

    Rows that share a doc_id share their largest number of copies.
    """
    found = mix(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)
    times = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("times")).withColumnRenamed("doc_id", "named")
    joined = docs.join(times, docs["doc_id"] == times["named"], "left").select(docs["*"], F.coalesce(times["times"], F.lit(1)))
    # an own name for each column while copies are made, whatever the documents' columns are called
    numbered = joined.toDF(*(f"c{i}" for i in range(len(docs.columns))), "times").filter("times > 0")
    repeated = numbered.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return repeated.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
