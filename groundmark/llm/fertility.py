"""Quality rules by tokenizer fertility: what public vocabularies make of a text tells prose from noise.

`features` reads whole texts in Arrow batches. The base columns count words, symbols, repeated lines and words in
repeated three-word windows. The method's columns measure, under a BPE vocabulary with byte fallback, characters per
token, the share of tokens that are single fallback bytes, and the entropy of the tokens over its largest possible
value, and under a byte-level vocabulary characters per token. `bands` turns the metrics of all documents that pass
the base rules into one range per language (per script where the language is null); `verdicts` rejects what lies
outside. A range is the median and `width` times the distance from it to two quantiles near it, never narrower than
`LEAST`, so a group of like documents keeps them all, and wider where a group has few rows. A group that is noise by more
than two fifths keeps some of it, and one of a few rows keeps what is not far from its median.

Nulls: a null text has no words and fails the base rules; a null or repeated doc_id is carried through, one row out
per row in. Texts without tokens have null metrics and are outside of no band. An empty table gives an empty table.
Other columns of the input are not read and cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, strings, sums, table
from .tokens import byte_table, sentence_table, vocabulary

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"

#: Pre-tokens that each of the two tables of a worker keeps.
CACHE = 300_000

METRICS = ("chars_per_piece", "chars_per_byte_token", "fallback_share", "entropy_share")
#: Bins per unit of each metric; bands are quantiles of these bins.
SCALE = {"chars_per_piece": 200, "chars_per_byte_token": 200, "fallback_share": 2000, "entropy_share": 2000}
#: Least distance of a band's ends from its median, in groups of `SURE_ROWS` rows; that of n fewer is wider by the square
#: root of `SURE_ROWS` over n, since their quantiles are chance.
LEAST = {"chars_per_piece": 0.3, "chars_per_byte_token": 0.3, "fallback_share": 0.05, "entropy_share": 0.15}
SURE_ROWS = 50
#: Texts of fewer words are a small sample of their language: their bands are wider by the square root of this over their words.
SURE_WORDS = 100

SCHEMA = (
    "doc_id long, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy_share double"
)

#: A band reaches `WIDTH` times the distance from the median to the quantiles `TAIL` and 1 - `TAIL`. These lie close to the
#: median, so that even a third of noise on one side leaves them among the prose.
WIDTH, TAIL = 20.0, 0.4
#: Most groups whose bands are broadcast, about 150 bytes each; more are joined by a shuffle.
FEW_GROUPS = 50_000
#: Name of a column that stands beside those of the documents for a while: a hash of what a row's verdict depends on.
ROW = "_quality_row"

#: First code points of common scripts' blocks, for documents without a language.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"),
)


def script(text: str) -> str:
    """Script of most letters of the text; `none` without letters."""
    letters = np.array([ord(c) for c in text if c.isalpha()], np.int64)
    if not len(letters):
        return "none"
    where = np.searchsorted([x for x, _ in SCRIPTS], letters, "right") - 1
    return SCRIPTS[int(np.bincount(where, minlength=len(SCRIPTS)).argmax())][1]


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has more than once."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base = len(numbers)
    pairs = ids[:-1] * base + ids[1:]
    if base > 1_000_000:  # three ids would not fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    data = text.encode()
    words = data.split()  # bytes split at the six ASCII white-space characters only
    chars = len(text) - len(data) + sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), chars, sum(text.count(x) for x in SYMBOLS), len(lines) - len(set(lines)), _repeated(words)


def _entropy(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entropy of the ids of each text over the logarithm of how many it has; texts of one token have 1."""
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = np.sort(doc * (int(ids.max(initial=0)) + 1) + ids)
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    times = np.diff(first, append=len(pairs))
    n = counts[doc[first]]
    total = np.bincount(doc[first], times * np.log(times), minlength=len(counts))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 1, 1 - total / (counts * np.log(counts)), 1.0) if len(n) else np.ones(len(counts))


def _features(pieces: str, bytes_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_piece, by_byte = sentence_table(pieces, CACHE), byte_table(bytes_, CACHE)
        for batch in batches:
            texts, langs = strings(batch.column("text")), batch.column("lang").to_pylist()
            for begin, end in slices(texts, 2_000_000):
                part = texts[begin:end]
                base = np.array([base_counts(x) for x in part], np.int64).reshape(-1, 5)
                ids, counts = by_piece.tokens(part)
                fallback = sums(by_piece.is_byte[ids].astype(np.int64), counts)
                codes, pretokens = by_byte.codes(part)
                n_bytes = sums(by_byte.lengths[codes], pretokens)
                chars = np.array([len(x) for x in part])
                none = counts == 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    metrics = [chars / counts, chars / n_bytes, fallback / counts, _entropy(ids, counts)]
                groups = [x if x is not None else "script:" + script(t) for x, t in zip(langs[begin:end], part)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[begin:end], pa.array(groups, pa.string()), *(pa.array(base[:, k]) for k in range(5)), *(pa.array(m, pa.float64(), mask=none) for m in metrics)],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def features(docs: DataFrame, pieces: str = PIECES, bytes_: str = BYTES) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): base counts and fertility metrics."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    out = rows.mapInArrow(_features(vocabulary(pieces), vocabulary(bytes_)), SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bands(rows: DataFrame, width: float = WIDTH, tail: float = TAIL) -> DataFrame:
    """(grp, metric, low, mid, high) from all rows that pass the base rules: exact quantiles of the binned metrics.

    Only one count per group, metric and bin is shuffled, so a language with a third of all rows costs no more.
    """
    long = rows.filter(~F.col("base_failed")).select("grp", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) * SCALE[m] + 0.5).cast("long").alias("bin"), F.lit(1.0 / SCALE[m]).alias("step"), F.lit(LEAST[m]).alias("least")) for m in METRICS))).alias("x")).select("grp", "x.*")
    counts = long.filter("bin is not null").groupBy("grp", "metric", "step", "least", "bin").agg(F.count("*").alias("n"))
    by_group = Window.partitionBy("grp", "metric")
    share = F.sum("n").over(by_group.orderBy("bin")) / F.sum("n").over(by_group)
    least = F.col("least") * F.greatest(F.lit(1.0), F.sqrt(SURE_ROWS / F.sum("n")))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin")))
    q = counts.withColumn("share", share).groupBy("grp", "metric", "step", "least").agg(at(tail).alias("lo"), at(0.5).alias("mid"), at(1 - tail).alias("hi"), least.alias("floor"))
    mid = F.col("mid") * F.col("step")
    reach = lambda a, b: F.greatest(F.lit(width) * (F.col(a) - F.col(b)) * F.col("step"), F.col("floor"))
    return q.select("grp", "metric", (mid - reach("mid", "lo")).alias("low"), mid.alias("mid"), (mid + reach("hi", "mid")).alias("high"))


def verdicts(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """`rows` with `kept`: false if the base rules failed or a metric lies outside of its group's band."""
    each = F.struct("low", "mid", "high")
    wide = limits.groupBy("grp").agg(*(F.first(F.when(F.col("metric") == m, each), ignorenulls=True).alias(f"band_{m}") for m in METRICS))
    outside = F.lit(False)
    wider = F.greatest(F.lit(1.0), F.sqrt(SURE_WORDS / F.greatest("n_words", F.lit(1))))
    for m in METRICS:
        away, end = F.col(m) - F.col(f"band_{m}.mid"), lambda side: F.col(f"band_{m}.{side}") - F.col(f"band_{m}.mid")  # noqa: E731, B023
        outside = outside | F.coalesce((away < wider * end("low")) | (away > wider * end("high")), F.lit(False))
    wide = materialise(wide, "bands")  # one row a group; few unless languages are many
    joined = rows.join(F.broadcast(wide) if wide.count() <= FEW_GROUPS else wide, "grp", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~outside).drop(*(f"band_{m}" for m in METRICS))


def judge(docs: DataFrame, width: float = WIDTH, tail: float = TAIL) -> DataFrame:
    """Features and verdict of every row of `docs`. The texts are read once: the features are written, then banded."""
    rows = materialise(features(docs), "fertility")
    return verdicts(rows, bands(rows, width, tail))


def op3_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`judge` over all documents."""
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows whose own verdict is `kept`, with their columns; doc_ids may be null or repeated."""
    row = ROW
    while row in docs.columns:
        row += "_"
    named = [F.col(c).isNull() for c in ("doc_id", "text", "lang")]
    marked = docs.withColumn(row, F.xxhash64("doc_id", "text", "lang", *named))
    kept = judge(marked.select(F.col(row).alias("doc_id"), "text", "lang")).filter("kept").select(F.col("doc_id").alias(row)).distinct()
    return marked.join(kept, row, "left_semi").select(*docs.columns)
