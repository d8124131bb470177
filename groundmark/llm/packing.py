"""Best-fit packing by the configuration linear program over the length histogram.

Texts are tokenised once, cut into pieces of at most `size` tokens, and written with each piece's rank among the pieces
of its length and input partition. All else works on the histogram of lengths, which has at most `size` bins whatever
the corpus: multiplicative weights price the lengths, a knapsack dynamic program finds the best configurations for those
prices, and the amounts taken, over the least coverage of a length, solve the configuration program to within `GAP` of a
lower bound. They are rounded to whole numbers, and the pieces that these leave are put by best fit decreasing, again by
length and multiplicity, into the room left or new sequences. Several roundings are tried, from all of the program down to
none of it, and the first that takes the fewest sequences is the plan, so it is never worse than best fit. A piece then finds its sequence and offset from its length
and rank by a binary search in the list of slots, so no group of pieces ever meets in one task.

A document is its ids and an end id; longer ones are cut so that only the first piece may be shorter than `size`.
Nulls: a null text is an empty one (the end id only); a null or repeated doc_id is carried through, and repeated rows
are packed one by one. An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, slices, strings, table
from .tokens import byte_table, vocabulary

VOCABULARY = "byte_bpe_50k.json"
SIZE, END = 1024, 2
#: The program is solved until its solution is within this share of a lower bound, or for so many rounds.
GAP, ROUNDS = 0.01, 3000
#: A configuration is taken if its value is within this share of the best one; prices fall at this rate. After so many
#: rounds without the gap both are halved, and amounts are gathered anew from the prices reached.
SLACK, RATE, PHASE = 0.02, 0.1, 1000
#: Roundings: the share of the program's amounts that is taken, of configurations that are worth so much at the dual's prices.
ROUNDINGS = tuple((share, value) for value in (0.9, 1 - 1e-9) for share in (1.0, 0.95, 0.9, 0.8)) + ((0.5, 0.9), (0.0, 0.9))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text followed by the end id, as little-endian unsigned 32-bit, and the new counts."""
    out = np.empty(len(ids) + len(counts), "<u4")
    last = np.cumsum(counts + 1) - 1
    text = np.ones(len(out), bool)
    text[last] = False
    out[text] = ids
    out[last] = end
    return out, counts + 1


def _pieces(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = byte_table(path).tokens, TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = strings(batch.column("text"))
            for begin, end in slices(texts, 3_000_000):
                ids, counts = with_end(*encode(texts[begin:end]), end_id)
                raw = memoryview(ids).cast("B")
                n = -(-counts // size)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                first = counts - size * (n - 1)
                length = np.where(piece == 0, first[doc], size)
                start = np.where(piece == 0, 0, first[doc] + size * (piece - 1))
                at = (4 * ((np.cumsum(counts) - counts)[doc] + start)).tolist()
                crc = [zlib.crc32(raw[a : a + b]) for a, b in zip(at, (4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                rank = np.empty_like(length)
                rank[order] = seen[ordered] + np.arange(len(order)) - np.searchsorted(ordered, ordered)
                seen += np.bincount(length, minlength=size + 1)
                yield pa.record_batch([
                    batch.column("doc_id")[begin:end].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank),
                ], names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def knapsack(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most value that each room of up to `size` can hold, and a length that begins such a filling (0: room is left).

    values[l] is that of length l; a length may be taken many times.
    """
    best = np.zeros(size + 1)
    pick = np.zeros(size + 1, np.int64)
    lengths = np.flatnonzero(values > 0)
    worth = values[lengths]
    fitting = np.searchsorted(lengths, np.arange(size + 1), "right").tolist()
    for room in range(1, size + 1):
        n = fitting[room]
        best[room] = best[room - 1]
        if n:
            total = best[room - lengths[:n]] + worth[:n]
            k = int(total.argmax())
            if total[k] > best[room]:
                best[room], pick[room] = total[k], lengths[k]
    return best, pick


def filling(pick: np.ndarray, room: int) -> Counter:
    """The lengths of a best filling of `room`, from the picks of `knapsack`."""
    out: Counter = Counter()
    while room > 0:
        length = int(pick[room])
        out.update([length] if length else [])
        room -= length or 1
    return out


def _program(demand: np.ndarray, size: int, gap: float, rounds: int) -> tuple[dict[tuple, float], float, np.ndarray]:
    """`configurations`, with the prices that give the bound: no configuration is worth more than 1 at them."""
    active = np.flatnonzero(demand)
    wanted = demand.astype(float)
    price = np.zeros(size + 1)
    price[active] = active / size
    bound, dual = float(wanted @ price), price.copy()
    best_total, best_found = np.inf, {}
    noise, slack, rate = np.random.default_rng(1), SLACK, RATE
    for k in range(rounds if len(active) else 0):
        if k % PHASE == 0:
            slack, rate = (slack / 2, rate / 2) if k else (slack, rate)
            covered, total, found = np.zeros(size + 1), 0.0, defaultdict(float)
        # many fillings are worth the same: a little noise takes another one each round
        best, pick = knapsack(price * (1 + slack / 4 * noise.random(size + 1)), size)
        top = best[size]
        if float(wanted @ price) / top > bound:
            bound, dual = float(wanted @ price) / top, price / top
        for length in active[np.argsort(covered[active], kind="stable")].tolist():
            if price[length] + best[size - length] < (1 - slack) * top:
                continue
            config = filling(pick, size - length)
            config[length] += 1
            if sum(n * price[x] for x, n in config.items()) < (1 - slack) * top:
                continue
            amount = min(wanted[x] / n for x, n in config.items())
            found[tuple(sorted(config.items(), reverse=True))] += amount
            total += amount
            for x, n in config.items():
                part = n * amount / wanted[x]
                covered[x] += part
                price[x] *= np.exp(-rate * part)
        least = covered[active].min()
        done = total <= (1 + gap) * bound * least
        if (done or k % PHASE == PHASE - 1 or k == rounds - 1) and total < best_total * least:
            best_total, best_found = total / least, {config: amount / least for config, amount in found.items()}
        if done:
            break
    if len(active) and best_total > (1 + gap) * bound:
        warnings.warn(f"the program ended after {rounds} rounds with a gap of {best_total / bound - 1:.3g}", stacklevel=2)
    return best_found, bound, dual


def configurations(demand: np.ndarray, size: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[dict[tuple, float], float]:
    """A feasible solution of the configuration program, amounts by configuration, and a lower bound of its optimum.

    The program covers demand[l] pieces of each length l by the least amount of configurations. Prices start from the room
    that a piece takes, which no configuration exceeds. Each round the dynamic program prices all rooms once; for each
    length, the least covered first, the best configuration that holds it is taken if its value is still within
    `SLACK` of the best, as often as its scarcest length is wanted, and what it covers gets cheaper by the share covered.
    The amounts over the least coverage of a length are a solution. Prices over the best value are a solution of the
    dual, so the search ends once the two are within `gap`; it warns if `rounds` are not enough for that.
    """
    return _program(demand, size, gap, rounds)[:2]


def best_fit(demand: np.ndarray, size: int, begun: list[tuple[tuple, int]] = ()) -> list[tuple[tuple, int]]:
    """Best fit decreasing of demand[l] pieces of each length l, by multiplicity, into the room that `begun` leaves and new sequences: (configuration, times)."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left: [configuration, times]
    for config, times in begun:
        open_[size - sum(length * n for length, n in config)].append([config, times])
    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        while left:
            room = min((r for r, x in open_.items() if r >= length and x), default=None)
            if room is None:
                each = size // length
                full, rest = divmod(left, each)
                if full:
                    open_[size - each * length].append([((length, each),), full])
                if rest:
                    open_[size - rest * length].append([((length, rest),), 1])
                break
            config, times = open_[room].pop()
            taken = min(left, times)
            if taken < times:
                open_[room].append([config, times - taken])
            more = dict(config)
            more[length] = more.get(length, 0) + 1
            open_[room - length].append([tuple(more.items()), taken])
            left -= taken
    return [(config, times) for x in open_.values() for config, times in x]


def _rounded(demand: np.ndarray, size: int, amounts: dict[tuple, float], dual: np.ndarray, share: float, value: float) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """Whole numbers of `share` of the program's configurations, and the pieces of each length that they leave.

    Configurations worth less than `value` at the dual's prices are no part of a best solution and are left out. Every amount
    is rounded down; then the fractions are added up in order of the configurations, and each time that they pass a whole
    number the configuration at hand is taken once more, so about as many are taken as the program has.
    """
    rest = demand.copy()
    chosen: list[tuple[tuple, int]] = []

    def take(config: tuple, times: int) -> None:
        times = min([times, *(int(rest[length]) // n for length, n in config)])
        if times > 0:
            chosen.append((config, times))
            for length, n in config:
                rest[length] -= n * times

    good = [(config, share * amount) for config, amount in amounts.items() if sum(n * dual[length] for length, n in config) >= value]
    fullest = sorted(good, key=lambda x: (size - sum(a * b for a, b in x[0]), -x[1], x[0]))
    for config, amount in fullest:
        take(config, int(amount))
    carry = 0.5
    for config, amount in fullest:
        carry += amount - int(amount)
        if carry >= 1:
            carry -= 1
            take(config, 1)
    return chosen, rest


def rounded(demand: np.ndarray, size: int) -> tuple[list[tuple[tuple, int]], np.ndarray]:
    """The first of `ROUNDINGS` of the program's solution, and the pieces of each length that it leaves."""
    amounts, _, dual = _program(demand, size, GAP, ROUNDS)
    return _rounded(demand, size, amounts, dual, *ROUNDINGS[0])


def _count(chosen: list[tuple[tuple, int]]) -> int:
    return sum(times for _, times in chosen)


def plan(demand: np.ndarray, size: int) -> list[tuple[tuple, int]]:
    """Whole numbers of configurations that hold demand[l] pieces of each length l exactly: the best of `ROUNDINGS`.

    The last rounding takes nothing of the program, so the plan is no worse than best fit decreasing. Pieces of the whole
    size are a sequence each.
    """
    left = demand.copy()
    left[size] = 0
    amounts, _, dual = _program(left, size, GAP, ROUNDS)
    best: list[tuple[tuple, int]] | None = None
    for share, value in ROUNDINGS:
        chosen, rest = _rounded(left, size, amounts, dual, share, value)
        packed = best_fit(rest, size, chosen)
        if best is None or _count(packed) < _count(best):
            best = packed
    return [(((size, 1),), int(demand[size]))] * bool(demand[size]) + best


def slots(chosen: list[tuple[tuple, int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each slot, and the first sequence and the offset of the pieces from that rank on."""
    found: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for config, times in chosen:
        offset = 0
        for length, n in config:
            for _ in range(n):
                found[length].append((used[length], sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64).T) for length, x in found.items()}


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length).tolist():
                here = length == x
                first, seq, off = by_length[x]
                k = np.searchsorted(first, rank[here], "right") - 1
                sequence[here] = seq[k] + rank[here] - first[k]
                offset[here] = off[k]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=PACKED_NAMES)

    return run


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PACKED_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def pack(docs: DataFrame, vocabulary_file: str = VOCABULARY, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece of the documents: where it starts in its document, and its sequence and offset there."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = materialise(rows.mapInArrow(_pieces(vocabulary(vocabulary_file), size, end), PIECES), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    demand = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        demand[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(slots(plan(demand, size), size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(counts.select("part", "length", before.alias("before")), ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(shared), PACKED)


def op10_config_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack` over all documents."""
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the documents with their sequences."""
    return pack(docs)
