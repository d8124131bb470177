"""Nearest neighbours by largest inner product from a few stable projections, kd-trees and a chi-square stopping test.

One more coordinate gives all rows the same length R, so that the largest inner product is the least distance. A fixed
matrix of normal variates projects rows to `COMPONENTS` dimensions: for a pair at squared distance D, the squared
projected distance over D has a chi-square distribution. So once the projected neighbours still to come are farther than
the `SURE` quantile times the squared distance of the k-th best row seen, a row still unseen that is nearer than that one
would have been seen with at least that probability, and the search stops.

A kd-tree fitted on a bounded sample deals all rows to cells of projected space; a cell of many rows, such as one of
copies, is cut into blocks by a hash of the id. Every query first searches its own block, which bounds its k-th distance,
then all blocks whose box the stopping radius reaches. A task reads a block, builds the block's own kd-tree, and streams
the block's queries past it, so that it holds one block and one batch of queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import materialise, ragged, table
from .vectors import dimension, lists, matrix, whole

#: Dimensions of the projection, the probability of the stopping test, neighbours wanted, every how many-th id asks.
COMPONENTS, SURE, NEAREST, EVERY = 10, 0.95, 20, 20
#: Rows that the cells are fitted on, fewest and most cells, rows of a block on large tables.
SAMPLE, FEWEST, MOST, BLOCK = 20_000, 16, 4096, 65_536
#: Rows of a leaf of a block's tree, and leaves that are looked at together.
LEAF, LEAVES = 64, 8
SEED = 11


def chi_square_quantile(sure: float, dims: int) -> float:
    """Where the chi-square distribution of an even number of dimensions reaches `sure`, by bisection."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1.0
    while below(high) < sure:
        high *= 2
    for _ in range(100):
        low, high = (low, (low + high) / 2) if below((low + high) / 2) >= sure else ((low + high) / 2, high)
    return high


def projection(dims: int) -> np.ndarray:
    """The fixed matrix of standard normal variates; its last row is for the coordinate that evens lengths."""
    return np.random.default_rng(SEED).standard_normal((dims + 1, COMPONENTS))


def projected(rows: np.ndarray, stable: np.ndarray, length2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, length2 - (rows * rows).sum(1)))
    return rows @ stable[:-1] + rest[:, None] * stable[-1]


class Cells:
    """A complete kd-tree over projected space whose leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels = levels
        self.axis, self.cut = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
        parts = {0: points}
        for node in range(2**levels - 1):
            rows = parts.pop(node)
            if len(rows):
                self.axis[node] = np.ptp(rows, 0).argmax()
                self.cut[node] = np.median(rows[:, self.axis[node]])
            right = rows[:, self.axis[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[~right], rows[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (2**self.levels - 1)


def leaves_of(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points that puts each leaf's together, and where each leaf starts (and the end)."""
    order, starts, todo = [], [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            starts.append(len(rows))
            order.append(rows)
            continue
        values = points[rows, np.ptp(points[rows], 0).argmax()]
        half = np.argpartition(values, len(rows) // 2)
        todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return np.concatenate(order), np.concatenate(([0], np.cumsum(starts)))


class Block:
    """The rows of a block under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, stable: np.ndarray, length2: float, stop: float):
        points = projected(rows, stable, length2)
        order, self.starts = leaves_of(points, LEAF)
        self.ids, self.rows, self.points = ids[order], rows[order], points[order]
        self.low, self.high = np.minimum.reduceat(self.points, self.starts[:-1]), np.maximum.reduceat(self.points, self.starts[:-1])
        self.length2, self.stop = length2, stop

    def nearest(self, own: int, query: np.ndarray, place: np.ndarray, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the block's best rows, best first, of those that reach `bound`.

        Leaves come by the distance of their boxes; a row is verified if the stopping test has not yet held at its
        projected distance. Equal inner products go to the smaller id.
        """
        away = ((np.maximum(self.low - place, 0) + np.maximum(place - self.high, 0)) ** 2).sum(1)
        nearest = np.argsort(away, kind="stable")
        scale = self.length2 + query @ query
        reach = lambda b: self.stop * (max(0.0, scale - 2 * b) + 1e-9 * scale)
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for i in range(0, len(nearest), LEAVES):
            within = reach(bound)
            taken = nearest[i : i + LEAVES]
            taken = taken[away[taken] <= within]
            if not len(taken):
                break
            at = ragged(self.starts[taken], self.starts[taken + 1] - self.starts[taken])
            at = at[((self.points[at] - place) ** 2).sum(1) <= within]
            # summed row by row, so that equal vectors have equal scores wherever they lie
            found = (self.rows[at] * query).sum(1)
            good = (found >= bound) & (self.ids[at] != own)
            ids, scores = np.concatenate((ids, self.ids[at[good]])), np.concatenate((scores, found[good]))
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                bound = max(bound, float(scores[-1]))
        return ids, scores


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    cuts = np.concatenate(([0], np.flatnonzero(change), [len(change)]))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _searcher(stable: np.ndarray, length2: float, stop: float, k: int, vector: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads (block, asks, vec_id, vector, bound) sorted by block and asks; gives each query's best rows of its block."""
    dims = len(stable) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, asks, ids, bounds = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "asks", "vec_id", "bound"))
            rows = matrix(batch.column(batch.schema.get_field_index("vector")), dims)
            queries, found = [], []
            for a, b in _runs(number, asks):
                if number[a] != current:
                    current, held, block = number[a], [], None
                if not asks[a]:
                    held.append((ids[a:b], rows[a:b]))
                    continue
                if block is None and held:
                    block = Block(*(np.concatenate(x) for x in zip(*held)), stable, length2, stop)
                    held = []
                for i in range(a, b):
                    empty = (np.empty(0, np.int64), np.empty(0))
                    found.append(block.nearest(ids[i], rows[i], rows[i] @ stable[:-1], bounds[i], k) if block else empty)
                    queries.append(i)
            if queries:
                ends = np.concatenate(([0], np.cumsum([len(x) for x, _ in found]))).astype(np.int32)
                list_of = lambda j, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[j] for x in found]), kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[queries]), lists(rows[queries], vector), pa.array(number[queries], pa.int32()), list_of(0, pa.int64()), list_of(1, pa.float64())],
                    names=["query_id", "vector", "block", "ids", "scores"],
                )

    return run


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, sure: float = SURE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the `k` rows of largest inner product.

    All rows are candidates but those with the query's id. Rows without an id, and vectors that are null, empty, zero, of
    another length than the most common one, or that hold a null, NaN or infinite entry take no part. If an id repeats,
    each of its rows asks, and their answers are merged: an id is named once, with its largest score. Fewer candidates
    than `k` are all returned, an empty table gives no rows, and other columns are ignored. Lengths that differ widely
    leave little contrast between distances: then the test stops late and most rows are verified.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & whole("vector")).filter(~F.forall("vector", lambda x: x == 0))
    dims = dimension(rows, "vector")
    rows = rows.filter(F.size("vector") == dims)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, length2 = rows.agg(F.count("*"), F.max(square)).first()
    out = StructType([StructField("query_id", LongType()), StructField("rank", IntegerType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])
    if not total:
        return spark.createDataFrame([], out)
    length2 *= 1 + 1e-12
    stable, stop = projection(dims), chi_square_quantile(sure, COMPONENTS)

    # the cells, from a sample of bounded size; all rows are dealt to them
    chosen = rows.select("vector").filter(F.rand(SEED) < min(1.0, 2 * SAMPLE / total)).limit(SAMPLE).toArrow()["vector"].combine_chunks()
    sample = projected(matrix(chosen, dims), stable, length2) if len(chosen) else np.empty((0, COMPONENTS))
    size = min(BLOCK, -(-total // FEWEST))
    cells = Cells(sample, int(np.log2(min(MOST, max(FEWEST, 1 << int(total // BLOCK).bit_length())))))

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = projected(matrix(batch.column(1), dims), stable, length2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(points), pa.int32()), lists(points, pa.float64())], names=["vec_id", "vector", "cell", "point"])

    schema = StructType([StructField("vec_id", LongType()), StructField("vector", ArrayType(kind)), StructField("cell", IntegerType()), StructField("point", ArrayType(DoubleType()))])
    dealt = materialise(rows.mapInArrow(located, schema), "stable-points")
    sides = [f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(COMPONENTS)]
    boxes = dealt.groupBy("cell").agg(F.count("*").alias("n"), *sides).orderBy("cell").collect()  # at most MOST rows
    low, high = (np.array([[r[f"{n}{i}"] for i in range(COMPONENTS)] for r in boxes]) for n in ("low", "high"))
    parts = np.array([-(-r["n"] // size) for r in boxes])
    first = np.concatenate(([0], np.cumsum(parts)))[:-1]
    numbers = F.broadcast(spark.createDataFrame([(r["cell"], int(f), int(p)) for r, f, p in zip(boxes, first, parts)], "cell int, first int, parts int"))
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int").alias("block")
    points = dealt.join(numbers, "cell").select(block, F.lit(False).alias("asks"), "vec_id", "vector", F.lit(float("-inf")).alias("bound"))

    small = pa.float32() if kind.typeName() == "float" else pa.float64()
    found = StructType([StructField("query_id", LongType()), StructField("vector", ArrayType(kind)), StructField("block", IntegerType()), StructField("ids", ArrayType(LongType())), StructField("scores", ArrayType(DoubleType()))])

    def searched(queries: DataFrame) -> DataFrame:
        together = points.unionByName(queries).repartition("block").sortWithinPartitions("block", "asks")
        return together.mapInArrow(_searcher(stable, length2, stop, k, small), found)

    own = materialise(searched(points.filter(F.col("vec_id") % every == 0).withColumn("asks", F.lit(True))), "stable-own")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every other block that its stopping radius reaches, with the score it has to reach."""
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(begin, 512)
                queries = matrix(batch.column(1), dims)
                places = queries @ stable[:-1]
                bounds = np.array([s[k - 1] if len(s) >= k else -np.inf for s in batch.column(4).to_pylist()])
                scale = length2 + (queries * queries).sum(1)
                within = stop * (np.maximum(0.0, scale - 2 * bounds) + 1e-9 * scale)
                home = batch.column(2).to_numpy()
                for i in range(len(queries)):
                    away = ((np.maximum(low - places[i], 0) + np.maximum(places[i] - high, 0)) ** 2).sum(1)
                    near = away <= within[i]
                    to = ragged(first[near], parts[near])
                    to = to[to != home[i]]
                    if len(to):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to, pa.int32()), pa.array(np.ones(len(to), bool)), pa.array(np.repeat(batch.column(0)[i].as_py(), len(to)), pa.int64()),
                             lists(np.repeat(queries[i : i + 1], len(to), 0), small), pa.array(np.full(len(to), bounds[i]))], names=["block", "asks", "vec_id", "vector", "bound"],
                        )

    others = searched(own.mapInArrow(spread, points.schema))
    pairs = own.unionByName(others).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_stable_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of `embeddings` by inner product, for every id divisible by 20; see `nearest`."""
    return nearest(table(spark, sf_dir, "embeddings"))
