"""Whitening of vectors by an exact integer scatter.

Entries become integers. The distinct integer vectors, less a fixed shift, are summed and multiplied exactly: inside a
batch in doubles or 64-bit integers while no sum can leave their exact range, else in Python's unbounded integers. Batches
are written as signed digits to base 2**32, which Spark adds up, so no total is rounded or overflows at any number of rows.
The driver gets one number for each pair of dimensions, forms n * XtX - S * St exactly, and only then uses doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import materialise, table
from .vectors import dimension, matrix, whole

#: Steps of a unit, the shift of the integers, and the most components.
STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this many steps are taken as this many, so that integers fit 64 bits.
MOST_STEPS = 2.0**61
#: Components with less than this share of the trace for each dimension are rounding, not spread.
LEAST_SHARE = 1e-13
#: Rows that are multiplied at once.
ROWS = 4096
DIGIT = 32


def steps(column: str) -> Column:
    """floor(64 c) of each entry: the integers x of the contract, less their shift of 1000000."""
    return F.transform(column, lambda c: F.floor(F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), c.cast("double") * STEPS))).cast("long"))


def digits(value: int) -> list[int]:
    """`value` as signed digits to base 2**32, least first; their weighted sum is the value again."""
    out, left, sign = [], abs(value), -1 if value < 0 else 1
    while left:
        out.append(sign * (left & (1 << DIGIT) - 1))
        left >>= DIGIT
    return out


def products(rows: np.ndarray) -> list[list[int]]:
    """The exact matrix of products of (1, rows): entry (0, 0) is the count, row 0 the sums."""
    ones = np.column_stack((np.ones(len(rows), np.int64), rows))
    most = max(1, max(abs(int(rows.max())), abs(int(rows.min()))) if rows.size else 1)
    if len(rows) * most * most < 2**53:  # every partial sum is a whole number that a double holds
        wide = ones.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).tolist()
    exact = ones if len(rows) * most * most < 2**63 else ones.astype(object)
    return (exact.T @ exact).tolist()


def scatter(distinct: DataFrame, column: str, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, matrix of n * XtX - S * St) of the rows of whole numbers in `column`, all exact."""
    kind = StructType([StructField("i", IntegerType()), StructField("j", IntegerType()), StructField("place", IntegerType()), StructField("digit", LongType())])
    upper = [(i, j) for i in range(dims + 1) for j in range(i, dims + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dims + 1) for _ in range(dims + 1)]
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for begin in range(0, len(rows), ROWS):
                part = products(rows[begin : begin + ROWS])
                for i, j in upper:
                    total[i][j] += part[i][j]
        out = [(i, j, place, digit) for i, j in upper for place, digit in enumerate(digits(total[i][j]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=kind.names)

    summed = distinct.select(column).mapInArrow(run, kind).groupBy("i", "j", "place").agg(F.sum("digit").alias("digit"))
    xx = [[0] * (dims + 1) for _ in range(dims + 1)]
    for r in summed.collect():  # some digits for each pair of dimensions
        xx[r["i"]][r["j"]] += int(r["digit"]) << (DIGIT * r["place"])
    n, sums = xx[0][0], xx[0][1:]
    return n, sums, [[n * xx[min(i, j) + 1][max(i, j) + 1] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]


def components(n: int, spread: list[list[int]], most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the covariance spread / n**2.

    Whole numbers become doubles here, after a division by their largest that is right to the last bit. Components that
    hold no more than rounding are left out.
    """
    top = max((abs(v) for row in spread for v in row), default=0)
    if not n or not top:
        return np.empty(0), np.empty((len(spread), 0)), 0.0
    scaled = np.array([[v / top for v in row] for row in spread])
    scale = top / (n * n)
    values, vectors = np.linalg.eigh(scaled)
    trace = sum(spread[i][i] for i in range(len(spread))) / top
    kept = [i for i in range(len(values) - 1, -1, -1) if values[i] > LEAST_SHARE * trace][:most]
    return values[kept] * scale, vectors[:, kept], trace * scale


def whitened(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    Vectors that are null, empty, of another length than the most common one, or that hold a null, NaN or infinite entry are
    left out; repeated rows and rows without an id give rows of their own, but count once in the fit. Fewer components
    than `most` are given where the distinct vectors spread over fewer dimensions: none for one distinct vector or an
    empty table. Entries beyond 2**55 count as that. `deviation` is null where it leaves 64 bits; `deviation_exact` is it
    in full. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = StructType([
        StructField("vec_id", vectors.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()), *StructType.fromDDL("deviation_exact string").fields,
    ])
    good = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(whole("vector"))
    dims = dimension(good, "vector")
    if not dims:
        return spark.createDataFrame([], schema)
    rows = good.filter(F.size("vector") == dims).select("vec_id", steps("vector").alias("x"))
    fit = materialise(rows.select("x").distinct(), "whitening-fit")
    n, sums, spread = scatter(fit, "x", dims)
    values, axes, trace = components(n, spread, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    # x - S/n is small where x is not: whole steps from the rounded mean first, then the fraction of a step that is left
    middle = np.array([s // n for s in sums], dtype=object)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)])
    weights = axes / np.sqrt(values)
    near = middle.astype(np.int64)

    def scores(x: np.ndarray) -> np.ndarray:
        # row by row, so that equal vectors have equal scores wherever they lie in a batch
        return np.einsum("ij,jk->ik", (x - near).astype(np.float64) - rest, weights)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        total, count = np.zeros((k + 1, k + 1)), 0
        for batch in batches:
            w = scores(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
            w = np.column_stack((np.ones(len(w)), w))
            total, count = total + w.T @ w, count + len(w)
        if count:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    moments = np.zeros((len(values) + 1, len(values) + 1))
    for r in fit.mapInArrow(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[r["i"], r["j"]] = r["s"]
    covariance = moments[1:, 1:] / n - np.outer(moments[0, 1:], moments[0, 1:]) / (n * n)
    error = float(np.abs(covariance - np.eye(len(values))).max())
    share = (values / trace).tolist()
    exact_sums = [int(s) for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(begin, ROWS)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                deviation = deviations(x, n, exact_sums)
                fits = [d if d < 2**63 else None for d in deviation]
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                     pa.array(fits, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(scores(x).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                     pa.array([str(d) for d in deviation], pa.string()).take(pa.array(np.repeat(np.arange(m), k)))], names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - S)**2 of each row, exact."""
    most = max(1, max(abs(int(x.max())), abs(int(x.min())))) if x.size else 1
    reach = n * most + max(abs(s) for s in sums)
    if reach * reach * x.shape[1] < 2**63:
        away = x * n - np.array(sums, np.int64)
        return (away * away).sum(1).tolist()
    if reach < 2**62:  # the differences fit, their squares need not
        away = x * n - np.array(sums, np.int64)
        if int(np.abs(away).max()) ** 2 * x.shape[1] < 2**63:
            return (away * away).sum(1).tolist()
        away = away.astype(object)
        return (away * away).sum(1).tolist()
    away = x.astype(object) * n - np.array(sums, dtype=object)
    return (away * away).sum(1).tolist()


def op13_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened rows of `embeddings`; see `whitened`. Shifting all x by 1000000 changes none of the columns."""
    return whitened(table(spark, sf_dir, "embeddings"))
