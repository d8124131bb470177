"""Plane calibrations from markers: solve, residuals, degenerate marker sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import rounded
from ..schemas import MARKER

#: Fewest markers, least spreads across a line, residual aimed at.
MIN_MARKERS, MIN_WORLD_M, MIN_IMAGE_PX, TARGET_M = 4, 1.0, 5.0, 0.10


def standard_markers(spark: SparkSession, spacing_m: float = 15.0, half_width_m: float = 10.0) -> DataFrame:
    """Three pairs of ground points on both edges of the strip; the clicks are still to be made."""
    rows = [(None, None, x, y, f"{x:+.0f}/{y:+.0f}") for x in (-spacing_m, 0.0, spacing_m) for y in (-half_width_m, half_width_m)]
    return spark.createDataFrame(rows, MARKER)


def geometry(markers: DataFrame, by: list[str]) -> DataFrame:
    """(by, markers, problem): why a set cannot be solved (few, same_ground, same_click, ground_line, click_line), or the empty text.

    The spread across the best line is the smaller principal axis of the points, from their variances and covariance.
    """
    def across(x: str, y: str):
        a, b, c = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
        return F.sqrt(F.greatest(F.lit(0.0), (a + b) / 2 - F.sqrt(F.pow((a - b) / 2, 2.0) + c * c)))

    places, clicks = F.count_distinct("world_x", "world_y"), F.count_distinct(rounded("image_x", 1), rounded("image_y", 1))
    found = markers.groupBy(*by).agg(F.count("*").alias("markers"), places.alias("places"), clicks.alias("clicks"), across("world_x", "world_y").alias("world"), across("image_x", "image_y").alias("image"))
    problem = (
        F.when(F.col("markers") < MIN_MARKERS, "few").when(F.col("places") < F.col("markers"), "same_ground")
        .when(F.col("clicks") < F.col("markers"), "same_click").when(F.col("world") < MIN_WORLD_M, "ground_line")
        .when(F.col("image") < MIN_IMAGE_PX, "click_line").otherwise("")
    )
    return found.select(*by, "markers", problem.alias("problem"))


def _centred(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points about their centroid at a mean distance of sqrt 2, and the matrix that does so."""
    middle = points.mean(0)
    away = np.linalg.norm(points - middle, axis=1).mean()
    s = np.sqrt(2) / away if away else 1.0
    return (points - middle) * s, np.array([[s, 0, -s * middle[0]], [0, s, -s * middle[1]], [0, 0, 1.0]])


def solve_plane(image: np.ndarray, world: np.ndarray) -> np.ndarray:
    """The projection from image to ground that fits best in the algebraic sense, its last entry 1."""
    (p, to_p), (q, to_q) = _centred(image), _centred(world)
    one, zero = np.ones(len(p)), np.zeros((len(p), 3))
    h = np.column_stack((p, one))
    rows = np.vstack((np.hstack((h, zero, -q[:, :1] * h)), np.hstack((zero, h, -q[:, 1:] * h))))
    m = np.linalg.inv(to_q) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ to_p
    return m / m[2, 2]


def solve(markers: DataFrame, by: str) -> DataFrame:
    """(by, matrix, inverse): one 3 x 3 matrix a set of markers, row by row; a set is a few dozen rows at most."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        m = solve_plane(group[["image_x", "image_y"]].to_numpy(float), group[["world_x", "world_y"]].to_numpy(float))
        return pd.DataFrame({by: [group[by].iloc[0]], "matrix": [m.ravel()], "inverse": [np.linalg.inv(m).ravel()]})

    good = markers.join(geometry(markers, [by]).filter("problem = ''").select(by), by, "left_semi")
    kind = markers.schema[by].dataType.simpleString()
    return good.groupBy(by).applyInPandas(run, f"{by} {kind}, matrix array<double>, inverse array<double>")


def residuals(markers: DataFrame, solved: DataFrame, by: str) -> DataFrame:
    """(by, residual_m, worst_m, acceptable): root mean square and largest distance of projected markers from their places."""
    m = lambda k: F.col("matrix")[k]
    part = lambda r: m(3 * r) * F.col("image_x") + m(3 * r + 1) * F.col("image_y") + m(3 * r + 2)
    dx, dy = part(0) / part(2) - F.col("world_x"), part(1) / part(2) - F.col("world_y")
    return rms(markers.join(solved, by).withColumn("_d", F.sqrt(dx * dx + dy * dy)), [by], "_d", "residual_m", "worst_m").withColumn("acceptable", F.col("residual_m") <= TARGET_M)


def rms(rows: DataFrame, by: list[str], value: str, name: str = "rms", worst: str = "worst") -> DataFrame:
    return rows.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias(name), F.max(F.abs(value)).alias(worst))
