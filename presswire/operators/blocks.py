"""Vectors in blocks of near directions, so that most pairs of blocks are never read."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.vectors import dot
from ..session import written

BLOCK_ROWS = 1024
MOST_DIRECTIONS = 512
FIT_ROWS = 8192  # vectors that directions are fitted on


def fit_directions(rows: DataFrame, count: int) -> np.ndarray:
    """Unit directions of groups of vectors: k-means by angle on at most FIT_ROWS vectors,
    those of the smallest hash of the id. What they are decides how many blocks are
    skipped, never which pairs are found."""
    drawn = rows.select("id", "vector").orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(FIT_ROWS)
    matrix = np.array([r["vector"] for r in drawn.collect()], dtype=np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = (matrix / np.where(length == 0, 1, length))[length[:, 0] > 0]
    if not len(matrix):
        return np.zeros((1, 1))
    # seeds far from each other
    found = [matrix[0]]
    nearest = matrix @ found[0]
    while len(found) < min(count, len(matrix)):
        found.append(matrix[int(nearest.argmin())])
        nearest = np.maximum(nearest, matrix @ found[-1])
    centers = np.array(found)
    for _ in range(10):
        home = (matrix @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, home, matrix)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return centers


def _nearest(centers: np.ndarray) -> Callable:
    @F.pandas_udf(IntegerType())
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series((np.array(vectors.tolist(), dtype=np.float64) @ centers.T).argmax(axis=1)).astype("int32")

    return nearest


def pack_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Vectors ``(day, id, vector)`` in blocks of about `block_rows`, one written row per block:
    ids and matrix, and the center and the widest angle around it.

    A day that fits is one block. A larger day is cut by direction, directions
    being fitted to the vectors, and by hash within one that is still too large.
    """
    kinds = dict(rows.dtypes)
    per_day = written(rows.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_slices")), "blocks")
    most = per_day.agg(F.max("_slices")).first()[0] or 1
    if most == 1:
        sliced = rows.withColumn("block", F.lit("0/0"))
    else:
        near = _nearest(fit_directions(rows, min(MOST_DIRECTIONS, most)))
        celled = rows.join(per_day, "day").withColumn("_cell", F.when(F.col("_slices") > 1, near("vector")).otherwise(0)).drop("_slices")
        per_cell = celled.groupBy("day", "_cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_slices"))
        sliced = celled.join(per_cell, ["day", "_cell"]).withColumn(
            "block", F.concat_ws("/", "_cell", F.pmod(F.xxhash64("id"), F.col("_slices"))))

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(part["vector"].tolist(), dtype=np.float32)
        wide = matrix.astype(np.float64)
        center = wide.mean(axis=0)
        length = np.linalg.norm(center)
        center = center / length if length else center
        lengths = np.linalg.norm(wide, axis=1)
        cosines = (wide @ center) / np.where(lengths == 0, 1, lengths)
        radius = float(np.arccos(np.clip(cosines, -1, 1)).max()) if length and (lengths > 0).all() else float(np.pi)
        return pd.DataFrame({
            "day": [key[0]], "block": [key[1]], "ids": [part["id"].tolist()], "matrix": [matrix.tobytes()],
            "dims": [matrix.shape[1]], "center": [center], "radius": [radius],
        })

    schema = f"day {kinds['day']}, block string, ids array<{kinds['id']}>, matrix binary, dims int, center array<double>, radius double"
    return written(sliced.select("day", "block", "id", "vector").groupBy("day", "block").applyInPandas(pack, schema), "blocks")


def heads(blocks: DataFrame, prefix: str = "", more: tuple = ()) -> DataFrame:
    """What is known of a block without its matrix."""
    return blocks.select(*[F.col(c).alias(prefix + c) for c in ("day", "block", "center", "radius", *more)])


def within_reach(threshold: float) -> Column:
    """Whether some pair of two heads can be as near as the threshold, by the triangle
    inequality of angles."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("center"), F.col("r_center"))))
    return F.acos(cosine) - F.col("radius") - F.col("r_radius") <= float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6


def with_matrices(pairs: DataFrame, left: DataFrame, right: DataFrame, more: tuple = ("ids",), kept: tuple = ()) -> DataFrame:
    """Pairs of blocks ``(day, block, r_day, r_block)`` with matrices of both, columns `more`
    of both and columns `kept` of the pair. Only blocks of a pair are fetched."""
    names = ("day", "block", *more, "matrix", "dims")
    ours = left.select(*names)
    theirs = right.select(*[F.col(c).alias(f"r_{c}") for c in names[:-1]])
    return pairs.select("day", "block", "r_day", "r_block", *kept).join(ours, ["day", "block"]).join(theirs, ["r_day", "r_block"])


def matrix(packed: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.float32).reshape(-1, dims).astype(np.float64)


def matrices(row) -> tuple[np.ndarray, np.ndarray]:
    return matrix(row.matrix, row.dims), matrix(row.r_matrix, row.dims)
