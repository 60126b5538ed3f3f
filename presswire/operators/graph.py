"""Connected components of links between rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

ONE_TASK = 1_000_000  # links that one task joins up, 16 MB


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number connected to each of n numbers by the pairs given."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right, root[left], root[right]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_groups(near: np.ndarray) -> np.ndarray:
    """The group of each row, numbered from 0, of a symmetric matrix that tells which rows
    are linked. Every row of the matrix is read once."""
    group = np.full(len(near), -1)
    for start in range(len(near)):
        if group[start] < 0:
            number = group.max() + 1
            front = np.array([start])
            while len(front):
                group[front] = number
                front = np.flatnonzero(near[front].any(axis=0) & (group < 0))
    return group


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if held:
        both = pa.Table.from_batches(held)
        a, b = both["a"].to_numpy(), both["b"].to_numpy()
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = names[roots(place[:len(a)], place[len(a):], len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(root)], ["id", "component"])


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``(id, component)`` of every id on an undirected link ``(a, b)`` of longs; a
    component has the name of its smallest id.

    Links of a number one task can hold are joined up there. More of them are
    turned, round by round, towards the smallest id next to each id until every
    component is a star; rounds grow with the logarithm of the longest path.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.limit(one_task + 1).count() <= one_task:
        return now.coalesce(1).mapInArrow(_joined_up, "id long, component long")
    mark = None
    while True:
        # larger neighbours of an id go to the smallest of its neighbourhood
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = written(ends.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        # then an id and its smaller neighbours to the smallest of those
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        turned = wide.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(turned.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if new == mark:
            stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
            return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
        mark = new
