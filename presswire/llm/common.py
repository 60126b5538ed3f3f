"""Helpers shared by the training-data operators."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path, written

__all__ = ["BATCH_ROWS", "HOT_SHARE", "components", "join_counted", "ready", "scratch_path", "table", "written"]

# A key is hot when it holds more than this share of the rows, so that there
# are at most 1 / HOT_SHARE hot keys, whatever the size of the table.
HOT_SHARE = 1 / 1000


BATCH_ROWS = "1000"  # whole texts that a Python worker holds at once


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings of this library, and small batches to Python."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf}/{name}.parquet")


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join rows to one row per group, for groups of any size.

    `count` says how many rows a group has and `total` how many there are at
    least. Groups above HOT_SHARE of the total are broadcast, there being at
    most 1 / HOT_SHARE of them; no other key is large enough to be uneven.
    """
    least = max(1.0, total * HOT_SHARE)
    hot = groups.where(F.col(count) > least)
    at_once = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return at_once.unionByName(rest.join(groups.where(F.col(count) <= least), key, "left"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an undirected edge (a, b); ids are longs and a
    component is named by its smallest id.

    Every id first points to its smallest neighbour. A round follows pointers
    until all of them reach a root, replaces edges by edges between roots, drops
    those inside a tree, and hooks each root under the smallest root next to it.
    Rounds grow with the logarithm of the longest path. Each step is a join
    whose result is written to the shared folder.
    """
    links = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to")))
    label = ends.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("label"))
    while True:
        label = _to_roots(written(label, "labels"))
        root_a, root_b = (label.select(F.col("id").alias(x), F.col("label").alias(f"root_{x}")) for x in "ab")
        across = links.join(root_a, "a").join(root_b, "b").where("root_a <> root_b")
        links = written(across.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
        if links.isEmpty():
            return label.select("id", F.col("label").alias("component"))
        hooks = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("hook"))
        label = label.join(hooks, "id", "left").select("id", F.coalesce("hook", "label").alias("label"))


def _to_roots(label: DataFrame) -> DataFrame:
    while True:
        up = label.select(F.col("id").alias("label"), F.col("label").alias("up"))
        # every label is an id too
        step = written(label.join(up, "label").select("id", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")), "labels")
        label = step.select("id", "label")
        if step.where("moved").isEmpty():
            return label
