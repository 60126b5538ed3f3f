"""Similarity joins: prior mentions and headline repeats."""

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import strip
from ..functions.vectors import dot
from .blocks import BLOCK_ROWS, heads, matrices, pack_blocks, with_matrices, within_reach


def similar_before(left: DataFrame, right: DataFrame, threshold: float, days: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of unit vectors at or above a cosine, with the right one dated in
    ``[left day - days, left day)``.

    Inputs are ``(day date, id string, vector)``. Vectors are packed in blocks of
    near directions. First only the blocks' centers and radii meet, by an equi-join
    on the earlier day; pairs of blocks too far apart for any pair of vectors end
    there. For those that are left the matrices are fetched and take one product
    each. Only pairs of vectors that pass are emitted.
    """
    older, newer = pack_blocks(right, block_rows), pack_blocks(left, block_rows)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = matrices(row)
                cosines = a @ b.T
                i, j = np.nonzero(cosines >= threshold)
                if len(i):
                    yield pd.DataFrame({
                        "day": row.day, "id": np.asarray(row.ids, dtype=object)[i],
                        "prior_day": row.r_day, "prior_id": np.asarray(row.r_ids, dtype=object)[j],
                        "similarity": cosines[i, j],
                    })

    near = blocks_before(newer, older, days).where(within_reach(threshold))
    return with_matrices(near, newer, older).mapInPandas(
        multiply, "day date, id string, prior_day date, prior_id string, similarity double")


def blocks_before(newer: DataFrame, older: DataFrame, days: int) -> DataFrame:
    """Heads of blocks with those of the days before."""
    looking = heads(newer).withColumn("r_day", F.explode(F.sequence(F.date_sub("day", days), F.date_sub("day", 1))))
    return looking.join(heads(older, "r_"), "r_day")


def published_only(clusters: DataFrame, published_ids: DataFrame) -> DataFrame:
    """Clusters that appeared in an edition."""
    return clusters.join(published_ids.select("cluster_id").distinct(), "cluster_id", "left_semi")


def days_in_reach(today: DataFrame, gold: DataFrame, days: int) -> DataFrame:
    """The rows of gold of any day that a story of today looks back on; without a story there are none."""
    span = today.agg(F.min("ingest_date").alias("first"), F.max("ingest_date").alias("last")).first()
    return gold.where(F.lit(False) if span["first"] is None else (
        F.col("ingest_date") >= F.lit(span["first"] - timedelta(days=days))) & (F.col("ingest_date") < F.lit(span["last"])))


def prior_mentions(today: DataFrame, gold: DataFrame, published_ids: DataFrame,
                   threshold: float = C.CLUSTER_THRESHOLD, days: int = C.PRIOR_MENTION_DAYS) -> DataFrame:
    """Earlier published coverage of each story.

    Both sides have ingest_date, cluster_id and vector; `gold` also headline
    and summary_seed. Rows are ranked newest first, then most similar.
    """
    candidates = published_only(days_in_reach(today, gold, days), published_ids)
    pairs = similar_before(
        today.select(F.col("ingest_date").alias("day"), F.col("cluster_id").alias("id"), "vector"),
        candidates.select(F.col("ingest_date").alias("day"), F.col("cluster_id").alias("id"), "vector"),
        threshold, days,
    )
    summary = strip(F.when(F.coalesce("summary_seed", F.lit("")) != "", F.col("summary_seed")).otherwise(F.col("headline")))
    told = candidates.select(F.col("ingest_date").alias("prior_day"), F.col("cluster_id").alias("prior_id"), summary.alias("summary"))
    return pairs.join(told, ["prior_day", "prior_id"]).select(
        F.col("day").alias("ingest_date"), F.col("id").alias("cluster_id"),
        F.col("prior_day").alias("date"), F.col("prior_id").alias("prior_cluster_id"), "summary", "similarity")


def recent_headlines(editions: DataFrame, day: Column, days: int = C.CONTINUING_COVERAGE_DAYS) -> DataFrame:
    """Headlines of ``[day - days, day)``; fallbacks and blanks carry none."""
    text = strip(F.col("headline_of_the_day"))
    return editions.where(
        (F.col("date") >= F.date_sub(day, days)) & (F.col("date") < day) & (F.coalesce(text, F.lit("")) != "")
    ).select("date", text.alias("headline"), F.col("headline_cluster_id").alias("cluster_id"))


def headline_repeats(headlines: DataFrame, prior: DataFrame, coverage: DataFrame,
                     threshold: float = C.HEADLINE_REPEAT_THRESHOLD, days: int = C.CONTINUING_COVERAGE_DAYS) -> DataFrame:
    """Best match of each headline among the earlier ones it may repeat.

    `headlines(date, vector)`, `prior(date, headline, vector)` and
    `coverage(date, covered_day)`: only headlines of days the story was already
    covered on are compared, so a look-alike of another story never counts.
    Of equal scores the earliest date wins.
    """
    covered = coverage.select("date", F.col("covered_day").alias("prior_date")).distinct().where(
        (F.col("prior_date") >= F.date_sub("date", days)) & (F.col("prior_date") < F.col("date")))
    older = prior.select(F.col("date").alias("prior_date"), F.col("headline").alias("prior_headline"), F.col("vector").alias("_v"))
    scored = headlines.join(covered, "date").join(older, "prior_date").withColumn("similarity", dot(F.col("vector"), F.col("_v")))
    rank = F.struct("similarity", (-F.datediff("prior_date", F.lit("1970-01-01"))).alias("age"))
    best = scored.groupBy("date").agg(F.max_by(F.struct("prior_date", "prior_headline", "similarity"), rank).alias("b"))
    found = best.select("date", "b.*")
    return headlines.select("date").join(found, "date", "left").withColumn(
        "repeated", F.coalesce(F.col("similarity") >= threshold, F.lit(False)))
