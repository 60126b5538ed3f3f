"""What a task holds and what is written stays in proportion on larger tables."""

import glob
from datetime import date

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from presswire.operators import cluster, items, ordering
from presswire.plans import item_queries, job_queries
from presswire.session import configure
from tests.test_cluster import SCHEMA, loop, make


def test_a_source_within_its_number_is_not_sorted(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.col("id").alias("position"),
                                    F.lit("2024-01-02").cast("timestamp").alias("published_at"))
    since = F.lit("2024-01-01").cast("timestamp")
    kept = items.since_and_cap(rows, since, {"a": 10**9, "b": 10**9})
    assert "Window" not in kept._jdf.queryExecution().toString()
    assert kept.count() == 3000
    cut = items.since_and_cap(rows, since, {"a": 10**9, "b": 1500}).collect()
    assert sorted(r.position for r in cut) == sorted([i for i in range(3000) if i % 3 == 0] + [i for i in range(3000) if i % 3][:1500])


def test_a_large_number_of_first_rows_is_ranked_in_ranges(spark):
    rows = spark.range(0, 6000, 1, 8).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).alias("v"), "id")
    got = ordering.first_rows(rows, ["k"], [F.desc("v")], 2500, rank="place", spread="id")
    assert "PARTITION BY k ORDER" not in got._jdf.queryExecution().toString().replace("#", " ")
    assert "specifiedwindowframe" in got._jdf.queryExecution().toString()
    for k in (0, 1):
        want = sorted((-(i % 7), i) for i in range(6000) if i % 2 == k)[:2500]
        assert [(-r.v, r.id) for r in got.where(F.col("k") == k).orderBy("place").collect()] == want
        assert [r.place for r in got.where(F.col("k") == k).orderBy("place").collect()] == list(range(1, 2501))


def test_batches_to_python_are_bounded_by_bytes(spark):
    @F.pandas_udf(LongType())
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    sizes = configure(spark).range(0, 600, 1, 1).select(batch_bytes(F.repeat(F.lit("x"), 100_000)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 10 << 20


def test_landed_entries_are_not_led_through_one_task(spark, sf, monkeypatch):
    def refused(*_):
        raise AssertionError("all entries in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    got = {(r.source, r.reason): r["items"] for r in item_queries.QUERIES["stream_rejects"](spark, sf).collect()}
    assert got


def test_landed_payloads_are_shuffled_once_and_packed(spark, sf):
    registry = job_queries._landed(spark, sf)
    for source in registry[:2]:
        files = glob.glob(f"{source['path'].removeprefix('file:')}/**/*.txt*", recursive=True)
        assert files and all(f.endswith(".gz") for f in files)


def test_only_a_crowded_part_is_walked(spark, monkeypatch):
    """A day of many parts, one larger than a task's share: the others need no rounds."""
    walked = []
    real = cluster._walked

    def watched(rows, *args):
        walked.append(rows.count())
        return real(rows, *args)

    monkeypatch.setattr(cluster, "_walked", watched)
    day = make(60, 8, 25, 0.2, 21)
    zero = [0.0] * 8
    rows = [(d, i, u, at, v + zero) for d, i, u, at, v in day]
    # 50 items in directions of their own, all linked
    rows += [(date(2024, 1, 1), f"c{i}", f"c{u}", at, zero + v) for _, i, u, at, v in make(50, 8, 1, 0.1, 23)]
    got = {r.item_id: r.seed_id for r in cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), 0.8, piece=20).collect()}
    assert got == loop(rows, 0.8)
    assert walked == [50]


def test_walked_pieces_look_up_repeated_urls_only(spark, monkeypatch):
    looked = []
    real = cluster._next_piece

    def watched(rows, done, *args):
        looked.append(done.where("canonical_url is not null").count())
        return real(rows, done, *args)

    monkeypatch.setattr(cluster, "_next_piece", watched)
    rows = [(date(2024, 1, 1), i, "same" if n in (3, 90) else u, at, v) for n, (_, i, u, at, v) in enumerate(make(100, 4, 2, 0.2, 23))]
    got = {r.item_id: r.seed_id for r in cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), 0.8, piece=20).collect()}
    assert got == loop(rows, 0.8)
    assert looked and max(looked) <= 2
