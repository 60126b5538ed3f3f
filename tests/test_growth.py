"""What grows with the square of a table, or with rounds, is held down."""

import os
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire import session
from presswire.operators import cluster, jobs
from presswire.sources import tables
from tests.test_cluster import SCHEMA, loop, make
from tests.test_jobs import NOW, landed


def parts_of(rows, threshold):
    """The smallest id connected to each, by all pairs."""
    v = np.array([r[2] for r in rows], dtype=np.float32).astype(np.float64)
    near, name = v @ v.T >= threshold * threshold - 1e-5, np.arange(len(v))
    for _ in range(len(v)):
        name = np.array([min(name[near[i]].min(initial=name[i]), name[i]) for i in range(len(v))])
    return {rows[i][1]: rows[name[i]][1] for i in range(len(v))}


def found_parts(spark, rows, threshold, block_rows):
    found = cluster.reachable_parts(spark.createDataFrame(rows, "day string, id long, vector array<double>"), threshold, block_rows).collect()
    got = {r.id: r.component for r in found}
    assert len(got) == len(found)
    return {i: got.get(i, i) for _, i, _ in rows}


@pytest.mark.parametrize("dims,noise,threshold", [(3, 0.25, 0.97), (8, 0.4, 0.93)])
def test_parts_of_blocks_equal_those_of_all_pairs(spark, dims, noise, threshold):
    rng = np.random.default_rng(31)
    base = rng.standard_normal((12, dims))
    rows = []
    for i in range(150):
        v = base[rng.integers(12)] + noise * rng.standard_normal(dims)
        rows.append(("d", int(1000 - i), (v / np.linalg.norm(v) * (i % 40 > 0)).tolist()))
    want = parts_of(sorted(rows, key=lambda r: r[1]), threshold)
    assert 5 < len(set(want.values())) < 150
    assert found_parts(spark, rows, threshold, 12) == want


def test_blocks_of_one_part_are_not_compared_row_by_row(spark, monkeypatch):
    """Blocks that hold copies of three vectors: no matrix is fetched a second time."""
    met = []
    real = cluster.with_matrices

    def watched(pairs, *args, **kwargs):
        met.append(pairs.count())
        return real(pairs, *args, **kwargs)

    monkeypatch.setattr(cluster, "with_matrices", watched)
    rows = [("d", i, [float(i % 3 == k) for k in range(3)]) for i in range(120)]
    assert found_parts(spark, rows, 0.8, 5) == {i: i % 3 for i in range(120)}
    assert met == [0]


def test_a_crowded_part_is_walked_in_few_rounds(spark, monkeypatch):
    """90 items at five to a task's share took 18 rounds, each planned over all earlier ones."""
    rounds = []
    real = cluster._next_piece

    def watched(rows, done, state, *args):
        rounds.append(len(done._jdf.queryExecution().analyzed().toString()) + len(state._jdf.queryExecution().analyzed().toString()))
        return real(rows, done, state, *args)

    monkeypatch.setattr(cluster, "_next_piece", watched)
    rows = make(90, 4, 2, 0.2, 41)
    got = {r.item_id: r.seed_id for r in cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), 0.8, piece=5).collect()}
    assert got == loop(rows, 0.8)
    assert 0 < len(rounds) <= 9 and max(rounds) < 1.5 * rounds[0]


def wide_shuffles(spark, df):
    """Exchanges of a frame's plan that carry titles."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x]


@pytest.mark.parametrize("listed", [200_000, 2])
def test_new_rows_are_found_by_their_keys(spark, monkeypatch, listed):
    """Stored keys, a key twice, one stored under another day and keys that are null, with and without lists of keys."""
    monkeypatch.setattr(tables, "LISTED_KEYS", listed)
    schema = "item_id string, ingest_date date, position int, title string"
    day, other = date(2024, 1, 1), date(2024, 1, 2)
    batch = spark.createDataFrame([("a", day, 1, "a1"), ("b", day, 5, "b5"), ("b", other, 2, "b2"), ("c", day, 3, "c"), ("d", day, 4, "d"), ("e", other, 6, "e"),
                                   (None, day, 9, "n9"), (None, day, 8, "n8"), ("f", day, 7, "f")], schema)
    stored = spark.createDataFrame([("c", day), ("d", other), ("e", date(2024, 1, 3)), (None, day)], "item_id string, ingest_date date")
    got = tables.new_rows(batch, stored, position="position").collect()
    assert sorted(r.title for r in got) == ["a1", "b2", "e", "f", "n8"]
    assert tables.new_rows(batch, batch.select("item_id", "ingest_date"), position="position").select("title").collect() == [("n8",)]


def test_whole_rows_are_not_shuffled_for_their_keys(spark):
    batch = spark.range(0, 50).select(F.col("id").cast("string").alias("item_id"), F.lit(date(2024, 1, 1)).alias("ingest_date"), F.col("id").alias("position"), F.lit("t").alias("title"))
    none = batch.where("position < 0").select("item_id", "ingest_date")
    for stored, n in ((none, 50), (batch.select("item_id", "ingest_date"), 0), (batch.where("position < 7").select("item_id", "ingest_date"), 43)):
        new = tables.new_rows(batch, stored, position="position")
        assert wide_shuffles(spark, new) == [] and new.count() == n


def test_collection_leaves_no_scratch_behind(spark, tmp_path, monkeypatch):
    made = []
    real = session.scratch_path

    def watched(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(session, "scratch_path", watched)
    registry = [landed(tmp_path, "a", ["Rates rise", "Storm"])]
    run = jobs.collect_job(spark, registry, str(tmp_path / "items"), str(tmp_path / "log"), now=NOW)
    assert run.items_out == 2 and len(made) >= 4
    assert not [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert spark.conf.get(session._SHUFFLE_CLEANUP, "false") == "false"
