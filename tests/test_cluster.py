"""Greedy clustering against the item-by-item loop, and its helpers."""

import hashlib
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.operators import cluster, graph

SCHEMA = "ingest_date date, item_id string, canonical_url string, published_at timestamp, vector array<double>"


def loop(items, threshold):
    """The definition: one item at a time, centroids recomputed each time."""
    clusters = []
    for item in sorted(items, key=lambda r: (r[3], r[1])):
        v = np.array(item[4])
        home = next((c for c in clusters if item[2] in c["urls"]), None)
        if home is None:
            best = threshold
            for c in clusters:
                mean = np.mean(c["vectors"], axis=0)
                length = np.linalg.norm(mean)
                score = float(v @ (mean / length if length else mean))
                if score >= best:
                    home, best = c, score
        if home is None:
            home = {"seed": item[1], "urls": set(), "vectors": []}
            clusters.append(home)
        home["urls"].add(item[2])
        home["vectors"].append(v)
        home.setdefault("ids", []).append(item[1])
    return {i: c["seed"] for c in clusters for i in c["ids"]}


def make(n, dims, centers, noise, seed, days=1, repeat_urls=False):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centers, dims))
    rows = []
    for i in range(n):
        v = base[rng.integers(centers)] + noise * rng.standard_normal(dims)
        v /= np.linalg.norm(v)
        url = f"u{rng.integers(n // 2)}" if repeat_urls else f"u{i}"
        rows.append((date(2024, 1, 1 + i % days), hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), url,
                     datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(n))), v.tolist()))
    return rows


@pytest.mark.parametrize("piece,noise,threshold,urls", [(10_000, 0.6, 0.6, False), (25, 0.6, 0.6, False), (20, 1.0, 0.45, False), (25, 0.8, 0.6, True)])
def test_matches_the_loop(spark, piece, noise, threshold, urls):
    rows = make(160, 8, 12, noise, 3, days=2, repeat_urls=urls)
    out = cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), threshold, piece=piece).collect()
    got = {r.item_id: r.seed_id for r in out}
    want = {}
    for day in {r[0] for r in rows}:
        want |= loop([r for r in rows if r[0] == day], threshold)
    assert got == want
    assert all(r.cluster_id == hashlib.sha256(r.seed_id.encode()).hexdigest()[:32] for r in out)


def test_parts_match_the_loop_on_random_days(spark, monkeypatch):
    """400 days too large for a task, each in parts that no cluster crosses; no rounds."""
    monkeypatch.setattr(cluster, "_walked", None)
    rng = np.random.default_rng(11)
    rows = []
    for n in range(400):
        centers = rng.standard_normal((6, 5))
        for i in range(12):
            v = centers[rng.integers(6)] + rng.choice([0.2, 0.5]) * rng.standard_normal(5)
            v = (v / np.linalg.norm(v)).astype(np.float32).astype(float)
            rows.append((date(2020, 1, 1) + timedelta(days=n), f"{n}-{rng.integers(10**9)}", f"u{n}-{i}", datetime(2024, 1, 1, 0, int(rng.integers(30))), v.tolist()))
    want = {}
    for n in range(400):
        want |= loop(rows[12 * n:12 * n + 12], 0.9)
    out = cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), 0.9, piece=11)
    assert {r.item_id: r.seed_id for r in out.collect()} == want
    assert len(set(want.values())) < len(want)


def test_parts_and_urls_and_a_crowded_part(spark):
    """A day in parts, a day with a URL twice, and one whose part is larger than a task's share."""
    free = make(60, 8, 25, 0.2, 21)
    urls = [(date(2024, 1, 2), f"b{r[1]}", "same" if i in (3, 40) else r[2], *r[3:]) for i, r in enumerate(make(50, 8, 20, 0.2, 22))]
    crowd = [(date(2024, 1, 3), f"c{r[1]}", *r[2:]) for r in make(50, 4, 2, 0.2, 23)]
    got = {r.item_id: r.seed_id for r in cluster.greedy_clusters(spark.createDataFrame(free + urls + crowd, SCHEMA), 0.8, piece=20).collect()}
    assert got == loop(free, 0.8) | loop(urls, 0.8) | loop(crowd, 0.8)


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components(spark, one_task):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (7, 7)]
    names = {}
    for a, b in links:
        if a != b:
            names.setdefault(a, a), names.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            if a != b:
                names[a] = names[b] = min(names[a], names[b])
    found = graph.components(spark.createDataFrame(links, "a long, b long"), one_task).collect()
    assert len(found) == len(names) and {r.id: r.component for r in found} == names
    assert graph.components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def angle(degrees):
    return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]


def two(spark, degrees, **same):
    at = datetime(2024, 1, 1)
    rows = [(date(2024, 1, 1), "a", "u1", at, angle(0)), (date(2024, 1, 1), "b", same.get("url", "u2"), at, angle(degrees))]
    return {r.item_id: r.seed_id for r in cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), 0.82).collect()}


def test_near_vectors_join_and_far_ones_do_not(spark):
    assert two(spark, 30) == {"a": "a", "b": "a"}
    assert two(spark, 45) == {"a": "a", "b": "b"}
    assert two(spark, 90, url="u1") == {"a": "a", "b": "a"}


def test_one_hot_group_of_copies(spark):
    """A third of all items are copies of one vector."""
    rows = make(90, 6, 30, 0.4, 5)
    rows += [(date(2024, 1, 1), f"copy{i:03}", f"c{i}", datetime(2024, 1, 1, 0, i % 60), rows[0][4]) for i in range(45)]
    out = cluster.greedy_clusters(spark.createDataFrame(rows, SCHEMA), 0.8, piece=30).collect()
    assert {r.item_id: r.seed_id for r in out} == loop(rows, 0.8)


def test_centroid_is_a_unit_mean_and_zero_safe(spark):
    rows = [("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("z", [1.0, 0.0]), ("z", [-1.0, 0.0])]
    got = {r.k: r.centroid for r in cluster.centroids(spark.createDataFrame(rows, "k string, vector array<double>"), ["k"]).collect()}
    assert got["x"] == pytest.approx([2**-0.5, 2**-0.5])
    assert got["z"] == [0.0, 0.0]


def test_embed_gives_unit_vectors(spark):
    def make_model():
        return lambda texts: [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), ("",)], "t string")
    got = [r.vector for r in cluster.embed(df, "t", make_model).orderBy(F.length("t")).collect()]
    assert got[0] == pytest.approx([0.0, 1.0]) and np.linalg.norm(got[1]) == pytest.approx(1.0)


def test_cache_never_serves_another_version(spark):
    items = spark.createDataFrame([("a", "xx"), ("b", "yyyy")], "item_id string, text string")
    cache = spark.createDataFrame([("a", "old", [9.0, 9.0])], "item_id string, model_version string, vector array<float>")

    def make_model():
        return lambda texts: [[1.0, 0.0] for _ in texts]

    vectors, added = cluster.embed_missing(items, cache, "text", make_model, "new")
    assert {r.item_id: r.vector for r in vectors.collect()} == {"a": [1.0, 0.0], "b": [1.0, 0.0]}
    assert added.count() == 2


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "One two, two"), (2, ""), (3, None)], "n int, t string")
    got = {r.n: r.vector for r in cluster.hashed_vectors(rows, "t", 16).collect()}
    want = np.zeros(16)
    for w in ("one", "two", "two"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
    assert got[1] == pytest.approx(want / np.linalg.norm(want)) and got[2] == got[3] == [0.0] * 16
