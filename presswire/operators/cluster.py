"""Embedding, exact greedy clustering of any day size, and cluster rows."""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .. import constants as C
from ..functions.text import strip
from ..functions.urls import cluster_id
from ..functions.vectors import dot, norm, unit
from ..session import cut_lineage, scratch_path, written
from .blocks import BLOCK_ROWS, heads, matrices, matrix, pack_blocks, with_matrices, within_reach
from .graph import components, linked_groups, roots
from .ordering import first_rows


# --- embedding ----------------------------------------------------------------

def embed(df: DataFrame, text: str, make_model: Callable[[], Callable], out: str = "vector") -> DataFrame:
    """Unit vectors from a model. `make_model()` runs once per Python worker
    and returns ``model(list_of_texts) -> 2-D array``."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for texts in batches:
            raw = np.asarray(model(texts.tolist()), dtype=np.float64).reshape(len(texts), -1)
            length = np.linalg.norm(raw, axis=1, keepdims=True)
            yield pd.Series(list((raw / np.where(length == 0, 1, length)).astype(np.float32)))

    return df.withColumn(out, vectors(F.col(text)))


def hashed_vectors(df: DataFrame, text: str, dims: int = 256, out: str = "vector") -> DataFrame:
    """Unit term-count vectors over words hashed by MD5, without Python or a fit. A text
    without words has the zero vector."""
    words = F.filter(F.split(F.lower(strip(F.col(text))), r"(?U)\W+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dims)
    counts = _bound(F.coalesce(place, F.array().cast("array<bigint>")), lambda places: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double")))
    vector = _bound(counts, lambda c: _bound(norm(c), lambda length: F.transform(c, lambda x: F.when(length > 0, x / length).otherwise(x))))
    return df.withColumn(out, vector.cast("array<float>"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def embed_missing(items: DataFrame, cache: DataFrame, text: str, make_model: Callable[[], Callable],
                  model_version: str) -> tuple[DataFrame, DataFrame]:
    """``(all vectors, rows to append to the cache)``.

    The cache is keyed by item id and model version: a miss is computed as if
    there were no cache, and a vector of another version is never served.
    """
    known = first_rows(cache.where(F.col("model_version") == model_version), ["item_id"], [F.col("item_id")])
    known = known.select("item_id", "vector")
    wanted = items.select("item_id", text).dropDuplicates(["item_id"])
    missing = embed(wanted.join(known, "item_id", "left_anti"), text, make_model).select(
        "item_id", F.lit(model_version).alias("model_version"), "vector"
    )
    missing = cut_lineage(missing)  # read twice below; the model runs once
    hits = known.join(wanted.select("item_id"), "item_id", "left_semi")
    return hits.unionByName(missing.select("item_id", "vector")), missing


# --- exact greedy clustering ----------------------------------------------------

_DONE = "group_key string, item_id string, canonical_url string, seq long, seed_id string"
_STATE = "group_key string, seq long, seed_id string, n long, total array<double>"
_OUT = "kind string, " + _DONE + ", n long, total array<double>"
_ROUND = 10**9
MOST_ROUNDS = 8
PIECE_BYTES = 32 << 20  # of vectors in a task


def _assign(items: pd.DataFrame, state: pd.DataFrame, threshold: float, first_seq: int):
    """One pass over items in order, starting from the clusters given.

    An item joins the cluster that holds its URL, else the cluster of the best
    cosine at or above the threshold (of equals, the later one), else a new one.
    """
    items = items.sort_values(["published_at", "item_id"], kind="stable")
    vectors = np.array(items["vector"].tolist(), dtype=np.float64)
    dims = vectors.shape[1]
    state = state.sort_values("seq", kind="stable")
    k, size = len(state), len(state) + len(items)
    totals = np.zeros((size, dims))
    centers = np.zeros((size, dims))
    counts = np.zeros(size, dtype=np.int64)
    seqs, seeds = state["seq"].tolist(), state["seed_id"].tolist()
    if k:
        totals[:k] = np.array(state["total"].tolist())
        counts[:k] = state["n"].to_numpy()
        length = np.linalg.norm(totals[:k], axis=1, keepdims=True)
        centers[:k] = totals[:k] / np.where(length == 0, 1, length)
    at_seq = {seq: i for i, seq in enumerate(seqs)}
    by_url, touched, chosen = {}, set(), []
    urls = items["canonical_url"].tolist()
    known = items["known_seq"].tolist()
    ids = items["item_id"].tolist()
    for i in range(len(items)):
        v = vectors[i]
        home = at_seq[int(known[i])] if not pd.isna(known[i]) else by_url.get(urls[i])
        if home is None and k:
            scores = centers[:k] @ v
            best = k - 1 - int(np.argmax(scores[::-1]))
            if scores[best] >= threshold:
                home = best
        if home is None:
            home = k
            seqs.append(first_seq + len(seqs))
            seeds.append(ids[i])
            k += 1
        if urls[i] is not None:
            by_url.setdefault(urls[i], home)
        totals[home] += v
        counts[home] += 1
        length = np.linalg.norm(totals[home])
        centers[home] = totals[home] / length if length else 0.0
        touched.add(home)
        chosen.append(home)
    done = pd.DataFrame({
        "kind": "item", "item_id": ids, "canonical_url": urls,
        "seq": [seqs[h] for h in chosen], "seed_id": [seeds[h] for h in chosen],
    })
    changed = sorted(touched)
    moved = pd.DataFrame({
        "kind": "cluster", "seq": [seqs[h] for h in changed], "seed_id": [seeds[h] for h in changed],
        "n": counts[changed], "total": [totals[h] for h in changed],
    })
    return pd.concat([done, moved], ignore_index=True)


def _shape(out: pd.DataFrame, group) -> pd.DataFrame:
    """Both kinds of row under one schema, with None where a column is unused."""
    out = out.reindex(columns=["kind", "item_id", "canonical_url", "seq", "seed_id", "n", "total"])
    out.insert(1, "group_key", group)
    out["n"] = out["n"].astype("Int64")
    for column in ("item_id", "canonical_url", "total"):
        values = out[column].astype(object)
        out[column] = values.where(values.notna(), None)
    return out


def reachable_parts(rows: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(id, component)`` of the vectors ``(day, id long, vector)`` of a day that are
    linked, over any number of steps, by a cosine of threshold^2 or more.

    No greedy cluster crosses such parts. An item joins where its mean dot with the
    members is at least t times the length of their mean; as every earlier member
    did so too, that length is at least t, so some member has a dot of t^2 or more.

    Each block is first joined up by itself into groups of linked rows. Blocks near enough
    then compare one row each, of their largest groups; where those groups are connected
    already, over any number of blocks, their rows never meet. Only what is left of
    two blocks is compared, once, and gives links of groups, not of rows.
    """
    least = threshold * threshold - 1e-5  # vectors are stored in single precision

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                a = matrix(row.matrix, row.dims)
                group = linked_groups(a @ a.T >= least)
                ids = np.asarray(row.ids, dtype=np.int64)
                names = np.full(group.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(names, group, ids)
                main = int(np.bincount(group).argmax())
                # the row of the largest group that is nearest to the block's center
                place = np.flatnonzero(group == main)
                shown = place[int((a[place] @ np.asarray(row.center)).argmax())]
                out.append((row.day, row.block, ids, row.matrix, row.dims, row.center, row.radius, group, names, main, names[main], a[shown], len(names) == 1))
            yield pd.DataFrame(out, columns=["day", "block", "ids", "matrix", "dims", "center", "radius", "groups", "names", "main", "top", "shown", "whole"])

    packed = pack_blocks(rows, block_rows)
    schema = ", ".join(f"{name} {kind}" for name, kind in packed.dtypes) + ", groups array<int>, names array<long>, main int, top long, shown array<double>, whole boolean"
    blocks = written(packed.mapInPandas(grouped, schema), "blocks")

    more = ("top", "shown", "whole")
    near = heads(blocks, more=more).join(heads(blocks, "r_", more).withColumn("day", F.col("r_day")), "day").where(F.col("block") < F.col("r_block")).where(within_reach(least))
    near = written(near.select("day", "block", "r_day", "r_block", "top", "r_top", (F.col("whole") & F.col("r_whole")).alias("whole"),
                               (dot(F.col("shown"), F.col("r_shown")) >= least).alias("linked")), "pairs")
    shown_links = near.where("linked").select(F.col("top").alias("a"), F.col("r_top").alias("b"))
    known = written(components(shown_links), "links")
    ours, theirs = (known.select(F.col("id").alias(name), F.col("component").alias(f"{name}_part")) for name in ("top", "r_top"))
    same = F.coalesce(F.col("top_part") == F.col("r_top_part"), F.lit(False))
    left = near.join(ours, "top", "left").join(theirs, "r_top", "left").withColumn("same", same).where("not (whole and same)")

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                a, b = matrices(row)
                groups, r_groups = np.asarray(row.groups), np.asarray(row.r_groups)
                names = np.concatenate([row.names, row.r_names])
                # rows of two groups that are connected already need no comparing
                rest, r_rest = (groups != row.main, r_groups != row.r_main) if row.same else (np.ones(len(a), bool), np.zeros(len(b), bool))
                ends = [_linked_pairs(a[i], b[j], groups[i], r_groups[j], least) for i, j in ((rest, np.ones(len(b), bool)), (~rest, r_rest))]
                i, j = (np.concatenate(side) for side in zip(*ends))
                root = roots(i, len(row.names) + j, len(names))
                moved = root != np.arange(len(names))
                if moved.any():
                    yield pd.DataFrame({"a": names[moved], "b": names[root[moved]]})

    met = with_matrices(left, blocks, blocks, ("groups", "names", "main"), ("same",)).mapInPandas(connect, "a long, b long")
    parts = components(shown_links.unionByName(met))
    each = blocks.select(F.explode(F.arrays_zip("ids", F.transform("groups", lambda g: F.get("names", g)).alias("name"))).alias("r")).select(
        F.col("r.ids").alias("id"), F.col("r.name").alias("_name"))
    joined = each.join(parts.withColumnRenamed("id", "_name"), "_name", "left")
    return joined.select("id", F.coalesce("component", "_name").alias("component"))


def _linked_pairs(a: np.ndarray, b: np.ndarray, groups: np.ndarray, r_groups: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of groups of which some two rows are linked."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = a @ b.T >= least
    for axis, of in ((0, groups), (1, r_groups)):
        order = np.argsort(of, kind="stable")
        starts = np.flatnonzero(np.diff(of[order], prepend=-1))
        near = np.logical_or.reduceat(np.take(near, order, axis=axis), starts, axis=axis)
    i, j = np.nonzero(near)
    return np.unique(groups)[i].astype(np.int64), np.unique(r_groups)[j].astype(np.int64)


def greedy_clusters(items: DataFrame, threshold: float = C.CLUSTER_THRESHOLD, group: str = "ingest_date",
                    piece: int = 10_000) -> DataFrame:
    """``(group, item_id, seed_id, cluster_id)`` of the sequential greedy pass.

    `items` has the group, item_id, canonical_url, published_at and a unit
    vector. The pass is defined item by item. A group of up to `piece` items,
    which is the normal day, is one task. A larger one falls into parts that no
    cluster crosses (see reachable_parts), and every part runs by itself, small
    ones several to a task. Only where a URL comes twice in such a group, so that
    items join whatever their vectors are, or where a part is itself larger than
    `piece`, is the group, or that part of it, walked in rounds (see _walked).
    """
    base = items.select(F.col(group).cast("string").alias("group_key"), "item_id", "canonical_url", "published_at", "vector",
                        F.monotonically_increasing_id().alias("id"))
    base = written(base, "items")
    sizes = written(base.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")), "items")
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    normal = base.join(sizes.where(F.col("n") <= piece).select("group_key"), "group_key", "left_semi")
    found = [_by_part(normal.withColumn("part", F.lit(0).cast("long")), threshold, F.col("group_key"))]
    if (most or 0) > piece:
        large = base.join(sizes.where(F.col("n") > piece).select("group_key"), "group_key", "left_semi")
        forced = large.where("canonical_url is not null").groupBy("group_key", "canonical_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_key")
        if threshold > 0:
            free = large.join(forced.distinct(), "group_key", "left_anti")
            linked = reachable_parts(free.select(F.col("group_key").alias("day"), "id", "vector"), threshold).withColumnRenamed("component", "part")
            parted = written(free.join(linked, "id", "left").withColumn("part", F.coalesce("part", "id")), "items")
            part_sizes = written(parted.groupBy("group_key", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "items")
            sized = parted.join(part_sizes.select("group_key", "part", F.lit(True).alias("shared"), (F.col("n") > piece).alias("crowded")), ["group_key", "part"], "left")
            small = sized.where("not coalesce(crowded, false)").drop("crowded")
            # a part of one item is a cluster of its own
            found.append(small.where("shared is null").select("group_key", "item_id", F.col("item_id").alias("seed_id")))
            found.append(_by_part(small.where("shared").drop("shared"), threshold, F.pmod(F.xxhash64("part"), F.lit(max(1, total // piece))).cast("string")))
            # a crowded part is walked by itself, beside the others
            walked = large.join(forced.distinct(), "group_key", "left_semi").withColumn("part", F.lit(0).cast("long")).unionByName(
                sized.where("crowded").select(*large.columns, "part"))
        else:
            walked = large.withColumn("part", F.lit(0).cast("long"))
        walked = written(walked.withColumn("group_key", F.concat_ws("/", "part", "group_key")).drop("id", "part"), "items")
        if not walked.isEmpty():
            found.append(_walked(walked, threshold, piece).withColumn("group_key", F.regexp_replace("group_key", "^[0-9]+/", "")))
    done = reduce(DataFrame.unionByName, found)
    kind = dict(items.dtypes)[group]
    return done.select(F.col("group_key").cast(kind).alias(group), "item_id", "seed_id", cluster_id(F.col("seed_id")).alias("cluster_id"))


def _by_part(rows: DataFrame, threshold: float, together: Column) -> DataFrame:
    """The pass over every (group, part) from its first item; parts of one `together` share a task."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (group, _), part in batch.groupby(["group_key", "part"], dropna=False, sort=False):
            done = _assign(part.assign(known_seq=None), _empty_state(), threshold, 0)
            done = done[done["kind"] == "item"]
            out.append(pd.DataFrame({"group_key": group, "item_id": done["item_id"], "seed_id": done["seed_id"]}))
        return pd.concat(out, ignore_index=True)

    return rows.withColumn("together", together).groupBy("together").applyInPandas(run, "group_key string, item_id string, seed_id string")


def _walked(base: DataFrame, threshold: float, piece: int) -> DataFrame:
    """Each group in consecutive pieces; piece r of all groups runs in round r, in
    parallel, and sees only those earlier clusters that some item of the piece can
    reach. That is exact: a cluster no item of the piece is within the threshold of
    cannot gain its first new member, so it stays as it is for the whole piece. No
    task holds more than a piece and the clusters near it.

    A round costs the driver the same whatever was done before, and their number is
    held down: a piece is an eighth of the largest group where that is more than
    `piece` items, as far as a task can hold their vectors.
    """
    spark = base.sparkSession
    sizes = written(base.groupBy("group_key").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    total, most = sizes.agg(F.sum("_size"), F.max("_size")).first()
    dims = base.select(F.size("vector")).first()[0]
    width = max(piece, min(-(-most // MOST_ROUNDS), PIECE_BYTES // (8 * max(1, dims))))
    # only a URL that comes twice is ever looked up
    twice = base.where("canonical_url is not null").groupBy("group_key", "canonical_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = written(twice.select("group_key", "canonical_url", F.lit(True).alias("twice")), "urls")
    if twice.isEmpty():
        named = base.withColumn("canonical_url", F.lit(None).cast("string"))
    else:
        named = base.join(twice, ["group_key", "canonical_url"], "left").withColumn("canonical_url", F.when(F.col("twice"), F.col("canonical_url"))).drop("twice")
    # ranges over the full order split a hot instant as well as a hot day
    ranged = named.repartitionByRange(-(-total // width), "group_key", "published_at", "item_id").withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "pieces")
    firsts = ranged.groupBy("group_key").agg(F.min("_part").alias("_first")).join(sizes, "group_key")
    rounds = F.when(F.col("_size") <= piece, 0).otherwise(F.col("_part") - F.col("_first"))
    staged = written(ranged.join(firsts, "group_key").withColumn("_round", rounds).drop("_part", "_size", "_first"), "pieces", by="_round")
    last = staged.agg(F.max("_round")).first()[0] or 0

    def first_piece(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _shape(_assign(rows.assign(known_seq=None), _empty_state(), threshold, 0), key[0])

    opening = staged.where(F.col("_round") == 0).drop("_round").groupBy("group_key").applyInPandas(first_piece, _OUT)
    # every round writes beside the earlier ones, so that what is done is one scan
    place = scratch_path(spark, "rounds")

    def done() -> DataFrame:
        return spark.read.schema(f"{_OUT}, round int").parquet(place)

    opening.write.parquet(f"{place}/round=0")
    state = _state_of(done())
    for r in range(1, last + 1):
        rows = staged.where(F.col("_round") == r).drop("_round")
        _next_piece(rows, _items_of(done()), state, threshold, r, width).write.parquet(f"{place}/round={r}")
        moved = _state_of(done().where(F.col("round") == r))
        if r < last:
            state = written(state.join(moved, ["group_key", "seq"], "left_anti").unionByName(moved), "state")
    return _items_of(done()).select("group_key", "item_id", "seed_id")


def _empty_state() -> pd.DataFrame:
    return pd.DataFrame({"seq": pd.Series(dtype="int64"), "seed_id": [], "n": pd.Series(dtype="int64"), "total": []})


def _items_of(out: DataFrame) -> DataFrame:
    return out.where("kind = 'item'").select("group_key", "item_id", "canonical_url", "seq", "seed_id")


def _state_of(out: DataFrame) -> DataFrame:
    return out.where("kind = 'cluster'").select("group_key", "seq", "seed_id", "n", "total")


def _next_piece(rows: DataFrame, done: DataFrame, state: DataFrame, threshold: float, r: int, piece: int) -> DataFrame:
    urls = done.where("canonical_url is not null").groupBy("group_key", "canonical_url").agg(F.min("seq").alias("known_seq"))
    rows = rows.join(urls, ["group_key", "canonical_url"], "left")

    # clusters of a group in slices of about `piece`; the piece goes to each slice
    active = state.join(rows.select("group_key").distinct(), "group_key", "left_semi")
    slices = active.groupBy("group_key").agg(F.ceil(F.count(F.lit(1)) / piece).alias("_slices"))
    sliced = active.join(slices, "group_key").withColumn("_slice", F.pmod(F.xxhash64("seq"), F.col("_slices"))).drop("_slices")
    spread = rows.join(slices, "group_key").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    ).select("group_key", "_slice", "vector")

    def reachable(key, clusters: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(clusters), dtype=bool)
        if len(clusters) and len(asked):
            centers = np.array(clusters["total"].tolist())
            length = np.linalg.norm(centers, axis=1, keepdims=True)
            centers = centers / np.where(length == 0, 1, length)
            vectors = np.array(asked["vector"].tolist(), dtype=np.float64)
            for start in range(0, len(vectors), 512):
                hit |= (centers @ vectors[start:start + 512].T).max(axis=1) >= threshold - 1e-9
        return pd.DataFrame({"group_key": key[0], "seq": clusters["seq"][hit]})

    near = sliced.groupBy("group_key", "_slice").cogroup(spread.groupBy("group_key", "_slice")).applyInPandas(
        reachable, "group_key string, seq long")
    linked = rows.where(F.col("known_seq").isNotNull()).select("group_key", F.col("known_seq").alias("seq"))
    wanted = near.unionByName(linked).distinct()
    relevant = active.join(wanted, ["group_key", "seq"], "left_semi")

    def run(key, piece_rows: pd.DataFrame, clusters: pd.DataFrame) -> pd.DataFrame:
        if not len(piece_rows):
            return _shape(pd.DataFrame({"kind": [], "seq": [], "seed_id": []}), key[0])
        return _shape(_assign(piece_rows, clusters, threshold, r * _ROUND), key[0])

    return rows.groupBy("group_key").cogroup(relevant.groupBy("group_key")).applyInPandas(run, _OUT)


# --- centroids and cluster rows -------------------------------------------------

def centroids(members: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Normalised mean vector per key, zero-safe, summed map-side."""
    parts = members.select(*keys, F.posexplode(vector).alias("_i", "_x"))
    sums = parts.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    # one row per dimension: the list is as long as the vector, not the group
    mean = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"])
    return sums.groupBy(*keys).agg(mean.alias("_mean")).select(*keys, unit(F.col("_mean")).alias("centroid"))


def cluster_rows(members: DataFrame) -> DataFrame:
    """Seed title and summary, member count and sorted sources per cluster.

    Everything is aggregated before the shuffle; `sources` is as long as the
    source registry at most. `with_member_ids` adds the id list.
    """
    seed = F.min_by(
        F.struct("item_id", "title", "body_excerpt"), F.struct("published_at", "item_id")
    )
    return members.groupBy("ingest_date", "cluster_id").agg(
        seed.alias("_seed"),
        F.count(F.lit(1)).alias("member_count"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    ).select(
        "cluster_id", "ingest_date",
        F.col("_seed.title").alias("headline"),
        strip(F.substring("_seed.body_excerpt", 1, C.SUMMARY_SEED_CHARS)).alias("summary_seed"),
        F.col("member_count").cast("int").alias("member_count"),
        "sources",
    )


def with_member_ids(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The stored row form, whose sorted id list is one value by its schema."""
    ids = members.groupBy("ingest_date", "cluster_id").agg(F.array_sort(F.collect_list("item_id")).alias("member_ids"))
    return rows.join(ids, ["ingest_date", "cluster_id"])


def largest_clusters(rows: DataFrame, n: int = 15) -> DataFrame:
    return rows.orderBy(F.desc("member_count"), "cluster_id").limit(n)
