"""Near-duplicate embeddings by lattice hashing: E8 cells of random projections."""

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, written
from .jaccard import roots

TABLES = 12
PROBES = 16   # neighbouring cells looked at, of 240
SCALE = 3.6   # length of a unit vector after projection; cells have volume 1
BLOCK = 512   # rows compared with each other at once


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: to all neighbouring lattice points."""
    whole = np.zeros((112, 8))
    for row, ((i, j), (a, b)) in enumerate(product(combinations(range(8), 2), product((-1, 1), repeat=2))):
        whole[row, i], whole[row, j] = a, b
    half = np.array([s for s in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: even whole points, or such points moved by a half."""
    first, second = _even(x), _even(x - 0.5) + 0.5
    closer = ((x - second) ** 2).sum(axis=1) < ((x - first) ** 2).sum(axis=1)
    return np.where(closer[:, None], second, first)


def cell_numbers(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(points.shape[:-1], table + 1, np.uint64)
    for i in range(8):
        h = (h ^ (2 * points[..., i]).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 20240101) -> np.ndarray:
    """Cell numbers, rows x tables x (1 + probes): the own cell, then the nearest neighbours."""
    steps = shortest_vectors()
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        draw = np.random.default_rng([seed, t, unit.shape[1]])
        x = unit @ draw.normal(size=(unit.shape[1], 8)) * (scale / np.sqrt(8)) + draw.uniform(0, 1, 8)
        home = decode(x)
        near = np.argsort(-((x - home) @ steps.T), axis=1, kind="stable")[:, :probes]
        out[:, t] = cell_numbers(np.concatenate([home[:, None], home[:, None] + steps[near]], axis=1), t)
    return out


def _units(vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, unit vectors) of the usable vectors, once per vector length."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        found = values[ends[at][:, None] + np.arange(size)].astype(np.float64)
        found /= np.abs(found).max(axis=1, keepdims=True)
        yield at, found / np.linalg.norm(found, axis=1, keepdims=True)


def links(embeddings: DataFrame, threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Link embeddings (vec_id, embedding) whose cosine is at least the threshold.

    Equal arrays are one class. A class is projected at random to eight
    dimensions in several tables, put in the cell of the nearest E8 point, and
    also looks into the neighbouring cells nearest to it. Those that meet in a
    cell are compared by exact cosine in double precision, blocks of a crowded
    cell two by two in tasks of their own. A pair at home in one cell is taken in
    the first such cell alone and only counted; the other links of a class, which
    several tables may find, are returned as one list a block. Pairs are never rows.

    Returns one row per row of embeddings: (vec_id, n_links, component_id, kept):
    n_links counts other rows linked directly, copies included; component_id is
    the smallest vec_id reachable; kept whether that is the row's own. Vectors
    that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths link. A row without vec_id
    counts as a link but names no component; alone it is kept. Repeated rows are copies.
    Other columns are ignored. Classes have 64-bit numbers.
    """
    rows = embeddings.select("vec_id", F.col("embedding").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.col("v")))
    rows = written(rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "vectors")
    classes = written(rows.where("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"), F.first("v").alias("v")), "vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for at, units in _units(batch.column("v")):
                found = cells(units, tables, probes) ^ units.shape[1]
                ends = pa.array(np.arange(len(at) + 1) * found[0].size, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["node", "cells"])

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        node, copies, block, cell, home = (rows[c].to_numpy() for c in ("node", "copies", "block", "cell", "home"))
        homes = rows["homes"].combine_chunks().flatten().to_numpy().reshape(len(node), tables)
        left, right, once = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for at, units in _units(rows["v"]):
            ours, theirs = np.flatnonzero(block[at] == first), np.flatnonzero(block[at] == second)
            for start in range(0, len(theirs), BLOCK):
                part = theirs[start:start + BLOCK]
                i, j = at[ours][:, None], at[part][None, :]
                hit = (units[ours] @ units[part].T) >= threshold
                hit &= (cell[i] == cell[j]) & (home[i] | home[j]) & (node[i] != node[j])
                row, column = np.nonzero(hit)
                x, y = at[ours][row], at[part][column]
                same = homes[x] == homes[y]
                shared = same.any(axis=1)
                # those at home in one cell are taken in the first such cell alone
                use = ~shared | (home[x] & home[y] & (homes[x, same.argmax(axis=1)] == cell[x]))
                left += [x[use], y[use]]
                right += [y[use], x[use]]
                once += [shared[use], shared[use]]
        # one place per class, in the order of their numbers; each link once
        names, at, place = np.unique(node, return_index=True, return_inverse=True)
        pairs, kept = np.unique(place[np.concatenate(left)] * len(names) + place[np.concatenate(right)], return_index=True)
        left, right, once = pairs // max(1, len(names)), pairs % max(1, len(names)), np.concatenate(once)[kept]
        linked, start = np.unique(left, return_index=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, left[once], copies[at][right[once]])
        offsets = np.append(np.concatenate([[0], np.cumsum(~once)])[start], (~once).sum())
        near = pa.StructArray.from_arrays([pa.array(names[right[~once]]), pa.array(copies[at][right[~once]])], ["node", "copies"])
        root = names[roots(left, right, len(names))[linked]]
        return pa.table({"node": names[linked], "sure": sums[linked], "near": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), near), "root": root})

    places = written(classes.repartition("node").mapInArrow(place, "node long, cells array<long>"), "cells")
    entries = places.select("node", F.posexplode("cells").alias("at", "cell")).select("node", "cell", (F.col("at") % (1 + probes) == 0).alias("home"))
    homes = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.get("cells", t * (1 + probes)))
    busy = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("owned")).where("owned and n > 1")
    busy = written(busy.select("cell", "n"), "cells")
    total = busy.agg(F.sum("n")).first()[0] or 0
    shared = join_counted(entries, busy, "cell", "n", total).where("n is not null")
    small, cut = F.col("n") <= BLOCK, F.ceil(F.col("n") / BLOCK)
    placed = shared.select(
        "node", "cell", "home", F.struct(small.alias("small"), F.when(small, F.pmod(F.xxhash64("cell"), F.lit(max(1, total // BLOCK)))).otherwise(F.col("cell")).alias("part")).alias("part"),
        F.when(small, 0).otherwise(F.pmod(F.xxhash64(F.lit(3), "node"), cut)).cast("int").alias("block"), F.when(small, 1).otherwise(cut).cast("int").alias("blocks"))
    dealt = placed.join(classes.select("node", "copies", "v").join(places.select("node", homes.alias("homes")), "node"), "node").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "part", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "node", "copies", "block", "cell", "home", "homes", "v")
    found = written(dealt.groupBy("part", "first", "second").applyInArrow(compare, "node long, sure long, near array<struct<node: long, copies: long>>, root long"), "near")

    # sorted lists, as array_distinct compares structs two by two
    merged = found.groupBy("node").agg(F.sum("sure").alias("sure"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    nothing = F.struct(F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("n"))
    counted = F.aggregate("near", nothing, lambda so_far, x: F.struct(
        x["node"].alias("node"), (so_far["n"] + F.when(x["node"].eqNullSafe(so_far["node"]), 0).otherwise(x["copies"])).alias("n")))
    degree = written(merged.select("node", (F.col("sure") + counted["n"]).alias("links")), "near")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.drop("v").join(degree, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = written(named.join(names, "component").select("node", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near")
    narrow = rows.select("vec_id", "node")
    out = join_counted(narrow.where("node is not null"), named, "node", "copies", named.agg(F.sum("copies")).first()[0] or 0).select("vec_id", "n_links", "component_id")
    out = out.unionByName(narrow.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
