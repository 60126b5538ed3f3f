"""N-gram Jaccard join by a MinHash LSH forest: sorted prefix tries, shortened where links say so."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, written
from .labelled import SMALL_ROWS
from .words import Shingler

TREES = 32
LONGEST = 8   # values of a signature in a tree, two bytes each
BLOCK = 256   # texts compared with each other at once

_SEEDS = np.random.default_rng(20240101)
_FACTORS = _SEEDS.integers(0, 2**31, TREES * LONGEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _SEEDS.integers(0, 2**32, TREES * LONGEST, dtype=np.uint32)


def found_share(similarity, length: int):
    """How likely a pair shares its first `length` values in one of the trees."""
    return 1 - (1 - similarity**length) ** TREES


def prefix_length(threshold: float, recall: float) -> int:
    """The longest prefix that a pair right at the threshold shares in some tree with the wanted probability."""
    return next((n for n in range(LONGEST, 1, -1) if found_share(threshold, n) >= recall), 1)


def signature(shingles: np.ndarray) -> bytes:
    """Per tree, the first LONGEST MinHash values, of which the low two bytes are kept."""
    if not len(shingles):
        return b""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * LONGEST, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (_FACTORS[:, None] * x[None, i:i + 1024] + _SHIFTS[:, None]).min(axis=1), out=least)
    # mixed, as the least values have small high parts and the low bits of an odd multiple say little
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(">u2").tobytes()


def runs(length: int):
    """Links of neighbours in the sorted entries (tree, key, node, open) of the tries that
    share `length` values: every node of such a run to the first. Runs without an open node give none."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, opened, waiting = None, None, False, []  # of the run a batch may end in
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree, node, is_open = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "node", "open"))
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(n, -1)[:, :2 * length]
            marks = np.concatenate([tree[:, None].astype(np.uint8), keys], axis=1)
            new = np.concatenate([[last is None or bool((marks[0] != last).any())], (marks[1:] != marks[:-1]).any(axis=1)])
            last = marks[-1]
            starts = np.flatnonzero(new)
            a, b = [], []

            def more(members: np.ndarray, some_open: bool) -> None:
                nonlocal opened, waiting
                opened |= some_open
                waiting.append(members)
                if opened:
                    a.extend(waiting)
                    b.append(np.full(sum(map(len, waiting)), first, np.int64))
                    waiting = []

            head = int(starts[0]) if len(starts) else n
            if head:
                more(node[:head], bool(is_open[:head].any()))
            if len(starts):
                # runs that begin and end in here
                sizes = np.diff(starts)
                take = (sizes > 1) & np.logical_or.reduceat(is_open, starts)[:-1]
                inside = np.repeat(take, sizes) & ~new[starts[0]:starts[-1]]
                a.append(node[starts[0]:starts[-1]][inside])
                b.append(np.repeat(node[starts[:-1]], sizes)[inside])
                begin = int(starts[-1])
                first, opened, waiting = int(node[begin]), False, []
                more(node[begin + 1:], bool(is_open[begin:].any()))
            left = np.concatenate(a) if a else np.zeros(0, np.int64)
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(np.concatenate(b))], ["a", "b"])

    return linked


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of a shares with each of b, by products of 0/1 matrices
    over a run of shingles at a time. Shingles of one text alone are left out."""
    every = np.concatenate(a + b)
    kinds, at, times = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    column[times == 1] = -1
    at, width = column[at], int((times > 1).sum())
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for start in range(0, width, 4096):
        low, high = np.searchsorted(at, [start, start + 4096])
        marks = np.zeros((len(a) + len(b), min(4096, width - start)), np.float32)
        marks[owner[low:high], at[low:high] - start] = 1
        out += marks[:len(a)] @ marks[len(a):].T
    return out


def _similar(sets_a, sets_b) -> np.ndarray:
    """Jaccard similarity of each of a with each of b; -1 where both are empty."""
    shared = _overlaps(sets_a, sets_b)
    both = np.array([len(x) for x in sets_a])[:, None] + np.array([len(x) for x in sets_b])[None, :] - shared
    return np.where(both > 0, shared / np.maximum(both, 1), -1.0)


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest number connected to each of n numbers by the pairs given."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _rows(docs: DataFrame, threshold: float, recall: float, group_recall: float) -> DataFrame:
    """One row per row of docs: (doc_id, node, class_id, n_links, kept), see links."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            words = [shingler.words(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": [Shingler.digest(w) for w in words],
                                "trees": [signature(Shingler.shingles(w)) for w in words]})

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            words = [shingler.words(t) for t in batch["text"]]
            yield pd.DataFrame({"node": [Shingler.digest(w) for w in words], "shingles": [Shingler.shingles(w).view(np.int64) for w in words]})

    def compare_at(length: int):
        def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            first, second = key[1].as_py(), key[2].as_py()
            node, copies, block = (rows[c].to_numpy() for c in ("node", "copies", "block"))
            sets = [np.asarray(x.values.to_numpy()) for x in rows["shingles"]]
            a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
            near = _similar([sets[i] for i in a], [sets[i] for i in b])
            if first == second:
                np.fill_diagonal(near, -1.0)
            hit = near >= threshold - 1e-9
            # a link that is found in a share p of such cases stands for 1/p links
            stands = np.where(hit, 1 / found_share(np.clip(near, threshold, 1.0), length), 0.0)
            count, pairs, mass = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64), np.zeros(len(node))
            count[a] += hit @ copies[b]
            pairs[a] += hit.sum(axis=1)
            mass[a] += stands.sum(axis=1)
            if first != second:
                count[b] += hit.T @ copies[a]
                pairs[b] += hit.sum(axis=0)
                mass[b] += stands.sum(axis=0)
            i, j = np.nonzero(hit)
            order = np.argsort(node)
            place = np.empty(len(node), np.int64)
            place[order] = np.arange(len(node))
            root = node[order][roots(place[a[i]], place[b[j]], len(node))[place]]
            found = count > 0
            return pa.table({"node": node[found], "links": count[found], "pairs": pairs[found], "mass": mass[found], "root": root[found]})

        return compare

    def groups(length: int, open_: DataFrame | None, known: DataFrame | None) -> DataFrame:
        """(id, component) of classes in a run of the tries, each linked to the first of it, or linked already."""
        entries = tries if open_ is None else tries.join(open_.withColumn("opened", F.lit(True)), "node", "left")
        flag = F.lit(True) if open_ is None else F.coalesce("opened", F.lit(False))
        tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
        placed = entries.select("node", "trees", flag.alias("open"), tree.alias("tree")).select(
            "tree", F.substring("trees", F.col("tree") * 2 * LONGEST + 1, F.lit(2 * LONGEST)).alias("key"), "node", "open")
        # a run is never cut: what shares the prefix is in one range
        ranged = placed.withColumn("prefix", F.substring("key", 1, 2 * length)).repartitionByRange("tree", "prefix").drop("prefix")
        met = ranged.sortWithinPartitions("tree", "key").mapInArrow(runs(length), "a long, b long")
        return written(components(met if known is None else met.unionByName(known)), "forest")

    def verify(near: DataFrame, length: int) -> DataFrame:
        """(node, links, pairs, mass, root) of the links among classes of a group, a row per task that finds one."""
        sizes = written(near.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "forest")
        total = sizes.agg(F.sum("n")).first()[0] or 0
        some = max(1, total // BLOCK)
        # small groups fill blocks together, large ones are cut into blocks
        cut = F.ceil(F.col("n") / BLOCK)
        small = F.col("n") <= BLOCK
        placed = join_counted(near.withColumnRenamed("id", "node"), sizes, "component", "n", total).select(
            "node", F.when(small, F.pmod(F.xxhash64("component"), F.lit(some))).otherwise(F.col("component")).alias("part"), small.alias("small"),
            F.when(small, 0).otherwise(F.pmod(F.xxhash64(F.lit(3), "node"), cut)).cast("int").alias("block"),
            F.when(small, 1).otherwise(cut).cast("int").alias("blocks"))
        wanted = written(placed.join(classes, "node"), "forest")

        # the texts of one row per class; rows without an id are looked at again
        ids = wanted.where("doc_id is not null").select("doc_id").distinct()
        ids = F.broadcast(ids) if wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else ids
        texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").unionByName(docs.select("doc_id", "text").where("doc_id is null"))
        spelt = texts.select("doc_id", "text").mapInPandas(spell, "node long, shingles array<long>").dropDuplicates(["node"])
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        dealt = wanted.drop("doc_id").join(spelt, "node").select("*", every).select(
            F.struct("small", "part").alias("part"), F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
            "node", "copies", "block", "shingles")
        return written(dealt.groupBy("part", "first", "second").applyInArrow(compare_at(length), "node long, links long, pairs long, mass double, root long"), "forest")

    signed = written(docs.select("doc_id", "text").mapInPandas(sign, "doc_id long, node long, trees binary"), "forest")
    classes = written(signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")), "forest")
    tries = signed.where(F.octet_length("trees") > 0).select("node", "trees").dropDuplicates(["node"])
    length = prefix_length(threshold, recall)
    near = groups(length, None, None)
    found = verify(near, length)
    # a group whose own links stand for more than were found looks along shorter prefixes
    while length > 1 and found_share(threshold, length) < group_recall:
        members = found.groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum("mass").alias("mass"))
        grouped = written(near.withColumnRenamed("id", "node").join(members, "node"), "forest")
        shares = written(grouped.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.sum("pairs") / F.sum("mass")).alias("share")), "forest")
        lacking = shares.where(F.col("share") < group_recall)
        total = shares.agg(F.sum("n")).first()[0] or 0
        open_ = written(join_counted(grouped.select("node", "component"), lacking, "component", "n", total).where("n is not null").select("node"), "forest")
        if open_.isEmpty():
            break
        length -= 1
        known = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
        wider = groups(length, open_, known)
        within = wider.join(near.withColumnRenamed("component", "before"), "id", "left").join(open_.select(F.col("node").alias("id"), F.lit(1).alias("open")), "id", "left").groupBy("component").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("before", "id")).alias("parts"), F.max("open").alias("open"))
        within = written(within, "forest")
        grown = within.where("parts > 1 and open = 1").select("component", "n")
        grown = written(join_counted(wider, grown, "component", "n", within.agg(F.sum("n")).first()[0] or 0).where("n is not null").select("id", "component"), "forest")
        if not grown.isEmpty():
            more = verify(grown, length)
            found = written(found.join(grown.select(F.col("id").alias("node")), "node", "left_anti").unionByName(more), "forest")
        near = wider

    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(degree, "node", "left").join(joined.withColumnRenamed("id", "node"), "node", "left")
    named = written(named.withColumn("component", F.coalesce("component", "node")), "forest")
    names = written(named.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members")), "forest")
    named = written(join_counted(named, names, "component", "members", names.agg(F.sum("members")).first()[0] or 0).select(
        "node", "copies", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("node") == F.col("component")).alias("first")), "forest")
    rows = join_counted(signed.select("doc_id", "node"), named, "node", "copies", named.agg(F.sum("copies")).first()[0] or 0)
    kept = F.when(F.col("class_id").isNull(), F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("class_id")))
    return rows.select("doc_id", "node", "class_id", "n_links", kept.alias("kept"))


def links(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, group_recall: float = 0.9999) -> DataFrame:
    """Join documents (doc_id, text) whose five-word shingles are similar.

    Words are runs of letters and digits in lower case. Texts of equal word
    sequences are one class with similarity 1, compared once; texts without words
    are copies of each other. Every class is signed once, by 8 MinHash values in each of 32
    trees, kept in a table. A tree is the sorted list of its signatures: a prefix of
    the trie is a run of neighbours. Classes in a run of at least the length that finds
    a pair right at the threshold with probability `recall` are brought together:
    those reachable over runs go to blocks of at most about 256, blocks of a
    larger group meet two by two in tasks of their own, and every pair that meets is
    verified exactly there and kept. A link as similar as s is found with a known
    probability p(s), so it stands for 1/p(s) links. Groups whose links stand for so many
    more that less than `group_recall` of them are found look along prefixes
    shorter by one value, against all signatures, until that share is reached. A
    pair whose texts have no other link is found with `recall` or more. Tasks return one row per class, with
    the number of its links, so pairs are never listed.

    Returns one row per row of docs: (doc_id, class_id, n_links, kept): class_id
    is the smallest doc_id reachable over links, n_links the number of other
    rows linked directly (copies included), kept whether doc_id is class_id. Null
    texts count as empty. A null doc_id never names a class; in a
    class without any other, the rows of one text are kept. A row that repeats is a copy of itself. Other
    columns are ignored. Hashes of words, shingles and classes have 64 bits.
    """
    return _rows(docs, threshold, recall, group_recall).drop("node")


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, group_recall: float = 0.9999) -> DataFrame:
    """The documents, all columns, one of each group of linked ones: that with the
    smallest doc_id, once if it repeats. Where no row of a group has an id, one of
    its rows stays."""
    rows = written(_rows(docs, threshold, recall, group_recall), "forest")
    ids = rows.where("doc_id is not null")
    kept = ids.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    gone = ids.where("not kept").select("doc_id").distinct().join(kept, "doc_id", "left_anti")
    again = kept.where("n > 1").select("doc_id")
    gone, again = (F.broadcast(x) if x.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else x for x in (written(gone, "forest"), written(again, "forest")))
    left = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    out = left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))

    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler()
        for texts in batches:
            yield pd.Series([Shingler.digest(shingler.words(t)) for t in texts], dtype="int64")

    nodes = rows.where("doc_id is null and kept").select(F.col("node").alias("__kept")).distinct()
    nameless = docs.where("doc_id is null").withColumn("__node", F.pandas_udf(digests, "long")(F.col("text")))
    nameless = nameless.join(nodes, F.col("__node") == F.col("__kept"), "left_semi").dropDuplicates(["__node"])
    return out.unionByName(nameless.select(*docs.columns))
