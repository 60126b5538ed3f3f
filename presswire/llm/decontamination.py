"""Benchmark decontamination with SimHash windows, in DataFrame functions alone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, written
from .labelled import SMALL_ROWS

SHINGLE = 5
RADIUS = 20
# The 64 bits of a fingerprint in blocks (first bit, width). Of two fingerprints
# within RADIUS at least one block differs in at most RADIUS // blocks bits.
BLOCKS = [(0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9)]


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words in order, repeats included."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingles: str) -> Column:
    """SimHash of a column of shingles: a bit is set where more than half of them,
    counted as often as they occur, have it."""
    ones = f"aggregate({shingles}, 0, (n, h) -> n + int(shiftright(h, b) & 1L))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | if(2 * {ones} > size({shingles}), shiftleft(1L, b), 0L))")


def _block(print_: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(print_, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _blocks(print_: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(print_, *b).alias("value")) for i, b in enumerate(BLOCKS)])


def _probes(print_: Column) -> Column:
    """Every (block, value) whose value is near enough to the fingerprint's own."""
    most, out = RADIUS // len(BLOCKS), []
    for i, (first, width) in enumerate(BLOCKS):
        # a short rule in place of each flip written out, which makes plans large
        flips = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda x: F.bit_count(x) <= most)
        own = _block(print_, first, width)
        out.append(F.transform(flips, lambda x: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(x).alias("value"))))
    return F.concat(*out)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows, else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item, n_words, size, shingles, kinds, print, item_ids): items of equal words are one
    class; kinds are the distinct shingles with their counts. Items without words are left out."""
    said = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    classes = said.groupBy("words").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids")).select(
        F.xxhash64("words").alias("item"), F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(SHINGLE)).alias("size"), "words", "item_ids")
    by_size = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        by_size = F.when(F.col("size") == size, shingles(F.col("words"), size)).otherwise(by_size)
    classes = classes.withColumn("shingles", by_size)
    kinds = F.transform(F.array_distinct("shingles"), lambda h: F.struct(h.alias("hash"), F.size(F.filter("shingles", lambda x: x == h)).alias("n")))
    return classes.select("item", "n_words", "size", "shingles", kinds.alias("kinds"), fingerprint("shingles").alias("print"), "item_ids")


def _least(threshold: float, k: Column) -> Column:
    """A window as similar as `threshold` to an item of k shingles has so many of them."""
    return F.ceil(F.lit(threshold) * k - 1e-9).cast("int")


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Benchmark items (item_id, text) that occur in documents (doc_id, text).

    A window has as many words as an item, or runs to the end of the text. It is
    compared with all items of that many words: their SimHash fingerprints must
    lie within RADIUS bits, found by joining on blocks of bits of which one is
    nearly equal, and then the weighted Jaccard similarity of their five-word
    shingles, each weighing as often as it occurs, must be `threshold` or more.
    Items of fewer than five words have one shingle of all their words.

    Windows that cannot be so similar to any item get no fingerprint: a similar
    one has one of the item's rarest shingles (so many that the others are too
    few), has enough of its shingles, and moved right to the first of them stays
    as similar. Equal texts are searched once.

    Returns (doc_id, item_id, similarity, start, n_words) per row of docs and
    item, for the best window, the first of equals; start counts words from 0.
    Null and empty texts and items match nothing; items of equal words are each
    reported; rows with a null doc_id and repeated rows are reported like
    others. Other columns are ignored.
    """
    items = written(item_classes(benchmark), "items")
    found = None
    for (size,) in sorted(map(tuple, items.select("size").distinct().collect())):  # at most SHINGLE values
        part = _find(docs, items.where(F.col("size") == size), size, threshold)
        found = part if found is None else found.unionByName(part)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    if found is None:
        return docs.select("doc_id").limit(0).selectExpr("doc_id", "0L item_id", "0D similarity", "0 start", "0 n_words")
    found = written(found, "matches")
    names = _small(written(items.select("item", F.explode("item_ids").alias("item_id")), "items"))
    rows = docs.select("doc_id", key.alias("text_key")).join(_small(found.select("text_key").distinct()), "text_key", "left_semi")
    rows = written(rows, "matches")
    copies = rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    matches = found.groupBy("text_key").agg(F.collect_list(F.struct("item", "similarity", "start", "n_words")).alias("all"))
    total = rows.count()
    named = join_counted(rows, written(copies.join(matches, "text_key"), "matches"), "text_key", "copies", total)
    return named.select("doc_id", F.explode("all").alias("m")).select("doc_id", "m.*").join(names, "item").select(
        "doc_id", "item_id", "similarity", "start", "n_words")


def _find(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")
    k = F.size("shingles")
    spread = items.select("item", F.explode("kinds").alias("kind"), (k - _least(threshold, k)).alias("spare")).select("item", "spare", "kind.*")
    often = spread.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    # the rarest shingles of an item, more occurrences than a similar window can lack
    rare = spread.join(often, "hash").groupBy("item", "spare").agg(F.array_sort(F.collect_list(F.struct("items", "hash", "n"))).alias("all"))
    rare = rare.select("item", "spare", F.posexplode("all").alias("i", "one"), "all").select(
        "item", F.col("one.hash").alias("hash"), (F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + x["n"]) <= F.col("spare")).alias("rare"))
    seeds = _small(written(rare.where("rare").select("hash", "item"), "items"))

    # words are a column of their own: inside a lambda they would be split for every run
    spelt = docs.select(key, words(F.col("text")).alias("words")).select("text_key", F.explode(shingles(F.col("words"), size)).alias("hash"))
    hits = written(spelt.join(seeds, "hash").select("text_key", "item").distinct(), "hits")

    held = docs.select(key, "text").join(_small(hits.select("text_key").distinct()), "text_key", "left_semi").dropDuplicates(["text_key"])
    texts = written(held.select("text_key", words(F.col("text")).alias("words")).select("text_key", shingles(F.col("words"), size).alias("line")), "texts")
    small_items = _small(items.select("item", "n_words", "shingles"))
    pairs = hits.join(texts, "text_key").join(small_items, "item")
    pairs = pairs.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("line") - 1), lambda p: F.array_contains("shingles", F.element_at("line", p + 1))))
    need, size_of = _least(threshold, k), F.size("at")
    starts = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(size_of - need + 1, F.lit(1))),
                 lambda j: (j + need - 1 <= size_of) & (F.get("at", j + need - 2) < F.get("at", j - 1) + k)),
        lambda j: F.get("at", j - 1))
    windows = pairs.where(size_of >= need).select("text_key", "n_words", F.explode(starts).alias("start"), k.alias("k"), "line").select(
        "text_key", "n_words", "start", F.expr("slice(line, start + 1, k)").alias("window"))
    windows = written(windows.dropDuplicates(["text_key", "n_words", "start"]).withColumn("print", fingerprint("window")), "windows")

    sought = items.select("item", "n_words", F.col("print").alias("item_print"), F.explode(_probes(F.col("print"))).alias("b")).select("item", "n_words", "item_print", "b.*")
    sought = _small(written(sought, "items"))
    near = windows.select("text_key", "n_words", "start", "print", F.explode(_blocks(F.col("print"))).alias("b")).select("text_key", "n_words", "start", "print", "b.*")
    near = near.join(sought, ["n_words", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = near.select("text_key", "n_words", "start", "item").distinct()
    both = near.join(windows, ["text_key", "n_words", "start"]).join(_small(items.select("item", "kinds", k.alias("k"))), "item")
    shared = F.aggregate("kinds", F.lit(0), lambda a, x: a + F.least(x["n"], F.size(F.filter("window", lambda h: h == x["hash"]))))
    scored = both.select("text_key", "item", "n_words", "start", (shared / (F.size("window") + F.col("k") - shared)).alias("similarity"))
    best = scored.where(F.col("similarity") >= threshold - 1e-9).groupBy("text_key", "item", "n_words").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("text_key", "item", "n_words", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, in which no item occurs. A row is judged by its
    own text, whatever other rows share its doc_id."""
    found = written(find(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text"), benchmark, threshold).select(
        F.col("doc_id").alias("__found")).distinct(), "matches")
    return docs.join(_small(found), F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__found"), "left_anti")
