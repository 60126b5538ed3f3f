"""Length buckets with the least padding, and token-budget batches inside them."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLICE_ROWS = 100_000  # rows numbered by one task, on average


def word_count(text: Column) -> Column:
    """Length in tokens of white-space tokenization; null and blank texts have none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[ \t\r\n\f]+"))).cast("long")


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise total padding.

    `lengths` ascend. A document is padded to the bound of its bucket, and a
    bound is best put at a length that occurs. best[j] over the first j lengths
    is the least of best[i] + cost(i, j); the best i never moves back as j grows,
    so each layer is filled by halving, a level of it in one numpy pass.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    tokens = np.concatenate([[0], np.cumsum(lengths * counts.astype(np.float64))])
    top = np.concatenate([[0], lengths.astype(np.float64)])

    def cost(i, j):
        return top[j] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    best = cost(0, np.arange(n + 1))
    froms = []
    for k in range(2, buckets + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        spans = [(k, n, k - 1, n - 1)]
        while spans:
            later = []
            for low, high, first, last in spans:
                mid = (low + high) // 2
                i = np.arange(first, min(last, mid - 1) + 1)
                values = best[i] + cost(i, mid)
                at = int(values.argmin())
                new[mid], cut[mid] = values[at], i[at]
                if low < mid:
                    later.append((low, mid - 1, first, i[at]))
                if mid < high:
                    later.append((mid + 1, high, i[at], last))
            spans = later
        froms.append(cut)
        best = new
    bounds, j = [], n
    for cut in reversed(froms):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    bounds.append(int(lengths[j - 1]))
    return bounds[::-1]


def pack(docs: DataFrame, length: Column | None = None, buckets: int = 16, token_budget: int = 65_536, seed: int = 20240101) -> DataFrame:
    """Assign documents (doc_id, text) to length buckets and token-budget batches.

    `length` is the number of tokens, white-space words by default. The histogram
    of all lengths, one row per distinct length, is all the driver sees. A batch
    holds as many documents as fit the budget when each is padded to its bucket's
    bound, at least one. Only the last batch of a bucket may be partly filled.

    Returns (doc_id, n_tokens, bucket, bound, capacity, batch, position, padding).
    Null and empty texts have length 0 and fall in the first bucket. Repeated
    rows are packed one by one; ties are broken by a seeded hash, then doc_id.
    An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select("doc_id", (word_count(F.col("text")) if length is None else length).alias("n_tokens"))
    same = written(rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("copies")), "packing")
    histogram = sorted(map(tuple, same.groupBy("n_tokens").agg(F.sum("copies")).toLocalIterator()))
    lengths = np.array([x[0] for x in histogram], dtype=np.int64)
    counts = np.array([x[1] for x in histogram], dtype=np.int64)
    bounds = best_bounds(lengths, counts, buckets) or [0]

    n = F.col("n_tokens")
    bucket = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(n <= bounds[i], i).otherwise(bucket)
    slices = max(1, -(-int(counts.sum()) // SLICE_ROWS))
    # a uniform draw orders the documents; its leading part is the slice
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "n_tokens"), 1)
    placed = same.select("doc_id", "n_tokens", "copies", bucket.alias("bucket"), draw.alias("draw"))
    placed = placed.withColumn("slice", F.floor(F.col("draw").cast("double") / 2.0**63 * slices).cast("long"))
    local = Window.partitionBy("bucket", "slice").orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("bucket", "slice").agg(F.sum("copies").alias("n"))
    over = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bucket", "slice", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    placed = placed.withColumn("inside", F.coalesce(F.sum("copies").over(local), F.lit(0))).join(offsets, ["bucket", "slice"])
    # copies of a row differ in their rank only; long runs of them unfold in pieces
    start = F.col("before") + F.col("inside")
    pieces = placed.select("doc_id", "n_tokens", "bucket", start.alias("start"), (start + F.col("copies") - 1).alias("end"),
                           F.explode(F.sequence(start, start + F.col("copies") - 1, F.lit(10_000).cast("long"))).alias("from"))
    ranked = pieces.select("doc_id", "n_tokens", "bucket", F.explode(F.sequence("from", F.least(F.col("from") + 9_999, "end"))).alias("rank"))
    bound = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("bucket"))
    capacity = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bound"), F.lit(1))))
    return ranked.withColumn("bound", bound).withColumn("capacity", capacity).select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bound", "capacity",
        F.floor(F.col("rank") / F.col("capacity")).alias("batch"), (F.col("rank") % F.col("capacity")).alias("position"),
        (F.col("bound") - F.col("n_tokens")).alias("padding"))
