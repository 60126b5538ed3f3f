"""Two-pass external shuffle into shards."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, scratch_path, written


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard with the highest seeded hash of key and shard number: one shard
    more takes rows only into itself."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.array_max(F.array(*draws)) if shards > 1 else draws[0])["shard"]


def shuffle_rows(docs: DataFrame, path: str, shards: int = 24, bucket_bytes: int = 32 << 20, seed: int = 20240101) -> DataFrame:
    """Shuffle documents (doc_id, text) into shards and write them under `path`.

    The law is `key`: doc_id and the shard count alone decide the shard. Pass one
    scatters the records of a shard by a seeded hash into buckets of about
    `bucket_bytes` each; pass two brings a bucket into one task, puts it into a
    fixed order, applies a Fisher-Yates shuffle seeded by shard and bucket, and
    writes it. Slots count gaplessly through the buckets of a shard.

    Returns (doc_id, size, text_crc32, shard, grown_shard, bucket, slot), read
    back from the files, which also hold the text. Null texts count no bytes and
    have the checksum of the empty text. Rows with a null doc_id share a shard.
    Repeated rows each get their own slot; a row that repeats for more than a
    thousandth of the table is spread over the buckets by its position. No
    rows, no files' rows; other columns are ignored.
    """
    body = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", "text", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    stats = written(rows.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")), "shards")
    count, total = stats.agg(F.sum("copies"), F.sum("bytes")).first()
    buckets = max(1, -(-(total or 0) // (shards * bucket_bytes)))
    heavy = stats.where(F.col("copies") > max(1000.0, (count or 0) * HOT_SHARE)).select(
        F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.lit(True).alias("_heavy"))
    rows = rows.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_crc32") == F.col("_crc")), "left")
    apart = F.when(F.col("_heavy"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = rows.select(
        "doc_id", "text", "size", "text_crc32", shard_of(F.col("doc_id"), shards, seed).alias("shard"),
        shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32", apart), F.lit(buckets)).cast("int").alias("bucket"))

    def fisher_yates(key: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        shard, number = (k.as_py() for k in key)
        bucket = bucket.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending")])
        order = np.arange(len(bucket))
        np.random.default_rng([seed, shard, number]).shuffle(order)
        return bucket.take(pa.array(order)).append_column("position", pa.array(np.arange(len(bucket)), pa.int64()))

    schema = rows.schema.simpleString()[len("struct<"):-1] + ",position:bigint"
    mixed = rows.repartition(shards * buckets, "shard", "bucket").groupBy("shard", "bucket").applyInArrow(fisher_yates, schema)
    mixed.sortWithinPartitions("shard", "bucket", "position").write.partitionBy("shard").parquet(path)
    kept = docs.sparkSession.read.schema(mixed.schema).parquet(path)
    sizes = kept.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket; buckets of a shard are few thousand even at 100 TB
    sizes = sizes.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("all"))
    sizes = sizes.select("shard", F.posexplode("all").alias("i", "one"), "all").select(
        "shard", F.col("one.bucket").alias("bucket"),
        F.aggregate(F.slice("all", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("before"))
    return kept.join(sizes, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket", (F.col("before") + F.col("position")).alias("slot"))


def shard(docs: DataFrame, shards: int = 24, **options) -> DataFrame:
    return shuffle_rows(docs, scratch_path(docs.sparkSession, "shards"), shards, **options)
