"""The whole item path in one query: pages to deduplicated items to a summary."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import main_text
from ..functions.urls import host_of
from ..operators.enrich import body_coverage
from ..operators.items import build_items, dedup
from .standins import table


def pages_by_host(spark: SparkSession, sf: str) -> DataFrame:
    """Read pages, canonicalise, take the main text, dedup, and report body
    coverage by host."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600)
    entries = table(spark, sf, "pages").select(
        host_of(F.col("url")).alias("source"), F.lit("rss").alias("source_type"), F.lit("World").alias("topic_hint"), "url",
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), main_text(F.col("html")).alias("body"),
        F.lit("").alias("author"), at.alias("published_at"))
    items = build_items(entries, F.lit("20240101T000000Z-0000"), F.col("published_at"))
    return body_coverage(dedup(items)).orderBy("source")
