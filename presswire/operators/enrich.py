"""Fill thin item bodies from the pages they link to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import excerpt, main_text, strip
from ..functions.urls import clean_url, host_of
from .ordering import first_rows


WANTED_URLS = 200_000  # that are broadcast, some 20 MB


def should_fetch(body_excerpt: Column, canonical_url: Column, min_chars: int = C.ENRICH_MIN_CHARS,
                 skip_hosts: list[str] = C.ENRICH_SKIP_HOSTS, enabled: bool = True) -> Column:
    return (
        F.lit(enabled)
        & (F.length(strip(body_excerpt)) < min_chars)
        & (canonical_url.startswith("http://") | canonical_url.startswith("https://"))
        & ~host_of(canonical_url).isin(skip_hosts)
    )


def readable_page(pages: DataFrame, max_bytes: int = C.ENRICH_MAX_BYTES) -> Column:
    """HTML within the size limit, where the page table says what it holds."""
    ok = F.octet_length("html") <= max_bytes
    if "content_type" in pages.columns:
        kind = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
        html_kind = kind.startswith(C.HTML_CONTENT_TYPES[0]) | kind.startswith(C.HTML_CONTENT_TYPES[1])
        ok = ok & ((kind == "") | html_kind)
    if "status" in pages.columns:
        ok = ok & (F.col("status") == 200)
    return ok


def page_texts(pages: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``(canonical_url, page_text)``, one row per URL, earliest page first.

    Pages are parsed where they are read, each once however many items link to
    it, so that excerpts and not whole pages go through the shuffle. Where the URLs
    wanted are few enough to be sent to every task, no other page is parsed.
    """
    found = pages.where(readable_page(pages)).withColumn("canonical_url", clean_url(F.col("url")))
    if wanted is not None:
        urls = wanted.select("canonical_url").distinct()
        if urls.limit(WANTED_URLS + 1).count() <= WANTED_URLS:
            found = found.join(F.broadcast(urls), "canonical_url", "left_semi")
    found = found.select("canonical_url", "page_id", excerpt(main_text(F.col("html"))).alias("page_text"))
    return first_rows(found, ["canonical_url"], [F.col("page_id")]).drop("page_id")


def enrich_items(items: DataFrame, pages: DataFrame, **config) -> DataFrame:
    """Items with ``fetched``, ``enriched`` and ``chars_added`` beside them.

    A body is replaced only by a longer excerpt; the item id never changes.
    """
    # rows with equal URLs agree on the page text, so the join is on URL alone;
    # adaptive execution splits a URL that many items share
    flagged = items.withColumn("fetched", should_fetch(F.col("body_excerpt"), F.col("canonical_url"), **config))
    texts = page_texts(pages, flagged.where("fetched"))
    joined = flagged.join(texts, "canonical_url", "left")
    before = F.length(strip(F.col("body_excerpt")))
    better = F.col("fetched") & (F.length(F.coalesce("page_text", F.lit(""))) > before)
    return joined.select(
        *[F.when(better, F.col("page_text")).otherwise(F.col(c)).alias(c) if c == "body_excerpt" else c for c in items.columns],
        "fetched",
        better.alias("enriched"),
        F.when(better, F.length("page_text") - before).otherwise(0).alias("chars_added"),
    )


def enrich_metrics(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("considered"),
        F.count_if("fetched").alias("fetched"),
        F.count_if("enriched").alias("enriched"),
        F.coalesce(F.sum("chars_added"), F.lit(0)).alias("chars_added"),
    )


def grounding_chars(members: Column) -> Column:
    """Trimmed body characters over an array of member structs."""
    return F.aggregate(members, F.lit(0), lambda n, m: n + F.length(strip(m["body_excerpt"])))


def groundable(items: DataFrame, keys: list[str], min_chars: int = C.MIN_GROUNDING_CHARS) -> DataFrame:
    """Per key: text to write from, and whether it reaches the floor."""
    chars = F.sum(F.length(strip(F.col("body_excerpt"))))
    return items.groupBy(*keys).agg(chars.alias("grounding_chars"), (chars >= min_chars).alias("groundable"))


def body_coverage(items: DataFrame) -> DataFrame:
    """Per source: items, empty bodies and mean body length."""
    return items.groupBy("source").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("body_excerpt") == "").alias("empty_bodies"),
        F.avg(F.length("body_excerpt")).alias("avg_chars"),
    )
