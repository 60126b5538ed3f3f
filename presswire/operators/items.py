"""Raw items: assembly, two-pass dedup, caps and unions."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import collapse, excerpt
from ..functions.urls import clean_url, host_of, make_item_id
from .ordering import first_rows

ITEM_SCHEMA = (
    "item_id string, source string, source_type string, topic_hint string, url string, "
    "canonical_url string, title string, body_excerpt string, author string, "
    "published_at timestamp, fetched_at timestamp, run_id string, ingest_date date"
)
ITEM_COLUMNS = [part.split()[0] for part in ITEM_SCHEMA.split(", ")]


def resolve_redirects(
    urls: DataFrame, redirects: DataFrame, url: str, out: str,
    hosts: list[str] = C.SHORTENER_HOSTS, max_hops: int = C.MAX_REDIRECT_HOPS,
) -> DataFrame:
    """Canonical URL of each row, following short links through a table.

    `redirects(from_url, to_url)` stands for the network. Only rows on a
    shortener host are looked up; a chain that has not ended after `max_hops`
    keeps the cleaned input.
    """
    hops = redirects.select(F.col("from_url").alias("_from"), F.col("to_url").alias("_to")).dropDuplicates(["_from"])
    cleaned = urls.withColumn("_clean", clean_url(F.col(url)))
    lookup = F.coalesce(host_of(F.col("_clean")).isin([h.lower() for h in hosts]), F.lit(False))
    # the distinct short links are few next to the rows that carry them
    walk = cleaned.where(lookup).select("_clean").distinct().withColumn("_at", F.col("_clean")).withColumn("_open", F.lit(True))
    for _ in range(max_hops):
        walk = walk.join(hops, F.col("_open") & (F.col("_at") == F.col("_from")), "left")
        walk = walk.select(
            "_clean",
            F.coalesce("_to", "_at").alias("_at"),
            (F.col("_open") & F.col("_to").isNotNull()).alias("_open"),
        )
    ended = walk.where(~F.col("_open")).select(F.col("_clean").alias("_short"), F.col("_at").alias("_end"))
    joined = cleaned.join(ended, lookup & (F.col("_clean") == F.col("_short")), "left")
    target = F.when(F.col("_end") != F.col("_clean"), clean_url(F.col("_end")))
    return joined.withColumn(out, F.coalesce(target, F.col("_clean"))).drop("_clean", "_short", "_end")


def build_items(entries: DataFrame, run_id: Column, fetched_at: Column, canonical: Column | None = None) -> DataFrame:
    """Bronze rows from normalised entries.

    `entries` has source, source_type, topic_hint, url, title, body or the
    body_excerpt made of it, author and published_at; any further columns are kept. A row whose URL cannot be
    cleaned is dropped.
    """
    canonical = clean_url(F.col("url")) if canonical is None else canonical
    extra = [c for c in entries.columns if c not in ITEM_COLUMNS and c != "body"]
    built = entries.select(
        "*", canonical.alias("_canonical"), fetched_at.alias("_fetched"), run_id.alias("_run")
    ).where(F.col("_canonical").isNotNull())
    return built.select(
        make_item_id(F.col("_canonical"), F.col("published_at")).alias("item_id"),
        "source", "source_type", "topic_hint", "url",
        F.col("_canonical").alias("canonical_url"),
        collapse(F.col("title")).alias("title"),
        excerpt(F.col("body")).alias("body_excerpt") if "body" in entries.columns else F.col("body_excerpt"),
        F.when(F.col("author") != "", F.col("author")).alias("author"),
        "published_at",
        F.col("_fetched").alias("fetched_at"),
        F.col("_run").alias("run_id"),
        F.to_date("_fetched").alias("ingest_date"),
        *extra,
    )


def since_and_cap(entries: DataFrame, since: Column, caps: dict[str, int], position: str = "position") -> DataFrame:
    """Drop what is older than `since`, then keep each source's first rows.

    `caps` maps each registered source to its ``max_items_per_run``; a source
    outside the registry is not collected. Rows are counted in feed order.
    """
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("source")]
    fresh = entries.where((F.col("published_at") >= since) & cap.isNotNull())
    # a source within its number is kept whole, whatever the order; a row a registered source
    over = [r["source"] for r in fresh.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).collect()]
    if not over:
        return fresh
    most = max(caps[s] for s in over)
    ranked = first_rows(fresh.where(F.col("source").isin(over)), ["source"], [F.col(position)], most, rank="_feed_rank")
    return fresh.where(~F.col("source").isin(over)).unionByName(ranked.where(F.col("_feed_rank") <= cap).drop("_feed_rank"))


def union_items(*batches: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def dedup(items: DataFrame) -> DataFrame:
    """One row per item id across days, then one per day and canonical URL.

    The earliest published row wins, the item id breaks ties. The passes do
    not commute. `dedup_order` gives the order the reference returns.
    """
    order = [F.col("published_at"), F.col("item_id")]
    # rows sharing an item id share url and stamp; a full-row tie break keeps
    # the result the same on every run
    by_id = first_rows(items, ["item_id"], order + _tie_break(items))
    return first_rows(by_id, ["ingest_date", "canonical_url"], order)


def _tie_break(items: DataFrame) -> list:
    return [F.col(c) for c in ("ingest_date", "fetched_at", "source", "url", "title", "body_excerpt") if c in items.columns]


def dedup_order(items: DataFrame) -> DataFrame:
    return items.orderBy("published_at", "item_id")
