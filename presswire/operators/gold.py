"""Questions asked of the permanent record: weekly review, archive, feed."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_long, date_short, duration, feed_date, month_heading, permalink
from ..functions.text import topic_slug
from ..sources.editions import parse_edition

FALLBACK_TITLE = "Short edition"


def parsed_editions(editions: DataFrame) -> DataFrame:
    """Edition rows with the parsed struct; unreadable JSON is left out."""
    return editions.withColumn("edition", parse_edition(F.col("edition_json"))).where(F.col("edition").isNotNull())


def _is_fallback() -> Column:
    return F.col("edition.edition_type") == "fallback"


def story_count() -> Column:
    """Section cards of an edition; briefly lines and fallbacks count nothing."""
    return F.aggregate(
        F.coalesce(F.col("edition.sections"), F.array()), F.lit(0), lambda n, s: n + F.coalesce(F.size(s["stories"]), F.lit(0)))


# --- published record -------------------------------------------------------------

def published_cluster_ids(editions: DataFrame) -> DataFrame:
    """Distinct cluster ids of section cards and briefly lines, with the date.
    Old briefly lines carry no id and are skipped."""
    cards = F.flatten(F.transform(F.coalesce("edition.sections", F.array()), lambda s: F.transform(s["stories"], lambda t: t["cluster_id"])))
    lines = F.transform(F.coalesce("edition.briefly", F.array()), lambda b: b["cluster_id"])
    ids = F.array_union(F.coalesce(cards, F.array()), F.coalesce(lines, F.array()))
    return parsed_editions(editions).select("date", F.explode(ids).alias("cluster_id")).where(
        F.coalesce("cluster_id", F.lit("")) != "").distinct()


def running_totals(editions: DataFrame) -> DataFrame:
    return parsed_editions(editions).agg(
        F.count(F.lit(1)).alias("editions"),
        F.coalesce(F.sum(F.when(~_is_fallback(), story_count())), F.lit(0)).alias("stories"))


def stories_per_edition(editions: DataFrame) -> DataFrame:
    return parsed_editions(editions).select("date", "edition_type", story_count().alias("stories"))


def topics_with_editions(editions: DataFrame) -> DataFrame:
    """One row per section name and edition that ran it."""
    rows = parsed_editions(editions).where(~_is_fallback())
    return rows.select(F.explode("edition.sections.name").alias("section"), "date").distinct().withColumn(
        "slug", topic_slug(F.col("section")))


def topic_pages(editions: DataFrame) -> DataFrame:
    return topics_with_editions(editions).groupBy("section", "slug").agg(
        F.count(F.lit(1)).alias("editions"), F.max("date").alias("latest"))


def neighbours(editions: DataFrame) -> DataFrame:
    """Previous and next edition date. One row per date and one window over
    them, a calendar's worth of rows."""
    dates = editions.select("date").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("date")
    return dates.select("date", F.lag("date").over(order).alias("prev_date"), F.lead("date").over(order).alias("next_date"))


def _title() -> Column:
    return F.when(_is_fallback(), F.lit(FALLBACK_TITLE)).otherwise(F.col("edition.headline_of_the_day"))


def archive_rows(editions: DataFrame) -> DataFrame:
    """Archive page rows. Newest first is ``orderBy(desc(date))``."""
    count = F.when(_is_fallback(), F.coalesce(F.size("edition.stories"), F.lit(0))).otherwise(story_count())
    audio = F.when(~_is_fallback(), F.col("edition.audio.duration_seconds"))
    return parsed_editions(editions).select(
        "date", F.year("date").cast("string").alias("year"), month_heading(F.col("date")).alias("month"),
        date_short(F.col("date")).alias("short_date"), permalink(F.col("date")).alias("path"),
        _title().alias("title"), count.alias("stories"), duration(audio).alias("audio_length"))


def archive_months(editions: DataFrame) -> DataFrame:
    """Archive rows by month, newest first within; a month has at most 31."""
    rows = archive_rows(editions)
    entry = F.struct("date", "title", "stories", "audio_length")
    return rows.groupBy("year", "month").agg(
        F.max("date").alias("newest"), F.count(F.lit(1)).alias("editions"),
        F.sort_array(F.collect_list(entry), asc=False).alias("rows"))


def feed_items(editions: DataFrame, site: str) -> DataFrame:
    """Feed entries: points as lines, the notice for a fallback, an enclosure
    where there is audio."""
    lines = F.array_join(F.transform("edition.key_points", lambda p: F.concat(F.lit("- "), p["text"])), "\n")
    audio = F.when(~_is_fallback(), F.col("edition.audio"))
    return parsed_editions(editions).select(
        "date", _title().alias("title"), F.concat(F.lit(site.rstrip("/")), permalink(F.col("date"))).alias("link"),
        feed_date(F.col("date")).alias("published"),
        F.when(_is_fallback(), F.col("edition.notice")).otherwise(lines).alias("description"),
        audio["url"].alias("enclosure_url"), audio["size_bytes"].alias("enclosure_length"),
        audio["duration_seconds"].alias("enclosure_seconds"))


def edition_headers(editions: DataFrame) -> DataFrame:
    from ..functions.dates import read_time

    return parsed_editions(editions).select(
        "date", date_long(F.col("date")).alias("long_date"), permalink(F.col("date")).alias("path"),
        read_time(F.coalesce(F.size("edition.key_points"), F.lit(0))).alias("read_time"))


# --- weekly review ----------------------------------------------------------------

def topic_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("topic").agg(F.count(F.lit(1)).alias("clusters"), F.avg("score").alias("avg_score"))


def source_summary(items: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Items and distinct keys per source; the distinct count is taken over
    (source, key) groups, not inside one task a source."""
    per_key = items.groupBy("source", key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("source").agg(F.sum("n").alias("items"), F.count(key).alias("distinct_keys"))


def top_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    return clusters.orderBy(F.desc_nulls_last("score"), "cluster_id").limit(n)


def score_distribution(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("score").agg(F.count(F.lit(1)).alias("clusters"))
