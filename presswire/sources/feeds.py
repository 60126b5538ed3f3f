"""Landed feed payloads to entries.

A payload is one fetched document as text. Every parser takes payload rows
(source, topic_hint, payload_no, payload) and returns entries with source,
source_type, topic_hint, url, title, body, author, published_at and position.
Entries that miss a title, a link or a readable date are dropped.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import parse_day, parse_epoch, parse_feed_date, parse_iso
from ..functions.text import strip_html
from ..session import written

PAYLOAD_SCHEMA = "source string, topic_hint string, payload_no long, payload string"


def _entries(payloads: DataFrame, values: Column, source_type: str, title: Column, url: Column, body: Column,
             author: Column, published_at: Column, keep: Column | None = None) -> DataFrame:
    """Explode the entry list of each payload (as ``e``) and pick its fields."""
    rows = payloads.select("source", "topic_hint", "payload_no", F.posexplode(values).alias("_pos", "e"))
    if keep is not None:
        rows = rows.where(keep)
    picked = rows.select(
        "source", F.lit(source_type).alias("source_type"), "topic_hint",
        url.alias("url"), title.alias("title"), body.alias("_body"),
        F.when(author != "", author).alias("author"),
        published_at.alias("published_at"),
        F.struct("payload_no", F.col("_pos").alias("entry")).alias("position"),
    ).where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "") & F.col("published_at").isNotNull())
    # decoded last, so entries that are dropped cost nothing
    decoded = strip_html(F.col("_body")) if source_type != "json" else F.coalesce("_body", F.lit(""))
    return picked.withColumn("body", decoded).drop("_body")


def item_api(payloads: DataFrame) -> DataFrame:
    """One JSON item per payload; live stories only. A story without a link
    points at its discussion page."""
    item = F.from_json("payload", "id long, type string, by string, time string, title string, url string, text string, dead boolean, deleted boolean")
    e = F.col("e")
    live = (e["type"] == "story") & ~F.coalesce(e["dead"], F.lit(False)) & ~F.coalesce(e["deleted"], F.lit(False))
    link = F.coalesce(F.nullif(e["url"], F.lit("")), F.concat(F.lit(C.DISCUSSION_PAGE), e["id"].cast("string")))
    return _entries(payloads, F.array(item), "api", e["title"], link, e["text"], e["by"], parse_epoch(e["time"]), live)


_RSS = "channel struct<item: array<struct<title: string, link: string, description: string, `dc:creator`: string, author: string, pubDate: string, updated: string>>>"
_ATOM = ("entry array<struct<title: string, id: string, link: array<struct<_href: string, _rel: string, _VALUE: string>>, "
         "published: string, updated: string, summary: string, content: string, author: array<struct<name: string>>>>")


def rss(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    items = F.from_xml("payload", _RSS)["channel"]["item"]
    when = F.coalesce(parse_feed_date(e["pubDate"]), parse_feed_date(e["updated"]))
    return _entries(payloads, items, "rss", F.trim(e["title"]), F.trim(e["link"]), e["description"], F.coalesce(e["dc:creator"], e["author"]), when)


def atom(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    entries = F.from_xml("payload", _ATOM)["entry"]
    main = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    when = F.coalesce(parse_feed_date(e["published"]), parse_feed_date(e["updated"]))
    body = F.coalesce(e["summary"], e["content"])
    return _entries(payloads, entries, "api", F.trim(e["title"]), F.get(main, F.lit(0))["_href"], body,
                    F.get(e["author"], F.lit(0))["name"], when)


def documents_json(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    results = F.from_json("payload", "results array<struct<title: string, html_url: string, publication_date: string, abstract: string, agencies: array<struct<name: string>>>>")["results"]
    return _entries(payloads, results, "json", e["title"], e["html_url"], e["abstract"],
                    F.get(e["agencies"], F.lit(0))["name"], parse_day(e["publication_date"]))


def headlines_json(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    articles = F.from_json("payload", "articles array<struct<title: string, url: string, publishedAt: string, description: string, content: string, author: string>>")["articles"]
    body = F.coalesce(F.nullif(e["description"], F.lit("")), e["content"])
    return _entries(payloads, articles, "json", e["title"], e["url"], body, e["author"], parse_iso(e["publishedAt"]))


def market_news_json(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    news = F.from_json("payload", "array<struct<headline: string, url: string, datetime: string, summary: string, source: string>>")
    return _entries(payloads, news, "json", e["headline"], e["url"], e["summary"], e["source"], parse_epoch(e["datetime"]))


def releases_json(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    releases = F.from_json("payload", "releases array<struct<id: string, realtime_start: string, name: string, link: string>>")["releases"]
    link = F.coalesce(F.nullif(e["link"], F.lit("")), F.concat(F.lit(C.RELEASE_PAGE), e["id"]))
    return _entries(payloads, releases, "json", e["name"], link, F.lit(None).cast("string"), F.lit(None).cast("string"), parse_day(e["realtime_start"]))


_BROKEN = {  # whether a payload of the format holds no list of entries, or no item
    "item_api": lambda: F.get_json_object("payload", "$.id").isNull(),
    "rss": lambda: F.coalesce(~F.col("payload").rlike(r"(?s)<channel[\s>].*</channel\s*>"), F.lit(True)),
    "atom": lambda: F.coalesce(~F.col("payload").rlike(r"(?s)<feed[\s>].*</feed\s*>"), F.lit(True)),
    "documents_json": lambda: F.json_array_length(F.get_json_object("payload", "$.results")).isNull(),
    "headlines_json": lambda: F.json_array_length(F.get_json_object("payload", "$.articles")).isNull(),
    "market_news_json": lambda: F.json_array_length("payload").isNull(),
    "releases_json": lambda: F.json_array_length(F.get_json_object("payload", "$.releases")).isNull(),
}

PARSERS = {
    "item_api": item_api, "rss": rss, "atom": atom, "documents_json": documents_json,
    "headlines_json": headlines_json, "market_news_json": market_news_json, "releases_json": releases_json,
}


# --- the registry -----------------------------------------------------------------

def check_registry(registry: list[dict]) -> list[dict]:
    """The enabled sources of a registry; names must be unique, formats known."""
    names = [s["name"] for s in registry]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if doubled:
        raise ValueError(f"duplicate source names: {doubled}")
    unknown = sorted({s["format"] for s in registry} - set(PARSERS))
    if unknown:
        raise ValueError(f"unknown formats: {unknown}")
    if any(s["max_items_per_run"] <= 0 for s in registry):
        raise ValueError("max_items_per_run must be above zero")
    return [s for s in registry if s.get("enabled", True)]


def caps(registry: list[dict]) -> dict[str, int]:
    return {s["name"]: s["max_items_per_run"] for s in check_registry(registry)}


def read_payloads(spark: SparkSession, source: dict) -> tuple[DataFrame, DataFrame]:
    """Landed files of one source as payloads, one a file and numbered by its path, and the
    paths of those files that could not be read when their turn came."""
    name, hint = F.lit(source["name"]).alias("source"), F.lit(source["topic_hint"]).alias("topic_hint")
    files = spark.read.option("ignoreCorruptFiles", "true").text(source["path"], wholetext=True, recursiveFileLookup=True)
    payloads = files.select(name, hint, F.col("_metadata.file_path").alias("payload_no"), F.col("value").alias("payload"))
    # a listing opens no file
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source["path"]).where("length > 0")
    found = payloads.select("payload_no").distinct()
    lost = listed.select(name, F.col("path").alias("payload_no"), _plain_path(F.col("path")).alias("_p")).join(
        found.select(_plain_path(F.col("payload_no")).alias("_p")), "_p", "left_anti").drop("_p")
    return payloads, lost


def _plain_path(path: Column) -> Column:
    """A path as listings and file metadata both write it: without escapes, one slash after the scheme."""
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), "^([a-z]+):/+", "$1:/")


def collect(spark: SparkSession, registry: list[dict]) -> tuple[DataFrame, DataFrame]:
    """``(entries, errors)`` over every enabled source of the registry.

    A source without its folder, a file that cannot be read, and a payload that is
    no document of its format each give a row ``(source, error, payload_no)`` of
    errors and never fail the others.
    """
    batches, errors, missing = [], [], []
    for source in check_registry(registry):
        try:
            payloads, lost = read_payloads(spark, source)
        except AnalysisException as error:
            missing.append((source["name"], error.getCondition() or type(error).__name__, None))
            continue
        payloads = written(payloads, "payloads", compression="zstd")
        broken = payloads.where(_BROKEN[source["format"]]())
        batches.append(PARSERS[source["format"]](payloads))
        errors += [lost.select("source", F.lit("UNREADABLE_FILE").alias("error"), "payload_no"),
                   broken.select("source", F.lit("BROKEN_PAYLOAD").alias("error"), "payload_no")]
    failed = reduce(DataFrame.unionByName, errors, spark.createDataFrame(missing, "source string, error string, payload_no string"))
    if not batches:
        empty = spark.createDataFrame([], PAYLOAD_SCHEMA.replace("payload_no long", "payload_no string"))
        return rss(empty), failed
    return reduce(DataFrame.unionByName, batches), failed


def collect_payloads(payloads: DataFrame, registry: list[dict]) -> DataFrame:
    """The same over one payload table that holds every source."""
    by_format: dict[str, list[str]] = {}
    for source in check_registry(registry):
        by_format.setdefault(source["format"], []).append(source["name"])
    parts = [PARSERS[kind](payloads.where(F.col("source").isin(names))) for kind, names in by_format.items()]
    return reduce(DataFrame.unionByName, parts)
