"""The published edition record: schema, reading, writing, upserting."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strict import lone_object
from ..operators.ordering import first_rows
from ..session import written
from .tables import exists

# one superset for the normal, quiet and fallback shapes; a fallback has a
# notice and a ranked story list, the others have sections
EDITION_SCHEMA = """
date string, edition_number int, edition_type string,
headline_of_the_day string, headline_cluster_id string, headline_rationale string,
key_points array<struct<text: string, topic: string>>,
audio struct<url: string, duration_seconds: int, size_bytes: int>,
sections array<struct<name: string, stories: array<struct<
  cluster_id: string, slug: string, title: string, summary: string, score: int,
  sources: array<struct<name: string, url: string>>,
  article: struct<background: string, what_happened: string, why_it_matters: string,
    quote: struct<text: string, attribution: string, source_url: string>>>>>>,
briefly array<struct<cluster_id: string, title: string, url: string, topic: string>>,
stats struct<items_ingested: int, clusters_considered: int, stories_run: int, sources: int, sections_held: int>,
notice string,
stories array<struct<rank: int, title: string, score: int, url: string, source: string>>
"""

EDITIONS_TABLE = "date date, edition_number int, edition_type string, edition_json string"


def parse_edition(text: Column) -> Column:
    """The edition struct of a JSON text; NULL where it is not one JSON object."""
    return F.from_json(lone_object(text), EDITION_SCHEMA)


def read_editions(spark: SparkSession, path: str) -> DataFrame:
    """``gold.editions`` rows from one JSON file per date; unreadable files are
    left out."""
    return edition_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "edition_json"))


def edition_rows(texts: DataFrame) -> DataFrame:
    e = F.col("_e")
    return (
        texts.withColumn("_e", parse_edition(F.col("edition_json")))
        .select(
            e["date"].try_cast("date").alias("date"),
            e["edition_number"].alias("edition_number"),
            e["edition_type"].alias("edition_type"),
            "edition_json",
        )
        .where(F.col("date").isNotNull() & F.col("edition_number").isNotNull() & F.col("edition_type").isNotNull())
    )


def publishable(new: DataFrame, published: DataFrame) -> DataFrame:
    """Editions that may be written: a fallback never replaces a published
    normal or quiet edition of its date."""
    kept = published.where(F.col("edition_type").isin("normal", "quiet")).select(F.col("date").alias("_day"))
    blocked = (F.col("date") == F.col("_day")) & (F.col("edition_type") == "fallback")
    return new.join(kept, blocked, "left_anti")


def write_editions(editions: DataFrame, path: str) -> int:
    """Write editions (date, edition_number, edition_type, edition_json) as one file a date
    and say how many were. Of several of a date that with the highest number counts.

    A fallback never replaces a published normal or quiet edition; what is stored
    but cannot be read is no publication. Only the dates written are replaced, each
    at once when the job commits, so a run without editions keeps all there is and
    a second run of the same ones gives the same files.
    """
    spark = editions.sparkSession
    newest = first_rows(editions, ["date"], [F.desc("edition_number"), F.col("edition_type"), F.col("edition_json")])
    newest = newest.select(F.col("date").cast("date").alias("date"), "edition_number", "edition_type", "edition_json")
    if exists(spark, path):
        stored = spark.read.schema("value string, date date").text(path, wholetext=True).withColumnRenamed("value", "edition_json")
        stored = stored.join(newest.select("date"), "date", "left_semi").drop("date")
        newest = publishable(newest, edition_rows(stored))
    chosen = written(newest, "editions")  # read from the folder that is written to next
    count = chosen.count()
    chosen.select("edition_json", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").text(path)
    return count
