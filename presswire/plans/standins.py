"""The driver's tables read as news data, in Spark and in SQL.

The pipeline's own tables are not among the given ones, so documents stand in
for items, groups of four documents for stories, events for run-log rows, and
so on. Each stand-in is a projection of a whole given table; `SQL` holds the
same projection for the check engine.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import make_run_id
from ..functions.urls import cluster_id
from ..operators import cluster, edition, jobs
from ..operators.items import build_items
from ..session import configure

JOB_OF_EVENT = {"signup": "collector", "click": "silver", "view": "editor", "purchase": "site", "error": "archive"}

# white space as the check engine's patterns name it
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, dates and times as text, so engines agree."""
    def cast(name, kind):
        col = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            return col.cast("long").alias(name)
        if kind == "date":
            return col.cast("string").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind == "float":
            return col.cast("double").alias(name)
        return col

    return df.select(*[cast(n, k) for n, k in df.dtypes])


# --- items, stories, clusters -----------------------------------------------------

def doc_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as items; four consecutive ones report the same story."""
    docs = table(spark, sf, "documents")
    story = F.floor(F.col("doc_id") / 4)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.sqrt(story % 144)).cast("int"))
    midnight = F.unix_timestamp(day.cast("timestamp"))
    entries = docs.select(
        "doc_id", story.alias("story_no"), "lang", "n_chars", "source",
        F.lit("rss").alias("source_type"), F.lit("World").alias("topic_hint"),
        F.concat(F.lit("HTTPS://"), "source", F.lit(".Example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit("/?utm_source=feed&id="), F.col("doc_id").cast("string"), F.lit("#top")).alias("url"),
        F.substring("text", 1, 80).alias("title"), F.col("text").alias("body"),
        F.lit("").alias("author"),
        F.timestamp_seconds(midnight + F.col("doc_id") * 7919 % 86400).alias("published_at"),
        F.timestamp_seconds(midnight + 86399).alias("_fetched_at"),
    )
    return build_items(entries, F.lit("20240101T000000Z-0000"), F.col("_fetched_at")).drop("_fetched_at")


def members(items: DataFrame) -> DataFrame:
    """Items with the cluster of their story, seeded by its first item."""
    seeds = items.groupBy("ingest_date", "story_no").agg(F.min_by("item_id", F.struct("published_at", "item_id")).alias("_seed"))
    return items.join(seeds, ["ingest_date", "story_no"]).withColumn("cluster_id", cluster_id(F.col("_seed"))).drop("_seed")


def scored_clusters(spark: SparkSession, sf: str, member_rows: DataFrame) -> DataFrame:
    """Cluster rows with a topic by story and a score where a label exists."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    marks = member_rows.select("ingest_date", "cluster_id", "doc_id", "story_no", "n_chars").join(labels, "doc_id", "left").groupBy(
        "ingest_date", "cluster_id").agg(
        F.min("story_no").alias("story_no"),
        F.when(F.count("quality") > 0, F.sum("n_chars") % 10 + 1).cast("int").alias("score"))
    topic = F.get(F.array(*[F.lit(t) for t in C.TOPICS]), (F.col("story_no") % 11).cast("int"))
    return cluster.cluster_rows(member_rows).join(marks, ["ingest_date", "cluster_id"]).withColumn("topic", topic).withColumn(
        "rationale", F.concat(F.lit("story "), F.col("story_no").cast("string"))
    ).withColumn("confidence", F.lit(0.5)).withColumn("model_version", F.lit("m1")).withColumn(
        "prompt_version", F.lit("p1")).withColumn("scored_at", F.lit("2024-02-01").cast("timestamp"))


def day_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    items = doc_items(spark, sf)
    member_rows = members(items)
    clusters = scored_clusters(spark, sf, member_rows)
    return {"items": items, "members": member_rows, "clusters": clusters,
            "contexts": edition.build_contexts(clusters, member_rows)}


def edition_numbers(days: DataFrame) -> DataFrame:
    return edition.edition_numbers(days.select(F.col("ingest_date").alias("date")), days.sparkSession.createDataFrame([], "date date, edition_number int"))


def editions(spark: SparkSession, sf: str) -> DataFrame:
    """One edition of every day: selection by rank, then assembly; days with too
    few stories, or none in a section, become fallbacks."""
    t = day_tables(spark, sf)
    days = t["items"].select("ingest_date").distinct()
    return jobs.ranked_editions(t["items"], t["clusters"], t["contexts"], edition_numbers(days))


# --- run log ----------------------------------------------------------------------

def run_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    job = F.create_map(*[F.lit(x) for kv in JOB_OF_EVENT.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    n = F.col("event_id")
    metrics = F.concat(
        F.lit('{"_enrich": {"fetched": 1}, "src'), (F.col("user_id") % 5).cast("string"), F.lit('": {"errors": '),
        (k % 2).cast("string"), F.lit(', "items": '), k.cast("string"), F.lit(', "latency_ms": 5}}'))
    return e.select(
        make_run_id(ts, n).alias("run_id"), n.alias("event_id"), job.alias("job"), ts.alias("started_at"),
        F.timestamp_seconds(F.unix_timestamp(ts) + F.floor(F.col("value") * 10)).alias("ended_at"),
        F.when(n % 5 == 0, "failed").when(n % 5 == 1, "partial").otherwise("success").alias("status"),
        k.alias("items_in"), F.floor(k / 2).cast("int").alias("items_out"),
        F.when(n % 2 == 0, metrics).alias("adapter_metrics"),
        F.when(n % 3 != 0, F.col("value")).alias("ai_cost_estimate_usd"),
        F.when(n % 4 == 0, "late start; trigger=cron").when(n % 4 == 1, "trigger=").when(n % 4 == 3, "adapters failed: a").alias("notes"),
        F.to_date(ts).alias("run_date"),
        F.when(n % 7 == 0, '["editor_invalid_fallback", "no_items"]').when(n % 7 == 1, '["null_scores"]').when(n % 7 == 2, "not json").alias("reasons"),
    )


# --- the same in SQL --------------------------------------------------------------

_TOPICS = "[" + ", ".join(f"'{t}'" for t in C.TOPICS) + "]"
_SECTIONS = "[" + ", ".join(f"'{t}'" for t in C.SECTION_ORDER) + "]"

SQL = {
    "doc_items": f"""
      SELECT doc_id, story_no, lang, n_chars, source, ingest_date, published_at, url, canonical_url, title, body_excerpt,
             substr(sha256(canonical_url || strftime(published_at, '%Y-%m-%dT%H:%M:%SZ')), 1, 32) AS item_id
      FROM (SELECT doc_id, doc_id // 4 AS story_no, lang, n_chars, source,
              DATE '2024-01-01' + CAST(floor(sqrt((doc_id // 4) % 144)) AS INTEGER) AS ingest_date,
              CAST(DATE '2024-01-01' + CAST(floor(sqrt((doc_id // 4) % 144)) AS INTEGER) AS TIMESTAMP)
                + to_seconds(CAST(doc_id * 7919 % 86400 AS BIGINT)) AS published_at,
              'HTTPS://' || source || '.Example.com/' || lang || '/' || doc_id || '/?utm_source=feed&id=' || doc_id || '#top' AS url,
              'https://' || source || '.example.com/' || lang || '/' || doc_id || '?id=' || doc_id AS canonical_url,
              trim(regexp_replace(substr(text, 1, 80), '{WS}+', ' ', 'g')) AS title,
              substr(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 1, 1200) AS body_excerpt
            FROM documents)""",
    "members": """
      SELECT i.*, substr(sha256(first_value(item_id) OVER (PARTITION BY story_no ORDER BY published_at, item_id)), 1, 32) AS cluster_id
      FROM doc_items i""",
    "clusters": f"""
      SELECT m.ingest_date, m.cluster_id, min(story_no) AS story_no, count(*) AS member_count,
             arg_min(title, (published_at, item_id)) AS headline,
             regexp_replace(substr(arg_min(body_excerpt, (published_at, item_id)), 1, 500), '^{WS}+|{WS}+$', '', 'g') AS summary_seed,
             array_to_string(list_sort(list(DISTINCT source)), ',') AS source_names,
             CASE WHEN count(quality) > 0 THEN CAST(sum(n_chars) % 10 + 1 AS BIGINT) END AS score,
             ({_TOPICS})[CAST(min(story_no) % 11 AS INTEGER) + 1] AS topic
      FROM members m LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
    "contexts": """
      SELECT c.*, p.primary_url, p.primary_source, p.grounding_chars
      FROM clusters c JOIN (
        SELECT cluster_id, arg_min(canonical_url, (published_at, item_id)) AS primary_url,
               arg_min(source, (published_at, item_id)) AS primary_source,
               CAST(sum(length(trim(body_excerpt))) AS BIGINT) AS grounding_chars
        FROM members GROUP BY 1) p USING (cluster_id)
      WHERE score IS NOT NULL""",
    "types": """
      SELECT d.ingest_date, count(c.cluster_id) AS usable,
             CASE WHEN count(c.cluster_id) >= 12 THEN 'normal' WHEN count(c.cluster_id) >= 3 THEN 'quiet' ELSE 'fallback' END AS edition_type
      FROM (SELECT DISTINCT ingest_date FROM doc_items) d LEFT JOIN contexts c USING (ingest_date) GROUP BY 1""",
    "placed": f"""
      SELECT *, ({_SECTIONS})[list_position({_TOPICS}, topic)] AS section,
             CASE WHEN in_topic >= 2 THEN 'section' ELSE 'briefly' END AS placement,
             row_number() OVER (PARTITION BY ingest_date ORDER BY CASE WHEN in_topic >= 2 THEN 0 ELSE 1 END, list_position({_TOPICS}, topic), score DESC, cluster_id) AS position
      FROM (SELECT *, count(*) OVER (PARTITION BY ingest_date, topic) AS in_topic
            FROM (SELECT *, row_number() OVER (PARTITION BY ingest_date ORDER BY score DESC, cluster_id) AS day_rank
                  FROM (SELECT *, row_number() OVER (PARTITION BY ingest_date, topic ORDER BY score DESC, cluster_id) AS topic_rank
                        FROM contexts WHERE topic IS NOT NULL)
                  WHERE topic_rank <= 4)
            WHERE day_rank <= 20)""",
    "cards": """
      SELECT p.*, t.edition_type FROM placed p JOIN types t USING (ingest_date)
      WHERE placement = 'section' AND edition_type <> 'fallback'""",
    "edition_days": """
      SELECT ingest_date AS date, CASE WHEN ingest_date IN (SELECT ingest_date FROM cards) THEN edition_type ELSE 'fallback' END AS edition_type,
             row_number() OVER (ORDER BY ingest_date) AS edition_number FROM types""",
    "run_log": """
      SELECT strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 4) AS run_id, event_id,
             CASE event_type WHEN 'signup' THEN 'collector' WHEN 'click' THEN 'silver' WHEN 'view' THEN 'editor'
               WHEN 'purchase' THEN 'site' ELSE 'archive' END AS job,
             ts AS started_at, date_trunc('second', ts) + to_seconds(CAST(floor(value * 10) AS BIGINT)) AS ended_at,
             CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'partial' ELSE 'success' END AS status,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS items_in,
             CASE WHEN event_id % 3 <> 0 THEN value END AS ai_cost_estimate_usd,
             CASE event_id % 4 WHEN 0 THEN 'cron' WHEN 1 THEN 'unknown' ELSE 'unknown' END AS trigger,
             CAST(ts AS DATE) AS run_date, user_id,
             CASE event_id % 7 WHEN 0 THEN 'editor_invalid_fallback,no_items' WHEN 1 THEN 'null_scores' END AS reason_list
      FROM events""",
}

_NEEDS = {
    "members": ["doc_items"], "clusters": ["members"], "contexts": ["clusters"], "types": ["contexts", "doc_items"],
    "placed": ["contexts"], "cards": ["placed", "types"], "edition_days": ["types", "cards"],
}


def with_sql(query: str, *names: str) -> str:
    """A query with the stand-ins it reads put in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{name} AS MATERIALIZED ({SQL[name]})" for name in order)
    return f"WITH {head}\n{query}" if head else query
