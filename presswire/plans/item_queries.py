"""Registered queries over items: scalars, sources, dedup, enrichment, tables."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import dates, text, urls
from ..operators import enrich, items, waitlist
from ..operators.edition import unique_slugs as number_slugs
from ..session import scratch_path
from ..sources import feeds, tables
from ..streaming import ingest
from .standins import WS, doc_items, plain, table, with_sql

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


# --- scalars ----------------------------------------------------------------------

_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_KEPT = r"""list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
  lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|(fbclid|gclid|msclkid|igshid|mc_cid|mc_eid)(=|$))'))"""
_CLEAN = rf"""lower(regexp_extract(url, '^([^:]+):', 1)) || '://' || lower({_HOST})
  || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '')
  || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END"""


@query("clean_url", f"SELECT page_id, {_CLEAN} AS canonical_url, lower({_HOST}) AS host FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.clean_url(F.col("url")).alias("canonical_url"), urls.host_of(F.col("url")).alias("host"))


@query("item_ids", f"""SELECT page_id, substr(sha256({_CLEAN} || strftime(TIMESTAMP '2024-01-01' + to_hours(page_id), '%Y-%m-%dT%H:%M:%SZ')), 1, 32) AS item_id FROM pages""")
def _(spark, sf):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600)
    return table(spark, sf, "pages").select("page_id", urls.make_item_id(urls.clean_url(F.col("url")), at).alias("item_id"))


@query("resolve_redirects", f"""
  WITH RECURSIVE hops AS (
    SELECT 'https://t.co/' || page_id AS from_url, CASE WHEN page_id % 7 = 0 THEN url ELSE 'https://t.co/' || (page_id + 1) END AS to_url FROM pages),
  walk AS (
    SELECT page_id, 'https://t.co/' || page_id AS here, 0 AS n FROM pages
    UNION ALL SELECT w.page_id, h.to_url, n + 1 FROM walk w JOIN hops h ON w.here = h.from_url WHERE n < 5),
  ended AS (SELECT page_id, max(n) AS n, arg_max(here, n) AS url FROM walk GROUP BY 1)
  SELECT page_id, CASE WHEN n >= 5 THEN 'https://t.co/' || page_id WHEN url LIKE 'https://t.co/%' THEN url ELSE {_CLEAN} END AS canonical_url FROM ended""")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    short = F.concat(F.lit("https://t.co/"), F.col("page_id").cast("string"))
    onward = F.concat(F.lit("https://t.co/"), (F.col("page_id") + 1).cast("string"))
    hops = pages.select(short.alias("from_url"), F.when(F.col("page_id") % 7 == 0, F.col("url")).otherwise(onward).alias("to_url"))
    asked = pages.select("page_id", F.concat(short, F.lit("/#x")).alias("link"))
    return items.resolve_redirects(asked, hops, "link", "canonical_url").select("page_id", "canonical_url")


@query("excerpts", f"""SELECT doc_id, md5(substr(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 1, 1200)) AS excerpt_md5,
  length(substr(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 1, 1200)) AS chars FROM documents""")
def _(spark, sf):
    ex = text.excerpt(F.col("text"))
    return plain(table(spark, sf, "documents").select("doc_id", F.md5(ex).alias("excerpt_md5"), F.length(ex).alias("chars")))


# the entities the given pages hold; the ampersand last, as decoding is one pass
_AMP = """regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')"""


@query("strip_html", f"""SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM (
  SELECT page_id, {_AMP.format("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS t FROM pages)""")
def _(spark, sf):
    stripped = table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return plain(stripped.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars")))


@query("build_items", with_sql("""SELECT doc_id, item_id, url, canonical_url, title, md5(body_excerpt) AS body_md5, CAST(NULL AS VARCHAR) AS author,
  strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at, CAST(ingest_date AS VARCHAR) AS ingest_date FROM doc_items""", "doc_items"))
def _(spark, sf):
    return plain(doc_items(spark, sf).select("doc_id", "item_id", "url", "canonical_url", "title", F.md5("body_excerpt").alias("body_md5"),
                                             "author", "published_at", "ingest_date"))


@query("parse_dates", """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 5 THEN NULL
  ELSE strftime(CASE o_orderkey % 10 WHEN 2 THEN CAST(o_orderdate AS DATE) WHEN 4 THEN o_orderdate + INTERVAL 5 HOUR WHEN 8 THEN CAST(o_orderdate AS DATE) ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') END AS published_at FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    kind = F.col("o_orderkey") % 10
    # every form feeds use, by the order's number
    forms = {0: "EEE, dd MMM yyyy HH:mm:ss 'GMT'", 1: "yyyy-MM-dd'T'HH:mm:ss'Z'", 2: "yyyy-MM-dd", 4: "d MMM yyyy HH:mm:ss 'EST'",
             6: "EEEE, dd-MMM-yy HH:mm:ss 'GMT'", 7: "EEE MMM  d HH:mm:ss yyyy", 8: "MMMM d, yyyy", 9: "yyyy/MM/dd HH:mm:ss"}
    raw = F.when(kind == 3, F.unix_timestamp(d).cast("string"))
    for k, form in forms.items():
        raw = raw.when(kind == k, F.date_format(d, form))
    raw = raw.otherwise("soon")
    parsed = F.when(kind == 3, dates.parse_epoch(raw)).when(kind == 2, dates.parse_day(raw)).otherwise(dates.parse_feed_date(raw))
    return plain(table(spark, sf, "orders").select("o_orderkey", parsed.alias("published_at")))


@query("run_ids", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(md5(CAST(event_id AS VARCHAR)), 1, 4) AS run_id FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.make_run_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("run_id"))


def _slug_sql(expr):
    base = f"trim(regexp_replace(replace(lower({expr}), 'ß', 'ss'), '[^a-z0-9]+', '-', 'g'), '-')"
    cut = f"trim(regexp_replace(substr({base}, 1, 60), '-[^-]*$', ''), '-')"
    return f"CASE WHEN length({base}) > 60 THEN coalesce(nullif({cut}, ''), 'story') WHEN {base} = '' THEN 'story' ELSE {base} END"


@query("slugify", f"SELECT doc_id, {_slug_sql('text')} AS slug FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("unique_slugs", f"""SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (
  SELECT doc_id, base, row_number() OVER (PARTITION BY lang, base ORDER BY doc_id) AS n FROM (
    SELECT doc_id, lang, {_slug_sql('text')} AS base FROM documents))""")
def _(spark, sf):
    titles = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("title"))
    return number_slugs(titles, "lang", "doc_id", width=100_000).select("doc_id", "slug")


@query("date_labels", """SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS long_date, strftime(o_orderdate, '%b %-d') AS short_date,
  strftime(o_orderdate, '%B %Y') AS month, strftime(o_orderdate, '/%Y/%m/%d/') AS path,
  strftime(o_orderdate, '%a, %d %b %Y 10:00:00 GMT') AS feed_date,
  CAST(CAST(floor(o_totalprice) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS duration,
  CAST(greatest(15, CAST(floor((o_orderkey % 9) * 12 / 15 + 0.5) AS BIGINT) * 15) AS VARCHAR) || '-second read' AS read_time,
  trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS topic FROM orders""")
def _(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.date_long(d).alias("long_date"), dates.date_short(d).alias("short_date"), dates.month_heading(d).alias("month"),
        dates.permalink(d).alias("path"), dates.feed_date(d).alias("feed_date"), dates.duration(F.floor("o_totalprice")).alias("duration"),
        dates.read_time(F.col("o_orderkey") % 9).alias("read_time"), text.topic_slug(F.col("o_orderpriority")).alias("topic"))


# one address shape per customer number modulo eight; {n} is the name
_MAIL_SHAPES = ["  {n}@Mail.Example.com ", "{n}@example", "a b{n}@example.com", "{n}@@example.com",
                "{n}@.example.com", "{n}@ex..ample.com", "{n}@example.org", "@example.com"]


def _mail():
    kind, name = F.col("c_custkey") % 8, F.replace(F.col("c_name"), F.lit("#"), F.lit("."))
    out = F.lit(None).cast("string")
    for k, shape in enumerate(_MAIL_SHAPES):
        out = F.when(kind == k, F.replace(F.lit(shape), F.lit("{n}"), name)).otherwise(out)
    return out


_MAIL_SQL = """CASE c_custkey % 8 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@mail.example.com'
  WHEN 6 THEN lower(replace(c_name, '#', '.')) || '@example.org' END"""


@query("normalize_email", f"SELECT c_custkey, {_MAIL_SQL} AS email FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.normalize_email(_mail()).alias("email"))


@query("embed_text", with_sql(f"""SELECT doc_id, md5(CASE WHEN b = '' THEN title ELSE title || chr(10) || b END) AS text_md5 FROM (
  SELECT doc_id, title, regexp_replace(CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(body_excerpt, 1, 500) END, '^{WS}+|{WS}+$', '', 'g') AS b FROM doc_items)""", "doc_items"))
def _(spark, sf):
    body = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("body_excerpt"))
    return doc_items(spark, sf).select("doc_id", F.md5(text.embed_text(F.col("title"), body)).alias("text_md5"))


@query("match_text", with_sql("""SELECT cluster_id, md5(CASE WHEN coalesce(s, '') = '' THEN headline ELSE headline || chr(10) || s END) AS text_md5 FROM (
  SELECT cluster_id, headline, CASE WHEN member_count % 2 = 0 THEN summary_seed END AS s FROM clusters)""", "clusters"))
def _(spark, sf):
    from .standins import day_tables

    rows = day_tables(spark, sf)["clusters"].withColumn("told", F.when(F.col("member_count") % 2 == 0, F.col("summary_seed")))
    return rows.select("cluster_id", F.md5(text.match_text(F.col("headline"), F.col("told"))).alias("text_md5"))


# --- enrichment -------------------------------------------------------------------

@query("should_fetch", with_sql("""SELECT doc_id, length(trim(body_excerpt)) < 600 AND canonical_url LIKE 'http%' AND source NOT IN ('src3', 'src4') AS fetch FROM doc_items""", "doc_items"))
def _(spark, sf):
    skip = ["src3.example.com", "src4.example.com"]
    return doc_items(spark, sf).select("doc_id", enrich.should_fetch(F.col("body_excerpt"), F.col("canonical_url"), skip_hosts=skip).alias("fetch"))


_BODY = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')"
_MAIN = rf"""array_to_string(list_filter(list_transform(regexp_extract_all({_BODY}, '(?is)<p[^>]*>(.*?)</p>', 1),
  lambda b: trim(regexp_replace({_AMP.format("regexp_replace(b, '<[^>]+>', ' ', 'g')")}, '{WS}+', ' ', 'g'))), lambda p: p <> ''), ' ')"""


@query("main_text", f"SELECT page_id, md5(t) AS text_md5, length(t) AS chars FROM (SELECT page_id, {_MAIN} AS t FROM pages)")
def _(spark, sf):
    main = table(spark, sf, "pages").select("page_id", text.main_text(F.col("html")).alias("t"))
    return plain(main.select("page_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars")))


def _thin_items(spark, sf):
    pages = table(spark, sf, "pages")
    return pages, pages.select(F.col("page_id").alias("item"), urls.clean_url(F.col("url")).alias("canonical_url"),
                               F.repeat(F.lit("x"), (F.col("page_id") * 7 % 900).cast("int")).alias("body_excerpt"))


_ENRICH = f"""
  WITH texts AS MATERIALIZED (SELECT {_CLEAN} AS u, min(page_id) AS first_page, arg_min(substr({_MAIN}, 1, 1200), page_id) AS t FROM pages GROUP BY 1),
  joined AS (SELECT page_id AS item, page_id * 7 % 900 AS had, page_id * 7 % 900 < 600 AS fetched, t FROM pages JOIN texts ON u = {_CLEAN}),
  out AS (SELECT item, fetched, fetched AND length(t) > had AS enriched, CASE WHEN fetched AND length(t) > had THEN length(t) - had ELSE 0 END AS chars_added,
    md5(CASE WHEN fetched AND length(t) > had THEN t ELSE repeat('x', CAST(had AS INTEGER)) END) AS body_md5 FROM joined)
"""


@query("enrich_items", _ENRICH + "SELECT * FROM out")
def _(spark, sf):
    pages, thin = _thin_items(spark, sf)
    return plain(enrich.enrich_items(thin, pages).select("item", F.md5("body_excerpt").alias("body_md5"), "fetched", "enriched", "chars_added"))


@query("enrich_metrics", _ENRICH + """SELECT count(*) AS considered, count(*) FILTER (fetched) AS fetched, count(*) FILTER (enriched) AS enriched,
  CAST(sum(chars_added) AS BIGINT) AS chars_added FROM out""")
def _(spark, sf):
    pages, thin = _thin_items(spark, sf)
    return plain(enrich.enrich_metrics(enrich.enrich_items(thin, pages)))


@query("groundable", with_sql("""SELECT story_no, CAST(sum(length(trim(body_excerpt))) AS BIGINT) AS grounding_chars,
  sum(length(trim(body_excerpt))) >= 400 AS groundable FROM doc_items GROUP BY 1""", "doc_items"))
def _(spark, sf):
    return enrich.groundable(doc_items(spark, sf), ["story_no"])


@query("body_coverage", with_sql("""SELECT source, count(*) AS items, count(*) FILTER (b = '') AS empty_bodies, round(avg(length(b)), 6) AS avg_chars
  FROM (SELECT source, CASE WHEN doc_id % 4 = 0 THEN '' ELSE body_excerpt END AS b FROM doc_items) GROUP BY 1""", "doc_items"))
def _(spark, sf):
    rows = doc_items(spark, sf).withColumn("body_excerpt", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("body_excerpt")))
    return enrich.body_coverage(rows).withColumn("avg_chars", F.round("avg_chars", 6))


# --- dedup, appends, merges -------------------------------------------------------

def _repeating(spark, sf):
    docs = table(spark, sf, "documents")
    story = F.floor(F.col("doc_id") / 4)
    return docs.select(
        "doc_id", F.md5(F.concat_ws("|", "lang", F.col("n_chars") % 30, F.col("doc_id") % 5)).alias("item_id"),
        F.md5(F.concat_ws("|", "lang", F.col("n_chars") % 10)).alias("canonical_url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars") % 30 * 3600).alias("published_at"),
        F.date_add(F.lit("2024-01-01").cast("date"), (story % 6).cast("int")).alias("ingest_date"), "source")


_REPEATING = """rep AS (SELECT doc_id, md5(lang || '|' || n_chars % 30 || '|' || doc_id % 5) AS item_id, md5(lang || '|' || n_chars % 10) AS canonical_url,
  TIMESTAMP '2024-01-01' + to_hours(n_chars % 30) AS published_at, DATE '2024-01-01' + CAST((doc_id // 4) % 6 AS INTEGER) AS ingest_date, source FROM documents)"""


@query("dedup_two_pass", f"""WITH {_REPEATING},
  by_id AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY published_at, ingest_date, source) = 1)
  SELECT item_id, canonical_url, CAST(ingest_date AS VARCHAR) AS ingest_date FROM by_id
  QUALIFY row_number() OVER (PARTITION BY ingest_date, canonical_url ORDER BY published_at, item_id) = 1""")
def _(spark, sf):
    return plain(items.dedup(_repeating(spark, sf)).select("item_id", "canonical_url", "ingest_date"))


@query("new_items", f"""WITH {_REPEATING}, batch AS (SELECT * FROM rep WHERE doc_id % 3 <> 0 AND ingest_date < DATE '2024-01-05'),
  stored AS (SELECT * FROM rep WHERE doc_id % 3 = 0),
  firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) = 1)
  SELECT doc_id, item_id, CAST(ingest_date AS VARCHAR) AS ingest_date FROM firsts
  WHERE item_id NOT IN (SELECT item_id FROM stored WHERE ingest_date IN (SELECT ingest_date FROM firsts))""")
def _(spark, sf):
    rows = _repeating(spark, sf)
    batch = rows.where((F.col("doc_id") % 3 != 0) & (F.col("ingest_date") < "2024-01-05"))
    return plain(tables.new_rows(batch, rows.where(F.col("doc_id") % 3 == 0), position="doc_id").select("doc_id", "item_id", "ingest_date"))


@query("append_items_twice", f"""WITH {_REPEATING} SELECT count(DISTINCT item_id) AS first_written, count(*) - count(DISTINCT item_id) AS first_skipped,
  0 AS second_written, count(*) AS second_skipped, count(DISTINCT item_id) AS stored FROM rep""")
def _(spark, sf):
    rows = _repeating(spark, sf).withColumn("ingest_date", F.lit("2024-01-01").cast("date"))
    schema = "doc_id long, item_id string, canonical_url string, published_at timestamp, source string, ingest_date date"
    path = scratch_path(spark, "items")
    first = tables.append_items(rows, path, schema, position="doc_id")
    second = tables.append_items(rows, path, schema, position="doc_id")
    stored = tables.read_table(spark, path, schema)
    return stored.agg(F.lit(first[0]).cast("long").alias("first_written"), F.lit(first[1]).cast("long").alias("first_skipped"),
                      F.lit(second[0]).cast("long").alias("second_written"), F.lit(second[1]).cast("long").alias("second_skipped"),
                      F.count(F.lit(1)).alias("stored"))


_ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date"


def _order_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))


@query("overwrite_days", """SELECT CAST(d AS VARCHAR) AS d, count(*) AS orders, round(sum(CASE WHEN month(d) = 2 THEN o_totalprice * 2 ELSE o_totalprice END), 2) AS total
  FROM (SELECT date_trunc('month', o_orderdate)::DATE AS d, o_totalprice, o_orderkey FROM orders) WHERE month(d) <> 2 OR o_orderkey % 2 = 0 GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "days")
    schema = "o_orderkey long, o_totalprice double, d date"
    rows = _order_rows(spark, sf).select("o_orderkey", "o_totalprice", F.trunc("o_orderdate", "month").alias("d"))
    tables.overwrite_days(rows, path, "d")
    # February again, from the table itself, with half the rows at twice the price
    again = tables.read_table(spark, path, schema, partition="d").where((F.month("d") == 2) & (F.col("o_orderkey") % 2 == 0))
    tables.overwrite_days(again.withColumn("o_totalprice", F.col("o_totalprice") * 2), path, "d")
    tables.overwrite_days(rows.where("false"), path, "d")
    return plain(tables.read_table(spark, path, schema, partition="d").groupBy("d").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("upsert_months", """WITH ends AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
    CASE WHEN o_orderkey % 10 >= 8 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders)
  SELECT month, count(*) AS orders, round(sum(price), 2) AS total,
    (SELECT count(*) FILTER (o_orderkey % 10 = 9) FROM orders) AS added FROM ends GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "months")
    rows = _order_rows(spark, sf)
    tables.upsert_months(rows.where(F.col("o_orderkey") % 10 != 9), path, _ORDERS, "o_orderdate", ["o_orderkey"])
    late = rows.where(F.col("o_orderkey") % 10 >= 8).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    added = tables.upsert_months(late, path, _ORDERS, "o_orderdate", ["o_orderkey"])
    stored = tables.read_table(spark, path, _ORDERS + ", month string", partition="month")
    return stored.groupBy("month").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                                       F.lit(added).cast("long").alias("added"))


@query("merge_by_key", """SELECT o_custkey, max(o_orderkey) FILTER (o_orderkey % 2 = 1) IS NOT NULL AS replaced,
  coalesce(arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 2 = 1), arg_max(o_totalprice, o_orderkey)) AS price FROM orders GROUP BY 1""")
def _(spark, sf):
    rows = _order_rows(spark, sf)
    latest = items.first_rows(rows.where("o_orderkey % 2 = 0"), ["o_custkey"], [F.desc("o_orderkey")])
    merged = tables.merge_by_key(latest, rows.where("o_orderkey % 2 = 1"), ["o_custkey"], F.col("o_orderkey"))
    return merged.select("o_custkey", (F.col("o_orderkey") % 2 == 1).alias("replaced"), F.col("o_totalprice").alias("price"))


@query("archive_day", with_sql("""SELECT 'gold_items' AS name, count(*) AS gold, 0 AS daily FROM doc_items WHERE ingest_date IN (DATE '2024-01-06', DATE '2024-01-07')
  UNION ALL SELECT 'gold_clusters', count(*), 0 FROM clusters WHERE ingest_date IN (DATE '2024-01-06', DATE '2024-01-07')
  UNION ALL SELECT 'gold_editions', count(*), 0 FROM types WHERE ingest_date = DATE '2024-01-06' UNION ALL SELECT 'missing_editions', 1, 0
  UNION ALL SELECT 'left', 0, count(*) FROM doc_items WHERE ingest_date NOT IN (DATE '2024-01-06', DATE '2024-01-07')""", "doc_items", "clusters", "types"))
def _(spark, sf):
    from datetime import date

    from ..operators.items import ITEM_SCHEMA, ITEM_COLUMNS
    from .standins import members, scored_clusters

    base = scratch_path(spark, "lake")
    paths = {k: f"{base}/{k}" for k in ("items", "clusters", "gold_items", "gold_clusters", "gold_editions")}
    schemas = {"items": ITEM_SCHEMA, "clusters": "cluster_id string, headline string, member_count int, sources array<string>, score int, topic string, ingest_date date",
               "editions": "date date, edition_number int, edition_type string, edition_json string"}
    rows = doc_items(spark, sf)
    rows.select(*ITEM_COLUMNS).write.partitionBy("ingest_date").parquet(paths["items"])
    names = [p.split()[0] for p in schemas["clusters"].split(", ")]
    scored_clusters(spark, sf, members(rows)).select(*names).write.partitionBy("ingest_date").parquet(paths["clusters"])
    # an edition of every day but the 7th, whose archive run has to say so
    days = rows.where("ingest_date <> '2024-01-07'").groupBy(F.col("ingest_date").alias("date")).agg(F.count(F.lit(1)).cast("int").alias("edition_number"))
    text_of = F.to_json(F.struct(F.col("date").cast("string").alias("date"), "edition_number", F.lit("quiet").alias("edition_type")))
    published = days.select("date", "edition_number", F.lit("quiet").alias("edition_type"), text_of.alias("edition_json"))
    runs = [tables.archive_day(spark, day, paths, schemas, published) for _ in range(2) for day in (date(2024, 1, 6), date(2024, 1, 7))]
    # of each day the first run counts; the second finds nothing and changes nothing
    missing = sum(r["edition_missing"] for r in runs[:2])
    gold = [tables.read_table(spark, paths[k], schemas[k[5:]] + ", month string").agg(
        F.lit(k).alias("name"), F.count(F.lit(1)).alias("gold"), F.lit(0).cast("long").alias("daily")) for k in ("gold_items", "gold_clusters", "gold_editions")]
    left = tables.read_table(spark, paths["items"], schemas["items"]).agg(F.lit("left").alias("name"), F.lit(0).cast("long").alias("gold"), F.count(F.lit(1)).alias("daily"))
    told = spark.range(1).select(F.lit("missing_editions").alias("name"), F.lit(missing).cast("long").alias("gold"), F.lit(0).cast("long").alias("daily"))
    return gold[0].unionByName(gold[1]).unionByName(gold[2]).unionByName(left).unionByName(told)


@query("partition_scan", with_sql("""SELECT item_id, title, CAST(ingest_date AS VARCHAR) AS ingest_date FROM doc_items
  WHERE ingest_date >= DATE '2024-01-03' AND ingest_date < DATE '2024-01-06'""", "doc_items"))
def _(spark, sf):
    from datetime import date

    path = scratch_path(spark, "scan")
    doc_items(spark, sf).select(*items.ITEM_COLUMNS).write.partitionBy("ingest_date").parquet(path)
    return plain(tables.read_table(spark, path, items.ITEM_SCHEMA, start=date(2024, 1, 3), end=date(2024, 1, 6), columns=["item_id", "title", "ingest_date"]))


@query("table_peek", f"""SELECT doc_id, source, lang, CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS t
  FROM (SELECT doc_id, source, lang, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS t FROM documents) ORDER BY doc_id LIMIT 10""")
def _(spark, sf):
    return tables.peek(table(spark, sf, "documents").select("doc_id", "source", "lang", text.collapse(F.col("text")).alias("t")), 10, ["doc_id"])


@query("capped_feed", """SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents
  WHERE doc_id % 24 >= 6 AND source IN ('src0', 'src1', 'src2')) WHERE n <= CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 8 ELSE 2000 END""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.timestamp_seconds(F.col("doc_id") % 24 * 3600).alias("published_at"))
    since = F.timestamp_seconds(F.lit(6 * 3600))
    return items.since_and_cap(rows, since, {"src0": 5, "src1": 8, "src2": 2000}, position="doc_id").select("doc_id")


@query("union_items", """SELECT source, count(*) AS items FROM (SELECT source FROM documents UNION ALL SELECT 'pages' FROM pages) GROUP BY 1""")
def _(spark, sf):
    a = table(spark, sf, "documents").select("source", F.col("text").alias("body"))
    b = table(spark, sf, "pages").select(F.lit("pages").alias("source"), "url")
    return items.union_items(a, b).groupBy("source").agg(F.count(F.lit(1)).alias("items"))


# --- feeds ------------------------------------------------------------------------

def _payloads(rows, source, value, shape, per=50):
    """Fold rows (with a number `n`) into payload documents of `per` entries."""
    grouped = rows.groupBy(F.floor(F.col("n") / per).alias("payload_no")).agg(F.array_sort(F.collect_list(F.struct("n", value.alias("v")))).alias("_l"))
    return grouped.select(F.lit(source).alias("source"), F.lit("World").alias("topic_hint"), "payload_no",
                          shape(F.transform("_l", lambda x: x["v"])).alias("payload"))


def _stamp(fmt):
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("n") * 60), fmt)


def _numbered(spark, sf):
    words = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("n"), words.alias("w"), "lang", "source", "text")


_WORDS = r"trim(regexp_replace(text, '[^\p{L}]+', ' ', 'g'))"
_WHEN = "strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d 00:00:00')"


def _out(entries):
    return plain(entries.select("url", "title", "body", "author", "published_at", "source_type", "position.payload_no", "position.entry"))


@query("read_item_api", f"""SELECT CASE WHEN doc_id % 4 = 0 THEN '{C.DISCUSSION_PAGE}' || doc_id ELSE 'http://a.example.com/' || doc_id END AS url, {_WORDS} AS title,
  ' ' || {_WORDS} || ' & more' AS body, lang AS author, {_WHEN} AS published_at, 'api' AS source_type, doc_id AS payload_no, 0 AS entry FROM documents
  WHERE doc_id % 5 <> 1 AND doc_id % 7 <> 1 AND doc_id % 11 <> 1 AND {_WORDS} <> ''""")
def _(spark, sf):
    d = _numbered(spark, sf)
    n = F.col("n")
    item = F.struct(
        n.alias("id"), F.when(n % 5 == 1, "comment").otherwise("story").alias("type"), F.col("lang").alias("by"),
        (F.lit(1704067200) + n * 60).alias("time"), F.col("w").alias("title"),
        F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("http://a.example.com/"), n)).alias("url"),
        F.concat(F.lit("<p>"), "w", F.lit(" &amp; more")).alias("text"), F.when(n % 7 == 1, True).alias("dead"), F.when(n % 11 == 1, True).alias("deleted"))
    return _out(feeds.item_api(d.select(F.lit("hn").alias("source"), F.lit("Tech").alias("topic_hint"), n.alias("payload_no"), F.to_json(item).alias("payload"))))


_POS = "doc_id // 50 AS payload_no, doc_id % 50 AS entry"


@query("read_rss", f"""SELECT 'http://r.example.com/' || doc_id AS url, {_WORDS} AS title, ' ' || {_WORDS} || ' &' AS body, lang AS author,
  {_WHEN} AS published_at, 'rss' AS source_type, {_POS} FROM documents WHERE doc_id % 6 <> 2 AND doc_id % 5 <> 3 AND {_WORDS} <> ''""")
def _(spark, sf):
    n = F.col("n")
    item = F.concat(
        F.lit("<item><title>"), "w", F.lit("</title>"), F.when(n % 6 == 2, "").otherwise(F.concat(F.lit("<link>http://r.example.com/"), n, F.lit("</link>"))),
        F.lit("<description>&lt;b&gt;"), "w", F.lit(" &amp;amp; </description><dc:creator>"), "lang", F.lit("</dc:creator><pubDate>"),
        F.when(n % 5 == 3, "no date").otherwise(_stamp("EEE, dd MMM yyyy HH:mm:ss Z")), F.lit("</pubDate></item>"))
    shape = lambda v: F.concat(F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>'), F.array_join(v, ""), F.lit("</channel></rss>"))
    return _out(feeds.rss(_payloads(_numbered(spark, sf), "r", item, shape)))


@query("read_atom", f"""SELECT 'http://t.example.com/' || doc_id AS url, {_WORDS} AS title, {_WORDS} AS body, lang AS author,
  {_WHEN} AS published_at, 'api' AS source_type, {_POS} FROM documents WHERE doc_id % 5 <> 3 AND {_WORDS} <> ''""")
def _(spark, sf):
    n = F.col("n")
    entry = F.concat(
        F.lit("<entry><id>x</id><title>"), "w", F.lit('</title><link rel="self" href="http://t.example.com/self"/><link rel="alternate" href="http://t.example.com/'), n, F.lit('"/><summary>'), "w",
        F.lit("</summary><author><name>"), "lang", F.lit("</name></author>"),
        F.when(n % 5 == 3, "").otherwise(F.concat(F.lit("<published>"), _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>"))), F.lit("</entry>"))
    shape = lambda v: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.array_join(v, ""), F.lit("</feed>"))
    return _out(feeds.atom(_payloads(_numbered(spark, sf), "t", entry, shape)))


@query("read_documents_json", f"""SELECT 'http://d.example.com/' || doc_id AS url, {_WORDS} AS title, {_WORDS} AS body, CASE WHEN doc_id % 3 > 0 THEN lang END AS author,
  {_DAY} AS published_at, 'json' AS source_type, {_POS} FROM documents WHERE doc_id % 5 <> 3 AND {_WORDS} <> ''""")
def _(spark, sf):
    n = F.col("n")
    entry = F.struct(F.col("w").alias("title"), F.concat(F.lit("http://d.example.com/"), n).alias("html_url"),
                     F.when(n % 5 == 3, "someday").otherwise(_stamp("yyyy-MM-dd")).alias("publication_date"), F.col("w").alias("abstract"),
                     F.when(n % 3 > 0, F.array(F.struct(F.col("lang").alias("name")))).alias("agencies"))
    return _out(feeds.documents_json(_payloads(_numbered(spark, sf), "d", entry, lambda v: F.to_json(F.struct(v.alias("results"))))))


@query("read_headlines_json", f"""SELECT 'http://h.example.com/' || doc_id AS url, {_WORDS} AS title, CASE doc_id % 3 WHEN 0 THEN {_WORDS} ELSE text END AS body, lang AS author,
  {_WHEN} AS published_at, 'json' AS source_type, {_POS} FROM documents WHERE doc_id % 7 <> 3 AND {_WORDS} <> ''""")
def _(spark, sf):
    n = F.col("n")
    entry = F.struct(F.when(n % 7 != 3, F.col("w")).alias("title"), F.concat(F.lit("http://h.example.com/"), n).alias("url"), _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
                     F.when(n % 3 == 0, F.col("w")).when(n % 3 == 1, "").alias("description"), F.col("text").alias("content"), F.col("lang").alias("author"))
    return _out(feeds.headlines_json(_payloads(_numbered(spark, sf), "h", entry, lambda v: F.to_json(F.struct(v.alias("articles"))))))


@query("read_market_news_json", f"""SELECT 'http://m.example.com/' || doc_id AS url, {_WORDS} AS title, {_WORDS} AS body, source AS author,
  {_WHEN} AS published_at, 'json' AS source_type, {_POS} FROM documents WHERE doc_id % 7 <> 3 AND {_WORDS} <> ''""")
def _(spark, sf):
    n = F.col("n")
    entry = F.struct(F.col("w").alias("headline"), F.concat(F.lit("http://m.example.com/"), n).alias("url"),
                     F.when(n % 7 == 3, "later").otherwise((F.lit(1704067200) + n * 60).cast("string")).alias("datetime"), F.col("w").alias("summary"), "source")
    return _out(feeds.market_news_json(_payloads(_numbered(spark, sf), "m", entry, F.to_json)))


@query("read_releases_json", f"""SELECT CASE WHEN doc_id % 3 = 0 THEN '{C.RELEASE_PAGE}' || doc_id ELSE 'http://f.example.com/' || doc_id END AS url, {_WORDS} AS title, '' AS body,
  CAST(NULL AS VARCHAR) AS author, {_DAY} AS published_at, 'json' AS source_type, {_POS} FROM documents
  WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) AND {_WORDS} <> ''""")
def _(spark, sf):
    n = F.col("n")
    entry = F.struct(F.when(~((n % 3 == 0) & (n % 2 == 0)), n).alias("id"), _stamp("yyyy-MM-dd").alias("realtime_start"),
                     F.col("w").alias("name"), F.when(n % 3 != 0, F.concat(F.lit("http://f.example.com/"), n)).alias("link"))
    return _out(feeds.releases_json(_payloads(_numbered(spark, sf), "f", entry, lambda v: F.to_json(F.struct(v.alias("releases"))))))


def _registry():
    return [
        {"name": "market", "format": "market_news_json", "topic_hint": "Finance", "max_items_per_run": 1000},
        {"name": "papers", "format": "documents_json", "topic_hint": "Regulation", "max_items_per_run": 7},
        {"name": "off", "format": "documents_json", "topic_hint": "World", "max_items_per_run": 9, "enabled": False},
    ]


@query("registry_collect", f"""WITH e AS (SELECT doc_id, {_WORDS} AS w FROM documents)
  SELECT 'market' AS source, doc_id AS n FROM e WHERE w <> '' QUALIFY row_number() OVER (ORDER BY doc_id) <= 1000
  UNION ALL SELECT 'papers', doc_id FROM e WHERE w <> '' QUALIFY row_number() OVER (ORDER BY doc_id) <= 7""")
def _(spark, sf):
    n, d = F.col("n"), _numbered(spark, sf)
    news = F.struct(F.col("w").alias("headline"), n.cast("string").alias("url"), (F.lit(1704067200) + n * 60).cast("string").alias("datetime"))
    papers = F.struct(F.col("w").alias("title"), n.cast("string").alias("html_url"), F.lit("2024-01-02").alias("publication_date"))
    as_results = lambda v: F.to_json(F.struct(v.alias("results")))
    payloads = _payloads(d, "market", news, F.to_json).unionByName(_payloads(d, "papers", papers, as_results)).unionByName(_payloads(d, "off", papers, as_results))
    entries = feeds.collect_payloads(payloads, _registry())
    kept = items.since_and_cap(entries, F.lit("2024-01-01").cast("timestamp"), feeds.caps(_registry()))
    return kept.select("source", F.col("url").cast("long").alias("n"))


@query("stream_ingest", f"""SELECT substr(sha256(url || '2024-01-01T00:00:00Z'), 1, 32) AS item_id, title, md5(body) AS body_md5 FROM (
  SELECT 'https://s.example.com/' || md5(text) AS url, arg_min({_WORDS}, doc_id) AS title, substr(trim(regexp_replace(any_value(text), '{WS}+', ' ', 'g')), 1, 1200) AS body FROM documents GROUP BY text)""")
def _(spark, sf):
    words = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    entries = table(spark, sf, "documents").select(
        "source", F.lit("rss").alias("source_type"), F.lit("World").alias("topic_hint"), F.concat(F.lit("https://s.example.com/"), F.md5("text")).alias("url"),
        words.alias("title"), F.col("text").alias("body"), F.lit("2024-01-01").cast("timestamp").alias("published_at"),
        F.lit("2024-01-01 06:00:00").cast("timestamp").alias("fetched_at"), F.lit("r").alias("run_id"))
    landing, path, state = (scratch_path(spark, k) for k in ("landing", "stream", "state"))
    entries.write.json(landing, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'")
    for _ in range(2):  # the second start has no new files and writes nothing
        ingest.start_ingest(ingest.read_landing(spark, landing), path, state).awaitTermination()
    return tables.read_table(spark, path, items.ITEM_SCHEMA, columns=["item_id", "title", "body_excerpt"]).select("item_id", "title", F.md5("body_excerpt").alias("body_md5"))


@query("stream_rejects", f"""WITH e AS (SELECT source, min(doc_id) AS first, text FROM documents WHERE {_WORDS} <> '' GROUP BY source, text),
  j AS (SELECT source, CASE WHEN source NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'unknown_source' WHEN first % 5 = 0 THEN 'too_old' END AS reason FROM e),
  c AS (SELECT source, reason, count(*) AS n FROM j GROUP BY 1, 2)
  SELECT source, 'stored' AS reason, least(n, 20) AS items FROM c WHERE reason IS NULL UNION ALL SELECT source, 'over_cap', n - 20 FROM c WHERE reason IS NULL AND n > 20
  UNION ALL SELECT source, reason, n FROM c WHERE reason IS NOT NULL""")
def _(spark, sf):
    words = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    per = table(spark, sf, "documents").where(words != "").groupBy("source", "text").agg(F.min("doc_id").alias("n"))
    fetched = F.lit("2024-01-01 06:00:00").cast("timestamp")
    entries = per.select(
        "source", F.lit("rss").alias("source_type"), F.lit("World").alias("topic_hint"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("n").cast("string")).alias("url"),
        F.lit("t").alias("title"), F.col("text").alias("body"), F.when(F.col("n") % 5 == 0, fetched - F.expr("INTERVAL 7 HOURS")).otherwise(fetched).alias("published_at"),
        fetched.alias("fetched_at"), F.lit("r").alias("run_id"))
    landing, path, state, rejected = (scratch_path(spark, k) for k in ("landing", "stream", "state", "rejected"))
    entries.write.json(landing, timestampFormat="yyyy-MM-dd'T'HH:mm:ss'Z'")
    for _ in range(2):  # the second start has no new files and writes nothing
        # numbers are counted in a batch: all files are one
        ingest.start_ingest(ingest.read_landing(spark, landing, 2**31 - 1), path, state, caps={f"src{i}": 20 for i in range(4)}, rejected=rejected).awaitTermination()
    stored = tables.read_table(spark, path, items.ITEM_SCHEMA).select("source", F.lit("stored").alias("reason"))
    lost = tables.read_table(spark, rejected, ingest.REJECTED_SCHEMA).select("source", "reason")
    return stored.unionByName(lost).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("items"))


# --- waiting list -----------------------------------------------------------------

@query("new_signups", f"""SELECT email, source, CAST(created_at AS VARCHAR) AS created_at FROM (
  SELECT {_MAIL_SQL} AS email, c_mktsegment AS source, '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS created_at, c_custkey FROM customer
  WHERE c_custkey % 3 <> 0) WHERE email IS NOT NULL AND c_custkey % 10 <> 0""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0"))
    sub = c.select(_mail().alias("email"), day.alias("created_at"), F.col("c_mktsegment").alias("source"),
                   F.when(F.col("c_custkey") % 3 == 0, " bot ").alias("company"), F.col("c_custkey").alias("position"))
    twice = sub.unionByName(sub.withColumn("created_at", F.lit("2025-01-01")))
    listed = c.where("c_custkey % 10 = 0").select(text.normalize_email(_mail()).alias("email")).where("email is not null")
    return waitlist.new_signups(twice, listed).select("email", "source", "created_at")


@query("unsent_signups", f"""SELECT count(*) AS signups, count(*) FILTER (c_acctbal < 0) AS unsent FROM customer WHERE {_MAIL_SQL} IS NOT NULL""")
def _(spark, sf):
    rows = table(spark, sf, "customer").select(text.normalize_email(_mail()).alias("email"), F.lit("2024").alias("created_at"), F.when(F.col("c_acctbal") >= 0, "2024").alias("emailed_at"))
    return waitlist.unsent_count(rows.where("email is not null"))


@query("export_signups", f"""SELECT {_MAIL_SQL} AS email, '2024-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS created_at, CASE WHEN c_acctbal < 0 THEN '2024-02-01' END AS emailed_at
  FROM customer WHERE {_MAIL_SQL} IS NOT NULL""")
def _(spark, sf):
    day = F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("c_custkey") % 28).cast("string"), 2, "0"))
    rows = table(spark, sf, "customer").select(text.normalize_email(_mail()).alias("email"), day.alias("created_at"), F.when(F.col("c_acctbal") < 0, "2024-02-01").alias("emailed_at"))
    return waitlist.export_signups(rows.where("email is not null"))
