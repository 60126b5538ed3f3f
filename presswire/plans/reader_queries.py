"""Registered queries over readers: allocation, read times, telemetry, retention."""

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import reader
from .standins import _TOPICS, plain, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


AS_OF = "2024-02-01 12:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def _topic(n):
    return F.get(F.array(*[F.lit(t) for t in C.TOPICS]), n.cast("int"))


def stories(spark, sf):
    """Parts as stories of the last ten days, on skewed topics."""
    n, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select(
        n.cast("string").alias("story_id"),
        F.when(n % 3 == 0, "World").otherwise(_topic(size % 10)).alias("primary_topic"),
        F.when(n % 4 == 0, F.array(_topic(n % 10), _topic((n + size) % 10))).when(n % 4 == 1, F.array(_topic(n % 7))).alias("secondary_topics"),
        (F.col("p_retailprice").cast("long") % 10 + 1).cast("int").alias("topic_score"),
        ((F.col("p_retailprice").cast("long") + size) % 10 + 1).cast("int").alias("general_score"),
        F.timestamp_seconds(F.unix_timestamp(as_of()) - (n * 37 % 14400) * 60).alias("written_at"))


def users(spark, sf):
    """Customers as readers with one to six ranked topics."""
    k = F.col("c_custkey")
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), (k % 6).cast("int")), lambda i: _topic((k + i * 3) % 10)))
    prefs = F.transform(wanted, lambda t, i: F.struct(t.alias("topic"), ((k + i * 5) % 8).cast("int").alias("weight")))
    return table(spark, sf, "customer").select(
        k.cast("string").alias("user_id"), prefs.alias("topic_prefs"),
        F.get(F.array(*[F.lit(n) for n in C.LENGTH_PRESETS]), (k % 5).cast("int")).alias("length"),
        F.when(k % 2 == 0, 3).otherwise(10).alias("allowance"), F.when(k % 2 == 0, "free").otherwise("pro").alias("plan"),
        F.when(k % 3 > 0, as_of() - F.expr("INTERVAL 1 HOUR") * (k % 60)).alias("last_read_at"), (k % 7 > 0).alias("has_newsletter"),
        F.when(k % 5 == 0, F.array(_topic(k % 10))).alias("added_topics"),
        F.get(F.array(F.lit("America/New_York"), F.lit("Europe/Paris"), F.lit("Asia/Kolkata"), F.lit("UTC")), (k % 4).cast("int")).alias("timezone"),
        F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":15:00")).alias("read_time_local"))


def seen(spark, sf):
    """Orders as what readers have already seen."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("user_id"), F.floor(F.col("o_totalprice") % 2000).cast("string").alias("story_id")).distinct()


@query("legacy_scores", f"""SELECT CAST(p_partkey AS VARCHAR) AS story_id, (CAST(floor(p_retailprice) AS BIGINT) + p_size) % 10 + 1 AS score,
  CASE WHEN p_partkey % 3 = 0 THEN 'World' ELSE ({_TOPICS})[p_size % 10 + 1] END AS topic FROM part""")
def _(spark, sf):
    return plain(reader.with_legacy_scores(stories(spark, sf)).select("story_id", "score", "topic"))


@query("stories_by_topic", f"""WITH s AS (SELECT p_partkey AS n, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 'World' ELSE ({_TOPICS})[p_size % 10 + 1] END AS p FROM part),
  t AS (SELECT n, p AS topic FROM s UNION SELECT n, ({_TOPICS})[n % 10 + 1] FROM s WHERE n % 4 = 0 UNION SELECT n, ({_TOPICS})[(n + size) % 10 + 1] FROM s WHERE n % 4 = 0
    UNION SELECT n, ({_TOPICS})[n % 7 + 1] FROM s WHERE n % 4 = 1)
  SELECT topic, count(*) AS stories FROM t GROUP BY 1""")
def _(spark, sf):
    rows = stories(spark, sf).select("story_id", F.explode(reader.story_topics()).alias("topic"))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("stories"))


@query("topic_windows", f"""WITH u AS (SELECT c_custkey AS k, c_custkey % 3 = 0 OR c_custkey % 7 = 0 OR c_custkey % 60 > 36 AS away FROM customer),
  t AS (SELECT k, away, pos, ({_TOPICS})[(k + pos * 3) % 10 + 1] AS topic FROM (SELECT k, away, unnest(generate_series(0, k % 6)) AS pos FROM u))
  SELECT CAST(k AS VARCHAR) AS user_id, pos AS position, topic, pos < CASE WHEN k % 2 = 0 THEN 3 ELSE 10 END AS entitled,
    away OR (k % 5 = 0 AND topic = ({_TOPICS})[k % 10 + 1]) AS catchup FROM t""")
def _(spark, sf):
    return plain(reader.topic_windows(users(spark, sf), as_of()).select("user_id", "position", "topic", "entitled", "catchup"))


def _allocated(spark, sf):
    return reader.allocate(users(spark, sf), stories(spark, sf), seen(spark, sf), as_of())


# The rules of the specification in their order, over every reader and story.
_ALLOCATED = f"""
  story AS (SELECT p_partkey AS n, CAST(p_partkey AS VARCHAR) AS story_id, p_partkey * 37 % 14400 AS age, CAST(floor(p_retailprice) AS BIGINT) % 10 + 1 AS topic_score,
      (CAST(floor(p_retailprice) AS BIGINT) + p_size) % 10 + 1 AS general_score, CASE WHEN p_partkey % 3 = 0 THEN 'World' ELSE ({_TOPICS})[p_size % 10 + 1] END AS first_topic,
      CASE p_partkey % 4 WHEN 0 THEN [({_TOPICS})[p_partkey % 10 + 1], ({_TOPICS})[(p_partkey + p_size) % 10 + 1]] WHEN 1 THEN [({_TOPICS})[p_partkey % 7 + 1]] ELSE [] END AS others
    FROM part WHERE p_partkey * 37 % 14400 <= {C.LOOKBACK_CATCHUP_DAYS * 1440}),
  reader AS (SELECT c_custkey AS k, ([{', '.join(map(str, C.LENGTH_PRESETS))}])[c_custkey % 5 + 1] AS length, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 10 END AS allowance,
      c_custkey % 3 = 0 OR c_custkey % 7 = 0 OR c_custkey % 60 > {C.LOOKBACK_DAILY_HOURS} AS away, CASE WHEN c_custkey % 5 = 0 THEN ({_TOPICS})[c_custkey % 10 + 1] END AS added FROM customer),
  pref AS (SELECT k, length, away, added, i, ({_TOPICS})[(k + i * 3) % 10 + 1] AS topic, (k + i * 5) % 8 AS weight, i < allowance AS entitled
    FROM (SELECT *, unnest(generate_series(0, k % 6)) AS i FROM reader)),
  seen AS (SELECT DISTINCT o_custkey AS k, CAST(floor(o_totalprice % 2000) AS BIGINT) AS n FROM orders),
  topical AS (SELECT n, unnest(list_distinct(list_append(others, first_topic))) AS topic FROM story),
  own AS (SELECT k, n, min(i) AS i FROM pref JOIN topical USING (topic) JOIN story USING (n)
    WHERE entitled AND (age <= {C.LOOKBACK_DAILY_HOURS * 60} OR away OR coalesce(topic = added, false)) AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.k = pref.k AND seen.n = topical.n) GROUP BY 1, 2),
  shares AS (SELECT k, length, i, topic, weight, coalesce(waiting, 0) AS waiting, CASE WHEN sum(weight) OVER (PARTITION BY k) > 0 THEN weight ELSE 1 END AS w
    FROM pref LEFT JOIN (SELECT k, i, count(*) AS waiting FROM own GROUP BY 1, 2) USING (k, i) WHERE entitled),
  targets AS (SELECT *, w * length // total + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY w * length % total DESC, i) <= length - sum(w * length // total) OVER (PARTITION BY k) THEN 1 ELSE 0 END AS target
    FROM (SELECT *, sum(w) OVER (PARTITION BY k) AS total FROM shares)),
  filling AS (
    SELECT k, length, i, topic, weight, waiting, target, least(target, waiting) AS filled, 0 AS step FROM targets
    UNION ALL
    SELECT k, length, i, topic, weight, waiting, target, CAST(filled + CASE WHEN opened THEN least(w * free // total + CASE WHEN r <= free - given THEN 1 ELSE 0 END, waiting - filled) ELSE 0 END AS BIGINT), step + 1
    FROM (SELECT *, sum(CASE WHEN opened THEN w * free // total ELSE 0 END) OVER (PARTITION BY k) AS given,
            row_number() OVER (PARTITION BY k ORDER BY CASE WHEN opened THEN 0 ELSE 1 END, w * free % total DESC, i) AS r
          FROM (SELECT *, sum(CASE WHEN opened THEN w ELSE 0 END) OVER (PARTITION BY k) AS total
                FROM (SELECT *, CASE WHEN sum(CASE WHEN opened THEN weight ELSE 0 END) OVER (PARTITION BY k) > 0 THEN weight ELSE 1 END AS w
                      FROM (SELECT *, waiting > filled AS opened, length - sum(filled) OVER (PARTITION BY k) AS free FROM filling))
                WHERE free > 0) WHERE total > 0)),
  filled AS (SELECT * FROM filling QUALIFY step = max(step) OVER (PARTITION BY k)),
  picked AS (SELECT k, i, row_number() OVER (PARTITION BY k, i ORDER BY topic_score DESC, age, story_id) AS nth, n, topic, false AS topped_up FROM own JOIN story USING (n) JOIN filled USING (k, i)
    QUALIFY nth <= filled),
  short AS (SELECT k, away, least(length - coalesce(had, 0), CAST(floor(length * {C.TOPUP_MAX_SHARE}) AS BIGINT)) AS need FROM reader LEFT JOIN (SELECT k, sum(filled) AS had FROM filled GROUP BY 1) USING (k)),
  topped AS (SELECT s.k, 99 AS i, row_number() OVER (PARTITION BY s.k ORDER BY general_score DESC, age, story_id) AS nth, n, first_topic AS topic, true AS topped_up
    FROM short s JOIN story ON general_score >= {C.TOPUP_FLOOR} AND (away OR age <= {C.LOOKBACK_DAILY_HOURS * 60})
    WHERE need > 0 AND NOT EXISTS (SELECT 1 FROM topical t JOIN pref p ON p.topic = t.topic AND p.k = s.k WHERE t.n = story.n) AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.k = s.k AND seen.n = story.n)
    QUALIFY nth <= need),
  chosen AS (SELECT * FROM picked UNION ALL SELECT * FROM topped),
  allocated AS (SELECT r.k, CAST(r.k AS VARCHAR) AS user_id, any_value(length) AS length, count(c.n) AS selected, count(c.n) FILTER (c.topped_up) AS topped_up, first(c.story_id ORDER BY general_score DESC, age, c.story_id) FILTER (c.n IS NOT NULL) AS lead_story_id,
      coalesce(string_agg(c.story_id || ':' || topic || ':' || topped_up, ' ' ORDER BY i, nth), '') AS stories, coalesce(string_agg(c.story_id, '|' ORDER BY i, nth), '') AS ids,
      (SELECT count(*) FROM own o WHERE o.k = r.k) AS candidates, greatest(any_value(r.k) % 6 + 1 - any_value(allowance), 0) AS locked_topics
    FROM reader r LEFT JOIN (SELECT chosen.*, story_id, general_score, age FROM chosen JOIN story USING (n)) c ON c.k = r.k GROUP BY r.k)"""


@query("allocate", f"WITH RECURSIVE {_ALLOCATED} SELECT user_id, lead_story_id, stories, selected, topped_up, candidates, locked_topics FROM allocated")
def _(spark, sf):
    a = _allocated(spark, sf)
    line = F.array_join(F.transform("stories", lambda s: F.concat_ws(":", s["story_id"], s["claimed_by_topic"], s["topped_up"].cast("string"))), " ")
    return plain(a.select("user_id", "lead_story_id", line.alias("stories"), "selected", "topped_up", "candidates", "locked_topics"))


@query("newsletter_records", f"""WITH RECURSIVE {_ALLOCATED}, dated AS (SELECT *, CAST(CAST(timezone((['America/New_York', 'Europe/Paris', 'Asia/Kolkata', 'UTC'])[k % 4 + 1], timezone('UTC', TIMESTAMP '{AS_OF}')) AS DATE) AS VARCHAR) AS local_date FROM allocated)
  SELECT substr(sha256(user_id || '|' || local_date), 1, {C.ID_CHARS}) AS newsletter_id, user_id, local_date, sha256(ids) AS intro_key, lead_story_id, length, CASE WHEN k % 2 = 0 THEN 'free' ELSE 'pro' END AS plan, selected AS stories
  FROM dated WHERE k % 4 <> 0""")
def _(spark, sf):
    rows = users(spark, sf)
    existing = rows.where("cast(user_id as long) % 4 = 0").select("user_id", F.to_date(F.from_utc_timestamp(as_of(), F.col("timezone"))).alias("local_date"))
    records = reader.newsletter_records(_allocated(spark, sf), rows, existing, as_of())
    return plain(records.select("newsletter_id", "user_id", "local_date", "intro_key", "lead_story_id", "length", "plan", F.size("stories").alias("stories")))


@query("next_read", """WITH u AS (SELECT c_custkey, (['America/New_York', 'Europe/Paris', 'Asia/Kolkata', 'UTC'])[c_custkey % 4 + 1] AS zone,
    to_hours(c_custkey % 24) + INTERVAL 15 MINUTE AS clock, TIMESTAMP '2024-02-01 12:00:00' AS now FROM customer),
  t AS (SELECT *, CAST(timezone(zone, timezone('UTC', now)) AS DATE) AS today FROM u),
  i AS (SELECT c_custkey, now, timezone('UTC', timezone(zone, today + clock)) AS a, timezone('UTC', timezone(zone, today + INTERVAL 1 DAY + clock)) AS b FROM t)
  SELECT CAST(c_custkey AS VARCHAR) AS user_id, strftime(CASE WHEN a >= now THEN a ELSE b END, '%Y-%m-%d %H:%M:%S') AS next_read_at FROM i""")
def _(spark, sf):
    return plain(reader.next_read(users(spark, sf), as_of()).select("user_id", "next_read_at"))


@query("reading_rates", f"""WITH picked AS (SELECT l_suppkey AS u, l_partkey AS s, min(l_linenumber) AS line, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
  e AS (SELECT user_id % 100 AS u, CAST(floor(value * 100) AS BIGINT) % 200 AS s, max(event_type = 'view') AS opened, max(event_type = 'purchase') AS completed, max(event_type = 'error') AS skipped FROM events GROUP BY 1, 2)
  SELECT ({_TOPICS})[p.s % 10 + 1] AS topic, CASE WHEN q % 10 + 1 >= 8 THEN '8-10' WHEN q % 10 + 1 >= 6 THEN '6-7' WHEN q % 10 + 1 >= 4 THEN '4-5' ELSE '1-3' END AS band, line > 4 AS topped_up, count(*) AS selected,
    count(*) FILTER (opened) AS opened, count(*) FILTER (completed) AS completed, count(*) FILTER (skipped) AS skipped, round(count(*) FILTER (opened) / count(*), 6) AS open_rate
  FROM picked p LEFT JOIN e USING (u, s) GROUP BY 1, 2, 3""")
def _(spark, sf):
    picked = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("story_id")).agg(F.min("l_linenumber").alias("line"), F.min("l_quantity").alias("q"))
    selected = picked.select("user_id", "story_id", _topic(F.col("story_id") % 10).alias("topic"), (F.col("q") % 10 + 1).alias("score"), (F.col("line") > 4).alias("topped_up"))
    name = F.when(F.col("event_type") == "view", "story_opened").when(F.col("event_type") == "purchase", "story_completed").when(F.col("event_type") == "error", "story_skipped").otherwise("newsletter_opened")
    events = table(spark, sf, "events").select((F.col("user_id") % 100).alias("user_id"), (F.floor(F.col("value") * 100) % 200).alias("story_id"), name.alias("event"))
    rates = reader.reading_rates(selected, events)
    return rates.select("topic", "band", "topped_up", "selected", "opened", "completed", "skipped", F.round("open_rate", 6).alias("open_rate"))


@query("retained_stories", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-02-28'")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return reader.retained(rows, "stories", "day", F.lit("1998-02-28").cast("timestamp")).select("o_orderkey")


@query("retained_events", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-02-28'")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return reader.retained(rows, "events", "day", F.lit("1998-03-28").cast("timestamp")).select("o_orderkey")


@query("without_accounts", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return reader.without_accounts(table(spark, sf, "orders"), gone, "o_custkey").select("o_orderkey")


@query("touched_partitions", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900)")
def _(spark, sf):
    gone = table(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("user_id"))
    return reader.touched_partitions(table(spark, sf, "orders"), gone, "o_orderpriority", "o_custkey")
