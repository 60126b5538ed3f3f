"""Registered queries over the run log and other operations data."""

from datetime import date

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import pricing
from ..operators import quality, runlog
from ..session import scratch_path
from .standins import plain, run_log, table, with_sql

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def _log_sql(text):
    return with_sql(text, "run_log")


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else c for c in df.columns])


# --- collection -------------------------------------------------------------------

def _fetches(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.to_date("ts").cast("string").alias("run_id"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.get_json_object("props", "$.k").cast("long").alias("items"), F.when(F.col("event_type") == "error", "HTTPError").alias("error"),
        (F.col("event_id") % 100).alias("latency_ms"))


_PER_SOURCE = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, 'src' || user_id % 5 AS source,
  CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS BIGINT) AS items,
  count(*) FILTER (event_type = 'error') AS errors, CAST(sum(event_id % 100) AS BIGINT) AS latency_ms FROM events GROUP BY 1, 2"""


@query("source_metrics", _PER_SOURCE)
def _(spark, sf):
    return runlog.source_metrics(_fetches(spark, sf))


@query("source_metrics_json", f"""SELECT run_id, '{{' || string_agg('"' || source || '":{{"items":' || items || ',"errors":' || errors || ',"latency_ms":' || latency_ms || '}}', ',' ORDER BY source) || '}}' AS adapter_metrics
  FROM ({_PER_SOURCE}) GROUP BY 1""")
def _(spark, sf):
    return runlog.metrics_json(runlog.source_metrics(_fetches(spark, sf)))


@query("collection_status", f"""SELECT run_id, CAST(sum(items) AS BIGINT) AS fetched, count(*) FILTER (errors > 0) AS failing_sources,
  CASE WHEN sum(items) = 0 THEN 'failed' WHEN count(*) FILTER (errors > 0) > 0 THEN 'partial' ELSE 'success' END AS status FROM ({_PER_SOURCE}) GROUP BY 1""")
def _(spark, sf):
    return runlog.collection_status(runlog.source_metrics(_fetches(spark, sf)))


# --- cost and status --------------------------------------------------------------

@query("cost_by_day", _log_sql("SELECT CAST(run_date AS VARCHAR) AS run_date, round(sum(ai_cost_estimate_usd), 6) AS cost_usd FROM run_log WHERE ai_cost_estimate_usd IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return plain(rounded(runlog.cost_by_day(run_log(spark, sf)), "cost_usd"))


@query("cost_projection", _log_sql("""SELECT round(sum(c), 4) AS total_usd, count(*) AS days, round(sum(c) / count(*), 4) AS avg_per_day, round(sum(c) / count(*) * 30, 4) AS projected_month
  FROM (SELECT run_date, sum(ai_cost_estimate_usd) AS c FROM run_log WHERE ai_cost_estimate_usd IS NOT NULL GROUP BY 1)"""))
def _(spark, sf):
    return rounded(runlog.cost_projection(run_log(spark, sf)), "total_usd", "avg_per_day", "projected_month", places=4)


_JOBS_SQL = ", ".join(
    f"round(coalesce(sum(ai_cost_estimate_usd) FILTER (job = '{j}'), 0), 6) AS {j}_cost, count(*) FILTER (job = '{j}') AS {j}_runs" for j in C.JOBS)


@query("cost_by_job", _log_sql(f"SELECT CAST(run_date AS VARCHAR) AS run_date, {_JOBS_SQL} FROM run_log GROUP BY 1"))
def _(spark, sf):
    return plain(rounded(runlog.cost_by_job(run_log(spark, sf)), *[f"{j}_cost" for j in C.JOBS]))


@query("status_by_job", _log_sql("""SELECT job, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial,
  count(*) FILTER (status = 'failed') AS failed FROM run_log GROUP BY 1"""))
def _(spark, sf):
    return runlog.status_by_job(run_log(spark, sf))


@query("adapter_error_rate", _log_sql("""SELECT 'src' || user_id % 5 AS adapter, count(*) AS runs, count(*) FILTER (items_in % 2 = 1) AS failed_runs,
  round(count(*) FILTER (items_in % 2 = 1) / count(*), 6) AS error_rate FROM run_log WHERE event_id % 2 = 0 GROUP BY 1"""))
def _(spark, sf):
    return rounded(runlog.adapter_error_rate(run_log(spark, sf)), "error_rate")


@query("reason_counts", _log_sql("""SELECT reason, count(*) AS runs FROM (SELECT unnest(string_split(reason_list, ',')) AS reason FROM run_log WHERE reason_list IS NOT NULL) GROUP BY 1"""))
def _(spark, sf):
    return runlog.reason_counts(run_log(spark, sf))


@query("check_run_log", """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'view' THEN 'job' END, CASE WHEN event_id % 3 = 2 THEN 'status' END,
    CASE WHEN event_id % 4 = 1 THEN 'reason' END], lambda x: x IS NOT NULL), ',') AS problems,
  CASE event_id % 4 WHEN 0 THEN '["no_items","write_failed"]' WHEN 1 THEN '["no_items","oops"]' WHEN 2 THEN NULL END AS reasons_json FROM events""")
def _(spark, sf):
    n = F.col("event_id")
    reasons = F.when(n % 4 == 0, F.array(F.lit("write_failed"), F.lit("no_items"), F.lit("write_failed"))).when(
        n % 4 == 1, F.array(F.lit("oops"), F.lit("no_items"))).when(n % 4 == 2, F.array().cast("array<string>"))
    job = F.when(F.col("event_type") == "view", "viewer").otherwise("silver")
    rows = table(spark, sf, "events").select("event_id", job.alias("job"), F.when(n % 3 == 2, "done").otherwise("success").alias("status"), reasons.alias("reasons"))
    return quality.check_run_log(rows).select("event_id", F.array_join("problems", ",").alias("problems"), "reasons_json")


@query("ai_cost", """SELECT event_type, round(sum((k * i + 10 * i * 1.25 + 100 * i * 0.1 + event_id % 7 * o) / 1000000), 8) AS cost_usd FROM (
  SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CASE event_id % 3 WHEN 1 THEN 1.0 WHEN 2 THEN 15.0 ELSE 3.0 END AS i,
    CASE event_id % 3 WHEN 1 THEN 5.0 WHEN 2 THEN 75.0 ELSE 15.0 END AS o FROM events) GROUP BY 1""")
def _(spark, sf):
    n = F.col("event_id")
    model = F.when(n % 3 == 1, "claude-haiku-4-5-20251001").when(n % 3 == 2, "claude-opus-4-1").otherwise("another-model")
    cost = pricing.call_cost(model, F.get_json_object("props", "$.k"), n % 7, F.lit(100), F.lit(10))
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(F.sum(cost).alias("cost_usd")), "cost_usd", places=8)


@query("speech_cost", """SELECT event_type, round(sum((CAST(json_extract_string(props, '$.k') AS DOUBLE) * 0.5 + event_id % 9 * 10) / 1000000), 8) AS cost_usd FROM events GROUP BY 1""")
def _(spark, sf):
    cost = pricing.speech_cost(F.get_json_object("props", "$.k"), F.col("event_id") % 9)
    return rounded(table(spark, sf, "events").groupBy("event_type").agg(F.sum(cost).alias("cost_usd")), "cost_usd", places=8)


# --- latest, freshness, gaps ------------------------------------------------------

@query("latest_per_day", _log_sql("""SELECT CAST(run_date AS VARCHAR) AS run_date, job, run_id, status FROM run_log
  QUALIFY row_number() OVER (PARTITION BY run_date, job ORDER BY started_at DESC, run_id) = 1"""))
def _(spark, sf):
    return plain(runlog.latest_per_day(run_log(spark, sf)).select("run_date", "job", "run_id", "status"))


@query("newest_per_job", _log_sql("""SELECT job, run_id, status, round((epoch(TIMESTAMP '2024-01-31') - floor(epoch(started_at))) / 3600, 6) AS age_hours,
  job = 'collector' AND (epoch(TIMESTAMP '2024-01-31') - floor(epoch(started_at))) / 3600 > 4 AS stale FROM run_log
  QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run_id DESC) = 1"""))
def _(spark, sf):
    newest = runlog.newest_per_job(run_log(spark, sf), F.lit("2024-01-31").cast("timestamp"))
    return rounded(newest.select("job", "run_id", "status", "age_hours", "stale"), "age_hours")


@query("run_gaps", _log_sql("""SELECT job, run_id, round(gap, 6) AS gap_hours FROM (SELECT job, run_id,
  (epoch_us(started_at) - epoch_us(lag(started_at) OVER (PARTITION BY job ORDER BY started_at, run_id))) / 3.6e9 AS gap FROM run_log) WHERE gap > 1"""))
def _(spark, sf):
    return rounded(runlog.run_gaps(run_log(spark, sf), over_hours=1.0).select("job", "run_id", "gap_hours"), "gap_hours")


@query("recent_runs", _log_sql("SELECT run_id, job, status FROM run_log WHERE run_date >= DATE '2024-01-20' AND job = 'editor' AND status <> 'success'"))
def _(spark, sf):
    return runlog.recent_runs(run_log(spark, sf), F.lit("2024-01-27").cast("date"), 7, "editor", failed_only=True).select("run_id", "job", "status")


# --- lateness ---------------------------------------------------------------------

_SITE = """site AS (SELECT *, timezone('America/New_York', timezone('UTC', ended_at)) AS live FROM run_log
    WHERE job = 'site'
    QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY started_at DESC, run_id) = 1),
  days AS (SELECT CAST(d AS DATE) AS day, s.run_id IS NOT NULL AS measured, CAST(live AS TIME) > TIME '06:00:00' AS late, live, trigger
    FROM (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS d) LEFT JOIN site s ON s.run_date = CAST(d AS DATE))"""


def _late_sql(text):
    head = with_sql("", "run_log").rstrip()
    return f"{head}, {_SITE} {text}"


def _late(spark, sf):
    return runlog.late_days(run_log(spark, sf), date(2023, 12, 28), date(2024, 2, 3))


@query("late_days", _late_sql("""SELECT CAST(day AS VARCHAR) AS day, late, CASE WHEN late IS NULL THEN 'unknown' WHEN late THEN 'late' ELSE 'on time' END AS verdict,
  strftime(live, '%H:%M:%S') AS live_eastern, coalesce(trigger, 'unknown') AS trigger FROM days"""))
def _(spark, sf):
    return plain(_late(spark, sf))


@query("lateness_report", _late_sql("""SELECT count(*) FILTER (late) AS late, count(late) AS measured, count(*) FILTER (late IS NULL) AS unmeasured,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM days WHERE late) GROUP BY g)) AS longest_streak FROM days"""))
def _(spark, sf):
    return plain(runlog.lateness_report(_late(spark, sf)))


@query("late_streaks", _late_sql("""SELECT CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days
  FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS g FROM days WHERE late) GROUP BY g"""))
def _(spark, sf):
    return plain(runlog.late_streaks(_late(spark, sf)))


@query("degraded_days", _log_sql("""SELECT CAST(run_date AS VARCHAR) AS run_date, run_id, coalesce(reason_list LIKE '%editor_invalid%', false) AS degraded FROM run_log WHERE job = 'editor'
  QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY started_at DESC, run_id) = 1"""))
def _(spark, sf):
    return plain(runlog.degraded_days(run_log(spark, sf)))


@query("should_publish", """SELECT event_id FROM events WHERE CAST(timezone('America/New_York', timezone('UTC', ts)) AS TIME) >= TIME '05:30:00'
  AND CAST(ts AS DATE) NOT IN (SELECT DISTINCT CAST(ts AS DATE) FROM events WHERE day(ts) % 3 = 0)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    done = e.where(F.dayofmonth("ts") % 3 == 0).select(F.to_date("ts").alias("date"))
    return runlog.should_publish(e.select("event_id", F.col("ts").cast("timestamp").alias("now")), done).select("event_id")


# --- writing and correcting -------------------------------------------------------

@query("run_log_evolution", _log_sql("""SELECT CAST(run_date AS VARCHAR) AS run_date, count(*) AS runs, count(reasons) AS with_reasons FROM (
  SELECT run_date, CASE WHEN day(run_date) > 15 AND event_id % 7 < 3 THEN 1 END AS reasons FROM run_log) GROUP BY 1"""))
def _(spark, sf):
    path = scratch_path(spark, "run-log")
    log = run_log(spark, sf).drop("event_id")
    # the first half of the month was written before the column existed
    log.where(F.dayofmonth("run_date") <= 15).drop("reasons").write.partitionBy("run_date").parquet(path)
    log.where(F.dayofmonth("run_date") > 15).write.mode("append").partitionBy("run_date").parquet(path)
    return plain(runlog.read_run_log(spark, path).groupBy("run_date").agg(F.count(F.lit(1)).alias("runs"), F.count("reasons").alias("with_reasons")))


@query("correct_run_log", _log_sql("""SELECT count(*) FILTER (NOT bad) AS rows_left, coalesce(sum(n) FILTER (first AND touched), 0)::BIGINT AS before, coalesce(sum(n - bads) FILTER (first AND touched), 0)::BIGINT AS after FROM (
  SELECT bad, count(*) OVER d AS n, count(*) FILTER (bad) OVER d AS bads, bool_or(bad) OVER d AS touched, row_number() OVER (PARTITION BY run_date ORDER BY event_id) = 1 AS first FROM (
    SELECT run_date, event_id, run_date IN (DATE '2024-01-05', DATE '2024-01-09') AND job = 'collector' AND items_in <= 5 AS bad FROM run_log) WINDOW d AS (PARTITION BY run_date))"""))
def _(spark, sf):
    path = scratch_path(spark, "run-log")
    run_log(spark, sf).write.partitionBy("run_date").parquet(path)
    log = runlog.read_run_log(spark, path)
    bad = log.where(F.col("run_date").isin("2024-01-05", "2024-01-09") & (F.col("job") == "collector") & (F.col("items_in") <= 5))
    before, after = runlog.correct_rows(log, path, bad)  # of the days that hold a bad row
    return runlog.read_run_log(spark, path).agg(F.count(F.lit(1)).alias("rows_left"), F.lit(before).cast("long").alias("before"), F.lit(after).cast("long").alias("after"))
