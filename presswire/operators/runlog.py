"""The run log: writing one row per run, and the questions asked of it."""

import json
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import eastern, is_late, window_is_open
from ..sources.tables import drop_day
from .ordering import first_rows, previous_value

RUN_LOG_SCHEMA = (
    "run_id string, job string, started_at timestamp, ended_at timestamp, status string, "
    "items_in int, items_out int, adapter_metrics string, ai_cost_estimate_usd double, "
    "readability_flag boolean, notes string, run_date date, headline_repeat_flag boolean, reasons string"
)


# --- writing --------------------------------------------------------------------

def build_row(run_id: str, job: str, started_at: datetime, ended_at: datetime, status: str, items_in: int = 0,
              items_out: int = 0, adapter_metrics: dict | None = None, reasons: list[str] | None = None, **more) -> dict:
    """One checked run-log row; unknown codes raise."""
    for name, value, allowed in (("job", {job}, C.JOBS), ("status", {status}, C.STATUSES), ("reason", set(reasons or []), C.REASONS)):
        if value - set(allowed):
            raise ValueError(f"unknown {name}: {sorted(value - set(allowed))}")
    row = dict.fromkeys(part.split()[0] for part in RUN_LOG_SCHEMA.split(", "))
    row |= {
        "run_id": run_id, "job": job, "started_at": started_at, "ended_at": ended_at, "status": status,
        "items_in": int(items_in), "items_out": int(items_out), "run_date": started_at.astimezone(timezone.utc).date(),
        "adapter_metrics": None if adapter_metrics is None else json.dumps(adapter_metrics, sort_keys=True),
        "reasons": json.dumps(sorted(set(reasons))) if reasons else None,
    }
    return row | more


def write_row(spark: SparkSession, path: str, row: dict) -> None:
    """Append one row; columns an older file lacks read back as NULL."""
    spark.createDataFrame([row], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").partitionBy("run_date").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.option("mergeSchema", True).parquet(path)
    missing = [f for f in spark.createDataFrame([], RUN_LOG_SCHEMA).schema if f.name not in stored.columns]
    return stored.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


@dataclass
class Run:
    """What a job reports about itself while it runs."""

    run_id: str
    job: str
    started_at: datetime
    status: str = "success"
    items_in: int = 0
    items_out: int = 0
    adapter_metrics: dict | None = None
    reasons: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    extra: dict = field(default_factory=dict)
    skip: bool = False


@contextmanager
def logged_run(spark: SparkSession, path: str, job: str, dry_run: bool = False):
    """Run a job body and append exactly one row, also when it fails.

    A failure is recorded and not raised; the caller reads ``status``. A dry
    run, or a body that sets ``skip``, writes nothing.
    """
    now = datetime.now(timezone.utc)
    run = Run(f"{now:%Y%m%dT%H%M%SZ}-{uuid4().hex[:4]}", job, now)
    try:
        yield run
    except Exception as error:
        run.status = "failed"
        run.reasons.append("run_failed")
        run.notes.append(f"{job} run failed: {type(error).__name__}: {error}")
    if not dry_run and not run.skip:
        write_row(spark, path, build_row(
            run.run_id, job, now, datetime.now(timezone.utc), run.status, run.items_in, run.items_out,
            run.adapter_metrics, run.reasons, notes="; ".join(run.notes) or None, **run.extra))


def correct_rows(log: DataFrame, path: str, bad: DataFrame) -> tuple[int, int]:
    """Remove the rows named by `bad(run_date, run_id)`; every other row and day
    stays. Returns the row counts of the touched days before and after."""
    days = bad.select("run_date").distinct()
    touched = log.join(days, "run_date", "left_semi")
    kept = touched.join(bad.select("run_date", "run_id"), ["run_date", "run_id"], "left_anti")
    sizes = touched.groupBy("run_date").agg(F.count(F.lit(1)).alias("before")).join(
        kept.groupBy("run_date").agg(F.count(F.lit(1)).alias("after")), "run_date", "left").na.fill(0).collect()  # one row per day
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
    for row in sizes:
        if row["after"] == 0:  # a day left empty writes no file, so its old ones go here
            drop_day(log.sparkSession, path, row["run_date"], "run_date")
    return sum(r["before"] for r in sizes), sum(r["after"] for r in sizes)


# --- collection -----------------------------------------------------------------

def source_metrics(fetches: DataFrame) -> DataFrame:
    """Per run and source: items, errors, latency. `fetches` has one row per
    request with run_id, source, items, error and latency_ms."""
    return fetches.groupBy("run_id", "source").agg(
        F.sum(F.when(F.col("error").isNull(), F.col("items")).otherwise(0)).alias("items"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("latency_ms").alias("latency_ms"),
    )


def metrics_json(per_source: DataFrame) -> DataFrame:
    """The metrics of a run as one JSON map over its registered sources."""
    entry = F.struct("source", F.struct("items", "errors", "latency_ms").alias("m"))
    return per_source.groupBy("run_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("adapter_metrics"))


def collection_status(per_source: DataFrame) -> DataFrame:
    fetched, failing = F.sum("items"), F.count_if(F.col("errors") > 0)
    return per_source.groupBy("run_id").agg(
        fetched.alias("fetched"), failing.alias("failing_sources"),
        F.when(fetched == 0, "failed").when(failing > 0, "partial").otherwise("success").alias("status"))


# --- cost, status, errors, reasons ------------------------------------------------

def cost_by_day(log: DataFrame) -> DataFrame:
    return log.where(F.col("ai_cost_estimate_usd").isNotNull()).groupBy("run_date").agg(F.sum("ai_cost_estimate_usd").alias("cost_usd"))


def cost_projection(log: DataFrame) -> DataFrame:
    total, days = F.sum("cost_usd"), F.greatest(F.count(F.lit(1)), F.lit(1))
    return cost_by_day(log).agg(
        total.alias("total_usd"), days.alias("days"), (total / days).alias("avg_per_day"), (total / days * 30).alias("projected_month"))


def cost_by_job(log: DataFrame) -> DataFrame:
    """Per day one cost and one run count column per job, so days that were run
    again stand out."""
    return log.groupBy("run_date").pivot("job", C.JOBS).agg(
        F.coalesce(F.sum("ai_cost_estimate_usd"), F.lit(0.0)).alias("cost"), F.count(F.lit(1)).alias("runs")
    ).na.fill(0)


def status_by_job(log: DataFrame) -> DataFrame:
    return log.groupBy("job").pivot("status", C.STATUSES).agg(F.count(F.lit(1))).na.fill(0)


def adapter_error_rate(log: DataFrame) -> DataFrame:
    """Per adapter: runs, runs with an error, and their share."""
    parsed = F.from_json("adapter_metrics", "map<string, struct<items: long, errors: long, latency_ms: long>>")
    per_run = log.where(F.col("adapter_metrics").isNotNull()).select(F.explode(parsed).alias("adapter", "m")).where("adapter <> '_enrich'")
    failed = F.count_if(F.col("m.errors") > 0)
    return per_run.groupBy("adapter").agg(
        F.count(F.lit(1)).alias("runs"), failed.alias("failed_runs"), (failed / F.count(F.lit(1))).alias("error_rate"))


def reason_counts(log: DataFrame) -> DataFrame:
    return log.select(F.explode(F.from_json("reasons", "array<string>")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("runs"))


# --- latest rows, freshness, gaps -------------------------------------------------

def latest_per_day(log: DataFrame, job: str | None = None, tie: str = "run_id") -> DataFrame:
    """The last started row per day and job; of equal starts the first stored."""
    rows = log.where(F.col("job") == job) if job else log
    return first_rows(rows, ["run_date", "job"], [F.desc("started_at"), F.col(tie)])


def newest_per_job(log: DataFrame, now: Column, stale_hours: float = C.COLLECTOR_STALE_HOURS) -> DataFrame:
    newest = log.groupBy("job").agg(F.max_by(F.struct("run_id", "status", "started_at", "ai_cost_estimate_usd"), F.struct("started_at", "run_id")).alias("r"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("r.started_at")) / 3600
    return newest.select("job", "r.*", age.alias("age_hours"), ((F.col("job") == "collector") & (age > stale_hours)).alias("stale"))


def run_gaps(log: DataFrame, job: str | None = None, over_hours: float | None = None, range_hours: int = 24) -> DataFrame:
    """Hours since the previous run of the same job, for logs of any size."""
    rows = log.where(F.col("job") == job) if job else log
    seconds = F.unix_timestamp("started_at")
    lagged = previous_value(rows.select("job", "run_id", "started_at"), ["job"], seconds,
                            [F.col("started_at"), F.col("run_id")], "started_at", "previous_start", range_hours * 3600)
    gaps = lagged.where(F.col("previous_start").isNotNull()).withColumn(
        "gap_hours", (F.unix_micros("started_at") - F.unix_micros("previous_start")) / 3.6e9)
    return gaps.where(F.col("gap_hours") > over_hours) if over_hours is not None else gaps


def recent_runs(log: DataFrame, today: Column, days: int, job: str | None = None, failed_only: bool = False) -> DataFrame:
    """Runs of the last days; the day condition prunes partitions. Newest first
    is ``orderBy(desc(started_at))``."""
    rows = log.where(F.col("run_date") >= F.date_sub(today, days))
    if job:
        rows = rows.where(F.col("job") == job)
    return rows.where(F.col("status") != "success") if failed_only else rows


# --- lateness and degraded days ---------------------------------------------------

def trigger_of(notes: Column) -> Column:
    """The ``trigger=`` part of ``;``-separated notes, else ``unknown``."""
    parts = F.transform(F.split(F.coalesce(notes, F.lit("")), ";"), lambda p: F.trim(p))
    found = F.get(F.filter(parts, lambda p: p.startswith("trigger=")), F.lit(0))
    value = F.substring(found, F.lit(len("trigger=") + 1), F.length(found))
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise("unknown")


def late_days(log: DataFrame, since: date, until: date) -> DataFrame:
    """One row per date of the range. A date without a site row is unknown, not
    on time."""
    spark = log.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(since), F.lit(until))).alias("day"))
    site = latest_per_day(log.where(F.col("run_date").between(F.lit(since), F.lit(until))), "site")
    facts = site.select(
        F.col("run_date").alias("day"), is_late(F.col("ended_at")).alias("late"),
        F.date_format(eastern(F.col("ended_at")), "HH:mm:ss").alias("live_eastern"), trigger_of(F.col("notes")).alias("trigger"))
    verdict = F.when(F.col("late").isNull(), "unknown").when(F.col("late"), "late").otherwise("on time")
    return days.join(facts, "day", "left").select(
        "day", "late", verdict.alias("verdict"), "live_eastern", F.coalesce("trigger", F.lit("unknown")).alias("trigger"))


def lateness_report(days: DataFrame) -> DataFrame:
    """Late of measured, unmeasured, and the longest run of late days in a row.
    The input is one row per calendar date."""
    order = Window.partitionBy("late").orderBy("day")
    island = F.datediff("day", F.lit("1970-01-01")) - F.row_number().over(order)
    streaks = days.where("late").withColumn("_island", island).groupBy("_island").agg(F.count(F.lit(1)).alias("n"))
    longest = streaks.agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    return days.agg(
        F.count_if("late").alias("late"), F.count_if(F.col("late").isNotNull()).alias("measured"),
        F.count_if(F.col("late").isNull()).alias("unmeasured")).withColumn("longest_streak", longest)


def late_streaks(days: DataFrame) -> DataFrame:
    order = Window.partitionBy("late").orderBy("day")
    island = F.datediff("day", F.lit("1970-01-01")) - F.row_number().over(order)
    return days.where("late").withColumn("_island", island).groupBy("_island").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_island")


def is_degraded(reasons: Column) -> Column:
    """Whether the stored reasons hold a degraded code; bad JSON does not."""
    codes = F.from_json(reasons, "array<string>")
    return F.coalesce(F.arrays_overlap(codes, F.array(*[F.lit(r) for r in C.DEGRADED_REASONS])), F.lit(False))


def degraded_days(log: DataFrame) -> DataFrame:
    """Per day with an editor run: whether its last one was degraded."""
    return latest_per_day(log, "editor").select("run_date", "run_id", is_degraded(F.col("reasons")).alias("degraded"))


def should_publish(ticks: DataFrame, published: DataFrame, now: str = "now") -> DataFrame:
    """Clock ticks at which the day's edition should be published: the window
    is open and its UTC date has no edition yet."""
    open_ticks = ticks.where(window_is_open(F.col(now))).withColumn("_day", F.to_date(now))
    done = published.select(F.col("date").alias("_day")).distinct()
    return open_ticks.join(done, "_day", "left_anti").drop("_day")
