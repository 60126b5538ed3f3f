"""Day- and month-partitioned Parquet tables: scans, appends, overwrites, upserts."""

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import first_rows
from ..session import scratch_scope, written

LISTED_KEYS = 200_000  # keys that are told to every task


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jpath)


def read_table(spark: SparkSession, path: str, schema: str, days: list[date] | None = None,
               start: date | None = None, end: date | None = None,
               columns: list[str] | None = None, partition: str = "ingest_date") -> DataFrame:
    """Some days of a table; `end` is exclusive. A missing table reads as empty.

    The day conditions prune partitions and the projection prunes columns.
    """
    try:
        table = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], schema)
    day = F.col(partition)
    if days is not None:
        table = table.where(day.isin(days))
    if start is not None:
        table = table.where(day >= F.lit(start))
    if end is not None:
        table = table.where(day < F.lit(end))
    return table.select(*columns) if columns else table


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "item_id", partition: str = "ingest_date",
             position: str | None = None) -> DataFrame:
    """Rows of a batch not stored yet: first row per key, less the stored keys.

    Only the partitions the batch touches are looked at, so a key stored under
    another day counts as new.
    """
    return _new_rows(batch, stored, key, partition, position)[0]


def _new_rows(batch: DataFrame, stored: DataFrame, key: str, partition: str, position: str | None) -> tuple[DataFrame, int, int]:
    """What is new, the number of its rows, and the number of rows of the batch.

    Keys, days and positions alone are shuffled to find what is new. A row whose key
    comes once in the batch passes as it is, one that is stored ends where it is, and
    only rows of a key that comes twice are ranked. Whole rows are shuffled for their
    keys only where those that pass and those that do not are both too many to list.
    """
    lead = [F.col(position)] if position else []
    first = F.min(F.struct(*lead, F.col(partition)))[partition]
    keys = written(batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), first.alias(partition)), "keys", compression="zstd")
    touched = keys.select(partition).distinct()
    known = stored.select(key, partition).join(touched, partition, "left_semi").select(key).distinct()
    told = keys.join(known.withColumn("_known", F.lit(True)), key, "left").select(F.col(key).alias("_key"), F.col("_n"), F.col("_known").isNotNull().alias("_known"))
    told = written(told, "keys", compression="zstd")
    once, twice = F.expr("_n = 1 and not _known"), F.expr("_n > 1 and not _known")
    passing, doubled, listed, total = told.agg(F.count_if(once), F.count_if(twice), F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()

    def rows_of(which: Column, n: int, how: str = "left_semi") -> DataFrame:
        wanted = told.where(which).select("_key")
        return batch.join(F.broadcast(wanted) if n <= LISTED_KEYS else wanted, F.col(key).eqNullSafe(F.col("_key")), how)

    if passing == listed:
        fresh = batch
    elif not passing:
        fresh = batch.where(F.lit(False))
    elif listed - passing <= LISTED_KEYS:
        fresh = rows_of(~once, listed - passing, "left_anti")
    else:
        fresh = rows_of(once, passing)
    if doubled:
        order = lead or [F.col(partition), *[F.col(c) for c in batch.columns if c not in (key, partition)]]
        fresh = fresh.unionByName(first_rows(rows_of(twice, doubled), [key], order))
    return fresh, passing + doubled, total


def append_items(batch: DataFrame, path: str, schema: str, key: str = "item_id", partition: str = "ingest_date",
                 position: str | None = None) -> tuple[int, int]:
    """Append what is new and return ``(written, skipped)``. Running it twice
    writes nothing the second time."""
    spark = batch.sparkSession
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    with scratch_scope(spark):
        fresh, new, seen = _new_rows(batch, read_table(spark, path, schema, partition=partition), key, partition, position)
        fresh.select(*names).write.mode("append").partitionBy(partition).option("compression", "zstd").parquet(path)
    return new, seen - new


def overwrite_days(rows: DataFrame, path: str, partition: str = "ingest_date") -> int:
    """Replace the days present in `rows`. Other days, and every day when there
    are no rows, stay as they are. The new files are written beside the old
    ones and swapped in at commit, so `rows` may be computed from the table."""
    count = Observation()
    (rows.observe(count, F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))
    return count.get["n"]


def merge_by_key(existing: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Existing rows whose key is not new, plus the new rows.

    `order` ranks duplicates among the new rows; the last one wins.
    """
    latest = first_rows(new, keys, [order.desc()]) if order is not None else new
    return existing.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def upsert_months(new: DataFrame, path: str, schema: str, date_col: str, keys: list[str],
                  order: Column | None = None) -> int:
    """Fold rows into their months by key and rewrite those months compacted.

    Returns the number of keys that were not there before. Each month is
    rewritten in few files: the rebalance joins small parts of a month and
    splits a month too large for one task.
    """
    spark = new.sparkSession
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    fresh = new.select(*names, *([order.alias("_order")] if order is not None else []))
    if order is not None:
        fresh = first_rows(fresh, keys, [F.col("_order").desc()]).drop("_order")
    fresh = fresh.withColumn("month", month_of(F.col(date_col)))
    stored = read_table(spark, path, schema + ", month string", partition="month")
    months = fresh.select("month").distinct()
    touched = stored.join(months, "month", "left_semi")
    added, total = Observation(), Observation()
    # one pass over both sides: a key is new when only the new side has it
    # (a new row may move within its month but keeps its key)
    mark = fresh.join(touched.select(*keys).withColumn("_known", F.lit(True)), keys, "left")
    incoming = mark.observe(
        added, F.count_if(F.col("_known").isNull()).alias("n")
    ).drop("_known")
    merged = touched.join(fresh.select(*keys), keys, "left_anti").unionByName(incoming)
    merged.hint("rebalance", "month").observe(total, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("month").parquet(path)
    return added.get["n"] if total.get["n"] else 0


def drop_day(spark: SparkSession, path: str, day: date, partition: str = "ingest_date") -> bool:
    """Delete one day's folder; False when there is none."""
    folder = f"{path}/{partition}={day.isoformat()}"
    if not exists(spark, folder):
        return False
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)


def archive_day(spark: SparkSession, day: date, paths: dict[str, str], schemas: dict[str, str],
                edition: DataFrame) -> dict:
    """Copy one day of items, clusters and edition to the monthly record, then
    drop the day. The drop is last, so a failure before it loses nothing, and a
    second run finds nothing left to copy."""
    items = read_table(spark, paths["items"], schemas["items"], days=[day])
    clusters = read_table(spark, paths["clusters"], schemas["clusters"], days=[day])
    edition = edition.where(F.col("date") == F.lit(day))
    result = {
        "items": items.count(),
        "clusters": clusters.count(),
        "edition_missing": edition.isEmpty(),
    }
    result["items_added"] = upsert_months(items, paths["gold_items"], schemas["items"], "ingest_date", ["item_id"]) if result["items"] else 0
    result["clusters_added"] = upsert_months(clusters, paths["gold_clusters"], schemas["clusters"], "ingest_date", ["cluster_id"]) if result["clusters"] else 0
    result["editions_added"] = 0 if result["edition_missing"] else upsert_months(
        edition, paths["gold_editions"], schemas["editions"], "date", ["date"])
    if result["items"]:
        drop_day(spark, paths["items"], day)
    if result["clusters"]:
        drop_day(spark, paths["clusters"], day)
    return result


def peek(table: DataFrame, n: int, order: list[str], chars: int = 60) -> DataFrame:
    """The first rows of a table, long strings cut to `chars` with an ellipsis."""
    def short(name, kind):
        col = F.col(name)
        if kind != "string":
            return col
        cut = F.concat(F.substring(col, 1, chars - 3), F.lit("..."))
        return F.when(F.length(col) > chars, cut).otherwise(col).alias(name)

    return table.orderBy(*order).limit(n).select(*[short(name, kind) for name, kind in table.dtypes])
