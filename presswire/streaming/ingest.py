"""Continuous ingest: landed entries to the items table, as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..operators.items import ITEM_SCHEMA, build_items
from ..operators.ordering import first_rows
from ..session import written
from ..sources.tables import append_items

ENTRY_SCHEMA = (
    "source string, source_type string, topic_hint string, url string, title string, body string, "
    "author string, published_at timestamp, fetched_at timestamp, run_id string"
)


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New entry files of a landing folder as a stream."""
    return spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stream_items(entries: DataFrame, lateness_hours: int = C.SINCE_WINDOW_HOURS) -> DataFrame:
    """Items of an entry stream, each id once within the lateness window. The
    window overlaps the polling interval, so a missed poll heals itself."""
    items = build_items(entries, F.col("run_id"), F.col("fetched_at"))
    return items.withWatermark("fetched_at", f"{lateness_hours} hours").dropDuplicatesWithinWatermark(["item_id"])


REJECTED_SCHEMA = ITEM_SCHEMA + ", reason string"


def start_ingest(entries: DataFrame, path: str, checkpoint: str, lateness_hours: int = C.SINCE_WINDOW_HOURS,
                 caps: dict[str, int] | None = None, rejected: str | None = None) -> StreamingQuery:
    """Append each batch through the idempotent writer: a batch that is run
    again after a failure writes nothing twice.

    With `caps`, items published more than the window before they were fetched are
    rejected, and so are those of a source outside the registry, or beyond its number in a batch
    by time of publication. What is rejected is kept as rows with a reason under `rejected`.
    """
    def write(batch: DataFrame, _: int) -> None:
        if caps is None:
            append_items(batch, path, ITEM_SCHEMA)
            return
        judged = written(with_reasons(batch, caps, lateness_hours), "batch")
        append_items(judged.where("reason is null").drop("reason"), path, ITEM_SCHEMA)
        if rejected:
            append_items(judged.where("reason is not null"), rejected, REJECTED_SCHEMA)

    return (
        stream_items(entries, lateness_hours).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def with_reasons(items: DataFrame, caps: dict[str, int], since_hours: int) -> DataFrame:
    """Items of a batch with why they are rejected: ``unknown_source``, ``too_old``, ``over_cap``, or NULL."""
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("source")] if caps else F.lit(None).cast("int")
    old = F.col("published_at") < F.col("fetched_at") - F.expr(f"INTERVAL {since_hours} HOURS")
    marked = items.withColumn("reason", F.when(cap.isNull(), "unknown_source").when(F.coalesce(old, F.lit(True)), "too_old"))
    fit = marked.where("reason is null").drop("reason")
    kept = first_rows(fit, ["source"], [F.col("published_at"), F.col("item_id")], max(caps.values(), default=1), rank="_place", spread="item_id").where(F.col("_place") <= cap)
    over = fit.join(kept.select("item_id"), "item_id", "left_anti").withColumn("reason", F.lit("over_cap"))
    return marked.where("reason is not null").unionByName(over).unionByName(kept.drop("_place").withColumn("reason", F.lit(None).cast("string")))
