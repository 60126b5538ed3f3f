"""What the physical plans must show for the queries to hold at scale."""

import pytest
from pyspark.sql import functions as F

from presswire.operators import items, reader, runlog
from presswire.operators.ordering import first_rows
from presswire.plans import catalog, reader_queries, standins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "dedup_two_pass", "new_items", "contexts", "select_stories", "prior_mentions", "headline_repeats", "run_gaps", "unique_slugs", "enrich_items",
    "late_days", "publishable_editions", "resolve_redirects", "merge_by_key", "carry_forward", "reading_rates", "without_accounts", "new_signups",
])
def test_no_cross_joins(spark, sf, name):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_keep_first_is_limited_before_the_shuffle(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    text = plan(first_rows(df, ["o_custkey"], [F.col("o_orderdate")]))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "WindowGroupLimit" in plan(items.first_rows(df, ["o_custkey"], [F.col("o_orderdate")], 10))


def test_scans_read_only_what_is_asked(spark, sf):
    text = plan(runlog.status_by_job(standins.run_log(spark, sf)))
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in scan
    text = plan(reader.retained(reader_queries.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "stories", "o_orderdate", F.lit("1998-01-01").cast("timestamp")))
    assert "GreaterThanOrEqual(o_orderdate" in text
