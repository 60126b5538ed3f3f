"""Time the headline queries, the best of some runs each, and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from presswire.plans import catalog
from presswire.plans.flagship import pages_by_host
from presswire.session import local_session

HEADLINE = [
    "clean_url", "main_text", "strip_html", "enrich_items", "build_items", "dedup_two_pass", "new_items", "doc_grades",
    "failing_sentences", "edition_report", "cluster_rows", "contexts", "select_stories", "greedy_clusters", "prior_mentions",
    "headline_repeats", "centroids", "cost_by_job", "latest_per_day", "run_gaps", "adapter_error_rate", "late_days",
    "read_rss", "check_editions", "allocate", "reading_rates", "unique_slugs", "slugify",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "presswire-bench")
    runs = {"pages_by_host": pages_by_host} | {name: catalog.QUERIES[name] for name in HEADLINE}
    # start the JVM and its Python workers before the clock
    spark.range(0, 10_000, 1, 8).mapInPandas(lambda batches: batches, "id long").selectExpr("sum(id)").collect()
    repeats = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name, fn in runs.items():
        for _ in range(repeats):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - start, 3)
            times[name] = min(took, times.get(name, took))
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "runs": repeats}))


if __name__ == "__main__":
    main()
