"""Registered queries over the joined jobs, each run twice on the whole tables."""

import json
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from ..operators import jobs, runlog
from ..session import scratch_path, shuffles_removed
from ..sources import feeds, tables
from .item_queries import _WORDS, _numbered
from .standins import plain

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


NOW = datetime(2024, 1, 20, 6, 0, tzinfo=timezone.utc)


def _landed(spark, sf):
    """Documents as landed files of two sources, one broken payload a source, and a source that is not there."""
    base = scratch_path(spark, "landing")

    def news(x):
        return F.struct(x["w"].alias("headline"), F.concat(F.lit("http://m.example.com/"), x["n"]).alias("url"), (F.lit(1704067200) + x["n"]).cast("string").alias("datetime"), x["w"].alias("summary"))

    def paper(x):
        return F.struct(x["w"].alias("title"), F.concat(F.lit("http://p.example.com/"), x["n"]).alias("html_url"), F.lit("2024-01-02").alias("publication_date"), x["w"].alias("abstract"))

    # texts are shuffled once and in one copy; both sources are written from that, a file a payload
    grouped = _numbered(spark, sf).groupBy(F.floor(F.col("n") / 200).alias("payload_no")).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("_l"))
    market, papers = F.to_json(F.transform("_l", news)), F.to_json(F.struct(F.transform("_l", paper).alias("results")))
    sources = F.array(*[F.struct(F.lit(name).alias("source"), text.alias("payload")) for name, text in (("market", market), ("papers", papers))])
    whole = grouped.select("payload_no", F.explode(sources).alias("s")).select("s.source", "payload_no", "s.payload")
    broken = spark.createDataFrame([("market",), ("papers",)], "source string").select("source", F.lit(-1).cast("long").alias("payload_no"), F.lit("<html>moved</html>").alias("payload"))
    with shuffles_removed(spark):
        whole.unionByName(broken).write.partitionBy("source", "payload_no").option("compression", "gzip").text(base)
    registry = [{"name": name, "format": kind, "topic_hint": "World", "max_items_per_run": 10**9, "path": f"{base}/source={name}"}
                for name, kind in (("market", "market_news_json"), ("papers", "documents_json"))]
    return registry + [{"name": "gone", "format": "rss", "topic_hint": "World", "max_items_per_run": 5, "path": f"{base}/gone"}]


def _collected(spark, sf):
    base = scratch_path(spark, "lake")
    registry = _landed(spark, sf)
    for _ in range(2):
        jobs.collect_job(spark, registry, f"{base}/items", f"{base}/log", now=NOW, since_hours=24 * 30)
    return base


@query("collect_job", f"""WITH n AS (SELECT count(*) AS n FROM documents WHERE {_WORDS} <> '')
  SELECT run, 'partial' AS status, 2 * n AS items_in, CASE run WHEN 1 THEN 2 * n ELSE 0 END AS items_out, '["adapters_failed"]' AS reasons, n AS market, 1 AS broken, 1 AS gone FROM n, (SELECT unnest([1, 2]) AS run)""")
def _(spark, sf):
    log = runlog.read_run_log(spark, f"{_collected(spark, sf)}/log")
    run = F.when(F.col("items_out") > 0, 1).otherwise(2)
    of = lambda path: F.get_json_object("adapter_metrics", path).cast("long")
    return plain(log.select(run.alias("run"), "status", "items_in", "items_out", "reasons", of("$.market.items").alias("market"), of("$.papers.errors").alias("broken"), of("$.gone.errors").alias("gone")))


@query("collect_errors", """SELECT source, error, 1 AS files FROM (SELECT unnest(['market', 'papers', 'gone']) AS source, unnest(['BROKEN_PAYLOAD', 'BROKEN_PAYLOAD', 'PATH_NOT_FOUND']) AS error)
  WHERE EXISTS (SELECT 1 FROM documents)""")
def _(spark, sf):
    _, errors = feeds.collect(spark, _landed(spark, sf))
    return errors.groupBy("source", "error").agg(F.count(F.lit(1)).alias("files"))


def _make_model():
    def model(texts):
        return [[1.0 if len(t) % 16 == i else 0.0 for i in range(16)] for t in texts]
    return model


def _make_scorer():
    def score(prompt):
        n = int(prompt.split(":")[1].split(",")[0])
        return json.dumps({"score": 1 + n % 10, "topic": "AI", "rationale": "counted", "confidence": 0.5}), {"input_tokens": 1000, "output_tokens": 100}
    return score


@query("silver_job", f"""WITH w AS (SELECT {_WORDS} AS w FROM documents), twice AS (SELECT w FROM w WHERE w <> '' UNION ALL SELECT w FROM w WHERE w <> ''),
  parts AS (SELECT (length(w) + 1 + length(rtrim(substr(w, 1, 500)))) % 16 AS part, count(*) AS n FROM twice GROUP BY 1)
  SELECT n AS member_count, 1 + n % 10 AS score, 'AI' AS topic, 'm-1' AS model_version, 'p-1' AS prompt_version, 'success' AS status, (SELECT count(*) FROM parts) AS clusters, 'scored 0' AS again FROM parts""")
def _(spark, sf):
    base = _collected(spark, sf)
    runs = [jobs.silver_job(spark, date(2024, 1, 20), f"{base}/items", f"{base}/clusters", f"{base}/log", _make_model, _make_scorer, "m-1", "p-1") for _ in range(2)]
    rows = tables.read_table(spark, f"{base}/clusters", jobs.CLUSTER_SCHEMA, days=[date(2024, 1, 20)])
    return plain(rows.select("member_count", "score", "topic", "model_version", "prompt_version", F.lit(runs[1].status).alias("status"), F.lit(runs[1].items_out).cast("long").alias("clusters"), F.lit(runs[1].notes[0]).alias("again")))
