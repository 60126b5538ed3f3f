"""Registered queries over clusters, editions, similarity and readability."""

import json

from pyspark.sql import functions as F

from .. import constants as C
from ..functions import readability as fk
from ..operators import cluster, edition, gold, quality, readability, scoring, similarity
from ..session import scratch_path
from ..sources.editions import edition_rows, publishable, read_editions, write_editions
from .standins import WS, _SECTIONS, _TOPICS, day_tables, doc_items, editions, members, plain, table, with_sql

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def rounded(df, *names, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in names else c for c in df.columns])


# --- clusters ---------------------------------------------------------------------

@query("cluster_rows", with_sql("SELECT cluster_id, CAST(ingest_date AS VARCHAR) AS ingest_date, headline, md5(summary_seed) AS seed_md5, member_count, source_names FROM clusters", "clusters"))
def _(spark, sf):
    rows = cluster.cluster_rows(members(doc_items(spark, sf)))
    return plain(rows.select("cluster_id", "ingest_date", "headline", F.md5("summary_seed").alias("seed_md5"), "member_count", F.array_join("sources", ",").alias("source_names")))


@query("cluster_member_ids", with_sql("SELECT cluster_id, string_agg(item_id, ',' ORDER BY item_id) AS member_ids FROM members GROUP BY 1", "members"))
def _(spark, sf):
    rows = members(doc_items(spark, sf))
    return cluster.with_member_ids(cluster.cluster_rows(rows), rows).select("cluster_id", F.array_join("member_ids", ",").alias("member_ids"))


@query("largest_clusters", with_sql("SELECT cluster_id, member_count FROM (SELECT lang || '-' || source AS cluster_id, count(*) AS member_count FROM documents GROUP BY 1) ORDER BY member_count DESC, cluster_id LIMIT 15"))
def _(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.concat_ws("-", "lang", "source").alias("cluster_id")).agg(F.count(F.lit(1)).alias("member_count"))
    return cluster.largest_clusters(rows)


@query("carry_forward", with_sql("""SELECT cluster_id, coalesce(score IS NOT NULL AND story_no % 3 <> 0 AND story_no % 4 <> 0, false) AS carried,
  CASE WHEN score IS NOT NULL AND story_no % 3 <> 0 AND story_no % 4 <> 0 THEN score END AS score FROM clusters""", "clusters"))
def _(spark, sf):
    now = day_tables(spark, sf)["clusters"]
    stored = now.where("story_no % 3 <> 0").withColumn("member_count", F.when(F.col("story_no") % 4 == 0, F.col("member_count") + 1).otherwise(F.col("member_count")))
    return plain(scoring.carry_forward(now, stored).select("cluster_id", "carried", "score"))


@query("check_replies", f"""SELECT doc_id, CASE WHEN doc_id % 16 IN (0, 8, 9) AND told = '' THEN 'rationale' ELSE (['', 'score', 'topic', 'extra_key', 'missing_key,confidence', 'not_an_object', 'not_an_object', 'rationale',
      '', '', 'score', 'confidence', 'not_an_object', 'not_an_object', 'not_an_object', 'rationale'])[CAST(doc_id % 16 AS INTEGER) + 1] END AS problems,
    CASE WHEN told <> '' THEN CASE doc_id % 16 WHEN 0 THEN 1 + n_chars % 10 WHEN 8 THEN 7 WHEN 9 THEN 1 END END AS score, CASE WHEN told <> '' AND doc_id % 16 IN (0, 8, 9) THEN 'AI' END AS topic,
    CASE WHEN told <> '' AND doc_id % 16 IN (0, 8, 9) THEN md5(told) END AS rationale_md5
  FROM (SELECT doc_id, n_chars, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS told FROM documents)""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("told"))

    def reply(score, topic='"AI"', rationale=None, confidence="0.5", more=""):
        return F.concat(F.lit('{"score": '), score, F.lit(f', "topic": {topic}, "rationale": '), _json_text(F.col("told")) if rationale is None else F.lit(rationale), F.lit(f', "confidence": {confidence}{more}}}'))

    fair = F.format_string("%d", 1 + F.col("n_chars") % 10)
    good = reply(fair)
    variants = [good, reply(F.lit("11"), rationale='"r"'), reply(fair, '"ai"', '"r"'), reply(fair, rationale='"r"', more=', "why": 1'),
                F.lit('{"score": 3, "topic": "AI", "rationale": "it matters"}'), F.lit("sorry, no"), F.lit("[1, 2]"), reply(fair, rationale='" "'),
                reply(F.lit('"7"')), reply(F.lit("true")), reply(F.lit("7.5"), rationale='"r"'), reply(fair, rationale='"r"', confidence="1.5"),
                F.concat(good, F.lit(" Hope that helps!")), F.concat(good, F.lit(", 0] Hope that helps!")), F.concat(good, good), reply(fair, rationale="12")]
    pick = F.get(F.array(*variants), (F.col("doc_id") % 16).cast("int"))
    checked = scoring.check_replies(d.withColumn("reply", pick))
    return plain(checked.select("doc_id", F.array_join("problems", ",").alias("problems"), "score", "topic", F.md5("rationale").alias("rationale_md5")))


def _json_text(value):
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def _make_scorer():
    def score(prompt):
        """A stand-in model: refuses some prompts once, some for good."""
        n, again = len(prompt.split(scoring.COMPLAINT)[0]), scoring.COMPLAINT in prompt
        if n % 5 == 0 or (n % 3 == 0 and not again):
            return "no", {"input_tokens": n, "output_tokens": 1}
        return json.dumps({"score": 1 + n % 10, "topic": "AI", "rationale": "ok", "confidence": 0.5}), {"input_tokens": n, "output_tokens": 2}
    return score


@query("score_clusters", with_sql("""SELECT cluster_id, CAST(ingest_date AS VARCHAR) AS ingest_date, CASE WHEN n % 5 = 0 OR n % 3 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 5 <> 0 THEN 1 + n % 10 END AS score,
    CASE WHEN n % 5 <> 0 THEN 'AI' END AS topic, CASE WHEN n % 5 <> 0 THEN 'ok' END AS rationale, CASE WHEN n % 5 <> 0 THEN 0.5::DOUBLE END AS confidence,
    CASE WHEN n % 5 = 0 THEN 10 WHEN n % 3 = 0 THEN 15 ELSE 10 END AS output_micros, 'model-7' AS model_version, 'prompt-3' AS prompt_version, '2024-02-02 06:00:00' AS scored_at
  FROM (SELECT cluster_id, ingest_date, length(headline) AS n FROM clusters)""", "clusters"))
def _(spark, sf):
    rows = day_tables(spark, sf)["clusters"].withColumn("prompt", F.col("headline"))
    attempts = scoring.score_clusters(rows, _make_scorer)
    settled = scoring.settle_scores(attempts, F.col("output_tokens") * 5, F.lit("model-7"), F.lit("prompt-3"), F.lit("2024-02-02 06:00:00").cast("timestamp"))
    return plain(settled.withColumnRenamed("cost_usd", "output_micros"))


@query("prompt_blocks", with_sql(f"""SELECT cluster_id, md5(string_agg(source || ' | ' || title || chr(10) || '<' || canonical_url || '>' || chr(10) ||
    CASE WHEN e = '' THEN '(no text)' ELSE e END, chr(10) ORDER BY published_at, item_id)) AS block_md5,
  md5('Reports of one event: ' || count(*) || ', from ' || array_to_string(list_sort(list(DISTINCT source)), ', ') || chr(10) ||
    string_agg('* ' || title || CASE WHEN s = '' THEN '' ELSE chr(10) || '    ' || s END, chr(10) ORDER BY published_at, item_id)) AS prompt_md5
  FROM (SELECT *, regexp_replace(substr(body_excerpt, 1, 700), '^{WS}+|{WS}+$', '', 'g') AS e, regexp_replace(substr(body_excerpt, 1, 400), '^{WS}+|{WS}+$', '', 'g') AS s FROM members) GROUP BY 1""", "members"))
def _(spark, sf):
    rows = edition.ordered_members(members(doc_items(spark, sf)))
    return rows.select("cluster_id", F.md5(edition.excerpt_block(F.col("members"))).alias("block_md5"), F.md5(scoring.scoring_prompt(F.col("members"))).alias("prompt_md5"))


@query("candidate_blocks", with_sql("""SELECT cluster_id, md5('story ' || cluster_id || ': ' || headline || chr(10) || '- rated ' || score || ' in ' || coalesce(topic, 'no topic') || ', because: story ' || story_no || chr(10) ||
  '- told by ' || member_count || ' items of ' || replace(source_names, ',', ', ') ||
  CASE WHEN summary_seed <> '' THEN chr(10) || '- begins: ' || substr(summary_seed, 1, 400) ELSE '' END ||
  CASE WHEN story_no % 2 = 0 THEN chr(10) || '- told on 2024-01-01: ' || substr(headline, 1, 200) ELSE '' END) AS block_md5 FROM contexts""", "contexts"))
def _(spark, sf):
    contexts = day_tables(spark, sf)["contexts"]
    told = F.when(F.col("story_no") % 2 == 0, F.array(F.struct(F.lit("2024-01-01").cast("date").alias("date"), F.col("headline").alias("summary"))))
    return contexts.withColumn("_m", told).select("cluster_id", F.md5(edition.candidate_block(F.col("_m"))).alias("block_md5"))


def _greedy_sql(threshold, days):
    """The pass item by item: a row per step, with the clusters so far and what each adds up to."""
    return f"""WITH RECURSIVE v AS (SELECT DATE '2024-01-01' + CAST(vec_id % {days} AS INTEGER) AS day, md5(CAST(vec_id AS VARCHAR)) AS item_id, CAST(embedding AS DOUBLE[]) AS e,
    row_number() OVER (PARTITION BY vec_id % {days} ORDER BY vec_id) AS i FROM embeddings),
  walk AS (
    SELECT DISTINCT day, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(seed VARCHAR, total DOUBLE[])[]) AS clusters, CAST(NULL AS VARCHAR) AS item_id, CAST(NULL AS VARCHAR) AS seed FROM v
    UNION ALL
    SELECT day, i, CASE WHEN home IS NULL THEN list_append(clusters, {{'seed': item_id, 'total': e}})
        ELSE list_transform(clusters, lambda c, j: CASE WHEN j = home THEN {{'seed': c.seed, 'total': list_transform(list_zip(c.total, e), lambda z: z[1] + z[2])}} ELSE c END) END,
      item_id, CASE WHEN home IS NULL THEN item_id ELSE clusters[home].seed END
    FROM (SELECT *, CASE WHEN len(scores) > 0 AND list_max(scores) >= {threshold} THEN len(scores) + 1 - list_position(list_reverse(scores), list_max(scores)) END AS home
          FROM (SELECT w.day, v.i, w.clusters, v.item_id, v.e, list_transform(w.clusters, lambda c: list_dot_product(c.total, v.e) / sqrt(list_dot_product(c.total, c.total))) AS scores
                FROM walk w JOIN v ON v.day = w.day AND v.i = w.i + 1)))
  SELECT CAST(day AS VARCHAR) AS ingest_date, item_id, substr(sha256(seed), 1, 32) AS cluster_id FROM walk WHERE i > 0"""


def _vector_items(spark, sf, days):
    n = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.date_add(F.lit("2024-01-01").cast("date"), (n % days).cast("int")).alias("ingest_date"), F.md5(n.cast("string")).alias("item_id"),
        n.cast("string").alias("canonical_url"), F.timestamp_seconds(n * 60).alias("published_at"), F.col("embedding").alias("vector"))


@query("greedy_clusters", _greedy_sql(0.3, 4))
def _(spark, sf):
    return plain(cluster.greedy_clusters(_vector_items(spark, sf, 4), threshold=0.3).select("ingest_date", "item_id", "cluster_id"))


@query("greedy_parts", _greedy_sql(0.62, 2))
def _(spark, sf):
    # two crowded days, each in parts that no cluster crosses
    return plain(cluster.greedy_clusters(_vector_items(spark, sf, 2), threshold=0.62, piece=100).select("ingest_date", "item_id", "cluster_id"))


@query("centroids", """WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2)
  SELECT label, i - 1 AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS value FROM m""")
def _(spark, sf):
    c = cluster.centroids(table(spark, sf, "embeddings"), ["label"], "embedding")
    return plain(c.select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 5)))


@query("hashed_vectors", """WITH t AS (SELECT item_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n FROM (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS w FROM benchmark) GROUP BY 1, 2)
  SELECT item_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 4) AS value FROM t""")
def _(spark, sf):
    v = cluster.hashed_vectors(table(spark, sf, "benchmark"), "text", 64)
    cells = v.select("item_id", F.posexplode("vector").alias("dim", "value")).where("value > 0")
    return plain(cells.withColumn("value", F.round(F.col("value").cast("double"), 4)))


def _length_model():
    def model(texts):
        return [[float(len(t)), 1.0] for t in texts]
    return model


@query("embedding_cache", """SELECT doc_id AS item_id, CASE WHEN doc_id % 2 = 0 THEN 'cached' ELSE 'computed' END AS origin,
  CASE WHEN doc_id % 2 = 0 THEN 0.0 ELSE round(n / sqrt(n * n + 1), 4) END AS first FROM (SELECT doc_id, CAST(length(lang || source) AS DOUBLE) AS n FROM documents)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.concat("lang", "source").alias("text"))
    old = docs.where("item_id % 2 = 0").select("item_id", F.lit("v2").alias("model_version"), F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>").alias("vector"))
    stale = docs.select("item_id", F.lit("v1").alias("model_version"), F.array(F.lit(9.0), F.lit(9.0)).cast("array<float>").alias("vector"))
    vectors, added = cluster.embed_missing(docs, old.unionByName(stale), "text", _length_model, "v2")
    made = added.select("item_id", F.lit("computed").alias("origin"))
    return vectors.join(made, "item_id", "left").select("item_id", F.coalesce("origin", F.lit("cached")).alias("origin"),
                                                         F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


# --- similarity -------------------------------------------------------------------

def _vector_clusters(spark, sf):
    n = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        n.alias("vec_id"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 40).cast("int")).alias("ingest_date"), n.cast("string").alias("cluster_id"),
        F.concat(F.lit("headline "), n.cast("string")).alias("headline"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(" seed "), n.cast("string"))).alias("summary_seed"),
        F.col("embedding").alias("vector"), "label")


@query("prior_mentions", """WITH v AS (SELECT vec_id, DATE '2024-01-01' + CAST(vec_id % 40 AS INTEGER) AS day, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
  SELECT CAST(a.vec_id AS VARCHAR) AS cluster_id, CAST(b.day AS VARCHAR) AS date, CAST(b.vec_id AS VARCHAR) AS prior_cluster_id,
    CASE WHEN b.vec_id % 3 = 0 THEN 'headline ' || b.vec_id ELSE 'seed ' || b.vec_id END AS summary, round(list_dot_product(a.e, b.e), 5) AS similarity
  FROM v a JOIN v b ON b.day >= a.day - 30 AND b.day < a.day AND b.label % 2 = 0 WHERE list_dot_product(a.e, b.e) >= 0.3""")
def _(spark, sf):
    rows = _vector_clusters(spark, sf)
    found = similarity.prior_mentions(rows, rows, rows.where("label % 2 = 0").select("cluster_id"), threshold=0.3)
    return plain(rounded(found.select("cluster_id", "date", "prior_cluster_id", "summary", "similarity"), "similarity", places=5))


@query("published_only", "SELECT vec_id FROM embeddings WHERE label % 2 = 0")
def _(spark, sf):
    rows = _vector_clusters(spark, sf)
    return similarity.published_only(rows, rows.where("label % 2 = 0").select("cluster_id")).select("vec_id")


@query("headline_repeats", """WITH v AS (SELECT vec_id, DATE '2024-01-01' + CAST(vec_id AS INTEGER) AS date, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  pairs AS (SELECT a.date, b.date AS prior_date, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON b.date >= a.date - 7 AND b.date < a.date AND a.label = b.label),
  best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY date ORDER BY s DESC, prior_date) = 1)
  SELECT CAST(v.date AS VARCHAR) AS date, CAST(prior_date AS VARCHAR) AS prior_date, round(s, 5) AS similarity, coalesce(s >= 0.2, false) AS repeated FROM v LEFT JOIN best USING (date)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("vec_id").cast("int")).alias("date"), "label", F.col("embedding").alias("vector"))
    days = rows.select("date", "label", F.explode(F.sequence(F.date_sub("date", 7), F.date_sub("date", 1))).alias("covered_day"))
    coverage = days.join(rows.select(F.col("date").alias("covered_day"), "label"), ["covered_day", "label"])
    prior = rows.select("date", F.lit("h").alias("headline"), "vector")
    found = similarity.headline_repeats(rows, prior, coverage, threshold=0.2)
    return plain(rounded(found.select("date", "prior_date", "similarity", "repeated"), "similarity", places=5))


# --- contexts and plan ------------------------------------------------------------

@query("contexts", with_sql("SELECT cluster_id, score, topic, primary_url, primary_source, grounding_chars FROM contexts", "contexts"))
def _(spark, sf):
    return plain(day_tables(spark, sf)["contexts"].select("cluster_id", "score", "topic", "primary_url", "primary_source", "grounding_chars"))


@query("story_sources", with_sql("""SELECT cluster_id, string_agg(source || '=' || url, ' ' ORDER BY first_at, id) AS sources FROM (
  SELECT cluster_id, source, arg_min(canonical_url, (published_at, item_id)) AS url, min(published_at) AS first_at, arg_min(item_id, (published_at, item_id)) AS id FROM members GROUP BY 1, 2) GROUP BY 1""", "members"))
def _(spark, sf):
    rows = edition.member_summary(members(doc_items(spark, sf)))
    return rows.select("cluster_id", F.array_join(F.transform("sources", lambda s: F.concat_ws("=", s["name"], s["url"])), " ").alias("sources"))


@query("context_losses", with_sql("""SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, count(*) AS clusters, count(*) FILTER (score IS NULL) AS dropped_null,
  count(*) FILTER (score IS NOT NULL AND story_no % 13 = 0) AS missing_members, count(*) FILTER (score IS NOT NULL AND story_no % 13 <> 0) AS usable FROM clusters GROUP BY 1""", "clusters"))
def _(spark, sf):
    t = day_tables(spark, sf)
    return plain(edition.context_losses(t["clusters"], t["members"].where("story_no % 13 <> 0")))


@query("edition_types", with_sql("SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, usable, edition_type FROM types", "types"))
def _(spark, sf):
    t = day_tables(spark, sf)
    return plain(edition.edition_types(t["contexts"], t["items"]))


@query("section_plan", with_sql(f"""SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, coalesce(string_agg(name, ',' ORDER BY pos) FILTER (n >= 2), '') AS available,
  coalesce(string_agg(name, ',' ORDER BY pos) FILTER (n = 1), '') AS held, count(*) FILTER (n = 1) >= 3 AS shrink FROM (
  SELECT ingest_date, list_position({_TOPICS}, topic) AS pos, ({_SECTIONS})[list_position({_TOPICS}, topic)] AS name, count(*) AS n FROM contexts WHERE topic IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1""", "contexts"))
def _(spark, sf):
    plan = edition.section_plan(day_tables(spark, sf)["contexts"])
    return plain(plan.select("ingest_date", F.array_join("available", ",").alias("available"), F.array_join("held", ",").alias("held"), "shrink"))


@query("select_stories", with_sql("SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, cluster_id, section, placement, position FROM placed", "placed"))
def _(spark, sf):
    return plain(edition.select_stories(day_tables(spark, sf)["contexts"]).select("ingest_date", "cluster_id", "section", "placement", "position"))


@query("fallback_top10", with_sql("""SELECT CAST(ingest_date AS VARCHAR) AS ingest_date, rank, cluster_id, score, primary_url AS url, primary_source AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY ingest_date ORDER BY score DESC, cluster_id) AS rank FROM contexts) WHERE rank <= 10""", "contexts"))
def _(spark, sf):
    return plain(edition.fallback_stories(day_tables(spark, sf)["contexts"]).drop("title"))


@query("edition_stats", with_sql("""SELECT CAST(d.ingest_date AS VARCHAR) AS ingest_date, items_ingested, clusters_considered, coalesce(stories_run, 0) AS stories_run, coalesce(sources, 0) AS sources, coalesce(held, 0) AS sections_held
  FROM (SELECT ingest_date, count(*) AS items_ingested FROM doc_items GROUP BY 1) d
  LEFT JOIN (SELECT ingest_date, count(*) AS clusters_considered FROM clusters GROUP BY 1) USING (ingest_date)
  LEFT JOIN (SELECT ingest_date, count(*) AS stories_run FROM placed WHERE placement = 'section' GROUP BY 1) USING (ingest_date)
  LEFT JOIN (SELECT c.ingest_date, count(DISTINCT m.source) AS sources FROM contexts c JOIN members m USING (cluster_id) GROUP BY 1) USING (ingest_date)
  LEFT JOIN (SELECT ingest_date, count(*) AS held FROM (SELECT ingest_date, topic FROM contexts WHERE topic IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1) USING (ingest_date)""", "placed", "clusters"))
def _(spark, sf):
    t = day_tables(spark, sf)
    contexts = t["contexts"]
    return plain(edition.edition_stats(t["items"], t["clusters"], edition.select_stories(contexts), contexts, edition.section_plan(contexts)))


@query("edition_numbers", """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), old AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM days WHERE d < DATE '1997-01-01'),
  new AS (SELECT d FROM days WHERE d >= DATE '1996-12-01')
  SELECT CAST(d AS VARCHAR) AS date, CAST(coalesce(n, (SELECT max(n) FROM old) + row_number() OVER (PARTITION BY n IS NULL ORDER BY d)) AS BIGINT) AS edition_number, n IS NOT NULL AS reused FROM new LEFT JOIN old USING (d)""")
def _(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    empty = spark.createDataFrame([], "date date, edition_number int")
    old = edition.edition_numbers(days.where("date < '1997-01-01'"), empty)
    return plain(edition.edition_numbers(days.where("date >= '1996-12-01'"), old))


@query("resolve_briefly", with_sql("""WITH asked AS (SELECT ingest_date, cluster_id, story_no AS position FROM clusters UNION ALL SELECT ingest_date, cluster_id, story_no + 500 FROM clusters WHERE story_no % 2 = 0
    UNION ALL SELECT ingest_date, 'nobody', 1 FROM clusters)
  SELECT CAST(c.ingest_date AS VARCHAR) AS date, c.cluster_id, min(position) AS position, topic, primary_url AS url FROM asked a JOIN contexts c USING (ingest_date, cluster_id)
  WHERE topic IS NOT NULL AND story_no % 5 <> 0 GROUP BY 1, 2, 4, 5""", "contexts").replace("\nWITH asked", ",\nasked", 1))
def _(spark, sf):
    t = day_tables(spark, sf)
    c = t["clusters"].select(F.col("ingest_date").alias("date"), "cluster_id", F.col("story_no").alias("position"))
    asked = c.unionByName(c.where("position % 2 = 0").withColumn("position", F.col("position") + 500)).unionByName(
        c.withColumn("cluster_id", F.lit("nobody")).withColumn("position", F.lit(1).cast("long")))
    used = t["clusters"].where("story_no % 5 = 0").select(F.col("ingest_date").alias("date"), "cluster_id")
    return plain(edition.resolve_briefly(asked, t["contexts"], used).select("date", "cluster_id", "position", "topic", "url"))


# --- editions and the record ------------------------------------------------------

@query("assemble_editions", with_sql("""SELECT CAST(ingest_date AS VARCHAR) AS date, section, cluster_id, score, row_number() OVER (PARTITION BY ingest_date ORDER BY position) AS position FROM cards""", "cards"))
def _(spark, sf):
    parsed = gold.parsed_editions(editions(spark, sf)).where("edition.edition_type <> 'fallback'")
    stories = F.flatten(F.transform("edition.sections", lambda s: F.transform(s["stories"], lambda t: F.struct(s["name"].alias("section"), t["cluster_id"].alias("cluster_id"), t["score"].alias("score")))))
    return plain(parsed.select("date", F.posexplode(stories).alias("position", "s")).select("date", "s.section", "s.cluster_id", "s.score", (F.col("position") + 1).alias("position")))


@query("edition_problems", with_sql("SELECT CAST(date AS VARCHAR) AS date, edition_type, edition_number, '' AS problems FROM edition_days", "edition_days"))
def _(spark, sf):
    checked = quality.check_editions(editions(spark, sf))
    return plain(checked.select("date", "edition_type", "edition_number", F.array_join("problems", ",").alias("problems")))


@query("daily_editions", with_sql("SELECT CAST(date AS VARCHAR) AS date, edition_type, edition_number FROM edition_days", "edition_days"))
def _(spark, sf):
    return plain(editions(spark, sf).select("date", "edition_type", "edition_number"))


@query("published_cluster_ids", with_sql("""SELECT CAST(ingest_date AS VARCHAR) AS date, cluster_id FROM placed JOIN types USING (ingest_date)
  WHERE edition_type <> 'fallback' AND ingest_date IN (SELECT ingest_date FROM cards)""", "placed", "types", "cards"))
def _(spark, sf):
    return plain(gold.published_cluster_ids(editions(spark, sf)))


@query("running_totals", with_sql("SELECT (SELECT count(*) FROM edition_days) AS editions, (SELECT count(*) FROM cards) AS stories", "edition_days", "cards"))
def _(spark, sf):
    return plain(gold.running_totals(editions(spark, sf)))


@query("topic_pages", with_sql("""SELECT section, trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(DISTINCT ingest_date) AS editions, CAST(max(ingest_date) AS VARCHAR) AS latest FROM cards GROUP BY 1""", "cards"))
def _(spark, sf):
    return plain(gold.topic_pages(editions(spark, sf)))


@query("stories_per_edition", with_sql("SELECT CAST(date AS VARCHAR) AS date, e.edition_type, count(c.cluster_id) AS stories FROM edition_days e LEFT JOIN cards c ON c.ingest_date = e.date GROUP BY 1, 2", "edition_days", "cards"))
def _(spark, sf):
    return plain(gold.stories_per_edition(editions(spark, sf)))


@query("neighbours", """SELECT CAST(d AS VARCHAR) AS date, CAST(lag(d) OVER (ORDER BY d) AS VARCHAR) AS prev_date, CAST(lead(d) OVER (ORDER BY d) AS VARCHAR) AS next_date
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(spark, sf):
    return plain(gold.neighbours(table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))))


_ARCHIVE = """SELECT date, e.edition_type, CASE WHEN e.edition_type = 'fallback' THEN (SELECT least(count(*), 10) FROM contexts x WHERE x.ingest_date = e.date)
    ELSE count(c.cluster_id) END AS stories, CASE WHEN e.edition_type = 'fallback' THEN 'Short edition' ELSE arg_max(c.headline, (c.score, c.cluster_id)) END AS title
  FROM edition_days e LEFT JOIN cards c ON c.ingest_date = e.date GROUP BY 1, 2"""


@query("archive_rows", with_sql(f"""SELECT CAST(date AS VARCHAR) AS date, strftime(date, '%Y') AS year, strftime(date, '%B %Y') AS month, strftime(date, '%b %-d') AS short_date,
  strftime(date, '/%Y/%m/%d/') AS path, title, stories, CAST(NULL AS VARCHAR) AS audio_length FROM ({_ARCHIVE})""", "edition_days", "cards", "contexts"))
def _(spark, sf):
    return plain(gold.archive_rows(editions(spark, sf)))


@query("archive_months", with_sql(f"""SELECT strftime(date, '%Y') AS year, strftime(date, '%B %Y') AS month, CAST(max(date) AS VARCHAR) AS newest, count(*) AS editions,
  string_agg(CAST(date AS VARCHAR) || '=' || stories, ' ' ORDER BY date DESC) AS rows FROM ({_ARCHIVE}) GROUP BY 1, 2""", "edition_days", "cards", "contexts"))
def _(spark, sf):
    months = gold.archive_months(editions(spark, sf))
    line = F.array_join(F.transform("rows", lambda r: F.concat_ws("=", r["date"].cast("string"), r["stories"].cast("string"))), " ")
    return plain(months.withColumn("rows", line))


@query("feed_items", with_sql(f"""SELECT CAST(date AS VARCHAR) AS date, title, 'https://x.example.com' || strftime(date, '/%Y/%m/%d/') AS link, strftime(date, '%a, %d %b %Y 10:00:00 GMT') AS published,
  CASE WHEN edition_type = 'fallback' THEN 'A short list today.' ELSE (SELECT string_agg('- ' || headline, chr(10) ORDER BY position) FROM (SELECT *, row_number() OVER (PARTITION BY ingest_date ORDER BY position) AS r FROM cards) c
    WHERE c.ingest_date = a.date AND r <= CASE WHEN a.edition_type = 'normal' THEN 4 ELSE 3 END) END AS description
  FROM ({_ARCHIVE}) a""", "edition_days", "cards", "contexts"))
def _(spark, sf):
    return plain(gold.feed_items(editions(spark, sf), "https://x.example.com/").select("date", "title", "link", "published", "description"))


@query("recent_headlines", with_sql(f"""SELECT CAST(date AS VARCHAR) AS date, title AS headline FROM ({_ARCHIVE}) WHERE edition_type <> 'fallback' AND date >= DATE '2024-01-04' AND date < DATE '2024-01-11'""", "edition_days", "cards", "contexts"))
def _(spark, sf):
    rows = gold.parsed_editions(editions(spark, sf)).select("date", "edition.headline_of_the_day", "edition.headline_cluster_id")
    return plain(similarity.recent_headlines(rows, F.lit("2024-01-11").cast("date")).select("date", "headline"))


@query("edition_files", """SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, max(o_orderkey) + 1 AS edition_number, 'normal' AS edition_type FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1""")
def _(spark, sf):
    # one file text per order, every fourth unreadable; the last of a date counts
    n, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    good = F.to_json(F.struct(d.alias("date"), (n + 1).alias("edition_number"), F.lit("normal").alias("edition_type")))
    texts = table(spark, sf, "orders").select(F.when(n % 4 == 0, "{broken").otherwise(good).alias("edition_json"))
    rows = edition_rows(texts)
    return plain(rows.groupBy("date").agg(F.max("edition_number").alias("edition_number"), F.max("edition_type").alias("edition_type")))


@query("edition_sink", """WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1),
  runs AS (SELECT date, CASE n % 3 WHEN 0 THEN 'fallback' WHEN 1 THEN 'quiet' ELSE 'broken' END AS first, CASE WHEN month(date) % 3 = 0 THEN NULL WHEN n % 2 = 0 THEN 'fallback' ELSE 'normal' END AS second, n FROM d)
  SELECT CAST(date AS VARCHAR) AS date, CASE WHEN second IS NULL OR (first = 'quiet' AND second = 'fallback') THEN first ELSE second END AS edition_type,
    CASE WHEN second IS NULL OR (first = 'quiet' AND second = 'fallback') THEN n ELSE n + 1 END AS edition_number,
    (SELECT count(*) FILTER (second IS NOT NULL AND NOT (first = 'quiet' AND second = 'fallback')) FROM runs) AS written_again
  FROM runs WHERE NOT (first = 'broken' AND second IS NULL)""")
def _(spark, sf):
    path = scratch_path(spark, "editions")
    per = table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(F.count(F.lit(1)).alias("n"))

    def run(kind, number, keep=F.lit(True), readable=F.lit(True)):
        text_of = F.to_json(F.struct(F.col("date").cast("string").alias("date"), number.cast("int").alias("edition_number"), kind.alias("edition_type")))
        rows = per.where(keep).select("date", number.cast("int").alias("edition_number"), kind.alias("edition_type"), F.when(readable, text_of).otherwise("{not json").alias("edition_json"))
        return write_editions(rows, path)

    n = F.col("n")
    run(F.when(n % 3 == 0, "fallback").otherwise("quiet"), n, readable=n % 3 < 2)
    again = run(F.when(n % 2 == 0, "fallback").otherwise("normal"), n + 1, keep=F.month("date") % 3 != 0)
    run(F.lit("normal"), n, keep=F.lit(False))  # nothing new: all stays
    return plain(read_editions(spark, path).select("date", "edition_type", "edition_number", F.lit(again).cast("long").alias("written_again")))


@query("publishable_editions", """SELECT o_orderkey FROM orders o WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 5 = 0
  AND EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_orderkey % 3 = 0 AND CAST(p.o_orderdate AS DATE) = CAST(o.o_orderdate AS DATE))) AND o_orderkey % 5 = 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("date"))
    published = o.where("o_orderkey % 3 = 0").select("date", F.when(F.col("o_orderstatus") == "F", "quiet").otherwise("fallback").alias("edition_type"))
    new = o.where("o_orderkey % 5 = 0").select("o_orderkey", "date", F.when(F.col("o_orderkey") % 2 == 0, "fallback").otherwise("normal").alias("edition_type"))
    return publishable(new, published).select("o_orderkey")


@query("edition_headers", with_sql(f"""SELECT CAST(date AS VARCHAR) AS date, strftime(date, '%B %-d, %Y') AS long_date, strftime(date, '/%Y/%m/%d/') AS path,
  CAST(greatest(15, CAST(floor(CASE edition_type WHEN 'fallback' THEN 0 WHEN 'normal' THEN least(n, 4) ELSE least(n, 3) END * 12 / 15 + 0.5) AS BIGINT) * 15) AS VARCHAR) || '-second read' AS read_time
  FROM (SELECT e.date, e.edition_type, (SELECT count(*) FROM cards c WHERE c.ingest_date = e.date) AS n FROM edition_days e)""", "edition_days", "cards"))
def _(spark, sf):
    return plain(gold.edition_headers(editions(spark, sf)))


# --- weekly review ----------------------------------------------------------------

@query("topic_summary", with_sql("SELECT topic, count(*) AS clusters, round(avg(score), 6) AS avg_score FROM clusters GROUP BY 1", "clusters"))
def _(spark, sf):
    return rounded(gold.topic_summary(day_tables(spark, sf)["clusters"]), "avg_score")


@query("source_summary", "SELECT source, count(*) AS items, count(DISTINCT md5(text)) AS distinct_keys FROM documents GROUP BY 1")
def _(spark, sf):
    return gold.source_summary(table(spark, sf, "documents").select("source", F.md5("text").alias("canonical_url")))


@query("top_clusters", with_sql("SELECT cluster_id, score FROM clusters ORDER BY score DESC NULLS LAST, cluster_id LIMIT 10", "clusters"))
def _(spark, sf):
    return plain(gold.top_clusters(day_tables(spark, sf)["clusters"]).select("cluster_id", "score"))


@query("score_distribution", with_sql("SELECT score, count(*) AS clusters FROM clusters GROUP BY 1", "clusters"))
def _(spark, sf):
    return plain(gold.score_distribution(day_tables(spark, sf)["clusters"]))


# --- readability ------------------------------------------------------------------

_WORDS = "regexp_extract_all({t}, '[A-Za-z][A-Za-z''’-]*')"
_SYLLABLES = """list_sum(list_transform(list_transform({words}, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')),
  lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND NOT w LIKE '%le' AND NOT w LIKE '%ee' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)))"""
_SENTENCES = f"""list_filter(list_transform(string_split(regexp_replace({{t}}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: regexp_matches(p, '[A-Za-z]'))"""


def _in(pattern, column):
    return pattern.replace("{t}", column)


def _syllables(words):
    return _SYLLABLES.replace("{words}", words)


def _grade_sql(s, w, y):
    return f"CASE WHEN {s} > 0 AND {w} > 0 THEN 0.39 * ({w} / {s}) + 11.8 * ({y} / {w}) - 15.59 ELSE 0.0 END"


_COUNTS = f"""SELECT doc_id, lang, text, len({_in(_SENTENCES, 'text')}) AS sentences, len({_in(_WORDS, 'text')}) AS words,
  CAST(coalesce({_syllables(_in(_WORDS, 'text'))}, 0) AS BIGINT) AS syllables FROM documents"""


@query("doc_grades", f"SELECT doc_id, sentences, words, syllables, round({_grade_sql('sentences', 'words', 'syllables')}, 6) AS grade FROM ({_COUNTS})")
def _(spark, sf):
    counts = fk.reading_counts(F.col("text"))
    graded = table(spark, sf, "documents").select("doc_id", counts.alias("c"))
    return plain(rounded(graded.select("doc_id", "c.*", fk.grade_of(F.col("c")).alias("grade")), "grade"))


@query("failing_sentences", f"""SELECT doc_id, position - 1 AS position, md5(s) AS sentence_md5, round(grade, 6) AS grade FROM (
  SELECT doc_id, position, s, {_grade_sql('1', 'w', 'y')} AS grade FROM (
    SELECT doc_id, position, s, len({_in(_WORDS, 's')}) AS w, CAST(coalesce({_syllables(_in(_WORDS, 's'))}, 0) AS BIGINT) AS y FROM (
      SELECT doc_id, unnest({_in(_SENTENCES, 'text')}) AS s, generate_subscripts({_in(_SENTENCES, 'text')}, 1) AS position FROM documents))) WHERE grade > 12""")
def _(spark, sf):
    found = readability.failing_sentences(table(spark, sf, "documents"), "doc_id")
    return plain(rounded(found.select("doc_id", "position", F.md5("sentence").alias("sentence_md5"), "grade"), "grade"))


def _document_editions(spark, sf):
    """Every document as an edition: a headline, one point, two stories."""
    story = lambda slug, part: F.struct(F.lit(slug).alias("slug"), part.alias("summary"), F.lit(None).cast(
        "struct<background:string,what_happened:string,why_it_matters:string,quote:struct<text:string>>").alias("article"))
    text = F.col("text")
    e = F.struct(F.lit("normal").alias("edition_type"), F.lit(None).cast("string").alias("notice"), F.substring(text, 1, 70).alias("headline_of_the_day"),
                 F.array(F.struct(F.substring(text, 71, 100).alias("text"), F.lit("World").alias("topic"))).alias("key_points"),
                 F.array(F.struct(F.lit("World").alias("name"), F.array(story("one", F.substring(text, 171, 200)), story("two", F.substring(text, F.lit(371), F.length(text)))).alias("stories"))).alias("sections"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("date"), e.alias("edition"))


def _part_counts(source):
    return f"""SELECT doc_id, id, t, CASE WHEN coalesce(t, '') = '' THEN 0.0 ELSE {_grade_sql('s', 'w', 'y')} END AS grade FROM (
  SELECT doc_id, id, t, len({_in(_SENTENCES, 't')}) AS s, len({_in(_WORDS, 't')}) AS w, CAST(coalesce({_syllables(_in(_WORDS, 't'))}, 0) AS BIGINT) AS y FROM ({source}))"""


_PIECES = """SELECT doc_id, 'headline' AS id, substr(text, 1, 70) AS t FROM documents UNION ALL SELECT doc_id, 'point:0', substr(text, 71, 100) FROM documents
  UNION ALL SELECT doc_id, 'summary:one', substr(text, 171, 200) FROM documents UNION ALL SELECT doc_id, 'summary:two', substr(text, 371) FROM documents"""
_JOINED = """SELECT doc_id, 'all' AS id, array_to_string(list_filter([substr(text, 1, 70), substr(text, 71, 100), substr(text, 171, 200), substr(text, 371)], lambda p: p <> ''), ' ') AS t FROM documents"""


@query("edition_report", f"""WITH pieces AS MATERIALIZED ({_part_counts(_PIECES)}), whole AS MATERIALIZED ({_part_counts(_JOINED)})
  SELECT w.doc_id AS date, round(w.grade, 6) AS average, w.grade <= 9.0 AS passes, 2 AS stories,
    (SELECT coalesce(string_agg(replace(p.id, 'summary:', ''), ',' ORDER BY p.grade DESC, p.id), '') FROM pieces p WHERE p.doc_id = w.doc_id AND p.id LIKE 'summary:%' AND p.grade > 9.0) AS failing_slugs FROM whole w""")
def _(spark, sf):
    report = readability.edition_report(_document_editions(spark, sf))
    return plain(rounded(report.withColumn("failing_slugs", F.array_join("failing_slugs", ",")), "average"))


@query("failing_pieces", f"SELECT doc_id AS date, id, round(grade, 6) AS grade FROM ({_part_counts(_PIECES)}) WHERE grade > 9.0 AND t <> ''")
def _(spark, sf):
    return rounded(readability.failing_pieces(_document_editions(spark, sf)).select("date", "id", "grade"), "grade")


@query("apply_rewrites", f"""WITH failing AS MATERIALIZED (SELECT * FROM ({_part_counts(_PIECES)}) WHERE grade > 9.0 AND t <> '')
  SELECT d.doc_id AS date, count(f.id) AS applied, md5(CASE WHEN max(f.id = 'headline') THEN 'So it is.' ELSE substr(d.text, 1, 70) END) AS headline_md5
  FROM documents d LEFT JOIN failing f ON f.doc_id = d.doc_id AND f.id <> 'point:0' GROUP BY d.doc_id, d.text""")
def _(spark, sf):
    rows = _document_editions(spark, sf)
    # two plain rewrites for everything but the point, the last of which counts; the point gets a harder one
    ids = ["headline", "point:0", "summary:one", "summary:two"]
    hard = "Extraordinarily complicated institutional responsibilities notwithstanding internationalization characteristically individualistic organizational considerations unquestionably incomprehensibilities."
    texts = F.when(F.col("id") == "point:0", F.array(F.lit(hard))).otherwise(F.array(F.lit("We go."), F.lit("So it is.")))
    offered = rows.select("date", F.explode(F.array(*[F.lit(i) for i in ids])).alias("id")).select("date", "id", F.posexplode(texts).alias("position", "text"))
    accepted = readability.accepted_rewrites(readability.failing_pieces(rows), offered)
    done = readability.apply_rewrites(rows, accepted)
    return plain(done.select("date", "applied", F.md5("edition.headline_of_the_day").alias("headline_md5")))


# --- other quality rules ----------------------------------------------------------

# Documents as editions, one way of going wrong per remainder; what texts and counts hold may be wrong besides.
_CASES = ["", "extra_key:why", "extra_key:sections[].stories[].mood", "", "wrong_kind:sections[].stories[].score", "missing_key:stats.sources", "wrong_kind:headline_of_the_day",
          "not_an_object", "extra_key:audio.kind", "", "", "", "", "", "", "not_an_object", "", "", "edition_type", "wrong_kind:key_points", "missing_key:sections[].stories[].article.quote.attribution"]
_CASE_COUNT = len(_CASES)


def _edition_texts(spark, sf):
    n, text = F.col("doc_id"), F.col("text")
    case = n % _CASE_COUNT

    def on(number, there, otherwise=""):
        return F.when(case == number, F.lit(there) if isinstance(there, str) else there).otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)

    def told(prefix, start, size=None):
        part = F.substring(text, F.lit(start), F.length(text)) if size is None else F.substring(text, start, size)
        return _json_text(F.concat(F.lit(prefix), part))

    def story(number, more="", article="null"):
        natural = (F.col("n_chars") % 12).cast("string")
        score = on(3, '"7"', on(4, "7.5", natural)) if number == 2 else F.lit("5")
        slug = on(11, "s-1", f"s-{number}")
        return F.concat(F.lit('{"cluster_id": "c'), n, F.lit("-"), on(11, "1", str(number)), F.lit('", "slug": "'), slug, F.lit('", "title": '), told(f"T{number} ", 171, 50), F.lit(', "summary": '), told("S ", 221),
                        F.lit(', "score": '), score, F.lit(', "sources": [{"name": '), _json_text(F.col("source")), F.lit(', "url": "http://a/'), n, F.lit('"}], "article": '), F.lit(article) if isinstance(article, str) else article, F.lit(more) if isinstance(more, str) else more, F.lit("}"))

    quote = '{"background": "b", "what_happened": "w", "why_it_matters": "y", "quote": {"text": "q", %s"source_url": "http://elsewhere"}}'
    article = on(12, quote % '"attribution": "me", ', on(20, quote % "", "null"))
    second = story(2, on(2, ', "mood": 1'), article)
    point = F.concat(F.lit('{"text": '), told("p ", 71, 100), F.lit(', "topic": "'), on(16, "Ai", "AI"), F.lit('"}'))
    full = F.concat(
        F.lit('{"date": "'), on(9, "1 Jan", "2024-01-01"), F.lit('", "edition_number": '), on(3, "true", "1"), F.lit(', "edition_type": "'), on(18, "loud", "quiet"), F.lit('", "headline_of_the_day": '), on(6, "12", told("H ", 1, 70)),
        F.lit(', "key_points": '), on(19, '"x"', F.concat(F.lit("["), point, F.lit(", "), point, F.lit(", "), point, F.lit("]"))),
        F.lit(', "audio": '), on(8, '{"url": "u", "duration_seconds": 1, "size_bytes": 2, "kind": "mp3"}', on(3, '{"url": "u", "duration_seconds": "1", "size_bytes": 2.0}', "null")),
        F.lit(', "sections": [{"name": "Technology", "stories": ['), story(1), on(10, "", F.concat(F.lit(", "), second)), F.lit("]}]"),
        on(17, F.concat(F.lit(', "briefly": [{"cluster_id": "c9", "title": '), told("t1 ", 171, 50), F.lit(', "url": "u", "topic": "AI"}]'))),
        F.lit(', "stats": {"items_ingested": 1, "clusters_considered": 1, "stories_run": 2'), on(5, "", ', "sources": 1'), F.lit(', "sections_held": 0}'), on(1, ', "why": 1'), F.lit("}"),
        on(7, ", 0] More below."), on(15, "{}"))
    ranked = lambda rank, score: F.concat(F.lit(f'{{"rank": {rank}, "title": '), told("T ", 1, 50), F.lit(f', "score": {score}, "url": "u", "source": "x"}}'))
    fallback = F.concat(F.lit('{"date": "2024-01-01", "edition_number": 2, "edition_type": "fallback", "notice": '), told("n ", 1, 90), F.lit(', "stories": ['), ranked(1, 5), F.lit(", "), on(13, ranked(2, 6), ranked(2, '"5"')), F.lit("]}"))
    return table(spark, sf, "documents").select("doc_id", F.when(case.isin(13, 14), fallback).otherwise(full).alias("edition_json"))


def _dashes(start, size=""):
    return f"substr(text, {start}{size}) LIKE '%—%'"


@query("check_editions", f"""SELECT doc_id, CASE WHEN k IN (13, 14) THEN array_to_string(list_filter([CASE WHEN k = 13 THEN 'score_order' END], lambda x: x IS NOT NULL) || list_filter([CASE WHEN {_dashes(1, ', 90')} THEN 'notice_em_dash' END, CASE WHEN {_dashes(1, ', 50')} THEN 'story_em_dash' END], lambda x: x IS NOT NULL), ',')
    WHEN fixed <> '' THEN fixed ELSE array_to_string(list_filter([CASE WHEN k = 9 THEN 'date' END, CASE WHEN {_dashes(1, ', 70')} THEN 'headline_em_dash' END, CASE WHEN {_dashes(71, ', 100')} THEN 'key_point_em_dash' END,
      CASE WHEN k = 16 THEN 'key_point_topic' END, CASE WHEN k = 10 THEN 'section_budget' END, CASE WHEN k = 11 THEN 'slug_repeated' END, CASE WHEN k = 11 THEN 'cluster_repeated' END,
      CASE WHEN {_dashes(171)} THEN 'story_em_dash' END, CASE WHEN k NOT IN (3, 10) AND n_chars % 12 NOT BETWEEN 1 AND 10 THEN 'story_score' END, CASE WHEN k = 12 THEN 'quote_source' END,
      CASE WHEN k = 17 AND {_dashes(171, ', 50')} THEN 'briefly_em_dash' END, CASE WHEN k = 17 THEN 'briefly_repeats_story' END], lambda x: x IS NOT NULL), ',') END AS problems
  FROM (SELECT doc_id, text, n_chars, doc_id % {_CASE_COUNT} AS k, ([{', '.join(f"'{c}'" for c in _CASES)}])[CAST(doc_id % {_CASE_COUNT} AS INTEGER) + 1] AS fixed FROM documents)""")
def _(spark, sf):
    return quality.check_editions(_edition_texts(spark, sf)).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("check_curation", """SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'headline_not_placed' WHEN 2 THEN 'key_point_count' WHEN 3 THEN 'rationale_length' WHEN 4 THEN 'not_an_object' ELSE '' END AS problems FROM documents""")
def _(spark, sf):
    kind = F.col("doc_id") % 5
    point = F.struct(F.col("lang").alias("text"), F.lit("AI").alias("topic"))
    story = F.struct(F.col("doc_id").cast("string").alias("cluster_id"), F.col("source").alias("title"), F.col("lang").alias("summary"))
    reply = F.to_json(F.struct(
        F.col("source").alias("headline_of_the_day"), F.when(kind == 1, "other").otherwise(F.col("doc_id").cast("string")).alias("headline_cluster_id"),
        F.when(kind == 3, F.repeat(F.lit("x"), 201)).otherwise("why").alias("headline_rationale"),
        F.when(kind == 2, F.array(point)).otherwise(F.array(point, point, point)).alias("key_points"),
        F.array(F.struct(F.lit("Anything").alias("name"), F.array(story).alias("stories"))).alias("sections"), F.array(F.lit("c")).alias("briefly")))
    rows = table(spark, sf, "documents").withColumn("reply", F.when(kind == 4, "no").otherwise(reply))
    return quality.check_curation(rows).select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("lint_quotes", "SELECT doc_id, n_chars <= 320 AND doc_id % 3 <> 1 AND doc_id % 4 <> 2 AS kept FROM (SELECT doc_id, length(text) AS n_chars FROM documents)")
def _(spark, sf):
    n = F.col("doc_id")
    quote = F.struct(F.col("text"), F.when(n % 3 == 1, "  ").otherwise("someone").alias("attribution"), F.when(n % 4 == 2, "http://x").otherwise("http://a").alias("source_url"))
    rows = table(spark, sf, "documents").withColumn("q", quality.lint_quote(quote, F.array(F.lit("http://a"), F.lit("http://b"))))
    return rows.select("doc_id", F.col("q").isNotNull().alias("kept"))


@query("check_dialogues", f"""SELECT conv_id, count(*) AS turns, CAST(sum(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))) AS BIGINT) AS words,
  array_to_string(list_filter([CASE WHEN count(*) < 4 THEN 'too_few_turns' END, CASE WHEN count(DISTINCT role) <> 2 OR count(*) FILTER (role NOT IN ('user', 'assistant')) > 0 THEN 'speakers' END, CASE WHEN count(*) FILTER (text = '') > 0 THEN 'empty_turn' END,
    CASE WHEN count(*) FILTER (text LIKE '%—%') > 0 THEN 'em_dash' END], lambda x: x IS NOT NULL), ',') AS problems,
  sum(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''))) BETWEEN 1300 AND 1600 AS in_band FROM conversations GROUP BY 1""")
def _(spark, sf):
    speaker = F.when(F.col("role") == "user", "A").when(F.col("role") == "assistant", "B").otherwise(F.col("role"))
    turns = table(spark, sf, "conversations").withColumn("speaker", speaker)
    return quality.check_dialogues(turns, "conv_id").withColumn("problems", F.array_join("problems", ","))
