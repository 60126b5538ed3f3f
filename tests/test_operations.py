"""Run-log writing, table writes that survive a rerun, and quality rules."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswire.operators import blocks as blocks_of
from presswire.operators import quality, runlog, scoring, similarity
from presswire.sources import editions, tables


def test_a_run_writes_exactly_one_row(spark, tmp_path):
    path = str(tmp_path / "log")
    with runlog.logged_run(spark, path, "silver") as run:
        run.items_in = 3
    with runlog.logged_run(spark, path, "editor") as run:
        raise ValueError("boom")
    with runlog.logged_run(spark, path, "site", dry_run=True):
        pass
    rows = {r.job: r for r in runlog.read_run_log(spark, path).collect()}
    assert set(rows) == {"silver", "editor"} and run.status == "failed"
    assert rows["silver"].status == "success" and rows["silver"].items_in == 3 and rows["silver"].reasons is None
    assert rows["editor"].status == "failed" and json.loads(rows["editor"].reasons) == ["run_failed"] and "boom" in rows["editor"].notes


def test_unknown_codes_are_refused():
    now = datetime(2024, 1, 1).astimezone()
    for bad in ({"job": "x"}, {"status": "x"}, {"reasons": ["x"]}):
        with pytest.raises(ValueError):
            runlog.build_row(**({"run_id": "r", "job": "site", "started_at": now, "ended_at": now, "status": "success"} | bad))


def test_trigger_note(spark):
    df = spark.createDataFrame([("a; trigger=cron",), ("trigger=",), (None,), ("x",)], "n string")
    assert [r.t for r in df.select(runlog.trigger_of(F.col("n")).alias("t")).collect()] == ["cron", "unknown", "unknown", "unknown"]


def test_degraded_reads_bad_json_as_not_degraded(spark):
    df = spark.createDataFrame([('["assembly_fallback"]',), ('["thin_day_fallback"]',), ("nope",), (None,)], "r string")
    assert [r.d for r in df.select(runlog.is_degraded(F.col("r")).alias("d")).collect()] == [True, False, False, False]


ROWS = "k string, v int, d date"


def test_empty_overwrite_leaves_the_table(spark, tmp_path):
    path, day = str(tmp_path / "t"), date(2024, 1, 1)
    tables.overwrite_days(spark.createDataFrame([("a", 1, day), ("b", 1, date(2024, 1, 2))], ROWS), path, "d")
    tables.overwrite_days(spark.createDataFrame([], ROWS), path, "d")
    tables.overwrite_days(spark.createDataFrame([("c", 2, day)], ROWS), path, "d")
    assert {(r.k, r.v) for r in tables.read_table(spark, path, ROWS, partition="d").collect()} == {("b", 1), ("c", 2)}


def test_upsert_counts_new_keys_and_last_duplicate_wins(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([("a", 1, date(2024, 1, 3)), ("b", 1, date(2024, 2, 3))], ROWS)
    assert tables.upsert_months(first, path, ROWS, "d", ["k"]) == 2
    assert tables.upsert_months(first, path, ROWS, "d", ["k"]) == 0
    again = spark.createDataFrame([("a", 5, date(2024, 1, 9)), ("a", 7, date(2024, 1, 9)), ("c", 1, date(2024, 1, 9))], ROWS)
    assert tables.upsert_months(again, path, ROWS, "d", ["k"], F.col("v")) == 1
    rows = tables.read_table(spark, path, ROWS + ", month string", partition="month").collect()
    assert {(r.k, r.v) for r in rows} == {("a", 7), ("b", 1), ("c", 1)}


def test_missing_table_reads_empty(spark, tmp_path):
    assert tables.read_table(spark, str(tmp_path / "none"), ROWS, days=[date(2024, 1, 1)], partition="d").count() == 0


def test_an_id_under_another_day_counts_as_new(spark):
    stored = spark.createDataFrame([("a", date(2024, 1, 1))], "item_id string, ingest_date date")
    batch = spark.createDataFrame([("a", date(2024, 1, 2)), ("b", date(2024, 1, 2))], "item_id string, ingest_date date")
    assert {r.item_id for r in tables.new_rows(batch, stored).collect()} == {"a", "b"}


def test_fallback_never_replaces_a_published_edition(spark):
    rows = "date date, edition_type string"
    published = spark.createDataFrame([(date(2024, 1, 1), "quiet"), (date(2024, 1, 2), "fallback")], rows)
    new = spark.createDataFrame([(date(2024, 1, 1), "fallback"), (date(2024, 1, 2), "fallback"), (date(2024, 1, 3), "fallback")], rows)
    assert {r.date.day for r in editions.publishable(new, published).collect()} == {2, 3}


def test_edition_files_skip_the_unreadable(spark, tmp_path):
    (tmp_path / "2024-01-01.json").write_text(json.dumps({"date": "2024-01-01", "edition_number": 4, "edition_type": "quiet"}, indent=2))
    (tmp_path / "2024-01-02.json").write_text("{")
    assert [(r.date.day, r.edition_number) for r in editions.read_editions(spark, str(tmp_path)).collect()] == [(1, 4)]


def test_pairs_match_brute_force_with_small_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 8))
    rows = []
    for i in range(150):
        v = base[i % 6] + 0.5 * rng.standard_normal(8)
        rows.append((date(2024, 1, 1 + i % 9), f"r{i}", (v / np.linalg.norm(v)).astype("float32").tolist()))
    df = spark.createDataFrame(rows, "day date, id string, vector array<float>")
    got = {(r.id, r.prior_id) for r in similarity.similar_before(df, df, 0.8, 4, block_rows=5).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if 0 < (a[0] - b[0]).days <= 4 and float(np.dot(np.array(a[2], dtype="float64"), np.array(b[2], dtype="float64"))) >= 0.8}
    assert got == want and len(want) > 100


def test_dialogue_rules(spark):
    rows = [("ok", s, "one two") for s in "ABAB"] + [("one", "A", "x")] * 4 + [("few", "A", "x"), ("few", "B", "—")]
    out = {r.script_id: r for r in quality.check_dialogues(spark.createDataFrame(rows, "script_id string, speaker string, text string")).collect()}
    assert out["ok"].problems == [] and out["ok"].words == 8 and not out["ok"].in_band
    assert out["one"].problems == ["speakers"] and out["few"].problems == ["too_few_turns", "em_dash"]


def test_scoring_prompt_names_every_member(spark):
    from presswire.operators import edition, scoring

    rows = [("2024-01-01", "c", f"i{n}", f"2024-01-01 0{n}:00:00", f"s{n}", f"T{n}", "u", "") for n in range(9)]
    members = spark.createDataFrame(rows, "ingest_date string, cluster_id string, item_id string, published_at string, source string, title string, canonical_url string, body_excerpt string")
    prompt = edition.ordered_members(members).select(scoring.scoring_prompt("members").alias("p")).first().p
    assert prompt.startswith("Reports of one event: 9, from s0, ") and prompt.endswith("* T8")


def test_replies_with_text_behind_them_are_rejected(spark):
    from presswire.operators import scoring

    good = '{"score": 7, "topic": "World", "rationale": "r", "confidence": 0.5}'
    replies = spark.createDataFrame([(good,), (good + " Hope that helps!",), (good + "," + good,), (good + "] x",)], "reply string")
    assert [r.score is not None for r in scoring.check_replies(replies).collect()] == [True, False, False, False]


KIND = "struct<edition_type:string,notice:string,headline_of_the_day:string,key_points:array<struct<text:string,topic:string>>,sections:array<struct<name:string,stories:array<struct<slug:string,summary:string,article:struct<background:string,what_happened:string,why_it_matters:string,quote:struct<text:string>>>>>>>"
HARD = "Incomprehensible institutional responsibilities notwithstanding internationalization characteristically. "


def test_revision_stops_when_easy_or_after_three_passes(spark):
    from presswire.operators import readability

    def text(n):
        return json.dumps({"edition_type": "normal", "headline_of_the_day": HARD * n if n else "We go.", "key_points": [{"text": "It is so.", "topic": "AI"}], "sections": []})

    rows = spark.createDataFrame([("easy", text(0)), ("once", text(1)), ("thrice", text(3)), ("never", text(8))], "date string, t string")
    editions = rows.select("date", F.from_json("t", KIND).alias("edition"))

    def make():
        def cut(t):  # a pass takes one hard sentence away
            if not t.startswith("Incomp"):
                raise ValueError("not asked for")
            rest = t[len(HARD):]
            return "We did. " + "It ran so. " * 3 if not rest else "We go. " * 2 + rest if rest.count("Incomp") > 5 else rest
        return cut

    got = {r.date: r for r in readability.revise(editions, make).collect()}
    assert set(got) == {"easy", "once", "thrice", "never"}
    assert (got["easy"].passes, got["easy"].hard) == (0, False) and got["easy"].edition.headline_of_the_day == "We go."
    assert (got["once"].passes, got["once"].hard) == (1, False) and got["once"].edition.headline_of_the_day.startswith("We did.")
    assert got["never"].hard and got["never"].average > 9 and got["never"].passes == 3
    assert got["once"].edition.key_points[0].text == "It is so."


def test_every_day_has_an_edition(spark):
    """A day whose sections are all too short gets a fallback; of two articles of a story the last counts."""
    from presswire.operators import edition

    day = lambda n: date(2024, 1, n)
    curated = spark.createDataFrame(
        [(day(1), "World", 1, i, f"c{i}", f"title {i}", "text") for i in range(3)] + [(day(2), s, p, 0, f"d{p}", "title", "text") for p, s in enumerate(("World", "AI"))],
        "date date, section string, section_pos int, story_pos int, cluster_id string, title string, summary string")
    source = "sources array<struct<name: string, url: string>>"
    contexts = spark.createDataFrame(
        [(r.date, r.cluster_id, 5, [("s", "http://s")], "h", "http://s", "s", "World") for r in curated.collect()],
        f"ingest_date date, cluster_id string, score int, {source}, headline string, primary_url string, primary_source string, topic string")
    heads = spark.createDataFrame([(day(n), "head", "c0", "why", [("p", "World")] * 3) for n in (1, 2)], "date date, headline_of_the_day string, headline_cluster_id string, headline_rationale string, key_points array<struct<text: string, topic: string>>")
    article = "struct<background:string,what_happened:string,why_it_matters:string,quote:struct<text:string,attribution:string,source_url:string>>"
    articles = spark.createDataFrame([(day(1), "c0", 0, ("first", "b", "c", None)), (day(1), "c0", 1, ("second", "b", "c", None)), (day(2), "c0", 2, ("other day", "b", "c", None))],
                                     f"date date, cluster_id string, position int, article {article}")
    numbers = spark.createDataFrame([(day(n), n) for n in (1, 2)], "date date, edition_number int")
    types = spark.createDataFrame([(day(n), "quiet") for n in (1, 2)], "ingest_date date, edition_type string")
    stats = spark.createDataFrame([(day(n), 9, 5, 3, 1, 0) for n in (1, 2)], "ingest_date date, items_ingested int, clusters_considered int, stories_run int, sources int, sections_held int")
    briefly = spark.createDataFrame([], "date date, position int, cluster_id string")
    full = edition.assemble_editions(curated, briefly, heads, contexts, articles, numbers, types, stats)
    found = {r.date: r for r in edition.daily_editions(full, contexts, numbers, numbers, "short").collect()}
    assert {d: r.edition_type for d, r in found.items()} == {day(1): "quiet", day(2): "fallback"}
    first = json.loads(found[day(1)].edition_json)
    assert [s["cluster_id"] for s in first["sections"][0]["stories"]] == ["c0", "c1", "c2"]
    assert first["sections"][0]["stories"][0]["article"]["background"] == "second"
    assert len(json.loads(found[day(2)].edition_json)["stories"]) == 2


def test_text_behind_an_edition_and_missing_stats(spark):
    from presswire.operators import quality

    good = {"date": "2024-01-01", "edition_number": 1, "edition_type": "fallback", "notice": "n", "stories": []}
    texts = [json.dumps(good), json.dumps(good) + " tail", json.dumps(good) + "] [", json.dumps(good | {"edition_type": "quiet", "stats": {"items_ingested": 1}}), "[1]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, edition_json string")
    found = {r.n: r.problems for r in quality.check_editions(rows).collect()}
    assert found[0] == [] and found[1] == found[2] == found[4] == ["not_an_object"]
    assert "missing_key:stats.sources" in found[3]


def test_blocks_of_a_crowded_day_are_few(spark):
    rng = np.random.default_rng(3)
    rows = [(date(2024, 5, 1), f"v{i:04}", rng.standard_normal(8).tolist()) for i in range(800)]
    blocks = blocks_of.pack_blocks(spark.createDataFrame(rows, "day date, id string, vector array<double>"), 100).collect()
    assert sum(len(b.ids) for b in blocks) == 800
    assert len(blocks) <= 2 * 8  # eight are needed; a cell is cut in two where it holds more than its share


def test_most_block_pairs_end_before_their_matrices(spark):
    """Two days of 60 topics in 40 directions: centers decide, matrices of near blocks alone are fetched."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 48))
    def day_of(day, n):
        v = base[rng.integers(60, size=n)] + 0.15 * rng.standard_normal((n, 48))
        return [(day, f"{day.day}-{i}", (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]

    old, new = day_of(date(2024, 5, 1), 1500), day_of(date(2024, 5, 2), 1500)
    schema = "day date, id string, vector array<double>"
    left, right = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    newer, older = blocks_of.pack_blocks(left, 25), blocks_of.pack_blocks(right, 25)
    pairs = similarity.blocks_before(newer, older, 30)
    near = pairs.where(blocks_of.within_reach(0.82))
    assert near.count() < 0.2 * pairs.count()
    assert "matrix" not in near._jdf.queryExecution().executedPlan().toString()
    found = {(r.id, r.prior_id) for r in similarity.similar_before(left, right, 0.82, 30, 25).collect()}
    cosines = np.array([r[2] for r in new]) @ np.array([r[2] for r in old]).T
    assert found == {(new[i][1], old[j][1]) for i, j in zip(*np.nonzero(cosines >= 0.82))} and len(found) > 10_000


def test_prior_mentions_read_only_the_days_in_reach(spark, tmp_path):
    schema = "ingest_date date, cluster_id string, vector array<double>, headline string, summary_seed string"
    day = date(2024, 5, 31)
    gold = [(day - timedelta(days=n), f"c{n}", [1.0, 0.0], f"told {n}", None) for n in (0, 1, 30, 31, 400)]
    spark.createDataFrame(gold, schema).write.partitionBy("ingest_date").parquet(str(tmp_path / "gold"))
    stored = spark.read.schema(schema).parquet(str(tmp_path / "gold"))
    today = spark.createDataFrame([(day, "new", [1.0, 0.0], "h", None)], schema)
    ids = stored.select("cluster_id")
    found = similarity.prior_mentions(today, stored, ids, threshold=0.9)
    assert sorted(r.prior_cluster_id for r in found.collect()) == ["c1", "c30"]
    assert "PartitionFilters: [isnotnull(ingest_date" in similarity.days_in_reach(today, stored, 30)._jdf.queryExecution().toString()
    assert similarity.prior_mentions(today.where("false"), stored, ids).count() == 0


def test_a_rationale_must_be_a_string_itself(spark):
    good = '{"score": 5, "topic": "AI", "rationale": "why", "confidence": 0.5}'
    inside = '{"score": 5, "topic": {"rationale": "AI"}, "rationale": 7, "confidence": 0.5}'
    number = '{"score": 5, "topic": "AI", "rationale": 7, "confidence": 0.5}'
    got = scoring.check_replies(spark.createDataFrame([(1, good), (2, inside), (3, number)], "k int, reply string")).collect()
    problems = {r.k: r.problems for r in got}
    assert problems[1] == [] and "rationale" in problems[2] and problems[3] == ["rationale"]


def test_scores_name_their_model_also_when_null(spark):
    rows = [(date(2024, 5, 1), "a", 1, 5, "AI", "why", 0.5), (date(2024, 5, 1), "b", 1, None, None, None, None)]
    attempts = spark.createDataFrame(
        rows, "ingest_date date, cluster_id string, attempt int, score int, topic string, rationale string, confidence double")
    got = scoring.settle_scores(attempts, F.lit(0.0), F.lit("m1"), F.lit("p1"), F.lit(datetime(2024, 5, 1, 9))).collect()
    assert {(r.cluster_id, r.score, r.model_version, r.prompt_version, r.scored_at) for r in got} == {
        ("a", 5, "m1", "p1", datetime(2024, 5, 1, 9)), ("b", None, "m1", "p1", datetime(2024, 5, 1, 9))}


def test_edition_sink_keeps_what_is_published(spark, tmp_path):
    path = str(tmp_path / "editions")

    def write(*rows):
        schema = "date date, edition_number int, edition_type string, edition_json string"
        texts = [(date(2024, 1, d), n, kind, json.dumps({"date": f"2024-01-{d:02}", "edition_number": n, "edition_type": kind}) if kind != "broken" else "{") for d, n, kind in rows]
        return editions.write_editions(spark.createDataFrame(texts, schema), path)

    def stored():
        return {(r.date.day, r.edition_number, r.edition_type) for r in editions.read_editions(spark, path).collect()}

    assert write((1, 1, "normal"), (2, 2, "fallback"), (3, 3, "broken"), (4, 4, "quiet")) == 4
    assert stored() == {(1, 1, "normal"), (2, 2, "fallback"), (4, 4, "quiet")}
    assert write((1, 9, "fallback"), (2, 9, "fallback"), (3, 9, "fallback")) == 2
    assert write() == 0 and write((4, 8, "quiet"), (4, 7, "normal")) == 1
    assert stored() == {(1, 1, "normal"), (2, 9, "fallback"), (3, 9, "fallback"), (4, 8, "quiet")}
    before = stored()
    assert write((1, 9, "fallback")) == 0 and stored() == before


def test_only_pages_asked_for_are_parsed(spark):
    from presswire.operators import enrich

    pages = spark.createDataFrame([(1, "http://a/1", "<p>long enough to help</p>"), (2, "http://a/2", "<p>never asked for</p>")], "page_id long, url string, html string")
    asked = spark.createDataFrame([("http://a/1",)], "canonical_url string")
    found = enrich.page_texts(pages, asked)
    assert [r.page_text for r in found.collect()] == ["long enough to help"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Project")  # the join is below what parses
