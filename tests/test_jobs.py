"""The joined jobs, run twice over small landed files."""

import json
from datetime import date, datetime, timezone

import pytest

from presswire.operators import items, jobs, runlog
from presswire.sources import tables

NOW = datetime(2024, 1, 2, 12, tzinfo=timezone.utc)
DAY = date(2024, 1, 2)


def landed(folder, name, titles):
    (folder / name).mkdir(parents=True)
    news = [{"headline": t, "url": f"http://{name}.example.com/{i}", "datetime": str(1704193200 + i), "summary": t} for i, t in enumerate(titles)]
    (folder / name / "a.json").write_text(json.dumps(news))
    return {"name": name, "format": "market_news_json", "topic_hint": "World", "max_items_per_run": 100, "path": str(folder / name)}


@pytest.fixture()
def lake(tmp_path):
    return {k: str(tmp_path / "lake" / k) for k in ("items", "clusters", "log")}


def test_collect_then_cluster_twice(spark, tmp_path, lake):
    registry = [landed(tmp_path, "a", ["Rates rise", "Storm"]), landed(tmp_path, "b", ["Rates rise again"]), {"name": "off", "format": "rss", "topic_hint": "World", "max_items_per_run": 5, "path": str(tmp_path / "none")}]
    first = jobs.collect_job(spark, registry, lake["items"], lake["log"], now=NOW)
    assert (first.status, first.items_in, first.items_out) == ("partial", 3, 3) and first.adapter_metrics["off"] == {"items": 0, "errors": 1}
    second = jobs.collect_job(spark, registry, lake["items"], lake["log"], now=NOW)
    assert (second.items_in, second.items_out) == (3, 0)

    def make_model():
        return lambda texts: [[1.0 if t.startswith("Rate") else 0.0, 0.0 if t.startswith("Rate") else 1.0] for t in texts]

    def make_scorer():
        def score(prompt):
            if "Storm" in prompt:
                raise RuntimeError("the model is out")
            return json.dumps({"score": 8, "topic": "AI", "rationale": "r", "confidence": 0.5}), {"input_tokens": 10}
        return score

    args = (spark, DAY, lake["items"], lake["clusters"], lake["log"], make_model, make_scorer, "m-1", "p-1")
    run = jobs.silver_job(*args)
    assert (run.status, run.items_in, run.items_out, run.reasons) == ("partial", 3, 2, ["null_scores"]), run.notes
    rows = {"Storm" if r.member_count == 1 else "Rates": r for r in tables.read_table(spark, lake["clusters"], jobs.CLUSTER_SCHEMA, days=[DAY]).collect()}
    assert (rows["Rates"].member_count, rows["Rates"].score, rows["Rates"].model_version) == (2, 8, "m-1")
    assert (rows["Storm"].score, rows["Storm"].prompt_version) == (None, "p-1")
    again = jobs.silver_job(*args)
    assert again.notes[0] == "scored 1" and again.items_out == 2  # the one without a score is asked for again
    log = runlog.read_run_log(spark, lake["log"]).collect()
    assert sorted((r.job, r.status) for r in log) == [("collector", "partial")] * 2 + [("silver", "partial")] * 2


def test_nothing_collected_is_a_failure(spark, tmp_path, lake):
    run = jobs.collect_job(spark, [landed(tmp_path, "a", [])], lake["items"], lake["log"], now=NOW)
    assert (run.status, run.reasons, run.items_out) == ("failed", ["no_items"], 0)
    assert tables.read_table(spark, lake["items"], items.ITEM_SCHEMA).count() == 0


def test_a_day_from_files_to_the_record(spark, tmp_path, lake):
    """Six stories of one topic make a quiet edition; the archive run empties the day; later runs change nothing."""
    from presswire.sources import editions

    paths = lake | {k: str(tmp_path / "lake" / k) for k in ("editions", "gold_items", "gold_clusters", "gold_editions")}
    registry = [landed(tmp_path, "a", [f"Story {w}" for w in ("one", "two", "three", "four", "five", "six")])]
    jobs.collect_job(spark, registry, paths["items"], paths["log"], now=NOW)

    def make_model():
        return lambda texts: [[float(ord(c)) ** (4 if i % 2 else 3) * (-1) ** ord(c) for i, c in enumerate(t[6:10].ljust(4))] for t in texts]

    def make_scorer():
        return lambda prompt: (json.dumps({"score": 8, "topic": "AI", "rationale": "r", "confidence": 0.5}), {})

    day = (spark, DAY, paths["items"], paths["clusters"])
    assert jobs.silver_job(*day, paths["log"], make_model, make_scorer, "m", "p", threshold=0.9999).items_out == 6
    first = jobs.edition_job(*day, paths["editions"], paths["log"])
    assert (first.status, first.items_out, first.notes) == ("success", 1, ["quiet edition"]), (first.notes, first.reasons)
    stored = editions.read_editions(spark, paths["editions"]).collect()
    second = jobs.edition_job(*day, paths["editions"], paths["log"])
    assert second.items_out == 1 and editions.read_editions(spark, paths["editions"]).collect() == stored
    archived = jobs.archive_job(spark, DAY, paths, paths["log"])
    assert (archived.status, archived.items_in, archived.items_out, archived.notes) == ("success", 6, 6, ["6 clusters, 1 editions added"])
    again = jobs.archive_job(spark, DAY, paths, paths["log"])
    assert (again.items_in, again.items_out) == (0, 0)
    late = jobs.edition_job(*day, paths["editions"], paths["log"])
    assert (late.status, late.reasons) == ("failed", ["no_items"]) and editions.read_editions(spark, paths["editions"]).collect() == stored
