"""Replies and editions that are nearly right."""

import json

import pytest
from pyspark.sql import functions as F

from presswire.functions import strict
from presswire.operators import quality, readability, scoring

REPLY = {"score": 5, "topic": "AI", "rationale": "it matters", "confidence": 0.5}


def test_nothing_may_stand_beside_the_object(spark):
    good = json.dumps(REPLY)
    texts = [good, f"  {good}\n", good + " tail", good + "], 0] tail", good + ", 0] tail", good + "]", good + good, "[" + good + "]", good + ",", good + "] [1", "", None, "7", good[:-1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, reply string")
    found = {r.n: r.problems for r in scoring.check_replies(rows).collect()}
    assert [n for n in found if not found[n]] == [0, 1]
    assert all(found[n] == ["not_an_object"] for n in found if n > 1)


@pytest.mark.parametrize("value, whole", [("7", 7), ("7.0", 7), ('"7"', 7), ('" 7 "', 7), ("true", 1), ('"7.0"', 7), ("7e0", 7), ("7.5", None), ('"7.5"', None), ('"seven"', None), ("null", None), ('"NaN"', None), ('"Infinity"', None), ('"7d"', None), ("[7]", None)])
def test_whole_numbers(spark, value, whole):
    text = json.dumps(REPLY).replace('"score": 5', f'"score": {value}')
    row = scoring.check_replies(spark.createDataFrame([(text,)], "reply string")).first()
    assert row.score == whole and ("score" in row.problems) == (whole is None)


SHAPE = strict.object_of(
    name=strict.text_value(), size=strict.whole_value(), note=strict.text_value(nullable=True), more=strict.list_of(strict.text_value(), optional=True),
    parts=strict.list_of(strict.object_of(id=strict.text_value(), inner=strict.object_of(nullable=True, deep=strict.whole_value()))))


@pytest.mark.parametrize("change, wanted", [
    ({}, []), ({"name": 3}, ["wrong_kind:name"]), ({"name": None}, ["wrong_kind:name"]), ({"size": "4"}, []), ({"size": 4.0}, []), ({"size": 4.5}, ["wrong_kind:size"]), ({"size": [4]}, ["wrong_kind:size"]),
    ({"note": None}, []), ({"note": 1}, ["wrong_kind:note"]), ({"more": None}, ["wrong_kind:more"]), ({"more": ["a", 1]}, ["wrong_kind:more[]"]), ({"odd": 1}, ["extra_key:odd"]),
    ({"parts": {}}, ["wrong_kind:parts"]), ({"parts": [1]}, ["wrong_kind:parts[]"]), ({"parts": [{"id": "a", "x": 1}, {"inner": {"deep": "no", "y": 2}}]},
     ["extra_key:parts[].inner.y", "extra_key:parts[].x", "missing_key:parts[].id", "wrong_kind:parts[].inner.deep"]),
    ({"parts": [{"id": "a", "inner": {}}]}, ["missing_key:parts[].inner.deep"]), ({"parts": []}, []),
])
def test_shapes(spark, change, wanted):
    text = json.dumps({"name": "n", "size": 1, "parts": [{"id": "a", "inner": None}]} | change)
    assert spark.createDataFrame([(text,)], "t string").select(strict.shape_problems("t", SHAPE)).first()[0] == wanted


def test_missing_keys_and_other_texts(spark):
    rows = spark.createDataFrame([("{}",), ("[]",), ("no",), (None,)], "t string")
    assert [r[0] for r in rows.select(strict.shape_problems("t", SHAPE)).collect()] == [
        ["missing_key:name", "missing_key:parts", "missing_key:size"], ["wrong_kind:$"], ["missing_key:$"], ["missing_key:$"]]


def test_curation_replies_nested(spark):
    story = {"cluster_id": "c", "title": "t", "summary": "s"}
    good = {"headline_of_the_day": "h", "headline_cluster_id": "c", "headline_rationale": "why", "key_points": [{"text": "p", "topic": "AI"}] * 3, "sections": [{"name": "x", "stories": [story]}]}
    texts = [good, good | {"sections": [{"name": "x", "stories": [story | {"score": 1}]}]}, good | {"key_points": [{"text": "p"}] * 3}, good | {"briefly": [1]}]
    rows = spark.createDataFrame([(n, json.dumps(t)) for n, t in enumerate(texts)], "n int, reply string")
    found = [r.problems for r in quality.check_curation(rows).orderBy("n").collect()]
    assert found == [[], ["extra_key:sections[].stories[].score"], ["missing_key:key_points[].topic"], ["wrong_kind:briefly[]"]]


def test_the_last_better_rewrite_counts(spark):
    hard = "Incomprehensible institutional responsibilities notwithstanding internationalization characteristically."
    failing = spark.createDataFrame([("d", "headline", hard, 30.0), ("d", "point:0", hard, 30.0)], "date string, id string, text string, grade double")
    offered = [("d", "headline", 0, "Zebras go."), ("d", "headline", 1, "All is well."), ("d", "headline", 2, hard + " " + hard), ("d", "point:0", 0, "We go — now."), ("d", "other", 0, "No.")]
    got = readability.accepted_rewrites(failing, spark.createDataFrame(offered, "date string, id string, position int, text string")).collect()
    assert [(r.id, r.rewrite) for r in got] == [("headline", "All is well.")]
    assert spark.range(1).select(strict.lax_whole(F.lit("3000000000"))).first()[0] is None
