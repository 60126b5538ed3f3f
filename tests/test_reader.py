"""The allocator against a per-reader brute force, its rules, and read times."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.operators import reader
from presswire.plans import reader_queries as q

NOW = datetime(2024, 2, 1, 12)
USERS = ("user_id string, topic_prefs array<struct<topic:string,weight:int>>, length int, allowance int, "
         "last_read_at timestamp, has_newsletter boolean, added_topics array<string>")
STORIES = "story_id string, primary_topic string, secondary_topics array<string>, topic_score int, general_score int, written_at timestamp"


def brute(user, stories, seen):
    """The rules as written, over every story."""
    prefs = [(p["topic"], p["weight"]) for p in user["topic_prefs"]]
    entitled, ranked = prefs[: user["allowance"]], {t for t, _ in prefs}
    away = not user["has_newsletter"] or user["last_read_at"] is None or user["last_read_at"] < NOW - timedelta(hours=36)
    since = {t: NOW - (timedelta(days=7) if away or t in (user["added_topics"] or []) else timedelta(hours=36)) for t, _ in entitled}
    unseen = [s for s in stories if s["story_id"] not in seen and s["written_at"] <= NOW]
    topics = lambda s: {s["primary_topic"], *(s["secondary_topics"] or [])}
    own = {t: [] for t, _ in entitled}
    for s in unseen:
        claim = next((t for t, _ in entitled if t in topics(s) and s["written_at"] >= since[t]), None)
        if claim:
            own[claim].append(s)
    order = lambda s: (-s["topic_score"], -s["written_at"].timestamp(), s["story_id"])
    targets, filled = reader._fill(entitled, {t: len(v) for t, v in own.items()}, user["length"])
    out = [(s["story_id"], t, False) for (t, _), n in zip(entitled, filled) for s in sorted(own[t], key=order)[:n]]
    short = min(user["length"] - len(out), int(user["length"] * C.TOPUP_MAX_SHARE))
    base = NOW - (timedelta(days=7) if away else timedelta(hours=36))
    rest = [s for s in unseen if not topics(s) & ranked and s["general_score"] >= C.TOPUP_FLOOR and s["written_at"] >= base]
    rest.sort(key=lambda s: (-s["general_score"], -s["written_at"].timestamp(), s["story_id"]))
    out += [(s["story_id"], s["primary_topic"], True) for s in rest[: max(short, 0)]]
    return out, sum(len(v) for v in own.values())


def test_matches_brute_force_on_the_small_tables(spark, sf):
    users, stories, seen = q.users(spark, sf), q.stories(spark, sf), q.seen(spark, sf)
    got = {r.user_id: r for r in reader.allocate(users, stories, seen, q.as_of()).collect()}
    story_rows = [r.asDict() for r in stories.collect()]
    seen_by = {}
    for r in seen.collect():
        seen_by.setdefault(r.user_id, set()).add(r.story_id)
    people = users.collect()
    assert len(got) == len(people)
    kinds = set()
    for u in people:
        want, candidates = brute(u, story_rows, seen_by.get(u.user_id, set()))
        mine = [(s.story_id, s.claimed_by_topic, s.topped_up) for s in got[u.user_id].stories]
        assert mine == want, u.user_id
        assert got[u.user_id].candidates == candidates
        assert sum(a.target for a in got[u.user_id].allocation) == u.length
        kinds |= {t for _, _, t in mine}
    assert kinds == {True, False}  # both ways of filling were exercised


def story(i, topic="AI", score=5, general=5, hours=1, also=None):
    return (f"s{i:03}", topic, also, score, general, NOW - timedelta(hours=hours))


def run(spark, prefs, stories, length=5, allowance=10, seen=(), last=1, has=True, added=None):
    users = spark.createDataFrame([("u", prefs, length, allowance, None if last is None else NOW - timedelta(hours=last), has, added)], USERS)
    out = reader.allocate(users, spark.createDataFrame(stories, STORIES), spark.createDataFrame([("u", s) for s in seen], "user_id string, story_id string"), F.lit(NOW))
    return out.collect()[0]


def ids(row):
    return [s.story_id for s in row.stories]


def test_one_topic_gets_the_whole_length_and_recent_first_on_ties(spark):
    row = run(spark, [("AI", 1)], [story(i, hours=i + 1) for i in range(9)])
    assert ids(row) == ["s000", "s001", "s002", "s003", "s004"] and row.topped_up == 0


def test_seen_and_locked_topics_never_appear(spark):
    stories = [story(i) for i in range(4)] + [story(i, "World", general=9) for i in range(10, 14)]
    row = run(spark, [("AI", 1), ("World", 9)], stories, allowance=1, seen=["s000"])
    assert set(ids(row)) == {"s001", "s002", "s003"} and row.locked_topics == 1


def test_top_up_has_a_floor_and_a_cap(spark):
    stories = [story(1)] + [story(i, "World", general=9) for i in range(10, 20)] + [story(30, "Sports", general=5)]
    row = run(spark, [("AI", 1)], stories, length=8)
    assert row.topped_up == 4 and row.selected == 5 and "s030" not in ids(row)
    assert [s.topped_up for s in row.stories] == [False] + [True] * 4


def test_a_shared_story_goes_to_the_earlier_topic(spark):
    row = run(spark, [("Cyber", 1), ("AI", 1)], [story(1, "AI", also=["Cyber"]), story(2, "AI")], length=2)
    assert {s.story_id: s.claimed_by_topic for s in row.stories} == {"s001": "Cyber", "s002": "AI"}


def test_windows(spark):
    stories = [story(1, hours=1), story(2, hours=60), story(3, "World", hours=60)]
    assert set(ids(run(spark, [("AI", 1), ("World", 1)], stories))) == {"s001"}
    assert set(ids(run(spark, [("AI", 1), ("World", 1)], stories, has=False))) == {"s001", "s002", "s003"}
    assert set(ids(run(spark, [("AI", 1), ("World", 1)], stories, last=48))) == {"s001", "s002", "s003"}
    assert set(ids(run(spark, [("AI", 1), ("World", 1)], stories, added=["World"]))) == {"s001", "s003"}


def test_no_stories_still_gives_a_row(spark):
    row = run(spark, [("AI", 1)], [story(1, "World", general=2)])
    assert row.selected == 0 and row.lead_story_id is None


def test_lead_is_the_highest_general_score(spark):
    assert run(spark, [("AI", 1)], [story(1, score=9, general=3), story(2, score=1, general=8)]).lead_story_id == "s002"


@pytest.mark.parametrize("weights,seats", [([1, 1, 1], 10), ([5, 3, 2], 11), ([1, 40], 5), ([0, 0], 3), ([7], 16)])
def test_largest_remainder_sums_to_the_seats(weights, seats):
    shares = reader.largest_remainder(weights, seats)
    assert sum(shares) == seats
    assert shares == reader.largest_remainder(weights, seats)


def test_read_time_at_clock_changes(spark):
    cases = [
        ("America/New_York", "02:30:00", "2026-03-08 05:00:00", "2026-03-08 07:00:00"),  # skipped hour: 03:00 EDT
        ("America/New_York", "01:30:00", "2026-11-01 04:00:00", "2026-11-01 05:30:00"),  # repeated hour: first one
        ("America/New_York", "06:00:00", "2026-07-01 11:00:00", "2026-07-02 10:00:00"),  # passed today
        ("Australia/Lord_Howe", "02:10:00", "2026-10-03 14:00:00", "2026-10-03 15:30:00"),  # half-hour gap
    ]
    df = spark.createDataFrame(cases, "timezone string, read_time_local string, now string, want string")
    rows = reader.next_read(df, F.col("now").cast("timestamp")).select(F.col("next_read_at").cast("string").alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_a_length_beyond_the_presets_is_filled(spark):
    row = run(spark, [("AI", 3)], [story(i) for i in range(70)], length=45)
    assert len(row.stories) == 45 and row.allocation[0].target == 45


def test_allocation_writes_what_is_picked(spark, tmp_path, monkeypatch):
    """What a round keeps grows with the stories picked, not with those looked at."""
    kept = {}
    real = reader.written

    def watched(df, kind):
        out = real(df, kind)
        kept.setdefault(kind, []).append(out)
        return out

    monkeypatch.setattr(reader, "written", watched)
    users = [{"user_id": f"u{i}", "topic_prefs": [{"topic": t, "weight": 1} for t in ("AI", "World")], "length": 5, "allowance": 3,
              "last_read_at": None, "has_newsletter": False, "added_topics": None} for i in range(40)] * 2
    # every World story is on AI too, but for the last ones: readers walk the whole World list for them
    stories = [{"story_id": f"s{i:05}", "primary_topic": "World", "secondary_topics": ["AI"] if i < 2600 else None, "topic_score": 10 if i < 2600 else 1,
                "general_score": 1, "written_at": NOW - timedelta(hours=1)} for i in range(2603)]
    seen = spark.createDataFrame([("u0", "s00000"), ("u0", "s02600")], "user_id string, story_id string")
    out = reader.allocate(spark.createDataFrame(users, USERS), spark.createDataFrame(stories, STORIES), seen, F.lit(NOW)).select("user_id", "selected", "candidates", "stories.story_id").distinct().collect()
    got = {r["user_id"]: r for r in out}
    assert len(got) == 40
    # a reader who is there twice is offered every story twice
    twice = lambda own, world: [s for s in own for _ in range(2)][:3] + [s for s in world for _ in range(2)][:2]
    assert got["u1"]["story_id"] == twice(["s00000", "s00001"], ["s02600"])
    assert got["u0"]["story_id"] == twice(["s00001", "s00002"], ["s02601"])
    rows = [p.select(F.coalesce(F.sum(F.size("picks")), F.lit(0)), F.coalesce(F.max(F.size("picks")), F.lit(0))).first() for p in kept["picks"]]
    assert max(r[1] for r in rows) <= 5
    assert sum(r[0] for r in rows) <= 40 * 2 * 5
