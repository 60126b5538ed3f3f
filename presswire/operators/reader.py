"""Per-reader newsletters: allocation, records, read times, telemetry, retention."""

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.dates import local_instant
from ..session import written
from .ordering import first_rows

# --- two scores and topics --------------------------------------------------------


def with_legacy_scores(clusters: DataFrame) -> DataFrame:
    """``score`` and ``topic`` for readers that know one score and one topic."""
    return clusters.withColumn("score", F.col("general_score")).withColumn("topic", F.col("primary_topic"))


def story_topics() -> Column:
    """The distinct topics of a story, out of the closed list, in text order."""
    named = F.concat(F.array("primary_topic"), F.coalesce("secondary_topics", F.array().cast("array<string>")))
    return F.array_sort(F.array_intersect(named, F.array(*[F.lit(t) for t in C.TOPICS])))


# --- lookback ---------------------------------------------------------------------

def catching_up(as_of: Column) -> Column:
    """A reader without a newsletter yet, or away longer than the daily window."""
    away = F.col("last_read_at").isNull() | (F.col("last_read_at") < as_of - F.expr(f"INTERVAL {C.LOOKBACK_DAILY_HOURS} HOURS"))
    return ~F.coalesce("has_newsletter", F.lit(False)) | away


def topic_windows(users: DataFrame, as_of: Column) -> DataFrame:
    """Per reader and ranked topic: place, weight, whether the plan covers it,
    and the earliest story time it draws on."""
    topics = users.withColumn("_all", catching_up(as_of)).select(
        "user_id", "allowance", "_all", F.coalesce("added_topics", F.array().cast("array<string>")).alias("_added"),
        F.posexplode("topic_prefs").alias("position", "p"))
    wide = F.col("_all") | F.array_contains("_added", F.col("p.topic"))
    since = F.when(wide, as_of - F.expr(f"INTERVAL {C.LOOKBACK_CATCHUP_DAYS} DAYS")).otherwise(
        as_of - F.expr(f"INTERVAL {C.LOOKBACK_DAILY_HOURS} HOURS"))
    return topics.select("user_id", "position", F.col("p.topic").alias("topic"), F.col("p.weight").alias("weight"),
                         (F.col("position") < F.col("allowance")).alias("entitled"), wide.alias("catchup"), since.alias("since"))


# --- allocation -------------------------------------------------------------------

NEWSLETTER = (
    "user_id string, lead_story_id string, "
    "stories array<struct<story_id: string, claimed_by_topic: string, topped_up: boolean>>, "
    "allocation array<struct<topic: string, weight: int, target: int, filled: int>>, "
    "selected int, topped_up int"
)


def largest_remainder(weights: list[int], seats: int) -> list[int]:
    """Whole shares that sum to `seats`; ties go to the earlier entry."""
    total = sum(weights)
    if not weights or total <= 0:
        weights, total = [1] * len(weights), max(len(weights), 1)
    shares = [w * seats // total for w in weights]
    by_remainder = sorted(range(len(weights)), key=lambda i: (-(weights[i] * seats % total), i))
    for i in by_remainder[: seats - sum(shares)]:
        shares[i] += 1
    return shares


def _fill(prefs: list[tuple[str, int]], waiting: dict[str, int], length: int) -> tuple[list[int], list[int]]:
    """Targets and fills per topic: fill to target, then hand the slots a topic
    cannot use to those with stories left, by weight, until nothing moves."""
    names = [t for t, _ in prefs]
    weights = [w for _, w in prefs]
    targets = largest_remainder(weights, length) if prefs else []
    filled = [min(t, waiting.get(n, 0)) for t, n in zip(targets, names)]
    while True:
        free = length - sum(filled)
        open_ = [i for i, n in enumerate(names) if waiting.get(n, 0) > filled[i]]
        if free <= 0 or not open_:
            return targets, filled
        extra = largest_remainder([weights[i] for i in open_], free)
        for i, more in zip(open_, extra):
            filled[i] += min(more, waiting[names[i]] - filled[i])


def _newsletter(user_id: str, entitled: list, length: int, offers: list) -> dict:
    """One reader's newsletter from the stories offered, best of a topic first."""
    prefs = [(p["topic"], int(p["weight"])) for p in entitled]
    length = int(length)
    own: dict[str, list] = {t: [] for t, _ in prefs}
    outside = []
    for o in offers:
        place = outside if o["outside"] else own[o["claim"]]
        place += [(s["story_id"], s["claim"] if o["outside"] else o["claim"], s["general_score"], s["written_at"]) for s in o["picks"]]
    targets, filled = _fill(prefs, {t: len(part) for t, part in own.items()}, length)
    picked = [(*s, False) for (t, _), n in zip(prefs, filled) for s in own[t][:n]]
    short = min(length - len(picked), int(length * C.TOPUP_MAX_SHARE))
    extra = [(*s, True) for s in outside[: max(short, 0)]]
    picked += extra
    by_story = sorted(picked, key=lambda s: s[0])
    lead = max(by_story, key=lambda s: (s[2], s[3]), default=(None,))[0]  # of equals the first id
    return {
        "user_id": user_id,
        "lead_story_id": lead,
        "stories": [{"story_id": s, "claimed_by_topic": t, "topped_up": up} for s, t, _, _, up in picked],
        "allocation": [{"topic": t, "weight": w, "target": g, "filled": n} for (t, w), g, n in zip(prefs, targets, filled)],
        "selected": len(picked),
        "topped_up": len(extra),
    }


_SEGMENT = 1024  # entries of a ranked list in one row


def _bits(topics: Column) -> Column:
    """Topics of the closed list as a bit mask."""
    bit = F.create_map(*[F.lit(x) for i, t in enumerate(C.TOPICS) for x in (t, 1 << i)])
    return F.aggregate(topics, F.lit(0), lambda m, t: m.bitwiseOR(F.coalesce(bit[t], F.lit(0))))


def _walk(wants: DataFrame, entries: DataFrame, order: list[Column], seen: DataFrame, depth: int = 32) -> DataFrame:
    """The first `need` allowed and unseen entries of a ranked list per reader.

    `wants(user_id, list_id, claim, need, near, far, copies)`, `entries(list_id, story_id,
    mask, fresh, claim, general_score, written_at)`. A fresh entry is allowed where its
    mask shares no bit with `near`, another where it shares none with `far`.

    Lists are rows of up to 1,024 ranked entries, which a reader's row filters where it is:
    only what is picked is written, never what was looked at. Wants that the head of a list
    does not fill go on where it ends, each time eight times as far, down to the end of the
    list, so the result does not depend on the depth. Each round gives rows
    ``(user_id, claim, from, picks)``, `from` being the place the round began at.
    """
    sizes = entries.groupBy("list_id").agg(F.count(F.lit(1)).alias("list_size"))
    asked = ["user_id", "list_id", "claim", "need", "near", "far", "copies", "list_size"]
    waiting, start, found = wants.join(F.broadcast(sizes), "list_id").select(*asked), 0, []

    def fits(e: Column) -> Column:
        reach = F.when(e["fresh"], F.col("near")).otherwise(F.col("far"))
        return (reach.bitwiseAND(e["mask"]) == 0) & ~F.coalesce(F.array_contains("known", e["story_id"]), F.lit(False))

    while True:
        head = first_rows(entries, ["list_id"], order, depth, rank="place", spread="story_id").where(F.col("place") > start)
        head = head.withColumn("segment", F.floor((F.col("place") - 1) / _SEGMENT).cast("int"))
        shown = F.struct("place", "story_id", "mask", "fresh", "claim", "general_score", "written_at")
        ranked = written(head.groupBy("list_id", "segment").agg(F.array_sort(F.collect_list(shown)).alias("entries")), "lists")
        spots = ranked.select("list_id", "segment", F.explode(F.array_distinct(F.transform("entries", lambda e: e["story_id"]))).alias("story_id"))
        if depth <= 2 * _SEGMENT:  # at most two rows of each of the few lists
            ranked, spots = F.broadcast(ranked), F.broadcast(spots)
        # of what a reader has seen, no more than a row of a list holds
        readers = seen if start == 0 else seen.join(waiting.select("user_id").distinct(), "user_id", "left_semi")
        known = readers.join(spots, "story_id").groupBy("user_id", "list_id", "segment").agg(F.collect_set("story_id").alias("known"))
        last = F.floor((F.least(F.lit(depth), F.col("list_size")) - 1) / _SEGMENT).cast("int")
        rows = waiting.withColumn("segment", F.explode(F.sequence(F.lit(start // _SEGMENT), last)))
        rows = rows.join(known, ["user_id", "list_id", "segment"], "left").join(ranked, ["list_id", "segment"])
        hits = F.transform(F.filter("entries", fits), lambda e: F.struct(*[e[c].alias(c) for c in ("story_id", "claim", "general_score", "written_at")]))
        # a reader who is there twice is offered everything twice
        hits = F.when(F.col("copies") > 1, F.flatten(F.transform(hits, lambda e: F.array_repeat(e, F.col("copies").cast("int"))))).otherwise(hits)
        rows = rows.select(*asked, "segment", F.slice(hits, 1, F.greatest("need", F.lit(0))).alias("picks"))
        if depth > _SEGMENT:
            parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", "picks"))), lambda p: p["picks"])
            rows = rows.groupBy(*asked).agg(parts.alias("_parts")).select(*asked, F.slice(F.flatten("_parts"), 1, F.greatest("need", F.lit(0))).alias("picks"))
        done = written(rows.select(*asked, "picks"), "picks")
        found.append(done.where(F.size("picks") > 0).select("user_id", "claim", F.lit(start).alias("from"), "picks"))
        unfilled = done.where((F.size("picks") < F.col("need")) & (F.col("list_size") > depth))
        if unfilled.isEmpty():
            return reduce(DataFrame.unionByName, found)
        waiting = unfilled.withColumn("need", F.col("need") - F.size("picks")).select(*asked)
        start, depth = depth, depth * 8


def allocate(users: DataFrame, stories: DataFrame, seen: DataFrame, as_of: Column) -> DataFrame:
    """One newsletter row per reader.

    `users(user_id, topic_prefs, length, allowance, last_read_at,
    has_newsletter, added_topics)`, `stories(story_id, primary_topic,
    secondary_topics, topic_score, general_score, written_at)`,
    `seen(user_id, story_id)`. Any length is filled as asked, preset or not.

    Readers never meet the story table: each walks the ranked lists of its own
    topics until it has `length` stories a topic, which is all it can use.
    """
    daily = as_of - F.expr(f"INTERVAL {C.LOOKBACK_DAILY_HOURS} HOURS")
    catchup = as_of - F.expr(f"INTERVAL {C.LOOKBACK_CATCHUP_DAYS} DAYS")
    recent = stories.where((F.col("written_at") >= catchup) & (F.col("written_at") <= as_of))
    keyed = recent.select(
        "story_id", "primary_topic", "topic_score", "general_score", F.unix_micros("written_at").alias("written_at"),
        (F.col("written_at") >= daily).alias("fresh"), story_topics().alias("topics"))
    keyed = written(keyed.withColumn("mask", _bits(F.col("topics"))), "stories")
    # a story is on the wide list of each of its topics, a fresh one on the daily list too
    scopes = F.when(F.col("fresh"), F.array(F.lit("daily"), F.lit("wide"))).otherwise(F.array(F.lit("wide")))
    scoped = keyed.withColumn("scope", F.explode(scopes))
    by_topic = scoped.withColumn("topic", F.explode("topics")).withColumn("list_id", F.concat_ws("/", "topic", "scope")).withColumn("claim", F.lit(None).cast("string"))

    base = users.select(
        F.col("user_id").cast("string").alias("user_id"), "length",
        F.slice("topic_prefs", 1, F.col("allowance")).alias("entitled"),
        F.transform("topic_prefs", lambda p: p["topic"]).alias("ranked"),
        F.coalesce("added_topics", F.array().cast("array<string>")).alias("added"),
        catching_up(as_of).alias("away"),
        F.greatest(F.size("topic_prefs") - F.col("allowance"), F.lit(0)).alias("locked_topics"),
    )
    seen_keys = written(seen.select(F.col("user_id").cast("string").alias("user_id"), "story_id").distinct(), "seen")
    # by reader once, so counting copies needs no further shuffle
    whole = base.drop("locked_topics").where("user_id is not null").repartition("user_id")
    readers = written(whole.groupBy(*whole.columns).agg(F.count(F.lit(1)).alias("copies")), "readers")

    # a topic draws on the stories no earlier one has claimed: of fresh ones the earlier topics
    # claim all, of others those that reach back as far; a topic without name claims everything
    ranks = readers.select("*", F.posexplode("entitled").alias("position", "p"))
    wide = F.col("away") | F.array_contains("added", F.col("p.topic"))
    earlier = F.transform(F.slice("entitled", 1, F.col("position")), lambda p: p["topic"])
    back = F.filter(earlier, lambda t: F.col("away") | F.coalesce(F.array_contains("added", t), F.lit(True)))
    own = ranks.where(~F.exists(earlier, lambda t: t.isNull())).select(
        "user_id", F.concat_ws("/", "p.topic", F.when(wide, "wide").otherwise("daily")).alias("list_id"),
        F.col("p.topic").alias("claim"), F.col("length").alias("need"), _bits(earlier).alias("near"), _bits(back).alias("far"), "copies")
    best = [F.desc("topic_score"), F.desc("written_at"), F.col("story_id")]
    mine = _walk(own, by_topic, best, seen_keys)

    # readers whose own topics cannot fill the length look outside of them; the
    # walk finds all there is of a topic up to the length, so a short sum is exact
    supply = mine.groupBy("user_id").agg(F.sum(F.size("picks")).alias("_supply"))
    free = F.col("length") - F.coalesce("_supply", F.lit(0))
    named = F.when(F.exists("ranked", lambda t: t.isNull()), (1 << len(C.TOPICS)) - 1).otherwise(_bits(F.col("ranked")))
    short = readers.join(supply, "user_id", "left").where(free > 0).select(
        "user_id", F.when(F.col("away"), "wide").otherwise("daily").alias("list_id"), F.lit(None).cast("string").alias("claim"),
        F.least(free, F.floor(F.col("length") * C.TOPUP_MAX_SHARE)).cast("int").alias("need"), named.alias("near"), named.alias("far"), "copies")
    high = scoped.where(F.col("general_score") >= C.TOPUP_FLOOR).withColumnRenamed("scope", "list_id").withColumn("claim", F.col("primary_topic"))
    by_general = [F.desc("general_score"), F.desc("written_at"), F.col("story_id")]
    offered = _walk(short, high, by_general, seen_keys)

    # at most a length's worth a topic and the top-up: a short list per reader
    offers = mine.withColumn("outside", F.lit(False)).unionByName(offered.withColumn("outside", F.lit(True))).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("outside", "claim", "from", "picks"))).alias("offers"))

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([
                _newsletter(u, list(e), n, [] if o is None else list(o))
                for u, e, n, o in zip(batch["user_id"], batch["entitled"], batch["length"], batch["offers"])
            ], columns=["user_id", "lead_story_id", "stories", "allocation", "selected", "topped_up"])

    made = base.select("user_id", "entitled", "length").repartition("user_id").join(offers, "user_id", "left").mapInPandas(assemble, NEWSLETTER)
    facts = base.select("user_id", "length", "locked_topics").join(_candidates(base, keyed, seen_keys), "user_id")
    return made.join(facts, "user_id")


def _candidates(base: DataFrame, keyed: DataFrame, seen_keys: DataFrame) -> DataFrame:
    """Unseen stories within reach of each reader, counted, not listed.

    Topic sets are bit masks. Stories count by mask and age: at most two times
    the subsets of the ten topics, a list short enough to collect and to be
    carried by every task. Each pair of masks readers draw on is counted once.
    """
    names = F.transform("entitled", lambda p: p["topic"])
    wide = F.when(F.col("away"), names).otherwise(F.array_intersect(names, F.col("added")))
    masks = base.select("user_id", _bits(names).alias("near"), _bits(wide).alias("far"))
    marked = keyed.select("story_id", "fresh", "mask")
    reach = F.when(F.col("fresh"), F.col("near")).otherwise(F.col("far")).bitwiseAND(F.col("mask")) != 0
    listed = [row.asDict() for row in marked.groupBy("fresh", "mask").agg(F.count(F.lit(1)).alias("n")).collect()]
    sizes = F.from_json(F.lit(json.dumps(listed)), "array<struct<fresh: boolean, mask: int, n: long>>")
    eligible = masks.select("near", "far").distinct().withColumn("_n", F.aggregate(
        F.filter(sizes, lambda g: F.when(g["fresh"], F.col("near")).otherwise(F.col("far")).bitwiseAND(g["mask"]) != 0),
        F.lit(0).cast("long"), lambda total, g: total + g["n"]))
    used = seen_keys.join(marked, "story_id").join(masks, "user_id").where(reach).groupBy("user_id").agg(F.count(F.lit(1)).alias("_used"))
    return masks.join(eligible, ["near", "far"], "left").join(used, "user_id", "left").select(
        "user_id", (F.coalesce("_n", F.lit(0)) - F.coalesce("_used", F.lit(0))).alias("candidates"))


# --- newsletter records -----------------------------------------------------------

def newsletter_records(allocated: DataFrame, users: DataFrame, existing: DataFrame, as_of: Column) -> DataFrame:
    """Records to append: at most one per reader and local date. The intro key
    is shared by readers who got the same stories in the same order."""
    local_date = F.to_date(F.from_utc_timestamp(as_of, F.col("timezone")))
    ids = F.array_join(F.transform("stories", lambda s: s["story_id"]), "|")
    zones = users.select(F.col("user_id").cast("string").alias("user_id"), "timezone", "plan")
    records = allocated.join(zones, "user_id").withColumn("local_date", local_date).join(
        existing.select(F.col("user_id").cast("string").alias("user_id"), "local_date"), ["user_id", "local_date"], "left_anti")
    return records.select(
        F.sha2(F.concat_ws("|", "user_id", F.col("local_date").cast("string")), 256).substr(1, C.ID_CHARS).alias("newsletter_id"),
        "user_id", "local_date", "timezone", as_of.alias("assembled_at"), F.lit(None).cast("string").alias("intro"),
        F.sha2(ids, 256).alias("intro_key"), "lead_story_id", "length", "plan", "stories", "allocation",
        F.struct("candidates", "selected", "topped_up", "locked_topics").alias("stats"))


def next_read(users: DataFrame, now: Column) -> DataFrame:
    """The next instant of each reader's local read time, computed, not stored."""
    today = F.to_date(F.from_utc_timestamp(now, F.col("timezone")))
    first = local_instant(today, F.col("read_time_local"), F.col("timezone"))
    second = local_instant(F.date_add(today, 1), F.col("read_time_local"), F.col("timezone"))
    return users.withColumn("next_read_at", F.when(first >= now, first).otherwise(second))


# --- telemetry --------------------------------------------------------------------

def score_band(score: Column) -> Column:
    return F.when(score >= 8, "8-10").when(score >= 6, "6-7").when(score >= 4, "4-5").otherwise("1-3")


def reading_rates(selected: DataFrame, events: DataFrame) -> DataFrame:
    """What was selected against what was read, by topic, score band and top-up.

    `selected(user_id, story_id, topic, score, topped_up)`,
    `events(user_id, story_id, event)`. Events are folded to one row per reader
    and story before the join, so repeated events do not count twice.
    """
    def had(name: str) -> Column:
        return F.max(F.when(F.col("event") == name, 1).otherwise(0)).alias(name)

    names = ["story_opened", "story_completed", "story_skipped"]
    folded = events.where(F.col("event").isin(names)).groupBy("user_id", "story_id").agg(*[had(n) for n in names])
    joined = selected.join(folded, ["user_id", "story_id"], "left").na.fill(0, names)
    total = F.count(F.lit(1))
    return joined.groupBy("topic", score_band(F.col("score")).alias("band"), "topped_up").agg(
        total.alias("selected"), *[F.sum(n).alias(n.removeprefix("story_")) for n in names],
        (F.sum("story_opened") / total).alias("open_rate"), (F.sum("story_completed") / total).alias("complete_rate"),
        (F.sum("story_skipped") / total).alias("skip_rate"))


# --- retention and deletion -------------------------------------------------------

def retained(rows: DataFrame, kind: str, at: str, now: Column) -> DataFrame:
    """Rows young enough to keep; the bound prunes date partitions."""
    return rows.where(F.col(at) >= F.add_months(F.to_date(now), -C.RETENTION_MONTHS[kind]))


def without_accounts(rows: DataFrame, deleted: DataFrame, key: str = "user_id") -> DataFrame:
    return rows.join(deleted.select(F.col("user_id").alias(key)).distinct(), key, "left_anti")


def touched_partitions(rows: DataFrame, deleted: DataFrame, partition: str, key: str = "user_id") -> DataFrame:
    """Partitions that hold a deleted account, so only those are rewritten."""
    gone = deleted.select(F.col("user_id").alias(key)).distinct()
    return rows.join(gone, key, "left_semi").select(partition).distinct()
