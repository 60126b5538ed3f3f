"""Rule checks: editions, curation replies, run-log rows, quotes, dialogues.

Each check yields named problems; nothing is raised, bad rows are data.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.strict import lax_whole, list_of, lone_object, object_of, shape_problems, text_value, whole_value
from ..functions.text import SPACES, casefold, strip
from ..sources.editions import EDITION_SCHEMA


def _rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that are broken; an undecidable rule is broken."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))


def _blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _dashed(text: Column) -> Column:
    return F.contains(F.coalesce(text, F.lit("")), F.lit(C.EM_DASH))


def _some(values: Column, test) -> Column:
    return F.coalesce(F.exists(values, test), F.lit(False))


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


# The documents as the record and the curation stage know them: every key, no other.
_SOURCE = object_of(name=text_value(), url=text_value())
_QUOTE = object_of(nullable=True, text=text_value(), attribution=text_value(), source_url=text_value())
_ARTICLE = object_of(nullable=True, background=text_value(), what_happened=text_value(), why_it_matters=text_value(), quote=_QUOTE)
_STORY = object_of(cluster_id=text_value(), slug=text_value(), title=text_value(), summary=text_value(), score=whole_value(),
                   sources=list_of(_SOURCE), article=_ARTICLE)
_POINT = object_of(text=text_value(), topic=text_value())
_HEAD = {"date": text_value(), "edition_number": whole_value(), "edition_type": text_value()}
FULL_SHAPE = object_of(
    **_HEAD, headline_of_the_day=text_value(), headline_cluster_id=text_value(nullable=True), headline_rationale=text_value(nullable=True),
    key_points=list_of(_POINT), audio=object_of(nullable=True, url=text_value(), duration_seconds=whole_value(), size_bytes=whole_value()),
    sections=list_of(object_of(name=text_value(), stories=list_of(_STORY))),
    briefly=list_of(object_of(cluster_id=text_value(), title=text_value(), url=text_value(), topic=text_value()), optional=True),
    stats=object_of(**{c: whole_value() for c in ("items_ingested", "clusters_considered", "stories_run", "sources", "sections_held")}))
FALLBACK_SHAPE = object_of(
    **_HEAD, notice=text_value(),
    stories=list_of(object_of(rank=whole_value(), title=text_value(), score=whole_value(), url=text_value(), source=text_value()), optional=True))
CURATION_SHAPE = object_of(
    headline_of_the_day=text_value(), headline_cluster_id=text_value(), headline_rationale=text_value(), key_points=list_of(_POINT),
    sections=list_of(object_of(name=text_value(), stories=list_of(object_of(cluster_id=text_value(), title=text_value(), summary=text_value())))),
    briefly=list_of(text_value(), optional=True))

# whole numbers are read as written and taken by lax_whole
_AS_WRITTEN = EDITION_SCHEMA.replace(": int", ": string").replace("edition_number int", "edition_number string")


def _full_rules(e: Column) -> dict[str, Column]:
    points, sections, briefly = e["key_points"], e["sections"], F.coalesce(e["briefly"], F.array())
    names = F.transform(sections, lambda s: s["name"])
    stories = F.flatten(F.transform(sections, lambda s: s["stories"]))
    order = F.array(*[F.lit(n) for n in C.SECTION_ORDER])
    low, high = C.MIN_STORIES_PER_SECTION, C.MAX_STORIES_PER_SECTION
    n_points = F.size(points)
    house = F.size(F.filter(points, lambda p: p["topic"] == C.HOUSE_TOPIC))
    titles = F.transform(stories, lambda s: casefold(strip(s["title"])))
    quote = lambda s: s["article"]["quote"]
    in_vocabulary = lambda t, extra: F.coalesce(t.isin(C.TOPICS + extra), F.lit(False))
    kind = e["edition_type"]
    stats = e["stats"]
    return {
        "headline_empty": _blank(e["headline_of_the_day"]),
        "headline_em_dash": _dashed(e["headline_of_the_day"]),
        "rationale_too_long": F.coalesce(F.length(e["headline_rationale"]) > C.RATIONALE_MAX_CHARS, F.lit(False)),
        "key_point_count": ~F.when(kind == "normal", n_points.between(*C.KEY_POINTS["normal"])).otherwise(
            n_points.between(*C.KEY_POINTS["quiet"])),
        "key_point_empty": _some(points, lambda p: _blank(p["text"])),
        "key_point_em_dash": _some(points, lambda p: _dashed(p["text"])),
        "key_point_topic": _some(points, lambda p: ~in_vocabulary(p["topic"], [C.HOUSE_TOPIC])),
        "house_point_not_quiet": (house > 0) & (kind != "quiet"),
        "house_point_repeated": house > 1,
        "no_sections": F.coalesce(F.size(sections), F.lit(0)) <= 0,
        "unknown_section": _some(names, lambda n: ~F.coalesce(n.isin(C.SECTION_ORDER), F.lit(False))),
        "section_repeated": _repeats(names),
        "section_order": names != F.filter(order, lambda n: F.array_contains(names, n)),
        "section_budget": _some(sections, lambda s: ~F.coalesce(F.size(s["stories"]).between(low, high), F.lit(False))),
        "too_many_stories": F.size(stories) > C.MAX_STORIES,
        "slug_repeated": _repeats(F.transform(stories, lambda s: s["slug"])),
        "cluster_repeated": _repeats(F.transform(stories, lambda s: s["cluster_id"])),
        "cluster_id_empty": _some(stories, lambda s: _blank(s["cluster_id"])),
        "slug_pattern": _some(stories, lambda s: ~F.coalesce(s["slug"].rlike(C.SLUG_PATTERN), F.lit(False))),
        "story_text_empty": _some(stories, lambda s: _blank(s["title"]) | _blank(s["summary"])),
        "story_em_dash": _some(stories, lambda s: _dashed(s["title"]) | _dashed(s["summary"])),
        "story_score": _some(stories, lambda s: ~F.coalesce(lax_whole(s["score"]).between(1, 10), F.lit(False))),
        "story_sources": _some(stories, lambda s: F.coalesce(F.size(s["sources"]), F.lit(0)) <= 0),
        "source_empty": _some(stories, lambda s: _some(s["sources"], lambda x: _blank(x["name"]) | _blank(x["url"]))),
        "article_empty": _some(stories, lambda s: s["article"].isNotNull() & (
            _blank(s["article"]["background"]) | _blank(s["article"]["what_happened"]) | _blank(s["article"]["why_it_matters"]))),
        "article_em_dash": _some(stories, lambda s: _dashed(s["article"]["background"]) | _dashed(s["article"]["what_happened"])
                                 | _dashed(s["article"]["why_it_matters"])),
        "quote_length": _some(stories, lambda s: quote(s).isNotNull() & ~F.coalesce(
            F.length(quote(s)["text"]).between(1, C.QUOTE_MAX_CHARS), F.lit(False))),
        "quote_attribution": _some(stories, lambda s: quote(s).isNotNull() & _blank(quote(s)["attribution"])),
        "quote_em_dash": _some(stories, lambda s: _dashed(quote(s)["text"]) | _dashed(quote(s)["attribution"])),
        "quote_source": _some(stories, lambda s: quote(s).isNotNull() & ~_some(
            s["sources"], lambda x: x["url"] == quote(s)["source_url"])),
        "briefly_empty": _some(briefly, lambda b: _blank(b["cluster_id"]) | _blank(b["title"]) | _blank(b["url"])),
        "briefly_em_dash": _some(briefly, lambda b: _dashed(b["title"])),
        "briefly_topic": _some(briefly, lambda b: ~in_vocabulary(b["topic"], [])),
        "briefly_repeats_story": _some(briefly, lambda b: F.array_contains(titles, casefold(strip(b["title"])))),
        "audio": e["audio"].isNotNull() & (_blank(e["audio"]["url"]) | ~F.coalesce(
            (lax_whole(e["audio"]["duration_seconds"]) > 0) & (lax_whole(e["audio"]["size_bytes"]) > 0), F.lit(False))),
        "stats": ~F.forall(F.array(*[lax_whole(stats[c]) for c in (
            "items_ingested", "clusters_considered", "stories_run", "sources", "sections_held")]), lambda n: n.isNotNull() & (n >= 0)),
    }


def _fallback_rules(e: Column) -> dict[str, Column]:
    stories = F.coalesce(e["stories"], F.array())
    ranks = F.transform(stories, lambda s: lax_whole(s["rank"]))
    scores = F.transform(stories, lambda s: lax_whole(s["score"]))
    n = F.size(stories)
    expected = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return {
        "notice_empty": _blank(e["notice"]),
        "notice_em_dash": _dashed(e["notice"]),
        "too_many_stories": n > C.FALLBACK_STORIES,
        "ranks": ranks != expected,
        "score_order": scores != F.sort_array(scores, asc=False),
        "story_score": _some(stories, lambda s: ~F.coalesce(lax_whole(s["score"]).between(1, 10), F.lit(False))),
        "story_text_empty": _some(stories, lambda s: _blank(s["title"]) | _blank(s["url"]) | _blank(s["source"])),
        "story_em_dash": _some(stories, lambda s: _dashed(s["title"])),
    }


def check_editions(texts: DataFrame, text: str = "edition_json") -> DataFrame:
    """Adds ``problems`` of each edition, empty when valid: departures from its shape at
    any depth, or else the rules it breaks."""
    checked = texts.withColumn("_raw", lone_object(F.col(text))).withColumn("_e", F.from_json("_raw", _AS_WRITTEN))
    raw, e = F.col("_raw"), F.col("_e")
    base = {
        "date": ~e["date"].rlike(C.DATE_PATTERN),
        "edition_number": ~(lax_whole(e["edition_number"]) >= 1),
    }

    def shaped(shape, rules: dict[str, Column]) -> Column:
        found = shape_problems("_raw", shape)
        return F.when(F.size(found) > 0, found).otherwise(_rules(base | rules))

    problems = (
        F.when(raw.isNull(), F.array(F.lit("not_an_object")))
        .when(~F.coalesce(e["edition_type"].isin("normal", "quiet", "fallback"), F.lit(False)), F.array(F.lit("edition_type")))
        .when(e["edition_type"] == "fallback", shaped(FALLBACK_SHAPE, _fallback_rules(e)))
        .otherwise(shaped(FULL_SHAPE, _full_rules(e)))
    )
    return checked.withColumn("problems", problems).drop("_e", "_raw")


def edition_problems(texts: DataFrame, key: str, text: str = "edition_json") -> DataFrame:
    """One row per broken rule."""
    return check_editions(texts, text).select(key, F.explode("problems").alias("problem"))


CURATION_SCHEMA = """
headline_of_the_day string, headline_cluster_id string, headline_rationale string,
key_points array<struct<text: string, topic: string>>,
sections array<struct<name: string, stories: array<struct<cluster_id: string, title: string, summary: string>>>>,
briefly array<string>
"""


def check_curation(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Adds ``problems`` to curation replies. Section names and the lower budget
    are left to assembly; the headline must name a placed story."""
    parsed = replies.withColumn("_raw", lone_object(F.col(text))).withColumn("_r", F.from_json("_raw", CURATION_SCHEMA))
    raw, r = F.col("_raw"), F.col("_r")
    stories = F.flatten(F.transform(r["sections"], lambda s: s["stories"]))
    rules = {
        "headline_empty": _blank(r["headline_of_the_day"]) | _blank(r["headline_cluster_id"]),
        "em_dash": _dashed(r["headline_of_the_day"]) | _dashed(r["headline_rationale"])
        | _some(r["key_points"], lambda p: _dashed(p["text"])) | _some(stories, lambda s: _dashed(s["title"]) | _dashed(s["summary"])),
        "rationale_length": ~F.length(r["headline_rationale"]).between(1, C.RATIONALE_MAX_CHARS),
        "key_point_count": ~F.size(r["key_points"]).between(3, 6),
        "key_point": _some(r["key_points"], lambda p: _blank(p["text"]) | ~F.coalesce(
            p["topic"].isin(C.TOPICS + [C.HOUSE_TOPIC]), F.lit(False))),
        "no_sections": F.coalesce(F.size(r["sections"]), F.lit(0)) <= 0,
        "section_budget": _some(r["sections"], lambda s: F.size(s["stories"]) > C.MAX_STORIES_PER_SECTION),
        "story_empty": _some(stories, lambda s: _blank(s["cluster_id"]) | _blank(s["title"]) | _blank(s["summary"])),
        "too_many_stories": F.size(stories) > C.MAX_STORIES,
        "headline_not_placed": ~_some(stories, lambda s: s["cluster_id"] == r["headline_cluster_id"]),
    }
    found = shape_problems("_raw", CURATION_SHAPE)
    problems = F.when(raw.isNull(), F.array(F.lit("not_an_object"))).when(F.size(found) > 0, found).otherwise(_rules(rules))
    return parsed.withColumn("problems", problems).drop("_r", "_raw")


def check_run_log(rows: DataFrame, reasons: str = "reasons") -> DataFrame:
    """Run-log rows with ``problems`` and the reasons sorted and distinct.

    `reasons` is an array of codes; an empty one is stored as NULL.
    """
    codes = F.col(reasons)
    allowed = F.array(*[F.lit(r) for r in C.REASONS])
    problems = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("job").isin(C.JOBS), F.lit(False)), F.lit("job")),
        F.when(~F.coalesce(F.col("status").isin(C.STATUSES), F.lit(False)), F.lit("status")),
        F.when(F.size(F.array_except(codes, allowed)) > 0, F.lit("reason")),
    ))
    stored = F.when(F.size(codes) > 0, F.to_json(F.array_sort(F.array_distinct(codes))))
    return rows.withColumn("problems", problems).withColumn("reasons_json", stored)


def lint_quote(quote: Column, source_urls: Column) -> Column:
    """The quote struct, or NULL where it is too long, unattributed or not
    linked to one of the story's sources."""
    keep = (
        (F.length(quote["text"]) <= C.QUOTE_MAX_CHARS)
        & (strip(quote["attribution"]) != "")
        & F.array_contains(source_urls, quote["source_url"])
    )
    return F.when(keep, quote)


def check_dialogues(turns: DataFrame, key: str = "script_id") -> DataFrame:
    """Per script: turns, words, problems, and whether it is in the word band.

    `turns` has the key, speaker and text. Aggregated before the shuffle.
    """
    words = F.size(F.filter(F.split(F.col("text"), SPACES), lambda w: w != ""))
    per = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(words).alias("words"),
        F.collect_set("speaker").alias("_speakers"),
        F.count_if(_blank(F.col("text"))).alias("_empty"),
        F.count_if(_dashed(F.col("text"))).alias("_dashed"),
        F.count_if(~F.coalesce(F.col("speaker").isin(C.SPEAKERS), F.lit(False))).alias("_strangers"),
    )
    low, high = C.DIALOGUE_WORDS
    problems = F.array_compact(F.array(
        F.when(F.col("turns") < C.MIN_TURNS, F.lit("too_few_turns")),
        F.when((F.col("_strangers") > 0) | (F.size("_speakers") != len(C.SPEAKERS)), F.lit("speakers")),
        F.when(F.col("_empty") > 0, F.lit("empty_turn")),
        F.when(F.col("_dashed") > 0, F.lit("em_dash")),
    ))
    return per.select(key, "turns", "words", problems.alias("problems"), F.col("words").between(low, high).alias("in_band"))
