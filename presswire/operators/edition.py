"""From scored clusters to an edition: contexts, plan, selection, assembly."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import slugify, strip
from ..session import cut_lineage
from .ordering import first_rows, number_rows
from .quality import check_editions


def topic_rank(topic: Column) -> Column:
    """Place of a topic in the fixed order; NULL for an unknown one."""
    return F.create_map(*[F.lit(x) for i, t in enumerate(C.TOPICS) for x in (t, i)])[topic]


def section_rank(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for i, t in enumerate(C.SECTION_ORDER) for x in (t, i)])[name]


def section_name(topic: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in C.SECTION_NAMES.items() for x in kv])[topic]


# --- contexts -------------------------------------------------------------------

def member_summary(members: DataFrame) -> DataFrame:
    """Per cluster: sources, primary link and grounding text length.

    Aggregated per source first, so neither a large cluster nor a loud source
    is gathered; the source list is as long as the registry at most.
    """
    first = F.min(F.struct("published_at", "item_id", F.col("canonical_url").alias("url")))
    per_source = members.groupBy("ingest_date", "cluster_id", "source").agg(
        first.alias("_first"),
        F.sum(F.length(strip(F.col("body_excerpt")))).alias("_chars"),
        F.count(F.lit(1)).alias("_n"),
    )
    entry = F.struct("_first.published_at", "_first.item_id", F.col("source").alias("name"), F.col("_first.url").alias("url"))
    per_cluster = per_source.groupBy("ingest_date", "cluster_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_sources"),
        F.sum("_chars").alias("grounding_chars"),
        F.sum("_n").alias("members_found"),
    )
    return per_cluster.select(
        "ingest_date", "cluster_id",
        F.transform("_sources", lambda s: F.struct(s["name"].alias("name"), s["url"].alias("url"))).alias("sources"),
        F.col("_sources")[0]["url"].alias("primary_url"),
        F.col("_sources")[0]["name"].alias("primary_source"),
        "grounding_chars", "members_found",
    )


def build_contexts(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Usable clusters: scored, and with at least one member among the items.

    `members` is one row per stored member joined to its item.
    """
    scored = clusters.where(F.col("score").isNotNull()).drop("sources")
    return scored.join(member_summary(members), ["ingest_date", "cluster_id"])


def context_losses(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Per day: clusters, those without a score, those without a member."""
    present = members.select("ingest_date", "cluster_id").distinct().withColumn("_present", F.lit(True))
    null_score = F.col("score").isNull()
    return clusters.join(present, ["ingest_date", "cluster_id"], "left").groupBy("ingest_date").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.count_if(null_score).alias("dropped_null"),
        F.count_if(~null_score & F.col("_present").isNull()).alias("missing_members"),
        F.count_if(~null_score & F.col("_present").isNotNull()).alias("usable"),
    )


def ordered_members(members: DataFrame) -> DataFrame:
    """All members of each cluster as an array, in order: a prompt names every one."""
    entry = F.struct("published_at", "item_id", "source", "title", "canonical_url", "body_excerpt")
    return members.groupBy("ingest_date", "cluster_id").agg(F.array_sort(F.collect_list(entry)).alias("members"))


def excerpt_block(members: Column) -> Column:
    """Grounding text of a story for the writer prompt."""
    def block(m: Column) -> Column:
        text = F.replace(strip(F.substring(m["body_excerpt"], 1, C.EXCERPT_CHARS)), F.lit("\n"), F.lit(" "))
        return F.concat(m["source"], F.lit(" | "), m["title"], F.lit("\n<"), m["canonical_url"], F.lit(">\n"), F.when(text != "", text).otherwise("(no text)"))

    return F.array_join(F.transform(F.slice(members, 1, C.EXCERPT_MEMBERS), block), "\n")


def candidate_block(mentions: Column) -> Column:
    """One candidate story for the curation prompt; `mentions` is an array of
    ``(date, summary)`` structs, newest first, or NULL."""
    names = F.array_join(F.array_sort(F.transform("sources", lambda s: s["name"])), ", ")
    text = F.substring(F.replace(strip(F.col("summary_seed")), F.lit("\n"), F.lit(" ")), 1, C.CANDIDATE_EXCERPT_CHARS)

    def line(m: Column) -> Column:
        told = F.substring(F.replace(strip(m["summary"]), F.lit("\n"), F.lit(" ")), 1, C.CANDIDATE_MENTION_CHARS)
        return F.concat(F.lit("- told on "), m["date"].cast("string"), F.lit(": "), told)

    return F.concat(
        F.lit("story "), F.col("cluster_id"), F.lit(": "), F.col("headline"),
        F.lit("\n- rated "), F.col("score").cast("string"), F.lit(" in "), F.coalesce(F.col("topic"), F.lit("no topic")),
        F.lit(", because: "), F.coalesce(F.col("rationale"), F.lit("not said")),
        F.lit("\n- told by "), F.col("member_count").cast("string"), F.lit(" items of "), names,
        F.when(text != "", F.concat(F.lit("\n- begins: "), text)).otherwise(""),
        F.coalesce(F.concat(F.lit("\n"), F.array_join(F.transform(mentions, line), "\n")), F.lit("")),
    )


# --- plan -----------------------------------------------------------------------

def edition_types(contexts: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Edition type per day; `days` adds the days without any usable cluster."""
    counts = contexts.groupBy("ingest_date").agg(F.count(F.lit(1)).alias("usable"))
    if days is not None:
        counts = days.select("ingest_date").distinct().join(counts, "ingest_date", "left").na.fill(0, ["usable"])
    kind = F.when(F.col("usable") >= C.MIN_CLUSTERS_NORMAL, "normal").when(
        F.col("usable") >= C.MIN_CLUSTERS_QUIET, "quiet").otherwise("fallback")
    return counts.withColumn("edition_type", kind)


def section_plan(contexts: DataFrame) -> DataFrame:
    """Per day: sections that can run, sections held for want of a second
    story, and whether the edition shrinks."""
    counts = contexts.where(topic_rank(F.col("topic")).isNotNull()).groupBy("ingest_date", "topic").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(topic_rank(F.col("topic")).alias("rank"), section_name(F.col("topic")).alias("name"))

    def names(wanted: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(wanted, entry))), lambda s: s["name"])

    return counts.groupBy("ingest_date").agg(
        names(F.col("n") >= C.MIN_STORIES_PER_SECTION).alias("available"),
        names(F.col("n") == 1).alias("held"),
    ).withColumn("shrink", F.size("held") >= C.SHRINK_HELD)


def select_stories(contexts: DataFrame) -> DataFrame:
    """Placement of stories by rank: at most four a topic and twenty a day;
    a topic left with one story goes to briefly.

    Rows have ``placement`` (section or briefly), ``section`` and ``position``.
    """
    best = [F.col("score").desc(), F.col("cluster_id")]
    known = contexts.where(topic_rank(F.col("topic")).isNotNull())
    per_topic = first_rows(known, ["ingest_date", "topic"], best, C.MAX_STORIES_PER_SECTION)
    per_day = first_rows(per_topic, ["ingest_date"], best, C.MAX_STORIES)
    topic = Window.partitionBy("ingest_date", "topic")  # at most four rows
    day = Window.partitionBy("ingest_date")  # at most twenty rows
    kept = F.count(F.lit(1)).over(topic) >= C.MIN_STORIES_PER_SECTION
    placed = per_day.withColumn("placement", F.when(kept, "section").otherwise("briefly"))
    order = [F.col("placement").desc(), topic_rank(F.col("topic")), *best]
    return placed.withColumn("section", section_name(F.col("topic"))).withColumn(
        "position", F.row_number().over(day.orderBy(*order)))


def edition_stats(items: DataFrame, clusters: DataFrame, selected: DataFrame, contexts: DataFrame, plan: DataFrame) -> DataFrame:
    """Per day: items, clusters considered, stories run, distinct sources of the
    usable clusters, sections held."""
    day = ["ingest_date"]
    ingested = items.groupBy(day).agg(F.count(F.lit(1)).alias("items_ingested"))
    considered = clusters.groupBy(day).agg(F.count(F.lit(1)).alias("clusters_considered"))
    run = selected.where("placement = 'section'").groupBy(day).agg(F.count(F.lit(1)).alias("stories_run"))
    sources = contexts.select("ingest_date", F.explode("sources.name").alias("name")).distinct().groupBy(day).agg(
        F.count(F.lit(1)).alias("sources"))
    held = plan.select("ingest_date", F.size("held").alias("sections_held"))
    out = ingested
    for part in (considered, run, sources, held):
        out = out.join(part, day, "left")
    return out.na.fill(0)


# --- numbering ------------------------------------------------------------------

def edition_numbers(days: DataFrame, published: DataFrame) -> DataFrame:
    """A date's own number if it was published, else the next free ones in
    date order. `days(date)`, `published(date, edition_number)`."""
    known = published.groupBy("date").agg(F.max("edition_number").alias("_number"))
    highest = published.agg(F.coalesce(F.max("edition_number"), F.lit(0))).scalar()
    joined = days.select("date").distinct().join(known, "date", "left")
    new = F.col("_number").isNull()
    # one row per calendar date, so the window is small
    order = Window.partitionBy(new).orderBy("date")
    return joined.select(
        "date",
        F.coalesce("_number", highest + F.row_number().over(order)).cast("int").alias("edition_number"),
        (~new).alias("reused"),
    )


def unique_slugs(titles: DataFrame, edition: str, position: str, title: str = "title", width: int = 1_000_000) -> DataFrame:
    """Slug per title; from the second equal one of an edition on, numbered in
    order of position."""
    slugged = titles.withColumn("_base", slugify(F.col(title)))
    ranked = number_rows(slugged, [edition, "_base"], F.col(position), [F.col(position)], "_nth", width)
    return ranked.withColumn(
        "slug", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", "_nth"))
    ).drop("_base", "_nth")


# --- assembly -------------------------------------------------------------------

def split_sections(curated: DataFrame) -> DataFrame:
    """Curated stories with ``kept``: false where the section is unknown or too
    short, which sends its stories to briefly."""
    size = F.count(F.lit(1)).over(Window.partitionBy("date", "section_pos"))  # a section has at most four
    known = F.coalesce(F.col("section").isin(C.SECTION_ORDER), F.lit(False))
    return curated.withColumn("kept", known & (size >= C.MIN_STORIES_PER_SECTION))


def resolve_briefly(requested: DataFrame, contexts: DataFrame, used: DataFrame) -> DataFrame:
    """Briefly lines in order: unknown, already placed, repeated and topic-less
    ids are dropped. `requested(date, position, cluster_id)`."""
    first = first_rows(requested, ["date", "cluster_id"], [F.col("position")])
    fresh = first.join(used.select("date", "cluster_id"), ["date", "cluster_id"], "left_anti")
    told = contexts.where(topic_rank(F.col("topic")).isNotNull()).select(
        F.col("ingest_date").alias("date"), "cluster_id", F.col("headline").alias("title"),
        F.col("primary_url").alias("url"), "topic")
    return fresh.join(told, ["date", "cluster_id"]).select("date", "position", "cluster_id", "title", "url", "topic")


def assemble_stories(curated: DataFrame, contexts: DataFrame) -> DataFrame:
    """Section stories with slug, and score and sources taken from the data.

    An edition with a kept story that was not offered is left out whole; its
    date shows up in `unassembled`.
    """
    kept = split_sections(curated).where("kept")
    facts = contexts.select(F.col("ingest_date").alias("date"), "cluster_id", "score", "sources")
    joined = kept.join(facts, ["date", "cluster_id"], "left")
    # a day holds an edition's worth of stories
    order = Window.partitionBy("date").orderBy("section_pos", "story_pos", "cluster_id")
    placed = joined.withColumn("position", F.row_number().over(order))
    bad = placed.where(F.col("score").isNull()).select("date").distinct()
    return unique_slugs(placed.join(bad, "date", "left_anti"), "date", "position")


def unassembled(curated: DataFrame, contexts: DataFrame) -> DataFrame:
    kept = split_sections(curated).where("kept")
    return kept.join(contexts.select(F.col("ingest_date").alias("date"), "cluster_id"), ["date", "cluster_id"], "left_anti").select("date", "cluster_id")


def _place(*parts: Column) -> Column:
    return F.struct(*[p.cast("long").alias(f"part_{i}") for i, p in enumerate(parts)]).alias("position")


def assemble_editions(curated: DataFrame, briefly: DataFrame, heads: DataFrame, contexts: DataFrame,
                      articles: DataFrame, numbers: DataFrame, types: DataFrame, stats: DataFrame) -> DataFrame:
    """``(date, edition_number, edition_type, edition_json)`` of normal and quiet
    editions.

    `curated(date, section, section_pos, story_pos, cluster_id, title, summary)`,
    `briefly(date, position, cluster_id)`, `heads(date, headline_of_the_day,
    headline_cluster_id, headline_rationale, key_points)`,
    `articles(date, cluster_id, position, article)`, of which the last of a story
    counts. Lists inside an edition are bounded by its story budget. A day without
    a kept section has none, see `daily_editions`.
    """
    written = articles.groupBy("date", "cluster_id").agg(F.max_by("article", "position").alias("article"))
    stories = assemble_stories(curated, contexts).join(written, ["date", "cluster_id"], "left")
    stories = cut_lineage(stories)  # a budget's worth a day, read four times below
    body = F.struct("cluster_id", "slug", "title", "summary", "score", "sources", "article")
    sections = stories.groupBy("date", "section").agg(
        F.array_sort(F.collect_list(F.struct("position", body.alias("story")))).alias("_stories"))
    sections = sections.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(
        section_rank(F.col("section")).alias("rank"),
        F.struct(F.col("section").alias("name"), F.transform("_stories", lambda s: s["story"]).alias("stories")).alias("section"),
    ))).alias("_sections")).select("date", F.transform("_sections", lambda s: s["section"]).alias("sections"))

    spilled = split_sections(curated).where("not kept").select(
        "date", _place(F.lit(0), F.col("section_pos"), F.col("story_pos")), "cluster_id")
    asked = briefly.select("date", _place(F.lit(1), F.col("position"), F.lit(0)), "cluster_id")
    lines = resolve_briefly(spilled.unionByName(asked), contexts, stories)
    lines = lines.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("position", F.struct("cluster_id", "title", "url", "topic").alias("line")))).alias("_b"))
    lines = lines.select("date", F.transform("_b", lambda b: b["line"]).alias("briefly"))

    cards = stories.select("date", F.col("cluster_id").alias("headline_cluster_id")).distinct().withColumn("_card", F.lit(True))
    day_stats = stats.withColumnRenamed("ingest_date", "date").drop("stories_run")
    counts = stories.groupBy("date").agg(F.count(F.lit(1)).alias("stories_run"))
    joined = (
        heads.join(sections, "date").join(numbers.select("date", "edition_number"), "date")
        .join(types.select(F.col("ingest_date").alias("date"), "edition_type"), "date")
        .join(lines, "date", "left").join(cards, ["date", "headline_cluster_id"], "left")
        .join(day_stats, "date", "left").join(counts, "date", "left")
    )
    edition = F.struct(
        F.col("date").cast("string").alias("date"), "edition_number", "edition_type", "headline_of_the_day",
        F.when(F.col("_card"), F.col("headline_cluster_id")).alias("headline_cluster_id"),
        "headline_rationale", "key_points", "sections",
        F.coalesce("briefly", F.array().cast("array<struct<cluster_id:string,title:string,url:string,topic:string>>")).alias("briefly"),
        F.struct(*[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in
                   ("items_ingested", "clusters_considered", "stories_run", "sources", "sections_held")]).alias("stats"),
    )
    return joined.select("date", "edition_number", "edition_type", F.to_json(edition).alias("edition_json"))


def fallback_stories(contexts: DataFrame) -> DataFrame:
    """The ten best clusters of each day with their rank."""
    best = [F.col("score").desc(), F.col("cluster_id")]
    return first_rows(contexts, ["ingest_date"], best, C.FALLBACK_STORIES, rank="rank").select(
        "ingest_date", "rank", "cluster_id", F.col("headline").alias("title"), "score",
        F.col("primary_url").alias("url"), F.col("primary_source").alias("source"))


def fallback_editions(contexts: DataFrame, days: DataFrame, numbers: DataFrame, notice: str) -> DataFrame:
    """Edition rows of the given days as ranked link lists; a day with nothing
    usable still gets one."""
    entry = F.struct("rank", "title", "score", "url", "source")
    lists = fallback_stories(contexts).groupBy(F.col("ingest_date").alias("date")).agg(F.array_sort(F.collect_list(entry)).alias("stories"))
    empty = F.array().cast("array<struct<rank:int,title:string,score:int,url:string,source:string>>")
    joined = days.select("date").distinct().join(numbers.select("date", "edition_number"), "date").join(lists, "date", "left")
    edition = F.struct(
        F.col("date").cast("string").alias("date"), "edition_number", F.lit("fallback").alias("edition_type"),
        F.lit(notice).alias("notice"), F.coalesce("stories", empty).alias("stories"))
    return joined.select("date", "edition_number", F.lit("fallback").alias("edition_type"), F.to_json(edition).alias("edition_json"))


def daily_editions(assembled: DataFrame, contexts: DataFrame, days: DataFrame, numbers: DataFrame, notice: str) -> DataFrame:
    """One edition for each of the days: the assembled one where it is valid, a
    fallback where there is none or a rule of its schema is broken."""
    assembled = cut_lineage(check_editions(assembled))  # one row a day, read twice below
    valid = assembled.where(F.size("problems") == 0).drop("problems")
    left = days.select("date").distinct().join(valid.select("date"), "date", "left_anti")
    return valid.unionByName(fallback_editions(contexts, left, numbers, notice))
