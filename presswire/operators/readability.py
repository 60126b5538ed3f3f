"""Readability of editions: report, failing pieces, and rewrites."""

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.readability import grade, sentences
from ..session import written


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), " ")


def revisable_text(story: Column) -> Column:
    """What a revision may change: everything but the quotation."""
    a = story["article"]
    return _joined(story["summary"], a["background"], a["what_happened"], a["why_it_matters"])


def story_text(story: Column) -> Column:
    return _joined(revisable_text(story), story["article"]["quote"]["text"])


def edition_text(e: Column) -> Column:
    """All generated text of an edition; briefly titles are not generated."""
    points = F.transform(F.coalesce(e["key_points"], F.array()), lambda p: F.coalesce(p["text"], F.lit("")))
    stories = F.flatten(F.transform(F.coalesce(e["sections"], F.array()), lambda s: F.transform(s["stories"], story_text)))
    notice = F.when(e["edition_type"] == "fallback", e["notice"])
    parts = F.concat(F.array(F.coalesce(e["headline_of_the_day"], F.lit(""))), points, stories, F.array(F.coalesce(notice, F.lit(""))))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def failing_sentences(texts: DataFrame, key: str, text: str = "text", threshold: float = C.SENTENCE_FLAG_GRADE) -> DataFrame:
    """Sentences above the threshold with their place; hardest first, of equals
    the earlier, is ``orderBy(key, desc(grade), position)``."""
    parts = texts.select(key, F.posexplode(sentences(F.col(text))).alias("position", "sentence"))
    return parts.withColumn("grade", grade(F.col("sentence"))).where(F.col("grade") > threshold)


def story_grades(editions: DataFrame, key: str = "date", edition: str = "edition") -> DataFrame:
    """One row per story of each edition struct with its grade."""
    sections = editions.select(key, F.explode(F.col(f"{edition}.sections")).alias("s"))
    stories = sections.select(key, F.explode("s.stories").alias("story"))
    return stories.select(key, F.col("story.slug").alias("slug"), grade(story_text(F.col("story"))).alias("grade"))


def edition_report(editions: DataFrame, key: str = "date", edition: str = "edition") -> DataFrame:
    """Grade of the joined text of each edition, the verdict, and the stories
    over the limit, hardest first. Grades each text once."""
    average = editions.select(key, grade(edition_text(F.col(edition))).alias("average"))
    over = story_grades(editions, key, edition).groupBy(key).agg(
        F.count(F.lit(1)).alias("stories"),
        F.array_sort(F.collect_list(F.when(F.col("grade") > C.MAX_GRADE, F.struct((-F.col("grade")).alias("g"), "slug")))).alias("_over"),
    ).select(key, "stories", F.transform("_over", lambda o: o["slug"]).alias("failing_slugs"))
    joined = average.join(over, key, "left")
    return joined.select(
        key, "average", (F.col("average") <= C.MAX_GRADE).alias("passes"),
        F.coalesce("stories", F.lit(0)).alias("stories"),
        F.coalesce("failing_slugs", F.array().cast("array<string>")).alias("failing_slugs"))


def pieces(editions: DataFrame, key: str = "date", edition: str = "edition") -> DataFrame:
    """The headline, key points and summaries of each edition, one per row,
    under the ids a rewrite addresses."""
    e = F.col(edition)
    piece = "struct<id:string,text:string,kind:string>"

    def entry(piece_id: Column, text: Column, kind: str) -> Column:
        return F.struct(piece_id.alias("id"), text.alias("text"), F.lit(kind).alias("kind")).cast(piece)

    points = F.transform(F.coalesce(e["key_points"], F.array()), lambda p, i: entry(
        F.concat(F.lit("point:"), i.cast("string")), p["text"], "glance point"))
    stories = F.flatten(F.transform(F.coalesce(e["sections"], F.array()), lambda s: s["stories"]))
    summaries = F.transform(stories, lambda s: entry(F.concat(F.lit("summary:"), s["slug"]), s["summary"], "story summary"))
    all_pieces = F.concat(F.array(entry(F.lit("headline"), e["headline_of_the_day"], "headline")), points, summaries)
    exploded = editions.select(key, F.posexplode(all_pieces).alias("position", "p"))
    return exploded.select(key, "position", "p.*").where(F.coalesce("text", F.lit("")) != "")


def failing_pieces(editions: DataFrame, key: str = "date", edition: str = "edition", limit: float = C.MAX_GRADE) -> DataFrame:
    return pieces(editions, key, edition).withColumn("grade", grade(F.col("text"))).where(F.col("grade") > limit)


def accepted_rewrites(failing: DataFrame, rewrites: DataFrame, key: str = "date", position: str = "position") -> DataFrame:
    """Rewrites that land: asked for, graded lower than what they replace, and of several
    such for one id the last by `position`."""
    new = rewrites.select(key, "id", F.col(position).alias("_place"), F.col("text").alias("rewrite"), grade(F.col("text")).alias("new_grade"))
    new = new.where(~F.contains("rewrite", F.lit(C.EM_DASH)))
    better = failing.join(new, [key, "id"]).where(F.col("new_grade") < F.col("grade"))
    last = better.groupBy(key, "id").agg(F.max_by(F.struct("rewrite", "grade", "new_grade"), F.struct("_place", "rewrite")).alias("_r"))
    return last.select(key, "id", "_r.*")


def apply_rewrites(editions: DataFrame, accepted: DataFrame, key: str = "date", edition: str = "edition") -> DataFrame:
    """Editions with the accepted text, one an id, put back and how many landed. An
    edition has a few dozen pieces, so its rewrites are one small map."""
    texts = accepted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("id", "rewrite"))).alias("_new"))
    joined = editions.join(texts, key, "left").withColumn("_new", F.coalesce("_new", F.create_map().cast("map<string,string>")))
    e, new = F.col(edition), F.col("_new")

    def swap(piece_id: Column, old: Column) -> Column:
        return F.coalesce(new[piece_id], old)

    points = F.transform(e["key_points"], lambda p, i: p.withField("text", swap(F.concat(F.lit("point:"), i.cast("string")), p["text"])))
    sections = F.transform(e["sections"], lambda s: s.withField("stories", F.transform(s["stories"], lambda t: t.withField(
        "summary", swap(F.concat(F.lit("summary:"), t["slug"]), t["summary"])))))
    changed = (e.withField("headline_of_the_day", swap(F.lit("headline"), e["headline_of_the_day"]))
               .withField("key_points", points).withField("sections", sections))
    return joined.withColumn("applied", F.size("_new")).withColumn(edition, changed).drop("_new")


def revise(editions: DataFrame, make_rewriter: Callable[[], Callable], key: str = "date", edition: str = "edition", passes: int = 3) -> DataFrame:
    """Editions whose hard pieces are rewritten until the whole reads easily enough:
    ``(key, edition, passes, average, hard)``.

    A pass takes the editions still over the limit alone, sends their failing
    pieces to the rewriter, and keeps what reads easier. After the last pass an
    edition goes out as it is, marked hard. ``make_rewriter()`` runs once per Python
    worker and returns ``rewriter(text) -> text``; one that raises leaves its piece
    as it was.
    """
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = make_rewriter()

        def one(text: str) -> str | None:
            try:
                return rewriter(text)
            except Exception:  # a failed call keeps the text
                return None

        for batch in batches:
            yield pd.DataFrame({key: batch[key], "id": batch["id"], "position": 0, "text": [one(t) for t in batch["text"]]}).dropna(subset=["text"])

    kind = dict(editions.dtypes)[key]
    open_, done = editions.select(key, edition, F.lit(0).alias("passes")), []
    for n in range(passes + 1):
        average = grade(edition_text(F.col(edition)))
        graded = written(open_.withColumn("average", average), "revision")
        over = F.coalesce(F.col("average") > C.MAX_GRADE, F.lit(False))
        done.append(graded.where(~over if n < passes else F.lit(True)).withColumn("hard", over))
        hard = graded.where(over)
        if n == passes or hard.isEmpty():
            break
        failing = written(failing_pieces(hard, key, edition), "revision")
        asked = failing.select(key, "id", "text").mapInPandas(ask, f"{key} {kind}, id string, position int, text string")
        accepted = accepted_rewrites(failing, written(asked, "revision"), key)
        open_ = apply_rewrites(hard.drop("average"), accepted, key, edition).drop("applied").withColumn("passes", F.col("passes") + 1)
    return reduce(DataFrame.unionByName, done).select(key, edition, "passes", "average", "hard")
