"""Scoring of clusters: prompts, replies, carry-forward and cost."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.strict import lax_number, lax_whole, lone_object
from ..functions.text import strip
from ..session import cut_lineage

COMPLAINT = "\n\nThe last answer broke these rules: "
REPLY_KEYS = ["score", "topic", "rationale", "confidence"]
_REPLY = "score string, topic string, rationale string, confidence string"


def _is_string(text: Column, key: str) -> Column:
    """Whether the JSON value under a top-level key is a string."""
    return F.schema_of_variant(F.from_json(text, f"{key} variant")[key]) == "STRING"


def check_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Parse score replies. Adds score, topic, rationale, confidence and
    ``problems``; the four values are NULL where a reply is rejected."""
    raw = lone_object(F.col(text))
    keys = F.json_object_keys(raw)
    body = F.from_json(raw, _REPLY)
    wanted = F.array(*[F.lit(k) for k in REPLY_KEYS])
    whole, confidence = lax_whole(body["score"]), lax_number(body["confidence"])
    rationale = strip(body["rationale"])

    def rule(bad: Column, name: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), F.lit(name))

    parsed = keys.isNotNull()
    problems = F.when(raw.isNull() | ~F.coalesce(parsed, F.lit(False)), F.array(F.lit("not_an_object"))).otherwise(
        F.array_compact(
            F.array(
                rule(F.size(F.array_except(wanted, keys)) > 0, "missing_key"),
                rule(F.size(F.array_except(keys, wanted)) > 0, "extra_key"),
                rule(~whole.between(1, 10), "score"),
                rule(~body["topic"].isin(C.TOPICS), "topic"),
                rule((rationale == "") | F.contains(rationale, F.lit("\n")) | ~_is_string(raw, "rationale"), "rationale"),
                rule(~confidence.between(0.0, 1.0), "confidence"),
            )
        )
    )
    good = F.size("problems") == 0
    return replies.withColumn("problems", problems).select(
        "*",
        F.when(good, whole).alias("score"),
        F.when(good, body["topic"]).alias("topic"),
        F.when(good, rationale).alias("rationale"),
        F.when(good, confidence).alias("confidence"),
    )


def scoring_prompt(members: Column) -> Column:
    """Prompt text of a cluster from its ordered member structs."""
    names = F.array_sort(F.array_distinct(F.transform(members, lambda m: m["source"])))

    def block(m: Column) -> Column:
        text = F.replace(strip(F.substring(m["body_excerpt"], 1, C.SCORING_EXCERPT_CHARS)), F.lit("\n"), F.lit(" "))
        return F.concat(F.lit("* "), m["title"], F.when(text != "", F.concat(F.lit("\n    "), text)).otherwise(""))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Reports of one event: "), F.size(members).cast("string"), F.lit(", from "), F.array_join(names, ", ")),
        F.array_join(F.transform(members, block), "\n"),
    )


STORED = ["score", "topic", "rationale", "confidence", "model_version", "prompt_version", "scored_at"]


def carry_forward(clusters: DataFrame, stored: DataFrame) -> DataFrame:
    """Clusters with the stored score where nothing changed.

    ``carried`` is true where the cluster id is known, its member count is the
    same and its stored score is not null; the others need scoring.
    """
    old = stored.select("ingest_date", "cluster_id", F.col("member_count").alias("_count"),
                        *[F.col(c).alias(f"_{c}") for c in STORED])
    fresh = clusters.drop(*STORED)
    joined = fresh.join(old, ["ingest_date", "cluster_id"], "left")
    same = F.coalesce((F.col("_count") == F.col("member_count")) & F.col("_score").isNotNull(), F.lit(False))
    return joined.select(*fresh.columns, same.alias("carried"),
                         *[F.when(same, F.col(f"_{c}")).alias(c) for c in STORED])


def score_clusters(to_score: DataFrame, make_scorer: Callable[[], Callable], prompt: str = "prompt",
                   retries: int = 1) -> DataFrame:
    """Send each prompt to a scorer and keep every reply.

    `make_scorer()` runs once per Python worker and returns
    ``scorer(prompt) -> (reply_text, usage)`` with the four token counts. A
    reply that fails its checks is asked for once more with the complaint added;
    a scorer that raises counts as a failed attempt. Rows come back with
    ``attempts`` (array of reply and usage), to be checked by `settle_scores`.
    """
    key = to_score.select("ingest_date", "cluster_id", prompt)
    schema = (
        "ingest_date date, cluster_id string, attempt int, reply string, input_tokens long, "
        "output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long"
    )
    counts = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    reply, usage = scorer(row[2])
                except Exception as error:  # a failed call is a failed attempt
                    reply, usage = f"error: {error}", {}
                rows.append((row[0], row[1], row[3], reply, *[usage.get(c, 0) or 0 for c in counts]))
            yield pd.DataFrame(rows, columns=["ingest_date", "cluster_id", "attempt", "reply", *counts])

    asked, pending, done = [], key.withColumn("attempt", F.lit(1)), None
    for attempt in range(1, retries + 2):
        replies = cut_lineage(check_replies(pending.mapInPandas(ask, schema)))
        asked.append(replies)
        if attempt <= retries:
            complaint = F.concat(
                F.lit(COMPLAINT), F.array_join("problems", ", "), F.lit(". Answer again with one JSON object of the four keys."),
            )
            failed = replies.where(F.size("problems") > 0).select("ingest_date", "cluster_id", complaint.alias("_complaint"))
            pending = key.join(failed, ["ingest_date", "cluster_id"]).select(
                "ingest_date", "cluster_id", F.concat(F.col(prompt), F.col("_complaint")).alias(prompt),
                F.lit(attempt + 1).alias("attempt"),
            )
    done = asked[0]
    for more in asked[1:]:
        done = done.unionByName(more)
    return done


def settle_scores(attempts: DataFrame, cost: Column, model_version: Column | None = None,
                  prompt_version: Column | None = None, scored_at: Column | None = None) -> DataFrame:
    """One row per cluster: the last attempt's values and the cost of all.

    Model, prompt version and time stand beside every cluster that was asked
    about, also where no reply was good and the score is NULL; the time is that
    of the call unless given.
    """
    none = F.lit(None).cast("string")
    stamps = [(none if model_version is None else model_version).alias("model_version"),
              (none if prompt_version is None else prompt_version).alias("prompt_version"),
              (F.current_timestamp() if scored_at is None else scored_at).alias("scored_at")]
    last = F.struct("attempt", "score", "topic", "rationale", "confidence")
    return attempts.groupBy("ingest_date", "cluster_id").agg(
        F.max(last).alias("_last"), F.sum(cost).alias("cost_usd"), F.count(F.lit(1)).alias("attempts")
    ).select("ingest_date", "cluster_id", "attempts", "cost_usd",
             *[F.col("_last")[c].alias(c) for c in ("score", "topic", "rationale", "confidence")], *stamps)
