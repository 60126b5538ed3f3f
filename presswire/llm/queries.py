"""The registered queries of the training-data operators, over whole tables."""

from pyspark.sql import functions as F

from . import chat, credentials, decontamination, html, jaccard, lattice, packing, quality, repair, sharding, toxicity, warc, whitening
from .common import table

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_formatting(spark, sf):
    """Turns of all conversations read as tool calls, linked, ordered and checked."""
    return chat.link_turns(table(spark, sf, "conversations"))


@query
def op2_toxicity(spark, sf):
    """Toxicity of all documents, learnt from the labelled ones outside fold 0."""
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op3_lattice(spark, sf):
    """Near-duplicate links among all embeddings."""
    return lattice.links(table(spark, sf, "embeddings"))


@query
def op4_sharding(spark, sf):
    """Two-pass external shuffle of all documents into 24 shards."""
    found = sharding.shard(table(spark, sf, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "bucket")


@query
def op5_html(spark, sf):
    """Main text of all pages."""
    return html.main_text(table(spark, sf, "pages"))


@query
def op6_quality(spark, sf):
    """Expected grade of all documents and whether they are kept."""
    return quality.score(table(spark, sf, "documents"), quality.grade_labels(table(spark, sf, "labels")))


@query
def op7_decontamination(spark, sf):
    """Documents that hold a benchmark item, with the item and the place."""
    return decontamination.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_jaccard_join(spark, sf):
    """Classes of near-duplicate documents, and how many links each document has."""
    return jaccard.links(table(spark, sf, "documents"))


@query
def op9_warc(spark, sf):
    """All pages written as WARC archives and read back."""
    return warc.round_trip(table(spark, sf, "pages"))


@query
def op10_packing(spark, sf):
    """Length buckets and batches of all documents."""
    return packing.pack(table(spark, sf, "documents"))


@query
def op11_whitening(spark, sf):
    """All embeddings on their first four whitened principal components."""
    return whitening.whiten(table(spark, sf, "embeddings"))


@query
def op12_structure_repair(spark, sf):
    """All conversations, damaged by a rule, with the cheapest edits that mend them."""
    return repair.report(repair.damaged(table(spark, sf, "conversations")), "gone")


@query
def op13_secret_scans(spark, sf):
    """Secrets of all documents: fixed shapes, and credential values that are hard to guess."""
    found = credentials.scan(table(spark, sf, "documents"))
    count = [F.size(F.array_compact(F.transform("base", lambda s: F.when(s["kind"] == k, 1)))).cast("long").alias(f"n_{name}") for k, name in enumerate(credentials.KINDS[:3])]
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *count, F.sha2(credentials.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        credentials.joined(every).alias("spans"), F.size("added").cast("long").alias("n_guess"), "values")
