"""URLs, text, dates, dedup, feeds and enrichment on small cases."""

import hashlib
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from presswire.functions import dates, readability, text, urls
from presswire.operators import edition, enrich, items, ordering
from presswire.sources import feeds


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


URLS = [
    ("https://ex.com/a?utm_source=x&id=1", "https://ex.com/a?id=1"),
    ("https://ex.com/a?FBCLID=1&gclid=2&msclkid=3&igshid=4&mc_cid=5&mc_eid=6", "https://ex.com/a"),
    ("HTTPS://EX.Com/A/B", "https://ex.com/A/B"),
    ("https://ex.com/a#frag", "https://ex.com/a"),
    ("https://ex.com/a/", "https://ex.com/a"),
    ("https://ex.com/", "https://ex.com"),
    ("https://ex.com/a//", "https://ex.com/a/"),
    ("https://ex.com:8080/a", "https://ex.com:8080/a"),
    ("https://ex.com:0/a", "https://ex.com/a"),
    ("https://me:pw@ex.com/a", "https://me:pw@ex.com/a"),
    ("  https://ex.com/a  ", "https://ex.com/a"),
    ("https://ex.com/a?b=2&a=1&a=&c", "https://ex.com/a?b=2&a=1&a=&c="),
    ("https://ex.com/a?q=a+b%20c~*&z=%zz", "https://ex.com/a?q=a+b+c~%2A&z=%25zz"),
    ("https://ex.com:port/a", None),
    ("https://ex.com:70000/a", None),
]


def test_clean_url_and_that_it_is_stable(spark):
    got = values(spark, [u for u, _ in URLS], urls.clean_url)
    assert got == [w for _, w in URLS]
    kept = [g for g in got if g and not g.endswith("/")]  # one slash goes at a time
    assert values(spark, kept, urls.clean_url) == kept


def test_item_id_hashes_url_and_second(spark):
    df = spark.createDataFrame([("https://ex.com/a", datetime(2026, 7, 19, 9, 0, 0, 999))], "u string, t timestamp")
    want = hashlib.sha256(b"https://ex.com/a2026-07-19T09:00:00Z").hexdigest()[:32]
    assert df.select(urls.make_item_id(F.col("u"), F.col("t"))).first()[0] == want


def test_excerpt_collapses_every_white_space(spark):
    assert values(spark, ["  a  b\x1c\nc ", None, "x" * 1300], text.excerpt) == ["a b c", "", "x" * 1200]


def test_slugs(spark):
    titles = ["Hello, World!", "Straße №5", "", "word " * 20, "x" * 80]
    assert values(spark, titles, text.slugify) == ["hello-world", "strasse-5", "story", "-".join(["word"] * 12), "x" * 60]


def test_unique_slugs_over_ranges(spark):
    df = spark.createDataFrame([("e", i, "Same") for i in range(7)] + [("e", 9, "Other")], "e string, pos int, title string")
    got = {r.pos: r.slug for r in edition.unique_slugs(df, "e", "pos", width=2).collect()}
    assert got == {0: "same", **{i: f"same-{i + 1}" for i in range(1, 7)}, 9: "other"}


def test_ranged_lag_matches_a_window(spark):
    rows = [("k", i * i % 101, f"r{i}") for i in range(101)] + [("j", 5, "x")]
    df = spark.createDataFrame(rows, "k string, v int, id string")
    got = ordering.previous_value(df, ["k"], F.col("v"), [F.col("v"), F.col("id")], "v", "prev", 10)
    mine = sorted((r.k, r.v, r.id, r.prev) for r in got.collect() if r.prev is not None)
    ordered = sorted(r for r in rows if r[0] == "k")
    assert mine == sorted((b[0], b[1], b[2], a[1]) for a, b in zip(ordered, ordered[1:]))


def test_deep_cut_per_key(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id")
    kept = ordering.first_rows(df, ["k"], [F.col("id")], 1500, spread="id")
    assert kept.groupBy("k").agg(F.count("id").alias("n"), F.max("id").alias("m")).orderBy("k").collect() == [(0, 1500, 2998), (1, 1500, 2999)]


def test_dates(spark):
    raw = ["Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0100", "Tue, 02 Jan 2024 03:04:05 EST", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "soon", None]
    want = ["2024-01-02 03:04:05", "2024-01-02 02:04:05", "2024-01-02 08:04:05", "2024-01-02 03:04:05", "2024-01-02 01:04:05", None, None]
    assert values(spark, raw, lambda c: dates.parse_feed_date(c).cast("string")) == want
    assert values(spark, ["1704164645", "x", None, "1e9"], lambda c: dates.parse_epoch(c).cast("string")) == ["2024-01-02 03:04:05", None, None, None]
    assert values(spark, ["2024-02-30", "2024-02-29", "24-1-1"], lambda c: dates.parse_day(c).cast("string")) == [None, "2024-02-29 00:00:00", None]


def test_clock_rules_across_the_march_change(spark):
    ended = ["2026-03-07 11:00:00", "2026-03-07 11:00:01", "2026-03-08 10:00:00", "2026-03-08 10:00:01"]
    assert values(spark, ended, lambda c: dates.is_late(c.cast("timestamp"))) == [False, True, False, True]
    assert values(spark, ["2026-03-07 10:29:59", "2026-03-07 10:30:00", "2026-03-08 09:30:00"], lambda c: dates.window_is_open(c.cast("timestamp"))) == [False, True, True]


WORDS = {"cat": 1, "make": 1, "table": 2, "agree": 2, "the": 1, "be": 1, "running": 2, "regulation": 4, "area": 2, "rhythm": 1, "co-op": 1, "Movie": 1, "don’t": 1}


def test_syllables(spark):
    got = values(spark, list(WORDS), lambda c: readability.reading_counts(c)["syllables"])
    assert dict(zip(WORDS, got)) == WORDS


def test_reading_counts_and_empty_text(spark):
    got = values(spark, ["One two. Three! Four 2026. 5.", "", None, "..."], lambda c: F.to_json(readability.reading_counts(c)))
    assert [tuple(json.loads(g).values()) for g in got] == [(3, 4, 4), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert values(spark, ["", "2026."], readability.grade) == [0.0, 0.0]


def test_html(spark):
    page = '<script>var t="<p>no</p>";</script><style>p{}</style><nav>x</nav><p class="a">One &amp; <b>two</b></p><P>\n</P><p>Three&nbsp;</p>'
    assert values(spark, [page, ""], text.main_text) == ["One & two Three", ""]
    assert values(spark, ["<i>a</i>&lt;b&amp;lt;", None], text.strip_html) == [" a <b&lt;", ""]


def test_emails(spark):
    raw = [" A@B.co ", "a@b", "a b@c.de", "a@@b.cd", "a@.bc.d", "a@b..cd", "x" * 65 + "@b.cd", None]
    assert values(spark, raw, text.normalize_email) == ["a@b.co"] + [None] * 7


def test_dedup_earliest_wins_and_days_stay_apart(spark):
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    rows = [("i1", "u", d1, datetime(2024, 1, 1, 2)), ("i2", "u", d1, datetime(2024, 1, 1, 1)), ("i3", "u", d2, datetime(2024, 1, 2)),
            ("i4", "w", d1, datetime(2024, 1, 1)), ("i4", "w", d2, datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "item_id string, canonical_url string, ingest_date date, published_at timestamp")
    assert {(r.item_id, r.ingest_date) for r in items.dedup(df).collect()} == {("i2", d1), ("i3", d2), ("i4", d1)}


def test_enrich_keeps_what_is_longer(spark):
    rows = [("a", "http://x/a", "short"), ("b", "http://x/b", "y" * 600), ("c", "ftp://x/c", ""), ("d", "http://x/a", "z" * 30)]
    df = spark.createDataFrame(rows, "id string, canonical_url string, body_excerpt string")
    pages = spark.createDataFrame([(1, "http://x/a/", "<p>longer than short</p>", "text/html; charset=x"), (2, "http://x/b", "<p>" + "n" * 900 + "</p>", "text/html"),
                                   (3, "http://x/c", "<p>no</p>", "application/pdf")], "page_id int, url string, html string, content_type string")
    out = enrich.enrich_items(df, pages)
    assert {r.id: (r.body_excerpt[:6], r.fetched, r.enriched) for r in out.collect()} == {
        "a": ("longer", True, True), "b": ("yyyyyy", False, False), "c": ("", False, False), "d": ("zzzzzz", True, False)}
    assert enrich.enrich_metrics(out).first().asDict() == {"considered": 4, "fetched": 2, "enriched": 1, "chars_added": 12}


def test_collect_isolates_a_bad_source(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text(json.dumps({"results": [
        {"title": "T", "html_url": "http://a/1", "publication_date": "2024-01-02", "abstract": "A", "agencies": []},
        {"title": None, "html_url": "http://a/2", "publication_date": "2024-01-02"}]}))
    registry = [
        {"name": "good", "format": "documents_json", "topic_hint": "World", "max_items_per_run": 5, "path": str(tmp_path / "good")},
        {"name": "bad", "format": "rss", "topic_hint": "World", "max_items_per_run": 5, "path": str(tmp_path / "nowhere")},
    ]
    entries, errors = feeds.collect(spark, registry)
    assert [(r.source, r.title, r.author) for r in entries.collect()] == [("good", "T", None)]
    assert [(r.source, r.error) for r in errors.collect()] == [("bad", "PATH_NOT_FOUND")]
    (tmp_path / "good" / "b c+%.json").write_text("{broken")
    (tmp_path / "good" / "c.gz").write_bytes(b"no gzip at all")
    (tmp_path / "good" / "empty.json").write_text("")
    entries, errors = feeds.collect(spark, registry[:1])
    assert entries.count() == 1
    assert sorted((r.error, r.payload_no.rsplit("/", 1)[1][:1]) for r in errors.collect()) == [("BROKEN_PAYLOAD", "b"), ("UNREADABLE_FILE", "c")]
    with pytest.raises(ValueError):
        feeds.check_registry(registry + registry[:1])


def test_feeds_drop_bad_entries(spark):
    rss = ('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>A</title><link>http://a/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>'
           "<description>&lt;p&gt;x&lt;/p&gt;</description><dc:creator>me</dc:creator></item><item><title>B</title><link>http://a/2</link></item>"
           "<item><link>http://a/3</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>")
    rows = spark.createDataFrame([("r", "World", 0, rss), ("r", "World", 1, "not xml")], feeds.PAYLOAD_SCHEMA)
    assert [(r.title, r.author, r.body.strip()) for r in feeds.rss(rows).collect()] == [("A", "me", "x")]
    item = {"id": 7, "type": "story", "title": "T", "time": 1704164645, "by": "x"}
    payloads = [item, item | {"dead": True}, item | {"type": "comment"}, item | {"title": ""}, item | {"time": None}]
    rows = spark.createDataFrame([("h", "Tech", i, json.dumps(p)) for i, p in enumerate(payloads)], feeds.PAYLOAD_SCHEMA)
    assert [r.url for r in feeds.item_api(rows).collect()] == ["https://news.ycombinator.com/item?id=7"]


def test_cap_counts_accepted_rows_in_feed_order(spark):
    rows = [("s", i, datetime(2024, 1, 1 if i < 2 else 5)) for i in range(6)]
    df = spark.createDataFrame(rows, "source string, position int, published_at timestamp")
    kept = items.since_and_cap(df, F.lit("2024-01-05").cast("timestamp"), {"s": 3})
    assert sorted(r.position for r in kept.collect()) == [2, 3, 4]


def test_control_characters_of_a_url_stay_in_it(spark):
    rows = spark.createDataFrame([("https://A.com/x\x01y/\n",), ("https://a.com/x\ny",)], "u string").select(urls.clean_url(F.col("u")).alias("c"))
    assert [r.c for r in rows.collect()] == ["https://a.com/x\x01y", "https://a.com/xy"]


def test_private_use_characters_of_a_page_stay_in_it(spark):
    pages = [("<p>ab &#xE000; c</p><p> </p><p>x &amp; y</p>", "ab  c x & y"), (None, ""), ("", "")]
    got = spark.createDataFrame(pages, "html string, want string").select(text.main_text(F.col("html")).alias("t"), "want").collect()
    assert all(r.t == r.want for r in got)


def test_excerpts_and_not_pages_are_shuffled(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x", "<p>one</p>"), (2, "https://a.com/x/", "<p>two</p>")], "page_id long, url string, html string")
    texts = enrich.page_texts(pages)
    assert [tuple(r) for r in texts.collect()] == [("https://a.com/x", "one")]
    plan = texts._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange"):]
    assert "ArrowEvalPython" in below  # parsed below the exchange


@pytest.mark.parametrize("raw, want", [
    ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"), ("2 Jan 2024 03:04 -0500", "2024-01-02 08:04:00"), ("Tuesday, 02-Jan-24 03:04:05 GMT", "2024-01-02 03:04:05"),
    ("Sunday, 06-Nov-94 08:49:37 GMT", "1994-11-06 08:49:37"), ("Sun Nov  6 08:49:37 1994", "1994-11-06 08:49:37"), ("02 Jan 24 03:04:05 EST", "2024-01-02 08:04:05"), ("January 2, 2024", "2024-01-02 00:00:00"),
    ("Jan 2, 2024", "2024-01-02 00:00:00"), ("2024/01/02 03:04:05", "2024-01-02 03:04:05"), ("2024-01-02T03:04:05+01:00", "2024-01-02 02:04:05"), ("2 Jan 2024", "2024-01-02 00:00:00"), ("Tue, 32 Jan 2024 03:04:05 GMT", None), ("soon", None), ("", None)])
def test_feed_dates(spark, raw, want):
    from presswire.functions import dates

    got = spark.createDataFrame([(raw,)], "t string").select(dates.parse_feed_date(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_stream_rejects_and_restarts(spark, tmp_path):
    from presswire.sources import tables
    from presswire.streaming import ingest

    landing = tmp_path / "landing"
    landing.mkdir()

    def land(name, *rows):
        lines = [json.dumps({"source": s, "source_type": "rss", "topic_hint": "World", "url": f"http://a.example.com/{n}", "title": "t", "body": "b",
                             "published_at": f"2024-01-01T{hour:02}:00:00Z", "fetched_at": "2024-01-01T12:00:00Z", "run_id": "r"}) for n, s, hour in rows]
        (landing / name).write_text("\n".join(lines))

    def run():
        ingest.start_ingest(ingest.read_landing(spark, str(landing)), str(tmp_path / "items"), str(tmp_path / "state"), caps={"a": 2}, rejected=str(tmp_path / "rejected")).awaitTermination()
        stored = sorted(r.url[-1] for r in tables.read_table(spark, str(tmp_path / "items"), items.ITEM_SCHEMA).collect())
        lost = sorted((r.url[-1], r.reason) for r in tables.read_table(spark, str(tmp_path / "rejected"), ingest.REJECTED_SCHEMA).collect())
        return stored, lost

    land("1.json", (1, "a", 7), (2, "a", 8), (3, "a", 9), (4, "a", 5), (5, "b", 9))
    first = (["1", "2"], [("3", "over_cap"), ("4", "too_old"), ("5", "unknown_source")])
    assert run() == first and run() == first
    land("2.json", (1, "a", 7), (6, "a", 6))  # a file that comes late: one known item, one new
    assert run() == (["1", "2", "6"], first[1])
