"""The training-data operators against brute force, round trips and held-out labels,
and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import io
import itertools
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from presswire.llm import chat, decontamination, html, jaccard, lattice, packing, quality, sharding, toxicity, warc
from presswire.llm.words import Shingler

DOCS = "doc_id long, text string, score double, node string, n long"
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
ODD = [(1, "a b c d e f g", 1.0, "x", 1), (2, "A b, c d e f g!", 1.0, "x", 1), (2, "A b, c d e f g!", 1.0, "x", 1), (3, "", None, None, None),
       (4, None, None, None, None), (None, "no id here at all but some words", 1.0, "y", 2), (None, "no id here at all but some words", 1.0, "y", 2), (5, LONG, 0.0, "z", 3), (6, "one two", 0.0, "z", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    k = min(5, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_links(texts):
    sets = {d: shingle_set(t) for d, t in texts}
    near = {d: set() for d in sets}
    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        whole = len(sets[a] | sets[b])
        if (n / whole if whole else 1.0) >= 0.8:
            near[a].add(b)
            near[b].add(a)
    return near


def test_jaccard_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = brute_links([(r.doc_id, r.text) for r in docs.collect()])
    found = {r.doc_id: r for r in jaccard.links(docs).collect()}
    assert {d: len(x) for d, x in near.items()} == {d: r.n_links for d, r in found.items()}
    for d, others in near.items():
        assert all(found[d].class_id == found[o].class_id for o in others)
    assert all(r.kept == (r.class_id == d) for d, r in found.items())


def test_jaccard_large_group_of_near_copies(spark):
    base = [f"v{i}" for i in range(300)]
    texts = [(i, " ".join([*base, f"tail{i}", f"end{i % 7}"])) for i in range(600)]
    rows = jaccard.links(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(rows) == 600 and {r.class_id for r in rows} == {0} and {r.n_links for r in rows} == {599}


def trees_of(text, shingler=Shingler()):
    return np.frombuffer(jaccard.signature(Shingler.shingles(shingler.words(text))), ">u2").reshape(jaccard.TREES, jaccard.LONGEST)


def meet(a, b, length):
    return bool((trees_of(a)[:, :length] == trees_of(b)[:, :length]).all(axis=1).any())


def sixty_words(rng):
    return [f"v{x}" for x in rng.integers(0, 100_000, 60)]


def test_jaccard_goes_to_shorter_prefixes(spark):
    """A group whose links are hardly over the threshold looks for more along shorter prefixes."""
    rng, n, rows = np.random.default_rng(9), jaccard.prefix_length(0.8, 0.999), []
    while len(rows) < 6:
        words = sixty_words(rng)
        whole, front, back = (" ".join(w) for w in (words, words[:49], words[11:]))
        if meet(whole, front, n) and not meet(whole, back, n) and meet(whole, back, n - 1):
            rows += [(len(rows) + i, t) for i, t in enumerate((whole, front, back))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (0, 2), 1: (0, 1), 2: (0, 1), 3: (3, 2), 4: (3, 1), 5: (3, 1)}
    alone = {r.doc_id: r.n_links for r in jaccard.links(spark.createDataFrame(rows[:3], "doc_id long, text string"), group_recall=0.0).collect()}
    assert alone == {0: 1, 1: 1, 2: 0}


def test_jaccard_recall_at_the_threshold(spark):
    """4,000 pairs of similarity 45/56, no other links: at least 99.5 of 100 are found."""
    rng = np.random.default_rng(10)
    rows = []
    for i in range(4000):
        words = sixty_words(rng)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:49]))]
    found = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.where("n_links = 1 and class_id = floor(doc_id / 2) * 2").count() >= 0.995 * 8000
    assert found.where("n_links > 1").count() == 0


@pytest.mark.parametrize("length, rows", [(2, 1), (2, 7), (3, 50), (1, 1000)])
def test_runs_of_the_tries(length, rows):
    rng = np.random.default_rng(rows)
    entries = sorted((int(t), rng.integers(0, 3, 4, dtype=np.uint16).astype(">u2").tobytes()) for t in rng.integers(0, 3, 400))
    nodes = rng.permutation(400).tolist()
    is_open = (rng.random(400) < 0.05).tolist()
    table = pa.table({"tree": [t for t, _ in entries], "key": [k for _, k in entries], "node": nodes, "open": is_open})
    got = [pair for batch in jaccard.runs(length)(iter(table.to_batches(max_chunksize=rows))) for pair in zip(*(batch.column(c).to_pylist() for c in "ab"))]
    wanted = []
    for _, run in itertools.groupby(range(400), lambda i: (entries[i][0], entries[i][1][:2 * length])):
        run = list(run)
        if any(is_open[i] for i in run):
            wanted += [(nodes[i], nodes[run[0]]) for i in run[1:]]
    assert sorted(got) == sorted(wanted)


def test_jaccard_odd_rows(spark, odd, none):
    rows = sorted(jaccard.links(odd).collect(), key=str)
    assert len(rows) == len(ODD)
    by = Counter((r.doc_id, r.class_id, r.n_links, r.kept) for r in rows)
    assert by[(1, 1, 2, True)] == 1 and by[(2, 1, 2, False)] == 2 and by[(None, None, 1, True)] == 2
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 1, None: 1, 5: 1, 6: 1}
    assert jaccard.links(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_prefix_is_shortened_to_the_recall():
    n = jaccard.prefix_length(0.8, 0.999)
    assert 1 - (1 - 0.8**n) ** jaccard.TREES >= 0.999 > 1 - (1 - 0.8 ** (n + 1)) ** jaccard.TREES


def brute_items(docs, items):
    out = {}
    for d, text in docs:
        w = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            v = re.findall(r"\w+", (item or "").lower())
            k = min(5, len(v))
            if not v:
                continue
            want = Counter(tuple(v[j:j + k]) for j in range(len(v) - k + 1))
            line = [tuple(w[j:j + k]) for j in range(len(w) - k + 1)]
            best = None
            for s in range(len(line)):
                if line[s] in want:
                    part = line[s:s + sum(want.values())]
                    n = sum((Counter(part) & want).values())
                    sim = n / (len(part) + sum(want.values()) - n)
                    if sim >= 0.8 - 1e-9 and (best is None or (sim, -s) > best):
                        best = (sim, -s)
            if best:
                out[d, i] = (round(best[0], 9), -best[1])
    return out


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    say = lambda n: [f"t{x}" for x in rng.integers(0, 400, n)]
    items = [(i, " ".join(say(int(rng.integers(12, 50))))) for i in range(12)] + [(20, "two words"), (21, ""), (22, None)]
    items.append((23, items[0][1].upper()))
    docs = []
    for d in range(60):
        words = say(int(rng.integers(0, 150)))
        if d % 3 == 0:
            put = items[d % 12][1].split()
            if d % 2:
                put[0], put[-1] = "changed", "too"
            words[len(words) // 2:len(words) // 2] = put
        docs.append((d, " ".join(words) if d != 7 else None))
    docs.append((100, "here are two words"))
    found = decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    mine = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in found.collect()}
    assert mine == brute_items(docs, items) and len(mine) > 15


def test_decontamination_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f g", "clash")], "item_id long, text string, doc_id string")
    assert Counter(r.doc_id for r in decontamination.find(odd, items).collect()) == {1: 1, 2: 2}
    kept = decontamination.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3
    assert decontamination.find(none, items).count() == 0
    assert decontamination.find(odd, items.limit(0)).count() == 0


def test_toxicity_and_quality_learn_held_out_labels(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(40)]
        bad, junk = int(i % 4 == 0), int(i % 5 == 0)
        if bad:
            words[::10] = ["rotzqo", "vilexy", "rotzun", "vilexo"]
        text = " ".join(w + "%%" for w in words) if junk else " ".join(words)
        rows.append((i, text))
        labels.append((i, 1 - junk, bad))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5001, LONG)], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = [r for r in toxicity.score(docs, marks).collect() if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored) and len(scored) > 100
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in scored)
    graded = quality.score(docs, quality.grade_labels(marks)).collect()
    assert len(graded) == 903 and all(0 <= r.tail_2 <= r.tail_1 <= 1 for r in graded)
    held = [r for r in graded if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.kept == (r.doc_id % 5 != 0) for r in held]) > 0.98


def test_toxicity_and_quality_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for marks in (no_labels, some):
        assert toxicity.score(odd, marks).count() == len(ODD) and toxicity.score(none, marks).count() == 0
        assert all(r.predicted == 0 for r in toxicity.score(odd, marks).collect())
        assert quality.score(odd, quality.grade_labels(marks)).count() == len(ODD)
        assert toxicity.keep_clean(odd, marks).columns == odd.columns


def test_quality_shape_reads_whole_tokens():
    assert quality.token_features("a" * 64 + "9")[1] != quality.token_features("a" * 64 + "-")[1]
    assert quality.token_features("a" * 64 + "9")[1] == quality.token_features("ab9")[1]


def test_ordinal_thresholds_stay_in_order():
    rows = [(np.array([g]), np.array([1.0], np.float32)) for g in (0, 1, 2) for _ in range(30)]
    model = quality.fit_ordinal(rows, np.repeat([0, 1, 2], 30))
    assert (np.diff(model.thresholds) > 0).all() and model.weights[0] < model.weights[1] < model.weights[2]


def test_lattice_decodes_to_nearest_point():
    steps = lattice.shortest_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    x = np.random.default_rng(0).normal(size=(200, 8)) * 2
    near = lattice.decode(x)
    own = ((x - near) ** 2).sum(axis=1)
    assert (own <= ((x[:, None] - near[:, None] - steps) ** 2).sum(axis=2).min(axis=1) + 1e-9).all() and own.max() <= 1 + 1e-9


def test_lattice_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    vectors = [*base, *(base[i % 40] + rng.normal(size=64) * 0.3 for i in range(160)), base[0]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None, 1.0]), (904, [])]
    found = {r.vec_id: r for r in lattice.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sum(found[i].n_links for i in range(201)) >= 0.9 * near.sum() and all(found[i].n_links <= near[i] for i in range(201))
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in range(900, 905))
    assert found[200].component_id == found[0].component_id == 0


def test_sharding_law_slots_and_growth(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(docs, 24, bucket_bytes=2000).collect()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text) and max(r.bucket for r in rows) > 0
    assert all(r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    assert all(r.grown_shard in (r.shard, 24) for r in rows)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {(r.doc_id, r.slot) for r in rows} == {(r.doc_id, r.slot) for r in sharding.shard(docs.repartition(5), 24, bucket_bytes=2000).collect()}
    assert sharding.shard(odd, 3).count() == len(ODD) and sharding.shard(none, 3).count() == 0


def test_best_bounds_against_every_choice():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 9, replace=False))
        counts = rng.integers(1, 20, 9)
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts))
        best = min(cost([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
        assert cost(packing.best_bounds(lengths, counts, 3)) == best


def test_packing_batches(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, buckets=4, token_budget=2000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.n_tokens <= r.bound and r.padding == r.bound - r.n_tokens for r in rows)
    for b in {r.bucket for r in rows}:
        mine = [r for r in rows if r.bucket == b]
        fill = Counter(r.batch for r in mine)
        assert len({(r.batch, r.position) for r in mine}) == len(mine) and all(n == mine[0].capacity for x, n in fill.items() if x != max(fill))
        assert mine[0].capacity == max(1, 2000 // max(1, mine[0].bound))
    assert packing.pack(odd).count() == len(ODD) and packing.pack(none).count() == 0


def test_warc_round_trip(spark, sf):
    pages = spark.createDataFrame([(1, "http://a/x y%20\n", "<p>ü</p>"), (2, None, "<p>ü</p>"), (3, "u", None), (4, "u", ""), (5, "http://b", "z" * 200_000),
                                   (5, "http://b", "z" * 200_000), (None, "n", "q")], "page_id long, url string, html string")
    rows = warc.round_trip(pages).collect()
    assert len(rows) == 7 and all(r.digest_ok for r in rows)
    by = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert by == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "response", None)}
    assert {r.url for r in rows if r.page_id == 1} == {"http://a/x y%20\n"}
    for r in rows:
        if r.page_id == 2:
            assert r.payload_digest == warc.base32_sha1("<p>ü</p>".encode()) and r.payload_bytes == 9
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_closed_by_bytes_and_by_records(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"http://a/{i}", "".join(rng.choice(list("abcdefgh"), 40_000 if i % 10 == 0 else 500))) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), records_per_file=30, bytes_per_file=20_000)
    files = [p.stat().st_size for p in (tmp_path / "a").rglob("*.txt")]
    assert len(files) > 4 and max(files) <= 20_000 + 30
    got = {r.page_id: (r.payload.decode(), r.digest_ok) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {i: (text, True) for i, _, text in rows}
    warc.write_archives(pages, str(tmp_path / "b"), bytes_per_file=10_000)  # a record larger than that has a file of its own
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 120


def test_warc_reader_frames_members():
    records = [warc._record([("WARC-Type", "x")], b"a" * n) for n in (0, 5, 100_000)]
    whole = b"".join(warc.member(r) + b"\0" * i for i, r in enumerate(records))
    assert list(warc.read_members(io.BytesIO(whole), chunk=7)) == records
    with pytest.raises(ValueError):
        list(warc.read_members(io.BytesIO(whole[:-10])))


def test_main_text(spark):
    def page(i, extra=""):
        return (f"<html><head><title>t</title></head><body><div id=x1><p>Site line</p><ul><li><a href=/>Home</a><li><a href=/{i}>Item {i}</a></ul></div>"
                f"<nav>menu</nav><div class='c'><p>Story {i} &amp; <b>bo</b>ld<p>common words{extra}</div><div class=\"reader-comments\"><p>Bad {i}</div><script>var a='</p>'</script></body>")
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)]
    rows += [(50, "http://one.example/", "<body><p>out</p><article><header><h1>T&uuml;</h1></header><p>a\n b<br>c</p><aside>x</aside><form>y</form></article><footer>f</footer>"),
             (51, None, None), (52, "bad://[", "plain text"), (53, "http://h.example/53", "")]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 24
    assert got[3].text.startswith("Story 3 & bold") and "Site line" not in got[3].text and "Bad" not in got[3].text and "menu" not in got[3].text
    assert got[50].text == "Tü a b c" and got[50].n_chars == 8
    assert got[51].text == "" and got[52].text == "plain text" and got[53].n_chars == 0


def test_main_text_counts_boxes_inside_articles(spark):
    """A box on some pages of a host goes, with and without article elements; a shared paragraph stays."""
    def page(i, tag):
        box = "<div class='c7'><p>Spread the word</p><p>now</p></div>" if i % 2 else ""
        shared = "<p>Quoted by many.</p>" if i % 3 == 0 else ""
        return f"<body><{tag}><h1>Head {i}</h1><p>Story {i} tells.</p>{shared}{box}<p>End {i}.</p></{tag}></body>"
    rows = [(i, f"http://{tag}.example/{i}", page(i, tag)) for tag in ("article", "div") for i in range(40)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 80
    for r in got:
        i = r.page_id
        assert r.text == f"Head {i} Story {i} tells. " + ("Quoted by many. " if i % 3 == 0 else "") + f"End {i}."


@pytest.mark.parametrize("page", [
    "<div class='content has-sidebar'><p>All of it</p></div>", "<article class='post no-comments'><p>All of it</p></article>",
    "<article id='comment-on-x'><p>All of it</p></article>", "<div><p>All</p><div class='social-policy'>of</div><p>it</p></div>",
    "<div class='sidebar'><article><p>All of it</p></article></div>", "<article><p class='alert'>All</p><p>of it</p></article>",
    "<article><p>All of it</p><div class='comments'>Bad</div></article>", "<div class='sponsored'><h1>All</h1><p>of it</p><div class='ad'>Bad</div></div>"])
def test_main_text_names_are_only_evidence(spark, page):
    rows = [(i, f"http://names.example/{i}", f"<body>{page.replace('it', f'it{i}')}") for i in range(2)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(i, f"All of it{i}") for i in range(2)}


def test_chat_linking(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "ask", '{"turn": 0, "text": "hé"}', None), (1, 2, "b", "ask", '{"text": "x", "turn": 2.0, "more": 1}', ["a"]), (1, 4, "c", "ask", "no json", ["b", "zz"]),
        (1, 5, "d", "other", "{}", ["e"]), (1, 6, "e", "ask", '{"text": "", "turn": "1"}', ["d"]), (1, 7, "a", "ask", "{}", None), (2, 3, "q", "instruct", '{"text": "t"}', None),
        (None, 1, "n", "ask", "{}", None)], "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, 1, "a", "done"), (1, 3, "b", None), (2, 1, "q", "soon"), (2, 9, "gone", "lost")], "conv_id long, turn long, call_id string, content string")
    rows = {(r.conv_id, r.call_id, r.status): r for r in chat.link(calls, results, chat.SCHEMAS).collect()}
    assert set(rows) == {(1, "a", "linked"), (1, "a", "repeated"), (1, "b", "linked"), (1, "c", "unanswered"), (1, "d", "unanswered"), (1, "e", "unanswered"),
                         (2, "q", "early"), (2, "gone", "orphan")}
    assert [rows[1, x, s].level for x, s in (("a", "linked"), ("b", "linked"), ("c", "unanswered"), ("d", "unanswered"), ("e", "unanswered"))] == [0, 1, 2, None, None]
    assert rows[1, "b", "linked"].problems == ["$.more: unknown"] and rows[1, "c", "unanswered"].problems == ["$: not JSON"]
    assert rows[1, "a", "linked"].message == '{"arguments":{"text":"hé","turn":0},"id":"a","name":"ask","result":"done","status":"linked"}'
    assert chat.link(calls.limit(0), results.limit(0), chat.SCHEMAS).count() == 0


def test_chat_query_keeps_every_turn(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    calls, results = chat.turns_as_calls(turns)
    rows = chat.link(calls, results, chat.SCHEMAS).collect()
    assert len([r for r in rows if r.status != "orphan"]) == turns.where("role <> 'assistant'").count()
    assert all(json.loads(r.message)["status"] == r.status for r in rows)


def test_chat_orders_long_conversations_and_keeps_odd_turns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(80)]
    rows += [(1, 3, "assistant", "again"), (1, 90, "tool", "x"), (1, 91, None, "y"), (1, None, "user", "z"), (None, 2, "user", "n")]
    got = chat.link_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: r.level for r in got if r.status == "linked"} == {i: i // 2 for i in range(0, 80, 2)}
    assert sorted((r.status, r.turn, r.result_turn) for r in got if r.status in ("extra", "other")) == [("extra", None, 3), ("other", 90, None), ("other", 91, None)]
    assert sorted(json.loads(r.message)["text"] for r in got if r.status == "unplaced") == ["n", "z"] and len(got) == 45


def test_chat_levels_of_branches_and_cycles(spark):
    needs = {"a": [], "b": ["a"], "c": ["b"], "d": ["a", "c"], "e": ["d"], "f": ["e", "b"], "x": ["y"], "y": ["x"], "z": ["x", "a"], "s": ["s"], "g": ["gone"], "h": ["z"]}
    calls = spark.createDataFrame([(1, k, v) for k, v in needs.items()], "conv_id long, call_id string, needs array<string>")
    assert {r.call_id: r.level for r in chat.levels(calls).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 5, "g": 0}


@pytest.mark.parametrize("value, schema, wanted", [
    (1, {"type": "decimal"}, ['$: unknown type "decimal"']), (1, {"type": ["integer", "what"]}, ['$: unknown type ["integer","what"]']), (1, {"type": 3}, ["$: unknown type 3"]),
    ("ab", {"pattern": "^a"}, []), ("ba", {"pattern": "^a"}, ["$: not the pattern"]), ("a", {"pattern": "("}, ["$: unknown pattern"]), (3, {"pattern": "^a"}, []),
    (3, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, []), (1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}, ["$: none of anyOf"]),
    (3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, ["$: not one of oneOf"]), (3, {"allOf": [{"minimum": 1}, {"maximum": 2}]}, ["$: over maximum"]),
    ("x", {"not": {"type": "string"}}, ["$: what it must not be"]), (1, {"$ref": "#/x"}, ["$: $ref is not followed"]),
])
def test_schema_words(value, schema, wanted):
    assert chat.violations(value, schema) == wanted
