"""Boxes whose own texts differ from page to page, scripts, and deep pages."""

import time

import pytest

from presswire.llm import html

PAGES = "page_id long, url string, html string, host string, text string, marks int"
CLASSES = ["comment-list", "comments-area", "reader-comments", "related-posts", "cookie-bar", "newsletter-box", "share-links", "post-comments"]


def article(i):
    return [f"First thing number {i} that was told in the morning paper of town {i * 7}.", f"Another sentence on matter {i * 13}, with more to say than the boxes have.", f"And the end of it came on day {i}, as all had hoped it would at last."]


def page(i, name, marked):
    texts = article(i)
    box = f'<div class="{name}"><h4>Box {i}</h4><div>by reader {i}: so {i * 3}</div></div>'
    inner = "".join(f"<p>{t}</p>" for t in texts[:2]) + box + f"<p>{texts[2]}</p>"
    return f"<html><body><article>{inner}</article></body></html>" if marked else f'<html><body><div class="story">{inner}</div></body></html>'


@pytest.mark.parametrize("marked", [True, False])
def test_boxes_of_their_own_texts(spark, marked):
    rows, wanted, n = [], {}, 0
    for pages in (2, 6, 20):
        for name in CLASSES:
            for _ in range(pages):
                rows.append((n, f"https://{name}{pages}.example.com/{n}", page(n, name, marked), "x", "y", 1))
                wanted[n] = " ".join(article(n))
                n += 1
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == wanted


def test_a_list_of_comments_on_one_page(spark):
    told = "".join(f"<p>{t}</p>" for t in article(5))
    rows = [(1, "https://one.example.com/", f'<article>{told}<section class="comments-area"><h3>2 replies</h3><ol class="comment-list"><li>I agree</li><li>I do not</li></ol></section></article>', "", "", 0),
            (2, "https://two.example.com/", f'<article class="post no-comments" id="comment-on-x">{told}</article>', "", "", 0),
            (3, "https://three.example.com/", f'<div class="content has-sidebar">{told}<p class="alert">Told to all of them too.</p></div>', "", "", 0)]
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found[1] == found[2] == " ".join(article(5)) and found[3] == " ".join([*article(5), "Told to all of them too."])


def test_scripts_do_not_close_themselves():
    assert [b[0] for b in html.parse('<p>Text</p><script src="a.js"/>alert(1)</script><p>More</p><svg/><p>End</p>')[0]] == ["Text", "More", "End"]


@pytest.mark.parametrize("source", ["<div>" * 20_000 + "x", "<div>t " * 20_000, "<ul><li>t " * 10_000, "<p><b class='comments'>t" * 20_000, "<div class='comments'>t " * 20_000])
def test_deep_pages_take_linear_time(source):
    start = time.perf_counter()
    blocks, marks, *_ = html.parse(source)
    assert time.perf_counter() - start < 5 and len(marks) <= 4 * 20_000
    assert len(html.parse("<div>" * 3 + "a")[0]) == 1


def test_counts_of_subtrees_against_brute_force(spark):
    """A box of equal texts goes once it is on ten pages and on 80 % of those with its place."""
    for pages, boxed, goes in ((12, 12, True), (12, 9, False), (9, 9, False), (20, 16, True)):
        rows = []
        for i in range(pages):
            told = "".join(f"<p>{t}</p>" for t in article(i))
            box = "<div><div>Follow the channel of the house.</div></div>" if i < boxed else f"<div><div>Own line {i} of the day.</div></div>"
            rows.append((i, "https://h.example.com/", f"<article>{told}{box}</article>", "", "", 0))
        found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
        for i in range(pages):
            own = " ".join(article(i))
            assert found[i] == (own + ("" if goes else " Follow the channel of the house.") if i < boxed else f"{own} Own line {i} of the day."), (pages, boxed, i)


def test_empty_table_and_long_text(spark):
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0
    long = "word " * 300_000
    rows = [(1, None, f"<p>{long}</p>", "", "", 0), (None, "::", "", None, None, None), (None, "::", None, None, None, None)]
    found = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r.n_chars for r in found) == [0, 0, len(long.strip())]
