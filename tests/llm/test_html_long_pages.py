"""Operator 8 on very long, broken and odd pages."""

import re
import time

import pytest

from codeloom.llm import htmlx

LONG = {
    "open tags": ("<a " * 350_000, 1_049_999),
    "open quotes": ("<a '<b \"" * 120_000 + ">", 0),
    "one tag name": ("<a" * 500_000, 1_000_000),
    "a quote at the end": ("<a " * 300_000 + '" >', 900_003),
    "declarations": ("<!x " * 200_000, 799_999),
    "raw elements": ("<svg>" * 200_000 + "x", 1),
    "nested": ("<div class='c'>" * 100_000 + "x", 1),
    "end tags behind a barrier": ("<td><nav>" + "<div>" * 100_000 + "</td>" * 100_000, 0),
    "comment": ("x<!-- " * 200_000, 1),
}


@pytest.mark.parametrize("kind", LONG)
def test_long_pages_take_linear_time(kind):
    source, length = LONG[kind]
    begin = time.time()
    page = htmlx.Page(source)
    assert len(page.text(page.best()[0])) == length
    assert time.time() - begin < 20


def plain_walk(source):
    """Text of the one article of a page without broken tags: what is not in a tag, less that in boilerplate."""
    inside = re.search(r"<article[^>]*>(.*)</article>", source, re.S)[1]
    inside = re.sub(r"<(nav|aside|form)>.*?</\1>", " ", inside, flags=re.S)
    return " ".join(re.sub(r"<[^>]*>", " ", inside).split())


def test_one_host_against_a_plain_walk(spark):
    rows = []
    for i in range(60):
        body = "".join(f"<p>Paragraph {j} of page {i} with some words in it.</p>" for j in range(1 + i % 7))
        extra = "<aside>aside links</aside>" if i % 3 == 0 else "<ul><li>one</li><li>two</li></ul>"
        rows.append((i, "http://h.example/p", f"<html><body><nav><a href=/>menu</a></nav><div class='wrap{i}'><article class=a1>{body}{extra}</article></div><footer>f</footer></body></html>"))
    rows += [rows[0], rows[0]]  # repeated rows
    df = spark.createDataFrame([(*r, "given", "t", 1) for r in rows], "page_id long, url string, html string, path string, text string, part int")
    out = htmlx.extract(df).collect()
    want = {i: plain_walk(h) for i, _, h in rows}
    assert len(out) == 62 and all(r.text == want[r.page_id] for r in out)
    assert htmlx.extract(df.limit(0)).count() == 0


def test_votes_that_tie(spark):
    """Two paths with one vote each: the one with more text wins, and both pages are read by what they have."""
    pages = [(1, "http://t.example/a", "<body><div class=x>" + "word " * 30 + "</div></body>"), (2, "http://t.example/b", "<body><div class=y>" + "text " * 20 + "</div></body>")]
    out = {r.page_id: (r.text, r.path) for r in htmlx.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1] == (" ".join(["word"] * 30), "/body/div.x") and out[2] == (" ".join(["text"] * 20), "/body/div.y")


def test_classes_with_slashes_and_odd_tags():
    page = htmlx.Page('<div class="w-1/2"><p title="a<b>c">one < two <b\n>three</b></p></div><3')
    path = page.best()[0]
    assert page.has(path) and page.text(path) == "one < two three <3" or page.text(path) == "one < two three"
