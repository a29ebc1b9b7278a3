import html
import random
import re

import pytest

from chromafold.llm.html_text import extract, labelled_pages, main_text, region, train
from chromafold.llm.queries import op3_html

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scorer():
    return train(labelled_pages())


def by_hand(page):
    """Valid for the table's one template only."""
    article = re.search(r"(?s)<article>(.*)</article>", page)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:h1|p|br)>", " ", re.sub("</?b>", "", article))).split())


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op3_html(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == by_hand(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_labelled_pages_come_back(scorer):
    wrong = [(got, " ".join(t.split())) for p, t in labelled_pages() if (got := extract(p, scorer)) != " ".join(t.split())]
    assert len(wrong) <= 2, wrong


def test_unseen_layouts(scorer):
    page = """<!doctype html><html><head><title>No</title><script>if (a<b) x("</p>")</script></head><body class="home">
    <div class="site-header"><a href="/">Logo</a></div><ul class="navbar"><li><a>One</a><li><a>Two</a></ul>
    <div class="cookieBanner" data-x="a>b">We use cookies.</div>
    <div class="story-content"><h1>Caf&eacute; &amp; more</h1><p>First para<b>gra</b>ph<br>goes on.<p>Second &lt;one&gt; here &#8212; ok.
    <div class="advertisement">Buy it</div><form><input><p>Mail us</p></form><p>Third, a long one at the end of the page.</div>
    <div id="comments"><p>Nice post, dear author, I liked it a lot.</p></div><div class="footer">legal</div></body></html>"""
    assert extract(page, scorer) == "Café & more First paragraph goes on. Second <one> here — ok. Third, a long one at the end of the page."


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<", ""), ("<p", ""), ("<!-- x", ""), ("<script>x", ""), ("<div></div>", ""), ("<article><p>a &lt; b", "a < b"),
                                       ("<article>one</article><footer>&copy; two &quo", "one"), ("<article><p>1 < 2</p></article>", "1 < 2")])
def test_edges(scorer, page, want):
    assert extract(page, scorer) == want


def test_long_page_and_deep_nesting(scorer):
    assert len(extract("<article>" + "<p>word word</p>" * 50000 + "</article>", scorer)) == 10 * 50000 - 1
    assert extract("<div>" * 3000 + "<article>x</article>", scorer) == "x"
    extract('<a b="' * 5000, scorer)


def test_null_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<article>hi</article>", 2), (1, "u", "<article>hi</article>", 2)], "page_id long, url string, html string, text int")
    assert sorted(((r.page_id, r.text, r.n_chars) for r in main_text(df).collect()), key=str) == [(1, "hi", 2), (1, "hi", 2), (None, "", 0)]
    assert main_text(df.limit(0)).collect() == []


def test_region_is_the_best_of_all():
    rnd = random.Random(8)
    for _ in range(300):
        scores = [rnd.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rnd.randint(0, 25))]
        s, e = region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)
        assert abs(sum(scores[s:e]) - max(best, 0.0)) < 1e-9


def test_the_scan_leaves_out_words_that_stand_apart(scorer):
    body = "<p>This is the long story of the day, told in a good number of plain words.</p>" * 3
    apart = "<div></div>" * 200
    page = f"<body><div>{body}</div>{apart}<div><p>Stray words</p></div></body>"
    near = f"<body><div>{body}</div><div><p>Stray words</p></div></body>"
    assert extract(near, scorer).endswith("Stray words") and "Stray" not in extract(page, scorer)


def test_quoted_values_of_any_length_and_formulas(scorer):
    long = "x > <p>y</p> " * 5000
    assert extract(f"<article data-a=\"{long}\" class='>'><p>Only this, <math><mi>a</mi><mo>+</mo><mi>b</mi></math> that.</p><noscript>And this.</noscript></article>", scorer) == "Only this, a + b that. And this."
    assert extract("<article><p title=\"never closed>Words here</p></article>", scorer) == "Words here"
