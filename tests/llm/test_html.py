import html
import random
import re
import time

import pyarrow.parquet as pq
import pytest

from tracelake.llm import html_text


def test_held_out_pages():
    rnd, right, blocks = random.Random(999), 0, 0
    pages = [html_text.sample_page(rnd) for _ in range(150)]
    for (_, true), got in zip(pages, html_text.main_texts([p for p, _ in pages])):
        right += len(set(true) & set(got.split("\n")))
        blocks += len(set(true) | set(got.split("\n")))
    assert right / blocks > 0.93


def plain(page):
    a = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    a = re.sub(r"</?b>", "", re.sub(r"</?(p|h1)>", "\n", a).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in a.split("\n")) if x)


@pytest.mark.parametrize("wrap", ["main", "div", "section", 'div class="qzx"', 'div class="content"', 'div id="post-body"', None])
def test_articles_in_other_elements(wrap):
    """The real pages with the article's element renamed, given an unknown name, or left out."""
    pages = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()[:120]]
    begin, end = (f"<{wrap}>", f"</{wrap.split()[0]}>") if wrap else ("", "")
    got = html_text.main_texts([p.replace("<article>", begin).replace("</article>", end) for p in pages])
    assert sum(g == plain(p) for g, p in zip(got, pages)) > 110


def test_references():
    of = lambda p: [t for _, t, _ in html_text.leaves(p)]
    assert of("<p>AT&T rocks</p><p>a?x=1&b=2</p>") == ["AT&T rocks", "a?x=1&b=2"]
    assert of("<p>&copy2024 &amp;amp; &lt;b&gt; &#65;&#x42; &nosuch; &</p>") == [html.unescape("&copy2024 &amp;amp; &lt;b&gt; &#65;&#x42; &nosuch; &")]
    assert of("<p>a&nbsp;&nbsp; b\n c</p>x<br>y<script>z &amp;</script>") == ["a b c", "x y"]


def test_large_and_broken_pages():
    """Five MB in small blocks, and tags that are never closed: time in proportion to the length."""
    began = time.time()
    page = "<nav>" + "<li><a href=x>a</a>" * 100 + "</nav><article>" + "<p>Words of a block, some more." * 150_000 + "</article>"
    assert len(html_text.main_texts([page, "<p>a"])[0]) > 4_000_000
    for tag in ("<font>", "<div>", "<p><b>", "<svg>", "<a>", "<b></i>"):
        html_text.main_texts([(tag + "x ") * 100_000])
    assert time.time() - began < 240


def test_clashing_columns_and_ties(spark):
    rows = [(1, "u", "<article><p>One and two.</p></article>", "no", 7)] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = html_text.extract(df).collect()
    assert len(got) == 3 and len({(r.text, r.n_chars) for r in got}) == 1


def test_real_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for r in df.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_awkward_pages(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "no tags at all", "x"), (None, "u", "<p>a", "x"), (3, "u", "<script>x</script><!-- c", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert html_text.extract(df).count() == 5 and html_text.extract(df.limit(0)).count() == 0
    assert html_text.extract(df.where("html = '' or html is null")).where("text = '' and n_chars = 0").count() == 2


def test_every_word_counts():
    head = " ".join(f"w{i}" for i in range(60))
    a, b = (html_text.vectors(html_text.leaves(f"<p>{head} {w}</p>"))[0] for w in ("advert " * 300, "banner " * 300))
    assert (a != b).any()
    words = slice(html_text.PATH_SLOTS, html_text.PATH_SLOTS + html_text.WORD_SLOTS)
    assert abs(a[words].sum() - 1) < 1e-5 and a[words].max() > 300 / 360 - 1e-5
