from __future__ import annotations

import html
import re

import pytest

from docspark.llm import html_extract
from docspark.llm.queries import op5_html_extraction

def alone(html_text):
    """A page's text by its own vote."""
    at, found = html_extract.parse(html_text)
    return "\n".join(text for path, text in found if not at or path == at or path.startswith(at + ">"))


TEXT = "A sentence of the article, long enough to count. " * 4


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>{extra}{body}<footer>&copy; foot</footer></body></html>'


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<article><h1>Head</h1><p>One &amp; two&nbsp;\n three<br>four<p>Last</article>", "Head\nOne & two three four\nLast"),
        ("<article><p>a<b>b</b>c <i>d</p><p>e</i>f</p></article>", "abc d\nef"),
        ("<article><p>x</p><aside>side</aside><div class='ad'>ad</div><form>f<input></form><section id='comments'><p>reader</p></section><p>y</p></article>", "x\ny"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table>tail</article>", "1\n2\na\nb\ntail"),
        ("<article><p>1 < 2 &lt; 3 &#8364;</p><!-- <p>no</p> --><pre> a\n b </pre></article>", "1 < 2 < 3 €\na b"),
        ("<article></article>", ""),
    ],
)
def test_blocks(body, expected):
    assert alone(page(body)) == expected


def test_cut_page():
    assert [b.text for b in html_extract.blocks("<article><p>cut <b").blocks] == ["cut <b"]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("<article><h2 id='advertising'>Advertising</h2><p>x</p></article>", "Advertising\nx"),
        ("<article><h3 id='related-work'>Related work</h3><section id='related-work'><p>x</p></section></article>", "Related work\nx"),
        ("<article><p class='social-history'>x</p></article>", "x"),
        ("<article><pre><code>a <span class='hljs-comment'># b</span></code></pre></article>", "a # b"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <label>this</label></p></article>", "so x=1 and this"),
        ("<article><p>one<svg/> two <math/> three</p><p>four</p></article>", "one two three\nfour"),
        ("<div class='ad'>" + "<b>" * 600 + "buy</div><article><p>x</p></article>", "x"),
        (f"<article><p {'a=b ' * 3000}>x</p></article>", "x"),
        (f"<article><p title='{'b > c ' * 3000}'>x</p></article>", "x"),
        (f"<div class='layout has-sidebar'><div class='sidebar'>side</div><div class='text'><p>{TEXT}</p></div></div>", TEXT.strip()),
        (f"<form id='aspnetForm'><div class='widget'><article><p>{TEXT}</p></article></div></form>", TEXT.strip()),
        (f"<div class='widget'><p>{TEXT}</p></div><div class='notice'>cookies</div>", TEXT.strip()),
        (f"<article><p>x</p></article><section id='comments'><article class='comment'><p>{TEXT}</p></article></section>", "x"),
        (f"<div class='post'><p>{TEXT}</p></div><div class='comment-list'><p>{TEXT * 5}</p></div>", TEXT.strip()),
        (f"<section class='intro'><p>Intro, a tenth.{'x' * 100}</p></section><section class='body'><p>{TEXT * 5}</p></section>", f"Intro, a tenth.{'x' * 100}\n{(TEXT * 5).strip()}"),
        (f"<div id='c'><h1>Head</h1><p>Some lead text, more than nothing.</p><div class='body'><p>{TEXT * 5}</p></div></div>", f"Head\nSome lead text, more than nothing.\n{(TEXT * 5).strip()}"),
        (f"{'<div>' * 3000}<p>{TEXT}</p>{'</div>' * 3000}", TEXT.strip()),
        (f"<main><div class='lead'>The lead.</div><div class='body'><p>{TEXT * 20}</p></div><div class='coda'>The coda.</div></main>", f"The lead.\n{(TEXT * 20).strip()}\nThe coda."),
        (f"<main><h1>Title</h1><section><p>{TEXT * 20}</p></section></main>", f"Title\n{(TEXT * 20).strip()}"),
        (f"<article><header><h1>The headline</h1><p>By someone</p></header><p>{TEXT}</p></article>", f"The headline\nBy someone\n{TEXT.strip()}"),
        (f"<div class='page'><div class='lead'>The lead.</div><div class='body'><p>{TEXT * 20}</p></div><div class='coda'>x</div></div>", f"The lead.\n{(TEXT * 20).strip()}\nx"),
        (f"<header><h1>Site</h1></header><article><p>{TEXT}</p></article>", TEXT.strip()),
        (f"<div class='wrap'><div class='top'><a href=a>one</a> <a href=b>two</a></div><div class='text'><p>{TEXT}</p></div></div>", TEXT.strip()),
        (f"<article><div><a href=x>a link of the article</a></div><p>{TEXT}</p></article>", f"a link of the article\n{TEXT.strip()}"),
        ("<div><a href=x>only</a></div><div><a href=y>links</a></div>", "only\nlinks"),
        ("<article><p>x</p><noscript><p>no</p></noscript><ul class='share-buttons'><li>share</ul><p>y</p></article>", "x\ny"),
    ],
)
def test_nothing_else_is_dropped(body, expected):
    assert alone(page(body)) == expected


def test_open_head_and_quotes_without_end():
    assert alone((f"<head><title>T</title><body><article><p>{TEXT}</article>")) == TEXT.strip()
    assert alone((f"<article><p title=\"x>one</p><p>{TEXT}</article>")) == f"one\n{TEXT.strip()}"


def test_consensus_reads_a_short_page_like_its_host(spark):
    long_page = page(f"<div class='content-12 main'><p>{TEXT}</p></div>", "<div class='teaser'><p>hi</p></div>")
    short_page = page("<div class='main content-7'><p>short</p></div>", f"<div class='teaser'><p>{TEXT}</p></div>")
    rows = [(i, "http://a.b/x", long_page) for i in range(5)] + [(9, "http://A.b/y", short_page), (10, "http://alone/", short_page), (11, None, None), (12, "http://a.b/", ""), (12, "http://a.b/", "")]
    pages = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    found = html_extract.main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == len(rows)
    said = {r["page_id"]: r["text"] for r in found.collect()}
    assert said[0] == TEXT.strip() and said[9] == "short"
    assert said[10].startswith("A sentence")  # alone, its own vote counts
    assert said[11] == said[12] == ""
    joined = html_extract.main_text(pages, broadcast_chars=0, salts=3)
    assert sorted(map(str, joined.collect())) == sorted(map(str, found.collect()))
    assert html_extract.main_text(pages.limit(0)).collect() == []


def test_each_page_of_a_mixed_host_is_read_by_its_own_template(spark):
    """Four pages have their article beside a container that is the article of six others; one page's template is its own."""
    post, words = "<div class='post'><p>{}</p></div>", "word " * 400
    rows = [(i, "http://h/", page(post.format(TEXT))) for i in range(6)]
    rows += [(10 + i, "http://h/", page(post.format("Read next: x") + f"<div class='story'><p>{words}</p></div>")) for i in range(4)]
    rows += [(20, "http://h/", page(post.format("Read next: y") + f"<div class='single'><p>{words}</p></div>"))]
    said = {r["page_id"]: r["text"] for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {said[i] for i in range(6)} == {TEXT.strip()} and {said[i] for i in (10, 11, 12, 13, 20)} == {words.strip()}


def test_query_against_the_pages_articles(spark, sf_dir):
    rows = {r["page_id"]: r for r in op5_html_extraction(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        expected = "\n".join(x for x in parts if x)
        assert (rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"]) == (expected, len(expected))


def test_long_and_odd_pages_take_linear_time():
    for odd in ("<" * 50_000, "<a" * 50_000, '<a b="' * 20_000, "<!--" * 20_000, "&" * 50_000, "<p>" * 50_000, "<script>" * 20_000, '<a b="' * 20_000 + ">", "<div class=ad>" * 20_000 + "x", "<div>" * 40_000 + "x", "<b>" * 20_000 + "</div>" * 20_000):
        html_extract.parse(odd)
