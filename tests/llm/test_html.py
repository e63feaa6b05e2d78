"""Main text of pages: tokens, regions, odd markup, and the given pages."""

import html
import itertools
import random
import re

import pytest

from seqlattice.llm import html_text as ht
from seqlattice.llm import queries

SF = "/root/testdata/sf0.001"


def test_region_equals_all_regions():
    rng = random.Random(1)
    for _ in range(300):
        x = [rng.choice([-3, -2, -1, -0.5, 0, 1, 2, 4]) for _ in range(rng.randrange(12))]
        start, end = ht.best_region(x)
        sums = {(i, j): sum(x[i:j]) for i, j in itertools.combinations(range(len(x) + 1), 2)}
        assert sum(x[start:end]) == max([0, *sums.values()])
    assert ht.best_region([]) == ht.best_region([-1.0, 0.0]) == (0, 0)


PAGES = [
    (None, ""), ("", ""), ("   \n ", ""), ("plain text only &amp; more", "plain text only & more"), ("a < b and c > d", "a < b and c > d"),
    ("<article><h1>A  title</h1><p>one\n two&nbsp;three<br>four</p></article>", "A title\none two three four"),
    ("<nav><a href=/x>x y z</a></nav><p>unclosed <b>bold text<p>second one here<div class=ad>buy this now", "unclosed bold text\nsecond one here"),
    ("<article><p>Words &lt;b&gt; of &amp;amp; text &eacute;&#233;&#xe9; and &copy 1</p></article>", "Words <b> of &amp; text ééé and © 1"),
    ("<header><h2>Site</h2></header><main><article><header><h1>Title</h1></header><p>One two three four five.</p><aside>Read this too</aside><p>Six.</p><footer>by me</footer></article></main><footer>f</footer>", "Title\nOne two three four five.\nSix."),
    ("<div class='cookie-notice'>We use cookies on this site to make it better for all of you each day</div><div id=content><h1>Big</h1><p>some words that are the article</p><ul><li>item one</li><li>item two</li></ul><p>its end</p></div><div class='sidebar'>other <a>x</a></div>", "Big\nsome words that are the article\nitem one\nitem two\nits end"),
    ("<article><p>The article is short.</p></article><section id='comments'><p>" + "I love this so much and more " * 20 + "</p></section>", "The article is short."),
    ("<article><p>Text.</p><form>Sign <input name=a> up <button>go</button></form><script>var a = '<p>no</p>';</script><style>p{}</style><p>End.</p></article>", "Text.\nEnd."),
    ("<article><p>before<!-- <p>hidden</p> --> after</p><p hidden>no</p><p style='display: none'>no</p><noscript>no</noscript></article>", "before after"),
    ("<body class='has-sidebar'><div class=nav>x<article><p>An advert left open does not hold the article.</p></article>", "An advert left open does not hold the article."),
    ("<ARTICLE><P CLASS=\"x>y\">Upper case</P></ARTICLE>", "Upper case"),
    ("<article><p>one</p><p>two", "one\ntwo"), ("</div></p><article>text</article></nav>", "text"), ("<article></article><nav>menu of words</nav>", ""),
    ("<article><table><tr><td>a</td><td>b</td></tr></table></article>", "a\nb"), ("<article><p>never ends <!-- at all", "never ends"), ("<article><p>x</p><script>never ends", "x"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_odd_pages(page, want):
    assert ht.main_text(page, ht.Weights()) == want


def expected(page):
    """The text of a page that marks its article, by plain replacement."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inside = re.sub(r"</?b>", "", inside.replace("<br>", " "))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inside)) if t)


def test_given_pages(spark):
    got = {r["page_id"]: r for r in queries.op13_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        assert got[r["page_id"]]["text"] == expected(r["html"]) and got[r["page_id"]]["n_chars"] == len(expected(r["html"])) and got[r["page_id"]]["url"] == r["url"]


def test_without_the_article_element(spark):
    """The scan alone finds the article of the given pages once its element is taken away."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    weights = ht.train(spark.read.parquet(f"{SF}/pages.parquet"))
    same = sum(ht.main_text(re.sub(r"</?article>", "", r["html"]), weights) == expected(r["html"]) for r in pages)
    assert same >= 0.95 * len(pages)


def test_weights_of_labelled_pages(spark):
    page = "<nav><a>m</a><a>n</a><a>o</a></nav><div class=zone>{}</div><article><p>{}</p></article>"
    rows = [(i, page.format("bought word " * 6, "good word " * 40)) for i in range(10)] + [(90, None), (91, "no article"), (None, "<article>a</article><article>b</article>")]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    w = ht.train(df)
    assert ".zone" in w.outside and "nav" in w.outside and "div" not in w.outside and w.tags["a"] < w.tags["p"] < 0
    assert ht.main_text("<div class=zone>" + "x " * 50 + "</div><p>the text here</p>", w) == "the text here"
    assert ht.train(df.limit(0)) == ht.Weights() == ht.train(df.where("page_id = 91"))
    assert ht.train(df.repartition(1)) == w


def test_rows_of_pages(spark):
    rows = [(1, "<p>a b c</p>", "u"), (1, "<p>a b c</p>", "u"), (None, None, None), (2, "<article>" + "<p>word word</p>" * 30_000 + "</article>", "v")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string")
    for name in ("text", "n_chars", "_pageid", "h"):
        df = df.withColumn(name, df["url"])
    out = ht.extract(df, ht.Weights())
    got = sorted(((r["page_id"], r["n_chars"], r["text"][:9], r["h"]) for r in out.collect()), key=str)
    assert got == sorted([(1, 5, "a b c", "u"), (1, 5, "a b c", "u"), (None, 0, "", None), (2, 30_000 * 10 - 1, "word word", "v")], key=str)
    assert out.limit(0).collect() == [] and ht.extract(df.limit(0), ht.Weights()).collect() == []
