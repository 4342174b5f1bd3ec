"""Main text of written pages and of the given ones."""

import html
import re

import pytest

from helixframe.llm import extract as X
from helixframe.llm import q_extract

LONG = "This is a proper sentence of the article, with commas, and a full stop. " * 3


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<nav>menu</nav>", ""), ("<div><!-- open", ""),
    ("<p>A &amp; B&nbsp;&#233;  c\n d<p>next", "A & B é c d\n\nnext"),
    ("<body><header>Site</header><nav><a>x</a></nav><article><header><h1>Head</h1></header><p>One <b>two</b><i>x</i>"
     f"<br>three</p><p>{LONG}</p><div class='share-bar'>share</div></article><aside>side</aside>"
     "<div id='comments'><p>First!</p></div><form><p>name</p></form><footer>c</footer></body>",
     f"Head\n\nOne twox three\n\n{LONG.strip()}"),
    (f"<div class=top-menu><a>a</a></div><div class=body><h2>Title</h2><p>{LONG}</p><p>Yes.</p></div>"
     "<div class='cookie-notice'>We use cookies, as you know, to help.</div><script>if (a<b) '</p>'</script>",
     f"Title\n\n{LONG.strip()}\n\nYes."),
    ("<article><ul><li>one<li>two</ul><p hidden>no</p><style>p{}</style><p>z</article></p></div>", "one\n\ntwo\n\nz"),
])
def test_pages(page, text):
    assert X.content_text(page) == text


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q_extract.op8_extract(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "old"), (1, "<p>x</p>", "old"), (2, None, "old")],
                               "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in X.extract(df).collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert X.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    (f"<div class='container with-sidebar'><article class='post comments-open'><p>{LONG}</p></article></div>",
     LONG.strip()),
    (f"<main class=search><article><header class=entry-header><h1>Head</h1></header><h2 id=related-work>Related</h2>"
     f"<p>{LONG}</p><h2 id=social-security class=banner>Social</h2><p>{LONG}</p></article></main>",
     f"Head\n\nRelated\n\n{LONG.strip()}\n\nSocial\n\n{LONG.strip()}"),
    (f"<div class='overflow-hidden p-4'><p>{LONG}</p></div><div data-id='search-1'><p>{LONG}</p></div>",
     f"{LONG.strip()}\n\n{LONG.strip()}"),
    (f"<div class='widget'><p>{LONG}</p></div><div style='display: none'><p>{LONG}</p></div>", LONG.strip()),
    (f"<article><p>{LONG * 3}</p><section id=related-work><p>{LONG * 3}</p></section></article>",
     f"{(LONG * 3).strip()}\n\n{(LONG * 3).strip()}"),
    (f"<article><p>{LONG}</p><div id=comments><ol class=comment-list><li><article class=comment-body><p>First, "
     "and best!</p></article></ol></div></article><div class=related><article><p>Read this, too.</p></article></div>",
     LONG.strip()),
])
def test_furniture_words_do_not_empty_the_main_text(page, text):
    assert X.content_text(page) == text


PARAGRAPH = "<p>" + "word, " * 8 + "word " * 70 + "</p>"
ITEMS = [f"entry number {i} without any mark" for i in range(6)]


@pytest.mark.parametrize("short", [
    "<ul>" + "".join(f"<li>{i}" for i in ITEMS) + "</ul>",
    "<table><tr>" + "<tr>".join(f"<td>{i}</td>" for i in ITEMS) + "</table>",
    "<div><dl>" + "".join(f"<dt>{i}" for i in ITEMS) + "</dl></div>",
    "<div><h2>" + ITEMS[0] + "</h2><div>" + "".join(f"<div>{i}</div>" for i in ITEMS[1:]) + "</div></div>",
])
@pytest.mark.parametrize("page", [
    "<div>{p}{p}{s}{p}{p}</div>", "<body><div class=nav><a>x</a></div><div><div>{p}{p}</div>{s}<div>{p}{p}</div></div></body>",
    "<div><section><h2>T</h2>{p}{p}{p}{p}</section><section><h2>U</h2><p>See.</p>{s}</section></div>", "{p}{p}{s}{p}{p}",
    "<body><div><a>Home</a><a>About</a></div><div class=widget>{p}{p}{p}{p}{s}</div></body>"])
def test_short_entries_inside_the_text_stay(page, short):
    found = X.content_text(page.format(p=PARAGRAPH, s=short)).split("\n\n")
    assert [t for t in found if t.startswith("entry")] == ITEMS
    assert sum(t.startswith("word") for t in found) == 4


def test_unnamed_boilerplate_beside_the_text_goes():
    text = X.content_text(f"<body><div><ul><li><a>Home page</a><li><a>About us</a></ul></div><div>{PARAGRAPH * 4}</div>"
                          "<div><div><p>made by</p></div></div></body>")
    assert text.count("\n\n") == 3 and "Home" not in text and "made by" not in text


COMMENTS = "<p>I do not agree, frankly. Has anybody read it? " + "It is wrong, and long, and wrong again. " * 8 + "</p>"


@pytest.mark.parametrize("times", [1, 3, 40])
@pytest.mark.parametrize("page", [
    "<article><h1>Head</h1>{p}{p}<section class=comments>{c}</section></article>",
    "<article><h1>Head</h1>{p}{p}<div id=comments><h2>Replies</h2>{c}</div></article>",
    "<main><h1>Head</h1>{p}{p}<div class='sidebar left'>{c}</div></main>",
    "<div class=page><h1>Head</h1>{p}{p}</div><div class=comments>{c}</div>",
    "<div class=page><h1>Head</h1>{p}{p}</div><div class=sidebar>{c}</div>",
    "<div class=cookie-notice>{c}</div><div class=page><h1>Head</h1>{p}{p}</div>",
    "<div class='site-header top-bar'>{c}</div><div><h1>Head</h1>{p}{p}<div class=relatedArticles>{c}</div></div>",
])
def test_named_furniture_goes_whatever_its_length(page, times):
    text = X.content_text(page.format(p=f"<p>{LONG}</p>", c=COMMENTS * times))
    assert text == f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"


def test_words_that_only_look_like_furniture_stay():
    for name in ("with-sidebar", "related-work", "no-comments", "advertising-history", "headerless", "share-prices"):
        assert X.content_text(f"<div><p>{LONG}</p><section class='{name}'><p>{LONG}</p></section></div>").count("proper") == 6


def test_buttons_and_hidden_pieces_inside_a_line_go():
    page = f"<article><p>{LONG}<button>Press me</button> <span hidden>no <b>never</b></span>end.</p></article>"
    assert X.content_text(page) == LONG.strip() + " end."


@pytest.mark.parametrize("page", [
    "<article>" + "<div>x" * 10_000, "<div>" * 10_000 + f"<p>{LONG}</p>", "<div><p>x.</p>" * 5_000, "<a " * 350_000,
    "<a href=\"x' " * 100_000, "<!--" * 250_000, "<script" * 150_000, "<p><b><i>x" * 100_000, "</div></p></b>" * 70_000,
    "<ul><li>" * 20_000 + "x", "<table><tr><td>x" * 20_000, "&" * 1_000_000, "a < b " * 150_000, "<" * 1_000_000,
    "<div class=comments>x" * 5_000, "<article><div class=comments>x. " * 3_000, "<div a='" + "b c=\"" * 100_000])
def test_hostile_pages_take_time_and_memory_of_their_length(page):
    import time
    import tracemalloc

    began = time.process_time()
    X.content_text(page)
    assert time.process_time() - began < 15
    tracemalloc.start()
    X.content_text(page[:200_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
