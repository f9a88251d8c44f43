"""Main text of hand-labelled pages whose layouts the training pages don't have; odd markup; the field by enumeration."""

import itertools
import time

import numpy as np
import pytest

from lodestream.llm import htmltext
from lodestream.llm.crf import LinearChainCRF

BLOG = """<!doctype html><html><head><title>Bread - Oven Diary</title><noscript><link href=x.css></noscript></head><body class="home single-post">
<div id="page"><header id="masthead"><a href="/">Oven Diary</a><nav><ul><li><a href=/a>Recipes</a><li><a href=/b>About me</a></ul></nav></header>
<main id="primary"><article class="post type-post hentry"><h1 class="entry-title">A slow loaf for cold days</h1>
<div class="entry-content"><p>Flour, water and salt are all that this loaf needs, and a night of patience. I mix the dough after supper, cover it,
and leave it on the coldest shelf until the next morning comes around.</p><h2>Shaping the dough</h2>
<p>Fold it four times, wait twenty minutes, then fold it again. The dough should feel like an ear lobe; if it sticks to your fingers, wet them.</p>
<ul><li>Heat the oven with the pot inside for at least forty minutes.</li><li>Bake with the lid on for half an hour, then without it.</li></ul>
<p>Let it cool before cutting, which is <em>the hardest part</em> of the whole affair &amp; the most important.</p></div></article>
<div id="comments" class="comments-area"><h2>2 replies</h2><ol><li class="comment"><p>I tried this yesterday and it was great, thank you so much!</p></li></ol></div></main>
<aside class="widget-area"><h3>Recent posts</h3><ul><li><a href=/1>Rye and caraway</a></li><li><a href=/2>Buns in an hour</a></li></ul></aside>
<footer><p>&copy; 2021 Oven Diary. All rights reserved.</p></footer></div></body></html>"""
BLOG_IN = ("A slow loaf for cold days", "Flour, water and salt", "Shaping the dough", "Fold it four times", "Heat the oven", "Let it cool before cutting", "the hardest part of the whole affair & the most important.")
BLOG_OUT = ("About me", "2 replies", "I tried this yesterday", "Rye and caraway", "All rights reserved", "Oven Diary.")

DOCS = """<html><body><div class="topbar"><a href="/">Docs</a> <a href="/api">API</a> <form action=/s><input name=q><button>Search</button></form></div>
<div class="layout"><div class="sidebar toc"><ul><li><a href="#i">Install</a></li><li><a href="#u">Usage</a></li><li><a href="#c">Configuration</a></li></ul></div>
<main class="content" role="main"><h1>Getting started with the scheduler</h1><p>The scheduler runs jobs at fixed times. It reads its table when it starts, and
whenever the table's file has changed since the last look, which happens once a minute.</p>
<pre>run --every 5m job.sh
run --at 12:00 other.sh</pre><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>--every</td><td>Repeats the job after each interval, counted from its start.</td></tr></table>
<p>Jobs that are still running when their time comes again are not started twice; a line in the log says so.</p></main></div>
<div class="footer"><a href=/p>Privacy</a> | <a href=/t>Terms</a> | Powered by nothing</div></body></html>"""
DOCS_IN = ("Getting started with the scheduler", "The scheduler runs jobs at fixed times.", "Jobs that are still running", "Repeats the job after each interval")
DOCS_OUT = ("Configuration", "Privacy", "Powered by nothing", "Search")

NEWS = """<html><body><div class="cookie-banner"><p>We use cookies to give you the best experience. Read our policy.</p><button>Accept</button></div>
<div class="nav"><a href=/w>World</a><a href=/s>Sport</a><a href=/m>Money</a></div>
<div class="ad-slot"><p>Advertisement: the best mattresses of the year, now half price!</p></div>
<div class="story-wrapper"><div class="story-body"><h1>River rises above its banks for a third time</h1><p class="byline">By a reporter</p>
<p>The river that runs through the old town rose above its banks on Sunday, for the third time in as many months, and flooded the cellars of the lower streets.</p>
<p>Nobody was hurt, the mayor said, but the bridge by the mill would stay closed until engineers had looked at its piers. "We will not take any risk," he said.</p>
<div class="promo"><a href=/x>Sign up for our newsletter</a></div>
<p>Water levels had begun to fall on Monday morning, and rain is not expected before the end of the week, according to the weather service.</p></div></div>
<div class="related"><h3>More on this story</h3><a href=/1>Town council meets over flood walls</a><a href=/2>How to dry a cellar</a></div></body></html>"""
NEWS_IN = ("River rises above its banks", "The river that runs through", "Nobody was hurt", "Water levels had begun to fall")
NEWS_OUT = ("We use cookies", "Advertisement", "Sport", "newsletter", "How to dry a cellar")

OLD = """<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><A HREF=index.html>Home</A> | <A HREF=links.html>Links</A> | <A HREF=mail.html>Mail</A></TD></TR>
<TR><TD WIDTH=150 CLASS=menu><A HREF=1.html>Chapter one</A><BR><A HREF=2.html>Chapter two</A><BR><A HREF=3.html>Chapter three</A></TD>
<TD CLASS=content><H2>The lighthouse on the northern cape</H2><P>The lighthouse was built in the year of the great storm, by twelve masons from the south who had never seen the sea before they came.
<P>Its lamp could be seen from thirty miles away on clear nights, and the keepers wrote down every ship that passed in a book which is still kept there.
<P>After the keepers left, the lamp was turned by a clock, and later by a motor; today it is a museum, open in summer.</TD></TR></TABLE></BODY></HTML>"""
OLD_IN = ("The lighthouse was built", "Its lamp could be seen", "After the keepers left")
OLD_OUT = ("Chapter two", "Links")


@pytest.mark.parametrize(("page", "inside", "outside"), [(BLOG, BLOG_IN, BLOG_OUT), (DOCS, DOCS_IN, DOCS_OUT), (NEWS, NEWS_IN, NEWS_OUT), (OLD, OLD_IN, OLD_OUT)])
def test_hand_labelled_pages(page, inside, outside):
    text = htmltext.main_texts([page], htmltext.default_model())[0]
    assert [x for x in inside if x not in text] == [] and [x for x in outside if x in text] == [], text


ONE = "A single paragraph that tells about one thing only, and does so at some length, so that nobody takes it for a label. It ends here."
RIVER = "On rivers The river rose in spring, and the bridge was closed until engineers had looked at it. It fell again in June."
ART = "<h1>On rivers</h1><p>The river rose in spring, and the bridge was closed until engineers had looked at it.</p><p>It fell again in June.</p>"
WHOLE = [
    (f"<body><p>{ONE}</p></body>", ONE), (ONE, ONE), (f"<html><head><title>t</title></head><body><div>{ONE}</div></body></html>", ONE), ("<body>Just a line</body>", "Just a line"), (f"<article>{ART}</article>", RIVER), (ART, RIVER),
    (f"<article>{ART}</article><div id=ftr>Copyright 2020</div>", RIVER), (f"<article>{ART}</article><div class=f>Imprint | Terms of use | Privacy</div>", RIVER), (f"<body><div class=x1><a href=/>Home</a> <a href=/b>News</a></div><div class=c2>{ART}</div><div class=zz>All rights reserved. Some Company Ltd.</div></body>", RIVER),
    (f"<body><p><a href=/>Home</a> | <a href=/2>Next</a></p>{ART}<p>&copy; 2020 River Times</p></body>", RIVER), (f"<article>{ART}<p>All rights reserved.</p></article><footer>&copy; 2020</footer>", f"{RIVER} All rights reserved."),
]


@pytest.mark.parametrize(("page", "text"), WHOLE)
def test_whole_texts_of_bare_and_nameless_pages(page, text):
    assert htmltext.main_texts([page], htmltext.default_model()) == [text]


def test_nothing_in_the_article_is_dropped():
    page = "<body><nav><a href=/>Home</a></nav><article><h1>On sums and their parts</h1><p>Take <math><mi>x</mi></math> as any number, and <svg><text>y</text></svg> as another one; both are kept as they are here.</p><noscript><p>Kept text, as long as a sentence should be in an article.</p></noscript><script>no()</script></article></body>"
    text = htmltext.main_texts([page], htmltext.default_model())[0]
    assert "Take x as any number, and y as another one" in text and "Kept text, as long as" in text and "no()" not in text


@pytest.mark.parametrize("make", [lambda n: "a <b " * n, lambda n: "<b>x</b>" + "<span>" * n + "</b>" * n, lambda n: "<b><td>" + "<span>" * n + "</b>" * n, lambda n: "<b" + ' "<b"' * n + " '>", lambda n: "<div>" + "<span>" * n + "<hr>" * n, lambda n: "<script>" * n])
def test_time_is_linear(make):
    page = make(100_000)
    t = time.process_time()
    htmltext.leaf_blocks(page)
    assert time.process_time() - t < 8  # a quadratic reading takes hours


def test_steps_change_nothing(monkeypatch):
    model = htmltext.default_model()
    page = "<body>" + "".join(f"<p>Sentence number {i}, which is long enough to be read.</p><a href=/>x</a>" for i in range(300))
    whole = htmltext.main_texts([page, BLOG], model)
    monkeypatch.setattr(htmltext, "STEP", 7)
    assert htmltext.main_texts([page, BLOG], model) == whole


def test_pages_of_any_kind(spark):
    rows = [(1, "u", BLOG, "x"), (1, "u", BLOG, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "plain text only", "x"), (4, "u", "<p>" * 50_000 + "y", None)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by = sorted(got.collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(by) == 6 and by[0] == by[1] and by[2].text == "" and by[3].n_chars == 0 and all(r.n_chars == len(r.text) for r in by)
    assert by[0].text.startswith("A slow loaf") and by[2].url is None and by[-1].text == "plain text only" and by[4].text == "y"
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_field_by_enumeration():
    rng = np.random.default_rng(8)
    m = LinearChainCRF(3)
    m.mean, m.scale, m.w, m.t = np.zeros(4), np.ones(4), rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    lens = [5, 0, 1, 6, 3]
    off = np.r_[0, np.cumsum(lens)].astype(np.int64)
    x = rng.normal(size=(off[-1], 4))
    e = m.scores(x)
    best, marg = m.viterbi(x, off), m.marginals(x, off)
    for a, b in zip(off[:-1], off[1:], strict=True):
        paths = list(itertools.product(range(3), repeat=int(b - a)))
        v = np.array([sum(e[a + i, s] for i, s in enumerate(p)) + sum(m.t[p[i], p[i + 1]] for i in range(len(p) - 1)) for p in paths])
        assert tuple(best[a:b]) == paths[v.argmax()]
        w = np.exp(v - v.max())
        for i in range(int(b - a)):
            want = [w[[p[i] == s for p in paths]].sum() / w.sum() for s in range(3)]
            assert np.allclose(marg[a + i], want)
