import itertools
import math
import random
import re
from collections import Counter

import pytest

from folium.llm import html_extraction as html
from folium.llm import layouts, queries
from tests.conftest import SF


@pytest.mark.parametrize("seed", range(20))
def test_marginals_by_enumeration(seed):
    pick = random.Random(seed)
    n = pick.randint(1, 9)
    parents = [-1] + [pick.randrange(i) for i in range(1, n)]
    odds, edges = [pick.uniform(-4, 4) for _ in range(n)], [(pick.random(), pick.random()) for _ in range(n)]
    weight = [0.0] * n
    total = 0.0
    for y in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i in range(n):
            on = edges[i][y[parents[i]] if i else 0]
            p *= (on if y[i] else 1 - on) * math.exp(odds[i] * y[i])
        total += p
        weight = [w + p * v for w, v in zip(weight, y)]
    assert html.marginals(parents, odds, edges) == pytest.approx([w / total for w in weight])


def truth(page):
    blocks = {}
    for at, block, text, _ in page.pieces:
        if page.labels[at]:
            blocks.setdefault(block, []).append(text)
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks.values()) if t)


def likeness(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


@pytest.fixture(scope="module")
def learnt(spark):
    pages = spark.read.parquet(f"{SF}/../sf0.01/pages.parquet")
    return html.learn(pages.where("page_id < 170")), {r["page_id"]: r["html"] for r in pages.where("page_id >= 170").collect()}


def test_held_out_pages_in_layouts_that_were_not_learnt(learnt):
    """Pages and seeds that the model has not seen, without what labels them."""
    model, pages = learnt
    scores = []
    for i, h in pages.items():
        copy = layouts.dressed(layouts.parts(html.read(h)), 10**6 + i)
        want = truth(html.read(copy))
        if want:
            scores.append(likeness(html.extract(re.sub(r' data-main="."', "", copy), model), want))
    assert sum(scores) / len(scores) > 0.88 and sum(s > 0.95 for s in scores) > 0.8 * len(scores)


PARTS = """<html><body><div class="site-header"><a href="/">Home</a> A site</div><div id="main-menu"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div>
<div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
<div class="post-content"><h1>Rivers &amp; roads</h1><p>The <b>river</b> rose, and <a href="/x">all the roads</a> were under water for a week. Nobody had seen the like.</p><p>Then it\n fell&nbsp;again.<br>People came back to their houses, and the bridges were opened one by one. It took a month.</p>
<div class="advert">Buy boats now. The best boats are here.</div><ul><li>First the northern bridge, which was new.</li><li>Then the old one.</li></ul></div>
<div class="sidebar"><h3>More</h3><ul><li><a href="/c">Boats of the world</a></li></ul></div><div class="comments"><h3>Comments</h3><div class="comment"><p>I was there, and the water came up to the door. Terrible days.</p></div></div>
<form action="/s"><label>Search this site</label><input></form><div class="footer">&copy; 2020 A site. All rights reserved.</div><script>var x = "<p>no text</p>";</script></body></html>"""


def test_every_kind_of_part(learnt):
    text = html.extract(PARTS, learnt[0])
    assert text == "Rivers & roads The river rose, and all the roads were under water for a week. Nobody had seen the like. Then it fell again. People came back to their houses, and the bridges were opened one by one. It took a month. First the northern bridge, which was new. Then the old one."


ODD = ["", "<", "<p", "plain words alone", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep", "<b>" * 2000 + "x" + "</b>" * 2000, "<![CDATA[x]]><p>y", "<![if IE]><p>y<![endif]>", "&#xD800;&#1;&bogus;&amp", "<script>never ends", "</p></div></x>", "<a" + " b='c'" * 2000 + ">t</a>", "<ul>" + "<li>one" * 2000, "\x00\x01<p\x00>x", "<!-- never ends", "<table><tr><td>a<td>b<tr><td>c", "<p>a</p " * 500, "<html><html><body><body>x</html>y"]


@pytest.mark.parametrize("page", ODD)
def test_odd_markup(page, learnt):
    html.extract(page, learnt[0])


def test_tree_of_unclosed_elements():
    page = html.read("<p><b>one<br><p>two<ul><li>a<li>b<ul><li>c</ul><li>d</ul><td>x")
    blocks = {}
    for at, block, text, _ in page.pieces:
        blocks.setdefault((page.tags[at], block), []).append(text)
    assert [(tag, "".join(t)) for (tag, _), t in blocks.items()] == [("p", "one"), ("p", "two"), ("li", "a"), ("li", "b"), ("li", "c"), ("li", "d"), ("td", "x")]
    depth = lambda at: 0 if at < 1 else 1 + depth(page.parents[at])
    lis = [depth(i) for i, t in enumerate(page.tags) if t == "li"]
    assert lis == [2, 2, 4, 2]


def test_odd_pages(spark, tmp_path):
    """Null, empty and very long pages, rows that repeat, null keys, columns of the operator's names."""
    long = "<article><h1>Long</h1>" + "<p>Some words of a very long page, again and again.</p>" * 40_000 + "</article><footer>the end</footer>"
    pages = [(1, "u", None), (2, None, ""), (3, "u", PARTS), (3, "u", PARTS), (None, "u", PARTS), (4, "u", long), (5, "u", "<nav><a href='/'>only a menu</a></nav>")]
    rows = [(*p, "old", 9, "seed") for p in pages]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, seed string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_html_extraction(spark, str(tmp_path)).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(p[0]) for p in pages)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["text"] == by_id[2]["text"] == by_id[5]["text"] == "" and by_id[4]["n_chars"] == len("Long") + 49 * 40_000
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op11_html_extraction(spark, str(tmp_path)).count() == 0
