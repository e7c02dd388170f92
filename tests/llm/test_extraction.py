"""Main text: messages against all labellings of small trees, held-out labelled pages, pages written by hand, odd rows."""

import itertools
import random

import numpy as np
import pytest

from slipmill.llm import extraction as ex


@pytest.fixture(scope="module")
def model():
    return ex.default_model()


def text_of(model, page):
    return ex.main_text(next(model.leaves([page])))


def test_messages_against_all_labellings():
    rng = np.random.default_rng(4)
    for page in ("<div>a<p>b</div>c", "<ul><li>x<li>y</ul>", "<p>one<b class=k>two</b>", "x"):
        number = {}
        tree = ex.Tree(page, number, grow=True)
        weights, edges, n = rng.normal(size=len(number)), rng.normal(size=(ex.EDGES, 2, 2)), len(tree.parent)
        forest = ex.Forest([tree])
        own = np.bincount(forest.owner, weights[forest.of], n)
        total, one, pairs = 0.0, np.zeros(n), np.zeros_like(edges)
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(own[k] * y[k] for k in range(n)) + sum(edges[tree.edge[k], y[tree.parent[k]], y[k]] for k in range(1, n)))
            total += p
            one += p * np.array(y)
            for k in range(1, n):
                pairs[tree.edge[k], y[tree.parent[k]], y[k]] += p
        assert np.allclose(forest.marginals(weights, edges), one / total)
        slope, between = forest.gradient(weights, edges)  # no label is set, so the observed pairs are (0, 0)
        observed = np.zeros_like(edges)
        for k in range(1, n):
            observed[tree.edge[k], 0, 0] += 1
        assert np.allclose(between, observed - pairs / total)
        assert np.allclose(slope, -np.bincount(forest.of, (one / total)[forest.owner], len(weights)))


def test_held_out_pages(model):
    right = kept = wanted = total = 0
    for page in ex.labelled_pages(200, seed=77):
        tree = ex.Tree(page, model.number)
        marginal = ex.Forest([tree]).marginals(model.weights, model.edges)
        for node, _, _ in tree.leaves:
            right += (marginal[node] >= 0.5) == tree.label[node]
            kept += tree.label[node] and marginal[node] >= 0.5
            wanted += tree.label[node]
            total += 1
    assert right / total > 0.97 and kept / wanted > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><div class=cookie-notice><p>We use cookies to improve your experience on our site.</p></div>
<nav><ul><li><a href=/>Home</a><li><a href="/a">About us</a></ul></nav>
%s
<aside><h3>Related</h3><ul><li><a href="/x">Other story</a></ul></aside>
<section id="comments"><h2>2 comments</h2><div class="comment"><p>I read this with great pleasure, thank you so much for writing it down.</p></div></section>
<form class="newsletter"><p>Sign up for our letters, we send one each week.</p><input name=q><button>Go</button></form>
<footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


@pytest.mark.parametrize("main", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', "<div id='content'><div>%s</div></div>", "<section itemprop=articleBody>%s</section>"])
def test_whole_page(model, main):
    inside = """<h1>The  title &amp; more</h1><p>First paragraph\n with a <a href="/l">link</a>, two
    lines<br>and a break.<p>Second one without an end<div class="ad"><p>Buy this now, it is cheap and good.</p></div><ul><li>one item of a list<li>another item</ul>
    <script>x</script><!-- note --><p>Caf&eacute;&nbsp;&#8364; &ampersand</p>"""
    assert text_of(model, PAGE % (main % inside)).split("\n") == [
        "The title & more", "First paragraph with a link, two lines and a break.", "Second one without an end", "one item of a list", "another item", "Café € &ersand"]


@pytest.mark.parametrize(("page", "blocks"), [
    ("<p>a</p>b<p>c", ["a", "b", "c"]),
    ("<p>a<b>b</b> <i>c</i>d<br>e", ["ab cd e"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ("<div title='x > y' class=a/b>a</div></div></p>b", ["a", "b"]),
    ("a<!-- <p>x --->b<!DOCTYPE x><?php x ?>c", ["abc"]),
    ("a<script>if (a < b) '</p>'</script>b<STYLE>x</STYLE >c<textarea>y</textarea>", ["abc"]),
    ("a<script>never ends <p>b", ["a"]),
    ("<p>1 < 2 and 3<4 <p>x<a href='cut off", ["1 < 2 and 3<4", "x"]),
    ("<p>a<span class=s>b</span>c</p>", ["abc"]),
    ("<p>&lt;p&gt; &amp;amp; &am &amp", ["<p> &amp; &am &"]),
    ("<svg><text>no</text></svg><h2>x</h2><hr>y<img src=a>z", ["x", "yz"]),
    ("", []), ("   \n\t ", []),
])
def test_blocks(page, blocks):
    lines = {}
    for _, line, raw in ex.Tree(page, {}).leaves:
        lines.setdefault(line, []).append(raw)
    assert [" ".join("".join(parts).split()) for parts in lines.values()] == blocks


def test_nothing_is_dropped_at_any_length(model):
    words = [f"w{k}" for k in range(300_000)]
    page = "<body><nav><a href=/>x</a></nav><article>" + "".join(f"<p>{' '.join(words[k : k + 50])}" for k in range(0, len(words), 50)) + "</article>"
    assert text_of(model, page).split() == words
    assert text_of(model, "<article>" + "<div>" * 3 + "<p>deep down</p>").split() == ["deep", "down"]
    assert [raw for _, raw, _ in next(model.leaves(["<div>" * 3000 + "deep down"]))] == ["deep down"]


def test_odd_rows(spark, model):
    rng = random.Random(1)
    pages = [None, "", "no markup at all, only a sentence.", "<" * 200, "<a" * 100, "&" * 50, *("".join(rng.choice(["<p>", "</p>", "<div class='", "'>", "<", ">", "&", "a ", "</", "<!--", '"', "é"]) for _ in range(60)) for _ in range(40))]
    rows = [(k if k else None, f"u{k}", page, "x") for k, page in enumerate(pages)] + [(3, "u3", pages[3], "y")]
    out = ex.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert next(r.text for r in out if r.url == "u0") == next(r.text for r in out if r.url == "u1") == ""
    assert {r.text for r in out if r.url == "u3"} == {text_of(model, pages[3])}
    marginals = ex.leaves(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert all(0 <= r.marginal <= 1 and r.text.strip() for r in marginals)
    assert ex.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []
