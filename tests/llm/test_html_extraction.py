import html as _html
import itertools
import math
import random
import re

import numpy as np
import pytest

from lakeloom.llm.dom import IN, OUT, parse
from lakeloom.llm.html_extraction import EDGES, SIZE, Model, edge_kind, extract, features, fit, labelled, main_text, train

SCHEMA = "page_id long, url string, html string, text string, h string"


def simple(source):
    """The article of the driver's pages, by their known markup."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|blockquote|table|tr|td)\b[^>]*>", body)
    flat = (" ".join(_html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts)
    return "\n".join(p for p in flat if p)


def test_driver_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    got = extract(pages, train(pages.where("page_id % 2 = 0"))).where("page_id % 2 = 1").collect()
    source = {r.page_id: r.html for r in pages.collect()}
    right = sum(r.text == simple(source[r.page_id]) for r in got)
    assert right / len(got) > 0.97
    assert all(r.n_chars == len(r.text) for r in got)


def renamed(source, rng, names=True):
    """The page with its named parts as plain containers and its class names at random."""
    source = re.sub(r"<(/?)(?:article|main|nav|footer)\b", r"<\1div", source)
    return re.sub(r'class="[^"]*"', lambda _: f'class="c{rng.randrange(10**6)}"', source) if names else source


def test_driver_pages_with_marks_renamed(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    model = train(pages.where("page_id % 2 = 0"))
    odd = [r.html for r in pages.where("page_id % 2 = 1").collect()]
    for names in (False, True):
        got = [(main_text(renamed(h, random.Random(i), names), model), simple(h)) for i, h in enumerate(odd)]
        assert sum(a == b for a, b in got) / len(got) > 0.9
        assert all(a for a, _ in got)


def test_pages_without_marks():
    model = fit(labelled([]))
    assert main_text("just text", model) == "just text"
    assert main_text("<p>only</p>", model) == "only"
    assert main_text("<html><body><div>One part of a page.</div><div>Another part of it.</div></body></html>", model) == "One part of a page.\nAnother part of it."
    assert main_text("<nav>menu</nav><footer><p>Foot.</p></footer>", model) == ""


@pytest.mark.parametrize("part", ['<div class="more">{}</div>', '<section class="discussion">{}</section>', '<div class="reviews">{}</div>', '<div class="text-legal">{}</div>', '<div id="q7">{}</div>'])
def test_parts_of_the_text_with_telling_names(part):
    model = fit(labelled([]))
    for seed in range(4):
        source, want = page(random.Random(seed), inside=part.format("<p>This is part of the text too.</p>"))
        lines = want.split("\n")
        assert main_text(source, model) == "\n".join([*lines[:3], "This is part of the text too.", *lines[3:]])


def page(rng, inside="", before="", after=""):
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n)).capitalize() + "."
    title, paragraphs = words(5), [words(rng.choice([2, 12, 60])) for _ in range(4)]
    wrap = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>")])
    text = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>{inside if i == 1 else ''}" for i, p in enumerate(paragraphs))
    return f"<html><body>{before}{wrap[0]}{text}{wrap[1]}{after}</body></html>", "\n".join([title, *paragraphs])


@pytest.mark.parametrize(
    "part",
    [
        '<div class="comments"><p>Nice read, thanks a lot for it.</p><p>I agree with all of this here.</p></div>',
        '<section id="comment-list"><div class="comment"><b>Ann</b><p>First! This is what I think of it.</p></div></section>',
        "<aside><h3>More</h3><p>Another story that you may like to read.</p></aside>",
        '<div class="cookie-banner"><p>We use cookies. Please accept all of them.</p></div>',
        '<form action="/x"><p>Your address here.</p><input name="q"><button>Send</button></form>',
        '<nav class="breadcrumbs"><a href="/">Home</a> <a href="/a">News</a></nav>',
        '<div class="ad-slot"><p>Buy one today. It is cheap and good.</p></div>',
        '<div role="alert" class="notice">Your browser is old. Update it now.</div>',
        "<footer><p>All rights reserved by someone.</p></footer>",
        '<ul class="menu"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>',
        '<script>if (a < b) { document.write("<p>no</p>") }</script><style>p > b {}</style><!-- <p>no</p> -->',
    ],
)
def test_parts_around_the_text(part):
    model = fit(labelled([]))
    for seed in range(4):
        for place in ("inside", "before", "after"):
            source, want = page(random.Random(seed), **{place: part})
            assert main_text(source, model) == want, (place, seed)


def test_markup():
    model = fit(labelled([]))
    assert main_text("<article><p>a&nbsp;b &amp;amp; &#233;&#x41;&copy\n c<br>d<p>e <b>f</b>g<p></p> <p>h<i> i</article>", model) == "a b &amp; éA© c d\ne fg\nh i"
    assert main_text("<article>x<div>y<p>z</div>w < 3 & <<b>v</b></article", model).split("\n") == ["x", "y", "z", "w < 3 & <v"]
    for bad in ("", "<", "<p", "</", "<!--", "<script>", "&", "<a href='", "<article><p>" * 3000, "<![CDATA[", "<p " + "a=\"b' " * 2000):
        main_text(bad, model)


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    source = '<div class="content"><p>a b c.</p><ul><li><a>x</a></li></ul></div><nav>n</nav><p>tail of it</p>'
    p = parse(source)
    model = Model(rng.normal(size=SIZE), np.log(rng.dirichlet([1, 1], size=(EDGES, 2))), 0.3)
    n, unary = len(p.parent), features(p) @ model.weights
    mass, ones = 0.0, np.zeros(n)
    for labels in itertools.product([0, 1], repeat=n):
        w = math.exp(sum(unary[i] * labels[i] for i in range(n)) + model.prior * labels[0] + sum(model.edges[edge_kind(p.tag[i]), labels[p.parent[i]], labels[i]] for i in range(1, n)))
        mass += w
        ones += w * np.array(labels)
    assert np.allclose(model.marginals(p), ones / mass)
    assert OUT in p.hint and IN in p.hint


def test_edges(spark):
    rows = [(1, "u", None, "t", "h"), (2, None, "", "t", "h"), (None, "v", "<main><p>Some words are here.</p></main>", "t", "h"), (3, "w", "<nav>menu</nav>", "t", "h"), (3, "w", "<nav>menu</nav>", "t", "h"), (4, "x", "<article>" + "<p>Long text.</p>" * 20_000 + "</article>", "t", "h")]
    got = {(r.page_id, r.url): r.text for r in extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.pop((4, "x")) == "\n".join(["Long text."] * 20_000)
    assert got == {(1, "u"): "", (2, None): "", (None, "v"): "Some words are here.", (3, "w"): ""}
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


def texts(source):
    return " ".join("".join(t for _, _, t, _ in parse(source).pieces).split())


@pytest.mark.parametrize("part", ["<button>Menu", "<svg><path d='M0'>", "<select><option>One<option>Two", "<video>", "<canvas>", "<template>", "<datalist><option>A"])
def test_unclosed_in_a_header(part):
    model = fit(labelled([]))
    for seed in range(4):
        source, want = page(random.Random(seed), before=f"<header><div>{part}</div></header>", after="<footer><button>Up</button></footer>")
        assert main_text(source, model) == want


def test_ends_of_dropped_elements():
    assert texts("<div><button>a</div><p>b</p><button>c</button>d") == "abd"
    assert texts("<p>a</p><button>b<p>c</p><button>d</button>e") == "abce"
    assert texts("<svg><svg>a</svg>b</svg>c<svg/>d<svg><script></svg></script>e</svg>f") == "cdf"
    assert texts("a<select><option>b<option>c</select>d<button><div>e</button>f") == "adf"
    assert texts("a<!-- <button> -->b<button><!-- </button> -->c</button>d") == "abd"
    assert texts("<button>" * 20_000 + "a") == "a"


def test_formulas_and_fallbacks():
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p>") == "So x=2 holds."
    assert texts('<p>See <object data="a.pdf"><param name="b">the report</object> here.</p>') == "See the report here."
