import random

import numpy as np
import pytest

from sizewise.llm.html_text import decode, extract_main_text, fit_trees, layout, node_features, parse_page, text_of, with_runs

PROSE = [f"Sentence number {i}, which is long enough to be a paragraph of its own; it has commas, too. And it ends." for i in range(40)]
PAGE = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More"
        "</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now, it is cheap.</div><article><h1>%s</h1><p>%s<br>\n x &amp; y&nbsp;z"
        "<p><b>%s</b></p></article><footer>&copy; me</footer><script>var a=\"</p>\";</script></body></html>")


@pytest.fixture(scope="module")
def trees():
    return fit_trees([PAGE % (PROSE[i], PROSE[i + 1], PROSE[i + 2]) for i in range(30)])


def read(trees, page):
    nodes = parse_page(page)
    return text_of(nodes, decode(nodes, trees.log_odds(node_features(nodes))))


def test_a_known_layout(trees):
    assert read(trees, PAGE % ("Title", PROSE[1], PROSE[2])) == f"Title\n{PROSE[1]} x & y z\n{PROSE[2]}"


def test_held_out_layouts(trees):
    rng, found = random.Random(77), []
    for _ in range(150):
        nodes = parse_page(layout(rng, PROSE, [p[:20] for p in PROSE]))
        chosen = decode(nodes, trees.log_odds(node_features(nodes)))
        size = [sum(len(t) for _, t in x.texts) for x in nodes]
        truth = [x.mark == "c" for x in nodes]
        both = sum(s for s, c, t in zip(size, chosen, truth, strict=True) if c and t)
        found.append(2 * both / max(1, sum(s for s, c in zip(size, chosen, strict=True) if c) + sum(s for s, t in zip(size, truth, strict=True) if t)))
    assert np.mean(found) > 0.93


def test_other_boilerplate_goes(trees):
    body = "".join(f"<p>{p}</p>" for p in PROSE[:6])
    page = (f"<body><header class='site-header'><h1>Site</h1></header><div id='cookie-notice'><p>{PROSE[7]}</p></div><aside class='sidebar'>"
            f"<p>{PROSE[8]}</p></aside><main>{body}</main><section class='comments'><p>{PROSE[9]}</p><p>{PROSE[10]}</p></section>"
            f"<form><p>Search <input></p></form><footer><p>{PROSE[11]}</p></footer>")
    assert read(trees, page) == "\n".join(PROSE[:6])


def test_choices_do_not_contradict_each_other():
    nodes = parse_page("<div><div><p>a</p><div><p>b</p></div></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(200):
        chosen = decode(nodes, rng.normal(size=len(nodes)) * 3)
        for i, x in enumerate(nodes):
            path = []
            while i >= 0:
                path.append(chosen[i])
                i = nodes[i].parent
            assert sum(a != b for a, b in zip(path, path[1:])) <= 2 and not path[-1]


def test_markup_that_is_broken():
    assert [t for x in parse_page("a<p>b<p>c</div><li>d<li>e<ul><li>f</ul>g<!-- open <p>x") for _, t in x.texts]
    for page in ("", "<", "<p", "</p>", "<a href='", "<script>x", "&amp", "<p title=\"a > b\">c</p>", "<div>" * 3000 + "x", "a < b"):
        parse_page(page)
    assert [t for x in parse_page("<p title=\"a > b\">c</p><textarea>no</textarea>d &lt;p&gt; &#233;") for _, t in x.texts] == ["d <p> é", "c"]


def test_special_pages(spark):
    rows = [(i, f"u{i}", PAGE % (PROSE[i], PROSE[i + 1], PROSE[i + 2]), "old") for i in range(20)]
    rows += [(100, None, None, None), (101, "u", "", "x"), (None, "u", rows[0][2], "x"), (0, "u0", rows[0][2], "old"),
             (102, "u", "<article>" + "<p>words, many of them here.</p>" * 20_000 + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = got.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if not r.html)
    assert next(r.text for r in got if r.page_id == 102).count("\n") == 19_999
    assert next(r.text for r in got if r.page_id == 5).startswith(PROSE[5])
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("body, text", [
    ("{0}<br>{1}<br><br>{2}", "{0} {1} {2}"),
    ("<font>{0}</font> <span>{1}</span>", "{0} {1}"),
    ("<my-article>{0} {1}</my-article>", "{0} {1}"),
    ("<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav>{0} {1}<p>{2}</p>{3} {4}<footer>&copy; me</footer>", "{0} {1}\n{2}\n{3} {4}"),
])
def test_text_that_stands_in_the_body_itself(trees, body, text):
    nodes = with_runs(parse_page(f"<html><body>{body.format(*PROSE)}</body></html>"))
    assert text_of(nodes, decode(nodes, trees.log_odds(node_features(nodes)))) == text.format(*PROSE)


def test_inline_content_and_unclosed_elements_keep_the_article():
    """Formulas, fallback text and labels are text; only scripts, styles, frames, templates and form controls hide what they hold."""
    from sizewise.llm.html_text import parse_page

    def text_of(page):
        return "\n".join(t for n in parse_page(page) for _, t in sorted(n.texts))

    page = ("<article><p>press <button>the red key</button> now</p><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>"
            "<p><object>a drawing</object> <svg><text>label</text></svg> <video>a film</video> <noscript>plain</noscript> <canvas>chart</canvas></p>"
            "<p>a<select><option>no</option></select>b<template>no</template>c<textarea>no</textarea>d<iframe>no</iframe>e<script>no</script>f</p></article>")
    assert text_of(page) == "press the red key now\nso x=2 holds\na drawing label a film plain chart\na b c d e f"
    for tag in ("button", "object", "video", "svg", "math", "noscript", "template", "select", "canvas"):
        assert text_of(f"<article><p>one <{tag}>two</p><p>three</p></article>") == ("one two\nthree" if tag not in ("template", "select") else "one two\nthree")
    assert text_of("<article><p>one <script>two</p><p>three</p></article>") == "one"
