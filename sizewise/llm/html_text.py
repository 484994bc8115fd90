"""Main text of HTML pages: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages that the trees are fitted on, at most, and how many layouts are made from their texts.
TRAINING_PAGES, LAYOUTS = 400, 900
#: Further layouts whose main text stands in the body itself.
BARE_LAYOUTS = 300
#: A run of text outside all blocks.
RUN = "#text"
TREES, DEPTH, BINS, RATE = 60, 4, 32, 0.25

# Elements of HTML by what they do to the text.
BLOCKS = (
    "html body div section article main aside nav header footer form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
    "thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup center menu dialog"
).split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page. An unclosed one of the second kind hides nothing.
RAW = set("script style iframe textarea title".split())
HIDDEN = set("template select".split())
CLOSES_P = set(BLOCKS) - {"html", "body"}
#: An open element of the first kind ends where one of the others begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
#: Words of class, id and role, by what they tell.
TOKENS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager topnav subnav links skip",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "comment": "comment comments commentlist discussion disqus reply replies respond reader readers thread reactions feedback",
    "side": "sidebar side aside widget widgets related recommended recommendations rail secondary complementary trending popular more",
    "foot": "footer foot bottom copyright colophon contentinfo legal imprint",
    "head": "header head masthead top topbar logo brand branding site title",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay message warning toast info bar paywall",
    "form": "form search login signup subscribe subscription newsletter register input field contact",
    "share": "share sharing social follow tools toolbar buttons meta tags byline author",
    "content": "article content main post entry story body text page prose articlebody maincontent copy blog",
}
_GROUP = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
_BLOCK = {tag: i for i, tag in enumerate(BLOCKS)}
_BAD_TAGS = {"nav", "aside", "header", "footer", "form", "menu", "dialog"}
_GOOD_TAGS = {"article", "main"}
_TAG_KINDS = ("div section article main aside nav header footer form p h1 h2 ul li table td blockquote body".split() + [RUN])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|([^>]*)>)|<[!?/][^>]*>"
                    r"|<[a-zA-Z!?/][^>]*\Z", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    tag: str
    parent: int
    groups: set[int]
    texts: list[tuple[int, str]] = field(default_factory=list)  # where in the page, and the raw text
    links: int = 0
    mark: str = ""
    start: int = 0  # how many texts of the page are read when it begins
    runs: list[tuple[int, str]] = field(default_factory=list)  # of the root: letters in links and mark of each of its texts


def parse_page(page: str) -> list[Node]:
    """The block elements of a page in document order; text belongs to the nearest one, inline markup is transparent."""
    nodes = [Node("html", -1, set())]
    stack = [0]
    links = place = at = counted = 0
    run_mark = ""
    pending: list[str] = []

    def flush() -> None:
        nonlocal place, counted, run_mark
        text = " ".join(html.unescape("".join(pending)).split()) if pending else ""
        pending.clear()
        if text:
            nodes[stack[-1]].texts.append((place, text))
            place += 1
        if stack[-1] == 0:
            if text:
                nodes[0].runs.append((nodes[0].links - counted, run_mark))
            counted, run_mark = nodes[0].links, ""

    def leave(depth: int) -> None:
        flush()
        del stack[depth:]

    search = _TOKEN.search
    while True:
        m = search(page, at)
        if m is None:
            pending.append(page[at:])
            break
        if m.start() > at:
            piece = page[at:m.start()]
            pending.append(piece)
            if links > 0:
                nodes[stack[-1]].links += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK and tag not in ("html", "body"):
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        leave(depth)
                        break
                else:
                    flush()
            elif tag in RAW or tag in HIDDEN:
                pending.append(" ")
            continue
        attributes = m[3] or m[4] or ""
        if tag == "br":
            pending.append(" ")
        elif tag == "hr":
            flush()
        elif tag == "a":
            links += 1
        elif tag in RAW or tag in HIDDEN:
            if attributes.endswith("/"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end or tag in RAW:
                at = end.end() if end else len(page)
            pending.append(" ")
        elif tag in _BLOCK and tag not in ("html", "body"):
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == "p":
                        leave(depth)
                        break
            for depth in range(len(stack) - 1, max(0, len(stack) - 4), -1):
                if tag in ENDS.get(nodes[stack[depth]].tag, ()):
                    leave(depth)
                    break
                if nodes[stack[depth]].tag in ("ul", "ol", "dl", "table"):
                    break
            flush()
            links = 0
            groups: set[int] = set()
            mark = ""
            if "=" in attributes:
                for found in _NAMES.finditer(attributes):
                    value = found[1] or found[2] or found[3] or ""
                    groups |= {_GROUP[w.lower()] for w in _WORDS.findall(value) if w.lower() in _GROUP}
                if "data-mark" in attributes:
                    mark = "c" if 'data-mark="c"' in attributes else "x"
            nodes.append(Node(tag, stack[-1], groups, mark=mark, start=place))
            stack.append(len(nodes) - 1)
        elif stack[-1] == 0 and "data-mark" in attributes:
            run_mark = "c" if 'data-mark="c"' in attributes else "x"
    flush()
    return nodes


def with_runs(nodes: list[Node]) -> list[Node]:
    """The nodes with each text of the root as a node of its own, at its place in the page; others stay as they are."""
    root = nodes[0]
    if not root.texts:
        return nodes
    out, to, waiting = [Node(root.tag, -1, root.groups, mark=root.mark)], {-1: -1, 0: 0}, list(zip(root.texts, root.runs, strict=True))[::-1]

    def add_run() -> None:
        piece, (links, mark) = waiting.pop()
        out.append(Node(RUN, 0, set(), [piece], links, mark))

    for i, x in enumerate(nodes[1:], 1):
        while x.parent == 0 and waiting and waiting[-1][0][0] < x.start:
            add_run()
        to[i] = len(out)
        out.append(Node(x.tag, to[x.parent], x.groups, x.texts, x.links, x.mark, x.start))
    while waiting:
        add_run()
    return out


def node_features(nodes: list[Node]) -> np.ndarray:
    """A row per node: tag, attribute words, depth, subtree density, siblings, place, and the like of its ancestors."""
    n = len(nodes)
    own = [sum(len(t) for _, t in x.texts) for x in nodes]
    total, links, size = own[:], [x.links for x in nodes], [1] * n
    commas = [sum(t.count(",") + t.count(".") for _, t in x.texts) for x in nodes]
    children = [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        total[p] += total[i]
        links[p] += links[i]
        size[p] += size[i]
        commas[p] += commas[i]
        children[p] += 1
    page = max(1, total[0])
    depth, order, seen, bad, good, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    passed = own[0]
    for i in range(1, n):
        x, p = nodes[i], nodes[i].parent
        depth[i] = depth[p] + 1
        order[i] = seen[p]
        seen[p] += 1
        same[p, x.tag] = same.get((p, x.tag), 0) + 1
        bad[i] = bad[p] or (x.tag in _BAD_TAGS and not good[p]) or bool(x.groups - {9, 5, 8})
        good[i] = good[p] or x.tag in _GOOD_TAGS or 9 in x.groups
        before[i] = passed
        passed += own[i]
    rows = np.zeros((n, len(_TAG_KINDS) + len(TOKENS) + 17))
    for i, x in enumerate(nodes):
        p = x.parent
        row = rows[i]
        if x.tag in _TAG_KINDS:
            row[_TAG_KINDS.index(x.tag)] = 1
        for g in x.groups:
            row[len(_TAG_KINDS) + g] = 1
        row[len(_TAG_KINDS) + len(TOKENS):] = (
            depth[i], total[i], total[i] / size[i], links[i] / max(1, total[i]), total[i] / page, own[i], size[i], children[i],
            order[i], (children[p] if p >= 0 else 1), total[i] / max(1, total[p] if p >= 0 else page),
            same.get((p, x.tag), 1), before[i] / page, commas[i] / max(1, total[i]), bad[i], good[i],
            (_BLOCK[nodes[p].tag] if p >= 0 else -1))
    return rows


class BoostedTrees:
    """Gradient-boosted trees for a yes-or-no label: logistic loss, Newton leaves, splits between quantiles."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        mean = float(np.average(y, weights=weight))
        self.start = float(np.log(mean + 1e-6) - np.log(1 - mean + 1e-6))
        raw, self.trees = np.full(len(y), self.start), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            at = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                node = at - first
                best = np.full(width, 1e-3)
                gs, hs = (np.bincount(node, weights=v, minlength=width)[:, None] for v in (g, h))
                split_bin = np.full(width, BINS + 1)
                for f in range(x.shape[1]):
                    slot = node * (BINS + 1) + binned[:, f]
                    gl = np.bincount(slot, weights=g, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    hl = np.bincount(slot, weights=h, minlength=width * (BINS + 1)).reshape(width, -1).cumsum(1)
                    gain = gl**2 / (hl + 1) + (gs - gl)**2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < 2) | (hs - hl < 2)] = 0
                    to = gain.argmax(1)
                    value = gain[np.arange(width), to]
                    for k in np.flatnonzero(value > best):
                        if to[k] < len(self.cuts[f]):
                            best[k], split_bin[k] = value[k], to[k]
                            feature[first + k], cut[first + k] = f, self.cuts[f][to[k]]
                right = x[np.arange(len(y)), feature[at]] > cut[at]
                at = 2 * at + 1 + right
            leaf = at - (2**DEPTH - 1)
            value = -RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
            raw += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        raw, every = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[every, feature[at]] > cut[at])
            raw += value[at - (2**DEPTH - 1)]
        return raw


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[bool]:
    """The most likely choice of nodes under which a page is read from the root outside the main text, into it at most
    once on the way down, and out of it at most once: an ancestor and a descendant cannot contradict each other."""
    n = len(nodes)
    gain = np.clip(log_odds, -6, 6).tolist()
    outside, inside, cut = [0.0] * n, gain[:], [0.0] * n
    # Of a node in each state, the best sum over its subtree; being inside counts the log odds.
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        outside[p] += max(outside[i], inside[i])
        inside[p] += max(inside[i], cut[i])
        cut[p] += cut[i]
    state = ["o"] * n
    for i in range(1, n):
        above = state[nodes[i].parent]
        if above == "o":
            state[i] = "i" if inside[i] > outside[i] else "o"
        elif above == "i":
            state[i] = "i" if inside[i] >= cut[i] else "c"
        else:
            state[i] = "c"
    return [s == "i" for s in state]


def text_of(nodes: list[Node], chosen: list[bool]) -> str:
    return "\n".join(t for _, t in sorted(piece for x, ok in zip(nodes, chosen, strict=True) if ok for piece in x.texts))


def marked(nodes: list[Node]) -> list[bool]:
    """Labels of a page by its semantic elements: inside article or main, and in no other kind of element there."""
    out = [False] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        inside = out[x.parent] or x.tag in _GOOD_TAGS
        foreign = x.tag in {"nav", "aside", "footer", "form"} or bool(x.groups & {0, 1, 2, 3, 4, 6, 7})
        out[i] = inside and not foreign
    return out


def layout(rng: random.Random, prose: list[str], short: list[str], bare_body: bool = False) -> str:
    """A page of random layout with ``data-mark`` c on what is main text and x on what is not, made of given texts.
    With ``bare_body`` the main text stands in the body itself, in runs and in blocks."""
    names = {k: v.split() for k, v in TOKENS.items()}

    def attrs(*groups: str, mark: str, bare: float = 0.15) -> str:
        if rng.random() < bare:
            return f' data-mark="{mark}"'
        words = [rng.choice(names[g][:8] if g == "content" else names[g]) for g in groups]
        value = rng.choice(["-", " ", "_"]).join(rng.sample(words, len(words)))
        return f' {rng.choice(["class", "id", "class"])}="{value}" data-mark="{mark}"'

    def escape(t: str) -> str:
        return html.escape(t, quote=False)

    def paragraphs(n: int, mark: str) -> str:
        out = []
        for _ in range(n):
            t, kind = escape(rng.choice(prose)), rng.random()
            if kind < 0.05:
                out.append(f'<h2 data-mark="{mark}">{t[:50]}</h2>')
            elif kind < 0.10:
                items = "".join(f'<li data-mark="{mark}">{escape(rng.choice(prose))[:160]}</li>' for _ in range(rng.randint(2, 5)))
                out.append(f'<ul data-mark="{mark}">{items}</ul>')
            elif kind < 0.13:
                out.append(f'<blockquote data-mark="{mark}">{t}</blockquote>')
            elif kind < 0.16:
                cells = "".join(f'<td data-mark="{mark}">{escape(rng.choice(short))[:40]}</td>' for _ in range(3))
                out.append(f'<table data-mark="{mark}"><tr data-mark="{mark}">{cells}</tr></table>')
            else:
                t = t if rng.random() < 0.8 else t[:rng.randint(5, 60)]
                if rng.random() < 0.2:
                    t = f'<a href="/x">{t[:30]}</a>{t[30:]}'
                out.append(f'<p data-mark="{mark}">{t}</p>')
        return "".join(out)

    def menu() -> str:
        items = "".join(f'<li data-mark="x"><a href="/{i}">{escape(rng.choice(short))[:24]}</a></li>' for i in range(rng.randint(3, 9)))
        inner = f'<ul data-mark="x">{items}</ul>'
        return rng.choice([f'<nav{attrs("menu", mark="x", bare=0.6)}>{inner}</nav>', f'<div{attrs("menu", mark="x", bare=0)}>{inner}</div>',
                           f'<ul{attrs("menu", mark="x", bare=0.3)}>{items}</ul>'])

    def box(group: str, tags: list[str], least: int, most: int, bare_tag: bool = True) -> str:
        tag = rng.choice(tags)
        bare = 0.5 if bare_tag and tag not in ("div", "section") else 0.0
        body = paragraphs(rng.randint(least, most), "x") if rng.random() < 0.7 else f"{escape(rng.choice(prose))[:rng.randint(20, 200)]}"
        return f"<{tag}{attrs(group, mark='x', bare=bare)}>{body}</{tag}>"

    def boxes(n: int) -> str:
        kinds = [lambda: box("advert", ["div", "div", "aside", "section"], 1, 2), lambda: box("side", ["aside", "div", "section"], 1, 5),
                 lambda: box("notice", ["div", "section", "dialog"], 1, 2), lambda: box("comment", ["section", "div", "ol"], 1, 8, False),
                 lambda: box("form", ["form", "form", "div"], 1, 1), lambda: box("share", ["div"], 0, 1, False), menu]
        return "".join(rng.choice(kinds)() for _ in range(n))

    def run(text: str, mark: str) -> str:
        tag = rng.choice(["span", "font", "b", "my-text"])
        return f'<hr><{tag} data-mark="{mark}">{text}</{tag}><hr>'

    def content_run() -> str:
        lines = [escape(rng.choice(prose)) for _ in range(rng.choice([1, 1, 2, 4, 8]))]
        if rng.random() < 0.2:
            lines[0] = f'<a href="/x">{lines[0][:30]}</a>{lines[0][30:]}'
        return run(rng.choice(["<br>", "<br><br>", " "]).join(lines), "c")

    def other_run() -> str:
        names = [escape(rng.choice(short))[:24] for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            return run("&copy; " + names[0], "x")
        return run(rng.choice([" | ", " ", "<br>"]).join(f'<a href="/x">{t}</a>' for t in names), "x")

    if bare_body:
        n = rng.choice([1, 1, 2, 3, 6])
        parts = [content_run() if rng.random() < 0.8 else paragraphs(rng.randint(1, 3), "c") for _ in range(n)]
        if not any(p.startswith("<hr>") for p in parts):
            parts.append(content_run())
        if rng.random() < 0.4:
            parts.insert(0, f'<h1 data-mark="c">{escape(rng.choice(prose))[:60]}</h1>')
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), boxes(1))
        first, last = (rng.choice(["", "", other_run(), menu(), boxes(1)]) for _ in range(2))
        return first + "".join(parts) + last + rng.choice(["", other_run(), f'<footer data-mark="x">&copy; {escape(rng.choice(short))[:80]}</footer>'])

    head = rng.choice(["", f'<header{attrs("head", mark="x", bare=0.6)}>{"<h1 data-mark=x>" + escape(rng.choice(short))[:20] + "</h1>" if rng.random() < 0.5 else escape(rng.choice(short))[:30]}{menu() if rng.random() < 0.5 else ""}</header>'])
    title = rng.choice(["h1", "h1", "h2"])
    title = f'<{title} data-mark="c">{escape(rng.choice(prose))[:60]}</{title}>'
    if rng.random() < 0.25:
        title = f'<header data-mark="c">{title}</header>'
    n = rng.choice([1, 2, 3, 5, 8, 13, 25])
    cutpoint = rng.randint(0, n)
    body = title * (rng.random() < 0.85) + paragraphs(cutpoint, "c") + boxes(rng.choice([0, 0, 0, 1, 2])) + paragraphs(n - cutpoint, "c")
    body += boxes(rng.choice([0, 0, 1]))
    tag = rng.choice(["article", "article", "main", "div", "div", "section"])
    root = f'<{tag}{attrs("content", mark="c", bare=0.7 if tag in ("article", "main") else 0.1)}>{body}</{tag}>'
    for _ in range(rng.choice([0, 0, 1, 2])):
        root = f'<div{rng.choice(["", " class=wrap", " class=row", " id=container"])} data-mark="x">{boxes(rng.choice([0, 1]))}{root}{boxes(rng.choice([0, 0, 1]))}</div>'
    foot = f'<{"footer"}{attrs("foot", mark="x", bare=0.7)}>&copy; {escape(rng.choice(short))[:80]}</footer>'
    if rng.random() < 0.3:
        foot = box("foot", ["div", "footer"], 1, 2)
    return head + (menu() if rng.random() < 0.8 else "") + boxes(rng.choice([0, 1, 2])) + root + boxes(rng.choice([0, 1, 2])) + foot


def fit_trees(sample: list[str]) -> BoostedTrees:
    """Fits the trees on sampled pages, labelled by their semantic elements, and on layouts made of their texts."""
    rng = random.Random(11)
    parsed = [with_runs(parse_page(p)) for p in sample]
    prose = [t for x in parsed for node in x for _, t in node.texts if len(t) > 60]
    short = [t for x in parsed for node in x for _, t in node.texts if len(t) <= 60]
    prose, short = prose or short or ["text, and more text."], short or [t[:30] for t in prose] or ["text"]
    x, y, w = [], [], []

    def add(nodes: list[Node], labels: list[bool]) -> None:
        x.append(node_features(nodes)[1:])
        y.append(np.array(labels[1:], dtype=np.float64))
        w.append(np.full(len(nodes) - 1, 30.0 / (29 + len(nodes))))

    for nodes in parsed:
        if sum(n.tag in _GOOD_TAGS for n in nodes) == 1:
            add(nodes, marked(nodes))
    for _ in range(LAYOUTS):
        nodes = parse_page(layout(rng, prose, short))
        add(nodes, [n.mark == "c" for n in nodes])
    bare = random.Random(12)
    for _ in range(BARE_LAYOUTS):
        nodes = with_runs(parse_page(layout(bare, prose, short, bare_body=True)))
        add(nodes, [n.mark == "c" for n in nodes])
    return BoostedTrees().fit(np.concatenate(x), np.concatenate(y), np.concatenate(w))


def extract_main_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """Adds ``text``, the main text of each page, and ``n_chars``, its code points, to all columns of ``pages``.

    The project keeps no pages, so the operator is general. A page is parsed into its block elements; boosted trees give
    each the odds of belonging to the main text; the likeliest choice without contradictions between ancestors and descendants is read
    out. Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

    The trees are fitted on at most ``training_pages`` pages, drawn by a hash of ``id_col``, that have one article or main
    element, and on LAYOUTS and BARE_LAYOUTS pages of random layout made of their texts, whose labels are known. Each run of text outside all
    blocks is judged like a block. Reading covers all pages and whole texts.

    A null or empty page, or one without main text, gives an empty text. Scripts, styles, comments of the markup and what
    stands in controls are no text. Repeated rows are read alike; columns named like the results are replaced. An empty table gives an empty result.
    """
    rows = pages.drop("text", "n_chars")
    # The hashes alone find the sample, so that its pages, and no others, come to the driver.
    ranked = rows.where(F.length(html_col) > 0).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(html_col).alias("html"))
    last = ranked.select("h").orderBy("h").limit(training_pages).agg(F.max("h")).first()[0]
    drawn = [r["html"] for r in ranked.where(F.col("h") <= last).limit(training_pages).collect()] if last is not None else []
    shared = pages.sparkSession.sparkContext.broadcast(fit_trees(drawn))  # TREES small arrays
    names = rows.columns

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                parsed = [with_runs(parse_page(p or "")) for p in batch.column(html_col).to_pylist()]
                odds = shared.value.log_odds(np.concatenate([node_features(x) for x in parsed]))
                ends = np.cumsum([0, *[len(x) for x in parsed]])
                texts = [text_of(x, decode(x, odds[a:b])) for x, a, b in zip(parsed, ends, ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*names, "text", "n_chars"])

    schema = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(extract, schema)
