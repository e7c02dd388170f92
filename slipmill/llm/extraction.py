"""Main text of web pages by a graphical model over the DOM tree.

A page is read into a tree: elements are nodes, runs of text are leaves. Every node is content or not. Its own evidence (tag, tag of its parent, words of class, id
and role; for leaves length, links, last sign) and a potential between parent and child make a tree-structured log-linear model. Sum-product message passing, once
upward and once downward, gives exact marginals of all nodes; text leaves with a marginal of one half or more are the main text. Messages are passed for all pages of a
batch at once, level by level.

Training. The weights maximise the likelihood of labelled pages: any HTML whose elements carry ``data-main`` ("1" or "0", inherited by what is inside); the gradient is
observed minus expected counts, which the same messages give. ``labelled_pages`` writes such pages, with menus, headers, notices, adverts, sidebars, forms, comments and
footers under many names around and inside of articles; texts are invented, so that their words teach nothing. ``train`` takes any others.

Reading follows what browsers do where it matters: implied ends of paragraphs, items and cells, void elements, raw text (scripts, styles and what only they show is
dropped), comments, attributes with or without quotes, character references without semicolon. Blocks are what block elements part; ``<br>`` is white space.

Scale: no shuffle; a task holds one batch of pages and its nodes as arrays. Weights are a few hundred numbers.

Defined cases: null and empty pages, and pages without content, have the empty text; text that is cut off in the middle of a tag is dropped from the tag on; unclosed
elements end with their parents; scripts without an end reach to the end of the page; repeated rows are alike; other columns do not matter, whatever their names; an empty
table gives an empty result. White space is what ``str.split`` takes for it, no-break spaces included.
"""

from __future__ import annotations

import functools
import html
import random
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title svg".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Elements that an element of this name ends, and those beyond which it ends none.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption summary caption".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_RIGHTS = re.compile(r"©|\ball rights reserved\b|\bcopyright\b", re.I)
EDGES = 4  # kinds of child: leaf, paragraph, box, inline


@functools.lru_cache(maxsize=4096)
def signs(tag: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    """The evidence of an element by itself, and its label."""
    words, label = [], None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            value = html.unescape(value)
            words += [w.lower() for w in [*_NAME.findall(value), *value.replace("_", "-").split()]]
        elif name == "data-main":
            label = value
        elif name == "hidden":
            words.append("hidden")
    if "-" in tag:  # a name of the page's own
        words += [w.lower() for w in _NAME.findall(tag)]
    return (f"tag={tag}", *(f"word={w}" for w in dict.fromkeys(words))), label


class Tree:
    """Nodes of one page in page order: parent (-1 for the root), depth, kind of edge, evidence (numbers in ``of`` from ``starts``), labels; leaves with their texts
    and the block (line) that they stand in."""

    def __init__(self, page: str, number: dict[str, int], grow: bool = False):
        self.number, self.grow = number, grow
        self.parent, self.depth, self.edge, self.label = array("i"), array("i"), array("b"), array("b")
        self.starts, self.of = array("q", [0]), array("i")
        self.leaves: list[tuple[int, int, str]] = []
        self.read(page)

    def node(self, parent: int, edge: int, label: int, evidence: Sequence[str]) -> int:
        number = self.number
        for name in evidence:
            if (k := number.get(name)) is None and self.grow:
                k = number[name] = len(number)
            if k is not None:
                self.of.append(k)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.edge.append(edge)
        self.label.append(label)
        self.starts.append(len(self.of))
        return len(self.parent) - 1

    def read(self, page: str) -> None:
        root = self.node(-1, 2, 0, ("tag=root",))
        stack: list[tuple[str, int, bool]] = [("root", root, True)]  # name, node, whether it is a block
        line, links, text, linked, place = 0, 0, [], 0, 0

        def flush() -> None:
            nonlocal text, linked
            raw = html.unescape("".join(text)) if text else ""
            if raw and not raw.isspace():
                owner = stack[-1][1]
                self.leaves.append((self.node(owner, 0, self.label[owner], self.seen(raw, linked, stack)), line, raw))
            elif raw and self.leaves and self.leaves[-1][1] == line:
                node, _, before = self.leaves[-1]
                self.leaves[-1] = node, line, before + " "
            text, linked = [], 0

        def leave(upto: int) -> None:
            """Ends the elements from this place of the stack on."""
            nonlocal line, links
            if any(block or node != stack[k + upto - 1][1] for k, (_, node, block) in enumerate(stack[upto:])):
                flush()
            if any(block for _, _, block in stack[upto:]):
                line += 1
            links -= sum(name == "a" for name, _, _ in stack[upto:])
            del stack[upto:]

        def find(names: frozenset[str] | set[str], beyond: frozenset[str] | set[str], inline: bool = False) -> int | None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in beyond or inline and stack[k][2]:
                    return None
            return None

        while place < len(page):
            m = _TOKEN.search(page, place)
            if part := page[place : m.start() if m else len(page)]:
                text.append(part)
                if links:
                    linked += len(part)
            if m is None:
                break
            place = m.end()
            if not m[2]:
                continue
            tag, attributes = m[2].lower(), m[3]
            if not m[4]:  # cut off
                break
            if m[1]:
                if tag in ("br", "p") and find({tag}, set()) is None:
                    text.append(" ")
                elif (at := find({tag}, {"table"} if tag not in ("table", "div", "article", "section", "main", "body", "html") else set(), tag in INLINE)) is not None:
                    leave(at)
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                    line += 1
                else:
                    text.append(" " if tag == "br" else "")
                continue
            if tag in RAW:
                if attributes.endswith("/") and tag == "svg":
                    continue
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, place)
                place = end.end() if end else len(page)
                continue
            if tag in ENDS_P and (at := find({"p"}, {"table", "li", "td", "th", "div", "article", "section"})) is not None:
                leave(at)
            if tag in IMPLIED and (at := find(*IMPLIED[tag])) is not None:
                while (outer := find(IMPLIED[tag][0], IMPLIED[tag][1])) is not None:
                    at = outer
                    leave(at)
            block, (evidence, label) = tag not in INLINE, signs(tag, attributes)
            owner = stack[-1][1]
            if block:
                flush()
                line += 1
            elif len(evidence) > 1 or label:
                flush()
            if block or len(evidence) > 1 or label:
                above = next((name for name, _, b in reversed(stack) if b), "root")
                edge = (1 if tag in PARAGRAPHS else 2) if block else 3
                owner = self.node(owner, edge, int(label == "1") if label else self.label[owner], (*evidence, f"in={above}>{tag}"))
            if not (attributes.endswith("/") and tag not in INLINE and tag not in ENDS_P):
                stack.append((tag, owner, block))
                links += tag == "a"
        flush()

    def seen(self, raw: str, linked: int, stack: list[tuple[str, int, bool]]) -> list[str]:
        """The evidence of a text."""
        words, plain = len(raw.split(None, 30)), raw.rstrip()
        share = linked / len(raw)
        return ["leaf", "links=" + ("0" if not linked else "some" if share < 0.5 else "most"), "words=" + ("1" if words < 4 else "4" if words < 10 else "10" if words < 30 else "30"),
                "end" if plain[-1] in ".!?…:" else "no end", *(["rights"] if _RIGHTS.search(plain[:400]) else [])]


class Forest:
    """Trees side by side, as arrays, their nodes by depth."""

    def __init__(self, trees: Sequence[Tree]):
        sizes = [len(t.parent) for t in trees]
        first = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes) if trees else np.empty(0, np.int64)
        get = lambda name, kind: np.concatenate([np.frombuffer(getattr(t, name), kind) for t in trees]) if trees else np.empty(0, kind)
        self.parent, self.depth, self.edge, self.label = get("parent", np.int32) + first, get("depth", np.int32), get("edge", np.int8), get("label", np.int8)
        self.size = int(sum(sizes))
        counts = np.concatenate([np.diff(np.frombuffer(t.starts, np.int64)) for t in trees]) if trees else np.empty(0, np.int64)
        self.owner, self.of = np.repeat(np.arange(self.size), counts), get("of", np.int32)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if self.size else []

    def messages(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own evidence with all that comes from below, the messages upward, and the beliefs (unnormalised logarithms) of every node."""
        below = np.zeros((self.size, 2))
        below[:, 1] = np.bincount(self.owner, weights[self.of], self.size)
        up = np.zeros((self.size, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(edges[self.edge[level]] + below[level][:, None, :], axis=2)
            for y in (0, 1):
                np.add.at(below[:, y], self.parent[level], up[level, y])
        belief = below.copy()
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - up[level]
            belief[level] += np.logaddexp.reduce(edges[self.edge[level]] + above[:, :, None], axis=1)
        return below, up, belief

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The probability of each node to be content."""
        belief = self.messages(weights, edges)[2]
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))

    def gradient(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts of the weights' evidence and of the pairs of labels on edges."""
        below, up, belief = self.messages(weights, edges)
        one = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        own = np.bincount(self.of, (self.label - one)[self.owner], len(weights))
        child = np.flatnonzero(self.depth > 0)
        joint = (belief[self.parent[child]] - up[child])[:, :, None] + edges[self.edge[child]] + below[child][:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pairs = np.zeros_like(edges)
        np.add.at(pairs, (self.edge[child], self.label[self.parent[child]], self.label[child]), 1.0)
        np.add.at(pairs, self.edge[child], -joint)
        return own, pairs


class Model:
    """Numbers of the evidence that the labelled pages show, a weight of each, and the potentials of the edges."""

    def __init__(self, number: dict[str, int], weights: np.ndarray, edges: np.ndarray):
        self.number, self.weights, self.edges = number, weights, edges

    def leaves(self, pages: Sequence[str | None]) -> Iterator[list[tuple[int, str, float]]]:
        """For each page its leaves: line, text and marginal."""
        trees, held = [], 0
        for k, page in enumerate(pages):
            trees.append(Tree(page or "", self.number))
            held += len(trees[-1].parent)
            if held > 200_000 or k == len(pages) - 1:
                marginal, at = Forest(trees).marginals(self.weights, self.edges), 0
                for t in trees:
                    yield [(line, raw, float(marginal[at + node])) for node, line, raw in t.leaves]
                    at += len(t.parent)
                trees, held = [], 0


def main_text(leaves: Sequence[tuple[int, str, float]]) -> str:
    """The content leaves: white space of each block made one space, blocks joined by a line feed."""
    lines: dict[int, list[str]] = {}
    for line, raw, marginal in leaves:
        if marginal >= 0.5:
            lines.setdefault(line, []).append(raw)
    return "\n".join(t for parts in lines.values() if (t := " ".join("".join(parts).split())))


def train(pages: Sequence[str], rounds: int = 120, decay: float = 0.005) -> Model:
    """A model of labelled pages (elements with data-main), by resilient steps along the exact gradient. The pages are held on the driver: a bounded number."""
    number: dict[str, int] = {}
    forest = Forest([Tree(p, number, grow=True) for p in pages])
    size = len(number)
    at, step, before = np.zeros(size + 4 * EDGES), np.full(size + 4 * EDGES, 0.1), np.zeros(size + 4 * EDGES)
    for _ in range(rounds):
        own, pairs = forest.gradient(at[:size], at[size:].reshape(EDGES, 2, 2))
        slope = np.concatenate([own, pairs.ravel()]) - decay * max(1, len(pages)) * at / 10
        turned = np.sign(slope) * np.sign(before)
        step = np.clip(step * np.where(turned > 0, 1.2, np.where(turned < 0, 0.5, 1.0)), 1e-6, 1.0)
        before = np.where(turned < 0, 0.0, slope)
        at = at + np.sign(before) * step
    return Model(number, at[:size], at[size:].reshape(EDGES, 2, 2))


# Usual names of the parts of pages, by kind.
NAMES = {
    "menu": "nav navbar navigation menu main-menu top-nav topbar breadcrumb breadcrumbs pagination pager tabs toc-menu".split(),
    "header": "header site-header page-header masthead banner brand logo top".split(),
    "notice": "cookie cookie-notice cookie-banner cookies consent gdpr notice alert privacy-notice popup modal overlay paywall disclaimer".split(),
    "advert": "ad ads advert adverts advertisement ad-slot ad-box adsbygoogle sponsored sponsor promo promotion commercial banner-ad".split(),
    "sidebar": "sidebar side aside widget widgets related related-posts recommended recommendations popular trending more-stories read-next teaser".split(),
    "form": "search search-form newsletter subscribe signup sign-up login register contact-form form feedback".split(),
    "comments": "comments comment comment-list user-comments replies reply discussion disqus responses reviews".split(),
    "footer": "footer site-footer page-footer bottom copyright legal colophon".split(),
    "extra": "share sharing social social-links tags tag-list meta byline author author-box timestamp tools print rating hidden skip-link".split(),
}
MAIN = "content main-content article article-body post post-body post-content entry entry-content story story-body text body-text main page-content".split()
BOXES = "wrapper container row col page layout grid inner outer wrap site".split()


def labelled_pages(count: int = 400, seed: int = 12) -> list[str]:
    """Pages of invented words with data-main marks: what surrounds an article, under its usual names, and articles of all kinds of blocks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñßжא日") for _ in range(rng.randrange(1, 11)))
    link = lambda n: " ".join(f'<a href="/{word()}">{text(n)}</a>' for _ in range(rng.randrange(1, 4)))

    def text(n: int) -> str:
        words = [word() if rng.random() < 0.96 else rng.choice(["42", "#", "&amp;", "--", "x=1;", "a@b.c", "&copy;"]) for _ in range(max(1, rng.randrange(n + 1)))]
        return " ".join(words).capitalize() + rng.choice([".", ".", ".", "", "!", "?", "…", ":", ","])

    def named(kind: str, tags: Sequence[str], inside: str) -> str:
        tag = rng.choice(tags)
        tag = "div" if tag in ("p", "span") and re.search("<(p|div|h3|ul)>", inside) else tag
        bare = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6
        return f'<{tag}{"" if bare else name(NAMES[kind])} data-main="0">{inside}</{tag}>'

    def name(names: Sequence[str]) -> str:
        one = rng.choice(names)
        one = rng.choice([one, one, one.replace("-", "_"), f"{rng.choice(BOXES)} {one}", f"x{rng.randrange(99)} {one}", "".join(w.capitalize() for w in one.split("-"))])
        return f' {rng.choice(["class", "class", "id"])}="{one}"'

    def some(kind: str) -> str:
        paragraphs = lambda n: "".join(f"<p>{text(n)}</p>" for _ in range(rng.randrange(1, 4)))
        items = lambda n: f"<ul>{''.join(f'<li>{link(n)}</li>' for _ in range(rng.randrange(2, 7)))}</ul>"
        mixed = lambda n: rng.choice([text(n), paragraphs(n), f"<div>{text(n)}</div>", f"<h3>{text(5)}</h3>{paragraphs(n)}", f"<span>{text(n)}</span>"])
        if kind == "menu":
            return named(kind, ["nav", "nav", "div", "ul"], rng.choice([items(2), link(2), items(1)]))
        if kind == "header":
            return named(kind, ["header", "header", "div"], rng.choice([f"<h1>{text(3)}</h1>", f"<p>{text(6)}</p>", link(2), text(5), f"<h1>{link(2)}</h1><p>{text(8)}</p>"]))
        if kind == "sidebar":
            return named(kind, ["aside", "aside", "div", "section"], rng.choice([items(6), f"<h3>{text(4)}</h3>{items(8)}", mixed(30)]))
        if kind == "form":
            field = f'<label>{text(3)}</label><input name="q"><button>{text(2)}</button>'
            return named(kind, ["form", "form", "div"], rng.choice([field, f"<p>{text(15)}</p>{field}", f"<select><option>{text(1)}<option>{text(1)}</select>{field}"]))
        if kind == "comments":
            one = lambda: rng.choice([f"<p>{text(40)}</p>", f'<div{name(["comment", "reply", "comment-body"])}><b>{text(2)}</b><p>{text(50)}</p></div>', f"<li>{text(30)}</li>"])
            return named(kind, ["div", "section", "section", "ol"], rng.choice(["", f"<h2>{text(3)}</h2>"]) + "".join(one() for _ in range(rng.randrange(1, 5))))
        if kind == "footer":
            return named(kind, ["footer", "footer", "div"], rng.choice([f"&copy; {text(12)}", f"<p>{text(20)}</p>{link(2)}", f"{link(1)} &middot; {text(6)}", mixed(25)]))
        if kind == "extra":
            return named(kind, ["div", "p", "ul", "span"], rng.choice([link(2), text(6), text(3)]))
        return named(kind, ["div", "div", "section", "p", "ins"] if kind == "advert" else ["div", "div", "section", "p"], mixed(30))

    def block() -> str:
        tag = rng.choice(["p"] * 12 + ["h2", "h3", "ul", "ol", "blockquote", "pre", "table", "figure", "div", "dl"])
        n = rng.choice([1, 3, 8, 20, 60])
        if tag in ("ul", "ol"):
            return f"<{tag}>{''.join(f'<li>{text(n)}' + rng.choice(['', '</li>']) for _ in range(rng.randrange(1, 5)))}</{tag}>"
        if tag == "table":
            return f"<table>{''.join(f'<tr><td>{text(3)}<td>{text(n)}</tr>' for _ in range(rng.randrange(1, 4)))}</table>"
        if tag == "figure":
            return f'<figure><img src="x"><figcaption>{text(n)}</figcaption></figure>'
        if tag == "dl":
            return f"<dl><dt>{text(2)}<dd>{text(n)}</dl>"
        if tag == "p" and rng.random() < 0.3:
            return rng.choice([f"<p><b>{text(n)}<br>", f"<p>{text(n)} {link(3)} {text(n)}</p>", f"<p>{link(4)}</p>", f"<p><em>{text(n)}</em></p>", f"<p><span>{text(n)}</span> {text(n)}"])
        return f"<{tag}>{text(n)}</{tag}>"

    kinds = [k for k in NAMES if k != "extra"]
    pages = []
    for _ in range(count):
        inner = [block() for _ in range(rng.choice([0, 1, 1, 3, 6, 12]))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            inner.insert(rng.randrange(len(inner) + 1), some(rng.choice(["advert", "sidebar", "form", "comments", "extra", "extra", "notice", "menu"])))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):  # boxes in the article that mean nothing
            low = rng.randrange(len(inner) + 1)
            high = rng.randrange(low, len(inner) + 1)
            inner[low:high] = [f"<div{rng.choice(['', '', name(BOXES)])}>{''.join(inner[low:high])}</div>"]
        title = f"<h1>{text(12)}</h1>"
        title = rng.choice([title, title, f"<header>{title}</header>", f'<header>{title}{some("extra")}</header>', ""])
        article = title + "".join(inner) + (some("footer") if rng.random() < 0.1 else "")
        how = rng.random()
        if how < 0.5:
            article = f'<article{rng.choice(["", "", name(MAIN)])} data-main="1">{article}</article>'
        elif how < 0.65:
            article = f'<main{rng.choice(["", name(MAIN)])} data-main="1">{rng.choice([article, f"<article>{article}</article>"])}</main>'
        elif how < 0.84:
            article = f'<{(tag := rng.choice(["div", "div", "section"]))}{rng.choice([name(MAIN), name(MAIN), " role=main", " itemprop=articleBody"])} data-main="1">{article}</{tag}>'
        else:  # nothing names the article; what it stands in counts as content
            article = f"<h1>{text(8)}</h1>" + "".join(f"<p>{text(60)}</p>" for _ in range(rng.randrange(2, 9)))
        around = [some(k) for k in ("menu", "header", "notice", "advert") if rng.random() < 0.6], [some(k) for k in rng.sample(kinds, 3) if rng.random() < 0.7] + [some("footer")] * (rng.random() < 0.8)
        body = "".join(around[0]) + article + "".join(around[1])
        main = " data-main=1" * (how >= 0.84)
        for _ in range(rng.choice([0, 0, 1, 2])):
            body, main = f"<div{rng.choice(['', name(BOXES)])}{main or ' data-main=0'}>{body}</div>", ""
        pages.append(f"<!DOCTYPE html><html><head><title>{text(5)}</title><style>p{{margin:0}}</style></head><body{main}>{body}" + rng.choice(["</body></html>", ""]))
    return pages


@functools.cache
def default_model() -> Model:
    """The model of labelled_pages()."""
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text (main text), n_chars (its code points), kept and dropped (numbers of text leaves) of every row of pages (page_id, url, html)."""
    model = model or default_model()
    rows = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = list(shared.value.leaves(part.column(2).to_pylist()))
                texts = [main_text(leaves) for leaves in found]
                kept = [sum(m >= 0.5 for _, _, m in leaves) for leaves in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(kept, pa.int64()),
                                                  pa.array([len(leaves) - k for leaves, k in zip(found, kept, strict=True)], pa.int64())], names=["page_id", "url", "text", "n_chars", "kept", "dropped"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, kept long, dropped long")


def leaves(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, line (block, from 0), text and marginal of every text leaf of pages, content or not."""
    model = model or default_model()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [(i, *leaf) for i, found in zip(part.column(0).to_pylist(), shared.value.leaves(part.column(1).to_pylist()), strict=True) for leaf in found]
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (part.column(0).type, pa.int32(), pa.string(), pa.float64()), strict=True)], names=["page_id", "line", "text", "marginal"])

    rows = pages.select("page_id", F.col("html"))
    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, line int, text string, marginal double")
