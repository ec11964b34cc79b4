"""Main text of web pages by a tree-structured graphical model.

Every element and every run of text of a page is a node that is content or not. A node has a
potential from its features, and each parent-child edge one from the two labels. Sum-product
messages go up and then down the tree; a run whose content marginal is at least a half is
part of the text. The weights are fitted by gradient ascent on the exact likelihood of
labelled pages, which ``training_pages`` builds from random layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags whose text flows on in the block around them; fixed values of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr object canvas audio video "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup "
    "msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page; without a closing tag, that of the first ones goes on to the end.
RAW_TEXT = frozenset("script style textarea title iframe".split())
RAW = RAW_TEXT | frozenset("template svg annotation annotation-xml".split())
#: An element that begins closes an open one of these, if that is the innermost block.
CLOSES = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"),
    "th": ("td", "th", "p"), "option": ("option",),
}
TAGS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 nav header footer aside form fieldset button select option label input ul ol li "
    "dl dt dd table tr td th blockquote pre figure figcaption details summary address dialog menu noscript".split()
)
#: Words in class, id and role that tell what an element is for.
HINTS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navigation menu navbar breadcrumb breadcrumbs sidebar side widget footer header "
    "masthead copyright cookie consent gdpr notice alert popup modal overlay subscribe newsletter signup login search form comment comments reply "
    "replies responses respond discussion discussions disqus thread threads reactions feedback talkback guestbook opinions share sharing social related recommended more pagination pager tags toolbar skip hidden article content main post "
    "entry story body text page article-body prose complementary contentinfo".split()
)
#: Those of readers' comments, which also count together.
TALK = frozenset("comment comments reply replies responses respond discussion discussions disqus thread threads reactions feedback talkback guestbook opinions".split())
#: Features of elements that frame an article.
FRAMES = frozenset("tag:article tag:main hint:article hint:content hint:main hint:post hint:entry hint:story hint:prose hint:article-body".split())
#: Features of elements that hold no article, whatever the model makes of a page.
FURNITURE = frozenset(f"tag:{t}" for t in "nav header footer aside form fieldset button select option label input menu dialog noscript".split()) | {f"hint:{h}" for h in HINTS} - FRAMES - {"hint:text", "hint:body", "hint:page"}
#: Features of runs that are no text of an article.
FOREIGN = frozenset(("link:2", "free:link:2", "mark:copyright", "free:mark:copyright"))
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>", re.S
)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>" + (r"|\Z" if t in RAW_TEXT else ""), re.I) for t in RAW}
ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Node:
    parent: int
    features: tuple[str, ...]
    text: str | None = None  # of a run
    label: int = 0
    kind: int = 0  # 1 for a run, 2 more on a page where no element says that it is the article


@dataclass
class Weights:
    unary: dict[str, float] = field(default_factory=dict)
    #: log potentials [kind of the child][parent label][child label]
    edge: list[list[list[float]]] = field(default_factory=lambda: [[[0.0, 0.0], [0.0, 0.0]] for _ in range(4)])


_element_memo: dict[tuple[str, str], tuple[str, ...]] = {}


def element_features(tag: str, attrs: str) -> tuple[str, ...]:
    key = (tag, attrs)
    found = _element_memo.get(key)
    if found is None:
        out = {"tag:" + (tag if tag in TAGS else "other")}
        for name, a, b, c in ATTR.findall(attrs):
            value = (a or b or c).lower()
            if name.lower() in ("class", "id", "role"):
                words = SPLIT.split(value)
                out |= {"hint:" + w for w in words if w in HINTS}
                if not TALK.isdisjoint(words):
                    out.add("talk")
            elif name.lower() == "style" and "none" in value or name.lower() == "aria-hidden" and value == "true":
                out.add("hint:hidden")
        if len(_element_memo) > 20_000:
            _element_memo.clear()
        found = _element_memo[key] = tuple(sorted(out))
    return found


def run_features(text: str, linked: int, tag: str) -> tuple[str, ...]:
    """linked: characters inside links; tag: of the element around."""
    n = text.count(" ") + 1
    size = "size:" + ("1" if n < 3 else "2" if n < 10 else "3" if n < 30 else "4")
    share = linked / max(1, len(text))
    link = "link:" + ("0" if share < 0.1 else "1" if share < 0.5 else "2")
    out = ["run", size, link, "in:" + (tag if tag in TAGS else "other")]
    if "©" in text:
        out.append("mark:copyright")
    return tuple(out)


#: In labelled pages alone: what stands between these is content, without an element of its own.
KEEP, KEPT = "<!--keep-->", "<!--/keep-->"


def parse(source: str, labelled: bool = False) -> list[Node]:
    """Nodes in page order, parents first; runs have their text with references decoded and white space collapsed."""
    nodes = [Node(-1, ("root",))]
    stack: list[tuple[str, int]] = [("", 0)]
    parts: list[str] = []
    linked, in_link = 0, False
    kept = 0
    unclosed: set[str] = set()  # no closing tag follows

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                nodes.append(Node(stack[-1][1], run_features(text, linked, stack[-1][0]), text, kept or nodes[stack[-1][1]].label))
            parts.clear()
        linked = 0

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(source[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if labelled and m[0] in (KEEP, KEPT):
                flush()
                kept = int(m[0] == KEEP)
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m["end"] and not m["attrs"].endswith("/") and tag not in unclosed:
                close = RAW_END[tag].search(source, at)
                if close:
                    at = close.end()
                else:
                    unclosed.add(tag)
            continue
        if tag in INLINE:
            if tag in ("br", "mtd"):
                parts.append(" ")
            elif tag == "a":
                in_link = not m["end"]
            continue
        flush()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    in_link = False
                    break
            continue
        if stack[-1][0] == "p" and tag not in CLOSES:
            stack.pop()
        else:
            while stack[-1][0] in CLOSES.get(tag, ()):
                stack.pop()
        up = stack[-1][1]
        label = kept or nodes[up].label
        if (k := m["attrs"].find("data-keep=")) >= 0:  # of labelled pages alone
            label = int(m["attrs"][k + 11])
        nodes.append(Node(up, element_features(tag, m["attrs"]), None, label))
        if tag not in VOID and not m["attrs"].endswith("/"):
            stack.append((tag, len(nodes) - 1))
    flush()
    for x in nodes:
        x.kind = int(x.text is not None)
    if not any(f in FRAMES for x in nodes for f in x.features):
        # where blocks lie and how long their text is tells more here: runs have features of their own
        tags = [next((f for f in x.features if f.startswith("tag:")), "") + "+" * (len(x.features) > 1) for x in nodes]
        for i, x in enumerate(nodes):
            x.kind += 2
            if x.text is None:
                x.features = (*x.features, f"free:{tags[i]}<{tags[x.parent]}")
            else:  # in order: run, size, link, in, ...
                x.features = (*[f"free:{f}" for f in x.features], f"free:run<{tags[x.parent]}", f"free:{x.features[1]}|{x.features[2]}")
    return nodes


def _clip(x: float) -> float:
    return 30.0 if x > 30 else -30.0 if x < -30 else x


def marginals(nodes: list[Node], w: Weights) -> tuple[list[float], list[float], list[float]]:
    """Per node: log odds of being content, and the two messages on the edge to its parent (up, down)."""
    unary, exp, log = w.unary, math.exp, math.log
    n = len(nodes)
    belief = [sum([unary.get(f, 0.0) for f in x.features]) for x in nodes]
    up, down = [0.0] * n, [0.0] * n
    tables = [[[exp(v) for v in row] for row in t] for t in w.edge]
    for i in range(n - 1, 0, -1):
        (a00, a01), (a10, a11) = tables[nodes[i].kind]
        e = exp(_clip(belief[i]))
        up[i] = m = log((a10 + a11 * e) / (a00 + a01 * e))
        belief[nodes[i].parent] += m
    for i in range(1, n):
        (a00, a01), (a10, a11) = tables[nodes[i].kind]
        e = exp(_clip(belief[nodes[i].parent] - up[i]))
        down[i] = m = log((a01 + a11 * e) / (a00 + a10 * e))
        belief[i] += m
    return belief, up, down


def extract(source: str | None, w: Weights) -> str:
    if not source:
        return ""
    nodes = parse(source)
    belief, _, _ = marginals(nodes, w)
    kept = [x.text for x, b in zip(nodes, belief, strict=True) if x.text is not None and b >= 0]
    return " ".join(kept or unplaced(nodes))


def unplaced(nodes: list[Node]) -> list[str]:
    """Of a page that the model places nowhere: the runs outside page furniture that are not mostly links."""
    inside = [False] * len(nodes)
    for i, x in enumerate(nodes):
        inside[i] = (x.parent >= 0 and inside[x.parent]) or (x.text is None and not FURNITURE.isdisjoint(x.features))
    return [x.text for i, x in enumerate(nodes) if x.text is not None and not inside[i] and FOREIGN.isdisjoint(x.features)]


def train(pages: list[str], rounds: int = 24, rate: float = 0.15, decay: float = 1e-5) -> Weights:
    """Weights by stochastic ascent on the log likelihood, whose gradient is labels minus marginals."""
    w = Weights()
    trees = [parse(p, labelled=True) for p in pages]
    for step in range(rounds):
        pace = rate / (1 + step / 4)
        for nodes in trees:
            belief, up, down = marginals(nodes, w)
            for x, b in zip(nodes, belief, strict=True):
                d = pace * (x.label - 1 / (1 + math.exp(-_clip(b))))
                for f in x.features:
                    v = w.unary.get(f, 0.0)
                    w.unary[f] = v + d - pace * decay * v
            grads = [[[0.0, 0.0], [0.0, 0.0]] for _ in w.edge]
            for i in range(1, len(nodes)):
                x, kind = nodes[i], nodes[i].kind
                p, c = _clip(belief[x.parent] - up[i]), _clip(belief[i] - down[i])
                t = [[math.exp(w.edge[kind][a][b] + a * p + b * c) for b in (0, 1)] for a in (0, 1)]
                z = sum(map(sum, t))
                for a in (0, 1):
                    for b in (0, 1):
                        grads[kind][a][b] += (nodes[x.parent].label == a and x.label == b) - t[a][b] / z
            for kind in {x.kind for x in nodes}:
                for a in (0, 1):
                    for b in (0, 1):
                        w.edge[kind][a][b] = max(-4.0, min(4.0, w.edge[kind][a][b] + 0.3 * pace * grads[kind][a][b]))
    return w


#: One labelled page in so many has no element that says that it is the article.
LOOSE = 5


def _words(r: random.Random, least: int, most: int) -> str:
    n = r.randint(least, most)
    return " ".join("".join(r.choice("bcdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + r.choice([".", ".", "", "!"])


def training_pages(n: int, seed: int = 7) -> list[str]:
    """Labelled pages of random layout; ``data-keep`` holds the label of an element and of what is below it."""
    r = random.Random(seed)

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{_words(r, 1, 3)}</a></li>' for i in range(r.randint(2, k))) + "</ul>"

    def p(least: int = 1, most: int = 60) -> str:
        body = _words(r, least, most)
        return r.choice([f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br><p>{_words(r, 1, 50)}</p>", f"<p>{body} <a href=x>{_words(r, 1, 3)}</a> {body}</p>"])

    def article_parts() -> list[str]:
        kinds = [lambda: f"<ul><li>{_words(r, 2, 20)}</li><li>{_words(r, 1, 20)}</li></ul>", lambda: f"<blockquote>{p()}</blockquote>",
                 lambda: f"<pre>{_words(r, 2, 20)}</pre>", lambda: f"<h2>{_words(r, 1, 6)}</h2>", lambda: f"<table><tr><td>{_words(r, 1, 5)}</td><td>{_words(r, 1, 5)}</td></tr></table>",
                 lambda: f"<figure><figcaption>{_words(r, 2, 9)}</figcaption></figure>", lambda: f"<div>{_words(r, 3, 40)}</div>", lambda: f"<section>{p()}{p()}</section>",
                 lambda: f'<div data-keep="0" class="{r.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{_words(r, 1, 30)}</div>',
                 lambda: f'<aside data-keep="0">{_words(r, 2, 30)}</aside>', lambda: f'<form data-keep="0"><label>{_words(r, 1, 3)}</label><input name=q><button>{_words(r, 1, 2)}</button></form>',
                 lambda: f'<div data-keep="0" class="{r.choice(["share", "social", "related", "tags", "newsletter"])}">{links(4)}</div>', replies]
        return [p() if r.random() < 0.75 else r.choice(kinds)() for _ in range(r.randint(1, 9))]

    def replies() -> str:
        outer, inner = r.choice([("ul", "li"), ("ol", "li"), ("div", "div"), ("section", "p")])
        said = "".join(f"<{inner}>{r.choice(['{}', '<p>{}</p>', '<b>Ann</b> {}']).format(_words(r, 2, 40))}</{inner}>" for _ in range(r.randint(1, 4)))
        return f'<{outer} data-keep="0" class="{r.choice(["replies", "comments", "responses", "comment-list", "discussion", "reader-comments"])}">{said}</{outer}>'

    def bare(parts: list[str]) -> str:
        """Parts of an article with nothing around them; each is labelled by itself."""
        return "".join(x if "data-keep" in x else re.sub(r"<(p|h[1-6]|ul|blockquote|pre|table|figure|div|section)(?=[ >])", r'<\1 data-keep="1"', x) for x in parts)

    def junk() -> str:
        cls = lambda *xs: r.choice(["class", "id"]) + f'="{r.choice(xs)}"'
        text = _words(r, 1, 40)
        inner = r.choice([text, f"<p>{text}</p>", links(6), f"<h3>{_words(r, 1, 4)}</h3><p>{text}</p>"])
        kinds = [f"<nav>{links(8)}</nav>", f"<header>{r.choice([inner, f'<h1>{_words(r, 1, 5)}</h1>'])}</header>", f"<footer>{inner}</footer>", f"<footer>&copy; {text}</footer>", f"<aside>{inner}</aside>",
                 f'<div {cls("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo")}>{inner}</div>',
                 f'<div {cls("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager", "skip")}>{r.choice([links(8), text])}</div>',
                 f'<div {cls("sidebar", "side", "widget", "related", "recommended", "more", "tags", "share", "social", "sharing")}>{inner}</div>',
                 f'<div {cls("cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "cookie-notice")}>{inner}<button>{_words(r, 1, 2)}</button></div>',
                 f'<div {cls("footer", "copyright", "header", "masthead", "site-footer", "site-header")}>{inner}</div>',
                 f'<div role="{r.choice(["navigation", "complementary", "contentinfo", "search", "banner"])}">{inner}</div>',
                 f'<section {cls("comments", "comment", "discussion", "respond", "disqus", "comment-list")}><h2>{_words(r, 1, 3)}</h2>' + "".join(f'<{t} class="comment"><p>{_words(r, 2, 50)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] * r.randint(1, 4)) + "</section>",
                 f'<form {cls("search", "login", "signup", "subscribe", "newsletter", "form")}><label>{_words(r, 1, 4)}</label><input name=q><select><option>{_words(r, 1, 2)}<option>{_words(r, 1, 2)}</select><button>{_words(r, 1, 2)}</button><p>{_words(r, 1, 20)}</p></form>',
                 f'<div style="display:none">{inner}</div>', f"<noscript>{r.choice([text, f'<p>{text}</p>'])}</noscript>", f"<menu>{links(4)}</menu>", f"<dialog>{inner}</dialog>"]
        return r.choice(kinds)

    def loose() -> str:
        """An article with no element that says so: text between line breaks, in plain divs, in the cells of a layout table."""
        text = lambda: _words(r, 8, 70)
        runs = lambda: KEEP + r.choice(["<br><br>", "<br>", " "]).join(text() for _ in range(r.randint(1, 6))) + KEPT
        title = r.choice(["", f'<h1 data-keep="1">{_words(r, 1, 8)}</h1>', f'<h2 data-keep="1">{_words(r, 1, 8)}</h2>'])
        menu = " ".join(f"<a href=/{i}>{_words(r, 1, 2)}</a>" for i in range(r.randint(2, 7)))
        ps = "".join(f'<p data-keep="1">{text()}</p>' for _ in range(r.randint(1, 5)))
        cell = r.choice([runs(), ps, f'<div data-keep="1">{text()}</div>'])
        kinds = [
            title + runs(), f"<div>{title}{runs()}</div>", f'{title}<div data-keep="1">{text()}</div>', "".join(f'<div data-keep="1">{text()}</div>' for _ in range(r.randint(2, 5))),
            f"<center>{title}<font size=2>{runs()}</font></center>", f"<div><div>{title}{runs()}</div></div>", f'<div data-keep="1">{text()}<p>{text()}</p>{text()}</div>',
            f"<table><tr><td>{r.choice([menu, links(6)])}</td><td>{title}{cell}</td></tr></table>", f"<table><tr><td colspan=2>{menu}</td></tr><tr><td>{links(6)}</td><td>{title}{cell}</td></tr><tr><td>&copy; {_words(r, 1, 4)}</td></tr></table>",
            f"<div>{menu}</div>{title}{cell}",
        ]
        return r.choice(kinds)

    out = []
    for i in range(n):
        if i % LOOSE == 0:
            around = lambda: "".join(junk() for _ in range(r.choice([0, 0, 1, 2])))
            page = r.choice(["<html><body>{}{}{}</body></html>", "<body>{}{}{}", "{}{}{}"]).format(around(), loose(), around())
            out.append(page)
            continue
        parts = [f"<p>{_words(r, 1, 4)}</p>" for _ in range(r.randint(10, 60))] if r.random() < 0.1 else article_parts()
        if r.random() < 0.25:
            parts.append(replies())
        head = r.choice([f"<h1>{_words(r, 1, 12)}</h1>", f"<header><h1>{_words(r, 1, 12)}</h1></header>", ""]) + "".join(parts)
        cls = f'{r.choice(["class", "id"])}="{r.choice(["content", "article", "post", "entry", "main", "story", "article-body", "text", "post-body", "prose", "main-content"])}"'
        body = r.choice([f'<article data-keep="1">{head}</article>', f'<article data-keep="1">{head}</article>', f'<main data-keep="1"><article>{head}</article></main>', f'<main data-keep="1">{head}</main>',
                         f'<div data-keep="1" {cls}>{head}</div>', f'<div><div data-keep="1" {cls}>{head}</div></div>', f'<main data-keep="1"><div {cls}>{head}</div></main>',
                         bare([f"<h1>{_words(r, 1, 12)}</h1>", *parts]), f"<div>{bare(parts)}</div>"])
        before, after = ("".join(junk() for _ in range(r.randint(0, 4))) for _ in range(2))
        title = f"<head><meta charset=utf-8><title>{_words(r, 1, 5)}</title><style>p{{}}</style></head>"
        out.append(f"<!DOCTYPE html><html>{title}<body>{before}<!-- x -->{r.choice([body, body, f'<div id=wrap>{body}{junk()}</div>'])}{after}{r.choice(['</body></html>', ''])}")
    return out


#: Labelled pages that the model is fitted to.
TRAINING_PAGES = 480
_fitted: list[Weights] = []


def fitted() -> Weights:
    """The trained weights, fitted once per driver process (a few seconds)."""
    if not _fitted:
        _fitted.append(train(training_pages(TRAINING_PAGES)))
    return _fitted[0]


def main_text(pages: DataFrame, html_col: str = "html", to: str = "text", weights: Weights | None = None) -> DataFrame:
    """``pages`` with column ``to``: the main text of html_col.

    Null or empty html: empty text. Repeated rows and rows without ids are pages like
    others. An empty table gives an empty one. A column already named ``to`` is replaced.
    """
    w = weights or fitted()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(x, w) for x in batch], dtype=object)

    return pages.withColumn(to, F.pandas_udf(run, "string")(F.col(html_col)))
