"""Main text of web pages: boosted trees over DOM-node features, decoded hierarchically.

A lenient parser builds the tree of block elements (inline ones belong to the block around them; scripts,
styles, comments, the head and other unseen elements are no nodes).  Each node has features of its own tag and
attribute tokens, of its ancestors', of its subtree (text, share of link text, text per tag, paragraphs,
punctuation), depth and siblings.  Gradient-boosted trees, trained on pages that a seeded generator builds
with known parts (``training_pages``, and ``plain_pages`` of little structure), give each node a probability of three states:

    pass   the node holds main text and other things, or can't be told
    main   the node and what is below it is main text, but for parts that are cut out
    other  the node and all below it is boilerplate

Decoding takes the best labelling of the whole tree under pass -> pass, main, other; main -> main, other;
other -> other: nothing is main below boilerplate, and main text isn't undecided again.  The text directly in
a main node is a block of output.

Character references are decoded piece by piece, so signs on either side of a tag never make one.  White space
is what Python's ``str.split`` takes for it, no-break and ideographic spaces included.

Null and empty html gives an empty text.  Each page is handled by itself, so ties, repeated rows and further
columns make no difference; nothing is cut or capped.  An unclosed script, style, textarea, title or iframe hides
what follows, as in browsers; other unclosed elements hide nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosting
from .common import batch, blocks, need, on_workers

PASS, MAIN, OTHER = range(3)

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input center picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg iframe head title object canvas math audio video select textarea button map".split())
#: Of these, what an unclosed one hides up to the end; an unclosed one of the others hides nothing.
RAW = frozenset("script style textarea title iframe".split())
#: What an opening tag closes, if it is open in the nearest scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol dl table tbody thead tfoot div section article main body html nav aside header footer blockquote form figure".split())
#: Elements whose end tag closes blocks inside them; a stray inline end tag closes nothing.
#: A quote opens a value only where a value begins; one that never closes is a sign like any other.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

GROUPS = {
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager pages toc tabs toolbar skip sitemap links topbar",
    "head": "header masthead banner branding logo site hero top",
    "foot": "footer foot copyright legal colophon bottom imprint credits",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more popular trending tags archive archives also",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted dfp adsense outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice notices notification popup modal overlay alert newsletter subscribe signup paywall disclaimer banner",
    "talk": "comment comments reply replies respond discussion disqus thread feedback reviews",
    "share": "share sharing social follow buttons facebook twitter print byline meta author",
    "form": "form login search signin register contact",
    "main": "article content main post entry story text hentry body page single prose",
}
WORDS = {w: k for k, (_, own) in enumerate(GROUPS.items()) for w in own.split()}
TAGS = {t: k for k, own in enumerate(("html body", "nav menu", "header", "footer", "aside", "form fieldset", "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tr td th", "blockquote pre figure figcaption", "dialog")) for t in own.split()}
N_TAGS, N_GROUPS = 17, len(GROUPS)


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "parts", "flags", "hidden", "length", "links", "tags", "paragraphs", "marks", "order", "number", "has_main")

    def __init__(self, tag: str, parent: Node | None, flags: int = 0, hidden: bool = False):
        self.tag, self.parent, self.flags, self.hidden = tag, parent, flags, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        #: Pieces of text and child nodes, in page order.
        self.parts: list = []
        self.length = self.links = self.tags = self.paragraphs = self.marks = self.order = 0
        self.has_main = False


def attribute_flags(text: str) -> tuple[int, bool]:
    """Bits of the word groups that class, id, role and label name; whether the element is hidden."""
    flags, hidden = 0, False
    for name, a, b, c in _ATTRIBUTE.findall(text):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id", "role", "aria-label", "itemprop", "data-role"):
            for w in _PIECE.findall(value):
                k = WORDS.get(w.lower())
                if k is not None:
                    flags |= 1 << k
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
    return flags, hidden


def parse(html: str) -> list[Node]:
    """Block nodes in page order; the first is the root."""
    root = Node("html", None)
    nodes, at, node, at_end = [root], 0, root, len(html)
    links = 0  # open links
    stack = [root]
    #: Places in the stack of the open elements of each tag, and of those that bound a scope; the root has none.
    places: dict[str, list[int]] = {}
    scopes: list[int] = [0]

    def innermost(tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none, or none in the nearest scope."""
        k = max((places[t][-1] for t in tags if places.get(t)), default=0)
        return k if k and (scopes[-1] <= k or not SCOPE.isdisjoint(tags)) else 0

    def close(k: int) -> Node:
        """Close the elements from place k on; each is closed once, so all of it takes as long as the page has tags."""
        for x in reversed(stack[k:]):
            places[x.tag].pop()
            if x.tag in SCOPE:
                scopes.pop()
        del stack[k:]
        return stack[-1]

    def push(x: Node) -> None:
        places.setdefault(x.tag, []).append(len(stack))
        if x.tag in SCOPE:
            scopes.append(len(stack))
        stack.append(x)

    unclosed: set[str] = set()  # tags without an end from here on
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            add_text(node, html[at : m.start()], links > 0)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE or tag in UNSEEN:
                continue
            if k := innermost((tag,)):
                node = close(k)
                links = 0
            continue
        if tag in UNSEEN:
            if not m[0].endswith("/>"):  # all up to its end tag is unseen, or up to the body for an open head
                end = None if tag in unclosed else re.compile(rf"</{tag}\s*>" + ("|(?=<body)" if tag in ("head", "title") else ""), re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in RAW:
                    at = at_end
                else:
                    unclosed.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            elif tag == "br":
                node.parts.append(" ")
            continue
        if tag in ("html", "body"):
            if tag == "body" and len(stack) == 1:
                flags, hidden = attribute_flags(m[3]) if m[3] else (0, False)
                node = Node("body", root, flags, False)
                root.children.append(node)
                root.parts.append(node)
                nodes.append(node)
                push(node)
            continue
        if tag in ENDS_PARAGRAPH and node.tag == "p":
            node = close(len(stack) - 1)
        if tag in CLOSES and (k := innermost(CLOSES[tag])):
            node = close(k)
        flags, hidden = attribute_flags(m[3]) if m[3] else (0, False)
        new = Node(tag, node, flags, hidden)
        node.children.append(new)
        node.parts.append(new)
        nodes.append(new)
        links = 0
        if tag not in VOID and not (m[3] and m[3].endswith("/")):
            push(new)
            node = new
    if at < at_end:
        add_text(node, html[at:], links > 0)
    for k, x in enumerate(nodes):
        x.number = k
    for x in reversed(nodes):
        x.tags += 1
        x.paragraphs += x.tag == "p"
        x.has_main = x.has_main or x.tag in ("article", "main")
        if x.parent is not None:
            p = x.parent
            p.length += x.length
            p.links += x.links
            p.tags += x.tags
            p.paragraphs += x.paragraphs
            p.marks += x.marks
            p.has_main = p.has_main or x.has_main
        for k, c in enumerate(x.children):
            c.order = k
    return nodes


def add_text(node: Node, text: str, link: bool) -> None:
    node.parts.append(text)
    n = len(text) - text.count(" ") // 2 if not text.isspace() else 0
    node.length += n
    node.links += n if link else 0
    node.marks += text.count(",") + text.count(". ")


def node_features(nodes: list[Node]) -> list[list[float]]:
    out, above = [], []
    if not nodes:
        return out
    whole = max(nodes[0].length, 1)
    for x in nodes:
        p = x.parent
        inherited = above[p.number] if p else (0, 0)
        tag = TAGS.get(x.tag, N_TAGS - 1)
        own = (inherited[0] | x.flags, inherited[1] | (1 << tag))
        above.append(own)
        length, siblings = x.length, len(p.children) if p else 1
        row = [
            length, x.links / max(length, 1), length / x.tags, x.paragraphs, x.marks / max(length, 1) * 100, length / whole, x.depth, x.order, siblings - x.order - 1, siblings,
            float(x.hidden), float(x.has_main), float(sum(isinstance(y, str) and not y.isspace() for y in x.parts)), tag, p.length / whole if p else 1.0, x.tags,
        ]
        row += [float(x.flags >> k & 1) for k in range(N_GROUPS)]
        row += [float(inherited[0] >> k & 1) for k in range(N_GROUPS)]
        row += [float(tag == k) for k in range(N_TAGS)]
        row += [float(inherited[1] >> k & 1) for k in range(N_TAGS)]
        out.append(row)
    return out


def decode(nodes: list[Node], logp: np.ndarray) -> list[int]:
    """The best states of a whole tree under the order of states."""
    n = len(nodes)
    best = logp.tolist()
    choice: list[list[int]] = [[0, 0, 0]] * n
    allowed = ((PASS, MAIN, OTHER), (MAIN, OTHER), (OTHER,))
    for k in range(n - 1, 0, -1):
        own = best[k]
        pick = [max(states, key=own.__getitem__) for states in allowed]
        choice[k] = pick
        up = best[nodes[k].parent.number]
        for s in range(3):
            up[s] += own[pick[s]]
    state = [0] * n
    state[0] = max(range(3), key=best[0].__getitem__)
    for k in range(1, n):
        state[k] = choice[k][state[nodes[k].parent.number]]
    return state


def main_text(nodes: list[Node], state: list[int]) -> str:
    out: list[str] = []

    def flush(pieces: list[str]) -> None:
        if pieces:
            block = " ".join("".join(map(unescape, pieces)).split())
            if block:
                out.append(block)
            pieces.clear()

    # an explicit stack: a page may nest deeper than Python recurses
    stack: list[tuple[Node, int, list[str]]] = [(nodes[0], 0, [])]
    while stack:
        node, k, pieces = stack.pop()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, str):
                if state[node.number] == MAIN:
                    pieces.append(part)
            else:
                flush(pieces)
                stack.append((node, k, pieces))
                node, k, pieces = part, 0, []
        flush(pieces)
    return "\n\n".join(out)


def training_pages(pages: int = 160, seed: int = 3) -> list[str]:
    """Pages with known parts: elements that carry x="m" are main text, x="o" boilerplate."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    chance = lambda p: r.random() < p

    def words(lo: int, hi: int) -> str:
        out = []
        for w in range(int(r.integers(lo, hi))):
            word = "".join(r.choice(list("abcdeilmnorstu"), r.integers(2, 9)))
            out.append(word.capitalize() if not w else word + pick("", "", "", "", "", ",", "."))
        return " ".join(out)

    link = lambda: f'<a href="/{words(1, 2)}">{words(1, 4)}</a>'
    items = lambda lo, hi: "".join(f"<li>{link()}</li>" for _ in range(int(r.integers(lo, hi))))

    def named(tag: str, group: str, text: str, mark: str = "o", name: bool | None = None) -> str:
        own = pick(*GROUPS[group].split())
        attribute = f' {pick("class", "id")}="{pick(own, own + "-" + words(1, 2).lower(), "site-" + own, own + "Box", "block " + own)}"' if (chance(0.85) if name is None else name) else ""
        return f'<{tag}{attribute} x="{mark}">{text}</{tag}>'

    def nav() -> str:
        return pick(f'<nav x="o"><ul>{items(3, 9)}</ul></nav>', named("div", "nav", f"<ul>{items(3, 9)}</ul>", name=True), named("ul", "nav", items(3, 9), name=True), f'<nav x="o">{link()} | {link()} | {link()}</nav>')

    def advert() -> str:
        return pick(named("div", "ad", words(3, 40), name=True), named("aside", "ad", f"<p>{words(5, 30)}</p>{link()}", name=True), named("div", "ad", f"{link()} {words(3, 30)}", name=True))

    def notice() -> str:
        return named(pick("div", "section", "dialog"), "notice", f"<p>{words(8, 40)}</p><button>{words(1, 3)}</button>{link()}", name=True)

    def form() -> str:
        return f'<form action="/s" x="o"><label>{words(1, 4)}</label><input name="q"><p>{words(2, 12)}</p><button>{words(1, 2)}</button></form>'

    def side() -> str:
        inner = pick(f"<h3>{words(1, 4)}</h3><ul>{items(3, 8)}</ul>", f"<h4>{words(1, 4)}</h4><p>{words(8, 50)}</p>", f"<p>{words(8, 60)}</p><p>{words(5, 30)}</p>")
        return pick(f'<aside x="o">{inner}</aside>', named("div", "side", inner, name=True), named("section", "side", inner, name=True))

    def talk() -> str:
        one = lambda: pick(f"<p>{words(5, 80)}</p>", f"<div><b>{words(1, 3)}</b><p>{words(8, 60)}</p></div>", f"<li><p>{words(5, 60)}</p></li>")
        return named(pick("div", "section", "ol"), "talk", f"<h3>{words(1, 3)}</h3>" * chance(0.6) + "".join(one() for _ in range(int(r.integers(1, 6)))), name=True)

    def head() -> str:
        inner = pick(f"<p>{words(1, 6)}</p>", f"<h2>{words(1, 4)}</h2><p>{words(2, 10)}</p>", link(), nav())
        return pick(f'<header x="o">{inner}</header>', named("div", "head", inner, name=True))

    def foot() -> str:
        inner = pick(f"&copy; {words(2, 30)}", f"<p>{words(5, 40)}</p><ul>{items(2, 6)}</ul>", f"{link()} {link()} <p>{words(2, 20)}</p>")
        return pick(f'<footer x="o">{inner}</footer>', named("div", "foot", inner, name=True))

    def share() -> str:
        return named(pick("div", "ul"), "share", items(2, 5), name=True)

    def paragraph() -> str:
        body = words(2, 120)
        if chance(0.15):
            body += f" {link()} " + words(2, 20)
        return pick(f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<p><em>{words(1, 5)}</em> {body}</p>")

    def article() -> str:
        parts = [f"<h1>{words(2, 10)}</h1>"] * chance(0.9) + [paragraph()]
        for _ in range(int(r.integers(0, 9))):
            parts.append(pick(paragraph, paragraph, paragraph, paragraph, lambda: f"<h2>{words(1, 7)}</h2>", lambda: f"<ul>{''.join(f'<li>{words(2, 25)}</li>' for _ in range(3))}</ul>", lambda: f"<blockquote><p>{words(5, 50)}</p></blockquote>", lambda: f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>", lambda: f"<figure><img src=x><figcaption>{words(3, 15)}</figcaption></figure>", lambda: f"<pre>{words(3, 20)}</pre>", lambda: f"<div>{words(10, 80)}</div>", lambda: f"<section><h3>{words(1, 5)}</h3>{paragraph()}</section>")())
            if chance(0.08):
                parts.append(pick(advert, share, form, side, notice)())
        if chance(0.12):
            parts.append(pick(share, talk, side, advert)())
        inner = "".join(parts)
        return pick(f'<article x="m">{inner}</article>', f'<article x="m">{inner}</article>', f'<main x="m">{inner}</main>', named("div", "main", inner, "m", True), named("section", "main", inner, "m", True), f'<article class="post" x="m"><div class="entry-content">{inner}</div></article>', f'<div x="m">{inner}</div>')

    out = []
    for _ in range(pages):
        before = [f() for f in (head, nav, notice, advert, form) if chance(0.45)]
        after = [f() for f in (side, talk, share, advert, form, notice) if chance(0.35)] + ([foot()] if chance(0.85) else [])
        r.shuffle(before)
        middle = article()
        if chance(0.35):
            middle = pick(f"<div>{middle}{side()}</div>", f'<div id="wrapper">{side()}{middle}</div>', f'<div class="container"><div>{middle}</div></div>', f"<main>{middle}</main>", f'<div class="content">{nav()}{middle}</div>', f"<div><div>{head()}</div>{middle}{talk()}</div>")
        body = "".join([*before, middle, *after])
        if chance(0.1):
            body = body[: int(len(body) * r.uniform(0.7, 1.0))]
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><style>p{{}}</style></head><body>{body}</body></html>")
    return out


def plain_pages(pages: int = 169, seed: int = 5) -> list[str]:
    """Pages of little text or structure, marked as ``training_pages``: bare text, a body without containers, short articles."""
    r = np.random.default_rng(seed)

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice(list("abcdeilmnorstu"), r.integers(2, 9))) + "  ,."[r.integers(4)].strip() for _ in range(int(r.integers(lo, hi))))

    def inline(lo: int, hi: int) -> str:
        return f" <b>{words(1, 4)}</b><br>".join(words(lo, hi) for _ in range(int(r.integers(1, 3))))

    def paragraphs() -> str:
        return "".join(f"<p>{inline(1, (4, 30, 120)[r.integers(3)])}</p>" for _ in range(int(r.integers(1, 4))))

    def links() -> str:
        return "".join(f'<li><a href="/">{words(1, 3)}</a></li>' for _ in range(int(r.integers(2, 8))))

    def aside() -> str:
        group = ("ad", "notice", "talk", "share", "side")[r.integers(5)]
        name = GROUPS[group].split()[r.integers(3)]
        return f'<div {("class", "id")[r.integers(2)]}="{name}" x="o"><p>{words(2, 16)}</p></div>'

    shapes = (
        lambda: f'<html x="m">{inline(1, 200)}',
        lambda: f'<html><body x="m">{inline(1, 200)}</body></html>',
        lambda: f'<html><body x="m">{paragraphs()}</body></html>',
        lambda: f'<html><body x="m"><h1>{words(1, 8)}</h1>{paragraphs()}</body></html>',
        lambda: f'<html><body x="m">{inline(5, 120)}<div>{inline(5, 60)}</div>{inline(5, 60)}</body></html>',
        lambda: f'<p x="m">{inline(1, 12)}</p>',
        lambda: f'<html><body><div x="m">{paragraphs()}</div></body></html>',
        # short main text beside boilerplate, so that few words alone aren't taken for it
        lambda: f'<html><body><nav x="o"><ul>{links()}</ul></nav><div class="ad" x="o">{words(2, 16)}</div><article x="m"><h1>{words(2, 10)}</h1><p>{inline(1, 15)}</article><footer x="o">&copy; {words(2, 30)}</footer></body></html>',
        lambda: f'<html><body><div class="menu" x="o">{links()}</div><div x="m"><p>{inline(1, 15)}</p></div><footer x="o"><p>{words(2, 30)}</p></footer></body></html>',
        lambda: f'<html><body><main x="m"><h1>{words(2, 10)}</h1><p>{inline(1, 15)}<p>{inline(1, 15)}</main><div class="footer" x="o">{words(2, 30)}</div></body></html>',
        lambda: f'<html><body><article x="m"><h1>{words(1, 10)}</h1><p>{inline(1, 15)}<p>{inline(1, 15)}</p>{aside()}</article>{aside()}<footer x="o">{words(1, 20)}</footer></body></html>',
        lambda: f'<html><body>{aside()}<article x="m"><p>{inline(1, 15)}</p>{aside()}<p>{inline(1, 15)}</p></article>{aside()}</body></html>',
        lambda: f'<html><body><header x="o">{words(1, 8)}</header><article x="m"><p>{inline(1, 15)}</article><footer x="o">{words(2, 30)}</footer></body></html>',
    )
    return [shapes[k % len(shapes)]() for k in range(pages)]


def labels_of(nodes: list[Node], marks: list[str | None]) -> list[int]:
    """States from marked elements: a mark holds below it until the next; what holds main text above is pass, the rest other."""
    state: list[int | None] = [None] * len(nodes)
    for x, m in zip(nodes, marks):
        up = state[x.parent.number] if x.parent else None
        state[x.number] = MAIN if m == "m" and up != OTHER else OTHER if m == "o" else up
    holds = [s == MAIN for s in state]
    for x in reversed(nodes[1:]):
        if holds[x.number]:
            holds[x.parent.number] = True
    return [s if s is not None else PASS if holds[k] else OTHER for k, s in enumerate(state)]


_MARK = re.compile(r'<([a-z0-9]+)[^>]*?(?: x="([mo])")?>')


def learn(pages: list[str] | None = None, seed: int = 3) -> Boosting:
    rows, states = [], []
    for html in [*training_pages(seed=seed), *plain_pages()] if pages is None else pages:
        nodes = parse(html)
        # the same parse, of the page without marks, gives the nodes in the same order
        marks: list[str | None] = ["m" if html.startswith('<html x="m">') else None]
        for m in _MARK.finditer(re.sub(r"<head>.*?</head>|<!DOCTYPE[^>]*>|<html[^>]*>", "", html)):
            if m[1] not in INLINE and m[1] not in UNSEEN:
                marks.append(m[2])
        rows += node_features(nodes)
        states += labels_of(nodes, marks[: len(nodes)] + [None] * (len(nodes) - len(marks)))
    return Boosting(3, rounds=14, depth=5).fit(np.array(rows), np.array(states))


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
COLUMNS = "page_id long, url string, text string, n_chars long"


def extract(pages: list[str | None], model: Boosting) -> list[str]:
    parsed = [parse(h) if h else [] for h in pages]
    rows = [row for nodes in parsed for row in node_features(nodes)] if any(parsed) else []
    logp = model.log_probabilities(np.array(rows)) if rows else np.zeros((0, 3))
    out, at = [], 0
    for nodes in parsed:
        own = logp[at : at + len(nodes)]
        at += len(nodes)
        out.append(main_text(nodes, decode(nodes, own)) if nodes else "")
    return out


def extract_batches(batches: Iterator[pa.RecordBatch], model: Boosting) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi in blocks(b.column(2)):
            part = b.slice(lo, hi - lo)
            texts = extract(part.column(2).to_pylist(), model)
            yield batch(SCHEMA, part.column(0), part.column(1), texts, np.array([len(t) for t in texts], np.int64))


def extract_pages(pages: DataFrame, model: Boosting | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; no shuffle."""
    rows = need(pages, page_id="long", url="string", html="string")
    return rows.mapInArrow(on_workers(__name__, "extract_batches", learn() if model is None else model), COLUMNS)
