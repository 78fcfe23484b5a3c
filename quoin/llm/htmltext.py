"""Main text of web pages: content marginals of DOM nodes by sum-product on the page's tree."""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
HIDDEN = RAW | frozenset("head svg math canvas object select button option datalist audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select", "datalist"}}
ROLES = ("nav", "menu", "header", "masthead", "footer", "foot", "sidebar", "side", "aside", "widget", "ad", "ads", "advert", "sponsor", "sponsored", "promo", "banner", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "comment", "comments", "reply", "discussion", "disqus", "share", "social", "related", "recommend", "breadcrumb", "breadcrumbs", "pagination", "toolbar", "search", "login", "form", "copyright", "legal", "tags", "meta", "content", "article", "post", "entry", "story", "main", "body", "text")

# possessive throughout: each character is read once, and a quote counts only behind an equals sign, as in browsers
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)(>?)")
_ATTR = re.compile(r"(?<![-\w:.])([a-zA-Z_:][-\w:.]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_NUMBER = re.compile(r"&#(?:0*+([0-9]{8,}+)|[xX]0*+([0-9a-fA-F]{7,}+));?")
DEPTH = 512
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_ROLE = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "text")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.text = tag, attrs, parent, [], ""


def tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """(text, tag) in page order: the text before each tag, and at the end the rest without one.

    Comments, declarations, processing instructions and character data are left out; a tag cut off
    at the page's end, or by a quote that never closes, ends the page.
    """
    start = pos = 0
    size = len(page)
    while (pos := page.find("<", pos)) >= 0:
        after = page[pos + 1 : pos + 2]
        if after in ("!", "?"):
            mark = next(((o, c) for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, pos)), ("<", ">"))
            end = page.find(mark[1], pos + len(mark[0]))
            yield page[start:pos], None
            start = pos = size if end < 0 else end + len(mark[1])
            continue
        m = _TAG.match(page, pos)
        if m is None:
            if after == "/" and pos + 2 >= size:
                size = pos
            pos += 1
            continue
        if not m[4]:
            yield page[start:pos], None
            return
        yield page[start:pos], m
        start = pos = m.end()
        if not m[1] and (tag := m[2].lower()) in RAW:
            end = _raw_end(tag).search(page, pos)
            start = pos = end.end() if end else size
    yield page[start:size], None


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)


def decoded(text: str) -> str:
    """text with character references decoded; numbers beyond every character give U+FFFD."""
    return html.unescape(_NUMBER.sub("&#xFFFD;", text)) if "&" in text else text


def tree(page: str) -> Node:
    """The DOM of a page: elements, and text nodes of tag '#'. Open elements are closed as HTML closes them; a tag cut off at the end is dropped.

    An end tag, and a start tag that closes others, looks at the DEPTH innermost open elements, as
    browsers nest no deeper; so work grows in proportion to the page.
    """
    root = at = Node("#root", "", None)
    for rest, m in tokens(page):
        if rest:
            text = Node("#", "", at)
            text.text = decoded(rest)
            at.kids.append(text)
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            at = _ended(at, tag)
            continue
        if tag in CLOSES_P:
            at = _close(at, {"p"}, {"table", "td", "th", "button"})
        if tag in CLOSED_BY:
            at = _close(at, CLOSED_BY[tag], SCOPE[tag])
        new = Node(tag, m[3] or "", at)
        at.kids.append(new)
        if tag not in VOID and tag not in RAW and not (m[3].endswith("/") and tag in ("svg", "path")):
            at = new
    return root


def _ended(at: Node, tag: str) -> Node:
    """The place after an end tag; one of an inline element closes nothing beyond a block."""
    up = at
    for _ in range(DEPTH):
        if up.parent is None or tag in INLINE and up.tag not in INLINE:
            return at
        if up.tag == tag:
            return up.parent
        up = up.parent
    return at


def _close(at: Node, kinds: set[str], stops: set[str]) -> Node:
    """The place after closing every open element of these kinds up to one that stops them."""
    up, out = at, at
    for _ in range(DEPTH):
        if up.parent is None or up.tag in stops:
            break
        if up.tag in kinds:
            out = up.parent
        up = up.parent
    return out


def _nodes(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(reversed(n.kids))
    return out


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of what is seen of each block-level node: its tag, words of its class, id and role, size, link share and place."""
    chars, linked, count = {}, {}, {}
    for n in reversed(nodes):
        own = len(n.text.strip()) if n.tag == "#" else 0
        chars[n] = own + sum(chars[k] for k in n.kids)
        count[n] = 1 + sum(count[k] for k in n.kids)
        linked[n] = chars[n] if n.tag in ("a", "button") else sum(linked[k] for k in n.kids)
    total = max(1, chars[nodes[0]])
    out = []
    for n in nodes:
        seen = [f"tag={n.tag}"]
        for name, a, b, c in _ATTR.findall(n.attrs):
            if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                words = set(_ROLE.findall((a or b or c).lower()))
                seen += [f"role={r}" for r in ROLES if r in words]
        if len(seen) > 1:
            seen.append(f"named={n.tag}")
        size, share = chars[n], linked[n] / max(1, chars[n])
        seen.append(f"size={min(5, int(math.log(size + 1, 4)))}")
        seen.append(f"links={0 if share < 0.05 else 1 if share < 0.3 else 2 if share < 0.7 else 3}")
        if n.tag not in INLINE and n.tag != "#":
            seen.append(f"share={min(3, int(4 * size / total))}")
        out.append(seen)
    return out


class Model:
    """Node and parent-child potentials of a tree-structured random field, fitted on labelled pages.

    A node's label tells whether it belongs to the page's content. The page's distribution is the
    product of a log-linear potential of what is seen of each node and one of each parent-child pair
    by the child's tag. Fitting follows the gradient of the pages' log likelihood: features and pairs
    observed less those expected under the marginals that sum-product gives.
    """

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.edges: dict[str, list[list[float]]] = {"*": [[1.0, 0.0], [0.0, 1.0]]}

    def fit(self, pages: list[tuple[list[Node], dict[Node, int]]], epochs: int = 6, rate: float = 0.3) -> Model:
        """Stochastic steps of adaptive size over (nodes, labels) of each page, in a fixed order."""
        size: dict = defaultdict(lambda: 1e-6)
        seen = [[f for f in features(nodes)] for nodes, _ in pages]

        def step(table: dict | list, key, at, gradient: float) -> None:
            if abs(gradient) > 1e-4:
                size[at] += gradient * gradient
                table[key] += rate * gradient / math.sqrt(size[at])

        for nodes, _ in pages:
            for n in nodes:
                if n.tag != "#":
                    self.edges.setdefault(n.tag, [[0.0, 0.0], [0.0, 0.0]])
        for names in seen:
            for own in names:
                for f in own:
                    self.weights.setdefault(f, 0.0)
        for _ in range(epochs):
            for (nodes, label), names in zip(pages, seen, strict=True):
                chance, pairs = self.marginals(nodes, names, pairs=True)
                for n, own in zip(nodes, names, strict=True):
                    if n.tag == "#":
                        continue
                    g = label[n] - chance[n]
                    for f in own:
                        step(self.weights, f, f, g)
                    if n.parent is not None:
                        for i in (0, 1):
                            for j in (0, 1):
                                step(self.edges[n.tag][i], j, (n.tag, i, j), float(label[n.parent] == i and label[n] == j) - pairs[n][i][j])
        return self

    def marginals(self, nodes: list[Node], seen: list[list[str]] | None = None, pairs: bool = False):
        """Each element's chance to be content, by one pass of messages up the tree and one down it; with pairs, also of each parent-child pair's labels."""
        total: dict[Node, list[float]] = {}
        for n, names in zip(nodes, seen or features(nodes), strict=True):
            if n.tag != "#":
                total[n] = [0.0, sum(self.weights.get(f, 0.0) for f in names)]
        up: dict[Node, tuple[float, float]] = {}
        for n in reversed(nodes):
            if n.tag == "#" or n.parent is None:
                continue
            (p00, p01), (p10, p11) = self.edges.get(n.tag) or self.edges["*"]
            s0, s1 = total[n]
            m = up[n] = (_add(p00 + s0, p01 + s1), _add(p10 + s0, p11 + s1))
            t = total[n.parent]
            t[0] += m[0]
            t[1] += m[1]
        belief: dict[Node, tuple[float, float]] = {}
        out: dict[Node, float] = {}
        both: dict[Node, list[list[float]]] = {}
        for n in nodes:
            if n.tag == "#":
                continue
            b0, b1 = s0, s1 = total[n]
            if n.parent is not None:
                (p00, p01), (p10, p11) = self.edges.get(n.tag) or self.edges["*"]
                q0, q1 = belief[n.parent]
                u0, u1 = up[n]
                q0, q1 = q0 - u0, q1 - u1
                b0, b1 = s0 + _add(p00 + q0, p10 + q1), s1 + _add(p01 + q0, p11 + q1)
                if pairs:
                    joint = [[q0 + p00 + s0, q0 + p01 + s1], [q1 + p10 + s0, q1 + p11 + s1]]
                    most = max(max(r) for r in joint)
                    joint = [[math.exp(x - most) for x in r] for r in joint]
                    whole = sum(map(sum, joint))
                    both[n] = [[x / whole for x in r] for r in joint]
            belief[n] = (b0, b1)
            d = b1 - b0
            out[n] = 1 / (1 + math.exp(-d)) if d > -500 else 0.0
        return (out, both) if pairs else out


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _is_block(n: Node) -> bool:
    return n.tag != "#" and n.tag not in INLINE


def blocks(root: Node, content: dict[Node, float] | None, least: float = 0.5) -> list[str]:
    """The text blocks in page order: runs of inline content of a block element, white space made one space; those of content only.

    Inline elements inside a block that aren't content themselves (an advert in a paragraph) are left
    out. White space is that of HTML: space, tab, line feed, carriage return, form and line tabulation;
    a no-break space is a character like others.
    """
    out: list[str] = []
    run: list[str] = []

    def flush(keep: bool) -> None:
        text = _SPACE.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text and keep:
            out.append(text)

    def good(n: Node) -> bool:
        return content is None or content.get(n, 0.0) >= least

    stack: list[tuple[Node, int]] = [(root, 0)]
    owner = [root]
    while stack:
        n, k = stack.pop()
        if k == 0 and _is_block(n):
            flush(good(owner[-1]))
            owner.append(n)
        if k < len(n.kids):
            stack.append((n, k + 1))
            kid = n.kids[k]
            if kid.tag == "#":
                run.append(kid.text)
            elif kid.tag == "br":
                run.append(" ")
            elif kid.tag not in HIDDEN and (kid.tag not in INLINE or good(kid) or not good(owner[-1])):
                stack.append((kid, 0))
            continue
        if _is_block(n):
            flush(good(n))
            owner.pop()
    return out


def extract(page: str | None, model: Model, least: float = 0.5) -> str:
    """The main text of a page, blocks joined by line feeds; empty for a null or empty page."""
    if not page:
        return ""
    root = tree(page)
    return "\n".join(blocks(root, model.marginals(_nodes(root)), least))


SYLLABLES = "ba de ki lo mu na pe ri so tu va we zi or an es it un al er".split()


def labelled_pages(count: int = 400, seed: int = 3) -> Iterator[tuple[str, str]]:
    """Labelled training pages: (html, content mark). Elements of the content carry the attribute data-own.

    A seeded generator of invented prose in the layouts that sites use: an article or a div with
    telling or no class, with menus, headers, footers, sidebars, notices, adverts, forms, comments,
    share bars and related links around or inside it.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def prose() -> str:
        kind = rng.random()
        if kind < 0.12:
            return line(1, 3)
        if kind < 0.2:
            return " ".join([word()] * rng.randint(2, 60))
        return " ".join(line(1, 14).capitalize() + rng.choice(["."] * 5 + ["!", "?", ""]) for _ in range(rng.randint(1, 8)))

    pick = rng.choice

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{line(1, 3)}</a></li>' for _ in range(n))

    def named(tag: str, names: str, inside: str) -> str:
        name = pick(names.split())
        how = pick(['class="{}"', 'id="{}"', 'class="{} box"', 'class="site-{}"', 'class="{}-wrap"'])
        return f"<{tag} {how.format(name)}>{inside}</{tag}>"

    def menu() -> str:
        body = f"<ul>{links(rng.randint(3, 9))}</ul>"
        return pick([f"<nav>{body}</nav>", named("div", "nav menu navigation toolbar", body), f"<nav class='menu'>{''.join(f'<a href=/{word()}>{word()}</a> ' for _ in range(5))}</nav>", named("ul", "breadcrumb breadcrumbs nav menu", links(4))])

    def head() -> str:
        body = pick([f"<h1>{line(1, 3)}</h1>", f"<h2><a href='/'>{line(1, 3)}</a></h2>", f"<a href='/'>{word()}</a>", f"<p>{line(2, 6)}</p>"])
        return pick([f"<header>{body}{menu() if rng.random() < 0.5 else ''}</header>", named("div", "header masthead banner", body)])

    def foot() -> str:
        body = pick([f"&copy; {word()}.example &middot; {prose()}", f"<p>&copy; 2020 {line(1, 4)}. {prose()}</p>", f"<p>{prose()}</p><ul>{links(3)}</ul>", f"{line(3, 9)} <a href='/p'>{word()}</a>"])
        return pick([f"<footer>{body}</footer>", f"<footer class='foot'>{body}</footer>", named("div", "footer copyright legal foot", body)])

    def side() -> str:
        body = pick([f"<h3>{line(1, 3)}</h3><ul>{links(5)}</ul>", f"<h4>{line(1, 3)}</h4><p>{prose()}</p>", f"<p>{prose()}</p><p>{prose()}</p>"])
        return pick([f"<aside>{body}</aside>", named("div", "sidebar side widget related recommend aside", body), named("aside", "sidebar widget", body), named("section", "related sidebar widget recommend", body)])

    def advert() -> str:
        body = pick([prose(), f"<p>{prose()}</p>", f"<a href='/x'>{line(2, 6)}</a>", f"<h4>{line(2, 4)}</h4><p>{prose()}</p>"])
        return named(pick(["div", "div", "section", "aside", "p"]) if "<p>" not in body else "div", "ad ads advert sponsor promo banner", body)

    def notice() -> str:
        body = pick([prose(), f"<p>{prose()}</p><button>{word()}</button>", f"<p>{line(4, 12)} <a href='/c'>{word()}</a></p>"])
        return named("div", "cookie consent notice alert popup newsletter subscribe modal", body)

    def form() -> str:
        return f"<form action='/f'><label>{line(1, 3)}</label><input name='q'>{pick(['', f'<p>{prose()}</p>'])}<button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: pick([f"<li><b>{word()}</b><p>{prose()}</p></li>", named("div", "comment reply", f"<span>{word()}</span><p>{prose()}</p>"), f"<p>{prose()}</p>"])
        return named(pick(["section", "div", "ol"]), "comments discussion disqus", f"<h3>{line(1, 2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))))

    def share() -> str:
        return named("div", "share social tags meta", "".join(f"<a href='/s'>{word()}</a>" for _ in range(3)))

    def within() -> str:
        if rng.random() < 0.4:
            return named(pick(["span", "a", "a", "em", "small", "span"]), "ad ads advert sponsor sponsored promo share social subscribe newsletter", line(1, 5))
        tag = pick("a b strong em i code span mark sup time abbr q small u".split())
        extra = pick(["", "", " href='/y'", f" class='{word()}'", " class='text'", f" id='{word()}'", " title='x'"])
        inside = pick([line(1, 3), line(1, 3), prose(), f"<b data-own>{line(1, 2)}</b>"])
        return f"<{tag} data-own{extra}>{inside}</{tag}>"

    def content(first: str) -> str:
        inline = rng.random() < 0.3
        own = [f"<h1 data-own>{first}</h1>"] if rng.random() < 0.85 else []
        for _ in range(pick([rng.randint(1, 9), rng.randint(1, 9), rng.randint(10, 60)])):
            kind = rng.random()
            if kind < 0.72:
                own.append(f"<p data-own>{prose()}" + pick(["</p>", "</p>", "</p>", ""]))
            elif kind < 0.78:
                own.append(f"<p data-own><b data-own>{prose()}<br>" * pick([1, 1, 3]))
            elif kind < 0.84:
                own.append(f"<h2 data-own>{line(2, 5)}</h2>")
            elif kind < 0.88:
                own.append("<ul data-own>" + "".join(f"<li data-own>{line(3, 10)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.91:
                own.append(f"<blockquote data-own><p data-own>{prose()}</p></blockquote>")
            elif kind < 0.93:
                own.append(f"<pre data-own>{line(2, 9)}</pre>")
            elif kind < 0.95:
                own.append(f"<table data-own><tr data-own><td data-own>{line(1, 4)}</td><td data-own>{line(1, 4)}</td></tr></table>")
            elif kind < 0.97:
                own.append(f"<p data-own>{line(2, 5)} <a data-own href='/y'>{line(1, 3)}</a> {prose()}</p>")
            else:
                own.append(f"<div data-own>{prose()}</div>")
            if inline and rng.random() < 0.5:
                own.append(f"<p data-own>{line(2, 9)} {within()} {prose()}" + pick(["</p>", f" {within()}</p>", f"{within()} {line(1, 4)}</p>"]))
            if rng.random() < 0.12:
                own.append(pick([advert, share, side, notice, form])())
        body = "".join(own)
        return pick([f"<article data-own>{body}</article>", f"<article data-own>{body}</article>", f"<main data-own><article data-own>{body}</article></main>", f"<main data-own>{body}</main>", f"<div data-own class='{pick(['content', 'post', 'entry', 'article-body', 'story', 'text', 'main-content', 'post-body'])}'>{body}</div>", f"<div data-own id='{pick(['content', 'main', 'x7', 'col2', 'article'])}'>{body}</div>", f"<section data-own>{body}</section>", f"<div data-own>{body}</div>"])

    for _ in range(count):
        title = line(2, 8).capitalize() + "."
        before = [f() for f in (head, menu, notice, advert, form) if rng.random() < 0.45]
        after = [f() for f in (share, comments, side, advert, form, foot) if rng.random() < 0.45]
        rng.shuffle(before)
        main = content(title)
        if rng.random() < 0.25:
            main = f"<div data-own class='{pick(['wrap', 'container', 'page', 'row'])}'>{main}{side() if rng.random() < 0.5 else ''}</div>"
        if "</p>" in main and rng.random() < 0.25:
            main = re.sub(r"</(article|main|section|div)>$", lambda m: comments() + m[0], main)
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"
        yield page, "data-own"


def train(pages: Iterator[tuple[str, str]] | None = None) -> Model:
    """A model of labelled pages (by default the seeded ones), with <html> and <body> counted as content's frame."""
    own = []
    for page, mark in pages or labelled_pages():
        nodes = _nodes(tree(page))
        label = {n: int(mark in n.attrs or n.tag in ("#root", "html", "body")) for n in nodes if n.tag != "#"}
        for n in nodes:
            n.attrs = n.attrs.replace(mark, "")
        own.append((nodes, label))
    return Model().fit(own)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages, from the whole page.

    Null and empty pages have an empty text; broken, unclosed and cut-off markup is repaired as
    browsers do; very long pages are read whole, with work in proportion to their length; equal pages
    get equal texts; null and repeated ids stay; an empty table gives no
    rows; other columns are ignored.
    """
    own = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), own) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
