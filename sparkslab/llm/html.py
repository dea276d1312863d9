"""Main text of web pages: minimum-cut labelling of text blocks.

A page is cut into blocks at block-level tags.  A linear classifier of each
block (its enclosing elements and what their names say, whether the page has an
article and the block is in it, its links, words and end) gives the cost of
calling it content or boilerplate: terminal capacities.  Neighbours in page
order, and each block and the one before it in the same container, are tied by
edges that weaken with their distance in the DOM.  The maximum flow separates
content from boilerplate, so a block that says little goes with those around it.

The time is linear in a page's length, but for the flow among blocks that their
own costs leave open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkslab.llm.mincut import labels

# HTML's element names by role.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select button textarea datalist head title".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
#: Elements that leave an open head open; any other start tag ends it, since </head> may be left out.
_IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = frozenset("ul ol dl table div article".split())
_HOLDS = frozenset("table ul ol dl article section main body div aside nav footer header form blockquote".split())
_CHROME = frozenset("nav aside footer menu dialog search".split())
_FORM = frozenset("form fieldset".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names, and how they end or begin where they say nothing of the element itself.
_TELLING = frozenset("ad ads adsense advert advertisement advertising adverts aside breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu nav navbar navigation newsletter pager pagination paywall popup promo promoted promotion promotions replies reply respond share sharing sidebar signup skiplink social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
_HINTING = frozenset("alert banner copyright disclaimer header legal modal notice notices overlay popular recommendations recommended related tagcloud toc trending".split())
_CONTENT = frozenset("article articlebody body content entry main maincontent post story text".split())
_STATES = frozenset("active allowed closed disabled enabled off on open".split())
_DENIALS = frozenset("has hide is no with without".split())
_WRAPPERS = frozenset("area block box container inner list outer section wrap wrapper".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: The classifier's weights: log-odds of content.
WEIGHTS = {"bias": -0.5, "chrome": -9.0, "telling": -9.0, "hinting": -2.0, "form": -3.5, "article": 3.0, "outside": -3.0, "content_name": 2.0, "words": 0.06, "words_max": 3.0, "links": -4.0, "sentence": 0.8, "paragraph": 0.7, "heading": 0.4}
#: Weight of an edge between blocks with nothing between them in the DOM, how it falls by steps in it, and steps beyond which there is none.
TIE, DECAY, FAR = 2.5, 0.6, 12


class _Open:
    """An open element, with what it has from those around it."""

    __slots__ = ("tag", "depth", "up", "chrome", "telling", "hinting", "form", "article", "named", "skipped", "link")

    def __init__(self, tag: str, up: _Open | None, block: bool = True) -> None:
        self.tag = tag
        # the enclosing block-level element; an inline one stands for its own
        self.up = (up if up is None or up.tag in _BLOCK or up.up is None else up.up) if block else (up.up if up.up is not None and up.tag not in _BLOCK else up)
        self.depth = self.up.depth + 1 if self.up is not None else 0
        for x in ("chrome", "telling", "hinting", "form", "article", "named", "skipped", "link"):
            setattr(self, x, getattr(up, x) if up is not None else False)


class Block:
    """A run of text between block-level tags, and the block-level element it stands in."""

    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: _Open) -> None:
        self.text, self.linked, self.element = text, linked, element


class _Stack:
    """The open elements, and where each tag, and each kind of tag, is open."""

    def __init__(self) -> None:
        self.all = [_Open("", None)]
        self.where: dict[str, list[int]] = {"#block": [0], "#holds": [0], "#list": [0]}

    @staticmethod
    def _kinds(tag: str) -> list[str]:
        return [tag, *(k for k, of in (("#block", _BLOCK), ("#holds", _HOLDS), ("#list", _LISTS)) if tag in of)]

    def push(self, node: _Open) -> None:
        for k in self._kinds(node.tag):
            self.where.setdefault(k, []).append(len(self.all))
        self.all.append(node)

    def last(self, kind: str) -> int:
        """The innermost place of a tag or kind; 0 if it isn't open."""
        at = self.where.get(kind)
        return at[-1] if at else 0

    def cut(self, place: int) -> None:
        """Close what is open from ``place`` on."""
        while len(self.all) > place:
            for k in self._kinds(self.all.pop().tag):
                self.where[k].pop()


def _says(value: str) -> tuple[bool, bool, bool]:
    """Whether a class or id tells of boilerplate, hints at it, or names content."""
    telling = hinting = named = False
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in _DENIALS or words[-1] in _STATES:
            continue
        while len(words) > 1 and words[-1] in _WRAPPERS:
            words.pop()
        ends = {words[0], words[-1], "".join(words)}
        telling |= not ends.isdisjoint(_TELLING)
        hinting |= not ends.isdisjoint(_HINTING)
        named |= not ends.isdisjoint(_CONTENT)
    return telling, hinting, named


_names: dict[str, tuple[bool, bool, bool]] = {}


def _read(node: _Open, attributes: str) -> None:
    for a in _ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if name in ("class", "id"):
            if value not in _names:
                if len(_names) > 10_000:
                    _names.clear()
                _names[value] = _says(value)
            telling, hinting, named = _names[value]
            if node.tag not in ("body", "html", "main") and not (node.tag == "article" and node.up is not None and not node.up.article):
                node.telling |= telling
                node.hinting |= hinting
            node.named |= named
        elif name == "role":
            node.chrome |= value.lower() in _CHROME_ROLES
            node.form |= value.lower() == "form"
            node.article |= value.lower() in ("main", "article")
        elif name == "itemprop":
            node.article |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "style" and _HIDDEN.search(value)) or (name == "aria-hidden" and value.lower() == "true"):
            node.skipped = True


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each tag; comments and declarations have no name.  Send a place to go on from."""
    at, size, last, quoted = 0, len(html), html.rfind(">"), True
    while True:
        i = html.find("<", at)
        if i < 0 or i > last:  # without an end, a tag is text, and an open comment hides the rest
            if (i := html.find("<!--", at)) >= 0:
                yield i, size, "", "", ""
            return
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = j + 3 if j >= 0 else size
            yield i, at, "", "", ""
        elif html.startswith(("<!", "<?"), i):
            at = html.index(">", i) + 1
            yield i, at, "", "", ""
        elif m := _NAME.match(html, i):
            rest = _REST.match(html, m.end()) if quoted else None
            if rest is None:
                # a quote that never ends: from here on, quotes don't hide the end of a tag
                quoted = False
                end = html.find(">", m.end())
                if end < 0:
                    return
            else:
                end = rest.end() - 1
            at = end + 1
            at = (yield i, at, m[1], m[2].lower(), html[m.end() : end]) or at
        else:
            at = i + 1


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, by its tags as browsers read them, near enough.

    An empty page has none; tags that are never closed, or closed without having
    been opened, do no harm.
    """
    stack, found = _Stack(), []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, linked, stack.all[stack.last("#block")]))
            pieces.clear()
        linked = 0

    def write(raw: str) -> None:
        nonlocal linked
        top = stack.all[-1]
        if top.skipped:
            return
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if top.link:
            linked += len(text.strip())

    at, size = 0, len(html)
    tags, skip_to = _tags(html), None
    while True:
        try:
            start, end, slash, tag, attributes = tags.send(skip_to)
        except StopIteration:
            break
        skip_to = None
        if start > at:
            write(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if slash:
            place = stack.last(tag)
            if place and (block or place > stack.last("#block")):
                stack.cut(place)
            continue
        if stack.all[-1].tag == "head" and tag not in _IN_HEAD:
            stack.cut(len(stack.all) - 1)
        if block:
            # a paragraph ends where a block begins, and formatting left open in it with it
            place = stack.last("p")
            if place and place > stack.last("#holds"):
                stack.cut(place)
            place = max((stack.last(t) for t in _ENDED_BY.get(tag, ())), default=0)
            if place and place > stack.last("#list"):
                stack.cut(place)
        if tag in _VOID:
            if tag in ("img", "input", "embed"):
                pieces.append(" ")
            continue
        node = _Open(tag, stack.all[-1], block)
        if tag in _SKIPPED:
            node.skipped = True
        elif tag == "a":
            node.link = True
        if tag in _CHROME or (tag == "header" and not node.article):
            node.chrome = True
        elif tag in _FORM:
            node.form = True
        elif tag in ("article", "main"):
            node.article = True
        if attributes and not attributes.isspace():
            _read(node, attributes)
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW:
            m = _END[tag].search(html, at)
            close = html.find(">", m.end()) if m else -1
            at = skip_to = close + 1 if close >= 0 else size
            continue
        stack.push(node)
    if at < size:
        write(html[at:])
    flush()
    return found


def score(b: Block, has_article: bool) -> float:
    """Log-odds that a block is content."""
    w, e = WEIGHTS, b.element
    s = w["bias"] + min(w["words_max"], w["words"] * (b.text.count(" ") + 1)) + w["links"] * min(1.0, b.linked / max(1, len(b.text)))
    s += w["chrome"] * e.chrome + w["telling"] * e.telling + w["hinting"] * e.hinting + w["form"] * e.form + w["content_name"] * e.named
    if has_article:
        s += w["article"] if e.article else w["outside"]
    if b.text[-1] in ".!?…\"'»”":
        s += w["sentence"]
    if e.tag in ("p", "blockquote", "pre"):
        s += w["paragraph"]
    elif e.tag[0:1] == "h" and e.tag[1:].isdigit():
        s += w["heading"]
    return s


def _apart(a: _Open, b: _Open) -> int:
    """Steps from one block-level element to another through their nearest common one, or more than FAR."""
    steps = 0
    while a is not b and steps <= FAR:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def graph(found: list[Block]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """(cost of content, cost of boilerplate, edges) of a page's blocks."""
    has_article = any(b.element.article for b in found)
    scores = [score(b, has_article) for b in found]
    edges, before = [], {}
    for i, b in enumerate(found):
        if i and (steps := _apart(found[i - 1].element, b.element)) <= FAR:
            edges.append((i - 1, i, TIE * DECAY**steps))
        holder = id(b.element.up)
        j = before.get(holder)
        if j is not None and j < i - 1:
            edges.append((j, i, TIE * DECAY**2))
        before[holder] = i
    return [max(0.0, -s) for s in scores], [max(0.0, s) for s in scores], edges


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by line feeds; null and empty pages have none."""
    found = blocks(html or "")
    return "\n".join(b.text for b, content in zip(found, labels(*graph(found)), strict=True) if content)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page from its whole html; rows map to rows, without a shuffle.

    A null or empty page gives an empty text; repeated rows give repeated
    results; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
