"""HTML to a tree of nodes with text pieces, in one pass over the tags."""

from __future__ import annotations

import html as _html
import re

#: Elements that start and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is not text of the page.
DROPPED = frozenset("script style noscript template svg iframe canvas audio video textarea select option button datalist title annotation annotation-xml".split())
#: Of these, those whose content is not parsed for tags.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Of the others, those that a start tag of the same name closes.
FLAT = frozenset("select option button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, if open inside the nearest of the listed limits.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_SCOPE = frozenset("article aside body blockquote button div footer header main nav section table td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of classes, ids and roles that often stand at the parts of a page around its main text. Fixed values.
AROUND = frozenset(
    (
        "ad ads advert advertisement adverts banner sponsor sponsored sponsors promo promoted promotion promotions outbrain taboola dfp adsense "
        "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager skip topbar toolbar sitemap "
        "masthead footer colophon sidebar aside widget widgets related recommended recommendations "
        "cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
        "comment comments commentlist disqus replies share sharing social subscribe subscription newsletter signup login signin search searchbox"
    ).split()
)
#: Words that often stand at such parts, and as often inside a text. Fixed values.
UNSURE = frozenset("header foot copyright legal imprint credits rail popular trending teaser teasers more alerts disclaimer warning discussion reply respond reviews thread follow register form contact feedback poll survey tags tagcloud rating".split())
#: Words that often stand at the main text. Fixed values.
WITHIN = frozenset("article articlebody post entry story content main maincontent body text blogpost prose hentry".split())
_AROUND_TAGS = frozenset("nav aside footer form menu dialog search".split())
_WITHIN_TAGS = frozenset("article main".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

#: Hints of a node: none, a part around the main text, the main text, a word that tells little.
NONE, OUT, IN, MAYBE = 0, 1, 2, 3


class Page:
    """parent, tag and hint of every node in page order (parents come first); pieces: (block, node, text, in a link)."""

    __slots__ = ("hint", "parent", "pieces", "tag")

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.hint: list[int] = [NONE]
        self.pieces: list[tuple[int, int, str, bool]] = []


def _hint(tag: str, attributes: str, within: bool) -> int:
    if tag in _AROUND_TAGS or (tag == "header" and not within):
        return OUT
    found = IN if tag in _WITHIN_TAGS else NONE
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return OUT
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    return OUT
                continue
            # the last telling word of a name counts: post-comments are comments
            told = set()
            for name_ in value.split():
                words = [w for w in map(str.lower, _WORD.findall(name_)) if w in AROUND or w in WITHIN or w in UNSURE]
                if words or name_.lower() == "articlebody":
                    told.add(IN if not words or words[-1] in WITHIN else OUT if words[-1] in AROUND else MAYBE)
            if told == {OUT}:
                return OUT
            if found == NONE and told:
                found = IN if told == {IN} else MAYBE
    return found


def _ends(source: str) -> dict[int, int]:
    """Where each dropped element with an end tag ends, by the place behind its start tag.

    An end tag of a block closes all that is open inside the block, so what is left open in it has no end.
    """
    found: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    count: dict[str, int] = {}
    at = 0

    def close(tag: str) -> int:
        while True:
            name, start = opened.pop()
            count[name] -= 1
            if name == tag:
                return start

    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            at = len(source) if stop < 0 else stop + 3
            continue
        if source[at + 1 : at + 2] in ("!", "?"):
            stop = source.find(">", at)
            at = len(source) if stop < 0 else stop + 1
            continue
        m = _TAG.match(source, at) or _LOOSE.match(source, at)
        if not m:
            at += 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in RAW and not m[1]:
            stop = _RAW_END[tag].search(source, at)
            at = stop.end() if stop else len(source)
        elif tag in RAW or tag in VOID or (tag not in BLOCKS and tag not in DROPPED):
            continue
        elif m[1]:
            if count.get(tag):
                start = close(tag)
                if tag in DROPPED:
                    found[start] = at
        elif tag in BLOCKS or not m[3].rstrip().endswith("/"):
            if tag in FLAT and count.get(tag):
                close(tag)
            opened.append((tag, at))
            count[tag] = count.get(tag, 0) + 1
    return found


def parse(source: str) -> Page:
    """The tree of a page; never fails, whatever the markup."""
    page = Page()
    parent, tags, hints, pieces = page.parent, page.tag, page.hint, page.pieces
    # open elements: (tag, node of its text, is a new node)
    opened: list[tuple[str, int]] = [("html", 0)]
    block, links, within = 0, 0, 0
    at, end = 0, len(source)
    ends: dict[int, int] | None = None

    def close(depth: int) -> None:
        nonlocal block, links, within
        while len(opened) > depth:
            name, node = opened.pop()
            if name in BLOCKS:
                block += 1
            if name == "a":
                links -= 1
            if hints[node] == IN and node != opened[-1][1]:
                within -= 1

    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = source[at:lt]
            pieces.append((block, opened[-1][1], _html.unescape(text) if "&" in text else text, links > 0))
            at = lt
            if at >= end:
                break
        following = source[at + 1 : at + 2]
        if following == "!":
            if source.startswith("<!--", at):
                stop = source.find("-->", at + 4)
                at = end if stop < 0 else stop + 3
            else:
                stop = source.find(">", at)
                at = end if stop < 0 else stop + 1
            continue
        if following == "?":
            stop = source.find(">", at)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(source, at) or _LOOSE.match(source, at)
        if not m:
            pieces.append((block, opened[-1][1], "<", links > 0))
            at += 1
            continue
        at = m.end()
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag == "br":
                pieces.append((block, opened[-1][1], " ", False))
            for i in range(len(opened) - 1, 0, -1):
                if opened[i][0] == tag or (tag in _HEADINGS and opened[i][0] in _HEADINGS):
                    close(i)
                    break
                if tag not in BLOCKS and opened[i][0] in BLOCKS and opened[i][0] != "p":
                    break
            else:
                if tag in BLOCKS:
                    block += 1
            continue
        if tag in DROPPED:
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                at = stop.end() if stop else end
            else:
                # without an end tag in the enclosing block only the start tag is skipped
                if ends is None:
                    ends = _ends(source)
                at = ends.get(at, at)
            continue
        if tag in BLOCKS:
            # a block ends an open paragraph, and a heading ends one
            for i in range(len(opened) - 1, 0, -1):
                if opened[i][0] == "p":
                    close(i)
                    break
                if opened[i][0] in _SCOPE:
                    break
            if tag in CLOSES:
                shut, limits = CLOSES[tag]
                for i in range(len(opened) - 1, 0, -1):
                    if opened[i][0] in limits:
                        break
                    if opened[i][0] in shut:
                        close(i)
                        if tag not in ("tr", "tbody", "thead", "tfoot"):
                            break
            if tag in _HEADINGS and opened[-1][0] in _HEADINGS:
                close(len(opened) - 1)
            block += 1
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            if tag == "br":
                pieces.append((block, opened[-1][1], " ", False))
            continue
        if tag == "html":
            continue
        node = opened[-1][1]
        hint = _hint(tag, attributes, within > 0)
        if tag in BLOCKS or hint == OUT:
            parent.append(node)
            tags.append(tag)
            hints.append(hint)
            node = len(parent) - 1
            within += hint == IN
        if tag == "a":
            links += 1
        opened.append((tag, node))
    return page
