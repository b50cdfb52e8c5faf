"""Blocks of web pages: a tolerant tag scanner and features of its tree.

``parse`` turns a page into block nodes in page order (a node's descendants
follow it without a gap).  Text that stands directly in a container is a node
of its own (``#run``), so a kept container does not bring its loose text.
Inline tags are no nodes; they are counted in their block.
"""

from __future__ import annotations

import html
import re

import numpy as np

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|-?>|.*)|([!?])[^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|$))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
_SKIPPED = {"head", "svg", "math", "object", "select", "datalist", "canvas", "audio", "video", "dialog"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RUNS = {"html", "body", "div", "section", "article", "main", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot",
         "tr", "header", "footer", "nav", "aside", "form", "figure", "center", "fieldset", "details", "menu", "td"}
_LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "address", "figcaption",
           "caption", "th", "summary", "legend", "hgroup", "button", "label"}
_BLOCKS = _RUNS | _LEAVES
#: an open tag of the first kind ends at a start tag of the second
_ENDS_P = _BLOCKS - {"button", "label", "td", "th", "tr"} | {"hr"}
_IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}}
_FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
           "th": {"tr", "table"}}

TAG_GROUPS = [
    ("heading", {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}), ("paragraph", {"p", "blockquote", "pre"}),
    ("list", {"ul", "ol", "dl", "menu"}), ("entry", {"li", "dt", "dd"}),
    ("table", {"table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}),
    ("box", {"div", "section", "center", "details"}), ("article", {"article", "main"}), ("nav", {"nav"}),
    ("aside", {"aside"}), ("header", {"header"}), ("footer", {"footer", "address"}),
    ("form", {"form", "fieldset", "button", "label", "legend"}), ("run", {"#run"}),
]
TOKEN_GROUPS = [
    ("good", "article content post story entry main text body".split()),
    ("menu", "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip".split()),
    ("advert", "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp outbrain taboola".split()),
    ("side", "sidebar side aside rail related recommended widget trending popular more also share social tags".split()),
    ("reader", "comment comments reply replies discussion disqus thread respond reader readers feedback".split()),
    ("notice", "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
               "paywall toast message warning".split()),
    ("head", "header masthead topbar logo brand branding hero".split()),
    ("foot", "footer foot copyright legal colophon credits".split()),
    ("input", "form search login register input".split()),
    ("hidden", "hidden invisible offscreen".split()),
]
_TOKEN_BIT = {t: 1 << i for i, (_, ts) in enumerate(TOKEN_GROUPS) for t in ts}
_TAG_BIT = {t: 1 << i for i, (_, ts) in enumerate(TAG_GROUPS) for t in ts}
_SCOPES = ["article", "nav", "aside", "header", "footer", "form", "list", "table"]
_SCOPE_BITS = [1 << i for i, (n, _) in enumerate(TAG_GROUPS) if n in _SCOPES]

FEATURES = (["chars", "link_share", "tags_a_char", "depth", "place", "siblings", "page_share", "stops",
             "parent_chars", "parent_link_share", "same_siblings", "sibling_chars"]
            + [f"tag_{n}" for n, _ in TAG_GROUPS] + [f"own_{n}" for n, _ in TOKEN_GROUPS]
            + [f"in_{n}" for n, _ in TAG_GROUPS if n in _SCOPES] + [f"in_{n}_token" for n, _ in TOKEN_GROUPS])

_ATTR_BITS: dict[str, tuple[int, str]] = {}


def _attribute_bits(attrs: str) -> tuple[int, str]:
    """Token groups of class, id and role, and the value of data-main."""
    got = _ATTR_BITS.get(attrs)
    if got is None:
        bits, mark = 0, ""
        for k, v in _ATTR.findall(attrs):
            k = k.lower()
            if k in ("class", "id", "role", "aria-label"):
                for t in _TOKEN.findall(v):
                    bits |= _TOKEN_BIT.get(t.lower(), 0)
            elif k in ("hidden",):
                bits |= _TOKEN_BIT["hidden"]
            elif k == "data-main":
                mark = v.strip("\"'")
        got = bits, mark
        if len(_ATTR_BITS) > 5000:
            _ATTR_BITS.clear()
        _ATTR_BITS[attrs] = got
    return got


class Page:
    """Columns of the block nodes of one page, and its text by node."""

    __slots__ = ("tag", "parent", "depth", "own", "scope", "tokens", "inline", "chars", "links", "stops", "texts",
                 "marks", "end")

    def __init__(self):
        self.tag, self.parent, self.depth, self.own = [], [], [], []
        self.scope, self.tokens, self.inline, self.chars, self.links, self.stops = [], [], [], [], [], []
        self.texts: list[list[str]] = []
        self.marks: list[str] = []
        self.end: list[int] = []

    def add(self, tag: str, parent: int, bits: int, mark: str) -> int:
        i = len(self.tag)
        t = _TAG_BIT.get(tag, 0)
        self.tag.append(t)
        self.parent.append(parent)
        self.own.append(bits)
        if parent < 0:
            self.depth.append(0)
            self.scope.append(t)
            self.tokens.append(bits)
            self.marks.append(mark)
        else:
            self.depth.append(self.depth[parent] + 1)
            self.scope.append(self.scope[parent] | t)
            self.tokens.append(self.tokens[parent] | bits)
            self.marks.append(mark or self.marks[parent])
        self.inline.append(0)
        self.chars.append(0)
        self.links.append(0)
        self.stops.append(0)
        self.texts.append([])
        return i


def parse(source: str) -> Page:
    page = Page()
    root = page.add("body", -1, 0, "")
    stack: list[tuple[str, int]] = [("body", root)]  # open blocks
    run, link, skip, skipped = -1, 0, 0, ""
    at, n = 0, len(source)

    def put(raw: str):
        nonlocal run
        if skip:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not text:
            return
        name, node = stack[-1]
        if name in _RUNS or node != len(page.tag) - 1:  # loose text, or text after an inner block
            if run < 0:
                if not text.strip():
                    return
                run = page.add("#run", node, 0, "")
            node = run
        page.texts[node].append(text)
        size = len(text) - text.count(" ")
        page.chars[node] += size
        if link:
            page.links[node] += size
        page.stops[node] += text.count(".") + text.count(",")

    while at < n:
        m = _TAG.search(source, at)
        if m is None:
            put(source[at:])
            break
        if m.start() > at:
            put(source[at:m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:  # end tag
            if skip:
                if name == skipped:
                    skip -= 1
                continue
            if name == "a":
                link = 0
            elif name in _BLOCKS:
                run = -1
                if name not in ("body", "html"):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            del stack[k:]
                            link = 0
                            break
            continue
        if skip:
            if name == skipped and not m[4].endswith("/"):
                skip += 1
            continue
        if name in _RAW:
            close = re.compile(f"</{name}[\\s/>]", re.I).search(source, at)
            at = n if close is None else source.find(">", close.start()) + 1 or n
            continue
        if name in _SKIPPED:
            if not m[4].endswith("/"):
                skip, skipped = 1, name
            continue
        if name in ("html", "body"):
            continue
        if name == "br" or name == "hr":
            node = run if run >= 0 else stack[-1][1]
            page.texts[node].append(" ")
            if name == "hr":
                run = -1
        if name in _BLOCKS:
            run = -1
            if name in _ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        link = 0
                        break
                    if stack[k][0] in ("table", "td", "button"):
                        break
            ends = _IMPLIED.get(name)
            if ends:
                fence = _FENCES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in fence:
                        break
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
            bits, mark = _attribute_bits(m[4]) if m[4] else (0, "")
            node = page.add(name, stack[-1][1], bits, mark)
            page.inline[node] += 1
            if not m[4].endswith("/"):
                stack.append((name, node))
            continue
        node = run if run >= 0 else stack[-1][1]
        page.inline[node] += 1
        if name == "a":
            link = 1
    end = list(range(1, len(page.tag) + 1))
    for i in range(len(end) - 1, 0, -1):
        p = page.parent[i]
        if end[i] > end[p]:
            end[p] = end[i]
    page.end = end
    return page


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all nodes of some pages, and where each page starts."""
    sizes = np.array([len(p.tag) for p in pages])
    base = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(base[:-1], sizes)

    def column(name):
        return np.array([x for p in pages for x in getattr(p, name)], dtype=np.int64)

    parent, end = column("parent"), column("end") + of
    node = np.arange(len(of))
    parent = np.where(parent < 0, node, parent + of)

    def below(values):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[end] - total[node]

    chars, links, tags, stops = (below(column(c)) for c in ("chars", "links", "inline", "stops"))
    kids = np.bincount(parent, minlength=len(of))
    order = np.lexsort((node, parent))
    first = np.concatenate([[0], np.cumsum(kids)])[:-1]
    place = np.empty(len(of))
    place[order] = np.arange(len(of)) - first[parent[order]]
    tag = column("tag")
    same_key = parent * (1 << len(TAG_GROUPS)) + tag
    _, which, count = np.unique(same_key, return_inverse=True, return_counts=True)
    share = links / np.maximum(chars, 1)
    cols = [np.log1p(chars), share, tags / np.maximum(chars, 1), column("depth"), place / np.maximum(kids[parent], 1),
            kids[parent], chars / np.maximum(chars[of], 1), stops / np.maximum(chars, 1),
            np.log1p(chars[parent]), share[parent], count[which.reshape(-1)], np.log1p(chars[parent] - chars)]
    own, scope, tokens = column("own"), column("scope"), column("tokens")
    cols += [tag >> i & 1 for i in range(len(TAG_GROUPS))]
    cols += [own >> i & 1 for i in range(len(TOKEN_GROUPS))]
    cols += [(scope & b) > 0 for b in _SCOPE_BITS]
    cols += [tokens >> i & 1 for i in range(len(TOKEN_GROUPS))]
    return np.stack(cols, axis=1).astype(np.float64), base


def kept_text(page: Page, keep) -> str:
    """Text of the kept nodes: blocks in page order, white space folded."""
    return " ".join(" ".join("".join(page.texts[i]) for i in range(len(page.tag)) if keep[i]).split())
