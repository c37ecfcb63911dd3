"""Pages as trees of block elements with text leaves, and the features of their nodes."""

from __future__ import annotations

import html as entities
import re

import numpy as np

_TOKEN = re.compile(
    r"<!--(?:.*?)(?:--!?>|\Z)"
    # Outside quotes a tag ends before the next "<", so that a page of open tags isn't searched again and again.
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*)(?P<attrs2>[^<>]*)>"
    r"|<[!?/][^<>]*>",
    re.S,
)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile("[a-z]+")
_CAMEL = re.compile("(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile("[.,;:!?]")

INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, or never shown.
UNSEEN = set("head noscript template svg math object canvas audio video select datalist dialog".split())
RAW = set("script style textarea iframe noframes xmp title".split())

#: Tags that count alike.
TAG_GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "li dt dd", "blockquote pre", "div section body html center", "article main", "nav menu", "header hgroup", "footer address", "aside", "form fieldset button legend output", "table tbody thead tr td th", "ul ol dl", "figure figcaption details summary"]
#: Words of class, id and role that count alike.
ATTR_GROUPS = [
    "article articlebody content main post entry story body text blog copy prose",
    "nav navigation navbar menu breadcrumb breadcrumbs toc tabs pagination pager sitemap",
    "header masthead topbar logo branding hero top",
    "footer foot copyright legal bottom colophon credits",
    "sidebar side aside rail secondary widget widgets complementary related recommended popular trending tags",
    "cookie cookies consent notice alert gdpr privacy popup modal overlay warning toast subscribe newsletter paywall disclaimer",
    "ad ads advert adverts advertisement sponsor sponsored promo promoted banner adsense",
    "form login signup search register contact",
    "comment comments commentlist reply replies discussion respond reader readers feedback",
    "share social sharing follow buttons",
]
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_ATTR_BIT = {w: 1 << i for i, g in enumerate(ATTR_GROUPS) for w in g.split()}
#: An opening tag closes these if open, up to the element that holds them.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

N_NUMBERS = 17
N_FEATURES = N_NUMBERS + 2 * len(TAG_GROUPS) + 2 * len(ATTR_GROUPS)


class Forest:
    """Nodes of many pages in page order: lists of one entry a node."""

    def __init__(self):
        self.parent, self.end, self.depth, self.tags, self.above, self.attrs, self.attrs_above = ([] for _ in range(7))
        self.texts: list[str | None] = []
        self.links: list[int] = []
        self.roots: list[int] = []

    def _node(self, parent: int, tag: int, attrs: int, leaf: bool) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.end.append(at + 1)
        if parent < 0:
            self.depth.append(0)
            self.above.append(0)
            self.attrs_above.append(0)
        else:
            self.depth.append(self.depth[parent] + 1)
            self.above.append(self.above[parent] | self.tags[parent])
            self.attrs_above.append(self.attrs_above[parent] | self.attrs[parent])
        # A leaf stands for its block.
        self.tags.append(self.tags[parent] if leaf else tag)
        self.attrs.append(attrs)
        self.texts.append("" if leaf else None)
        self.links.append(0)
        return at

    def add(self, page: str) -> None:
        """Parse one page. Unclosed and misplaced tags are taken as browsers would, by and large."""
        root = self._node(-1, 0, 0, False)
        self.roots.append(root)
        stack: list[tuple[str, int, bool]] = [("", root, False)]
        n_open: dict[str, int] = {}
        unseen = 0
        leaf, parts, linked, in_link = -1, [], 0, False

        def close_leaf() -> None:
            nonlocal leaf, parts, linked
            if leaf >= 0:
                self.texts[leaf] = " ".join("".join(parts).split())
                self.links[leaf] = linked
            leaf, parts, linked = -1, [], 0

        def pop() -> None:
            nonlocal unseen
            tag, at, hides = stack.pop()
            self.end[at] = len(self.parent)
            n_open[tag] -= 1
            unseen -= hides

        def put(text: str) -> None:
            nonlocal leaf, linked
            if unseen:
                return
            text = entities.unescape(text)
            if leaf < 0:
                if not text.strip():
                    return
                leaf = self._node(stack[-1][1], 0, 0, True)
            parts.append(text)
            if in_link:
                linked += len(text.strip())

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                put(page[at:])
                break
            if m.start() > at:
                put(page[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag, ends = tag.lower(), bool(m["end"] or m["end2"])
            if tag in RAW:
                if not ends:
                    closing = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
                    at = closing.end() if closing else n
                continue
            if tag in ("br", "hr"):
                if leaf >= 0:
                    parts.append(" ")
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not ends
                continue
            if tag in VOID:
                continue
            close_leaf()
            in_link = False
            if ends:
                if n_open.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag == "body":
                while n_open.get("head"):
                    pop()
            if stack[-1][0] == "p":
                pop()
            if tag in _CLOSES:
                closes, holders = _CLOSES[tag]
                if any(n_open.get(c) for c in closes):
                    k = len(stack) - 1
                    while k > 0 and stack[k][0] not in closes and stack[k][0] not in holders:
                        k -= 1
                    if stack[k][0] in closes:
                        while len(stack) > k:
                            pop()
            attrs = m["attrs"] or m["attrs2"] or ""
            bits, hides = 0, tag in UNSEEN
            if attrs.strip():
                for _, value in _ATTR.findall(attrs):
                    for word in _WORD.findall(_CAMEL.sub(" ", value).lower()):
                        bits |= _ATTR_BIT.get(word, 0)
                hides = hides or bool(_HIDDEN.search(attrs))
            node = self._node(stack[-1][1], 1 << _TAG[tag] if tag in _TAG else 0, bits, False)
            stack.append((tag, node, hides))
            n_open[tag] = n_open.get(tag, 0) + 1
            unseen += hides
        close_leaf()
        while len(stack) > 1:
            pop()
        self.end[root] = len(self.parent)

    def features(self) -> np.ndarray:
        n = len(self.parent)
        parent, end = np.array(self.parent), np.array(self.end)
        here = np.arange(n)
        leaf = np.array([t is not None for t in self.texts])
        chars = np.array([len(t) if t else 0 for t in self.texts], np.float64)
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.texts], np.float64)
        marks = np.array([len(_PUNCTUATION.findall(t)) if t else 0 for t in self.texts], np.float64)
        links = np.array(self.links, np.float64)

        def below(v: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0.0], np.cumsum(v)])
            return total[end] - total[here]

        c, w, m, k = below(chars), below(words), below(marks), below(links)
        nodes = below(np.ones(n))
        root = np.repeat(self.roots, np.diff([*self.roots, n]))
        before = np.concatenate([[0.0], np.cumsum(chars)])[here] - np.concatenate([[0.0], np.cumsum(chars)])[root]
        up = np.where(parent < 0, here, parent)
        children = np.bincount(up, parent >= 0, n)
        siblings = children[up]
        mean = np.where(siblings > 0, np.bincount(up, np.where(parent >= 0, c, 0), n)[up] / np.maximum(1, siblings), c)
        ratio = k / np.maximum(1, c)
        linked_siblings = np.bincount(up, np.where(parent >= 0, ratio, 0), n)[up] / np.maximum(1, siblings)
        page = np.maximum(1, c[root])
        numbers = [
            leaf, np.log1p(c), np.log1p(w), ratio, m / np.maximum(1, w), c / nodes, np.log1p(nodes), np.array(self.depth),
            c / page, before / page, (before + c) / page, np.log1p(children), np.log1p(siblings), np.log1p(mean), c / (mean + 1),
            linked_siblings, np.log1p(c / np.maximum(1, w)),
        ]
        bits = [(np.array(self.tags), len(TAG_GROUPS)), (np.array(self.above), len(TAG_GROUPS)), (np.array(self.attrs), len(ATTR_GROUPS)), (np.array(self.attrs_above), len(ATTR_GROUPS))]
        flags = [(b[:, None] >> np.arange(size)) & 1 for b, size in bits]
        return np.concatenate([np.stack(numbers, axis=1), *flags], axis=1).astype(np.float32)
