"""Leaf blocks of HTML pages, with the tags around them."""

import html
import re
from collections import Counter
from dataclasses import dataclass

COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.DOTALL)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
TAG_BORDER = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
SILENT = frozenset("script style noscript template iframe object svg math canvas title textarea select".split())
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
# An open element of these ends where one of the values begins.
ENDED_BY = {
    "p": frozenset(
        "p div ul ol dl table h1 h2 h3 h4 h5 h6 section article aside header footer nav main form blockquote pre hr "
        "figure address fieldset details".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}


MAIN = frozenset(["article", "main"])
FURNITURE_MARKS = frozenset(
    "ad ads advert advertisement sponsored promo banner nav navigation menu breadcrumb breadcrumbs sidebar side footer "
    "header masthead notice notices cookie cookies consent alert comment comments disqus respond reply share social "
    "related newsletter subscribe signup form search pagination popup modal toolbar widget".split()
)
# An element with this share of a page's text is a frame around the page, and with the smaller share it is one
# if it holds the headline or the main element.
FRAME_SHARE, HEADED_SHARE = 0.9, 0.5
# The element that a tag's beginning ends is looked for among so many open elements.
DEEPEST = 128


@dataclass
class Block:
    """Text between two block borders: its elements, and how much of it is linked.

    ``tags`` are the elements from outside in, each once outside and once from the main element on; the nearest one
    stands last. ``marks`` are the words of their classes, ids and roles.
    """

    text: str
    tags: tuple[str, ...]
    marks: tuple[str, ...]
    linked: int
    bold: bool = False


def _marks(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id and role, in lower case."""
    found = []
    for name, *values in ATTRIBUTE.findall(attributes):
        found += [w for w in re.split(r"[^a-z]+", next((v for v in values if v), "").lower()) if w]
    return tuple(found)


class _Page:
    """The elements and blocks of one page while it is read, each character once."""

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.parents, self.names, self.marks = [-1], [""], [()]  # of elements that are not inline; 0 is around all
        self.stack: list[tuple[str, int]] = []  # open elements, each with the innermost one that is not inline
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.found: list[tuple[str, int, int, bool]] = []
        self.without_end: set[str] = set()

    @property
    def around(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def close_block(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            bold = self.open["b"] + self.open["strong"] > 0
            self.found.append((text, self.around, min(self.linked, len(text)), bold))
        self.parts.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        if self.open["a"]:
            self.linked += len(text.strip())

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` is closed. Quoted values may hold the sign; a quote without an end counts for nothing."""
        start = at
        while border := TAG_BORDER.search(self.page, at):
            if border[1] is None:
                return border.start()
            at = self.page.find(border[1], border.end()) + 1
            if not at or at > self.last_end:
                break
        return self.page.find(">", start)

    def silent_end(self, tag: str, at: int) -> int | None:
        """Where a silent element's end tag ends, if it has one."""
        if tag in self.without_end:
            return None
        end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(self.page, at)
        if end is None:
            self.without_end.add(tag)
        return end and end.end()

    def push(self, tag: str, attributes: str) -> None:
        inner = self.around
        if tag not in INLINE:
            self.parents.append(inner)
            self.names.append(tag)
            self.marks.append(_marks(attributes))
            inner = len(self.names) - 1
        self.stack.append((tag, inner))
        self.open[tag] += 1

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop()[0]] -= 1

    def close(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self.pop_to(len(self.stack) - 1)
            self.pop_to(len(self.stack) - 1)

    def end_implied(self, tag: str) -> None:
        """Close what the beginning of ``tag`` ends: the nearest such element, with the inline elements in it."""
        if not any(self.open[t] for t in ENDED_BY):
            return
        for i in range(len(self.stack) - 1, max(len(self.stack) - DEEPEST, 0) - 1, -1):
            open_tag = self.stack[i][0]
            if tag in ENDED_BY.get(open_tag, ()):
                self.pop_to(i)
                return
            if open_tag not in INLINE and open_tag not in ENDED_BY:
                return

    def read(self) -> None:
        page, at = self.page, 0
        while at < len(page):
            start = page.find("<", at)
            if start < 0 or start > self.last_end and not page.startswith(("<!", "<?"), start):
                self.add(page[at:])
                return
            if start > at:
                self.add(page[at:start])
            if page.startswith(("<!", "<?"), start):
                at = COMMENT.match(page, start).end()
                continue
            found = TAG.match(page, start)
            end = self.tag_end(found.end()) if found else -1
            if end < 0:
                self.add("<")
                at = start + 1
                continue
            at = end + 1
            tag, closing = found[2].lower(), bool(found[1])
            if not closing and tag in SILENT:
                after = self.silent_end(tag, at)
                if after or tag in RAW:
                    at = after or len(page)
                    if tag not in INLINE:
                        self.close_block()
                    continue
            if tag == "br":
                self.parts.append("\n")
                continue
            if tag not in INLINE:
                self.close_block()
            if closing:
                self.close(tag)
            elif tag not in VOID:
                if tag not in INLINE:
                    self.end_implied(tag)
                self.push(tag, page[found.end() : end])

    def frames(self) -> list[bool]:
        """Which elements are around the page rather than parts of it: their classes say what the page has, not what its text is."""
        size, heads = [0] * len(self.names), [tag in MAIN for tag in self.names]
        for text, inner, *_ in self.found:
            size[inner] += len(text)
        if "h1" in self.names:
            heads[self.names.index("h1")] = True
        for i in range(len(self.names) - 1, 0, -1):
            size[self.parents[i]] += size[i]
            heads[self.parents[i]] |= heads[i]
        return [
            tag in ("html", "body") or n >= FRAME_SHARE * size[0] or (head and n >= HEADED_SHARE * size[0])
            for tag, n, head in zip(self.names, size, heads, strict=True)
        ]

    def blocks(self) -> list[Block]:
        frames = self.frames()
        paths: list[tuple[str, ...]] = [()]
        marks: list[tuple[str, ...]] = [()]
        known: dict[tuple, tuple[str, ...]] = {}
        for i in range(1, len(self.names)):
            parent, tag = self.parents[i], self.names[i]
            key = (paths[parent], tag)
            if key not in known:
                known[key] = _extended(*key)
            paths.append(known[key])
            own = [m for m in self.marks[i] if not (frames[i] and m in FURNITURE_MARKS)]
            more = tuple(dict.fromkeys(m for m in own if m not in marks[parent]))
            marks.append(marks[parent] + more if more else marks[parent])
        return [Block(text, paths[inner], marks[inner], linked, bold) for text, inner, linked, bold in self.found]


def _extended(path: tuple[str, ...], tag: str) -> tuple[str, ...]:
    """A path with one more element, which stands only once in its part."""
    main = next((i for i, t in enumerate(path) if t in MAIN), None)
    if main is None:
        return (*[t for t in path if t != tag], tag)
    return (*path[: main + 1], *[t for t in path[main + 1 :] if t != tag], tag)


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; none for null or an empty page.

    Text is decoded, its white space is single spaces, and empty blocks are left out. Inline elements
    do not part blocks; a line break is white space. Scripts, styles, comments, and the head have no
    text. Elements that are never closed end with the one around them. The time taken grows with the length of
    the page, also where it is broken.
    """
    reader = _Page(page or "")
    reader.read()
    reader.close_block()
    return reader.blocks()
