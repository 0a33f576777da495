"""Main text of web pages by tag-path ratios.

Every block of text outside scripts, styles and the like has a tag path: the block-level tags around it, with their
whole class tokens. Text length and punctuation are aggregated a path, smoothed up the tree of paths, fused, weighed by
what the tags, roles and class names say, and thresholded; the nodes of the paths that pass are the content, and with
them those of lesser paths that stand between or in one element with them. What names say is evidence only: a page
without any telling name gives its article by length, punctuation, links and place."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe svg title audio video".split()
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br math semantics mrow mi mn mo ms mtext mspace msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle".split())
#: Controls, whose text is none of the page's: up to their end tag, or, where that is missing, to the next tag of a block.
CONTROLS = frozenset("button select option optgroup".split())
#: A start tag of the key ends open elements of the value, up to a container.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
CONTAINERS = frozenset("ul ol dl menu table html body article main section div aside nav header footer form blockquote".split())

#: Elements, roles and class or id tokens that speak against main text. A token counts as a whole: one of the words,
#: alone or with the words for a place before it and for a part of a page after it.
ZONES = frozenset("head nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
WORDS = (
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner "
    "sidebar side rail nav navbar navigation menu breadcrumb breadcrumbs footer foot topbar toolbar cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments commentlist disqus reply replies respond pagination pager widget copyright legal disclaimer search skip"
).split()
#: Tokens that do so outside an article only; within, they mark its own heading.
HEADERS = frozenset("header masthead site-header page-header main-header global-header".split())
BEFORE = "site page main global top bottom left right primary secondary".split()
AFTER = "area bar banner block bottom box container content group inner item items left link links list menu notice panel policy posts right section slot stories text top unit widget wrap wrapper".split()
TELLING = re.compile(rf"(?:(?:{'|'.join(BEFORE)})[-_]?)?(?:{'|'.join(WORDS)})(?:[-_]?(?:{'|'.join(AFTER)}|[0-9]+))*")

#: Elements that hold the page or its main text, whatever their class says.
KEPT = frozenset("html body article main".split())
MARKS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a paragraph or a row, not a text.
LEAVES = HEADINGS | frozenset("p li dd dt td th tr pre address figcaption caption".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<control>button|select)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?:(?!</?(?:button|select|p|h[1-6]|article|section|main|ul|ol|table|form)[\s/>]).)*</(?P=control)\s*>|<(?:svg|math)(?=[\s/])(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^'\">])*|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
#: One attribute after another: name, and the value as quoted by either mark or by none.
ATTR = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、¿¡]")

#: What of an outer path's sums a path takes over in smoothing, for each step outwards.
OUTER = 0.7
#: The share of the best path's score from which a path is content, from which it is so outside the main element, and
#: from which it is so among content.
LEAST, LEAST_OUTSIDE, LEAST_WITHIN = 0.7, 0.8, 0.03
#: What the score of a path through a telling element counts, and that of one outside articles on a page that has them;
#: the share of the longest path's text below which a path's score falls with its text, and to what share at most.
ZONE_WEIGHT, UNMARKED_WEIGHT, LEAST_TEXT, LEAST_COUNT = 0.01, 0.3, 0.1, 0.3
#: A path whose text is links by more than this share is a list of links.
MAX_LINKS = 0.7
#: The innermost element that holds so much of the text, each block's times its score's square, is the page's main one.
MAIN_SHARE = 0.85
WEAK, STRONG = 1, 2
#: Characters of text that a form, or what a name speaks against, must hold to be the page itself where all is in such.
LEAST_FREED = 60


class Tree:
    """Nodes by number, each made after its parent; 0 is the root."""

    def __init__(self) -> None:
        self.parent, self.step, self.own, self.zone, self.marked = [0], [""], [0], [0], [False]
        self.known: dict[tuple[int, str, int], int] = {}

    def add(self, parent: int, step: str, zone: int = 0) -> int:
        marks = step.split(".")[0] in MARKS
        self.parent.append(parent)
        self.step.append(step)
        self.own.append(zone)
        self.zone.append(self._around(len(self.own) - 1))
        self.marked.append(marks or self.marked[parent])
        return len(self.parent) - 1

    def _around(self, i: int) -> int:
        """An article in a form that holds the page is no part of a form."""
        around = self.zone[self.parent[i]]
        return self.own[i] if self.step[i].split(".")[0] in MARKS and around == WEAK else max(self.own[i], around)

    def free_one(self, chars: list[float]) -> bool:
        """Of the outermost nodes that a name speaks against, or that are forms, the one below which most of the characters
        are counts as any other from now on. Menus, footers and the like stay what they are. Whether there was one."""
        below = self.sums(chars)
        named = [t == "form" or t not in ZONES | {"header"} for t in (s.split(".")[0] for s in self.step)]
        outer = [i for i in range(1, len(self.own)) if self.own[i] and not self.zone[self.parent[i]] and named[i] and below[i] >= LEAST_FREED]
        if not outer:
            return False
        self.own[max(outer, key=lambda i: below[i])] = 0
        for i in range(1, len(self.own)):
            self.zone[i] = self._around(i)
        return True

    def child(self, parent: int, step: str, zone: int) -> int:
        """The parent's one child of that name."""
        key = (parent, step, zone)
        if key not in self.known:
            self.known[key] = self.add(parent, step, zone)
        return self.known[key]

    def sums(self, own: list[float]) -> list[float]:
        """By node: the sum over it and all below it."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


@dataclass
class Block:
    """The text between two block-level tags, in an element and at a path."""

    path: int
    element: int
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _reading(tag: str, attrs: str, inside: bool) -> tuple[str, int]:
    """The element's step in its path, and whether it speaks against main text (0, WEAK for a form, STRONG)."""
    zone = tag in ZONES or tag == "header" and not inside
    tokens: set[str] = set()
    for name, a, b, c in ATTR.findall(attrs or ""):
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            tokens.update(value.split())
        if tag in KEPT or zone:
            continue
        zone = name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES
        if name in ("class", "id"):
            zone = any(TELLING.fullmatch(t) or t in HEADERS and not inside for t in value.split())
    return ".".join([tag, *sorted(tokens)]), (WEAK if tag == "form" else STRONG) if zone else 0


def blocks(page: str) -> tuple[list[Block], Tree, Tree]:
    """The blocks in page order, with white space and references resolved, the tree of their paths and that of the elements."""
    paths, elements = Tree(), Tree()
    stack: list[tuple[str, int, int]] = []  # open block-level elements: tag, path, element
    open_: Counter = Counter()
    found: list[Block] = []
    links = 0
    now = Block(0, 0, False)

    def close(to: int) -> None:
        for tag, _, _ in stack[to:]:
            open_[tag] -= 1
        del stack[to:]

    def flush() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join(html.unescape("".join(now.parts)).split())
            if now.text:
                found.append(now)
        tag, path, element = stack[-1] if stack else ("", 0, 0)
        now = Block(path, element, tag in HEADINGS)

    inline_zone: list[str] = []
    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not inline_zone:
                now.parts.append(text)
                if links:
                    now.linked += len(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE or tag in CONTROLS:
            if tag == "br":
                now.parts.append(" ")
            elif m["close"]:
                links = max(0, links - 1) if tag == "a" else links
                if tag in inline_zone:
                    del inline_zone[len(inline_zone) - 1 - inline_zone[::-1].index(tag) :]
            elif tag == "a":
                links += 1
            elif inline_zone and tag == inline_zone[-1] or tag in CONTROLS or tag == "span" and m["attrs"] and _reading(
                tag,
                m["attrs"],
                open_["article"] + open_["main"] > 0,
            )[1]:
                inline_zone.append(tag)
            continue
        links, inline_zone = 0, []
        if m["close"]:
            if open_[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            flush()
            continue
        if tag in VOID:
            flush()
            continue
        if stack and stack[-1][0] == "p":  # any block-level start tag ends a paragraph
            close(len(stack) - 1)
        if tag in ENDS:
            at = len(stack)
            while at and stack[at - 1][0] not in CONTAINERS and stack[at - 1][0] in ENDS[tag]:
                at -= 1
            close(at)
        if tag == "body" and open_["head"]:
            close(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if not m["attrs"].endswith("/"):
            step, zone = _reading(tag, m["attrs"], open_["article"] + open_["main"] > 0)
            _, path, element = stack[-1] if stack else ("", 0, 0)
            stack.append((tag, paths.child(path, step, zone), elements.add(element, tag)))
            open_[tag] += 1
        flush()
    flush()
    return found, paths, elements


def path_scores(found: list[Block], paths: Tree) -> list[float]:
    """By path: text and punctuation a node, each smoothed and taken relative to the largest, then fused and weighed.

    Smoothing: a path's sums are its own, and OUTER times those of all below the path one step out, and so on; so paths
    with more steps in common have more in common, at a cost linear in the steps. It goes out no further than the innermost
    path that more than half of the text that nothing speaks against is below, and not to one that all blocks are below."""
    size = len(paths.parent)
    nodes, chars, marks, linked = ([0.0] * size for _ in range(4))
    for b in found:
        nodes[b.path] += 1
        chars[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text)) + 1
        linked[b.path] += min(b.linked, len(b.text))
    free = [0.0 if k > MAX_LINKS * c else 1 - k / (c or 1) for c, k in zip(chars, linked)]
    any_marked = any(paths.marked[b.path] and not paths.zone[b.path] for b in found)
    weight = [ZONE_WEIGHT if z else UNMARKED_WEIGHT if any_marked and not m else 1.0 for z, m in zip(paths.zone, paths.marked)]
    own = [nodes, [c * f for c, f in zip(chars, free)], [m * f for m, f in zip(marks, free)]]
    below = [paths.sums(x) for x in own]
    plain = paths.sums([c * w for c, w in zip(own[1], weight)])
    outside = {0}
    inner, children = 0, _children(paths)
    while True:
        largest = next((i for i in children.get(inner, ()) if plain[i] * 2 > plain[0]), None)
        if largest is None:
            break
        outside.add(inner)
        inner = largest
    if below[0][inner] == below[0][0]:
        outside.add(inner)
    outer = [[0.0] * size for _ in own]  # what a path hands on to those one step further in
    smooth: list[tuple[float, float]] = []
    for i in range(size):
        n, text, punctuation = (x[i] + (OUTER * o[paths.parent[i]] if i else 0.0) for x, o in zip(own, outer))
        smooth.append((text / n, punctuation / n) if nodes[i] and free[i] else (0.0, 0.0))
        for o, b in zip(outer, below):
            o[i] = 0.0 if i in outside else b[i] + (OUTER * o[paths.parent[i]] if i else 0.0)
    most = [max(0.0 if z else s[i] for s, z in zip(smooth, paths.zone)) for i in (0, 1)]
    fused = [w * sum(min(1.0, v / m) for v, m in zip(s, most) if m) / 2 for s, w in zip(smooth, weight)]
    longest = LEAST_TEXT * max((c for c, z in zip(own[1], paths.zone) if not z), default=0.0)
    fused = [f * max(LEAST_COUNT, min(1.0, c / longest)) if f and longest else f for f, c in zip(fused, chars)]
    best = max(fused) if any(most) else 1.0
    return [f / best for f in fused]


def _children(tree: Tree) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i in range(1, len(tree.parent)):
        out.setdefault(tree.parent[i], []).append(i)
    return out


def content(found: list[Block], paths: Tree, elements: Tree) -> list[bool]:
    """Which blocks are main text. In the main element, all of paths from LEAST_WITHIN on, and outside those from
    LEAST_OUTSIDE on. Where that element, not being an article, holds the whole page: those of paths from LEAST on, and of those from
    LEAST_WITHIN on the ones between the first and the last of these. A heading goes with the next block that isn't one,
    if that stands in the heading's parent."""
    while found and all(paths.zone[b.path] for b in found):
        # What holds all of the page is the page, whatever it is called.
        chars = [0.0] * len(paths.parent)
        for b in found:
            chars[b.path] += len(b.text)
        if not paths.free_one(chars):
            break
    scores = path_scores(found, paths)
    score = [scores[b.path] for b in found]
    weight, each = [0.0] * len(elements.parent), [0.0] * len(elements.parent)
    for b, s in zip(found, score):
        weight[b.element] += len(b.text) * s * s
        each[b.element] += 1
    weight, each = elements.sums(weight), elements.sums(each)
    children, main = _children(elements), 0
    while True:
        largest = next((i for i in children.get(main, ()) if weight[i] >= MAIN_SHARE * weight[0] > 0), None)
        if largest is None:
            break
        main = largest
    while elements.step[main] in LEAVES or elements.marked[elements.parent[main]]:
        main = elements.parent[main]  # one that holds more than a paragraph; in an article, the whole of it
    if each[main] == each[0] and not elements.marked[main]:
        high = [i for i, s in enumerate(score) if s >= LEAST]
        first, last = (high[0], high[-1]) if high else (0, -1)
        kept = [s >= LEAST or s >= LEAST_WITHIN and first <= i <= last for i, s in enumerate(score)]
    else:
        within = [False] * len(elements.parent)
        for i in range(len(within)):
            within[i] = i == main or i > 0 and within[elements.parent[i]]
        kept = [s >= (LEAST_WITHIN if within[b.element] else LEAST_OUTSIDE) for b, s in zip(found, score)]
    for i in range(len(found) - 2, -1, -1):
        b, after = found[i], found[i + 1]
        if b.heading and not kept[i] and not paths.zone[b.path] and not after.heading and kept[i + 1]:
            kept[i] = elements.parent[b.element] == elements.parent[after.element]
    return kept


def main_text(page: str) -> str:
    """The blocks of main text in page order, joined by empty lines."""
    found, paths, elements = blocks(page)
    return "\n\n".join(b.text for b, yes in zip(found, content(found, paths, elements)) if yes)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(x.as_py() or "") for x in b.column("html")]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. Null html is empty and has no text; repeated rows give repeated
    rows; an empty table gives none; other columns are ignored. Each page is parsed whole and alone: no shuffle."""
    C.require(pages, id_col, url_col, html_col)
    given = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        pages[html_col].cast("string").alias("html"),
    )
    return given.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
