"""Main-text extraction by tag-path ratios.

A page is cut into blocks of text; each block has a root-to-leaf tag path
(formatting tags left out). For every path of the page the text length and the
number of punctuation marks per block are aggregated, both ratios are smoothed
over the neighbouring blocks in page order, fused by a product, and paths above
a threshold (a share of the text-weighted mean) become content nodes. The
content nodes fix the container (the deepest element that holds them together
with the headings beside them), and every block of that container is kept but
for those in navigation, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_or_empty

THRESHOLD = 0.3  # of the text-weighted mean of the fused ratios
KEPT_SHARE = 0.2  # hints that leave less of a page's text give way, largest subtree first
SMOOTH = np.array([0.25, 0.5, 0.25])

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDE = re.compile(r"(?:^|\s)(?:hidden(?=$|[\s=/])|style\s*=\s*[\"'][^\"']*display\s*:\s*none|aria-hidden\s*=\s*[\"']?true)", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，！？、؟،]")
_RAW = frozenset("script style noscript template textarea title iframe xmp".split())
_EMBEDDED = frozenset("svg math object canvas audio video".split())  # no text either, but an unclosed one hides nothing
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
_SPACE = frozenset("br img hr wbr".split()) - {"wbr"}
_DROP_TAGS = frozenset(
    "head nav header footer aside form button select fieldset dialog menu input option datalist".split()
)
_KEEP_TAGS = frozenset("html body main article".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAF = frozenset("p li dt dd pre blockquote h1 h2 h3 h4 h5 h6 tr td th caption figcaption figure ul ol dl table thead tbody tfoot address".split())
_NEUTRAL = frozenset("div section center".split())
_CLOSES = {  # start tag -> open tags that it ends, up to the boundary tags
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_BOUNDARY = frozenset("body article main section div td th li blockquote table form aside nav header footer button".split())
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adbox adslot banner promo promoted promotion "
    "sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert menu menus nav navbar "
    "navigation navi breadcrumb breadcrumbs sidebar sidebars aside comment comments commentlist disqus respond replies reply "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "footer header masthead topbar toolbar widget widgets pagination pager skip search tags tagcloud copyright toc".split()
)
_TALK = frozenset("comment comments commentlist disqus respond replies reply".split())  # may well be most of a page
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def _boilerplate(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no part of an article by its tag or role, or because it is hidden."""
    if name in _DROP_TAGS:
        return not (name == "header" and inside)
    if not attrs or (name in _KEEP_TAGS and not inside):
        return False
    return bool(_HIDE.search(attrs)) or any(_value(found).strip().lower() in _ROLES for found in _ATTR.findall(attrs) if found[0].lower() == "role")


def _value(found: tuple) -> str:
    return next((v for v in found[1:] if v), "")


def _hints(name: str, attrs: str, inside: bool) -> set[str]:
    """Words of class and id that speak for boilerplate."""
    if not attrs or (name in _KEEP_TAGS and not inside):
        return set()
    words = (w.lower() for found in _ATTR.findall(attrs) if found[0].lower() != "role" for w in _WORD.findall(_value(found)))
    return {w for w in words if w in _HINTS}


class _Element:
    __slots__ = ("article_header", "drop", "hinted", "inside", "key", "name", "parent", "talk")

    def __init__(self, name: str, attrs: str, parent: _Element | None):
        self.name, self.parent = name, parent
        above = parent is not None
        self.inside = above and (parent.inside or parent.name in ("article", "main"))
        self.drop = (above and parent.drop) or _boilerplate(name, attrs, self.inside)
        hints = _hints(name, attrs, self.inside)
        self.hinted, self.talk = bool(hints), bool(hints & _TALK)
        self.article_header = (above and parent.article_header) or (name == "header" and self.inside)
        mark = ""
        if attrs:
            found = next((m for m in _ATTR.findall(attrs) if m[0].lower() == "class"), None)
            if found:
                mark = "." + ".".join(sorted(_value(found).split()))
        self.key = (parent.key if above else "") + "/" + name + mark

    def chain(self) -> Iterator[_Element]:
        e: _Element | None = self
        while e is not None:
            yield e
            e = e.parent


class _Block:
    __slots__ = ("element", "link", "text")

    def __init__(self, element: _Element, text: str, link: int):
        self.element, self.text, self.link = element, text, link


def _blocks(page: str) -> list[_Block]:
    """All blocks of a page in order, with white space folded and references decoded."""
    out: list[_Block] = []
    stack = [_Element("", "", None)]  # block elements only
    inline: list[str] = []  # open formatting tags of the current block
    parts: list[str] = []
    linked: list[str] = []
    hidden = 0  # open formatting tags that are boilerplate by class

    def flush() -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append(_Block(stack[-1], text, len(" ".join(_html.unescape("".join(linked)).split()))))
            parts.clear()
            linked.clear()

    def put(text: str) -> None:
        if text and not hidden:
            parts.append(text)
            if "a" in inline:
                linked.append(text)

    def leave(to: int) -> None:
        nonlocal hidden
        flush()
        del stack[to:]
        inline.clear()
        hidden = 0

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        put(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                put(page[lt + 9 : size if end < 0 else end].replace("&", "&amp;"))
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if nxt.isascii() and nxt.isalpha() or nxt == "/":
                break  # a tag that the page's end cuts off
            put("<")
            at = lt + 1
            continue
        at = m.end()
        name, attrs = m[1].lower(), m[2]
        if nxt == "/":
            if name in _INLINE:
                if name in inline:
                    while inline and inline.pop() != name:
                        pass
                    hidden = max(0, min(hidden, len(inline)))
            elif name == "p" and not any(e.name == "p" for e in stack):
                flush()
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        leave(k)
                        break
            continue
        if name in _RAW or name in _EMBEDDED:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if close is not None:
                    end = page.find(">", close.end())
                    at = size if end < 0 else end + 1
                elif name in _RAW:
                    break
            continue
        if name in _SPACE:
            put(" ")
            continue
        if name in _VOID:
            continue
        if name in _INLINE:
            if not attrs.rstrip().endswith("/"):
                inline.append(name)
                if hidden or (attrs and _boilerplate(name, attrs, True)):
                    hidden = hidden or len(inline)
            continue
        flush()
        inline.clear()
        hidden = 0
        for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
            if stack[k].name == "p":
                leave(k)
                break
            if stack[k].name in _P_BOUNDARY:
                break
        ends, bounds = _CLOSES.get(name, (None, None))
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in bounds:
                    break
                if stack[k].name in ends:
                    leave(k)
                    if name != "tr":
                        break
        if name in ("html", "body") and any(e.name == name for e in stack):
            continue
        if name == "body":
            leave(next((k for k, e in enumerate(stack) if e.name == "head"), len(stack)))
        stack.append(_Element(name, attrs, stack[-1]))
    flush()
    return out


def _is_menu(group: list[_Block]) -> bool:
    return len(group) >= 3 and sum(b.link for b in group) >= 0.9 * sum(len(b.text) for b in group)


def path_scores(blocks: list[_Block]) -> tuple[np.ndarray, np.ndarray]:
    """Fused tag-path ratios of the blocks (in page order): smoothed over neighbours, and those of the paths alone."""
    paths: dict[str, int] = {}
    of = np.array([paths.setdefault(b.element.key, len(paths)) for b in blocks])
    chars = np.array([len(b.text) - b.link for b in blocks], float)
    marks = np.array([len(_PUNCT.findall(b.text)) for b in blocks], float)
    count = np.bincount(of)
    text_ratio = (np.bincount(of, chars) / count)[of]
    mark_ratio = (np.bincount(of, marks) / count)[of]

    def smooth(x: np.ndarray) -> np.ndarray:
        padded = np.concatenate([x[:1], x, x[-1:]])
        return SMOOTH[0] * padded[:-2] + SMOOTH[1] * padded[1:-1] + SMOOTH[2] * padded[2:]

    def fuse(text: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.log1p(text) * (1 + np.log1p(mark))

    return fuse(smooth(text_ratio), smooth(mark_ratio)), fuse(text_ratio, mark_ratio)


def _without_hinted(blocks: list[_Block]) -> list[_Block]:
    """Blocks outside of hinted subtrees. Where that leaves next to nothing of the page's text, the hinted
    element with most of it is taken for a wrapper and its hint ignored, and so on."""
    mass = [len(b.text) - b.link for b in blocks]
    hinted = [[e for e in b.element.chain() if e.hinted] for b in blocks]
    held: dict[int, int] = {}
    elements: dict[int, _Element] = {}  # with some sentence in them
    for b, m, found in zip(blocks, mass, hinted):
        for e in found:
            held[id(e)] = held.get(id(e), 0) + m
            if _PUNCT.search(b.text):
                elements[id(e)] = e
    while True:
        kept = [not any(e.hinted for e in found) for found in hinted]
        left = sum(m for m, k in zip(mass, kept) if k)
        if left >= KEPT_SHARE * sum(mass):
            break
        wrappers = [i for i, e in elements.items() if e.hinted and held[i] * 2 >= sum(mass) and (not e.talk or left == 0)]
        if not wrappers:
            break
        elements[max(wrappers, key=held.__getitem__)].hinted = False
    return [b for b, k in zip(blocks, kept) if k]


def extract(page: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of one page (empty for NULL, empty and text-free pages)."""
    if not page:
        return ""
    blocks = _without_hinted([
        b for b in _blocks(page)
        if not b.element.drop and (not b.element.article_header or b.element.name in _HEADINGS)
    ])
    lists: dict[int, list[_Block]] = {}
    for b in blocks:
        if b.element.name == "li" and b.element.parent is not None and not b.element.inside:
            lists.setdefault(id(b.element.parent), []).append(b)
    menus = {id(b) for group in lists.values() if _is_menu(group) for b in group}
    if len(menus) < len(blocks):
        blocks = [b for b in blocks if id(b) not in menus]
    if not blocks:
        return ""
    scores, alone = path_scores(blocks)
    weight = np.array([len(b.text) for b in blocks], float)
    cut = threshold * float((scores * weight).sum() / weight.sum())
    seeds = scores >= cut

    above: list[list[int]] = []
    elements: dict[int, _Element] = {}
    for b in blocks:
        chain, e = [], b.element
        while e is not None:
            chain.append(id(e))
            elements[id(e)] = e
            e = e.parent
        above.append(chain[::-1])
    depth, members = 0, list(range(len(blocks)))
    while True:
        here = elements[above[members[0]][depth]]
        if here.name in ("article", "main"):
            break
        mass: dict[int, float] = {}
        for i in members:
            if len(above[i]) > depth + 1 and seeds[i]:
                child = above[i][depth + 1]
                mass[child] = mass.get(child, 0.0) + weight[i]
        if not mass:
            break
        best = max(mass, key=mass.__getitem__)
        if elements[best].name in _LEAF:
            break
        lost = [i for i in members if len(above[i]) <= depth + 1 or above[i][depth + 1] != best]
        semantic = elements[best].name in ("article", "main")
        if not semantic and any(seeds[i] or blocks[i].element.name in _HEADINGS for i in lost):
            break
        members = [i for i in members if len(above[i]) > depth + 1 and above[i][depth + 1] == best]
        depth += 1
    # inside the container the ratios decide on elements that say nothing about their content
    return "\n".join(blocks[i].text for i in members if alone[i] >= cut or blocks[i].element.name not in _NEUTRAL)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url, main text and the text's code points.

    A NULL html gives an empty text. Each page is handled on its own, so rows
    stay in their partition (no shuffle) and memory holds one page at a time.
    """
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("_lm_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return src.mapInArrow(run, schema)
