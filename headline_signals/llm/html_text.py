"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with the path of tags from the root to it.
Per path, text length and punctuation are summed over its blocks and divided by their
number. Both ratios are smoothed along the page, fused with the share of text outside
links and with what the path's names say, and paths over a threshold find the content's
root: the article or main element around them, else the deepest element that covers them.
All blocks under the root stay, lists, tables and links too, but for frames (menus,
adverts, comments ...). A frame that holds the page's main element or most of its prose
is none, whatever its names say.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's element kinds.
RAW_TAGS = "script style noscript template iframe svg canvas textarea title select audio video annotation annotation-xml"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
#: A start tag that ends an open element of the second set, up to one of the third.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
# Names that tell what an element is for.
FRAME_TAGS = frozenset("nav footer aside form button dialog menu head fieldset search header".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu "
                        "menubar toolbar".split())
FRAME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended recommendations comment comments commentlist reply replies "
    "respond disqus discussion feedback widget widgets toolbar pagination pager copyright legal disclaimer tags "
    "teaser trending outbrain taboola paywall".split())
#: Those that hold prose of their own: beside an article's text, however short, they stay frames.
OTHER_PROSE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promos promotion teaser related recommended "
    "recommendations trending comment comments commentlist reply replies respond disqus discussion feedback cookie "
    "cookies consent gdpr popup modal newsletter outbrain taboola".split())
#: Inside an article or main element these names and tags may also be the content's own (a section called
#: discussion, a list of steps): there they are frames only if what they hold looks like one.
DOUBTFUL_NAMES = frozenset(
    "side menu menus header masthead legal notice notices notification alert social related discussion feedback tags "
    "trending copyright disclaimer toolbar overlay subscription".split())
DOUBTFUL_TAGS = frozenset(["menu", "dialog"])
#: A doubtful element is content if at most this share of its text is in links.
LINKED_SHARE = 0.2
MAIN_TAGS = frozenset(["article", "main"])
ROOT_TAGS = frozenset(["html", "body"])
#: How surely an element is a frame: by a name or a form, by a tag, role or name of other prose, or hidden.
PART, WHOLE, HIDDEN = 1, 2, 3
PART_TAGS = frozenset(["form", "fieldset"])

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<svg(?=[\s/])[^>]*?/>"
    rf"|<(?P<raw>{'|'.join(RAW_TAGS.split())})(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Smoothing over the blocks before and after, by distance.
KERNEL = (1.0, 0.6, 0.2)
#: How much a path outside the main element counts where a page has one.
OUTSIDE = 0.05
#: A path is content from this share of the page's text-weighted mean score on.
THRESHOLD = 0.3
#: A ``WHOLE`` frame that holds most prose is none if less than this share of it is outside frames.
LEFT_OUTSIDE = 0.25


@dataclass(eq=False)
class Element:
    tag: str
    label: str
    framed: int
    main: bool
    heads: bool
    prose: int = 0
    #: Framed by its tag or by names that may be the content's own.
    doubtful: bool = False


@dataclass
class Block:
    path: str
    text: str
    linked: int
    within: list[Element]

    @property
    def frame(self) -> bool:
        return any(e.framed for e in self.within)

    @property
    def main(self) -> bool:
        return any(e.heads for e in self.within)

    @property
    def prose(self) -> int:
        """Characters outside links, if the text has punctuation."""
        return len(self.text) - self.linked if PUNCTUATION.search(self.text) else 0


@dataclass
class _Page:
    """The open elements and the blocks so far."""

    stack: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0

    def end_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                path = "/".join(e.label for e in self.stack if e.tag in BLOCK_TAGS)
                within = [e for e in self.stack if e.tag in BLOCK_TAGS or e.framed or e.heads]
                self.blocks.append(Block(path, text, min(self.linked, len(text)), within))
            self.parts.clear()
        self.linked = 0

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.links:
            self.linked += len(piece.strip())

    def pop_to(self, place: int) -> None:
        self.links -= sum(e.tag == "a" for e in self.stack[place:])
        del self.stack[place:]

    def start(self, tag: str, rest: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
            tags = [e.tag for e in self.stack]
            if "p" in tags:
                self.pop_to(tags.index("p"))
            if tag in IMPLIED_ENDS:
                ended, scope = IMPLIED_ENDS[tag]
                for place in range(len(self.stack) - 1, -1, -1):
                    if self.stack[place].tag in scope:
                        break
                    if self.stack[place].tag in ended:
                        self.pop_to(place)
        if tag in VOID_TAGS or rest.endswith("/") and tag not in BLOCK_TAGS:
            if tag == "br":
                self.parts.append(" ")
            return
        over_main = bool(self.stack) and self.stack[-1].main
        names, whole, hidden = _names(rest) if "=" in rest or "hidden" in rest else (set(), set(), False)
        heads = tag in MAIN_TAGS or "role:main" in names
        framed = HIDDEN if hidden or tag == "head" else 0
        if not framed and tag in FRAME_TAGS and not (tag == "header" and over_main):
            framed = PART if tag in PART_TAGS else WHOLE
        doubtful = over_main and framed == WHOLE and tag in DOUBTFUL_TAGS
        if (framed < WHOLE or doubtful) and names and tag not in ROOT_TAGS:
            said = names & FRAME_NAMES
            if over_main and said and said <= DOUBTFUL_NAMES:
                doubtful, framed, whole = True, framed or PART, set()
            elif said:
                doubtful = False
            if said == {"header"} and over_main:
                said = set()
            if said & whole & OTHER_PROSE or any(f"role:{r}" in names for r in FRAME_ROLES):
                framed, doubtful = WHOLE, False
            elif said and not heads and not framed:
                framed = PART
        label = tag + "".join(f".{n}" for n in sorted(names)) if tag in BLOCK_TAGS else tag
        self.stack.append(Element(tag, label, framed, over_main or heads, heads, doubtful=doubtful))
        if tag == "a":
            self.links += 1

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
        for place in range(len(self.stack) - 1, -1, -1):
            if self.stack[place].tag == tag:
                self.pop_to(place)
                return
            if tag not in BLOCK_TAGS and self.stack[place].tag in BLOCK_TAGS:
                return


def _names(rest: str) -> tuple[set[str], set[str], bool]:
    """Words of the element's class and id and its role, whole classes and id, and whether it is hidden."""
    names, whole, hidden = set(), set(), False
    for key, *values in ATTRIBUTE.findall(rest):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            names.update(w.lower() for w in NAME.findall(value))
            whole.update(value.lower().split())
        elif key == "role":
            names.add(f"role:{value.strip().lower()}")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or (
                key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
    return names, whole, hidden


def page_blocks(page: str) -> list[Block]:
    """All text blocks of a page in order; what a cut-off tag at the end says is not text."""
    state, at = _Page(), 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            state.text(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None or at == len(page) and not page.endswith(">"):
            continue
        if m.group("end"):
            state.end(tag.lower())
        else:
            state.start(tag.lower(), m.group("rest"))
    if at < len(page):
        state.text(page[at:])
    state.end_block()
    _lift(state.blocks)
    return state.blocks


def _lift(blocks: list[Block]) -> None:
    """Elements that their tag or names make frames, but that hold the content, are none."""
    held: dict[int, list] = {}
    for b in blocks:
        for e in b.within:
            if e.doubtful:
                sums = held.setdefault(id(e), [e, 0, 0, 0])
                sums[1:] = sums[1] + len(b.text), sums[2] + b.linked, sums[3] + b.prose
    for e, length, linked, prose in held.values():
        if linked <= LINKED_SHARE * length and (prose or e.tag in DOUBTFUL_TAGS):
            e.framed = 0
    total = outside = 0
    elements: dict[int, Element] = {}
    free_main = False
    for b in blocks:
        if any(e.framed == HIDDEN for e in b.within):
            continue
        prose = b.prose
        total += prose
        free = True
        for e in b.within:
            e.prose += prose
            elements[id(e)] = e
            free = free and not e.framed
            free_main = free_main or free and e.heads
        outside += prose if free else 0
    heads = [e for e in elements.values() if e.heads]
    if heads and not free_main:
        most = max(heads, key=lambda e: e.prose)
        within = next(b.within for b in blocks if most in b.within)
        for e in within[:within.index(most) + 1]:
            if e.framed == PART or outside < LEFT_OUTSIDE * most.prose:
                e.framed = 0
    for e in elements.values():
        if e.framed and 2 * e.prose > total and (e.framed == PART or outside < LEFT_OUTSIDE * e.prose):
            e.framed = 0


def _smoothed(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for distance in range(-len(KERNEL) + 1, len(KERNEL)):
            if 0 <= i + distance < len(values):
                total += KERNEL[abs(distance)] * values[i + distance]
                weight += KERNEL[abs(distance)]
        out.append(total / weight)
    return out


def content_paths(blocks: list[Block]) -> set[str]:
    """The paths whose fused ratio passes the threshold."""
    sums: dict[str, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, v in enumerate((1, len(b.text), len(PUNCTUATION.findall(b.text)), b.linked)):
            s[i] += v
    lengths = _smoothed([math.log1p(sums[b.path][1] / sums[b.path][0]) for b in blocks])
    marks = _smoothed([math.log1p(sums[b.path][2] / sums[b.path][0]) for b in blocks])
    any_main = any(b.main and not b.frame for b in blocks)
    score: dict[str, list[float]] = {}
    for b, length, mark in zip(blocks, lengths, marks):
        own = sums[b.path]
        fused = length * (1 + mark) * (1 - own[3] / own[1]) ** 2
        said = 0.0 if b.frame else OUTSIDE if any_main and not b.main else 1.0
        score.setdefault(b.path, []).append(fused * said)
    ratio = {path: sum(v) / len(v) for path, v in score.items()}
    weight = sum(len(b.text) for b in blocks if ratio[b.path] > 0)
    if not weight:
        return set()
    mean = sum(ratio[b.path] * len(b.text) for b in blocks) / weight
    return {path for path, r in ratio.items() if r > 0 and r >= THRESHOLD * mean}


def _children_in(blocks: list[Block], root: Element | None) -> list[tuple[Element | None, list[int]]]:
    """The parts of ``root`` (None: of the page): what block of each child, in order."""
    found: dict[int, tuple[Element | None, list[int]]] = {}
    for i, b in enumerate(blocks):
        if root is None or root in b.within:
            depth = 0 if root is None else b.within.index(root) + 1
            child = b.within[depth] if depth < len(b.within) else None
            found.setdefault(id(child) if child else -1 - i, (child, []))[1].append(i)
    return list(found.values())


def content_blocks(blocks: list[Block]) -> list[Block]:
    """All blocks but frames under the root of what passes.

    Outside any article or main element, where the passing paths meet only in the page's
    body, its parts before or after all of them that are mostly links are menus.
    """
    chosen = content_paths(blocks)
    blocks = [b for b in blocks if not b.frame]
    passing = [b for b in blocks if b.path in chosen]
    if not passing:
        return []
    mains = {id(e) for b in passing for e in [next((e for e in b.within if e.heads), None)] if e}
    if mains:
        return [b for b in blocks if b.path in chosen or any(id(e) in mains for e in b.within)]
    shared = passing[0].within
    for b in passing[1:]:
        same = 0
        while same < min(len(shared), len(b.within)) and shared[same] is b.within[same]:
            same += 1
        shared = shared[:same]
    # a lone passing block is covered by itself; its root is what holds it
    if shared and all(shared[-1] is b.within[-1] for b in passing) and shared[-1].tag not in ROOT_TAGS and len(shared) > 1:
        shared = shared[:-1]
    root = shared[-1] if shared else None
    if root is not None and root.tag not in ROOT_TAGS:
        return [b for b in blocks if root in b.within]
    passes = [i for i, b in enumerate(blocks) if b.path in chosen]
    kept: list[int] = []
    for _, part in _children_in(blocks, root):
        between = part[-1] > passes[0] and part[0] < passes[-1] or any(blocks[i].path in chosen for i in part)
        linked, length = (sum(v) for v in zip(*[(blocks[i].linked, len(blocks[i].text)) for i in part]))
        if between or 2 * linked <= length:
            kept += part
    return [blocks[i] for i in sorted(kept)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(b.text for b in content_blocks(page_blocks(page)))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``text_col`` (main text; a null, empty or textless
    page gives the empty string). A column already named ``text_col`` is replaced; repeated
    rows and null ids pass through, an empty table stays empty. Pages are read whole and
    independently of each other."""
    kept = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                block = batch.slice(start, 256)
                texts = [main_text(h) for h in block.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[block.column(f.name) for f in kept], pa.array(texts, pa.string())],
                                                 names=[*[f.name for f in kept], text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return pages.mapInArrow(run, f"{schema + ', ' if schema else ''}`{text_col}` string")
