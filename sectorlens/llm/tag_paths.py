"""Main text of web pages by tag-path ratios.

A page's text falls into blocks. For each root-to-leaf path of block tags the text
length, the punctuation marks and the linked text of its blocks are added up; the
path's length and punctuation per block are fused into one ratio, damped by the
linked share. Ratios are smoothed along the page, averaged per path again, and
paths at a share of the best one or more select content nodes. They decide twice:

* The lowest element that holds all content nodes, widened to the outermost article
  or main element around it, is the container; what lies beside it goes.
* In the container, all that stands between the first and the last content node stays.
  Before and after them, blocks of paths that were not selected go if most of their
  text is linked (menus, link bars); headings, lists and other text there stay.

Elements that their tag, role, class or id mark as menus, headers, footers, sidebars,
notices, adverts, forms or reader comments are vetoed whatever their paths' ratios.

Cases: a null or empty page, or one without text, gives an empty text; text outside
any tag is a block of its own; tags that are never closed end with their parent; time
and memory are linear in the page, however deep or broken; pages are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import slices

#: Fixed lists: names from the HTML standard, and words that mark parts of a page beside its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
NOISE_TAGS = frozenset("head nav footer aside form menu dialog button fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations widget widgets toolbar login signup pagination pager masthead".split())
OUTSIDE_ARTICLE = frozenset("header".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "body": {"head"}}
KEEPS_P = frozenset("button td th table article section div li body".split())
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?…。，、！？؟।]")
KEEP_SHARE = 0.3


class Element:
    __slots__ = ("depth", "first", "inside", "last", "link", "name", "noise", "parent", "path")

    def __init__(self, name: str, parent: Element | None, first: int = 0, noise: bool = False, path: int = 0):
        self.name, self.parent, self.path = name, parent, path
        self.first = self.last = first  # numbers, in the order of opening, of the element and the last one in it
        self.depth = parent.depth + 1 if parent is not None else 0
        self.noise = noise or (parent is not None and parent.noise)
        self.link = name == "a" or (parent is not None and parent.link)
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def is_noise(name: str, raw: str, inside: bool) -> tuple[bool, str]:
    """Whether the element stands beside the article, and the first of its classes."""
    if name in NOISE_TAGS or (name in OUTSIDE_ARTICLE and not inside):
        return True, ""
    if not raw or raw.isspace():
        return False, ""
    a = attributes(raw)
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) or a.get("role", "") in NOISE_ROLES:
        return True, ""
    label = a.get("class", "")
    if name not in ("html", "body", "article", "main"):
        words = {w.lower() for w in WORDS.findall(f"{label} {a.get('id', '')}")}
        if words & NOISE_WORDS or (not inside and words & OUTSIDE_ARTICLE):
            return True, ""
    return False, label.split()[0] if label.split() else ""


_shut: dict[str, re.Pattern] = {}
LISTS = frozenset("ul ol table dl select".split())


class Open:
    """The open elements, with the places of each name, so that no tag has to look through all of them."""

    def __init__(self) -> None:
        self.root = Element("", None)
        self.stack, self.at, self.blocks = [self.root], {}, [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.made = 0

    def add(self, name: str, noise: bool, label: str) -> None:
        parent = self.stack[-1]
        path = parent.path if name in INLINE else self.paths.setdefault((parent.path, f"{name}.{label}" if label else name), len(self.paths) + 1)
        self.made += 1
        self.at.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(Element(name, parent, self.made, noise, path))

    def cut(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > place:
            e = self.stack.pop()
            e.last = self.made
            self.at[e.name].pop()
            if e.name not in INLINE:
                self.blocks.pop()

    def place(self, names: frozenset[str] | set[str]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, names: frozenset[str] | set[str], least: int = 0) -> None:
        """Close the innermost of these elements if it is within the element at place `least`."""
        place = self.place(names)
        if place > least:
            self.cut(place)

    def block(self) -> Element:
        return self.stack[self.blocks[-1]]


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in page order."""
    out: list[Block] = []
    open_ = Open()
    parts: list[tuple[str, bool]] = []
    owner = open_.root
    never_shut: set[str] = set()

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                out.append(Block(owner, text, sum(len(t.strip()) for t, link in parts if link)))
            parts.clear()

    def add(raw: str) -> None:
        nonlocal owner
        if raw:
            if not parts:
                owner = open_.block()
            if not open_.stack[-1].noise:
                parts.append((entities.unescape(raw), open_.stack[-1].link))

    at, end, last = 0, len(page), page.rfind(">") + 1
    last = end if page.find("<!--", last) >= 0 else last  # no tag ends beyond, though a comment may go on to the end
    while at < end:
        m = TOKEN.search(page, at, last)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        block = name not in INLINE
        if block:
            flush()
        elif name in ("br", "img", "wbr"):
            if name == "br" and parts:
                parts.append((" ", False))
            continue
        if m[1]:
            open_.close({name}, 0 if block else open_.blocks[-1])
            continue
        if name in RAW:
            if name not in _shut:
                _shut[name] = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I)
            shut = _shut[name].search(page, at) if name not in never_shut else None
            if shut is None:
                never_shut.add(name)
            at = shut.end() if shut else (end if name in ("script", "style") else at)
            continue
        if name in VOID:
            continue
        if block:
            open_.close(CLOSES.get(name, set()), open_.place(LISTS - {name} if name != "p" else KEEPS_P))
            if name != "p":
                open_.close({"p"}, open_.place(KEEPS_P))
        elif name == "a":
            open_.close({"a"}, open_.blocks[-1])
        if m[3].endswith("/") and name in ("svg", "path"):
            continue
        open_.add(name, *is_noise(name, m[3], open_.stack[-1].inside))
    flush()
    open_.cut(1)
    open_.root.last = open_.made
    return out


def path_ratios(page: list[Block]) -> dict[int, float]:
    """Per tag path the fused and smoothed ratio of text length and punctuation."""
    totals: dict[int, list[int]] = {}
    for b in page:
        t = totals.setdefault(b.element.path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), len(MARKS.findall(b.text)), b.linked)):
            t[i] += x
    raw = {p: math.log1p(chars / n) * math.log1p(marks / n) * (1 - min(1.0, linked / chars)) for p, (n, chars, marks, linked) in totals.items()}
    row = [raw[b.element.path] for b in page]
    smooth: dict[int, list[float]] = {}
    for i, b in enumerate(page):
        near = row[max(0, i - 1) : i + 2]
        smooth.setdefault(b.element.path, []).append((row[i] + sum(near)) / (1 + len(near)))
    return {p: sum(v) / len(v) for p, v in smooth.items()}


def common(a: Element, b: Element) -> Element:
    """The lowest element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_blocks(page: str) -> list[str]:
    found = [b for b in blocks(page) if not b.element.noise]
    if not found:
        return []
    ratios = path_ratios(found)
    least = KEEP_SHARE * max(ratios.values())
    content = [b.element.parent or b.element for b in found if ratios[b.element.path] >= least]
    # elements are numbered as they open, so the outermost two tell what holds all
    holder = common(min(content, key=lambda e: e.first), max(content, key=lambda e: e.first))
    best, e = holder, holder
    while e is not None:
        best, e = (e if e.name in ("article", "main") else best), e.parent
    inside = [b for b in found if best.first <= b.element.first <= best.last]
    chosen = [i for i, b in enumerate(inside) if ratios[b.element.path] >= least]
    return [b.text for i, b in enumerate(inside) if chosen[0] <= i <= chosen[-1] or 2 * b.linked <= len(b.text)]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """The columns of pages, without the page source, plus the main text."""
    rest = [f for f in pages.schema.fields if f.name.lower() not in {html.lower(), text.lower()}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, html):
                texts = pa.array([main_text(x) for x in batch.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), texts], [*(f.name for f in rest), text])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(text, T.StringType())]))
