"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame

from memlake.llm.batches import map_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([A-Za-z_:-]+)""")
_PART = re.compile(r"[a-z]+")

# Elements whose content is no text, those that begin and end blocks, and those without end.
SILENT = frozenset("script style noscript template textarea select option button iframe object svg math canvas audio video head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that stay open until their end tag; paragraphs, list items and the like end where the next block begins.
HOLDERS = BLOCKS - HEADINGS - frozenset("p hr li dd dt td th tr html body legend caption summary pre".split())

# Elements, roles and parts of class or id that mark what is not the article.
ASIDE = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr "
    "notice notices newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments disqus replies respond related recommended share sharing social "
    "popup modal overlay login toolbar pagination pager skip alert".split()
)
MAIN = frozenset(("article", "main"))


@dataclass
class Block:
    """A stretch of text between block elements, and what its place says of it."""

    text: str
    words: int
    link_words: int
    aside: bool
    main: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


@dataclass
class _Holder:
    name: str
    aside: bool
    main: bool


def _marks_aside(name: str, attributes: str, inside_main: bool) -> bool:
    if name in ASIDE or name == "header" and not inside_main:
        return True
    if name in ("body", "html") or name in MAIN and not inside_main or not attributes.strip(" /"):
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        key = (match[1] or match[5]).lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if key in ("class", "id") and any(part in HINTS for part in _PART.findall(value)):
            return True
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
    return False


class _Reader:
    def __init__(self):
        self.blocks: list[Block] = []
        self.holders: list[_Holder] = [_Holder("", False, False)]
        self.pieces: list[tuple[str, bool]] = []
        self.link = self.heading = False
        #: Of the open paragraph, list item or heading itself, which end with the next block.
        self.own_aside = False

    def text(self, piece: str) -> None:
        if piece:
            self.pieces.append((unescape(piece), self.link))

    def flush(self) -> None:
        if self.pieces:
            words = "".join(text for text, _ in self.pieces).split()
            if words:
                linked = sum(len(text.split()) for text, link in self.pieces if link)
                place = self.holders[-1]
                self.blocks.append(
                    Block(" ".join(words), len(words), min(linked, len(words)), place.aside or self.own_aside, place.main, self.heading)
                )
            self.pieces = []

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.pieces.append((" ", False))
        elif name == "a":
            self.link = True
        elif name in BLOCKS:
            self.flush()
            self.heading, place = name in HEADINGS, self.holders[-1]
            aside = _marks_aside(name, attributes, place.main)
            self.own_aside = aside and name not in HOLDERS
            if name in HOLDERS:
                self.link = False
                self.holders.append(_Holder(name, place.aside or aside, place.main or name in MAIN))

    def end(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif name in BLOCKS:
            self.flush()
            self.heading = self.own_aside = False
            if name in HOLDERS:
                for i in range(len(self.holders) - 1, 0, -1):
                    if self.holders[i].name == name:
                        del self.holders[i:]
                        self.link = False
                        break


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page, in order. Character references are decoded, white space runs are one space."""
    reader, at = _Reader(), 0
    while match := _MARKUP.search(html, at):
        reader.text(html[at : match.start()])
        at = match.end()
        name = match["name"] or match["name2"]
        if name is None:
            if match[0].startswith("<![CDATA["):
                reader.text(match[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if match["end"] or match["end2"]:
            reader.end(name)
        elif name in SILENT:
            if name == "head":
                reader.flush()
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>|<body(?=[\s>])" if name == "head" else rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE)
            found = closing.search(html, at)
            if not found:
                at = len(html)
            else:
                at = found.start() if found[0][1] != "/" else found.end()
        elif name == "title":
            found = re.compile(r"</title(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = found.end() if found else len(html)
        else:
            reader.start(name, match["attributes"] or match["attributes2"] or "")
    reader.text(html[at:])
    reader.flush()
    return reader.blocks


# --- the classifier --------------------------------------------------------

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "aside", "main", "heading")

#: Labelled blocks: FEATURES, then 1 for main text. Made by hand after usual page layouts.
LABELLED = (
    # inside an article
    (120, 0.00, 60, 0.00, 80, 0.00, 0, 1, 0, 1),
    (60, 0.05, 12, 0.00, 120, 0.00, 0, 1, 0, 1),
    (2, 0.00, 90, 0.00, 140, 0.00, 0, 1, 0, 1),
    (1, 0.00, 40, 0.00, 0, 0.00, 0, 1, 0, 1),
    (9, 0.00, 3, 0.00, 70, 0.00, 0, 1, 1, 1),
    (10, 0.00, 1, 1.00, 50, 0.00, 0, 1, 1, 1),
    (5, 1.00, 80, 0.00, 90, 0.00, 0, 1, 0, 1),
    (3, 1.00, 4, 1.00, 3, 1.00, 0, 1, 0, 1),
    (30, 0.50, 2, 1.00, 6, 0.00, 0, 1, 0, 1),
    (4, 0.00, 10, 0.00, 5, 0.00, 0, 1, 0, 1),
    (5, 0.00, 1, 1.00, 5, 0.00, 0, 1, 1, 1),
    (3, 0.00, 60, 0.00, 12, 0.10, 0, 1, 0, 1),
    (6, 0.00, 4, 0.00, 9, 0.00, 0, 1, 0, 1),
    (1, 0.00, 2, 0.00, 2, 0.00, 0, 1, 0, 1),
    (4, 0.00, 8, 0.00, 6, 1.00, 0, 1, 0, 1),
    (2, 1.00, 6, 0.00, 1, 1.00, 0, 1, 0, 1),
    (12, 0.90, 2, 1.00, 14, 0.80, 0, 1, 0, 1),
    (8, 0.60, 60, 0.00, 4, 1.00, 0, 1, 0, 1),
    (5, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 1, 0, 1),
    (2, 0.00, 0, 0.00, 1, 1.00, 0, 1, 0, 1),
    (240, 0.00, 3, 0.00, 2, 0.00, 0, 1, 0, 1),
    # marked as something else, inside or outside of one
    (8, 0.00, 1, 1.00, 10, 0.00, 1, 0, 0, 0),
    (40, 0.00, 1, 1.00, 12, 0.00, 1, 0, 0, 0),
    (150, 0.00, 90, 0.00, 60, 0.00, 1, 0, 0, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 1, 0, 0, 0),
    (12, 0.10, 100, 0.00, 0, 0.00, 1, 0, 0, 0),
    (45, 0.00, 120, 0.00, 70, 0.00, 1, 1, 0, 0),
    (4, 0.00, 60, 0.00, 20, 0.00, 1, 1, 1, 0),
    (7, 1.00, 60, 0.00, 8, 1.00, 1, 1, 0, 0),
    (3, 0.00, 50, 0.00, 30, 0.00, 1, 0, 1, 0),
    (60, 0.05, 12, 0.00, 120, 0.00, 1, 1, 0, 0),
    (90, 0.00, 45, 0.00, 60, 0.00, 1, 0, 0, 0),
    (25, 0.00, 2, 1.00, 3, 1.00, 1, 0, 0, 0),
    (6, 0.00, 50, 0.00, 40, 0.00, 1, 0, 1, 0),
    (18, 0.00, 60, 0.00, 3, 1.00, 1, 1, 0, 0),
    (2, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 0),
    (110, 0.00, 70, 0.00, 90, 0.00, 1, 0, 0, 0),
    (9, 0.00, 0, 0.00, 90, 0.00, 1, 0, 1, 0),
    (33, 0.00, 30, 0.00, 28, 0.00, 1, 1, 0, 0),
    (70, 0.30, 60, 0.00, 40, 0.10, 1, 0, 0, 0),
    (200, 0.00, 1, 1.00, 300, 0.00, 1, 0, 0, 0),
    # pages without article element: running text
    (110, 0.00, 70, 0.00, 90, 0.00, 0, 0, 0, 1),
    (45, 0.02, 80, 0.00, 60, 0.00, 0, 0, 0, 1),
    (30, 0.10, 9, 0.00, 55, 0.00, 0, 0, 0, 1),
    (22, 0.00, 40, 0.00, 35, 0.05, 0, 0, 0, 1),
    (70, 0.30, 60, 0.00, 40, 0.10, 0, 0, 0, 1),
    (18, 0.00, 60, 0.00, 3, 1.00, 0, 0, 0, 1),
    (25, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 1),
    (4, 0.00, 70, 0.00, 80, 0.00, 0, 0, 0, 1),
    (8, 0.00, 45, 0.00, 60, 0.00, 0, 0, 0, 1),
    (2, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0, 1),
    (7, 0.00, 2, 1.00, 60, 0.00, 0, 0, 1, 1),
    (9, 0.00, 0, 0.00, 90, 0.00, 0, 0, 1, 1),
    (6, 0.00, 50, 0.00, 40, 0.00, 0, 0, 1, 1),
    (6, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    # pages without article element: lists of links, short strays
    (1, 1.00, 1, 1.00, 2, 1.00, 0, 0, 0, 0),
    (3, 1.00, 2, 1.00, 40, 0.00, 0, 0, 0, 0),
    (6, 1.00, 50, 0.00, 5, 1.00, 0, 0, 0, 0),
    (12, 0.80, 9, 0.90, 11, 0.70, 0, 0, 0, 0),
    (20, 0.90, 4, 1.00, 6, 1.00, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0),
    (4, 0.00, 1, 1.00, 3, 0.00, 0, 0, 0, 0),
    (5, 0.00, 3, 0.00, 0, 0.00, 0, 0, 0, 0),
    (2, 0.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0),
    (3, 0.00, 4, 1.00, 6, 1.00, 0, 0, 1, 0),
    (8, 0.60, 60, 0.00, 4, 1.00, 0, 0, 0, 0),
)


@dataclass
class Node:
    """A leaf, or a question: is the feature at most the limit?"""

    label: int
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = field(default=None, repr=False)
    high: "Node | None" = field(default=None, repr=False)

    def ask(self, row: Sequence[float]) -> int:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.label


def _impurity(rows: Sequence[Sequence[float]]) -> float:
    ones = sum(row[-1] for row in rows)
    return 2.0 * ones * (len(rows) - ones) / len(rows) if rows else 0.0


def grow(rows: Sequence[Sequence[float]], depth: int = 6) -> Node:
    """A decision tree by least Gini impurity; of equal splits the first feature's, then the lowest limit."""
    ones = sum(row[-1] for row in rows)
    node = Node(int(2 * ones > len(rows)))
    if depth == 0 or ones in (0, len(rows)):
        return node
    best = _impurity(rows) - 1e-9
    # Marks of place are asked first where they split as well as counts do.
    for feature in (6, 7, *range(6), 8):
        values = sorted({row[feature] for row in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            parts = [row for row in rows if row[feature] <= limit], [row for row in rows if row[feature] > limit]
            if (left := sum(map(_impurity, parts))) < best - 1e-9:
                best, node.feature, node.limit, split = left, feature, limit, parts
    if node.feature >= 0:
        node.low, node.high = grow(split[0], depth - 1), grow(split[1], depth - 1)
    return node


def rows_of(blocks: Sequence[Block]) -> list[tuple]:
    """FEATURES of each block; beyond the first and the last one there are blocks of no words."""
    none = Block("", 0, 0, False, False, False)
    around = [none, *blocks, none]
    return [
        (b.words, b.density, a.words, a.density, c.words, c.density, int(b.aside), int(b.main), int(b.heading))
        for a, b, c in zip(around, blocks, around[2:])
    ]


def main_text(html: str | None, tree: Node) -> str:
    """The main blocks of a page, in order, joined by one space; empty for null or empty pages."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return " ".join(block.text for block, row in zip(blocks, rows_of(blocks)) if tree.ask(row))


def extract(df: DataFrame, html: str = "html", keep: list[str] | None = None, labelled=LABELLED) -> DataFrame:
    """The columns `keep` (all) of `df`, text and n_chars (code points), row by row.

    Null, empty and textless pages: an empty text. Broken markup is read as far as it goes: unclosed elements end
    with what holds them, a `<` that opens no tag is text. Equally named input columns give way.
    """
    tree = grow(labelled)

    def start():
        def work(pages):
            texts = [main_text(page, tree) for page in pages]
            return texts, [len(text) for text in texts]

        return work

    return map_batches(df, df.columns if keep is None else keep, [html], "text string, n_chars long", start)
