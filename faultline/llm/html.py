"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 6

# Element names of the markup language.
# Plain text up to their end tag or else the end of the page.
_RAW = frozenset("script style title textarea".split())
# Closed by "/>" too.
_EMBEDDED = frozenset("svg math iframe object canvas audio video".split())
_UNSEEN = _RAW | _EMBEDDED | frozenset("noscript template select".split())
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _UNSEEN}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
    "ul".split()
)
_BOILER = frozenset("nav footer aside form menu dialog button label".split())
_MAIN = frozenset(("article", "main"))
# Words in class, id or role that mark what is not the article.
_MARKS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent notice alert popup modal overlay "
    "comment comments disqus reply replies respond discussion share sharing social related recommended newsletter subscribe "
    "signup login search pagination pager widget widgets complementary contentinfo dialog".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """Text between two block-level tags."""

    text: str
    words: int
    linked: int  # words inside links
    boiler: bool
    main: bool
    heading: bool


@dataclass
class _Place:
    """What holds for the text at hand, from the open elements."""

    open: list[tuple[str, bool, bool, bool, bool]] = field(default_factory=list)
    at: dict[str, list[int]] = field(default_factory=dict)  # where each element name stands in ``open``

    def enter(self, name: str, attributes: str) -> None:
        boiler, main, link, head = self.state
        names = _WORDS.findall(" ".join(a or b or c for a, b, c in _NAMED.findall(attributes)))
        marked = any(w.lower() in _MARKS for w in names) and name not in ("body", "html")
        own = name in _BOILER or marked or (name == "header" and not main) or bool(_HIDDEN.search(attributes))
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, boiler or own, main or name in _MAIN, link or name == "a", head or name[:1] == "h" and name[1:].isdigit()))

    def leave(self, name: str) -> None:
        if not self.at.get(name):
            return
        at = self.at[name][-1]
        for left in self.open[at:]:
            self.at[left[0]].pop()
        del self.open[at:]

    @property
    def state(self) -> tuple[bool, bool, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, False, False)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Character references are decoded and white space becomes one space."""
    found: list[Block] = []
    place, pieces, linked, at = _Place(), [], 0, 0
    state = place.state

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            words = text.count(" ") + 1
            found.append(Block(text, words, min(linked, words), state[0], state[1], state[3]))
        pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            pieces.append(text)
            if place.state[2]:
                linked += len(text.split())

    ends: dict[str, tuple[int, int]] = {}  # next end tag of each unseen element

    while tag := _TOKEN.search(page, at):
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        # What is not seen in a head is so by itself; anything else in it ends it.
        if not name or name == "head":
            continue
        if name in _UNSEEN and not tag[1]:
            if name in _EMBEDDED and tag[3].endswith("/"):
                continue
            if name not in ends or ends[name][0] < at:
                end = _ENDS[name].search(page, at)
                ends[name] = end.span() if end else (len(page), len(page) if name in _RAW else -1)
            if ends[name][1] >= 0:
                at = ends[name][1]
                continue
        if name == "br":
            pieces.append(" ")
        elif name in _VOID and name != "hr":
            continue
        else:
            if name in _BLOCK:
                close()
            if tag[1]:
                place.leave(name)
            elif name != "hr":
                if name in ("p", "li") and place.open and place.open[-1][0] == name:
                    place.leave(name)
                place.enter(name, tag[3] or "")
            if not pieces:
                state = place.state
    add(page[at:])
    close()
    return found


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "place", "heading")


def shape(found: list[Block]) -> np.ndarray:
    """Features of each block: word count and link density, those of its neighbours, and where it stands.

    ``place`` is 2 inside an article element, 1 outside on a page that has one, 0 on a page without.
    """
    words = np.array([0, *(b.words for b in found), 0], dtype=float)
    links = np.array([0, *(b.linked / b.words for b in found), 0], dtype=float)
    has_main = any(b.main and not b.boiler for b in found)
    here = [[float(b.boiler), 2.0 if b.main else float(has_main), float(b.heading)] for b in found]
    around = [words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]]
    return np.column_stack([np.column_stack(around), np.array(here).reshape(-1, 3)])


Tree = float | tuple[int, float, "Tree", "Tree"]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = MAX_DEPTH) -> Tree:
    """Binary decision tree by Gini impurity; a leaf is the share of main-text rows. Ties take the first feature."""
    share = float(labels.mean()) if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for column in range(rows.shape[1]):
        values = np.unique(rows[:, column])
        for cut in (values[1:] + values[:-1]) / 2:
            left = rows[:, column] <= cut
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (labels[left], labels[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, float(cut), left)
    if best is None:
        return share
    _, column, cut, left = best
    return column, cut, grow(rows[left], labels[left], depth - 1), grow(rows[~left], labels[~left], depth - 1)


def is_main(tree: Tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        column, cut, below, above = tree
        tree = below if row[column] <= cut else above
    return tree >= 0.5


def _words(n: int) -> str:
    return " ".join(["lorem"] * n)


def _links(n: int, each: int = 1) -> str:
    return "".join(f"<li><a href='#'>{_words(each)}</a></li>" for _ in range(n))


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """The training table: blocks of small example pages, each part marked as main text (1) or not (0)."""
    p = lambda *sizes: "".join(f"<p>{_words(n)}</p>" for n in sizes)
    pages = [
        [
            (0, f"<nav><ul>{_links(4)}</ul></nav><div class='ad'>{_words(8)}</div>"),
            (1, f"<article><h1>{_words(7)}</h1>{p(2, 60, 1, 25, 4)}"),
            (0, f"<div class='comments'>{p(3, 40, 12)}</div></article><footer>{_words(9)}</footer>"),
        ],
        [
            (0, f"<header>{_words(3)}</header><div>{_words(20)}</div><div>{_words(3)}</div>"),
            (1, f"<main><h1>{_words(3)}</h1>{p(90, 1, 3, 15)}<ul><li>{_words(6)}</li><li>{_words(2)}</li></ul>"),
            (1, f"<p>{_words(12)} <a href='#'>{_words(8)}</a></p><h2>{_words(2)}</h2>{p(9)}"),
            (0, f"<aside>{p(30)}</aside><form>{p(2, 12)}</form></main><div>{_words(45)}</div><ul>{_links(3, 2)}</ul>"),
        ],
        [
            (0, f"<div class='menu'>{_links(3, 2)}</div><div class='cookie-notice'>{_words(25)}</div><ul>{_links(5)}</ul>"),
            (1, f"<div><h1>{_words(5)}</h1>{p(50, 35, 6, 70, 3, 40)}</div>"),
            (0, f"<ul>{_links(4, 3)}</ul><div>{_words(4)}</div>"),
        ],
        [
            (0, f"<ul>{_links(6, 2)}</ul><div>{_words(2)}</div>"),
            (1, f"{p(30, 22, 45)}<h2>{_words(4)}</h2>{p(18, 33)}"),
            (0, f"<div><a href='#'>{_words(5)}</a> {_words(1)}</div><ul>{_links(3, 4)}</ul><div id='sidebar'>{p(50)}</div>"),
            (0, f"<div>{_words(6)}</div>"),
        ],
        [(1, p(12)), (1, p(40, 5))],
        [(1, p(40))],
        [(0, f"<div>{_words(2)}</div><ul>{_links(2)}</ul>"), (1, p(65)), (0, f"<footer>{_words(5)}</footer>")],
        [(1, f"<article>{p(1)}</article>"), (0, f"<div>{_words(1)}</div><div>{_words(70)}</div>")],
    ]
    rows, labels = [], []
    for page in pages:
        found = blocks("".join(part for _, part in page))
        rows.append(shape(found))
        labels += [label for label, part in page for _ in blocks(part)]
    return np.vstack(rows), np.array(labels, dtype=float)


def main_text(page: str, tree: Tree) -> tuple[str, int, int]:
    """Text of the main blocks joined by blank lines, their number and that of all blocks."""
    found = blocks(page)
    rows = shape(found).tolist() if found else []
    chosen = [b.text for b, row in zip(found, rows, strict=True) if is_main(tree, row)]
    return "\n\n".join(chosen), len(chosen), len(found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``text``, ``n_chars``, ``n_main``, ``n_blocks``) per row of ``pages``.

    The tree is fitted on the small table of labelled blocks above and applied to every page. Missing and empty html, and
    pages without main text, give the empty text. Elements left open end with their parent, also those that are not seen
    otherwise, except script, style, title and textarea; a tag cut off at the end of a
    page is dropped. Repeated rows give repeated rows, other columns are not looked at.
    """
    tree = grow(*labelled_blocks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(x or "", tree) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([t for t, _, _ in made], pa.string()),
                    pa.array([len(t) for t, _, _ in made], pa.int64()),
                    pa.array([n for _, n, _ in made], pa.int64()),
                    pa.array([n for _, _, n in made], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars", "n_main", "n_blocks"],
            )

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col))
    return picked.mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_main long, n_blocks long"
    )
