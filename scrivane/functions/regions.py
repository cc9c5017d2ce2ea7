"""Where a page's article stands: its blocks in reading order, the segment of them that is text, and how much of a text each element holds.

Every function goes over the tree once, without recursion, in time linear in the page
(times the logarithm of its depth for the elements' shares).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

from scrivane.functions.markup import BLOCK, CHROME_ROLES, CHROME_TAGS, HEADINGS, SILENT, Node, collapse

#: Words that a block must have to speak for an article; shorter ones only stay between others.
COST = 10
#: Characters of an article, at least.
LEAST = 200

_WORD = re.compile(r"[^\W_]+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    chrome: bool
    heading: bool

    @property
    def score(self) -> int:
        """Words less twice the linked ones and COST; a heading costs nothing, chrome counts against."""
        if self.chrome:
            return -self.words - COST
        return self.words - 2 * self.linked - (0 if self.heading else COST)


def shows_nothing(node: Node) -> bool:
    """Whether the element itself is hidden, whatever holds it."""
    style = node.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _is_chrome(node: Node) -> bool:
    return node.tag in CHROME_TAGS or (node.attrs.get("role", "").lower().split() or [""])[0] in CHROME_ROLES


def block_sequence(root: Node) -> list[Block]:
    """The visible blocks' own texts in reading order; inline elements belong to the block around them."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    chrome = heading = False
    links = 0  # open links

    def close() -> None:
        nonlocal linked
        if text := collapse("".join(parts).replace("\n", " ")):
            words = len(text.split())
            out.append(Block(text, words, min(linked, words), chrome, heading))
        parts.clear()
        linked = 0

    stack: list = list(reversed(root.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
            linked += len(c.split()) if links else 0
        elif isinstance(c, tuple):  # the end of an element: what held before it holds again
            if c[0]:
                close()
            _, chrome, heading, links = c
        elif c.tag == "br":
            parts.append(" ")
        elif c.tag not in SILENT and not shows_nothing(c):
            block = c.tag in BLOCK
            if block:
                close()
            stack.append((block, chrome, heading, links))
            if block:
                chrome, heading = chrome or _is_chrome(c), c.tag in HEADINGS
            links += c.tag == "a"
            stack.extend(reversed(c.children))
    close()
    return out


def best_segment(scores: list[int]) -> tuple[int, int]:
    """[from, to) of the greatest positive sum; of equal sums the one that begins first, then the shortest. (0, 0) if none is positive."""
    best, at, run, begin = 0, (0, 0), 0, 0
    for i, s in enumerate(scores):
        if run <= 0 and not (run == 0 and begin < i and i):
            run, begin = 0, i
        run += s
        if run > best or run == best > 0 and begin < at[0]:
            best, at = run, (begin, i + 1)
        if run < 0:
            run, begin = 0, i + 1
    return at


def article(root: Node, least: int = LEAST) -> str | None:
    """The lines of the best segment without chrome; None below `least` characters."""
    found = block_sequence(root)
    a, b = best_segment([x.score for x in found])
    text = "\n".join(x.text for x in found[a:b] if not x.chrome)
    return text if len(text) >= least else None


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


ELEMENT = ("pre", "post", "depth", "step", "chars", "distinct_words", "occurrences")


def element_shares(root: Node, wanted: str) -> list[tuple]:
    """A row (ELEMENT) for each visible element: its pre-order number, the last one inside it, its depth and step of a locator, and its own part of the sums below.

    An element's characters are those of its own texts with single blanks. Added up from
    pre to post, distinct_words gives how many different words of `wanted` the element
    holds, and occurrences how many of their occurrences, each word at most as often as
    `wanted` has it: an occurrence counts where it stands, and is taken off at the lowest
    element that also holds the one before it (of the same word; for occurrences the one
    as many before as `wanted` has of it). A word that inline tags cut counts by parts.
    """
    limits = Counter(words_of(wanted))
    places: dict[str, list[int]] = {}
    rows: list[list] = []
    opened: list[int] = []  # rows of the open elements
    starts: list[int] = []  # words before each of them
    seen = 0
    stack: list = list(reversed(root.children))
    counters: list[dict[str, int]] = [{}]
    totals: list[Counter] = [Counter(c.tag for c in root.children if isinstance(c, Node))]
    while stack:
        c = stack.pop()
        if c is None:
            rows[opened.pop()][1] = len(rows) - 1
            starts.pop(), counters.pop(), totals.pop()
        elif isinstance(c, str):
            if not opened:
                continue
            own = rows[opened[-1]]
            own[4] += sum(len(w) + 1 for w in c.split())
            for word in words_of(c):
                if word in limits:
                    before = places.setdefault(word, [])
                    own[5] += 1
                    own[6] += 1
                    if before:
                        rows[opened[bisect_right(starts, before[-1]) - 1]][5] -= 1
                    if len(before) >= limits[word]:
                        rows[opened[bisect_right(starts, before[-limits[word]]) - 1]][6] -= 1
                    before.append(seen)
                seen += 1
        elif c.tag not in SILENT and not shows_nothing(c):
            counters[-1][c.tag] = n = counters[-1].get(c.tag, 0) + 1
            step = f"#{c.attrs['id']}" if c.attrs.get("id") else c.tag if totals[-1][c.tag] == 1 else f"{c.tag}:nth-of-type({n})"
            rows.append([len(rows), len(rows), len(opened), step, 0, 0, 0])
            opened.append(len(rows) - 1)
            starts.append(seen)
            counters.append({})
            totals.append(Counter(x.tag for x in c.children if isinstance(x, Node)))
            stack.append(None)
            stack.extend(reversed(c.children))
        else:
            counters[-1][c.tag] = counters[-1].get(c.tag, 0) + 1
    return [tuple(r) for r in rows]
