"""Sentences by which a page asks to sign in, join or pay before it shows the rest.

A text is cut into words and marks; phrases are looked up word by word in tables, and
the rules below say which phrases make a wall, in which order and how far apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

# What readers are asked to do, what for, and who may read. (x) may be left out, x/y is one of both.
ASK = ("sign up", "sign in", "log in", "subscribe", "register", "join", "create (a) (free) account", "become a (free) member/subscriber")
JOINING = ("join",)
ACCOUNT = ("create (a) (free) account",)
GO_ON = ("to keep/continue reading",)
OPEN = ("to read/access/unlock",)
WHOLE = ("the full/whole article/story", "the rest of the/this article/story", "this article/story")
MEMBERS = ("become a member to read", "this article/story/content is (only) for/reserved-for/exclusive-to/available-to (paid) subscribers/members")
ALREADY = ("already a subscriber/member",)
ENTER = ("sign/log in",)
#: Characters between the asking and what it is for, at most.
FAR = 48

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_|\n")


class Phrases:
    """Phrases by their first words."""

    def __init__(self, specs: tuple[str, ...], without: tuple[str, ...] = ()):
        self.ways: dict[str, list[tuple[str, ...]]] = {}
        left_out = {w for spec in without for w in self.spelled(spec)}
        for spec in specs:
            for way in self.spelled(spec):
                if way not in left_out:
                    self.ways.setdefault(way[0], []).append(way)
        for ways in self.ways.values():
            ways.sort(key=len, reverse=True)

    @staticmethod
    def spelled(spec: str) -> list[tuple[str, ...]]:
        """Every way to say a phrase; words with a hyphen are several."""
        choices = []
        for word in spec.split():
            inner = word.strip("()")
            choices.append([tuple(w.split("-")) for w in inner.split("/")] + ([()] if word.startswith("(") else []))
        return [sum(way, ()) for way in product(*choices)]

    def end(self, words: list[str], at: int) -> int | None:
        """Where the longest phrase that begins at a word ends."""
        if at < len(words):
            for way in self.ways.get(words[at], ()):
                if tuple(words[at : at + len(way)]) == way:
                    return at + len(way)
        return None


_ASK, _ASK_AFTER, _ASK_OPEN = Phrases(ASK), Phrases(ASK, JOINING), Phrases(ASK, JOINING + ACCOUNT)
_GO_ON, _OPEN, _WHOLE, _MEMBERS, _ALREADY, _ENTER = map(Phrases, (GO_ON, OPEN, WHOLE, MEMBERS, ALREADY, ENTER))
#: Words that a wall can begin with.
_FIRST = frozenset(word for phrases in (_ASK, _GO_ON, _MEMBERS, _ALREADY) for word in phrases.ways)


def _wall(words: list[str], places: list[tuple[int, int]], at: int) -> int | None:
    """Where a wall that begins at a word ends."""
    if (asked := _ASK.end(words, at)) is not None:
        if (opened := _OPEN.end(words, asked)) and _ASK_OPEN.end(words, at) == asked and (whole := _WHOLE.end(words, opened)):
            return whole  # subscribe to read the whole story
        k = asked
        while k < len(words) and words[k] not in ".!?\n" and places[k][0] - places[asked - 1][1] <= FAR:
            if (on := _GO_ON.end(words, k)) is not None:
                return on  # sign up ... to keep reading
            k += 1
    if (on := _GO_ON.end(words, at)) is not None:
        on += on < len(words) and words[on] == ","
        on += on < len(words) and words[on] == "please"
        if (asked := _ASK_AFTER.end(words, on)) is not None:
            return asked  # to continue reading, please log in
    if (members := _MEMBERS.end(words, at)) is not None:
        return members
    if (member := _ALREADY.end(words, at)) is not None and member < len(words) and words[member] == "?":
        member += 1
        while member < len(words) and words[member] == "\n":
            member += 1
        return _ENTER.end(words, member)
    return None


def spans(text: str) -> Iterator[tuple[int, int]]:
    """[from, to) of the walls of a text, in order, none inside another."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    words = [text[a:b].lower() for a, b in places]
    past = 0
    for at in [i for i, word in enumerate(words) if word in _FIRST]:
        if at >= past and (end := _wall(words, places, at)) is not None:
            yield places[at][0], places[end - 1][1]
            past = end
