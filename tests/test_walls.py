"""Walls are looked for only where one can begin, and found as by a look at every word."""

import random
from bisect import bisect_left

from scrivane.functions import selectors, walls


def every_word(text):
    """Spans by trying every word."""
    found = [(m[0].lower(), m.span()) for m in walls._TOKEN.finditer(text)]
    words, places = [w for w, _ in found], [p for _, p in found]
    at, out = 0, []
    while at < len(words):
        end = walls._wall(words, places, at)
        if end is None:
            at += 1
        else:
            out.append((places[at][0], places[end - 1][1]))
            at = end
    return out


def test_walls_and_words_as_by_a_look_at_every_word():
    rng = random.Random(4)
    parts = ["Sign up", "to keep reading", "to continue reading, please log in", "Already a member?\nlog in", "become a member to read", "subscribe to read the full story", "this story is only for paid subscribers", "to", "a", ". ", "word Ünd 12", "\n"]
    for _ in range(4000):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))
        found = every_word(text)
        assert list(walls.spans(text)) == found
        letters = [i for i, c in enumerate(text) if c.isalpha()]
        fit = [text[a:b] for a, b in found if bisect_left(letters, a) > len(letters) - bisect_left(letters, b)]
        assert selectors.wall_words(text) == (fit[-1] if fit else None)


def test_words_that_begin_no_wall_are_passed_over(monkeypatch):
    tried = []
    whole = walls._wall
    monkeypatch.setattr(walls, "_wall", lambda words, places, at: tried.append(words[at]) or whole(words, places, at))
    assert len(list(walls.spans("plain words " * 1000 + "sign up to keep reading"))) == 1
    assert tried == ["sign"]
