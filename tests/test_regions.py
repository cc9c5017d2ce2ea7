"""Articles and covering elements against exhaustive search."""

import math
import random
import re
import time

from scrivane.functions import markup, regions
from scrivane.operators import structure


def exhaustive(scores):
    found = [(sum(scores[a:b]), -a, -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    top = max(found, default=(0,))
    return (top[3], top[4]) if top[0] > 0 else (0, 0)


def test_the_best_segment_is_that_of_an_exhaustive_search():
    rng = random.Random(1)
    for _ in range(3000):
        scores = [rng.randrange(-4, 5) for _ in range(rng.randrange(0, 12))]
        assert regions.best_segment(scores) == exhaustive(scores), scores


def page(rng, depth=0):
    """Random markup with nested and inline elements, chrome, links, hidden parts and repeated words."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["text", "text", "div", "p", "a", "b", "nav", "h2", "hidden", "script", "br"])
        words = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups phi chi psi ome".split()) for _ in range(rng.randrange(1, 25)))
        if kind == "text":
            out.append(f" {words} ")
        elif kind == "br":
            out.append("<br>")
        elif kind == "script":
            out.append(f"<script>{words}</script>")
        elif kind == "hidden":
            out.append(f"<div style='display: none'>{words}</div>")
        elif depth < 5:
            name = " id=x1" if rng.random() < 0.1 else ""
            out.append(f"<{kind}{name}>{page(rng, depth + 1)}</{kind}>")
    return "".join(out)


def brute_cover(root, article):
    """Every element by its own subtree's words."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    wanted = words(article)
    best = None

    def visible(n, out):
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in markup.SILENT and not regions.shows_nothing(c):
                visible(c, out)
        return out

    order = [n for n in root.walk() if n.tag not in markup.SILENT and not any(x.tag in markup.SILENT or regions.shows_nothing(x) for x in (n, *n.up()))]
    for n in order:
        texts = visible(n, [])
        own = [w for t in texts for w in words(t)]
        chars = sum(len(w) + 1 for t in texts for w in t.split())
        held = len(set(own) & set(wanted))
        seen = sum(min(own.count(w), wanted.count(w)) for w in set(wanted))
        need = math.ceil(0.9 * len(set(wanted)))
        if len(set(wanted)) >= 20 and chars >= max(200, 2 * need - 1) and held >= 0.9 * len(set(wanted)) and seen >= 0.9 * len(wanted) and (best is None or chars <= best[1]):
            best = (n, chars, held, len(set(wanted)), seen, len(wanted))
    return best


def test_covering_elements(spark):
    rng = random.Random(5)
    pages = [(i, f"<html><body>{page(rng)}{page(rng)}</body></html>") for i in range(250)] + [(900, None), (901, ""), (902, "no tags " * 300), (903, "<p>" + "a1 b2 c3 " * 100)]
    got = {r["page_id"]: tuple(r)[1:] for r in structure.covering_element(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    want = {}
    for i, html in pages:
        root = markup.parse(html or "")
        text = regions.article(root)
        if text and (b := brute_cover(root, text)):
            want[i] = (markup.locator(b[0]), *b[1:])
    assert len(want) > 40 and {i: r[1:] for i, r in got.items()} == {i: r[1:] for i, r in want.items()}
    assert {i: r[0] for i, r in got.items()} == {i: r[0] for i, r in want.items()}


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 20_000 + "word and more words here " * 20 + "</div>" * 20_000
    wide = "".join(f"<p>paragraph {i} of a long page with some more words than others have</p>" for i in range(20_000))
    for html in (deep, wide):
        root = markup.parse(html)
        began = time.process_time()
        text = regions.article(root)
        rows = regions.element_shares(root, text)
        assert text and len(rows) == 20_000 and time.process_time() - began < 10


def test_links_and_chrome_stay_outside():
    menu = "<ul>" + "".join(f"<li><a href=/{i}>menu entry {i}</a></li>" for i in range(30)) + "</ul>"
    body = "".join(f"<p>{'A sentence of the article with a good number of words in it. ' * 2}</p>" for _ in range(5))
    text = regions.article(markup.parse(f"<nav>{menu}</nav>{menu}<div>Ad: buy now</div><h1>Heading</h1>{body}<p>short</p>{body}{menu}<footer>{'Legal words of the house ' * 9}</footer>"))
    assert text.startswith("Heading\n") and "menu" not in text and "Legal" not in text and "Ad:" not in text and "\nshort\n" in text
    assert regions.article(markup.parse("<p>too short</p>")) is None
