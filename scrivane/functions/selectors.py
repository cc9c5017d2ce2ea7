"""A subset of CSS selectors on the tree, and the rules that are lists of selectors.

Known: tag, *, #id, .class, [a], [a=v], [a^=v], [a$=v], [a*=v], [a~=v] (also with i), descendant and child combinators, and commas.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from scrivane.functions.markup import Node, parse, text_of

# Where content stands, what is noise, whose boxes ask for consent or check for robots.
CONTENT = ("article", "main", "[role=main]", "#content", "#main", ".content", ".post", ".entry-content", ".article-body", ".post-content", ".article-content")
NOISE = (
    "nav", "body > header", "body > footer", "body > aside", "[role=navigation]", "[role=search]", "[aria-label*=cookie i]", "[class*=cookie-consent i]", "[id*=cookie-consent i]", "[class*=newsletter i]", "[class*=subscribe i]",
    ".sidebar", "#sidebar", ".comments", "#comments", ".related-posts", "#mv-first-video", "[id^=mv-player-]", "[id^=mv-ad-]", "iframe[src*=imasdk.googleapis.com]", "iframe[title=Advertisement i]", "video[title=Advertisement i]", "ins.adsbygoogle", "[id^=div-gpt-ad]", "[id^=google_ads_iframe]",
    "ins[id^=gpt_unit_][id*=anchor]",
)
CONSENT = {"onetrust": "#onetrust-consent-sdk", "cookiebot": "#CybotCookiebotDialog, #CybotCookiebotDialogBodyUnderlay", "usercentrics": "#usercentrics-root, #usercentrics-cmp-ui", "quantcast": ".qc-cmp2-container, #qc-cmp2-container", "trustarc": "#truste-consent-track", "didomi": "#didomi-host", "sourcepoint": "[id^=sp_message_container]", "klaro": ".klaro", "osano": ".osano-cm-window, .osano-cm-dialog", "iubenda": "#iubenda-cs-banner",
           "complianz": "#cmplz-cookiebanner-container, .cmplz-cookiebanner, #cmplz-manage-consent", "cookieyes": ".cky-consent-container, .cky-overlay, .cky-modal, .cky-btn-revisit-wrapper"}
ROBOT_CHECKS = {"cloudflare": "#challenge-form, #cf-wrapper, [class*=cf-turnstile]", "datadome": "[src*=captcha-delivery]", "perimeterx": "#px-captcha", "hcaptcha": ".h-captcha", "recaptcha": ".g-recaptcha"}
WALLS = {"mg2_connext": ".Mg2-connext", "piano": "[class*=tp-modal], .tp-backdrop", "poool": "#poool-widget", "generic": "[class*=paywall i], [id*=paywall i]"}

_PART = re.compile(r"\*|[A-Za-z][\w-]*|#[\w-]+|\.[\w-]+|\[\s*([\w-]+)\s*(?:([~^$*]?=)\s*\"?'?([^\]\"']*?)\"?'?\s*(i)?\s*)?\]")


_KNOWN: dict[str, list] = {}


def _compiled(selector: str):
    if selector in _KNOWN:
        return _KNOWN[selector]
    out = []
    for alternative in selector.split(","):
        steps, child = [], False
        for token in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", alternative):
            if token == ">":
                child = True
                continue
            steps.append((child, [(m[0], m[1], m[2], m[3], bool(m[4])) for m in _PART.finditer(token)]))
            child = False
        if steps:
            out.append(steps)
    if len(_KNOWN) < 1024:
        _KNOWN[selector] = out
    return out


def _simple(node: Node, parts) -> bool:
    for whole, attr, op, value, fold in parts:
        if whole[0] == "#":
            ok = node.attrs.get("id") == whole[1:]
        elif whole[0] == ".":
            ok = whole[1:] in node.attrs.get("class", "").split()
        elif whole[0] == "[":
            have = node.attrs.get(attr.lower())
            if have is not None and fold:
                have, value = have.lower(), value.lower()
            ok = have is not None and (op is None or (op == "=" and have == value) or (op == "^=" and have.startswith(value)) or (op == "$=" and have.endswith(value)) or (op == "*=" and value in have) or (op == "~=" and value in have.split()))
        else:
            ok = whole == "*" or node.tag == whole.lower()
        if not ok:
            return False
    return True


def _fits(node: Node, steps) -> bool:
    child, parts = steps[-1]
    if not _simple(node, parts):
        return False
    if len(steps) == 1:
        return True
    for up in node.up():
        if up.tag == "#root":
            return False
        if _fits(up, steps[:-1]):
            return True
        if child:
            return False
    return False


def matches(node: Node, selector: str) -> bool:
    return any(_fits(node, steps) for steps in _compiled(selector))


def select(root: Node, selector: str) -> list[Node]:
    return [n for n in root.walk() if matches(n, selector)]


def remove(root: Node, selectors, reason: str) -> list[tuple[str, str]]:
    """Take the matching elements out; (selector, reason) of each."""
    gone = []
    for n in list(root.walk()):
        hit = next((s for s in selectors if matches(n, s)), None)
        if hit and n.parent is not None and n in n.parent.children:
            n.parent.children.remove(n)
            gone.append((hit, reason))
    return gone


def isolate(root: Node, selector: str) -> Node:
    """The tree with the first match alone; an error if there is none."""
    found = select(root, selector)
    if not found:
        raise LookupError(f"nothing matches {selector}")
    node = found[0]
    for up in list(node.up()):
        up.children = [node]
        node = up
    return root


def refusals(root: Node) -> list[str]:
    """Firewalls whose refusal the page is: the title and the text the vendor writes are both required."""
    title = next((text_of(n) for n in select(root, "title")), "").strip().lower()
    if title not in ("access denied", "request rejected"):
        return []
    said = " ".join(text_of(next(iter(select(root, "body")), root)).split())
    if title == "access denied":
        return ["akamai"] if re.search(r"Reference\s*#\s*\d+\.[0-9a-f]+\.\d+\.[0-9a-f]+", said, re.I) else []
    return ["f5"] if re.search(r"Your support ID is:?\s*<?\s*\d{6,}\s*>?", said, re.I) and re.search(r"The requested URL was rejected\.", said, re.I) else []


def wall_words(text: str) -> str | None:
    """The words by which a wall ends a text: the last of them that has more letters before than after it."""
    from scrivane.functions.walls import spans

    start = end = 0
    for start, end in spans(text):
        pass  # a later wall has no fewer letters before it and no more after it: if any will do, the last one does
    return text[start:end] if sum(map(str.isalpha, text[:start])) > sum(map(str.isalpha, text[end:])) else None



def vendors(root: Node, table: dict[str, str]) -> list[str]:
    return [name for name, s in table.items() if select(root, s)]


def clean_text(html: str) -> tuple[str, int]:
    """(text without noise and consent boxes, elements taken out)."""
    root = parse(html)
    gone = remove(root, (*NOISE, *CONSENT.values()), "noise")
    return text_of(root, lines=True), len(gone)


def css_imports(css: str) -> list[str]:
    """Addresses of the leading @import statements."""
    css = re.sub(r"/\*.*?\*/", " ", css, flags=re.S)
    out, at = [], 0
    while m := re.compile(r"\s*(?:@charset[^;]*;\s*)?(?:@layer[^;{]*;\s*)*@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)[^;]*;", re.I).match(css, at):
        out.append(m[1])
        at = m.end()
    return out


def collapsed_regions(root: Node, least: int = 200) -> list[dict]:
    """Text of some length behind a control: details elements, and what aria-expanded=false controls."""
    ids = {i for n in root.walk() if n.attrs.get("aria-expanded") == "false" for i in n.attrs.get("aria-controls", "").split()}
    out = []
    for n in root.walk():
        if (n.tag == "details" and "open" not in n.attrs) or n.attrs.get("id") in ids:
            body = text_of(n, skip=("summary",))
            if len(body) >= least:
                out.append({"name": next((text_of(c) for c in n.children if isinstance(c, Node) and c.tag == "summary"), n.attrs.get("id", "")), "text": body})
    return out


def words_in_order(haystack: list[str], needle: list[str], gap: int = 40) -> bool:
    """The needle's words in order, each within `gap` words of the one before; each start takes the first fit."""
    if not needle:
        return True
    places: dict[str, list[int]] = {}
    for i, w in enumerate(haystack):
        places.setdefault(w, []).append(i)
    for start in places.get(needle[0], []):
        at = start
        for w in needle[1:]:
            later = places.get(w, [])
            k = bisect_right(later, at)
            if k == len(later) or later[k] - at > gap:
                break
            at = later[k]
        else:
            return True
    return False
