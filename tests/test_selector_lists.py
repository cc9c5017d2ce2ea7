"""Each entry of the reference's selector lists is met."""

import pytest

from scrivane.functions import selectors
from scrivane.functions import markup as M


@pytest.mark.parametrize("vendor, attrs", [
    ("cookiebot", "id=CybotCookiebotDialogBodyUnderlay"), ("usercentrics", "id=usercentrics-cmp-ui"), ("quantcast", "class=qc-cmp2-container"), ("osano", "class=osano-cm-dialog"), ("complianz", "id=cmplz-cookiebanner-container"), ("complianz", "class=cmplz-cookiebanner"),
    ("complianz", "id=cmplz-manage-consent"), ("cookieyes", "class=cky-consent-container"), ("cookieyes", "class=cky-overlay"), ("cookieyes", "class=cky-modal"), ("cookieyes", "class=cky-btn-revisit-wrapper"),
])
def test_consent(vendor, attrs):
    html = f"<p>a</p><div {attrs}>box</div>"
    assert selectors.vendors(M.parse(html), selectors.CONSENT) == [vendor] and selectors.clean_text(html)[0].strip() == "a"


@pytest.mark.parametrize("unit", ["<div id=mv-first-video>x</div>", "<div id=mv-player-1>x</div>", "<div id=mv-ad-2>x</div>", "<div id=div-gpt-ad-3>x</div>", "<div id=google_ads_iframe_4>x</div>", "<ins id=gpt_unit_/1/anchor_0>x</ins>", "<iframe src=https://imasdk.googleapis.com/a></iframe>", "<iframe title=advertisement></iframe>", "<video title=Advertisement></video>", "<div aria-label='Cookie notice'>x</div>"])
def test_ads(unit):
    text, removed = selectors.clean_text(f"<p>a</p>{unit}")
    assert text.strip() == "a" and removed == 1


def test_walls_content_and_refusals():
    assert selectors.vendors(M.parse("<div class=Mg2-connext>x</div>"), selectors.WALLS) == ["mg2_connext"]
    assert selectors.vendors(M.parse("<div class=tp-backdrop>x</div>"), selectors.WALLS) == ["piano"]
    assert {".post-content", ".article-content"} <= set(selectors.CONTENT)
    page = "<html><head><title>{}</title></head><body>{}</body></html>".format
    assert selectors.refusals(M.parse(page("Access Denied", "Reference #18.2f3a.1700000000.1ab"))) == ["akamai"]
    assert selectors.refusals(M.parse(page("Request Rejected", "The requested URL was rejected. Your support ID is: 1234567"))) == ["f5"]
    assert selectors.refusals(M.parse(page("News", "Reference #18.2f3a.1700000000.1ab"))) == [] and selectors.refusals(M.parse(page("Access Denied", "no"))) == []


@pytest.mark.parametrize("said, found", [
    ("Sign up to keep reading", True), ("To continue reading, please log in", True), ("Subscribe to read the full story", True), ("Become a member to read", True), ("This article is only available to subscribers", True), ("Already a member? Sign in", True), ("We subscribe to this view", False),
    ("Join 10,000 others, or log in to continue reading", True), ("Create a free account to keep reading", True), ("create account now, it costs nothing, to keep reading", True), ("Register. To keep reading helps", False), ("Register now" + " and read" * 6 + " to keep reading", False),
    ("To keep reading join us", False), ("To keep reading become a free member", True), ("To continue reading subscribe", True), ("Join to read this story", False), ("Create a free account to read this story", False), ("Sign in to unlock the rest of this article", True), ("Log in to access this story", True),
    ("Become a subscriber to read the whole article", True), ("This content is reserved for paid members", True), ("This story is exclusive to subscribers", True), ("This story is for everyone", False), ("Already a subscriber?\n Log in", True), ("Already a member. Sign in", False), ("They resign up to keep reading", False), ("SIGN UP to KEEP reading", True),
])
def test_wall_words(said, found):
    assert (selectors.wall_words(f"{'A long beginning of the text. ' * 5}{said}") is not None) is found
    assert selectors.wall_words(f"{said} {'and the text goes on ' * 9}") is None


def test_wall_words_are_those_of_the_text():
    text = "A first part of the text. Sign up, it is free, to keep reading! " + "b " * 3
    assert selectors.wall_words(text) == "Sign up, it is free, to keep reading"
    assert selectors.wall_words("") is None and selectors.wall_words("sign up") is None
    assert selectors.wall_words("word " * 200_000 + "subscribe to read this story") == "subscribe to read this story"


@pytest.mark.parametrize("kept", ["<div class=cookie-recipe>x</div>", "<div id=cookies-and-cakes>x</div>", "<div role=banner>x</div>", "<div role=contentinfo>x</div>", "<div role=complementary>x</div>", "<ol class=breadcrumb>x</ol>", "<div class=share-price>x</div>", "<div class='ad'>x</div>", "<div class=advertising-history>x</div>", "<main><header>x</header></main>", "<p class=related>x</p>"])
def test_texts_that_only_sound_like_noise_stay(kept):
    text, removed = selectors.clean_text(f"<p>a</p>{kept}")
    assert "x" in text and removed == 0


@pytest.mark.parametrize("gone", ["<div class='my-Cookie-Consent-box'>x</div>", "<div id=cookie-consent>x</div>", "<div role=navigation>x</div>", "<form role=search>x</form>", "<div class=newsletter-box>x</div>", "<a class=btn-subscribe>x</a>", "<div class='left sidebar'>x</div>", "<div id=sidebar>x</div>", "<div id=comments>x</div>", "<div class=comments>x</div>", "<ins class=adsbygoogle>x</ins>"])
def test_noise_goes(gone):
    text, removed = selectors.clean_text(f"<p>a</p>{gone}")
    assert text.strip() == "a" and removed == 1
