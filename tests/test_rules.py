"""Selectors, Markdown rendering and the façade."""

import json

import pytest
from pyspark.sql import functions as F

from scrivane.functions import commonmark, selectors
from scrivane.functions import markup as M
from scrivane.operators import reading, settings
from scrivane.sources import readers

PAGE = '<body><nav class="a b">n</nav><div id=content><p class=x data-k="Vv1">t</p></div><div class="Cookie-bar">c</div><main><aside>z</aside></main></body>'


@pytest.mark.parametrize("selector, tags", [
    ("nav", ["nav"]), ("body > p", []), ("body p", ["p"]), ("body > div > p", ["p"]), ("#content .x", ["p"]), (".a.b", ["nav"]), (".a.c", []), ("[data-k^=V]", ["p"]), ('[data-k="Vv1"]', ["p"]), ("[data-k$=1]", ["p"]),
    ("[class*=cookie i]", ["div"]), ("[class*=cookie]", []), ("nav, aside", ["nav", "aside"]), ("*[id]", ["div"]), ("main > *", ["aside"]),
])
def test_selectors(selector, tags):
    assert [n.tag for n in selectors.select(M.parse(PAGE), selector)] == tags


def test_isolate_and_remove():
    assert M.text_of(selectors.isolate(M.parse(PAGE), "main")) == "z"
    with pytest.raises(LookupError):
        selectors.isolate(M.parse(PAGE), "#none")
    root = M.parse(PAGE)
    assert selectors.remove(root, ["nav", "aside"], "why") == [("nav", "why"), ("aside", "why")] and M.text_of(root) == "t c"


@pytest.mark.parametrize("text, html", [
    ("", ""), ("# A #", "<h1>A</h1>"), ("a\nb", "<p>a\nb</p>"), ("a  \nb", "<p>a<br>\nb</p>"), ("T\n-", "<h2>T</h2>"), ("- a\n- b", "<ul><li>a</li><li>b</li></ul>"), ("- a\n\n- b", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"),
    ("2) x\n3) y", '<ol start="2"><li>x</li><li>y</li></ol>'), ("- a\n  - b\n\n1. c", "<ul><li>a<ul><li>b</li></ul></li></ul><ol><li>c</li></ol>"), ("> a\n> > b", "<blockquote><p>a</p><blockquote><p>b</p></blockquote></blockquote>"),
    ("`a*b*` *c* **d** \\*e", "<p><code>a*b*</code> <em>c</em> <strong>d</strong> *e</p>"), ("<b>", "<b>"), ("x <b>y</b>", "<p>x <b>y</b></p>"), ("[a](b \"t\") ![c](d)", '<p><a href="b" title="t">a</a> <img src="d" alt="c"></p>'),
    ("~~~\n```\n~~~", "<pre><code>```\n</code></pre>"), ("|a|b|\n|-|-|\n|1|", '<table><thead><tr><th scope="col">a</th><th scope="col">b</th></tr></thead><tbody><tr><td>1</td><td></td></tr></tbody></table>'), ("***", "<hr>"), ("snake_case_word", "<p>snake_case_word</p>"),
])
def test_markdown(text, html):
    assert commonmark.render(text) == html


def test_markdown_document():
    page = commonmark.document("x <script>y</script>", "Fall & back", "md")
    assert "<title>Fall &amp; back</title>" in page and "<h1>Fall &amp; back</h1>" in page and "<script>" not in page


@pytest.mark.parametrize("hay, needle, want", [("a b c", "a c", True), ("a b c", "c a", False), ("a " + "x " * 39 + "c", "a c", True), ("a " + "x " * 40 + "c", "a c", False), ("a", "", True), ("a " + "x " * 50 + "a b", "a b", True)])
def test_words_in_order(hay, needle, want):
    assert selectors.words_in_order(hay.split(), needle.split()) is want


def test_options():
    assert settings.Options(ocr_language="deu").ignored() and not settings.Options().ignored()
    for bad in ({"mode": "x"}, {"target_characters": 5}, {"page_width": "3em"}):
        with pytest.raises(ValueError):
            settings.Options(**bad)


def test_library(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.example/", "<title>T</title><h1>Top é</h1><p>Some body</p><img src=a.png>"), (2, "https://b.example/", "")], "page_id bigint, url string, html string")
    lib = reading.Library(spark)
    lib.capture(pages)
    assert [r.text for r in lib.query_chunks("BODY").collect()] == ["Top é\nSome body"]
    assert lib.query_chunks("", offset=5).count() == 0
    first = lib.read_markdown(1, 0, 7).first()
    assert first.text == "# Top " and lib.read_markdown(1, first.next_offset).first().text.startswith("é")
    assert lib.read_markdown(1, 10_000).first().text is None
    assert lib.list_assets(1).first().src == "a.png" and lib.get_manifest(1).first().untrusted and all(r.passed for r in lib.doctor().where("need = 'required'").collect())
    files = spark.createDataFrame([("a.bin", bytearray(b"abcdef"))], "path string, content binary")
    assert lib.read_asset(files, "a.bin", 2, 3).first().next_offset == 5
    with pytest.raises(ValueError):
        lib.query_chunks("x", offset=-1)
    with pytest.raises(TypeError):
        lib.query_chunks("x", colour="red")
    readers.write_bundle(lib.tables["markdown"], lib.tables["chunks"], str(tmp_path / "b"))
    lines = [json.loads(r.value) for r in readers.text_records(spark, str(tmp_path / "b/chunks/page_id=1")).collect()]
    assert lines[0]["chunk_id"] == "ch_000001" and lines[0]["meta"]["kind"] == "text"
    target = readers.publish(pages, str(tmp_path / "p"), "1")
    with pytest.raises(Exception):
        readers.publish(pages, str(tmp_path / "p"), "1")
    assert spark.read.parquet(target).count() == 2


def test_json_lines_break_at_newlines_only(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes('{"id":"a","text":"p q\u0085r"}\n{"id":"b","text":"s"}\n'.encode())
    assert [r.chunk_id for r in reading.chunk_projection(readers.text_records(spark, str(tmp_path / "x.jsonl"))).collect()] == ["a", "b"]


def test_windows_of_every_size(spark):
    text = "aé€😀z"
    df = spark.createDataFrame([(text,)], "t string")
    data = text.encode()
    for offset in range(len(data) + 1):
        for window in (4, 5, 7):
            got = df.select(reading.byte_window(F.col("t").cast("binary"), offset, window).alias("w")).select("w.*").first()
            want = data[offset : offset + window]
            while offset + len(want) < len(data) and data[offset + len(want)] & 0xC0 == 0x80:
                want = want[:-1]
            assert bytes(got.data) == want and got.next_offset == (offset + len(want) if offset + len(want) < len(data) else None)


def test_command_line():
    from scrivane.__main__ import build_parser

    assert build_parser().parse_args(["query", "c", "x", "--limit", "3"]).limit == 3
    with pytest.raises(SystemExit):
        build_parser().parse_args(["query", "c", "x", "--unknown"])
