"""The office readers beyond plain parts, held to what each file says."""

import pytest

from scrivane.plans.office_queries import MC, A, R, W, relations, sheet_file, slide_file, word_file
from scrivane.sources import office

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def word(body, **more):
    return office.convert("docx", office.zipped({"word/document.xml": f"<w:document {W} {R} {MC} {A} {M}><w:body>{body}</w:body></w:document>", **{k.replace("__", "/") + ".xml": v for k, v in more.items()}}))


def run(text, properties=""):
    return f'<w:r><w:rPr>{properties}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def test_word_file_reads_whole():
    assert office.convert("docx", word_file("T & t", "body", "note", "https://x.example/?a=1&b=2")) == "# T & t\n\nbody\n\n[see](https://x.example/?a=1&b=2)[^1]\n\n[^1]: note"


def test_inserted_stays_and_deleted_goes():
    assert word(f"<w:p><w:ins>{run('new')}</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del><w:moveFrom>{run('was')}</w:moveFrom></w:p>") == "new"


def test_emphasis_joins_runs_and_leaves_blanks_outside():
    assert word(f"<w:p>{run('a ', '<w:b/>')}{run('b', '<w:b/>')}{run(' c ')}{run('d', '<w:b/><w:i/>')}{run('e', '<w:b w:val=%s0%s/>' % (chr(34), chr(34)))}</w:p>") == "**a b** c ***d***e"


def test_alternate_content_is_read_once():
    box = f"<w:txbxContent><w:p>{run('inside')}</w:p></w:txbxContent>"
    body = f"<w:p>{run('x')}<w:r><mc:AlternateContent><mc:Choice><w:drawing>{box}</w:drawing></mc:Choice><mc:Fallback><w:pict>{box}</w:pict></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    assert word(body) == "x\n\ninside"


def test_equations():
    e = lambda name, *kids: f"<m:{name}>{''.join(kids)}</m:{name}>"
    t = lambda s: e("r", e("t", s))
    made = e("oMath", e("f", e("num", t("a")), e("den", t("b"))), e("sSup", e("e", t("x")), e("sup", t("2"))), e("rad", e("deg"), e("e", t("y"))))
    assert word(f"<w:p>{run('is ')}{made}</w:p>") == r"is $\frac{a}{b}x^{2}\sqrt{y}$"


def test_spans_and_merges_keep_columns():
    cell = lambda s, p="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p>{run(s)}</w:p></w:tc>"
    made = word(f'<w:tbl><w:tr>{cell("a", "<w:gridSpan w:val=%s2%s/>" % (chr(34), chr(34)))}{cell("b", "<w:vMerge w:val=%srestart%s/>" % (chr(34), chr(34)))}</w:tr><w:tr>{cell("c")}{cell("d")}{cell("hidden", "<w:vMerge/>")}</w:tr></w:tbl>')
    assert made.split("\n")[0] == "| a |  | b |" and made.split("\n")[-1] == "| c | d |  |"


def test_lists_through_styles_and_overrides():
    numbering = (f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>'
                 '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>')
    styles = f'<w:styles {W}><w:style w:styleId="L"><w:basedOn w:val="K"/></w:style><w:style w:styleId="K"><w:basedOn w:val="L"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style></w:styles>'
    number = lambda n: f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr>'
    body = f'<w:p><w:pPr><w:pStyle w:val="L"/></w:pPr>{run("one")}</w:p><w:p><w:pPr>{number(2)}</w:pPr>{run("five")}</w:p><w:p><w:pPr><w:pStyle w:val="L"/>{number(0)}</w:pPr>{run("plain")}</w:p>'
    assert word(body, word__numbering=numbering, word__styles=styles) == "1. one\n5. five\n\nplain"


def test_slides_read_alternates_diagrams_and_charts_once():
    assert office.convert("pptx", slide_file("T", "top", "low", "7")) == "## Slide 1: T\n\n- top\n    - low\n\n### Chart\n\n| Category | balance |\n| --- | --- |\n| top | 7 |"


def test_slide_tables_and_pictures():
    cell = lambda s: f"<a:tc><a:txBody><a:p><a:r><a:t>{s}</a:t></a:r></a:p></a:txBody></a:tc>"
    tree = f'<p:grpSp><p:pic><p:nvPicPr><p:cNvPr name="n" descr="a dog"/></p:nvPicPr><p:blipFill><a:blip r:embed="r1"/></p:blipFill></p:pic></p:grpSp><p:graphicFrame><a:tbl><a:tr>{cell("h")}</a:tr><a:tr>{cell("v")}</a:tr></a:tbl></p:graphicFrame>'
    data = office.zipped({"ppt/presentation.xml": f'<p:p xmlns:p="p" {R}><p:sldId id="1" r:id="r1"/></p:p>', "ppt/_rels/presentation.xml.rels": relations(r1="slides/s.xml"),
                          "ppt/slides/s.xml": f'<p:s xmlns:p="p" {A} {R}><p:spTree>{tree}</p:spTree></p:s>', "ppt/slides/_rels/s.xml.rels": relations(r1="../media/d.png")})
    assert office.convert("pptx", data) == "## Slide 1\n\n![a dog](ppt/media/d.png)\n\n| h |\n| --- |\n| v |"


@pytest.mark.parametrize("serial, said", [("1", "1900-01-01 00:00:00"), ("61", "1900-03-01 00:00:00"), ("45292.5", "2024-01-01 12:00:00"), ("0.25", "06:00:00"), ("x", "x"), ("1e30", "1e30")])
def test_dates(serial, said):
    assert office.convert("xlsx", sheet_file("S", serial, "1", "word")) == f"## S\n\n| {said} | True | word | {serial} |\n| --- | --- | --- | --- |"


def test_parts_are_rewritten_by_their_type():
    types = '<Types><Default Extension="xml" ContentType="a/plain"/><Override PartName="/x/one.xml" ContentType="a/one"/></Types>'
    data = office.zipped({"[Content_Types].xml": types, "x/one.xml": "<r><t>old</t></r>", "x/two.xml": "<r><t>old</t></r>"})

    def renew(root):
        root[0].text = "new"
        return True

    z = office.open_archive(office.rewrite_parts(data, {"a/one": renew}))
    assert b"new" in z.read("x/one.xml") and z.read("x/two.xml") == b"<r><t>old</t></r>"
    assert office.rewrite_parts(data, {"a/one": lambda root: False, "a/none": renew}) is data


def test_slugs_keep_three_digits_and_lose_outer_dashes(spark):
    from pyspark.sql import functions as F

    from scrivane.operators.records import ordinal_slug

    rows = spark.createDataFrame([("(A) plan!", 3), ("?!", 4), ("x", 123)], "t string, n int").select(ordinal_slug(F.col("t"), F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["03-a-plan", "04", "123-x"]
