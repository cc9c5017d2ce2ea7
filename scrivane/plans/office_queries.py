"""Queries over files of office formats built from the rows of whole tables, and over journeys of modules."""

from __future__ import annotations

from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.arrow import arrow_function
from scrivane.operators import hierarchy as H
from scrivane.operators import media as V
from scrivane.plans import chunk_queries
from scrivane.plans.registry import query, table
from scrivane.sources import office

# Namespaces of the formats.
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
MC = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def relations(**targets: str) -> str:
    """A relationships part; addresses of other hosts stand outside the package."""
    one = lambda k, t: f'<Relationship Id="{k}" Target="{escape(t)}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in t else ""}/>'
    return RELS.format("".join(one(k, t) for k, t in targets.items()))


def word_file(title: str, text: str, note: str, link: str) -> bytes:
    """A heading by its style's name, the text in a content control beside deleted text, a link and a footnote."""
    t = lambda s: f'<w:r><w:t xml:space="preserve">{escape(s)}</w:t></w:r>'
    body = (f'<w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr>{t(title)}</w:p><w:sdt><w:sdtPr/><w:sdtContent><w:p>{t(text)}<w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p></w:sdtContent></w:sdt>'
            f'<w:p><w:hyperlink r:id="r9">{t("see")}</w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>')
    return office.zipped({
        "word/document.xml": f"<w:document {W} {R}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Own"><w:name w:val="mine"/><w:basedOn w:val="H1"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="2"><w:p><w:r><w:footnoteRef/></w:r>{t(note)}</w:p></w:footnote></w:footnotes>',
        "word/_rels/document.xml.rels": relations(r9=link),
    })


def slide_file(title: str, above: str, below: str, number: str) -> bytes:
    """A title in alternate content, a diagram of two points and a chart of one value."""
    p = lambda s: f"<a:p><a:r><a:t>{escape(s)}</a:t></a:r></a:p>"
    shape = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{p(title)}</p:txBody></p:sp>'
    frame = lambda inner: f"<p:graphicFrame><a:graphic><a:graphicData>{inner}</a:graphicData></a:graphic></p:graphicFrame>"
    tree = (f'<mc:AlternateContent><mc:Choice Requires="x">{shape}</mc:Choice><mc:Fallback>{shape}</mc:Fallback></mc:AlternateContent>' + frame('<d:relIds xmlns:d="d" r:dm="r2"/>') + frame('<c:chart xmlns:c="c" r:id="r3"/>'))
    point = lambda k, s: f'<d:pt modelId="{k}"><d:t>{p(s)}</d:t></d:pt>'
    value = lambda s: f'<c:pt idx="0"><c:v>{escape(s)}</c:v></c:pt>'
    return office.zipped({
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldId id="256" r:id="r1"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations(r1="slides/slide1.xml"),
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" {A} {R} {MC}><p:cSld><p:spTree>{tree}</p:spTree></p:cSld></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": relations(r2="../diagrams/data1.xml", r3="../charts/chart1.xml"),
        "ppt/diagrams/data1.xml": f'<d:dataModel xmlns:d="d" {A}><d:ptLst><d:pt modelId="0" type="doc"/>{point(2, below)}{point(1, above)}</d:ptLst><d:cxnLst><d:cxn srcId="0" destId="1" srcOrd="0"/><d:cxn srcId="1" destId="2" srcOrd="0"/></d:cxnLst></d:dataModel>',
        "ppt/charts/chart1.xml": f'<c:chartSpace xmlns:c="c"><c:ser><c:tx><c:strRef><c:strCache>{value("balance")}</c:strCache></c:strRef></c:tx><c:cat><c:strRef><c:strCache>{value(above)}</c:strCache></c:strRef></c:cat><c:val><c:numRef><c:numCache>{value(number)}</c:numCache></c:numRef></c:val></c:ser></c:chartSpace>',
    })


def sheet_file(name: str, serial: str, truth: str, text: str) -> bytes:
    """A row with a date by a format of the file's own, a truth value and a shared string with its reading."""
    return office.zipped({
        "xl/workbook.xml": f'<workbook {R}><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations(r1="worksheets/sheet1.xml"),
        "xl/sharedStrings.xml": f"<sst><si><r><t>{escape(text)}</t></r><rPh><t>reading</t></rPh></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="164" formatCode="[$-409]d\\-mmm\\-yyyy;@"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1"><c r="A1" s="1"><v>{serial}</v></c><c r="B1" t="b"><v>{truth}</v></c><c r="C1" t="s"><v>0</v></c><c r="D1"><v>{serial}</v></c></row></sheetData></worksheet>',
    })


FILES = {"docx": word_file, "pptx": slide_file, "xlsx": sheet_file}


def _built(kind: str):
    @arrow_function("binary")
    def build(fields: pa.Array) -> pa.Array:
        values = [v or "" for v in fields.flatten().to_pylist()]
        n = len(values) // max(len(fields), 1)  # of each row
        return pa.array([FILES[kind](*values[at : at + n]) for at in range(0, len(values), n or 1)], pa.binary())

    return build


word_files, slide_files, sheet_files = map(_built, FILES)


def _read(df: DataFrame, key: str, kind: str, build, *fields) -> DataFrame:
    content = build(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]))
    return df.select(key, office.converted_from(kind)(content).alias("r")).select(key, F.sha2("r.markdown", 256).alias("sha"), F.coalesce("r.error", F.lit("")).alias("error"))


@query("""WITH t AS (SELECT doc_id, lang, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS words, chr(10) || chr(10) AS gap FROM documents)
SELECT doc_id, sha256('# Document ' || doc_id || gap || CASE words WHEN '' THEN '' ELSE words || gap END || '[see](https://d.example/' || doc_id || ')[^1]' || gap || '[^1]: ' || coalesce(lang, '')) AS sha, '' AS error FROM t""")
def office_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " "))
    return _read(table(spark, d, "documents"), "doc_id", "docx", word_files, F.concat(F.lit("Document "), "doc_id"), words, F.col("lang"), F.concat(F.lit("https://d.example/"), "doc_id"))


@query("""SELECT c_custkey, sha256('## Slide 1: ' || trim(c_name) || gap || '- ' || trim(c_mktsegment) || chr(10) || '    - ' || c_custkey || gap || '### Chart' || gap || '| Category | balance |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || trim(c_mktsegment) || ' | ' || c_custkey || ' |') AS sha, '' AS error
FROM (SELECT *, chr(10) || chr(10) AS gap FROM customer)""")
def office_slides(spark: SparkSession, d: str) -> DataFrame:
    return _read(table(spark, d, "customer", heavy=True), "c_custkey", "pptx", slide_files, F.trim("c_name"), F.trim("c_mktsegment"), F.col("c_custkey"), F.col("c_custkey"))


@query("""SELECT o_orderkey, sha256('## Orders' || chr(10) || chr(10) || '| ' || strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00 | ' || CASE o_orderkey % 2 WHEN 1 THEN 'True' ELSE 'False' END || ' | ' || trim(o_orderpriority) || ' | ' || (o_orderdate::DATE - DATE '1899-12-30') || ' |' || chr(10) || '| --- | --- | --- | --- |') AS sha, '' AS error FROM orders""")
def office_sheets(spark: SparkSession, d: str) -> DataFrame:
    serial = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date"))
    return _read(table(spark, d, "orders", heavy=True), "o_orderkey", "xlsx", sheet_files, F.lit("Orders"), serial, F.col("o_orderkey") % 2, F.trim("o_orderpriority"))


def _journey(spark, d):
    """Regions, nations and suppliers as an outline whose modules are the suppliers, and what became of two thirds of them."""
    level = lambda name, key, parent, title: table(spark, d, name).select(F.col(key).cast("bigint").alias("key"), (F.col(parent) if parent else F.lit(None)).cast("bigint").alias("parent_key"), F.col(title).alias("title"), F.lit(None).cast("bigint").alias("listed"))
    nodes = H.renumbered([level("region", "r_regionkey", None, "r_name"), level("nation", "n_nationkey", "n_regionkey", "n_name"), level("supplier", "s_suppkey", "s_nationkey", "s_name")])
    nodes = nodes.withColumn("level", F.when(F.col("level") == "chapter", "module").otherwise(F.col("level")))
    outcomes = nodes.where("level = 'module' AND key % 3 < 2").select("node_id", F.when(F.col("key") % 3 == 0, "captured").otherwise("refused").alias("status"))
    return nodes, outcomes


_JOURNEY = r"""WITH r AS (SELECT r_regionkey, printf('course-%02d', row_number() OVER (ORDER BY r_regionkey)) AS r_id FROM region),
n AS (SELECT n_nationkey, r_id, r_id || '/' || printf('part-%02d', k) AS n_id, printf('%02d-', k) || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS n_slug FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) JOIN r ON n_regionkey = r_regionkey),
m AS (SELECT s_suppkey, s_name, r_id, n_id, n_slug, n_id || '/' || printf('chapter-%02d', k) AS m_id, printf('%02d-', k) || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS m_slug FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier) JOIN n ON s_nationkey = n_nationkey) """


@query(_JOURNEY + "SELECT m_id AS node_id, n_slug || '/' || m_slug AS directory FROM m WHERE s_suppkey % 3 = 0")
def captured_directories(spark: SparkSession, d: str) -> DataFrame:
    return H.captured_directories(*_journey(spark, d))


@query(_JOURNEY + "SELECT unnest([r_id, n_id, m_id]) AS entry, m_id AS node_id, s_name AS title, CASE s_suppkey % 3 WHEN 1 THEN 'refused' ELSE 'not-reached' END AS status FROM m WHERE s_suppkey % 3 <> 0")
def refused_modules(spark: SparkSession, d: str) -> DataFrame:
    return H.refused(*_journey(spark, d))


@query(f"""SELECT conv_id, (n + 1)::BIGINT AS number, role AS title, trim(text, ' ') AS instruction, false AS silent, round(start, 3) AS start_seconds, round(start + duration, 3)::DOUBLE AS end_seconds, round(duration, 3)::DOUBLE AS duration_seconds,
CASE WHEN start >= 3600 THEN printf('%d:%02d:%02d', floor(start)::BIGINT // 3600, floor(start)::BIGINT // 60 % 60, floor(start)::BIGINT % 60) ELSE printf('%d:%02d', floor(start)::BIGINT // 60, floor(start)::BIGINT % 60) END AS timestamp,
1::BIGINT AS cues, CASE WHEN turn % 2 = 0 THEN role ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' a' END AS cue_text, round(CASE WHEN turn % 2 = 0 THEN start + 0.5 ELSE start END, 3) AS cue_start, round(sum(duration) OVER (PARTITION BY conv_id), 3)::DOUBLE AS whole_seconds, 'pb' || conv_id AS playbook
FROM ({chunk_queries._STARTS})""")
def steps_payloads(spark: SparkSession, d: str) -> DataFrame:
    playbooks = chunk_queries._playbooks(spark, d)
    ids = playbooks.select("conv_id", F.col("p.id").alias("playbook"))
    made = V.steps_payload(V.step_rows(playbooks, "conv_id").join(ids, "conv_id"), "conv_id", {"playbook_id": F.first("playbook")})
    cue = "struct<text: string, start_seconds: double, end_seconds: double, timestamp: string>"
    step = f"struct<number: bigint, title: string, instruction: string, silent: boolean, start_seconds: double, end_seconds: double, duration_seconds: double, timestamp: string, transcript: array<{cue}>>"
    read = made.select("conv_id", F.from_json("payload", f"playbook_id string, duration_seconds double, steps array<{step}>").alias("p"))
    rows = read.select("conv_id", F.col("p.playbook_id").alias("playbook"), F.col("p.duration_seconds").alias("whole_seconds"), F.explode("p.steps").alias("s"))
    fields = [F.col(f"s.{n}").alias(n) for n in ("number", "title", "instruction", "silent", "start_seconds", "end_seconds", "duration_seconds", "timestamp")]
    first = F.get("s.transcript", 0)
    return rows.select("conv_id", "playbook", "whole_seconds", *fields, F.size("s.transcript").cast("bigint").alias("cues"), first["text"].alias("cue_text"), first["start_seconds"].alias("cue_start"))
