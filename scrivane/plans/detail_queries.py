"""Queries over the smaller rules: noise, walls, print and access checks, records and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import text as X
from scrivane.operators import hierarchy as H
from scrivane.operators import ocr as O
from scrivane.operators import records as B
from scrivane.operators import rules as R
from scrivane.operators import structure as S
from scrivane.plans.page_queries import C
from scrivane.plans.registry import query, table


@query(r"""SELECT n_nationkey, n_name || chr(10) || 'tail' AS text, 4 AS removed, 'onetrust' AS consent, CASE n_nationkey % 2 WHEN 0 THEN 'cloudflare' ELSE '' END AS robots, CASE n_nationkey % 2 WHEN 1 THEN 'generic' ELSE '' END AS walls FROM nation""")
def noise_filtered(spark: SparkSession, d: str) -> DataFrame:
    extra = F.when(F.col("n_nationkey") % 2 == 0, '<form id="challenge-form"></form>').otherwise('<i class="Paywall"></i>')
    html = C("<body><nav>menu</nav><header>top</header><article><p>", F.col("n_name"), '</p><div class="related-posts">more</div><p>tail</p></article><div id="onetrust-consent-sdk">cookies?</div>', extra, "</body>")
    n = table(spark, d, "nation").select("n_nationkey", html.alias("h"))
    return n.select("n_nationkey", R.cleaned(F.col("h"))["text"].alias("text"), R.cleaned(F.col("h"))["removed"].alias("removed"), F.array_join(R.consent_managers(F.col("h")), ",").alias("consent"),
                    F.array_join(R.robot_checks(F.col("h")), ",").alias("robots"), F.array_join(R.access_walls(F.col("h")), ",").alias("walls"))


@query(r"""SELECT page_id, regexp_replace(html, '(?s)^.*<article>.*?<h1>.*$', 'yes') = 'yes' AS isolated, false AS found FROM pages""")
def isolated_roots(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", R.isolated_text(F.col("html"), F.lit("article")).alias("a"), R.isolated_text(F.col("html"), F.lit("#nothing")).alias("b"))
    return p.select("page_id", (F.length("a") > 0).alias("isolated"), F.col("b").isNotNull().alias("found"))


@query("""SELECT page_id, 'article' AS selector, 'static' AS strategy FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT page_id, '#x', 'explicit' FROM pages WHERE page_id % 3 = 0""")
def content_choice(spark: SparkSession, d: str) -> DataFrame:
    p, m = table(spark, d, "pages"), F.col("page_id") % 3
    html = F.concat(F.lit("<body><main>short</main><article><p>"), F.repeat(F.lit("long text "), 40), F.lit("</p></article></body>"))
    candidates = p.select("page_id", F.explode(R.content_candidates(html)).alias("c")).select("page_id", "c.*")
    best = S.best_region(candidates).select("page_id", F.col("selector").alias("static"))
    joined = p.join(best, "page_id", "left").select("page_id", S.selection(F.when(m == 0, "#x"), F.lit(None).cast("string"), F.col("static")).alias("s"))
    return joined.select("page_id", F.col("s.root").alias("selector"), "s.strategy")


@query("""SELECT p_partkey, '<h1>' || p_name || '</h1><p>x <strong>b</strong> ' || p_size || '</p><ul><li>a</li><li>c</li></ul><table><thead><tr><th scope="col">k</th></tr></thead><tbody><tr><td>' || p_partkey || '</td></tr></tbody></table>' AS html, p_name AS title FROM part""")
def markdown_pages(spark: SparkSession, d: str) -> DataFrame:
    md = C("# ", F.col("p_name"), "\n\nx **b** ", F.col("p_size"), "\n\n- a\n- c\n\n| k |\n| --- |\n| ", F.col("p_partkey"), " |\n\n<script>x</script>")
    md = F.replace(md, F.lit("\n\n<script>x</script>"), F.lit(""))
    p = table(spark, d, "part", heavy=True).select("p_partkey", md.alias("md"))
    return p.select("p_partkey", R.markdown_html(F.col("md")).alias("html"), F.regexp_extract(R.markdown_document(F.col("md"), F.lit("f"), F.lit("md")), "<title>(.*?)</title>", 1).alias("title"))


_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT doc_id, sha256('<blockquote><p><em>by <strong>' || source || '</strong> in <a title="No. ' || doc_id || '" href="/d/' || doc_id || '">' || lang || '</a></em></p></blockquote><ul><li>as it is:<pre><code>'
|| {_ESCAPED.format("text")} || chr(10) || '</code></pre></li></ul>') AS html_sha FROM documents""")
def markdown_references(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents in Markdown with nested marks, a link whose definition follows, and their text as code in a list."""
    from scrivane.functions.text import fence

    code = F.concat(F.lit("  "), F.replace(fence(F.col("text")), F.lit("\n"), F.lit("\n  ")))
    md = C("> *by **", F.col("source"), "** in [", F.col("lang"), "][Doc  ", F.col("doc_id"), "]*\n\n- as it is:\n", code, "\n\n[doc ", F.col("doc_id"), "]: </d/", F.col("doc_id"), "> 'No. ", F.col("doc_id"), "'")
    return table(spark, d, "documents").select("doc_id", F.sha2(R.markdown_html(md), 256).alias("html_sha"))


@query("""SELECT s_suppkey, 'a.css,b.css' AS imports, CASE s_suppkey % 2 WHEN 0 THEN 'More' ELSE '' END AS collapsed, CASE s_suppkey % 2 WHEN 0 THEN 'More' ELSE '' END AS warned FROM supplier""")
def css_and_collapsed(spark: SparkSession, d: str) -> DataFrame:
    css = C("/* @import 'no.css'; */ @import url(a.css); @import \"b.css\" print; p{color:", F.col("s_suppkey"), "} @import 'late.css';")
    body = F.when(F.col("s_suppkey") % 2 == 0, F.repeat(F.lit("hidden words here "), 20)).otherwise("few")
    s = table(spark, d, "supplier").select("s_suppkey", R.css_imports(css).alias("i"), R.collapsed(C("<details><summary>More</summary>", body, "</details><details open><summary>Open</summary>", F.repeat(F.lit("seen words "), 40), "</details>")).alias("c"))
    return s.select("s_suppkey", F.array_join("i", ",").alias("imports"), F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("collapsed"), R.collapsed_warning(F.col("c"), F.lit("some other text")).alias("warned"))


@query("""SELECT p_partkey, '{"@type": "Thing", "n": ' || p_partkey || '}' AS first, true AS second_failed FROM part""")
def json_ld_export(spark: SparkSession, d: str) -> DataFrame:
    html = C('<script type="application/ld+json">{"@type":"Thing","n":', F.col("p_partkey"), '}</script><script type="application/ld+json">{bad</script><script>{"x":1}</script>')
    p = table(spark, d, "part").select("p_partkey", R.json_ld(html).alias("j"))
    return p.select("p_partkey", F.get("j", 0).alias("first"), F.contains(F.get("j", 1), F.lit("parseError")).alias("second_failed"))


@query("""SELECT n_nationkey, n_nationkey % 2 = 0 AS same, ['Published 2020-01-02 by Ann.', 'By Ann.', ''][n_nationkey % 3 + 1] AS note FROM nation""")
def people_and_notes(spark: SparkSession, d: str) -> DataFrame:
    n, m = table(spark, d, "nation"), F.col("n_nationkey") % 3
    return n.select("n_nationkey", R.same_people(F.concat(F.lit("Lee, "), "n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" Lee"))).otherwise("Bo")).alias("same"),
                    R.watch_note(F.when(m == 0, "2020-01-02"), F.when(m < 2, "Ann")).alias("note"))


@query("""SELECT n_nationkey, 'h' || n_nationkey || ' lost' AS heading, 'lost' AS state FROM nation UNION ALL SELECT n_nationkey, 'Only Bundle', 'unprinted' FROM nation UNION ALL SELECT n_nationkey, 'only print', 'hidden' FROM nation""")
def missing_headings(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    heads = n.select("n_nationkey", F.explode(F.array(C("h", F.col("n_nationkey"), " lost"), F.lit("Only Bundle"), F.lit("only  bundle"), F.lit("only print"), F.lit("in both"))).alias("heading"))
    texts = n.select("n_nationkey", X.tokens(F.lit("in the both and only the print")).alias("printed"), X.tokens(F.lit("in both only bundle")).alias("bundle"))
    return R.missing_headings(heads, texts, "n_nationkey")


_BOXES = "SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS id, l_linenumber AS line, l_quantity * 4 AS x0, l_quantity * 4 + 9 AS x1, l_linenumber * 10.0 AS y0, l_linenumber * 10.0 + 12 AS y1 FROM lineitem"


def _boxes(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (n * 1000000 + F.col("l_partkey")).alias("id"), n.alias("line"), (q * 4).alias("x0"), (q * 4 + 9).alias("x1"), (n * 10.0).alias("y0"), (n * 10.0 + 12).alias("y1"))


@query(f"""WITH b AS ({_BOXES}) SELECT a.page, a.id AS first, b.id AS second FROM b AS a JOIN b ON a.page = b.page AND a.id < b.id AND a.line <> b.line AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def overprinted(spark: SparkSession, d: str) -> DataFrame:
    return R.overprinted(_boxes(spark, d))


@query(f"""WITH b AS ({_BOXES}) SELECT page, id FROM b WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT page, line FROM b WHERE line % 2 = 0) p WHERE p.page = b.page AND p.line > b.line AND b.x0 >= 40 AND b.x1 <= 140 AND b.y0 >= 5 AND b.y1 <= 60)""")
def covered_text(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d).withColumn("ord", F.col("line"))
    painted = b.where("line % 2 = 0").select("page", "ord", F.lit(40.0).alias("x0"), F.lit(140.0).alias("x1"), F.lit(5.0).alias("y0"), F.lit(60.0).alias("y1")).distinct()
    return R.covered(b, painted)


@query("""SELECT p_partkey, CASE WHEN cost > 536870912 THEN r END::BIGINT AS piece_rows, CASE WHEN cost > 536870912 THEN ceil(n / r)::BIGINT ELSE 1 END AS pieces, least(p_size * 100, ceil(p_size / 72.0 * 300))::BIGINT AS pixels FROM (
  SELECT *, greatest(least(floor(33554432 / ((1 + c / n) * g * 64)), 1000), 1) AS r FROM (SELECT *, (n + c) * g * 64 AS cost FROM (SELECT p_partkey, p_size, p_partkey * 20 AS n, p_partkey * 60 AS c, p_size AS g FROM part)))""")
def table_split_plan(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = R.split_plan(table(spark, d, "part").select("p_partkey", "p_size", (k * 20).alias("n_rows"), (k * 60).alias("n_cells"), F.col("p_size").alias("n_pages")))
    return t.select("p_partkey", F.col("piece_rows").cast("bigint").alias("piece_rows"), F.col("pieces").cast("bigint").alias("pieces"), R.image_target(F.col("p_size") * 100, F.col("p_size").cast("double")).alias("pixels"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'subscribe to read' END AS phrase, s_suppkey % 2 = 0 AS ligature, s_suppkey % 2 = 1 AS lost, s_suppkey % 4 = 0 AS wall FROM supplier""")
def print_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    t = F.when(k % 3 == 0, "A long opening of an article. Subscribe to read more").when(k % 3 == 1, "Subscribe to read: and then follows the whole of a long text").otherwise("nothing here")
    cut = F.when(k % 2 == 0, "a longer cut sentence").otherwise("another longer cut sentence")
    html = F.when(k % 2 == 0, "<input type='password' name=p>").otherwise("<p>")
    landed = F.when(k % 4 == 0, "https://login.example/").otherwise("https://a.example/x")
    return table(spark, d, "supplier").select("s_suppkey", R.wall_phrase(t, ["subscribe to read", "sign in to go on"])["phrase"].alias("phrase"), R.has_ligatures(F.when(k % 2 == 0, "eﬃcient").otherwise("efficient")).alias("ligature"),
                                             R.lost_cut(cut, F.lit("it has a longer  cut\nsentence in it")).alias("lost"), R.sign_in_wall(html, F.lit("https://a.example/y"), landed).alias("wall"))


@query("""SELECT s_suppkey, s_suppkey % 2 = 0 AS pdf, CASE s_suppkey % 2 WHEN 0 THEN '2b' END AS flavour, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::INT END AS step, ['draw', 'convert', 'refuse', 'link'][s_suppkey % 4 + 1] AS picture, ['utf-8', NULL, 'utf-8-sig', NULL][s_suppkey % 4 + 1] AS charset FROM supplier""")
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    content = F.when(k % 2 == 0, '%PDF-1.7 <x pdfaid:part="2" pdfaid:conformance="B"/>').otherwise("PDF").cast("binary")
    src = F.element_at(F.array(*map(F.lit, ["data:image/png;base64,x", "data:image/tiff,x", "data:text/html,x", "a.png"])), (k % 4 + 1).cast("int"))
    data = F.when(k % 4 == 0, F.lit("né").cast("binary")).when(k % 4 == 1, F.lit("ascii").cast("binary")).when(k % 4 == 2, F.unhex(F.lit("EFBBBFC3A9"))).otherwise(F.unhex(F.lit("E900")))
    link = F.when(k % 3 == 0, C("https://appendix.invalid/step/", k)).otherwise("https://x.example/step/1")
    return table(spark, d, "supplier").select("s_suppkey", R.is_pdf(content).alias("pdf"), R.pdfa_flavour(content).alias("flavour"), R.back_link(link).alias("step"), R.drawable(src).alias("picture"), R.declared_charset(data).alias("charset"))


@query("""SELECT c_custkey, c_custkey % 4 <> 0 AS exposed, [NULL, 'outside the roots', 'scheme', 'user information', 'internal address', 'outside the roots', NULL][c_custkey % 7 + 1] AS refused FROM customer""")
def access_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = lambda allow, sid: F.array(F.struct(F.lit(allow).alias("allow"), F.lit(sid).alias("sid"), F.lit(False).alias("inherit_only")))
    dacl = F.when(k % 4 == 0, F.concat(entry(True, "me"), entry(False, "you"))).when(k % 4 == 1, entry(True, "you")).when(k % 4 == 3, entry(True, "S-1-5-18"))
    owner = F.when(k % 4 == 3, "you").otherwise("me")
    src = F.element_at(F.array(*map(F.lit, ["https://a.example/", "file:///etc/passwd", "ftp://a/", "https://u:p@a.example/", "http://10.0.0.8/", "/data/../etc", "/data/x"])), (k % 7 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", R.acl_exposed(owner, dacl, F.lit("me")).alias("exposed"), R.check_source(src, ["/data"]).alias("refused"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'no host' WHEN 1 THEN 'internal address' END AS refused, CASE n_nationkey % 3 WHEN 0 THEN 'no host' END AS private_refused FROM nation""")
def target_checks(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import check_target, is_internal

    m = F.col("n_nationkey") % 3
    n = table(spark, d, "nation").select("n_nationkey", F.when(m == 0, "https:///x").otherwise("https://a.example/").alias("u"), F.when(m == 1, F.array(F.lit("8.8.8.8"), F.lit("10.0.0.1"))).otherwise(F.array(F.lit("8.8.8.8"))).alias("addresses"))
    flags = n.select("n_nationkey", "u", F.explode("addresses").alias("a")).withColumn("i", is_internal(F.col("a"))).groupBy("n_nationkey", "u").agg(F.collect_list("i").alias("resolved"))
    return flags.select("n_nationkey", check_target(F.col("u"), F.col("resolved")).alias("refused"), check_target(F.col("u"), F.col("resolved"), True).alias("private_refused"))


@query("""SELECT o_orderkey, 'body' AS layer, true AS chrome_text, true AS aligned FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'furniture', false, false FROM orders WHERE o_orderkey % 2 = 1""")
def layers_and_alignment(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 2
    o = table(spark, d, "orders")
    items = o.select("o_orderkey", F.lit(0).alias("pos"), F.lit("paragraph").alias("type"), F.lit("furniture").alias("layer"), (k == 1).alias("chrome")).unionByName(o.select("o_orderkey", F.lit(5).alias("pos"), F.lit("heading").alias("type"), F.lit("body").alias("layer"), F.lit(False).alias("chrome")))
    first = R.refiled(items, "o_orderkey").where("pos = 0")
    flags = F.when(k == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False), F.lit(True)))
    return first.select("o_orderkey", "layer", R.in_chrome(F.when(k == 0, "Home  page").otherwise("away"), F.array(F.lit("the home page of"), F.lit("x"))).alias("chrome_text"), R.outside_chrome(F.array(F.lit("a"), F.lit("b")), flags).isNotNull().alias("aligned"))


@query("""SELECT * FROM (SELECT p_brand AS caption FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_brand FROM part WHERE p_partkey % 3 = 0)""")
def captions_missing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return R.captions_missing(p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("caption")), p.where("p_partkey % 3 = 0").select("p_brand"))


@query("""SELECT l_orderkey AS page_id, sum(l_quantity::BIGINT * l_linenumber)::BIGINT AS cells FROM lineitem GROUP BY 1 HAVING cells > 500""")
def cell_guard(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_quantity").cast("bigint").alias("n_rows"), F.col("l_linenumber").cast("bigint").alias("n_cols"))
    return S.cells_over(t, 500)


@query("""SELECT c_nationkey AS page_id, c_custkey AS ref, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT - 1 AS number FROM customer WHERE c_custkey % 3 <> 0""")
def renumbered_items(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("page_id"), F.col("c_custkey").alias("ref"))
    return S.renumbered(c, c.where("ref % 3 = 0"))


@query("""SELECT page_id, 'iframe' AS kind, CASE page_id % 2 WHEN 0 THEN 'dom' ELSE 'screenshot' END AS frame_content, page_id % 2 = 1 AS unread FROM pages""")
def frames_read(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    assets, read = p.select("page_id", F.lit("iframe").alias("kind"), F.lit("f").alias("locator")), p.where("page_id % 2 = 0").select("page_id", F.lit("f").alias("locator"))
    unread = R.unread_frames(assets, read).select("page_id", F.lit(True).alias("u"))
    return R.frame_content(assets, read).join(unread, "page_id", "left").select("page_id", "kind", "frame_content", F.coalesce("u", F.lit(False)).alias("unread"))


@query("""SELECT s_suppkey, '-   - x' || s_suppkey || chr(10) || '- b' AS markdown, '[reading of a' || s_suppkey || ' by e, 87%]' || chr(10) || 't' || chr(10) || '[end of reading]' AS reading, 'see [credentials]/x' AS message FROM supplier""")
def small_writers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", R.write_empty_items(C("-\n    - x", k, "\n- b")).alias("markdown"), S.ocr_marker(F.lit("t"), C("a", k), F.lit("e"), F.lit(87.2)).alias("reading"), R.redact_paths(F.lit("see /home/u/.keys/x"), ["/home/u", "/home/u/.keys"]).alias("message"))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 3 < 2""")
def residue_scan(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 3
    t = F.when(m == 0, "at file:///w/dir/x").when(m == 1, "at \\w\\dir\\x").otherwise("at /w/other")
    return R.residue(table(spark, d, "part").select("p_partkey", t.alias("text")), "/w/dir").select("p_partkey")


@query("""SELECT n_nationkey, p.path, p.description FROM nation, (VALUES ('manifest.json', 'manifest'), ('content.md', 'content'), ('chunks.jsonl', 'chunks'), ('tables/table-001.csv', 'table')) AS p(path, description)""")
def payload_files(spark: SparkSession, d: str) -> DataFrame:
    paths = F.array(*map(F.lit, ["manifest.json", "content.md", "chunks.jsonl", "tables/table-001.csv", "assets/a.png", "x.tmp"]))
    return R.payload_files(table(spark, d, "nation").select("n_nationkey", F.explode(paths).alias("path")), assets=False)


@query("""SELECT n_nationkey, n_name || ',"a ""q"", b"' || chr(10) || n_regionkey || ',' AS csv FROM nation""")
def table_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array("n_name", F.lit('a "q", b')), F.array(F.col("n_regionkey").cast("string"), F.lit("")))
    return table(spark, d, "nation").select("n_nationkey", S.csv_table(rows).alias("csv"))


@query("""SELECT conv_id, count(*) AS records, count(*) FILTER (WHERE turn % 3 = 2) AS gaps, min(printf('ch_%06d', k + 100)) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations) GROUP BY conv_id""")
def media_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return B.media_records(c.select("conv_id", F.col("turn").alias("at"), "text", (F.col("turn") % 3 != 2).alias("transcribed")), 100).groupBy("conv_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == "gap").alias("gaps"), F.min("chunk_id").alias("first_id"))


@query("""SELECT conv_id, sha256('# Walkthrough' || chr(10) || chr(10) || string_agg('## ' || k || '. ' || role || ' (' || t || ')' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY k)) AS markdown_sha, sha256(string_agg('[' || t || '] ' || text, chr(10) ORDER BY k)) AS transcript_sha FROM (
  SELECT *, printf('%d:%02d', turn * 7 // 60, turn * 7 % 60) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations) GROUP BY conv_id""")
def walkthrough_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.struct("turn", "text").alias("n"), (F.col("turn") * 7.0).alias("start"), F.col("role").alias("title"), F.col("text").alias("said"))
    w = B.walkthrough(c, "conv_id")
    return w.select("conv_id", F.sha2("markdown", 256).alias("markdown_sha"), F.sha2("transcript", 256).alias("transcript_sha"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'u' || p_partkey WHEN 1 THEN 'g' ELSE '' END AS url, CASE p_partkey % 3 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'gif' ELSE '' END AS kind, left(regexp_replace(p_name || ' ' || p_partkey, '[^A-Za-z0-9_-]', '-', 'g'), 64) AS safe, CASE WHEN length(p_name) > 5 THEN left(p_name, 5) || ' [...]' ELSE p_name END AS short FROM part""")
def step_pictures(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_partkey") % 3
    shot = B.screenshot(F.when(m == 0, C("u", F.col("p_partkey"))), F.lit(""), F.when(m == 1, "g"))
    return table(spark, d, "part").select("p_partkey", shot["url"].alias("url"), shot["kind"].alias("kind"), X.safe_id(C(F.col("p_name"), " ", F.col("p_partkey"))).alias("safe"), X.bounded(F.col("p_name"), 5).alias("short"))


@query("""SELECT n_nationkey, lpad((n_nationkey + 1)::VARCHAR, 2, '0') || '-' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, 'out/' || lower(replace(r_name, ' ', '-')) || '/' || lower(regexp_replace(n_name, '[^A-Za-z0-9]+', '-', 'g')) AS directory, n_nationkey % 3 = 0 AS openable FROM nation JOIN region ON n_regionkey = r_regionkey""")
def module_places(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.element_at(F.array(*map(F.lit, ["article", "quiz", "video"])), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return n.select("n_nationkey", B.ordinal_slug(F.col("n_name"), F.col("n_nationkey") + 1).alias("slug"), B.module_directory("out", F.array("r_name", "n_name")).alias("directory"), B.openable(kind, ("quiz-review",)).alias("openable"))


@query("""SELECT count(*) AS modules, sum(CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS unaccounted, sum(CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS to_do, 64 AS digest_characters FROM part""")
def resume_state(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node_id"), F.lit("module").alias("level"), F.col("p_name").alias("title"))
    done = p.where("node_id % 3 < 2").select("node_id")
    digest = H.outline_digest(p).first()[0]
    left, todo = H.unaccounted(p, done), H.resumed(p, done, digest, H.outline_digest(p.repartition(3)).first()[0])
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((p, "modules"), (left, "unaccounted"), (todo, "to_do"))]
    return counts[0].join(counts[1]).join(counts[2]).withColumn("digest_characters", F.lit(len(digest)))  # single rows


@query("""SELECT r_name || '' AS root, sha256(r_name || '') AS sha FROM region WHERE false UNION ALL SELECT 'course-' || lpad((row_number() OVER (ORDER BY r_regionkey))::VARCHAR, 2, '0'), sha256('- ' || r_name) FROM region""")
def outline_render(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("parent_key"), F.col("r_name").alias("title"), F.lit(None).cast("bigint").alias("listed"))
    return H.render(H.renumbered([r])).select("root", F.sha2("markdown", 256).alias("sha"))


@query("""SELECT lang, count(*) AS documents, CASE WHEN lang = 'en' THEN count(*) FILTER (WHERE n_chars > 1000) END AS long_ones, CASE WHEN lang = 'en' THEN sum(n_chars)::BIGINT END AS characters, bool_and(n_chars > 0) AS all_text, bool_and(doc_id >= 0) AS ids_ok FROM documents GROUP BY lang""")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").withColumn("measured", F.col("lang") == "en")
    return B.report(t, "lang")


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'record' WHEN 1 THEN 'texts' ELSE 'missing' END AS held FROM nation""")
def definitions_held(spark: SparkSession, d: str) -> DataFrame:
    n, m = table(spark, d, "nation"), F.col("n_nationkey") % 3
    want = n.select("n_nationkey", F.col("n_name").alias("term"), F.lit("def").alias("definition"))
    have = n.where(m == 0).select("n_nationkey", F.col("n_name").alias("term"), F.lit("def").alias("definition"))
    texts = n.select("n_nationkey", F.when(m == 1, F.concat("n_name", F.lit(" is a def"))).otherwise("nothing").alias("text"))
    return B.definitions(want, have, texts, "n_nationkey").select("n_nationkey", "held")


@query("""SELECT n_nationkey, sha256(n_name) AS sha, n_nationkey % 5 = 0 AS damaged FROM nation""")
def asset_integrity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    files = n.select("n_nationkey", C("a/", F.col("n_nationkey")).alias("path"), F.col("n_name").cast("binary").alias("content"))
    listed = files.select("path", F.when(F.col("n_nationkey") % 5 == 0, "0").otherwise(F.sha2("content", 256)).alias("stated"))
    bad = B.damaged(listed, files.drop("n_nationkey")).select("path", F.lit(True).alias("bad"))
    return files.join(bad, "path", "left").select("n_nationkey", F.sha2("content", 256).alias("sha"), F.coalesce("bad", F.lit(False)).alias("damaged"))


@query("""SELECT event_type, round(max(gap), 3) AS longest FROM (SELECT event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id))) / 1000000.0 AS gap FROM events) GROUP BY 1""")
def stage_clock(spark: SparkSession, d: str) -> DataFrame:
    g = H.gaps(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type")
    return g.groupBy("event_type").agg(F.round(F.max("gap"), 3).alias("longest"))


@query("SELECT n_nationkey, n_name || chr(10) AS content, strlen(n_name) + 1 AS length FROM nation")
def file_scan(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.readers import files
    from scrivane.sources.shared import new_path

    out = new_path(spark, "files")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(out)
    found = files(spark, out, (".txt",))
    return found.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.col("content").cast("string").alias("content"), F.col("length").cast("bigint").alias("length"))


@query("SELECT name, fields FROM (VALUES ('block', 14), ('chunk', 3), ('manifest', 6)) AS t(name, fields)")
def schema_export(spark: SparkSession, d: str) -> DataFrame:
    return B.schemas(spark).select("name", "fields")


@query("""SELECT c_custkey, '{"id":"c' || c_custkey || '","text":"' || c_name || '"}' AS record, c_custkey % 2 = 0 AS has_note FROM customer""")
def json_records(spark: SparkSession, d: str) -> DataFrame:
    r = B.sparse_json(F.struct(C("c", F.col("c_custkey")).alias("id"), F.col("c_name").alias("text"), F.lit(None).cast("string").alias("note")))
    noted = B.sparse_json(F.struct(F.lit("x").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "n").alias("note")))
    return table(spark, d, "customer").select("c_custkey", r.alias("record"), F.contains(noted, F.lit("note")).alias("has_note"))


@query("""SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'primary text' || chr(10) || chr(10) || '[another reading]' || chr(10) || 'other' ELSE '[nothing could be read]' END AS text, c_custkey % 2 = 1 AS empty FROM customer""")
def complete_texts(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import empty_capture

    k = F.col("c_custkey") % 2
    return table(spark, d, "customer").select("c_custkey", O.complete_text(F.when(k == 0, "primary text").otherwise(" "), F.when(k == 0, "other")).alias("text"), empty_capture(F.when(k == 0, 60).otherwise(10), F.lit(0), F.lit(0)).alias("empty"))
