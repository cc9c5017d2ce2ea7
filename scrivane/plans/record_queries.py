"""Queries over records: chunks of figures and steps, bundles, tracks, exports and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.operators import chunks as K
from scrivane.operators import pages as P
from scrivane.operators import reading as R
from scrivane.operators import records as B
from scrivane.plans.page_queries import C
from scrivane.plans.registry import query, table


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || chr(10) || chr(10) || p_brand ELSE p_name END AS text FROM part""")
def figure_chunks(spark: SparkSession, d: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", B.figure_seed(F.col("p_name"), F.concat(F.lit(" "), "p_name"), brand, F.lit("")).alias("text"))


def _steps(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", F.struct("turn", "text").alias("k"), F.col("role").alias("title"), F.col("text").alias("said"), (F.col("turn") * 7.0).alias("start"), F.lit(7.0).alias("duration"), F.col("turn").alias("n"))


@query("""SELECT conv_id, printf('ch_%06d', row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) + 10) AS chunk_id, role || chr(10) || text AS text, turn::INT AS step, printf('%d:%02d', turn * 7 // 60, turn * 7 % 60) AS at FROM conversations""")
def step_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = B.step_records(_steps(spark, d).drop("k"), "conv_id", 10)
    return c.select("conv_id", "chunk_id", "text", "video.step", "video.at")


@query("""SELECT c_custkey AS node_id, c_name AS text, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS part, c_custkey % 2 = 0 AS stamped FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def stamped_chunks(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    outline = c.where("c_custkey % 2 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("node_id"), F.col("n_name").alias("part"))
    s = K.stamped(c.select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("text")), outline)
    return s.select("node_id", "text", "journey.part", F.col("journey").isNotNull().alias("stamped"))


@query(r"""SELECT page_id, url AS source, len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"'))::INT AS links FROM pages""")
def legacy_bundles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    b = B.legacy_bundle(p, P.block_rows(p), P.link_rows(p))
    back = F.from_json("bundle", "source string, links array<struct<url:string>>")
    return b.select("page_id", back.alias("b")).select("page_id", "b.source", F.coalesce(F.size("b.links"), F.lit(0)).alias("links"))


@query("""SELECT n_nationkey, '<doctag>' || chr(10) || '<section_header_level_2>' || n_name || '</section_header_level_2>' || chr(10) || '<text>a &amp; b</text>' || chr(10) || '</doctag>' AS doctags FROM nation""")
def page_exports(spark: SparkSession, d: str) -> DataFrame:
    html = C("<h2>", F.col("n_name"), "</h2><p>a &amp; b</p>")
    return B.doctags(P.block_rows(table(spark, d, "nation").select("n_nationkey", html.alias("html")), "n_nationkey"), "n_nationkey")


@query("""SELECT conv_id, sha256('WEBVTT' || chr(10) || chr(10) || 'NOTE t' || conv_id || chr(10) || 'https://s/' || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'PARTIAL: the track was cut' ELSE '' END || chr(10) || chr(10) || string_agg(k || chr(10) || printf('00:%02d:%02d.000', (turn * 7) // 60, (turn * 7) % 60) || ' --> ' || printf('00:%02d:%02d.000', (turn * 7 + 7) // 60, (turn * 7 + 7) % 60) || chr(10) || text, chr(10) || chr(10) ORDER BY k) || chr(10)) AS vtt_sha
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations) GROUP BY conv_id""")
def track_files(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d)
    cues = s.select("conv_id", "start", (F.col("start") + 7).alias("end"), F.col("said").alias("text"))
    tracks = s.select("conv_id").distinct().select("conv_id", C("t", F.col("conv_id")).alias("title"), F.lit("https://s/").alias("source"), (F.col("conv_id") % 2 == 0).alias("truncated"))
    return B.track_vtt(cues, tracks, "conv_id").select("conv_id", F.sha2("vtt", 256).alias("vtt_sha"))


@query("""SELECT n_nationkey, 'b.mp3' AS src, 'audio' AS name FROM nation UNION ALL SELECT n_nationkey, 'a.mp4', 'video' FROM nation WHERE n_nationkey % 2 = 0""")
def plain_media(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    found = P.block_rows(n.select("n_nationkey", F.lit("<video src=a.mp4></video><audio src=b.mp3></audio>").alias("html")), "n_nationkey").select("n_nationkey", "src", "name")
    return B.undocumented_media(found, n.where("n_nationkey % 2 = 1").select("n_nationkey", F.lit("a.mp4").alias("src")), "n_nationkey").select("n_nationkey", "src", "name")


@query("""SELECT n_nationkey, 'visual' AS type, 'v' || n_nationkey AS src, NULL::INT AS step FROM nation UNION ALL SELECT n_nationkey, 'video', 'p' || n_nationkey, 1 FROM nation UNION ALL SELECT n_nationkey, 'video', 'c', 1 FROM nation WHERE n_nationkey % 2 = 0""")
def asset_lists(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    visual = n.select("n_nationkey", F.lit("visual").alias("type"), C("v", F.col("n_nationkey")).alias("src"))
    steps = n.select("n_nationkey", C("p", F.col("n_nationkey")).alias("picture"), F.when(F.col("n_nationkey") % 2 == 0, "c").alias("clip"))
    video = B.asset_urls(steps, "n_nationkey", clips=True).select("n_nationkey", F.lit("video").alias("type"), F.col("url").alias("src"), F.lit(1).alias("step"))
    return R.asset_list(visual, video)


@query("""SELECT n_nationkey, 'a' || chr(10) || 'b' AS lines, 'a b' AS one_line, 'x^' || n_nationkey AS math, 'for i in x:' || chr(10) || '    y' AS code, 'py' AS language FROM nation""")
def inline_rules(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    code = P.block_rows(n.select("n_nationkey", F.lit('<pre class="language-py">1 for i in x:\n2     y</pre>').alias("html")), "n_nationkey").select("n_nationkey", F.col("text").alias("code"), "language")
    math = C('<math alttext="no"><semantics><mi>x</mi><annotation encoding="application/x-tex">x^', F.col("n_nationkey"), "</annotation></semantics></math>")
    t = F.lit("<br>a <br/> b<br>")
    return n.select("n_nationkey", B.line_breaks(t, True).alias("lines"), B.line_breaks(t, False).alias("one_line"), P.math(math).alias("math")).join(code, "n_nationkey")


@query("""SELECT conv_id, sha256(string_agg('<h2>' || role || '</h2><p>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p>', '' ORDER BY turn, text)) AS html_sha FROM conversations GROUP BY conv_id""")
def appendix_pages(spark: SparkSession, d: str) -> DataFrame:
    s = _steps(spark, d).withColumn("n", F.struct("n", "said"))
    return B.appendix_html(s, "conv_id").select("conv_id", F.sha2("html", 256).alias("html_sha"))


@query("""SELECT n_nationkey, n_name || chr(10) || 'https://x/' || chr(10) || chr(10) || 'Attached files:' || chr(10) || '- a.md: content' AS readme, 'render.a,render.b' AS settings, true AS versions FROM nation""")
def bundle_notes(spark: SparkSession, d: str) -> DataFrame:
    files = F.array(F.struct(F.lit("a.md").alias("path"), F.lit("content").alias("description")))
    settings = F.create_map(*[F.lit(x) for k in ("render.a", "render.b", "auth.token", "auth.password") for x in (k, "v")])
    return table(spark, d, "nation").select("n_nationkey", B.readme_text(F.col("n_name"), F.lit("https://x/"), files).alias("readme"), F.array_join(F.map_keys(B.without_secrets(settings)), ",").alias("settings"),
                                            (B.tool_versions()["pyspark"].isNotNull() & B.tool_versions()["browser"].isNull()).alias("versions"))


@query("""SELECT page_id, url, '{"page_id":' || page_id || ',"url":"' || url || '","sha256":"' || sha256(html) || '"}' AS provenance FROM pages""")
def provenance_records(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", "url", F.sha2("html", 256).alias("sha256"))
    return B.provenance(p).join(p.select("page_id", "url"), "page_id")


@query("""SELECT 'ch_' || lpad(r_regionkey::VARCHAR, 6, '0') AS chunk_id, r_name AS text FROM region UNION ALL SELECT 'ch_' || lpad((row_number() OVER (ORDER BY n_name) + 4)::VARCHAR, 6, '0'), n_name FROM nation""")
def appended_chunks(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    records = r.select(F.format_string("ch_%06d", "r_regionkey").alias("chunk_id"), F.col("r_name").alias("text"))
    return K.appended(records, n.select(F.col("n_name").alias("text")), 4, "text")
