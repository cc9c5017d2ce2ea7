"""Queries over sources, names, escapes, URLs and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import text as X
from scrivane.functions import url as U
from scrivane.plans.registry import query, table


def sql_chain(column: str, pairs) -> str:
    for a, b in pairs:
        lit = lambda s: "'" + s.replace("'", "''") + "'"
        column = f"replace({column}, {lit(a)}, {lit(b)})"
    return column


SQL_HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
SQL_PATH = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SQL_SCHEME = r"lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_READABLE = "|".join(U.READABLE)

_SOURCES_SQL = r"""
SELECT page_id, CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN substr(url, 9) WHEN 2 THEN 'localhost:8080/p' || page_id WHEN 3 THEN '127.0.0.1/' || page_id
  WHEN 4 THEN 'ftp://files/' || page_id WHEN 5 THEN '../secret' || page_id || '.txt' WHEN 6 THEN 'report' || page_id || '.csv' WHEN 7 THEN 'word' || page_id
  WHEN 8 THEN 'C:\x' || page_id ELSE '  HTTPS://Host.example/' || page_id || ' ' END AS v FROM pages"""


def _stated(spark, d):
    p, i = table(spark, d, "pages"), F.col("page_id").cast("string")
    m = F.col("page_id") % 10
    v = (F.when(m == 0, F.col("url")).when(m == 1, F.expr("substr(url, 9)")).when(m == 2, F.concat(F.lit("localhost:8080/p"), i)).when(m == 3, F.concat(F.lit("127.0.0.1/"), i))
         .when(m == 4, F.concat(F.lit("ftp://files/"), i)).when(m == 5, F.concat(F.lit("../secret"), i, F.lit(".txt"))).when(m == 6, F.concat(F.lit("report"), i, F.lit(".csv")))
         .when(m == 7, F.concat(F.lit("word"), i)).when(m == 8, F.concat(F.lit("C:\\x"), i)).otherwise(F.concat(F.lit("  HTTPS://Host.example/"), i, F.lit(" "))))
    return p.select("page_id", v.alias("v"))


@query(rf"""
WITH s AS ({_SOURCES_SQL}), t AS (SELECT page_id, trim(v) AS v FROM s), c AS (
  SELECT page_id, v, CASE WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '^(?i:https?|file)://') THEN 'asis' WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN 'scheme'
    WHEN regexp_matches(v, '^(\.\.?/|~|/|[A-Za-z]:[\\/])') OR contains(v, '\') OR regexp_matches(v, '^[^/:]+\.({_READABLE})$') THEN 'path'
    WHEN regexp_matches(v, '^(localhost|[0-9]+(\.[0-9]+){{3}})(:[0-9]+)?(/|$)') THEN 'http' WHEN contains(regexp_extract(v, '^([^/?#]*)', 1), '.') THEN 'https' ELSE 'source' END AS k FROM t)
SELECT page_id, CASE k WHEN 'asis' THEN v WHEN 'http' THEN 'http://' || v WHEN 'https' THEN 'https://' || v END AS source, CASE WHEN k NOT IN ('asis', 'http', 'https') THEN k END AS error FROM c""")
def source_urls(spark: SparkSession, d: str) -> DataFrame:
    return _stated(spark, d).select("page_id", U.normalise_source(F.col("v")).alias("s")).select("page_id", "s.source", "s.error")


_SLUG = "substr(regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 120)"


@query(rf"""
WITH p AS (SELECT page_id, url, {SQL_HOST.format('url')} AS h, list_filter(string_split({SQL_PATH.format('url')}, '/'), lambda x: x <> '') AS parts FROM pages),
n AS (SELECT page_id, url, coalesce(nullif({_SLUG.format("array_to_string(list_concat([h], parts[greatest(len(parts) - 1, 1):]), '-')")}, ''), 'web-page') AS name FROM p)
SELECT page_id, name, 'output/' || regexp_replace(name, '(?i)\.pdf$', '') || '.pdf' AS output, name || '-' || substr(sha256(url), 1, 12) AS published FROM n""")
def output_slugs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("name", U.output_name(F.col("url")))
    return p.select("page_id", "name", U.output_path(F.col("name")).alias("output"), U.published_name(F.col("url")).alias("published"))


@query(rf"""
WITH s AS (SELECT page_id, url AS a, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https://([^/]*).*$', 'https://\1/') WHEN 2 THEN replace(url, 'https://', 'http://')
  WHEN 3 THEN regexp_replace(url, '^https://([^/]*)', 'https://\1:443') ELSE 'https://login.example/' END AS b FROM pages),
x AS (SELECT page_id, {SQL_SCHEME.format('a')} AS sa, {SQL_SCHEME.format('b')} AS sb, {SQL_HOST.format('a')} AS ha, {SQL_HOST.format('b')} AS hb, {SQL_PATH.format('a')} AS pa, {SQL_PATH.format('b')} AS pb,
  CASE WHEN sa = 'http' THEN 80 ELSE 443 END AS oa, CASE WHEN b LIKE '%:443%' THEN 443 WHEN sb = 'http' THEN 80 ELSE 443 END AS ob FROM s)
SELECT page_id, NOT (sa = sb AND ha = hb AND oa = ob) AS crossed, sa = sb AND ha = hb AND oa = ob AND regexp_replace(pa, '(?i)/(index|default)\.(html?|php|aspx?)$', '/') NOT IN ('', '/') AND pb IN ('', '/') AS home FROM x""")
def origin_crossings(spark: SparkSession, d: str) -> DataFrame:
    p, m = table(spark, d, "pages"), F.col("page_id") % 5
    landed = (F.when(m == 0, F.col("url")).when(m == 1, F.regexp_replace("url", "^https://([^/]*).*$", "https://$1/")).when(m == 2, F.replace(F.col("url"), F.lit("https://"), F.lit("http://")))
              .when(m == 3, F.regexp_replace("url", "^https://([^/]*)", "https://$1:443")).otherwise("https://login.example/"))
    p = p.withColumn("landed", landed)
    return p.select("page_id", U.crossed_origin(F.col("url"), F.col("landed")).alias("crossed"), U.landed_on_home(F.col("url"), F.col("landed")).alias("home"))


_FORMATS = [(".csv", "table", "converted"), (".tsv", "table", "converted"), (".json", "data", "verbatim"), (".jsonl", "data", "verbatim"), (".md", "text", "native"), (".txt", "text", "verbatim"),
            (".log", "text", "verbatim"), (".yaml", "data", "verbatim"), (".xml", "data", "verbatim"), (".docx", "office", "converted"), (".pptx", "office", "converted"), (".xlsx", "office", "converted"),
            (".epub", "book", "converted"), (".zip", "archive", "converted"), (".html", "page", "native"), (".png", "image", "native")]


@query("WITH f(suffix, kind, presentation) AS (VALUES " + ", ".join(map(str, _FORMATS)) + r"""), s AS (SELECT doc_id, 'f' || doc_id || ['.csv', '.MD', '.png', '.exe', '.zip', '.html', '.docx', ''][doc_id % 8 + 1] AS name FROM documents)
SELECT coalesce(kind, 'none') AS kind, coalesce(presentation, 'none') AS presentation, count(*) AS files FROM s LEFT JOIN f ON lower(regexp_extract(name, '(\.[^.]*)$', 1)) = suffix GROUP BY ALL""")
def format_registry(spark: SparkSession, d: str) -> DataFrame:
    formats = spark.createDataFrame(_FORMATS, "suffix string, kind string, presentation string")
    names = table(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, [".csv", ".MD", ".png", ".exe", ".zip", ".html", ".docx", ""])), (F.col("doc_id") % 8 + 1).cast("int"))).alias("name"))
    joined = names.withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))).join(F.broadcast(formats), "suffix", "left")  # a fixed table of 16 rows
    return joined.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("presentation", F.lit("none")).alias("presentation")).agg(F.count(F.lit(1)).alias("files"))


@query(r"""SELECT doc_id, sha256(repeat('`', m) || chr(10) || b || chr(10) || repeat('`', m)) AS block_sha, m AS ticks FROM (
  SELECT doc_id, b, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(b, '`+'), lambda x: len(x))), 0) + 1)::INT AS m FROM (SELECT doc_id, regexp_replace(repeat('`', (doc_id % 7)::INT) || text, '\n+$', '') AS b FROM documents))""")
def verbatim_fence(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.fence(F.concat(F.repeat(F.lit("`"), (F.col("doc_id") % 7).cast("int")), F.col("text"))).alias("b"))
    return t.select("doc_id", F.sha2("b", 256).alias("block_sha"), F.length(F.regexp_extract("b", "^(`+)", 1)).alias("ticks"))


_HOSTILE = "'a|b_c*' || chr(10) || '<&>#[x]{y}`!\\ ' || o_orderpriority || ' (' || o_orderkey || ')'"


@query(f"""SELECT o_orderkey, replace({sql_chain('t', X.reference_pairs(X.CELL_REFERENCES))}, chr(10), '<br>') AS cell, {sql_chain('t', X.reference_pairs(X.INLINE_REFERENCES))} AS inline_text,
  {sql_chain('t', X.destination_pairs())} AS destination FROM (SELECT o_orderkey, {_HOSTILE} AS t FROM orders)""")
def escape_cells(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("a|b_c*\n<&>#[x]{y}`!\\ "), F.col("o_orderpriority"), F.lit(" ("), F.col("o_orderkey").cast("string"), F.lit(")"))
    o = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    return o.select("o_orderkey", X.escape_cell(F.col("t")).alias("cell"), X.escape_inline(F.col("t")).alias("inline_text"), X.escape_destination(F.col("t")).alias("destination"))


@query(r"""SELECT l_orderkey, l_linenumber, concat_ws(chr(10), '&#43; ' || l_quantity::INT, '' || l_linenumber || '&#46; item', '&#32;&#32;code', 'plain - text') AS lines FROM lineitem""")
def escape_line_starts(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws("\n", F.concat(F.lit("+ "), F.col("l_quantity").cast("int").cast("string")), F.concat(F.col("l_linenumber").cast("string"), F.lit(". item")), F.lit("    code"), F.lit("plain - text"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.escape_lines(t).alias("lines"))


@query("SELECT n_nationkey, n_name || ', \"x\"' AS name, n_regionkey FROM nation")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.delimited import parse_lines

    quoted = F.concat(F.lit('"'), F.replace(F.concat("n_name", F.lit(', "x"')), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, d, "nation").select(F.concat_ws(",", F.col("n_nationkey").cast("string"), quoted, F.col("n_regionkey").cast("string")).alias("line"))
    return parse_lines(lines, "line", "n_nationkey int, name string, n_regionkey int")


@query("SELECT event_type, (props->>'k')::BIGINT % 10 AS bucket, count(*) AS events FROM events GROUP BY ALL")
def json_scan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("events"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN -(o_orderkey % 1000) ELSE o_orderkey END AS number FROM orders""")
def html_integers(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    v = F.when(m == 0, F.concat(F.lit(" "), k.cast("string"), F.lit("px"))).when(m == 1, F.concat(F.lit("+"), k.cast("string"))).when(m == 2, F.concat(F.lit("-"), (k % 1000).cast("string"), F.lit(".5"))).otherwise("9999999999")
    return table(spark, d, "orders").select("o_orderkey", X.html_integer(v).alias("number"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    m, day = F.col("o_orderkey") % 5, F.col("o_orderdate")
    v = (F.when(m == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm")).when(m == 1, F.date_format(day, "yyyy/MM/dd")).when(m == 2, F.date_format(day, "yyyyMMdd")).when(m == 3, F.date_format(day, "yyyy-MM-dd"))
         .otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-31"))))
    return table(spark, d, "orders").select("o_orderkey", X.calendar_date(v).alias("day"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN floor(s) >= 3600 THEN printf('%d:%02d:%02d', floor(s / 3600)::BIGINT, (floor(s / 60) % 60)::BIGINT, (floor(s) % 60)::BIGINT) ELSE printf('%d:%02d', floor(s / 60)::BIGINT, (floor(s) % 60)::BIGINT) END AS citation,
  printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS vtt FROM (SELECT *, round(s * 1000)::BIGINT AS ms FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 8 AS s FROM lineitem))""")
def media_times(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_extendedprice") / 8
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.citation_time(s).alias("citation"), X.vtt_time(s).alias("vtt"))


@query("""SELECT c_custkey, printf('%02d:%02d:%06.3f', floor(s / 3600)::BIGINT, (floor(s / 60) % 60)::BIGINT, s - floor(s / 60) * 60) AS caption FROM (SELECT c_custkey, abs(round(c_acctbal)) + 0.5 AS s FROM customer)""")
def caption_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", X.caption_time(F.abs(F.round("c_acctbal")) + 0.5).alias("caption"))


@query("""SELECT o_orderkey, 'say ' || o_orderpriority || ' or ' || o_orderstatus || ' x' || o_orderkey AS resolved, CASE WHEN o_orderkey % 2 = 0 THEN 'tone' ELSE '' END AS unknown FROM orders""")
def markup_resolve(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 0, "tone").otherwise("alt")
    t = F.concat(F.lit("say {"), F.col("o_orderpriority"), F.lit("||||alt=q} /pause-3/ or {zz||||spelling="), F.col("o_orderstatus"), F.lit("}  {x"), F.col("o_orderkey").cast("string"), F.lit("||||"), kind, F.lit("=w}"))
    o = table(spark, d, "orders").select("o_orderkey", t.alias("t"))
    return o.select("o_orderkey", X.resolve_corrections(X.clean_narration(F.col("t"))).alias("resolved"), F.array_join(X.unknown_corrections(F.col("t")), ",").alias("unknown"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE o[1] IN (0, 10, 127) OR o[1] = 100 AND o[2] BETWEEN 64 AND 127 OR o[1] = 169 AND o[2] = 254 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31 OR o[1] = 192 AND o[2] = 168
  OR o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2) OR o[1] = 198 AND o[2] IN (18, 19) OR o[1] = 198 AND o[2] = 51 AND o[3] = 100 OR o[1] = 203 AND o[2] = 0 AND o[3] = 113 OR o[1] >= 224 END AS internal
FROM (SELECT c_custkey, [[10, 100, 172, 192, 198, 203, 169, 8, 127, 239][c_custkey % 10 + 1], (c_custkey * 7) % 256, c_custkey % 120, 1] AS o FROM customer)""")
def ip_policy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    first = F.element_at(F.array(*map(F.lit, [10, 100, 172, 192, 198, 203, 169, 8, 127, 239])), (k % 10 + 1).cast("int"))
    address = F.concat_ws(".", first.cast("string"), ((k * 7) % 256).cast("string"), (k % 120).cast("string"), F.lit("1"))
    return table(spark, d, "customer").select("c_custkey", U.is_internal_ipv4(F.when(k % 9 == 0, "10.0.0").otherwise(address)).alias("internal"))


@query("""SELECT s_suppkey, k IN (0, 1) AS inside, k NOT IN (0, 1) AS outside FROM (SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier)""")
def roots_policy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    p = F.when(k == 0, F.concat(F.lit("/data/in/f"), F.col("s_suppkey").cast("string"))).when(k == 1, "/data/in").when(k == 2, "/data/input/x").otherwise("/etc/passwd")
    inside = U.within_roots(p, F.array(F.lit("/data/in"), F.lit("/srv")))
    return table(spark, d, "supplier").select("s_suppkey", inside.alias("inside"), (~inside).alias("outside"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'challenge' WHEN 1 THEN 'datadome' END AS refusal, CASE WHEN s_suppkey % 4 < 2 THEN 'refused by an automation check' WHEN s_suppkey % 2 = 0 THEN 'sign-in needed' ELSE 'forbidden' END AS message FROM supplier""")
def header_refusal(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import automation_refusal, refused_message

    k = F.col("s_suppkey") % 4
    headers = F.when(k == 0, F.create_map(F.lit("cf-mitigated"), F.lit("challenge"))).when(k == 1, F.create_map(F.lit("server"), F.lit("DataDome"))).otherwise(F.create_map(F.lit("server"), F.lit("nginx")))
    s = table(spark, d, "supplier").select("s_suppkey", headers.alias("h"), F.when(F.col("s_suppkey") % 2 == 0, 401).otherwise(403).alias("status"))
    return s.select("s_suppkey", automation_refusal(F.col("h")).alias("refusal"), refused_message(F.col("status"), F.col("h")).alias("message"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS permitted FROM customer""")
def asset_hosts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    target = F.when(k == 0, "cdn.media.example").when(k == 1, "media.example").when(k == 2, "evilmedia.example").when(k == 3, "").otherwise("media.example.evil")
    return table(spark, d, "customer").select("c_custkey", U.same_service(target, F.lit("media.example")).alias("permitted"))


@query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE false END AS watch, CASE page_id % 4 WHEN 0 THEN 'https' ELSE CASE page_id % 4 WHEN 1 THEN 'javascript' WHEN 2 THEN 'mailto' ELSE 'data' END END AS scheme,
  page_id % 4 <> 1 AS allowed FROM pages""")
def url_schemes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v=a"), F.col("page_id").cast("string"))).when(k == 1, "javascript:alert(1)").when(k == 2, "mailto:x@y.example").otherwise("data:text/plain,x")
    return table(spark, d, "pages").select("page_id", U.watch_page(u).alias("watch"), U.scheme(u).alias("scheme"), U.scheme(u).isin(U.SCHEMES).alias("allowed"))


@query("""SELECT p_partkey, [p_size, p_partkey % 10, 3]::INT[] AS parts, p_size * 10000 + p_partkey % 10 * 100 >= 250500 AS recent, p_partkey % 2 = 0 AS css FROM part""")
def versions_and_lengths(spark: SparkSession, d: str) -> DataFrame:
    v = X.version_parts(F.concat(F.lit("tool v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".3 (build)")))
    css = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("mm"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("em")))
    return table(spark, d, "part").select("p_partkey", v.alias("parts"), (v >= F.array(F.lit(25), F.lit(5))).alias("recent"), X.css_length(css).alias("css"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'flag' WHEN 1 THEN 'env' ELSE 'file' END AS a, CASE WHEN s_suppkey % 2 = 0 THEN 'env' ELSE 'default' END AS b, 'default' AS c FROM supplier""")
def settings_merge(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.settings import from_environment, merge_layers

    k = F.col("s_suppkey")
    flags = F.when(k % 3 == 0, F.create_map(F.lit("render.a"), F.lit("flag")))
    env = from_environment(F.map_filter(F.create_map(F.lit("APP_RENDER_A"), F.when(k % 3 == 1, "env"), F.lit("APP_RENDER_B"), F.when(k % 2 == 0, "env"), F.lit("HOME"), F.lit("x")), lambda _, v: v.isNotNull()), "APP_")
    file = F.create_map(F.lit("render.a"), F.lit("file"))
    default = F.create_map(*[F.lit(x) for n in "abc" for x in (f"render.{n}", "default")])
    m = table(spark, d, "supplier").select("s_suppkey", merge_layers(flags, env, file, default).alias("m"))
    return m.select("s_suppkey", *(F.col("m")[f"render.{n}"].alias(n) for n in "abc"))


@query("""SELECT c_custkey, 'pw=[REDACTED PASSWORD] for ' || c_name AS redacted, '<title>' || c_name || ' &lt;&amp;&gt;</title>' AS title FROM customer""")
def redaction_and_wrap(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.sanitise import document_title, redact_values

    c = table(spark, d, "customer").withColumn("secret", F.concat(F.lit("s3cret"), F.col("c_custkey").cast("string")))
    text = F.concat(F.lit("pw="), F.col("secret"), F.lit(" for "), F.col("c_name"))
    return c.select("c_custkey", redact_values(text, F.array("secret")).alias("redacted"), document_title(F.concat("c_name", F.lit(" <&>"))).alias("title"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN './img/' || p_partkey || '.png?x=1#f' WHEN 1 THEN NULL ELSE NULL END AS relative, CASE WHEN p_partkey % 3 = 2 THEN 'data:image/png;base64 (' || len('AAAA' || p_partkey) || ' characters)' ELSE u END AS recorded FROM
 (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'file:///src/dir/img/' || p_partkey || '.png?x=1#f' WHEN 1 THEN 'file:///src/dir/../x' || p_partkey ELSE 'data:image/png;base64,AAAA' || p_partkey END AS u FROM part)""")
def recorded_urls(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.sanitise import record_data_url, relative_local_path

    k, s = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    u = F.when(k == 0, F.concat(F.lit("file:///src/dir/img/"), s, F.lit(".png?x=1#f"))).when(k == 1, F.concat(F.lit("file:///src/dir/../x"), s)).otherwise(F.concat(F.lit("data:image/png;base64,AAAA"), s))
    return table(spark, d, "part").select("p_partkey", relative_local_path(u, "/src/dir").alias("relative"), record_data_url(u).alias("recorded"))


@query("""SELECT archive, bytes, members, depth, escapes, bytes > 40000 OR members > 6 OR depth > 3 OR escapes AS refused FROM (SELECT l_orderkey AS archive, sum(l_quantity * 300)::BIGINT AS bytes, count(*) AS members,
  max(l_linenumber % 5)::BIGINT AS depth, bool_or(l_suppkey % 10 = 0) AS escapes FROM lineitem GROUP BY ALL)""")
def archive_guard(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.archives import guard

    name = F.when(F.col("l_suppkey") % 10 == 0, "a/../../x").otherwise(F.concat(F.repeat(F.lit("d/"), (F.col("l_linenumber") % 5).cast("int")), F.lit("f")))
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), name.alias("member"), (F.col("l_quantity") * 300).cast("bigint").alias("size"), (F.col("l_linenumber") % 5).alias("depth"))
    return guard(members, max_bytes=40_000, max_members=6, max_depth=3)


@query("""SELECT reason, array_to_string(list_sort(list(name))[1:3], ', ') AS first, greatest(count(*) - 3, 0) AS more FROM (SELECT 'reason ' || p_size % 7 AS reason, p_name || p_partkey AS name FROM part) GROUP BY reason""")
def left_out_tally(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.archives import left_out

    p = table(spark, d, "part").select(F.concat(F.lit("reason "), (F.col("p_size") % 7).cast("string")).alias("reason"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"))
    return left_out(p)


@query("""SELECT s_suppkey, s_suppkey % 3 IN (0, 1) AS refused FROM supplier""")
def xml_guard(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.archives import xml_refused

    k = F.col("s_suppkey") % 3
    x = F.when(k == 0, "<?xml version='1.0'?><!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>").when(k == 1, "<!DOCTYPE a SYSTEM 'http://x/y.dtd'><a/>").otherwise("<a><b>")
    return table(spark, d, "supplier").select("s_suppkey", xml_refused(x).alias("refused"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 9 END AS code FROM supplier""")
def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import exit_code

    e = F.element_at(F.array(*map(F.lit, ["usage", "source", "policy", "other"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", exit_code(e).alias("code"))


@query("""SELECT event_id, replace(replace(t, 'X', '<workdir>'), 'Y', '<time>') || ' <version> <size>' AS masked FROM (SELECT event_id, 'X/f Y' AS t FROM events)""")
def masked_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("/tmp/w/f "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z v1.2."), (F.col("event_id") % 9).cast("string"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" bytes"))
    return table(spark, d, "events").select("event_id", X.mask_volatile(t, "/tmp/w").alias("masked"))
