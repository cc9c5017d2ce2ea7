"""Queries over chunks, sections, media and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.operators import chunks as K
from scrivane.operators import media as V
from scrivane.operators import ocr as O
from scrivane.operators import pages as P
from scrivane.operators import sections as S
from scrivane.plans.page_queries import C
from scrivane.plans.registry import query, table

_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_LEGACY = rf"""WITH RECURSIVE s AS (
  SELECT doc_id, 0 AS k, '' AS part, {_STRIP.format('text')} AS rest FROM documents
  UNION ALL
  SELECT doc_id, k + 1, {_STRIP.format('left(rest, cut)')}, {_STRIP.format('substr(rest, cut + 1)')} FROM (
    SELECT doc_id, k, rest, CASE WHEN length(rest) <= 1800 THEN length(rest) WHEN nl >= 900 THEN nl WHEN sp >= 900 THEN sp ELSE 1800 END AS cut FROM (
      SELECT doc_id, k, rest, CASE WHEN strpos(f, chr(10)) > 0 THEN 1800 - strpos(f, chr(10)) ELSE -1 END AS nl, CASE WHEN strpos(f, ' ') > 0 THEN 1800 - strpos(f, ' ') ELSE -1 END AS sp
      FROM (SELECT doc_id, k, rest, reverse(left(rest, 1800)) AS f FROM s WHERE rest <> '')))
), p AS (SELECT doc_id, k, part, length(part) AS n FROM s WHERE k > 0), g AS (
  SELECT doc_id, k, part, 1 AS chunk, n AS size FROM p WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, p.part, CASE WHEN g.size + p.n > 1800 OR g.size >= 1800 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.size + p.n > 1800 OR g.size >= 1800 THEN p.n ELSE g.size + p.n END
  FROM g JOIN p ON p.doc_id = g.doc_id AND p.k = g.k + 1
), c AS (SELECT doc_id, chunk, string_agg(part, chr(10) || chr(10) ORDER BY k) AS text FROM g GROUP BY ALL)
"""


@query(_LEGACY + "SELECT doc_id, printf('chunk-%05d', chunk) AS chunk_id, length(text)::INT AS characters, sha256(text) AS sha256 FROM c")
def chunks_legacy(spark: SparkSession, d: str) -> DataFrame:
    c = K.legacy_records(table(spark, d, "documents"))
    return c.select("doc_id", "chunk_id", F.length("text").alias("characters"), "sha256")


@query(None)
def chunks_contextual(spark: SparkSession, d: str) -> DataFrame:
    c = K.contextual_records(K.section_seeds(P.block_rows(table(spark, d, "pages"))))
    return c.select("page_id", "chunk_id", "text", "meta.headings", "meta.locator", "meta.sha256")


@query("SELECT count(DISTINCT page_id) AS pages, 0::BIGINT AS bad_digests, 0::BIGINT AS bad_pointers FROM pages")
def chunk_digests(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.quality import bad_digests, bad_pointers

    blocks = P.block_rows(table(spark, d, "pages"))
    c = K.contextual_records(K.section_seeds(blocks))
    digests = bad_digests(c.select("page_id", "chunk_id", "text", "meta.sha256")).agg(F.count(F.lit(1)).alias("bad_digests"))
    pointers = bad_pointers(c.select("page_id", "chunk_id", "meta.doc_items"), blocks.select("page_id", F.col("id").alias("ref")), "page_id").agg(F.count(F.lit(1)).alias("bad_pointers"))
    return c.agg(F.count_distinct("page_id").alias("pages")).join(digests).join(pointers)  # three single rows


_VIEWER = """WITH RECURSIVE l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS k, substr(x, j * 1800 + 1, 1800) AS line FROM (
  SELECT doc_id, i, x, unnest(range((length(x) + 1799) // 1800)) AS j FROM (SELECT doc_id, i, {0} AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS y, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE x <> '')),
g AS (SELECT doc_id, k, line, 1 AS chunk, length(line) + 1 AS size FROM l WHERE k = 1
  UNION ALL SELECT l.doc_id, l.k, l.line, CASE WHEN g.size + length(l.line) > 1800 THEN g.chunk + 1 ELSE g.chunk END, CASE WHEN g.size + length(l.line) > 1800 THEN length(l.line) + 1 ELSE g.size + length(l.line) + 1 END FROM g JOIN l ON l.doc_id = g.doc_id AND l.k = g.k + 1),
c AS (SELECT doc_id, chunk, string_agg(line, chr(10) ORDER BY k) AS text FROM g GROUP BY ALL)
SELECT doc_id, printf('page-%03d-chunk-%03d', 1, coalesce(chunk, 1)) AS chunk_id, sha256(coalesce(text, '')) AS text_sha FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN c USING (doc_id)""".format(_STRIP.format("y"))


@query(_VIEWER)
def viewer_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = K.viewer_records(table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    return c.select("doc_id", "chunk_id", F.sha2("text", 256).alias("text_sha"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations),
g AS (SELECT conv_id, turn, text, k, 1 AS part, length(text) + 1 AS size FROM t WHERE k = 1
  UNION ALL SELECT t.conv_id, t.turn, t.text, t.k, CASE WHEN g.size + length(t.text) > 1500 THEN g.part + 1 ELSE g.part END, CASE WHEN g.size + length(t.text) > 1500 THEN length(t.text) + 1 ELSE g.size + length(t.text) + 1 END FROM g JOIN t ON t.conv_id = g.conv_id AND t.k = g.k + 1),
c AS (SELECT conv_id, part, min(turn) AS first, max(turn) AS last, sha256(string_agg(text, chr(10) ORDER BY k)) AS text_sha FROM g GROUP BY ALL)
SELECT conv_id, part, max(part) OVER (PARTITION BY conv_id) AS parts, first, last, text_sha FROM c""")
def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = K.transcript_records(table(spark, d, "conversations"))
    return c.select("conv_id", "part", "parts", "first", "last", F.sha2("text", 256).alias("text_sha"))


@query("""SELECT conv_id, 'No transcript: m' || conv_id AS text FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def gap_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    media = c.select("conv_id").distinct().withColumn("title", C("m", F.col("conv_id")))
    return K.gap_records(media, c.where("role = 'system'"), "conv_id").select("conv_id", "text")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN c_name || chr(10) || chr(10) || c_mktsegment ELSE c_mktsegment END AS text FROM customer""")
def visual_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 3
    return table(spark, d, "customer").select("c_custkey", K.visual_text(F.when(m < 2, F.col("c_name")), F.when(m == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")), F.lit(" ")).alias("text"))


_MD = """SELECT c_custkey, '# Top' || chr(10) || 'x' || chr(10) || '## A' || chr(10) || '```' || chr(10) || '# no' || chr(10) || '```' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '### deep' ELSE 'body' END || chr(10) || '##  A ##' || chr(10) || c_name AS t FROM customer"""


def _md(spark, d):
    t = C("# Top\nx\n## A\n```\n# no\n```\n", F.when(F.col("c_custkey") % 2 == 0, "### deep").otherwise("body"), "\n##  A ##\n", F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", t.alias("text"))


@query("""SELECT c_custkey, h.pos, h.level, h.text, h.occurrence, h."end" FROM customer, (VALUES (0, 1, 'top', 1, NULL), (2, 2, 'a', 1, 7), (6, 3, 'deep', 1, 7), (7, 2, 'a', 2, NULL)) AS h(pos, level, text, occurrence, "end") WHERE h.pos <> 6 OR c_custkey % 2 = 0""")
def section_ends(spark: SparkSession, d: str) -> DataFrame:
    return S.section_ends(S.headings(_md(spark, d), "c_custkey"), "c_custkey").select("c_custkey", "pos", "level", "text", "occurrence", "end")


@query(f"""SELECT c_custkey, regexp_replace(t, chr(10) || '##  A', chr(10) || '[one]' || chr(10) || '##  A') || chr(10) || '[two]' AS text FROM ({_MD})""")
def section_splice(spark: SparkSession, d: str) -> DataFrame:
    md = _md(spark, d)
    ends = S.section_ends(S.headings(md, "c_custkey"), "c_custkey")
    inserts = md.select("c_custkey", F.lit("a").alias("text"), F.explode(F.array(F.lit("[one]"), F.lit("[two]"))).alias("block"))
    return S.spliced(md.select("c_custkey", F.posexplode(F.split("text", "\n")).alias("pos", "line")), ends, inserts, "c_custkey")


def _playbooks(spark, d):
    """Each conversation as a walkthrough: a step per turn."""
    c = table(spark, d, "conversations")
    step = F.struct(F.col("turn").cast("string").alias("id"), F.lit("step").alias("kind"), F.col("role").alias("title"), F.col("text").alias("description"),
                    F.when(F.col("turn") % 4 == 3, F.lit("NaN")).otherwise((F.length("text") / 16).cast("string")).alias("duration"), F.struct(F.concat("text", F.lit(" /pause-2/ {a||||alt=b}")).alias("markdown")).alias("audioNote"),
                    F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.col("role").alias("text"), F.lit(0.5).alias("start"), F.lit(0.25).alias("end")))).otherwise(F.array().cast("array<struct<text:string,start:double,end:double>>")).alias("subtitles"))
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", step.alias("s")))).alias("t"))
    payload = F.to_json(F.struct(F.concat(F.lit("pb"), F.col("conv_id").cast("string")).alias("id"), F.transform("t", lambda x: x.s).alias("steps")))
    return whole.select("conv_id", V.parse_playbook(payload, F.concat(F.lit("pb"), F.col("conv_id").cast("string"))).alias("p"))


_STEPS = "SELECT conv_id, row_number() OVER w - 1 AS n, turn, role, text, CASE WHEN turn % 4 = 3 THEN 0 ELSE length(text) / 16 END AS duration FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)"
_STARTS = f"SELECT *, coalesce(sum(duration) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start FROM ({_STEPS})"


@query(f"SELECT conv_id, n::INT AS n, duration::DOUBLE AS duration, start FROM ({_STARTS})")
def step_timeline(spark: SparkSession, d: str) -> DataFrame:
    return V.step_rows(_playbooks(spark, d), "conv_id").select("conv_id", "n", "duration", "start")


@query(f"""SELECT conv_id, n::INT AS n, CASE WHEN turn % 2 = 0 THEN role ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' a' END AS text, CASE WHEN turn % 2 = 0 THEN start + 0.5 ELSE start END AS start, CASE WHEN turn % 2 = 0 THEN start + 0.5 ELSE start + duration END AS stop FROM ({_STARTS})""".replace("\\\\", "\\"))
def step_cues(spark: SparkSession, d: str) -> DataFrame:
    return V.step_cues(V.step_rows(_playbooks(spark, d), "conv_id"), "conv_id").select("conv_id", "n", "text", "start", F.col("end").alias("stop"))


@query("""SELECT conv_id, count(*) AS cues, sha256('WEBVTT' || chr(10) || chr(10) || string_agg(k || chr(10) || printf('00:%02d:%02d.000', (turn * 5) // 60, (turn * 5) % 60) || ' --> ' || printf('00:%02d:%02d.000', (turn * 5 + 5) // 60, (turn * 5 + 5) % 60) || chr(10) || text, chr(10) || chr(10) ORDER BY k) || chr(10)) AS vtt_sha
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations) GROUP BY conv_id""")
def vtt_cues(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 5.0).alias("start"), (F.col("turn") * 5.0 + 5).alias("end"), "text")
    return V.vtt(c, "conv_id").join(c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("cues")), "conv_id").select("conv_id", "cues", F.sha2("vtt", 256).alias("vtt_sha"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'empty' WHEN 2 THEN 'translation' ELSE 'captions' END AS role, turn % 4 = 3 AS transcript FROM conversations""")
def track_roles(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 4
    c = table(spark, d, "conversations").select("conv_id", "turn", (m != 0).alias("readable"), F.when(m == 1, 0).otherwise(3).alias("cues"), F.when(m == 2, "subtitles").otherwise("captions").alias("kind"))
    return c.select("conv_id", "turn", V.track_role(F.col("readable"), F.col("cues"), F.col("kind")).alias("role"), V.is_transcript(F.col("readable"), F.col("cues"), F.col("kind")).alias("transcript"))


@query("""SELECT conv_id, min(turn) AS turn FROM conversations WHERE turn % 4 = 3 GROUP BY conv_id""")
def transcript_pick(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 4
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), (m != 0).alias("readable"), F.when(m == 1, 0).otherwise(3).alias("cues"), F.when(m == 2, "subtitles").otherwise("captions").alias("kind"), F.lit("en").alias("lang"), F.lit("").alias("label"))
    return V.transcript_of(c, "conv_id").select("conv_id", F.col("track.pos").alias("turn"))


@query("""SELECT conv_id, count(*) AS kept, bool_or(kept_n < all_n) AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS kept_n FROM (SELECT conv_id, all_n, before FROM (SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS all_n,
 coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 1000)) GROUP BY conv_id""")
def bounded_cue_read(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("o", F.struct("turn", "text"))
    return V.bounded_cues(c, "conv_id", "o", 1000).groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"), F.bool_or("truncated").alias("truncated"))


@query("""SELECT count(*) FILTER (WHERE turn % 3 = 0) AS transcribed, count(*) FILTER (WHERE turn % 3 = 1) AS gaps, count(*) FILTER (WHERE turn % 3 = 2) AS failed, count(*) AS videos FROM conversations""")
def media_tally(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("turn") % 3
    return V.tally(table(spark, d, "conversations").select((m == 0).alias("transcript"), (m != 2).alias("readable")))


@query("""SELECT page_id, 'abcdefghij0123456' || page_id % 7 AS playbook, 0 AS pos FROM pages""")
def walkthrough_embeds(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id") % 7
    html = C('<iframe src="https://app.guides.example/embed/abcdefghij0123456', i, '"></iframe><a href="https://guides.example.evil/embed/abcdefghij01234567"><div data-url="https://guides.example/x?id=abcdefghij0123456', i, '&y=1">')
    return V.embeds(table(spark, d, "pages").select("page_id", html.alias("html")))


@query("""SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN s_name ELSE '' END AS title, CASE s_suppkey % 2 WHEN 0 THEN '' ELSE 'several lines' END AS reason, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'narr' WHEN 2 THEN 'cues' ELSE 'title' END AS instruction,
 ['no track', 'no track could be read', 'only translations'][s_suppkey % 3 + 1] AS note FROM supplier""")
def media_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").withColumn("t", V.media_title(F.when(k % 2 == 0, F.concat("s_name", F.lit(" | read by x"))).otherwise("a\nb")))
    tracks = F.when(k % 3 == 1, F.array(F.struct(F.lit(False).alias("readable")))).when(k % 3 == 2, F.array(F.struct(F.lit(True).alias("readable"))))
    said = V.instruction(F.when(k % 4 == 0, F.col("s_name")).otherwise("  "), F.when(k % 4 == 1, "narr"), F.when(k % 4 == 2, "cues").otherwise(""), F.lit("title"))
    return s.select("s_suppkey", "t.title", "t.reason", said.alias("instruction"), V.untranscribed_note(tracks).alias("note"))


@query("""SELECT l_orderkey AS page, l_linenumber AS line, string_agg(l_shipmode_, ' ' ORDER BY l_shipmode_) AS text, round(avg(conf), 2) AS confidence FROM (SELECT l_orderkey, l_linenumber, 'w' || l_partkey AS l_shipmode_, CASE WHEN l_quantity < 5 THEN NULL ELSE l_quantity END AS conf FROM lineitem) GROUP BY ALL""")
def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    conf = F.when(F.col("l_quantity") < 5, -1.0).otherwise(F.col("l_quantity"))
    tsv = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("1"), F.lit("1"), F.col("l_linenumber").cast("string"), C("w", F.col("l_partkey")), conf.cast("string"))
    words = O.parse_tsv(table(spark, d, "lineitem").select(tsv.alias("line")))
    return O.lines(words.withColumn("n", F.col("word"))).select("page", "line", "text", "confidence")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS kept, 'eng' AS asked, 'xyz' AS missing FROM customer""")
def second_readings(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("c_custkey") % 4
    first = F.when(m == 3, "the same text here").otherwise("some words that were read")
    other = F.when(m == 1, "quite another reading of it").when(m == 3, "the same text here!").when(m == 2, "").otherwise("zzz")
    r = table(spark, d, "customer").select("c_custkey", first.alias("a"), other.alias("b"), F.when(m == 0, 90.0).otherwise(40.0).alias("conf"))
    asked = F.lit("eng+xyz")
    return r.select("c_custkey", O.keeps_second(F.col("a"), F.col("b"), F.col("conf")).alias("kept"), F.array_join(F.array_intersect(F.split(asked, r"\+"), F.array(F.lit("eng"))), "+").alias("asked"), F.array_join(O.missing_languages(asked, F.array(F.lit("eng"), F.lit("deu"))), "+").alias("missing"))


@query(r"""SELECT sum(CASE WHEN trim(x) = '' THEN 0 ELSE len(regexp_split_to_array(trim(x), '\s+')) END)::BIGINT AS words FROM (SELECT replace(text, chr(10), ' ') AS x FROM benchmark)""")
def ocr_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").agg(F.sum(O.word_count(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))).alias("words"))


@query("""WITH m AS (SELECT p_size % 5 AS w, count(*) AS n FROM part GROUP BY 1), k AS (SELECT w FROM m ORDER BY n DESC, w LIMIT 1) SELECT p_partkey, round((p_size % 5 + 1) * 595.0 / ((SELECT w FROM k) + 1), 6) AS points, p_size % 5 >= 2 AS landscape FROM part""")
def page_scales(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 5 + 1).alias("width"), F.lit(3).alias("height"))
    return O.scaled(p).select("p_partkey", F.round("points", 6).alias("points"), (F.col("width") >= F.col("height")).alias("landscape"))
