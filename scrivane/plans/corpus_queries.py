"""Queries over the read API, outlines, quality and analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivane.functions import text as X
from scrivane.operators import chunks as K
from scrivane.operators import hierarchy as H
from scrivane.operators import quality as Q
from scrivane.operators import reading as R
from scrivane.plans.chunk_queries import _LEGACY
from scrivane.plans.page_queries import C
from scrivane.plans.registry import query, table


def _search(offset: int) -> str:
    return _LEGACY + f""", m AS (SELECT doc_id, printf('chunk-%05d', chunk) AS chunk_id, text FROM c WHERE contains(lower(text), 'tion'))
SELECT doc_id, chunk_id, sha256(text) AS text_sha, (SELECT count(*) FROM m) AS matched, CASE WHEN (SELECT count(*) FROM m) > {offset + 20} THEN {offset + 20}::BIGINT END AS next_offset FROM m ORDER BY doc_id, chunk_id LIMIT 20 OFFSET {offset}"""


def _searched(spark, d, offset):
    found = R.query_chunks(K.legacy_records(table(spark, d, "documents")), "TION", 20, offset)
    return found.select("doc_id", "chunk_id", F.sha2("text", 256).alias("text_sha"), "matched", "next_offset")


@query(_search(0))
def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, 0)


@query(_search(20))
def chunk_search_page2(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, 20)


@query("""SELECT doc_id, length(w)::INT AS characters, sha256(w) AS text_sha, CASE WHEN strlen(w) + 0 < strlen(text) THEN strlen(w)::BIGINT END AS next_offset FROM (
  SELECT doc_id, text, CASE WHEN strlen(text) <= 101 THEN text ELSE left(text, list_max(list_filter(range(50, 102), lambda n: strlen(left(text, n)) <= 101))) END AS w FROM documents)""")
def byte_window(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").select("doc_id", R.byte_window(F.col("text").cast("binary"), 0, 101).alias("w"))
    return w.select("doc_id", F.length(F.col("w.data").cast("string")).alias("characters"), F.sha2(F.col("w.data"), 256).alias("text_sha"), "w.next_offset")


@query("""SELECT doc_id, base64(array_slice(encode(text), 11, 40)) AS data FROM documents""")
def asset_pages(spark: SparkSession, d: str) -> DataFrame:
    w = R.byte_window(F.col("text").cast("binary"), 10, 30, text=False)
    return table(spark, d, "documents").select("doc_id", F.base64(F.coalesce(w["data"], F.lit("").cast("binary"))).alias("data"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE 'c' || doc_id END AS chunk_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE 'h' || doc_id END AS heading, doc_id % 3 = 2 AS unreadable FROM documents""")
def chunk_projection(spark: SparkSession, d: str) -> DataFrame:
    i, m = F.col("doc_id"), F.col("doc_id") % 3
    v = F.when(m == 0, C('{"id":"c', i, '","text":"t","meta":{"headings":["h', i, '"],"kind":"text","sha256":"x"}}')).when(m == 1, C('{"id":"c', i, '","text":"t","heading_path":["h', i, '"],"sha256":"x"}')).otherwise("{broken")
    r = R.chunk_projection(table(spark, d, "documents").select("doc_id", v.alias("value")))
    return r.select("doc_id", "chunk_id", F.get("headings", 0).alias("heading"), "unreadable")


def _outline(spark, d):
    r, n, c = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    none = F.lit(None).cast("bigint")
    per = lambda df, k: df.groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    nations = r.join(per(n, "n_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    customers = n.join(per(c, "c_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return H.renumbered([
        nations.select(F.col("r_regionkey").cast("bigint").alias("key"), none.alias("parent_key"), F.col("r_name").alias("title"), F.col("n").alias("listed")),
        customers.select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_regionkey").cast("bigint").alias("parent_key"), F.col("n_name").alias("title"), (F.coalesce("n", F.lit(0)) + F.when(F.col("n_nationkey") % 5 == 0, 1).otherwise(0)).alias("listed")),
        c.select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("bigint").alias("parent_key"), F.col("c_name").alias("title"), none.alias("listed")),
    ])


_NODES = """WITH r AS (SELECT r_regionkey AS k, 'course-' || lpad(row_number() OVER (ORDER BY r_regionkey)::VARCHAR, 2, '0') AS id, r_name AS title FROM region),
n AS (SELECT n_nationkey AS k, r.id || '/part-' || lpad(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::VARCHAR, 2, '0') AS id, r.id AS parent, n_name AS title FROM nation JOIN r ON r.k = n_regionkey),
c AS (SELECT c_custkey AS k, n.id || '/chapter-' || printf('%02d', o) AS id, n.id AS parent, c_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS o FROM customer) JOIN n ON n.k = c_nationkey)"""


@query(_NODES + " SELECT id AS node_id, NULL AS parent_id, title FROM r UNION ALL SELECT id, parent, title FROM n UNION ALL SELECT id, parent, title FROM c")
def journey_outline(spark: SparkSession, d: str) -> DataFrame:
    return _outline(spark, d).select("node_id", "parent_id", "title")


@query(_NODES + ", x AS (SELECT n.id, n.k, count(c.id) AS children FROM n LEFT JOIN c ON c.parent = n.id GROUP BY ALL) SELECT id AS node_id, children + 1 AS listed, children FROM x WHERE k % 5 = 0")
def count_failures(spark: SparkSession, d: str) -> DataFrame:
    return H.count_failures(_outline(spark, d))


@query("""SELECT 'N' || n_nationkey AS node_id, CASE n_nationkey % 4 WHEN 0 THEN 'vanished' WHEN 1 THEN 'appeared' ELSE 'changed' END AS state FROM nation WHERE n_nationkey % 4 <> 3""")
def outline_diff(spark: SparkSession, d: str) -> DataFrame:
    n, m = table(spark, d, "nation").withColumn("node_id", C("N", F.col("n_nationkey"))), F.col("n_nationkey") % 4
    first = n.where(m != 1).select("node_id", F.col("n_name").alias("title"))
    second = n.where(m != 0).select("node_id", F.when(m == 2, "other").otherwise(F.col("n_name")).alias("title"))
    return H.outline_diff(first, second)


@query("""SELECT n_nationkey, r_name AS first, n_name AS last FROM nation JOIN region ON n_regionkey = r_regionkey""")
def outline_trails(spark: SparkSession, d: str) -> DataFrame:
    o = _outline(spark, d)
    t = H.ancestors(o).join(o.where("level = 'part'").select("node_id", "key"), "node_id")
    return t.select(F.col("key").cast("int").alias("n_nationkey"), F.get("trail", 0).alias("first"), F.element_at("trail", -1).alias("last"))


def _named(spark, d):
    """Texts of customers that name suppliers, all of them in turn, and the suppliers' titles."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    names = s.select(F.col("s_suppkey").alias("k"), F.trim("s_name").alias("name"))
    texts = c.withColumn("k", F.col("c_custkey") % (s.count() + 1)).join(names, "k").select(F.col("c_custkey").alias("node_id"), F.concat(F.lit("see "), "name", F.lit(" and more")).alias("text"))
    titles = s.select(F.col("s_suppkey").alias("node_id"), F.when(F.col("s_suppkey") % 7 == 0, "more").otherwise(F.col("s_name")).alias("title"))
    return texts, titles


@query("""WITH t AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 7 = 0 THEN 'more' ELSE trim(s_name) END AS title FROM supplier), x AS (SELECT c_custkey AS source, 'see ' || trim(s_name) || ' and more' AS text FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) + 1 FROM supplier))
SELECT source, title, CASE n WHEN 1 THEN least_node END AS target, CASE n WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM x JOIN (SELECT title, count(*) AS n, min(node) AS least_node, list(node) AS nodes FROM t GROUP BY title) ON contains(text, title)
WHERE n > 1 OR source <> least_node""")
def cross_refs(spark: SparkSession, d: str) -> DataFrame:
    return H.cross_references(*_named(spark, d))


_LEAD = r"""'^(?:[^\x20\x09-\x0D]+ ){3}[^\x20\x09-\x0D]+'"""


@query(f"""WITH t AS (SELECT item_id AS node, regexp_extract(text, {_LEAD}) AS title FROM benchmark), n AS (SELECT title, count(DISTINCT node) AS n, min(node) AS least_node FROM t WHERE title <> '' GROUP BY title), own AS (SELECT DISTINCT node, title FROM t)
SELECT doc_id AS source, title, CASE n WHEN 1 THEN least_node END AS target, CASE n WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM documents JOIN n ON contains(text, title)
WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM own WHERE own.node = doc_id AND own.title = n.title)""")
def passage_refs(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents that name passages by their first four words."""
    lead = F.regexp_extract("text", r"^(?:[^\x20\x09-\x0D]+ ){3}[^\x20\x09-\x0D]+", 0)
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("node_id"), lead.alias("title"))
    return H.cross_references(table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text"), titles)


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("node_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("""SELECT sha256(text) AS sha256, max(strlen(text))::BIGINT AS bytes, count(*) AS refs, count(DISTINCT source) AS nodes, min(source || '/' || doc_id) AS first, count(DISTINCT source) > 1 AS shared FROM documents GROUP BY 1""")
def media_store(spark: SparkSession, d: str) -> DataFrame:
    return H.media_store(_files(spark, d))


@query("""SELECT o_custkey AS node_id, CASE WHEN count(*) = count(d) THEN sum(d)::BIGINT END AS total FROM (SELECT o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 100 END AS d FROM orders) GROUP BY 1""")
def measured_total(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 100).alias("duration"))
    return H.measured_total(v, "node_id")


@query("""SELECT CASE n_nationkey % 3 WHEN 0 THEN 'missing' ELSE 'extra' END AS state, CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE n_name || '!' END AS title FROM nation WHERE n_nationkey % 3 < 2""")
def reconciled_titles(spark: SparkSession, d: str) -> DataFrame:
    n, m = table(spark, d, "nation"), F.col("n_nationkey") % 3
    return H.reconcile(n.where(m != 1).select(F.col("n_name").alias("title")), n.where(m != 0).select(F.when(m == 1, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")).alias("title")))


@query("""SELECT coalesce(CASE p_partkey % 3 WHEN 0 THEN 'captured' WHEN 1 THEN 'refused' END, 'not-reached') AS status, count(*) AS modules FROM part GROUP BY 1""")
def journey_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.lit("module").alias("level"), F.col("p_name").alias("title"))
    outcomes = p.where("node_id % 3 < 2").select("node_id", F.when(F.col("node_id") % 3 == 0, "captured").otherwise("refused").alias("status"))
    return H.index(p, outcomes).groupBy("status").agg(F.count(F.lit(1)).alias("modules"))


_WORDS = r"SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents"


def _words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("word"))


@query(f"""WITH a AS (SELECT word, count(*) AS na, count(*) FILTER (WHERE doc_id % 10 <> 0) AS nb FROM ({_WORDS}) GROUP BY word) SELECT sum(least(na, nb)) / greatest(sum(na), sum(nb)) AS score FROM a""")
def parity_set(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    return Q.set_score(w, w.where("doc_id % 10 <> 0"), ["word"])


@query(f"""WITH a AS (SELECT word, count(*) FILTER (WHERE doc_id % 2 = 0) AS na, count(*) FILTER (WHERE doc_id % 2 = 1) AS nb FROM ({_WORDS}) GROUP BY word) SELECT sum(least(na, nb)) / sum(na) AS coverage FROM a""")
def parity_coverage(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    return Q.coverage(w.where("doc_id % 2 = 0"), w.where("doc_id % 2 = 1"), ["word"])


@query(f"""WITH a AS (SELECT word, count(*) FILTER (WHERE doc_id % 2 = 0) AS na, count(*) FILTER (WHERE doc_id % 2 = 1) AS nb FROM ({_WORDS}) GROUP BY word) SELECT word, na - nb AS missing FROM a WHERE na > nb ORDER BY missing DESC, word LIMIT 15""")
def worst_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d)
    return Q.worst_missing(w.where("doc_id % 2 = 0"), w.where("doc_id % 2 = 1"), ["word"])


@query("""SELECT 'd' || doc_id AS chunk_id, 'x' || doc_id AS ref FROM documents WHERE doc_id % 50 = 0""")
def pointer_failures(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select(F.lit(0).alias("page"), C("d", F.col("doc_id")).alias("chunk_id"), F.array(C("r", F.col("doc_id")), F.when(F.col("doc_id") % 50 == 0, C("x", F.col("doc_id"))).otherwise("r0")).alias("doc_items"))
    items = docs.select(F.lit(0).alias("page"), C("r", F.col("doc_id")).alias("ref")).union(docs.select(F.lit(0), F.lit("r0"))).distinct()
    return Q.bad_pointers(chunks, items, "page").select("chunk_id", "ref")


@query(r"""SELECT item_id, count(DISTINCT run) AS runs, count(DISTINCT run) FILTER (WHERE contains(held, run)) AS found FROM (SELECT item_id, substr(w, i, 20) AS run, left(w, length(w) // 2) AS held FROM (
  SELECT item_id, w, unnest(range(1, length(w) - 18)) AS i FROM (SELECT item_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g') AS w FROM benchmark))) GROUP BY item_id""")
def printed_share(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", Q.squeezed(F.col("text")).alias("text"))
    held = b.select("item_id", F.expr("left(text, cast(length(text) div 2 as int))").alias("text"))
    return Q.printed_share(b, held, "item_id").select("item_id", "runs", "found")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'utf-16-le' WHEN doc_id % 4 = 3 AND regexp_matches(text, '[^\x00-\x7f]') THEN 'windows-1252' ELSE 'utf-8' END AS encoding, sha256(text) AS text_sha FROM documents""")
def encoding_decisions(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.encoding import decode_text

    t, m = F.col("text"), F.col("doc_id") % 4
    data = (F.when(m == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).when(m == 1, F.concat(F.unhex(F.lit("EFBBBF")), t.cast("binary"))).when(m == 3, X.single_bytes(t)).otherwise(t.cast("binary")))
    r = table(spark, d, "documents").select("doc_id", decode_text(data, F.lit("windows-1252")).alias("r"))
    return r.select("doc_id", "r.encoding", F.sha2("r.text", 256).alias("text_sha"))


@query("""SELECT kind, count(*) AS urls FROM (SELECT url, arg_min(kind, seq) AS kind FROM (SELECT event_id AS seq, 'https://x/' || user_id AS url, event_type AS kind FROM events) GROUP BY url) GROUP BY kind""")
def failed_requests(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import failed_requests as tally

    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), C("https://x/", F.col("user_id")).alias("url"), F.col("event_type").alias("kind"))
    return tally(e)[0]


@query("""SELECT url, seq FROM (SELECT 'https://x/' || user_id AS url, min(event_id) AS seq FROM events GROUP BY 1) ORDER BY seq, url LIMIT 20""")
def failed_requests_top(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import failed_requests as tally

    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), C("https://x/", F.col("user_id")).alias("url"), F.col("event_type").alias("kind"))
    return tally(e)[1].select("url", "seq")


@query("""SELECT lang, source, count(*) AS docs, sum(n_chars)::BIGINT AS chars, grouping_id(lang, source)::INT AS g FROM documents GROUP BY CUBE (lang, source)""")
def lang_source_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("g"))


@query("""SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000 THEN 1 ELSE 0 END AS new FROM events) GROUP BY user_id""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    g = H.gaps(table(spark, d, "events"), "user_id")
    return g.groupBy("user_id").agg(F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1800), 1).otherwise(0)).alias("sessions"))


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value"))
    return w.select(X.clock_seconds(F.col("w.start")).alias("start"), "event_type", "events", "value")


@query("""SELECT user_id, event_type, n, rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS rank, dense_rank() OVER (PARTITION BY event_type ORDER BY n DESC) AS dense FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def user_ranks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"))
    return c.withColumn("rank", F.rank().over(w).cast("bigint")).withColumn("dense", F.dense_rank().over(w).cast("bigint"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def level_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))


@query("""SELECT median(v)::DOUBLE AS median, median(v) * 3 AS budget, count(*) AS runs FROM (SELECT value AS v FROM events)""")
def run_medians(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.median("value").alias("median"), (F.median("value") * 3).alias("budget"), F.count(F.lit(1)).alias("runs"))


@query("""SELECT doc_id, 'documents/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents""")
def checksum_manifest(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents").select("doc_id", C("documents/", F.col("doc_id"), ".txt").alias("path"), F.col("text").cast("binary").alias("content"))
    return Q.file_manifest(f).withColumn("doc_id", F.regexp_extract("path", "([0-9]+)", 1).cast("bigint"))


@query(r"""SELECT doc_id, count(*) FILTER (WHERE regexp_matches(x, '[^\x00-\x7f]')) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY doc_id""")
def non_ascii_lines(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.sources.encoding import non_ascii_lines as kept

    t = table(spark, d, "documents").select("doc_id", kept(F.col("text")).alias("t"))
    return t.select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("bigint").alias("lines"))


@query(None)
def captured_manifest(spark: SparkSession, d: str) -> DataFrame:
    t = R.Library(spark).capture(table(spark, d, "pages"))
    return t["manifest"].select("page_id", "url", "metadata.title", "chunks", "sha256")
