"""The registered queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table. A scan of fewer tasks than cores is dealt over them, so that one small file does not keep most idle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.ogg import stored

    done = stored(_documents(spark, sf_dir).select("doc_id", "text"), keep_media=False)
    return done.select("doc_id", *(f"ogg.{c}" for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")))


def op2_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.sharding import interleaved

    done = interleaved(_documents(spark, sf_dir))
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.divergence import judged

    return judged(_documents(spark, sf_dir)).drop("char_distance", "word_distance")


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.repeats import remove_repeats

    done = remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "repeats.n_words", "repeats.n_removed", F.sha2("repeats.kept", 256).alias("kept_sha256"))


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.packing import packed

    return packed(_documents(spark, sf_dir))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.training_order import materialise, read_shards

    return read_shards(spark, materialise(_documents(spark, sf_dir)), digest=True)


def op7_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.chat import digests

    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)")
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.mixing import mixed

    return mixed(_documents(spark, sf_dir)).drop("copies")


def op9_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.toxicity import scored

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(_documents(spark, sf_dir), labels).select("doc_id", "toxicity.*")


def op10_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.simhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.trie import rebuilt, trie

    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_lexicon_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.lexicon import digests

    return digests(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scrivane.llm.audit import interactions

    return interactions(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE: dict[str, str] = {}

def _op3_sql() -> str:
    from scrivane.llm.divergence import CHAR_LIMIT, CHAR_SLACK, CLASSES, COMMON, GUARD_WORDS, LEAST_DOCUMENTS, WORD_LIMIT, WORD_SLACK

    every = sorted({w for ws in COMMON.values() for w in ws})
    lists = [(lang, i, w) for lang, ws in [*COMMON.items(), ("*", every)] for i, w in enumerate(ws)]
    values = ", ".join(f"('{lang}', {i}, '{x}')" for lang, i, w in lists for x in (w, w.capitalize()))
    known = ", ".join(f"'{x}'" for x in COMMON)
    quoted = {c: p.replace("'", "''") for c, p in CLASSES.items()}
    counts = ", ".join(f"len(regexp_extract_all(t, '{p}')) AS {c}" for c, p in quoted.items())
    rest = " - ".join(CLASSES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, {counts} FROM d
), b AS (
  SELECT *, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    least(strlen(t) - length(t), length(t)) AS wide
  FROM w
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, i, md5(array_to_string(w[i:i + 7], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w))
), rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM h WHERE c > 1) GROUP BY r
), lists(l, pos, word) AS (VALUES {values}), found AS (
  SELECT r, pos, count(*) AS n FROM (SELECT r, CASE WHEN lang IN ({known}) THEN lang ELSE '*' END AS l, unnest(w) AS word FROM b) JOIN lists USING (l, word) GROUP BY r, pos
), com AS (
  SELECT r, lang, pos, coalesce(n, 0) AS n FROM (SELECT r, lang, pos FROM b JOIN (SELECT DISTINCT l, pos FROM lists) x ON x.l = CASE WHEN lang IN ({known}) THEN lang ELSE '*' END) LEFT JOIN found USING (r, pos)
  UNION ALL SELECT r, lang, -1, n_words - coalesce((SELECT sum(n) FROM found WHERE found.r = b.r), 0) FROM b
), cls AS (
  SELECT r, lang, unnest(range(7)) AS pos, unnest([{", ".join(CLASSES)}, length(t) - word_chars, wide, greatest(word_chars - wide - {rest}, 0)]) AS n FROM b
), both_ AS (
  SELECT 'c' AS kind, * FROM cls UNION ALL SELECT 'w', * FROM com
), ref AS (
  SELECT kind, lang, pos, sum(n) AS m, count(*) AS docs FROM both_ GROUP BY ALL
), every_ AS (
  SELECT kind, pos, sum(m) AS a FROM ref GROUP BY ALL
), others AS (
  SELECT kind, r, n, docs > {LEAST_DOCUMENTS} AS many, CASE WHEN docs > {LEAST_DOCUMENTS} THEN m ELSE a END - n AS o FROM both_ JOIN ref USING (kind, lang, pos) JOIN every_ USING (kind, pos)
), pq AS (
  SELECT kind, r, many, n / nullif(sum(n) OVER (PARTITION BY kind, r), 0) AS p, o / nullif(sum(o) OVER (PARTITION BY kind, r), 0) AS q FROM others
), dist AS (
  SELECT r, coalesce(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) FILTER (WHERE kind = 'c' AND p IS NOT NULL AND q IS NOT NULL) / 2, 0)), 0) AS dc,
    coalesce(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) FILTER (WHERE kind = 'w' AND many AND p IS NOT NULL AND q IS NOT NULL) / 2, 0)), 0) AS dw
  FROM pq GROUP BY r
), j AS (
  SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, dc, dw, n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed FROM b LEFT JOIN rep USING (r) JOIN dist USING (r)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND (n_words < {GUARD_WORDS} OR dc <= {CHAR_LIMIT} + {CHAR_SLACK} / sqrt(greatest(n_words, 1)) AND dw <= {WORD_LIMIT} + {WORD_SLACK} / sqrt(greatest(n_words, 1))) AS kept
FROM j
"""


ORACLE["op4_repeated_phrases"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, r, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), h AS (
  SELECT doc_id, r, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p
), m AS (
  SELECT k, min(doc_id) AS least FROM h GROUP BY k
), x AS (
  SELECT h.r, unnest(range(h.i, h.i + 50)) AS j FROM h JOIN m USING (k) WHERE h.doc_id > m.least
), y AS (
  SELECT r, list(DISTINCT j) AS gone FROM x GROUP BY r
), z AS (
  SELECT d.doc_id, d.r, w, coalesce(gone, []) AS gone FROM d LEFT JOIN y ON d.r = y.r
), u AS (
  SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d
), k AS (
  SELECT u.r, string_agg(u.word, ' ' ORDER BY u.j) AS kept FROM u ANTI JOIN x ON u.r = x.r AND u.j = x.j GROUP BY u.r
)
SELECT z.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM z LEFT JOIN k ON z.r = k.r
"""


ORACLE["op7_relational_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), b AS (
  SELECT *, replace(replace(role, '<', '<~'), '[', '[~') AS r, replace(replace(text, '<', '<~'), '[', '[~') AS x,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + CASE WHEN same THEN 6 ELSE 9 + 7 + 4 + length(r) END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""

ORACLE["op8_systematic_mix"] = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM documents
), s AS (
  SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1]::BIGINT AS w FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
    (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest
  FROM w
), l AS (
  SELECT min_by((total - 3 * filled) / rest, {'a': source_size / w, 'b': key}) AS level FROM f WHERE w * ((total - 3 * filled) / rest) <= 3 * source_size
), t AS (
  SELECT key, source_size, least((3 * source_size)::DOUBLE, w * level) AS target FROM f, l
), r AS (
  SELECT d.*, row_number() OVER (PARTITION BY key ORDER BY size, o, doc_id) - 1 AS k FROM d
), c AS (
  SELECT doc_id, size, source_size, target, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
    ('0x' || substr(md5('mix-1/' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN t USING (key)
)
SELECT doc_id, size, source_size, target, ((floor(u + (k + 1) * each) - floor(u + k * each)) * size)::BIGINT AS taken FROM c
"""


ORACLE["op11_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT i AS b, list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)
), table_ AS (
  SELECT list(v ORDER BY b) AS v FROM crc
), ids AS (
  SELECT conv_id, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, x: xor(a // 256, v[xor(a, x) % 256 + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), table_
), r AS (
  SELECT i.conv_id, t.k AS p, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id - i.conv_id % 5 AND t.k < i.h
  UNION ALL SELECT i.conv_id, 100 + t.k, role, text FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.k >= i.h
), c AS (
  SELECT i.conv_id, coalesce(list(sha256(strlen(role)::VARCHAR || ':' || role || text) ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS s, coalesce(list(strlen(text) ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS b
  FROM ids i LEFT JOIN r USING (conv_id) GROUP BY i.conv_id
), m AS (
  SELECT conv_id, d, array_to_string(s[1:d], '') AS key, CASE WHEN d = 0 THEN 0 ELSE b[d] END AS bytes, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM c)
), n AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(bytes) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY d, key
), kids AS (
  SELECT d - 1 AS d, left(key, 64 * (d - 1)::INT) AS key, count(*) AS k FROM n WHERE d > 0 GROUP BY ALL
), w AS (
  SELECT n.*, coalesce(k, 0) AS k FROM n LEFT JOIN kids USING (d, key)
), below AS (
  SELECT a AS d, left(key, 64 * a::INT) AS key, sum((k = 0)::INT) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY ALL
)
SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n::BIGINT AS n_convs, w.k::BIGINT AS n_children, below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN below USING (d, key) LEFT JOIN n p ON p.d = w.d - 1 AND p.key = left(w.key, 64 * (w.d - 1)::INT)
"""

ORACLE["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT part, doc_id, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS bits
  FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits
), x(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs
  FROM x a JOIN x b ON b.f <> a.f JOIN x c ON c.f NOT IN (a.f, b.f) JOIN x d ON d.f NOT IN (a.f, b.f, c.f) JOIN x e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE bits & (before + own) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE bits & own > 0 AND bits & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE bits & own > 0 AND bits & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE bits = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE bits & own > 0 AND bits & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE bits & own > 0 AND bits & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return ORACLE | {"op3_divergence": _op3_sql()}
