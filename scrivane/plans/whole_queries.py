"""All referrers and all candidates, both sides of a comparison from whole texts, and second names of queries over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import text as X
from scrivane.operators import hierarchy as H
from scrivane.operators import quality as Q
from scrivane.operators import records as B
from scrivane.operators import rules
from scrivane.plans import chunk_queries, corpus_queries, detail_queries, record_queries
from scrivane.plans.registry import ORACLES, query, table


@query(ORACLES["step_chunks"])
def step_chunks_whole(spark: SparkSession, d: str) -> DataFrame:
    return record_queries.step_chunks(spark, d)


@query(ORACLES["track_files"])
def track_files_whole(spark: SparkSession, d: str) -> DataFrame:
    return record_queries.track_files(spark, d)


@query(ORACLES["appendix_pages"])
def appendix_pages_whole(spark: SparkSession, d: str) -> DataFrame:
    return record_queries.appendix_pages(spark, d)


@query(ORACLES["step_cues"])
def step_cues_whole(spark: SparkSession, d: str) -> DataFrame:
    return chunk_queries.step_cues(spark, d)


@query(ORACLES["walkthrough_texts"])
def walkthrough_texts_whole(spark: SparkSession, d: str) -> DataFrame:
    return detail_queries.walkthrough_texts(spark, d)


@query("""SELECT sha256(text) AS sha256, source AS node_id, concat_ws('/', source, doc_id::VARCHAR) AS path FROM documents""")
def media_references(spark: SparkSession, d: str) -> DataFrame:
    return H.media_references(corpus_queries._files(spark, d))


@query("""WITH t AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 7 = 0 THEN 'more' ELSE trim(s_name) END AS title FROM supplier), x AS (SELECT c_custkey AS source, 'see ' || trim(s_name) || ' and more' AS text FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) + 1 FROM supplier)),
n AS (SELECT title, count(*) AS n, min(node) AS least_node FROM t GROUP BY title)
SELECT source, title, node AS candidate FROM x JOIN n ON contains(text, title) JOIN t USING (title) WHERE n > 1 OR source <> least_node""")
def cross_ref_candidates(spark: SparkSession, d: str) -> DataFrame:
    texts, titles = corpus_queries._named(spark, d)
    return H.cross_reference_candidates(H.cross_references(texts, titles), titles)


# The second side of a comparison is every whole text with the last letter of words in e lost.
_SIDES = r"""s AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS a, regexp_extract_all(lower(replace(coalesce(text, ''), 'e ', ' ')), '[\p{L}\p{N}_]+') AS b FROM documents),
w AS (SELECT word, sum(x)::BIGINT AS na, sum(y)::BIGINT AS nb FROM (SELECT unnest(a) AS word, 1 AS x, 0 AS y FROM s UNION ALL SELECT unnest(b), 0, 1 FROM s) GROUP BY word)"""


def _sides(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", X.tokens(text).alias("a"), X.tokens(F.replace(text, F.lit("e "), F.lit(" "))).alias("b"))


@query(f"""WITH {_SIDES} SELECT 'texts' AS metric, round((SELECT sum(least(na, nb)) / greatest(sum(na), sum(nb)) FROM w), 9) AS score UNION ALL SELECT 'words', round((SELECT sum(least(na, nb)) / sum(na) FROM w), 9)
UNION ALL SELECT 'chunks', round((SELECT count(*) FILTER (WHERE len([x for x in b if NOT list_contains(a, x)]) = 0) / count(*) FROM s), 9)""")
def parity_scores_whole(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    a, b = (sides.select(F.explode(c).alias("word")) for c in ("a", "b"))
    scores = {"texts": Q.set_score(a, b, ["word"]), "words": Q.coverage(a, b, ["word"]).toDF("score"), "chunks": B.chunk_traceability(sides.select(F.col("b").alias("refs"), F.col("a").alias("known")))}
    first, *rest = [s.select(F.lit(m).alias("metric"), F.round("score", 9).alias("score")) for m, s in scores.items()]
    for s in rest:
        first = first.unionByName(s)
    return first


@query(f"""SELECT metric, score >= CASE metric WHEN 'words' THEN 0.99 ELSE 1.0 END AS passed FROM ({ORACLES["parity_scores_whole"]})""")
def parity_report(spark: SparkSession, d: str) -> DataFrame:
    """The scores of whole texts against their changed form, held to thresholds."""
    return B.judged(parity_scores_whole(spark, d), {"texts": 1.0, "words": 0.99, "chunks": 1.0})


@query(f"""WITH {_SIDES} SELECT word, na - nb AS missing FROM w WHERE na > nb ORDER BY missing DESC, word LIMIT 15""")
def worst_tokens_whole(spark: SparkSession, d: str) -> DataFrame:
    sides = _sides(spark, d)
    return Q.worst_missing(sides.select(F.explode("a").alias("word")), sides.select(F.explode("b").alias("word")), ["word"])


@query(r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND regexp_matches(coalesce(text, ''), '\p{L}') THEN 'Sign up to keep reading' END AS words FROM documents""")
def wall_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts that a wall ends (even ids) or that go on after one."""
    text, wall = F.coalesce("text", F.lit("")), F.lit("Sign up to keep reading")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(text, F.lit("\n"), wall)).otherwise(F.concat(wall, F.lit("\n"), text, F.lit("\n"), text, F.lit(" and so the text goes on")))
    return table(spark, d, "documents").select("doc_id", rules.wall_words(said).alias("words"))
