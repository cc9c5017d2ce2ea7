"""Queries over streams and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.plans.page_queries import _TEXT_SQL, C
from scrivane.plans.registry import query, table
from scrivane.sources import office
from scrivane.sources.readers import register_functions
from scrivane.streaming import jobs


@query(rf"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"'))::INT AS links, sha256({_TEXT_SQL.format('html')}) AS text_sha FROM pages""")
def stream_bundle(spark: SparkSession, d: str) -> DataFrame:
    return jobs.page_bundle(spark, f"{d}/pages.parquet")


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return jobs.windowed(spark, f"{d}/events.parquet")


@query("SELECT DISTINCT event_id FROM events")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return jobs.deduplicated(spark, f"{d}/events.parquet", ["event_id"])


@query("SELECT user_id, count(*) AS events, round(sum(value), 4) AS spent FROM events GROUP BY 1")
def stream_budgets(spark: SparkSession, d: str) -> DataFrame:
    return jobs.budgets(spark, f"{d}/events.parquet").withColumn("spent", F.round("spent", 4))


@query(r"""SELECT n_nationkey, k.kind, CASE k.kind WHEN 'docx' THEN '## ' || n_name || nl || nl || '3. b' || n_nationkey || nl || '4. c & <d>' WHEN 'pptx' THEN '## Slide 1: ' || n_name || nl || nl || 'b' || n_nationkey || nl || nl || '### Notes' || nl || nl || 'c & <d>'
 WHEN 'xlsx' THEN '## ' || n_name || nl || nl || '| b' || n_nationkey || ' |  | c & <d> |' || nl || '| --- | --- | --- |' ELSE 'Title: ' || n_name || nl || nl || '# b' || n_nationkey || nl || nl || 'c & \<d\>' END AS markdown
FROM (SELECT *, chr(10) AS nl FROM nation), (VALUES ('docx'), ('pptx'), ('xlsx'), ('epub')) AS k(kind)""")
def office_files(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("kind", F.explode(F.array(*map(F.lit, ("docx", "pptx", "xlsx", "epub")))))
    files = n.select("n_nationkey", "kind", office.sample_file(F.col("kind"), F.array("n_name", C("b", F.col("n_nationkey")), F.lit("c & <d>"))).alias("content"))
    return files.select("n_nationkey", "kind", office.converted(F.col("kind"), F.col("content"))["markdown"].alias("markdown"))


@query("""SELECT n_nationkey, NULL AS markdown, 'no archive' AS error FROM nation""")
def broken_files(spark: SparkSession, d: str) -> DataFrame:
    c = office.converted(F.lit("zip"), F.col("n_name").cast("binary"))
    return table(spark, d, "nation").select("n_nationkey", c["markdown"].alias("markdown"), c["error"].alias("error"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"')) AS links, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages""")
def sql_surface(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark)
    table(spark, d, "pages").createOrReplaceTempView("scrivane_pages")
    # Pages and links are counted apart: the metadata are read once a page, and a page without links keeps its row.
    return spark.sql("""SELECT page_id, sum(links) AS links, any_value(language, true) AS language FROM (SELECT page_id, 0 AS links, page_metadata(html).language AS language FROM scrivane_pages
 UNION ALL SELECT p.page_id, 1, NULL FROM scrivane_pages p, LATERAL link_table(p.html) t WHERE t.url IS NOT NULL) GROUP BY page_id""")


@query("""SELECT n_nationkey, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL WHEN 4 THEN true ELSE true END AS internal, CASE k WHEN 2 THEN '127.0.0.1' WHEN 3 THEN '' ELSE host END AS readings
FROM (SELECT n_nationkey, n_nationkey % 6 AS k, ['10.1.2.3', '8.8.8.8', '0177.1', 'name.example', '::ffff:10.0.0.1', 'ff02::1'][n_nationkey % 6 + 1] AS host FROM nation)""")
def address_policy(spark: SparkSession, d: str) -> DataFrame:
    from scrivane.operators.policy import is_internal, readings

    host = F.element_at(F.array(*map(F.lit, ["10.1.2.3", "8.8.8.8", "0177.1", "name.example", "::ffff:10.0.0.1", "ff02::1"])), (F.col("n_nationkey") % 6 + 1).cast("int"))
    n = table(spark, d, "nation").select("n_nationkey", host.alias("host")).withColumn("r", readings(F.col("host")))
    return n.select("n_nationkey", is_internal(F.get("r", 0)).alias("internal"), F.array_join("r", ",").alias("readings"))
