"""Character references without their semicolon, as the SQL of page_noise, page_choice and article_regions reads them."""

import duckdb
import pytest

from scrivane.operators import pages
from scrivane.plans import catalog

TITLE = "Ver&amp und&amp;&amp;&amp; x &am &quot;y&quot; a&b &amp"
HTML = f"<html><head><title>{TITLE}</title></head><body><nav><ul><li>m</li></ul></nav><article><h1>{TITLE}</h1><p>{'viele Worte &amp; mehr &copy; ' * 20}</p></article><footer>f &middot; g</footer></body></html>"


@pytest.mark.parametrize("name", ["page_noise", "page_choice", "article_regions"])
def test_references_without_semicolon_stay(spark, tmp_path, name):
    spark.createDataFrame([(1, "https://a.invalid/", HTML), (2, "https://a.invalid/", HTML.replace("&amp ", "&amp; "))], "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall())


def test_terminated_references_are_left(spark):
    given = "a &amp; &#38; &#x26; &amp &#38 & &amp&amp; &frac12;"
    row = spark.createDataFrame([(given,)], "h string").select(pages.terminated("h").alias("h")).first()
    assert row["h"] == "a &amp; &#38; &#x26; &amp;amp &amp;#38 &amp; &amp;amp&amp; &frac12;"
