"""A page's metadata are read once, however many links it has."""


def test_metadata_are_read_once_a_page(spark, tmp_path):
    from scrivane.plans import stream_queries

    pages = [(1, 'u', '<html lang="de"><a href="/a">a</a><a href="/b">b</a><a href="/c">c</a></html>'), (2, 'v', '<html lang="en"><p>none</p></html>')]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = stream_queries.sql_surface(spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 3, "de"), (2, 0, "en")]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    metadata, links = (min(i for i, x in enumerate(plan) if "EvalPython" in x and "page_metadata(" in x), min(i for i, x in enumerate(plan) if "link_table(" in x))
    assert "Union" in "".join(plan[:metadata]) and not any("link_table(" in x for x in plan[:metadata]) and metadata < links
