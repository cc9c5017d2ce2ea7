"""Candidates of references: each node of a title a row, made on all cores."""

from pyspark.sql import functions as F

from scrivane.operators import hierarchy as H


def test_candidates_are_whole_and_made_on_all_cores(spark, monkeypatch):
    monkeypatch.setattr(H, "CANDIDATES", 3)
    titles = [(i, " more " if i % 2 else f"name{i}") for i in range(40)] + [(1, "more"), (None, "more"), (50, ""), (51, None)]
    texts = [(100 + i, f"see name{i} and more") for i in range(60)] + [(2, "name2 more"), (3, None)]
    t, x = spark.createDataFrame(titles, "node_id bigint, title string"), spark.createDataFrame(texts, "node_id bigint, text string")
    refs = H.cross_references(x, t)
    found = H.cross_reference_candidates(refs, t)
    clean = {(n, name.strip()) for n, name in titles if name and name.strip()}
    want = []
    for source, text in texts:
        for title in {name for _, name in clean}:
            nodes = [n for n, name in clean if name == title]
            if text and title in text and (len(nodes) > 1 or nodes[0] != source):
                want += [(source, title, n) for n in nodes]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert found.columns == ["source", "title", "candidate"]
    assert found.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_slices_and_blocks_leave_no_candidate_out(spark, monkeypatch):
    monkeypatch.setattr(H, "CANDIDATES", 7)
    monkeypatch.setattr(H, "SLICE", 3, raising=False)
    monkeypatch.setattr(H, "MET", 2, raising=False)
    t = spark.createDataFrame([(i, "more") for i in range(30)] + [(None, "more"), (40, "one"), (41, "two"), (42, "two")], "node_id bigint, title string")
    refs = spark.createDataFrame([(s, "more", None) for s in range(25)] + [(s, "one", 40) for s in range(5)] + [(None, "two", None), (7, "two", None)], "source bigint, title string, target bigint")
    found = H.cross_reference_candidates(refs, t)
    want = [(s, "more", n) for s in range(25) for n in [*range(30), None]] + [(s, "one", 40) for s in range(5)] + [(s, "two", n) for s in (None, 7) for n in (41, 42)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_files_of_candidates_are_small(spark, tmp_path):
    """Rows grow with references times nodes; their files hold a small part of a byte for each."""
    t = spark.range(3000).select(F.col("id").alias("node_id"), F.lit("more").alias("title"))
    refs = spark.range(3000).select(F.col("id").alias("source"), F.lit("more").alias("title"), F.lit(None).cast("bigint").alias("target"))
    H.cross_reference_candidates(refs, t).write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 9_000_000 * 0.4
