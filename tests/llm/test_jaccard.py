"""Near-duplicates of the pipeline against brute-force Jaccard similarity."""

import random

import pyspark.sql.functions as F

from scrivane.llm import jaccard


def word_sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """The least id of each component of pairs of similarity 0.8 or more."""
    sets = {i: word_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def corpus():
    rng = random.Random(7)
    rows = [(0, ""), (1, None), (2, "one two"), (3, "One  TWO"), (4, "one two three")]
    for group in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 300]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    base = [f"h{i}" for i in range(100)]
    for i in range(150):  # one large group: an edited word near the end costs few shingles, one in the middle costs five
        copy = list(base)
        copy[i % 100] = f"y{i}"
        if i % 3 == 0:
            copy[(i * 7) % 100] = f"z{i}"
        rows.append((len(rows), " ".join(copy)))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 150
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    extra = spark.createDataFrame([(None, "one two"), (3, "one two")], docs.schema)
    kept = jaccard.keep_one(docs.union(extra))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values())) and kept.where("doc_id is null").count() == 1
    assert jaccard.near_duplicates(docs.where("false")).count() == 0


def test_pipeline_stage_drops_what_is_alike(spark):
    import corpus_pipeline

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(brute(rows).values()))


def test_shards_beyond_the_batch():
    """A shard dealt over several record batches is still one, and a member names so many partners as it may."""
    import numpy as np
    import pyarrow as pa

    sketch = np.arange(128, dtype=np.uint16).tobytes()
    rows = [(1, 5, 5, 9, 0), *[(2, i, i, 9, i) for i in (0, 1, 2, 3)], (3, 7, 7, 9, 0), (4, 8, 8, 9, 0), (4, 9, 9, 9, -1), (5, 1, 6, 9, 0), (5, 2, 6, 9, 0), (6, 2, 2, 9, 2), (6, 3, 3, 9, 3)]
    bottom = np.arange(9, dtype=np.uint32).tobytes()
    rows = [(*r, sketch, bottom, [x[0] for x in rows if x[1] == r[1]]) for r in rows]
    types = [pa.int64()] * 5 + [pa.binary(), pa.binary(), pa.list_(pa.int64())]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(types)], list("abcdefgh"))
    for size in (1, 2, 3, 10):
        for partners, want in ((1, [(0, 1), (0, 2), (1, 3)]), (9, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])):
            out = jaccard._rounds(0.8, 4, partners)(batch(rows[i : i + size]) for i in range(0, len(rows), size))
            assert sorted((r["u"], r["v"]) for b in out for r in b.to_pylist()) == want, size
    assert np.allclose(jaccard.similarity(np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)), 0.5)


def test_sketches_rule_out_only_what_is_unlike():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (40, 200, 900):
        for share in (0.3, 0.7, 0.85, 0.95):
            whole = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(whole[:n]), np.unique(np.concatenate([whole[: int(share * n)], whole[n : 2 * n - int(share * n)]]))
            true = jaccard.similarity(a, b)
            got = jaccard.may_be_alike(*(x for s in (a, b) for x in (np.unique((s[:256] >> np.uint64(32)).astype(np.uint32)), len(s))), 0.8)
            assert got if true >= 0.8 else not got or true > 0.6


def test_rows_of_one_id_are_told_apart(spark):
    """Unlike texts of one id both stay, of rows alike in id and text one does, and reruns agree."""
    from scrivane.llm import simhash

    long = " ".join(f"l{i}" for i in range(40))
    rows = [(1, "a b c d e f", "x", {"k": 1}), (1, long, "x", {"k": 1}), (2, long, "y", {}), (3, "q r s t u v", "b", None), (3, "q r s t u v", "a", None), (3, "q r s t u v", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _one_id string, m map<string, int>")
    for options in ({}, {"shingle": 5, "radius": 16, "least": 0.8}):
        once, again = (sorted((r.doc_id, r.text, r._one_id) for r in simhash.keep_one(d, **options).collect()) for d in (docs, docs.repartition(7)))
        assert once == again and [r[:2] for r in once] == [(1, "a b c d e f"), (1, long), (3, "q r s t u v")]


def test_shards_over_the_limit_lose_no_pair(spark, monkeypatch):
    """Texts that share one beginning fill every shard; each is alike to the one short text alone, and none is lost."""
    monkeypatch.setattr(jaccard, "SHARD_MOST", 4)
    monkeypatch.setattr(jaccard, "FINER", 0)
    base = [f"b{i}" for i in range(160)]
    rows = [(k, " ".join(base + [f"p{k}_{i}" for i in range(30 if k else 1)])) for k in range(90)]
    assert set(brute(rows).values()) == {0} and len(set(brute(rows[1:]).values())) == 89
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {0}


def test_links_of_earlier_rounds_are_not_met_again(spark, monkeypatch):
    """Each round's components are made of its own links, on top of those before; a round without links makes none."""
    met = []
    real = jaccard.connected_components
    monkeypatch.setattr(jaccard, "connected_components", lambda links: met.append(links.count()) or real(links))
    edges = lambda rows: spark.createDataFrame(rows, "u bigint, v bigint")
    roots = jaccard._rooted(edges([(1, 2), (2, 3), (5, 6), (8, 9)]), None)
    roots = jaccard._rooted(edges([(3, 6), (9, 11), (20, 21), (2, 5)]), roots)
    assert {r.node: r.root for r in roots.collect() if r.node != r.root} == {2: 1, 3: 1, 5: 1, 6: 1, 9: 8, 11: 8, 21: 20}
    assert met == [4, 4] and roots.count() == len({r.node for r in roots.collect()})
    met.clear()
    monkeypatch.setattr(jaccard, "PARTNERS", (2, 3, None))
    written = []
    write = jaccard.write_table
    monkeypatch.setattr(jaccard, "write_table", lambda df, name: written.append((name, out := write(df, name))) or out)
    rows = corpus()
    jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    links = [t.count() for name, t in written if name == "links"]
    assert met == [n for n in links if n] and len(links) > 1
