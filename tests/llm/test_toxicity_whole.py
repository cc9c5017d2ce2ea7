"""The classifier learns from every labelled row, in shards, and reruns agree."""

import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from scrivane.llm import toxicity
from test_operators import labelled


def test_all_labelled_rows_teach_in_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    rows, labels = labelled(n=3000)
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    taught, shards = toxicity.taught(docs, marks, "doc_id", "text", "lang", 7)
    known = {i: y for i, _, y in labels if y is not None and i < 3000 and zlib.crc32(str(i).encode()) % 5}
    texts = {i: t for i, t, _ in rows}
    assert sorted((r.toxic, r.text) for r in taught.collect()) == sorted((y, texts[i]) for i, y in known.items())
    assert shards >= 3 and shards == taught.select(F.spark_partition_id()).distinct().count()
    steps = []
    monkeypatch.setattr(toxicity, "steepness", lambda z, y, n, was=toxicity.steepness: steps.append((int(n.sum()), int(y.sum()))) or was(z, y, n))
    got = toxicity.scored(docs, marks).select("doc_id", "toxicity.*").collect()
    assert steps == [(len(known), sum(known.values()))]  # the scale and the thresholds weigh every row
    held = [r for r in got if r.doc_id is not None and r.doc_id < 3000 and r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    again = toxicity.scored(docs.repartition(5), marks.repartition(3)).select("doc_id", "toxicity.*").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_a_training_survives_packing():
    import numpy as np

    live = np.random.default_rng(0).random(toxicity.BUCKETS) < 0.01
    one = toxicity.Training(live, 3)
    ids = np.flatnonzero(live)[:240].reshape(-1, 6)[:, : 1 + len(toxicity.PREFIXES)].astype(np.int32)
    one.step([ids, ids[:0]], np.array([1, 0]), np.array([1.0, 1.0]))
    two = toxicity.Training.unpacked(one.packed())
    assert np.allclose(two.rest(), one.rest()) and (two.model.table == one.model.table).all() and (two.grown[0] == one.grown[0])[live].all()
    assert one.model.logits([ids]) == two.model.logits([ids])


def test_a_long_text_is_pooled_in_pieces(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    model = toxicity.TextCNN.fresh(2)
    x = np.vstack([rng.normal(0, 1, (57, toxicity.DIM)), np.zeros((2, toxicity.DIM))]).astype(np.float32)
    whole = model.best(x)
    monkeypatch.setattr(toxicity, "PIECE", 10)
    pieces = model.best(x)
    assert np.allclose(whole[0], pieces[0]) and (whole[1] == pieces[1]).all()


def test_changes_are_sent_in_few_bytes_and_summed_whole(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    at = np.flatnonzero(rng.random(toxicity.BUCKETS) < 0.3)
    changes = rng.laplace(0, 0.01, (len(at), toxicity.WIDE))
    changes[:, -1] = rng.exponential(0.001, len(at))
    whole = np.rint(changes / toxicity.unit(at)).astype(np.int64)
    rows = [b for k in range(4) for b in toxicity._blocks(1, at[k:], whole[k:])]
    assert sum(c.nbytes for b in rows for c in b.columns) < 12 * 4 * len(at)  # a row of numbers for each bucket took 42 in the shuffle, and 80 before it
    whole[0, 0], whole[-1] = -(1 << 62), 1 << 40
    rows = [b for k in range(4) for b in toxicity._blocks(1, at[k:], whole[k:])]
    sent = spark.createDataFrame(pa.Table.from_batches(rows)).repartition(3)
    got = sorted(toxicity.gathered(sent), key=lambda r: r[1][0])
    assert {k for k, *_ in got} == {1} and (np.concatenate([p for _, p, *_ in got]) == at).all()
    tasks = np.concatenate([n for *_, n in got])
    assert (tasks == np.minimum(np.arange(len(at)) + 1, 4)).all() and (np.concatenate([s for *_, s, _ in got]) == whole * tasks[:, None]).all()
    assert not list(toxicity._blocks(1, at[:0], whole[:0]))


def test_a_pass_sends_few_bytes_a_bucket():
    import numpy as np

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, 9))) for _ in range(60)) for _ in range(640)]
    batch = pa.RecordBatch.from_pydict({"fold": [1] * 640, "toxic": [i % 2 for i in range(640)], "lang": ["en"] * 640, "text": texts})
    one = toxicity.Training(np.ones(toxicity.BUCKETS, bool), 3)
    shared = type("Shared", (), {"value": ({0: one.packed()}, {0: np.ones(2)})})()
    sent = list(toxicity._learned(shared)([batch]))
    touched, rows = set(), list(toxicity._examples([batch]))
    for lo in range(0, 640, toxicity.BATCH):
        touched.update(one.step([r[2] for r in rows[lo : lo + toxicity.BATCH]], np.array([r[1] for r in rows[lo : lo + toxicity.BATCH]]), np.ones(toxicity.BATCH)).tolist())
    assert len(touched) > 20_000 and sum(c.nbytes for b in sent for c in b.columns) < 16 * len(touched)  # 80 before
