"""Titles in texts and shared runs against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from scrivane.operators import quality, titles


def brute_references(texts, names):
    by = {}
    for node, title in names:
        if title and title.strip(" "):
            by.setdefault(title.strip(" "), set()).add(node)
    out = set()
    for node, text in texts:
        for title, nodes in by.items():
            if text and title in text and (node not in nodes or len(nodes) > 1):
                out.add((node, title, min(nodes) if len(nodes) == 1 else None, "resolved" if len(nodes) == 1 else "ambiguous"))
    return out


@pytest.mark.parametrize("shard", [titles.SHARD, 60])
def test_cross_references(spark, monkeypatch, shard):
    monkeypatch.setattr(titles, "SHARD", shard)
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "ab", "b a", "é", "Ünit", "x.y", "(z)"])
    names = [(i, " ".join(word() for _ in range(rng.randrange(1, 4)))) for i in range(30)] + [(90, None), (91, "  "), (92, " ab "), (93, "L" * 300 + "1"), (94, "L" * 300 + "2"), (94, "L" * 300 + "2")]
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "say " + "L" * 301), (63, "L" * 300 + "12"), (93, "L" * 300 + "1 and ab"), (3, "ab")]
    texts += texts[:2]
    got = titles.cross_references(spark.createDataFrame(texts, "node_id int, text string"), spark.createDataFrame(names, "node_id int, title string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_references(texts, names)
    assert titles.cross_references(spark.createDataFrame(texts, "node_id int, text string"), spark.createDataFrame([], "node_id int, title string")).count() == 0


def test_the_plan_of_cross_references_takes_no_text_apart(spark):
    from scrivane.plans import catalog

    plan = catalog.QUERIES["passage_refs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def brute_share(wanted, held, n=quality.RUN):
    runs = lambda ts: {t[i : i + n] for t in ts if t for i in range(len(t) - n + 1)}
    return len(runs(wanted)), len(runs(wanted) & runs(held))


def test_shared_runs(monkeypatch):
    rng = random.Random(6)
    for k in range(60):
        text = lambda n: "".join(rng.choice("abé\U0001f600"[: rng.choice([1, 2, 4])]) for _ in range(n))
        wanted = [rng.choice([None, "", text(5), text(20), text(90)]) for _ in range(3)]
        held = [rng.choice([None, text(200), (wanted[0] or "") + text(9), text(20)]) for _ in range(rng.randrange(3))]
        assert quality.shared_runs(wanted, held) == brute_share(wanted, held)
    real = quality._fingerprints

    def colliding(texts, length):
        codes, found = real(texts, length)
        found[0] %= 3
        return codes, found

    monkeypatch.setattr(quality, "_fingerprints", colliding)
    assert quality.shared_runs(["ab" * 30, "c" * 40], ["ba" * 30]) == brute_share(["ab" * 30, "c" * 40], ["ba" * 30])


@pytest.mark.parametrize("most", [1000, 1])
def test_printed_share(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "MOST_TEXTS", most)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    wanted = [(i % 9, rng.choice([None, "", text(15), text(60)])) for i in range(20)]
    held = [(i % 7, text(100)) for i in range(11)] + [(50, text(50))]
    got = quality.printed_share(spark.createDataFrame(wanted, "id int, text string"), spark.createDataFrame(held, "id int, text string"), "id")
    want = {i: brute_share([t for j, t in wanted if j == i], [t for j, t in held if j == i]) for i in {i for i, _ in wanted}}
    assert {(r["id"], r["runs"], r["found"]) for r in got.collect()} == {(i, a, b) for i, (a, b) in want.items() if a}
    assert all(r["share"] == r["found"] / r["runs"] for r in got.collect())
