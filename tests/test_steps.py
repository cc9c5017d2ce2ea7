"""Batches are worked through in pieces, so that the Python values of one piece are held at a time."""

import pyarrow as pa

from scrivane.functions import arrow
from scrivane.operators import pages


def test_pieces_cover_a_batch_in_order_and_are_small():
    texts = pa.array(["x" * (1 << 21), None, *["y" * 9000] * 300, *[""] * 500, "z" * (1 << 21)])
    for columns in ((texts,), (texts.slice(1, 700), pa.array(range(700)))):
        found = list(arrow.steps(columns))
        assert [at for at, _ in found] == [sum(n for _, n in found[:i]) for i in range(len(found))] and sum(n for _, n in found) == len(columns[0])
        assert all(n == 1 or n <= arrow.STEP_ROWS and sum(c.slice(at, n).nbytes for c in columns) <= arrow.STEP_BYTES for at, n in found)
    assert list(arrow.steps((pa.array([], pa.string()),))) == [(0, 0)]


def test_a_function_never_sees_a_whole_batch(spark):
    seen = arrow.in_steps(lambda a: pa.array([len(a)] * len(a), pa.int32()))
    assert max(seen(pa.array(range(10_000))).to_pylist()) <= arrow.STEP_ROWS
    df = spark.range(300).selectExpr("id AS page_id", "concat('<p>a ', id, '</p>') AS html").coalesce(1)
    got = pages.block_rows(df).select("page_id", "text").collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"a {i}") for i in range(300)]
    empty = df.where("false").select(pages.markdown("html").alias("m"))
    assert empty.count() == 0


def test_a_batch_of_pages_holds_the_blocks_of_a_few(monkeypatch):
    """What `blocks` keeps in Python at a time is that of a piece."""
    most = []
    whole = pages._each
    monkeypatch.setattr(pages, "_each", lambda values, *rest: most.append(len(values)) or whole(values, *rest))
    out = pages.blocks.udf().func(pa.array(["<p>x</p>"] * 1000))
    assert len(out) == 1000 and max(most) <= arrow.STEP_ROWS
