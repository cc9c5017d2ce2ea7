"""Rows that once ended a job, took another row's place, or emptied a class."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivane.llm import common, mixing, packing, toxicity

BLANKS = {"newlines": "\n", "blanks": " ", "tabs": "\t", "line ends": "\r\n", "wide": "　"}


@pytest.mark.parametrize("kind", BLANKS)
def test_a_million_blanks_have_the_ids_of_the_library(kind):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.make_encoder(packing.tokenizer_path())
    run = (BLANKS[kind] * 1_100_000)[:1_100_000]
    for text in (run, f"some words {run}and more", f"<|endoftext|>{run}", f"a{run[:packing.LONG_BLANK - 1]}b", f"a{run[:packing.LONG_BLANK]}b"):
        assert encode([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_packing_a_million_blanks(spark):
    df = spark.createDataFrame([(1, "\n" * 1_200_000), (2, "x"), (3, "a" + " " * 1_200_000 + "b")], "doc_id bigint, text string")
    pieces = packing.packed(df, with_ids=True).collect()
    encode = packing.make_encoder(packing.tokenizer_path())
    for r in df.collect():
        mine = sorted((p for p in pieces if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert [i for p in mine for i in np.frombuffer(p["ids"], "<u2").tolist()] == [*encode([r["text"]])[0], packing.END_ID]


HARD = "doc_id bigint, text string, source string, at timestamp, day date, money decimal(20,9), m map<string, int>, s struct<a: string, b: string>"


def hard_rows():
    t = dt.datetime(2024, 1, 1, 0, 0, 0, 5)
    base = dict(at=t, day=dt.date(2024, 1, 1), money=Decimal("1.000000001"), m={"a": 1}, s=("x", None))
    more = [{}, {"at": t.replace(microsecond=6)}, {"day": dt.date(2024, 1, 2)}, {"money": Decimal("1.000000002")}, {"m": {"a": None}}, {"m": {}}, {"s": (None, "x")}, {"m": None}]
    rows = [(1, "a few words", "s", *(base | x).values()) for x in more]
    return rows + [rows[0]]


@pytest.mark.parametrize("written", [True, False])
@pytest.mark.parametrize("collide", [True, False])
def test_every_row_of_the_mix_is_its_own(spark, monkeypatch, tmp_path, written, collide):
    """One source, so each row is taken once, whatever its hash."""
    if collide:
        monkeypatch.setattr(mixing, "row_hash", lambda df: F.lit("0" * 32))
    df = spark.createDataFrame(hard_rows(), HARD)
    if written:
        df.repartition(2).write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    assert common._is_scan(df) == written
    assert Counter(map(repr, mixing.emitted(df).collect())) == Counter(map(repr, df.collect()))


def test_rows_that_are_made_of_one_file_row_are_not_taken_for_it(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "s"), (2, "c d", "s")], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    assert not common._is_scan(df)
    assert Counter(map(repr, mixing.emitted(df).collect())) == Counter(map(repr, df.collect()))


def test_hashes_of_rows_differ_by_microseconds(spark):
    df = spark.createDataFrame(hard_rows(), HARD)
    assert df.select(common.row_hash(df)).distinct().count() == 8


def test_a_text_beyond_the_bound_leaves_the_others(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["awful", "bad"] if i % 2 else ["fine", "good"]) + str(rng.randrange(9)) for _ in range(40)), "en") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    plain = toxicity.sample(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels, "doc_id", "text", "lang", 2500, 100_000, 7)
    sizes = Counter(r["toxic"] for r in plain)
    first = min((r for r in plain if r["toxic"] == 1), key=lambda r: r["_at"])["_own"]
    huge = [(i, "x " * 30_000 if i == first else t, lang) for i, t, lang in rows]
    df = spark.createDataFrame(huge, "doc_id bigint, text string, lang string")
    left = toxicity.sample(df, labels, "doc_id", "text", "lang", 2500, 100_000, 7)
    assert Counter(r["toxic"] for r in left)[1] >= sizes[1] - 1 > 50 and first not in {r["_own"] for r in left}
    for y in (0, 1):
        assert sum(len(r["text"].encode()) for r in left if r["toxic"] == y) <= 50_000
