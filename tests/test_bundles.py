"""Archives as a data source: batch, pushed filters, stream, publication and failed writes."""

import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from scrivane.sources import bundles


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    bundles.register(spark)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.zip").write_bytes(packed({"x/one.txt": "1", "two.HTML": "<p>2", "big.bin": "b" * 5000, "none": ""}))
    (tmp_path / "in" / "deep" / "b.zip").write_bytes(packed({"three.txt": "3é"}))
    (tmp_path / "in" / "bad.zip").write_bytes(b"PK no archive")
    (tmp_path / "in" / "note.txt").write_text("no archive")
    return str(tmp_path / "in")


def test_members_are_rows(spark, folder):
    rows = {(os.path.basename(r["archive"]), r["member"]): r for r in spark.read.format("archives").option("maxMember", 1000).load(folder).collect()}
    assert set(rows) == {("a.zip", "x/one.txt"), ("a.zip", "two.HTML"), ("a.zip", "big.bin"), ("a.zip", "none"), ("b.zip", "three.txt"), ("bad.zip", None)}
    assert rows["b.zip", "three.txt"]["content"] == "3é".encode() and rows["a.zip", "two.HTML"]["kind"] == "html" and rows["a.zip", "none"]["kind"] == ""
    assert rows["a.zip", "big.bin"]["error"] == "too large" and rows["a.zip", "big.bin"]["content"] is None and rows["bad.zip", None]["error"].startswith("no archive")
    assert spark.read.format("archives").load(f"file://{folder}").count() == 6


def test_filters_leave_members_unread(spark, folder):
    df = spark.read.format("archives").load(folder)
    found = df.where("kind = 'txt' AND size <= 2 AND length(content) > 0").select("member")
    assert {r[0] for r in found.collect()} == {"x/one.txt"}
    reader = bundles.ArchiveReader({"path": folder})
    left = list(reader.pushFilters([bundles.EqualTo(("kind",), "txt"), bundles.StringEndsWith(("member",), "three.txt"), bundles.EqualTo(("sha256",), "x")]))
    assert [f.attribute for f in left] == [("sha256",)]
    assert [p.names for p in reader.partitions()] == [["three.txt"]]
    assert df.where("member is null").count() == 1 and df.where("kind in ('txt', 'html')").count() == 3 and df.where("kind = 'nothing'").count() == 0


def test_an_archive_is_read_by_several_tasks(spark, folder):
    df = spark.read.format("archives").option("partBytes", 1).load(folder)
    assert df.rdd.getNumPartitions() == 6 and df.count() == 6


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    def run():
        q = spark.readStream.format("archives").load(folder).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((os.path.basename(r["archive"]), r["member"] or "") for r in spark.read.schema(bundles.SCHEMA).parquet(str(tmp_path / "out")).collect())

    first = run()
    assert len(first) == 6
    time.sleep(0.02)
    with open(f"{folder}/c.zip", "wb") as f:
        f.write(packed({"new.txt": "n"}))
    assert run() == sorted([*first, ("c.zip", "new.txt")])
    assert run() == sorted([*first, ("c.zip", "new.txt")])


def test_a_bundle_is_published_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "bundles")
    df = spark.range(100).repartition(4).select(F.format_string("d%03d.txt", "id").alias("member"), F.encode(F.concat(F.lit("text é "), "id"), "utf-8").alias("content"))
    df.write.format("archives").mode("append").option("version", "7").save(out)
    got = spark.read.format("archives").load(out).select("member", F.col("content").cast("string").alias("t"), "sha256", F.sha2("content", 256).alias("again")).collect()
    assert {(r[0], r[1]) for r in got} == {(f"d{i:03d}.txt", f"text é {i}") for i in range(100)} and all(r[2] == r[3] for r in got)
    with open(f"{out}/version=7/manifest.json") as f:
        manifest = json.load(f)
    assert manifest["members"] == 100 and manifest["archives"] == sorted(x for x in os.listdir(f"{out}/version=7") if x.endswith(".zip"))
    assert os.listdir(f"{out}/_staging") == []
    with pytest.raises(Exception, match="published already"):
        df.write.format("archives").mode("append").option("version", "7").save(out)


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    out = str(tmp_path / "bundles")
    bad = spark.range(40).repartition(4).select(F.col("id").cast("string").alias("member"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception):
        bad.write.format("archives").mode("append").option("version", "1").save(out)
    assert spark.read.format("archives").load(out).count() == 0
    assert not os.path.exists(f"{out}/version=1/manifest.json") and not any(os.scandir(f"{out}/_staging"))


def test_staged_and_unpublished_archives_are_not_seen(spark, folder):
    for place in ("_staging/j", "version=3"):
        os.makedirs(f"{folder}/{place}")
        with open(f"{folder}/{place}/p.zip", "wb") as f:
            f.write(packed({"p": "p"}))
    assert spark.read.format("archives").load(folder).where("member = 'p'").count() == 0
    with open(f"{folder}/version=3/manifest.json", "w") as f:
        f.write("{}")
    assert spark.read.format("archives").load(folder).where("member = 'p'").count() == 1
