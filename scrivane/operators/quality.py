"""Integrity and parity: multiset scores, coverage, digests, pointers, shingles."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.functions.arrow import arrow_function

RUN, LEAST_RUNS, LEAST_SHARE = 20, 200, 0.5
#: Rows of an id whose texts meet in one place, and ids of more rows that are broadcast.
MOST_TEXTS, MOST_HOT = 1000, 100_000


def bad_digests(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.sha2("text", 256) != F.col("sha256"))


def bad_pointers(chunks: DataFrame, items: DataFrame, id: str) -> DataFrame:
    """References that no item resolves, of rows (id, chunk_id, doc_items) against (id, ref)."""
    return chunks.withColumn("ref", F.explode("doc_items")).join(items, [id, "ref"], "left_anti")


def counted(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each value on both sides, 0 where there is none."""
    na = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    return na.join(nb, keys, "full").fillna(0, ["na", "nb"])


def set_score(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Shared of the larger side as multisets; 1 if both are empty."""
    s = counted(a, b, keys).agg(F.sum(F.least("na", "nb")).alias("both"), F.greatest(F.sum("na"), F.sum("nb")).alias("most"))
    return s.select(F.when(F.coalesce("most", F.lit(0)) == 0, 1.0).otherwise(F.col("both") / F.col("most")).alias("score"))


def coverage(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    s = counted(wanted, have, keys).agg(F.sum(F.least("na", "nb")).alias("both"), F.sum("na").alias("wanted"))
    return s.select(F.when(F.coalesce("wanted", F.lit(0)) == 0, 1.0).otherwise(F.col("both") / F.col("wanted")).alias("coverage"))


def worst_missing(wanted: DataFrame, have: DataFrame, keys: list[str], most: int = 15) -> DataFrame:
    gaps = counted(wanted, have, keys).withColumn("missing", F.col("na") - F.col("nb")).where("missing > 0")
    return gaps.orderBy(F.desc("missing"), *keys).limit(most).select(*keys, "missing")


def squeezed_text(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum())


@arrow_function("string")
def squeezed(text: pa.Array) -> pa.Array:
    """NFKC, case-folded, letters and digits only."""
    return pa.array([None if t is None else squeezed_text(t) for t in text.to_pylist()], pa.string())


def runs(text: Column, length: int = RUN) -> Column:
    """Distinct character runs of a squeezed text."""
    n = F.length(text) - length + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, (i + 1).cast("int"), F.lit(length))))).otherwise(F.array().cast("array<string>"))


def _fingerprints(texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the characters of all texts, each followed by a stop; 64-bit fingerprints of the runs that hold no stop, by place) with places of stops left out."""
    joined = "\0".join(t or "" for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(codes) - length + 1
    if n <= 0:
        return codes, np.zeros((2, 0), np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(length):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    stops = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes == 0, out=stops[1:])
    places = np.flatnonzero(stops[length : length + n] == stops[:n])
    return codes, np.stack([h[places], places.astype(np.uint64)])


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, length: int) -> bool:
    """Whether all the runs of a at `at` are those of b at `bt`, character by character."""
    return all((a[at + j] == b[bt + j]).all() for j in range(length))


def shared_runs(wanted: list[str | None], held: list[str | None], length: int = RUN) -> tuple[int, int]:
    """(distinct runs of the wanted texts, how many of them the held texts have), exact: every two runs of one fingerprint are compared."""
    a, (ha, pa_) = _fingerprints(wanted, length)
    b, (hb, pb) = _fingerprints(held, length)
    own, order = np.unique(ha, return_inverse=True)
    first = np.zeros(len(own), np.int64)
    first[order] = pa_.astype(np.int64)
    theirs, where = np.unique(hb, return_index=True)
    at = np.minimum(np.searchsorted(theirs, own), max(0, len(theirs) - 1))
    hit = theirs[at] == own if len(theirs) else np.zeros(len(own), bool)
    exact = _same(a, first[order], a, pa_.astype(np.int64), length) and (not hit.any() or _same(a, first[hit], b, pb[where[at[hit]]].astype(np.int64), length))
    if exact and len(theirs) < len(hb):
        back = np.searchsorted(theirs, hb)
        exact = _same(b, pb[where[back]].astype(np.int64), b, pb.astype(np.int64), length)
    if not exact:  # different runs of one fingerprint: as sets of strings
        sets = [{t[i : i + length] for t in ts if t for i in range(len(t) - length + 1)} for ts in (wanted, held)]
        return len(sets[0]), len(sets[0] & sets[1])
    return len(own), int(hit.sum())


@arrow_function("struct<runs: bigint, found: bigint>")
def _shares(wanted: pa.Array, held: pa.Array) -> pa.Array:
    counts = [shared_runs(w or [], h or []) for w, h in zip(wanted.to_pylist(), held.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1)], ["runs", "found"])


def printed_share(wanted: DataFrame, held: DataFrame, id: str) -> DataFrame:
    """(id, runs, found, share): runs of each wanted text that the held text of the same id has; ids without a run are left out.

    The texts of an id meet whole, once, and their runs are compared by fingerprints in
    place. Ids of more than MOST_TEXTS rows are compared run by run over all tasks.
    """
    counts = wanted.select(id).unionByName(held.select(id)).groupBy(id).count().where(F.col("count") > MOST_TEXTS).select(id, F.lit(True).alias("_hot"))
    hot = F.broadcast(counts) if counts.count() <= MOST_HOT else counts

    def parted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = texts.select(id, "text").join(hot, id, "left")
        return rows.where("_hot IS NULL").groupBy(id).agg(F.collect_list("text").alias("texts")), rows.where("_hot")

    few_wanted, many_wanted = parted(wanted)
    few_held, many_held = parted(held)
    few = few_wanted.join(few_held.withColumnRenamed("texts", "held"), id, "left").select(id, _shares(F.col("texts"), F.col("held")).alias("s")).select(id, "s.*")
    want = many_wanted.select(id, F.explode(runs(F.col("text"))).alias("run")).distinct()
    have = many_held.select(id, F.explode(runs(F.col("text"))).alias("run"), F.lit(1).alias("hit")).distinct()
    many = want.join(have, [id, "run"], "left").groupBy(id).agg(F.count(F.lit(1)).alias("runs"), F.count("hit").alias("found"))
    return few.where("runs > 0").unionByName(many).withColumn("share", F.col("found") / F.col("runs"))


def low_share(shares: DataFrame) -> DataFrame:
    return shares.where((F.col("runs") >= LEAST_RUNS) & (F.col("share") < LEAST_SHARE))


def snapshot_diff(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing, unexpected or changed."""
    a, b = expected.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")), actual.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state is not null")


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of rows (path, content)."""
    return files.select("path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))
