"""How quality filters interact: what each removes alone, after others, and on average over all orders.

Each batch of texts is scanned in its Arrow buffers: a table of byte classes and prefix
sums give every document's words, capitals, symbols and code points, and the sorted
hashes of its words, whose neighbours are compared byte by byte, its distinct words. A
document then is five bits, one for each filter it fails; everything else is counted
by part and bits, 32 numbers a part, from which all orders of the filters follow by
one matrix product.

    A  under LEAST_WORDS words
    B  DISTINCT percent of its words or fewer are distinct (100 * distinct < DISTINCT * words)
    C  more than CAPITALS percent of its code points are A-Z
    D  holds one of the symbols #$%&*|
    E  its text is that of a smaller id, anywhere in the table

Nulls and the like: a null text is an empty one, a null part the empty string; a row
with a null id neither fails E nor makes another fail it, and has no labels; rows of one
id and text are not copies of a smaller id; of several labels of an id any 1 counts; a
very long text is scanned whole, in pieces cut between words; repeated rows count one
by one; an empty table has no parts; other columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import byte_views, spread_join, write_table
from scrivane.llm.words import SEPARATORS, eights, grouped_words, word_hashes

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT, CAPITALS = 50, 65, 5
SYMBOLS = b"#$%&*|"
#: Bytes of text that are scanned at once.
SLICE = 2 << 20

_SPACE, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(SEPARATORS)] = _SPACE
_CLASS[65:91] = _CAPITAL
_CLASS[list(SYMBOLS)] = _SYMBOL
_CLASS[128:192] = _INNER


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Set flags between neighbouring offsets."""
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return np.diff(before[offsets])


def _spans(space: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes where words start, and the words' ends; no word goes beyond its document."""
    word = ~space
    edges = offsets[:-1][np.diff(offsets) > 0]
    start, last = word.copy(), word.copy()
    start[1:] &= space[:-1]
    start[edges] = word[edges]
    last[:-1] &= space[1:]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    last[ends] = word[ends]
    return start, np.flatnonzero(last) + 1


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and points of each document between the offsets of data."""
    kinds = _CLASS[data]
    start, ends = _spans(kinds == _SPACE, offsets)
    starts = np.flatnonzero(start)
    words = _sums(start, offsets)
    owner = np.repeat(np.arange(len(words)), words)
    view, lengths = eights(data), ends - starts
    # The document above, 40 bits of the word's hash below: one sort brings the equal words of each document together.
    keys = (owner.astype(np.uint64) << np.uint64(40)) | (word_hashes(view, data, starts, lengths) >> np.uint64(24))
    order, first, clash = grouped_words(keys, view, data, starts, lengths)
    distinct = np.bincount(owner[order[first]], minlength=len(words))
    for d in set(owner[clash].tolist()):  # two words of one hash: this document's are told apart by their bytes
        mine = np.flatnonzero(owner == d).tolist()
        distinct[d] = len({data[starts[i] : ends[i]].tobytes() for i in mine})
    return {
        "words": words, "distinct": distinct, "capitals": _sums(kinds == _CAPITAL, offsets),
        "symbols": _sums(kinds == _SYMBOL, offsets), "points": _sums(kinds != _INNER, offsets),
    }


def scan_long(data: np.ndarray) -> dict[str, np.ndarray]:
    """The same of one document, in pieces that end between words; a word that is longer than a piece stays whole."""
    total, seen, lo = dict.fromkeys(("words", "capitals", "symbols", "points"), 0), set(), 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE)
        while hi < len(data):  # on to the end of the word
            more = np.flatnonzero(_CLASS[data[hi : hi + SLICE]] == _SPACE)
            hi = hi + int(more[0]) if len(more) else min(len(data), hi + SLICE)
            if len(more):
                break
        piece = data[lo:hi]
        for k, v in scan(piece, np.array([0, len(piece)])).items():
            if k in total:
                total[k] += int(v[0])
        seen.update(piece.tobytes().translate(bytes(32 if c in SEPARATORS else c for c in range(256))).split(b" "))
        lo = hi
    return {k: np.array([v]) for k, v in total.items()} | {"distinct": np.array([len(seen - {b""})])}


def failures(s: dict[str, np.ndarray]) -> np.ndarray:
    """The bits of the filters A to D."""
    return (
        (s["words"] < LEAST_WORDS).astype(np.int32) | (100 * s["distinct"] < DISTINCT * s["words"]).astype(np.int32) << 1
        | (100 * s["capitals"] > CAPITALS * s["points"]).astype(np.int32) << 2 | (s["symbols"] > 0).astype(np.int32) << 3
    )


def _slices(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about SLICE bytes; one that is longer stands alone."""
    out, lo = [], 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _scanned(batches):
    for batch in batches:
        data, offsets = byte_views(batch.column(2))
        bits, digests = [], []
        for lo, hi in _slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            own = data[a:b]
            bits.append(failures(scan_long(own) if hi == lo + 1 and b - a > 2 * SLICE else scan(own, offsets[lo : hi + 1] - a)))
        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            digests.append(hashlib.sha256(data[x:y]).digest())
        found = np.concatenate(bits) if bits else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "bits", "digest"])


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, bits of A to D, digest of the text), written."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    return write_table(rows.mapInArrow(_scanned, f"id {kind}, part string, bits int, digest binary"), "scanned")


def failed(docs: DataFrame, labels: DataFrame | None = None, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, bits of A to E, good, toxic) of every row."""
    rows = scanned(docs, id, text, part)
    ids = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    copies = ids.where(F.col("most") > F.col("least")).select("digest", "least")
    told = spread_join(rows, copies, ["digest"], "left", rows)
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    told = told.withColumn("bits", F.col("bits").bitwiseOR(F.when(late, F.lit(16)).otherwise(F.lit(0)))).drop("digest", "least")
    if labels is None:
        return told.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    known = labels.groupBy(F.col(id).alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    return spread_join(told, known, ["id"], "left", rows).fillna(0, ["good", "toxic"])


def order_table() -> tuple[list[tuple[str, int]], dict[str, np.ndarray], np.ndarray]:
    """The 600 (order, step), the 0/1 matrices (600, 32) that give their counts, and the filter (0 to 4) of each step."""
    bits = np.arange(32)
    steps, kept, removed, redundant, alone, letter = [], [], [], [], [], []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for k, f in enumerate(order):
            own = 1 << FILTERS.index(f)
            steps.append((order, k + 1))
            removed.append((bits & own > 0) & (bits & before == 0))
            redundant.append((bits & own > 0) & (bits & before > 0))
            kept.append(bits & (before | own) == 0)
            alone.append(bits == own)
            letter.append(FILTERS.index(f))
            before |= own
    return steps, {n: np.array(m, np.int64) for n, m in (("kept", kept), ("removed", removed), ("redundant", redundant), ("unique_fails", alone))}, np.array(letter)


SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def _all_orders(batches):
    steps, masks, letter = order_table()
    for batch in batches:
        for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, good, toxic = np.zeros((3, 32), np.int64)
            for c in cells:
                n[c["bits"]], good[c["bits"]], toxic[c["bits"]] = c["n"], c["good"], c["toxic"]
            out = {k: m @ n for k, m in masks.items()} | {"good_lost": masks["removed"] @ good, "toxic_lost": masks["removed"] @ toxic}
            share = np.array([out["removed"][letter == f].sum() for f in range(len(FILTERS))])[letter]
            columns = [pa.array([part] * len(steps)), pa.array([s[0] for s in steps]), pa.array([s[1] for s in steps], pa.int32())]
            names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[k]) for k in names), pa.array(share)], ["part", "filter_order", "step", *names, "shapley"])


def interactions(docs: DataFrame, labels: DataFrame | None = None, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what stays, goes, went before, fails nothing else, and the filter's removals summed over all orders."""
    cells = failed(docs, labels, id, text, part).groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return parts.mapInArrow(_all_orders, SCHEMA)
