"""Training-order materialisation: a keyed permutation of packed sequences, written as fixed-stride shards.

A balanced Feistel network over the smallest even power of two that holds all
sequences, walked along its cycles until it lands among them, gives each sequence its
global slot. Pieces of sequences go once through a range partitioning by shard, are
put together in slot order, and each shard is written as one file of records of the
same stride: the ids, little-endian, padded with `pad_id`, and one byte 10. Slot s is
record s mod `per_shard` of shard s div `per_shard`, so a reader resumes anywhere by a
seek. Shards are committed by Spark's writer, so a lost executor's shard is written
anew. A sequence whose pieces do not fill it ends the job instead of being padded.

A task writes one shard after another, TASK_BYTES of them, so tasks do not grow with
the number of shards; a small corpus is dealt over as many tasks as shuffles have.

An empty table has no sequences and no shards; a null text is the end id alone; very
long texts take many sequences; rows that repeat are sequences' pieces of their own;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.llm.common import new_path
from scrivane.llm.packing import LENGTH, token_table, with_offsets
from scrivane.llm.words import mix

KEY, ROUNDS = 20240229, 6
#: Sequences of a shard (32 MB of 16-bit ids at 2048). A shard is read back as a whole, so this bounds a reader's memory.
PER_SHARD = 8192
#: Bytes that one task writes, in shards.
TASK_BYTES = 256 << 20
END = b"\n"


@dataclass(frozen=True)
class Feistel:
    """A keyed permutation of range(n)."""

    n: int
    key: int = KEY

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> np.ndarray:
        return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.key))

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for k in self._keys()[:: -1 if back else 1]:
            if back:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        return (left << h) | right

    def apply(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """Slots of sequences, or sequences of slots."""
        out = self._pass(x.astype(np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._pass(out[far], back)
        return out.astype(np.int64)


def _pieces(length: int, wide: bool, order: Feistel):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            firsts, blobs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sequences, offsets, parts, size = [], [], [], 0

            def flush():
                slots = order.apply(np.array(sequences, np.int64))
                return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(offsets, pa.int32()), pa.array(parts, pa.binary())], ["slot", "offset", "ids"])

            for g, blob in zip(firsts, blobs):
                values, at = np.frombuffer(blob, kind), 0
                while at < len(values):
                    n = min(len(values) - at, length - g % length)
                    parts.append(pack.compress(values[at : at + n].tobytes()))
                    sequences.append(g // length)
                    offsets.append(g % length)
                    size += len(parts[-1])
                    at, g = at + n, g + n
                if size > 4 << 20:
                    yield flush()
                    sequences, offsets, parts, size = [], [], [], 0
            if parts:
                yield flush()

    return run


def _records(length: int, wide: bool, per_shard: int, pad_id: int, total: int, order: Feistel):
    kind = np.dtype("<u4" if wide else "<u2")
    pad = np.full(length, pad_id, kind).tobytes()

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        slot, parts, done = None, [], []

        def record():
            body = b"".join(parts)
            return slot, len(body), body + pad[len(body) :]

        def flush():
            slots, sizes, bodies = zip(*done)
            done.clear()
            want = np.minimum(total - order.apply(np.array(slots, np.int64), back=True) * length, length) * kind.itemsize
            if (short := np.flatnonzero(want != np.array(sizes))).size:
                raise ValueError(f"the sequence of slot {slots[short[0]]} is not whole")
            return pa.RecordBatch.from_arrays([pa.array([s // per_shard for s in slots], pa.int64()), pa.array(slots, pa.int64()), pa.array(bodies, pa.binary())], ["shard", "slot", "record"])

        for batch in batches:
            for s, offset, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if s != slot:
                    if parts:
                        done.append(record())
                        if len(done) >= 512:
                            yield flush()
                    slot, parts = s, []
                if offset * kind.itemsize != sum(map(len, parts)):
                    raise ValueError(f"a piece of slot {s} is missing before {offset}")
                parts.append(unpack.decompress(blob))
        if parts:
            done.append(record())
        if done:
            yield flush()

    return run


@dataclass(frozen=True)
class Materialised:
    path: str
    sequences: int
    tokens: int
    length: int
    id_bytes: int
    per_shard: int
    order: Feistel

    @property
    def stride(self) -> int:
        return self.length * self.id_bytes + len(END)


def materialise(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, pad_id: int = 0, path: str | None = None, tokenizer: str | None = None) -> Materialised:
    """Write the shards of a table of documents under path (by default in the shared folder)."""
    spark = docs.sparkSession
    tokens, wide = token_table(docs, id, text, tokenizer)
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    n = -(-total // length)
    out = Materialised(path or new_path(spark, "shards"), n, total, length, 4 if wide else 2, per_shard, Feistel(n, key))
    pieces = with_offsets(tokens).select("g", "ids").mapInArrow(_pieces(length, wide, out.order), "slot bigint, offset int, ids binary")
    shards = max(1, -(-n // per_shard))
    by_shard = pieces.withColumn("shard", F.expr(f"slot div {per_shard}"))
    tasks = min(shards, max(-(-n * out.stride // TASK_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-shards // tasks)
    dealt = by_shard.repartitionById(-(-shards // each), F.expr(f"shard div {each}").cast("int"))  # ranges of slots, without sampling
    made = _records(length, wide, per_shard, pad_id, total, out.order)
    rows = dealt.sortWithinPartitions("shard", "slot", "offset").select("slot", "offset", "ids").mapInArrow(made, "shard bigint, slot bigint, record binary")
    # The text writer puts a string's bytes down as they are: records of one stride, committed by Spark.
    rows.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", END.decode()).text(out.path)
    return out


def _reader(made: Materialised, first_slot: int, digest: bool):
    stride, length, per_shard, order, total = made.stride, made.length, made.per_shard, made.order, made.tokens
    kind = np.dtype("<u4" if made.id_bytes == 4 else "<u2")

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                if len(data) % stride:
                    raise ValueError(f"shard {shard} is not whole")
                view = np.frombuffer(data, np.uint8).reshape(-1, stride)
                if (view[:, -1] != END[0]).any():
                    raise ValueError(f"shard {shard} is off its stride")
                rows = np.arange(max(0, first_slot - shard * per_shard), len(view), dtype=np.int64)
                slots = shard * per_shard + rows
                sequences = order.apply(slots, back=True)
                counts = np.minimum(total - sequences * length, length)
                ids = (view[i, :-1].view(kind)[:n] for i, n in zip(rows.tolist(), counts.tolist()))
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.tobytes() for x in ids], pa.binary())
                names = ["slot", "shard", "row", "sequence_id", "n_tokens", "ids_crc32" if digest else "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(rows), shard, np.int64)), pa.array(rows), pa.array(sequences), pa.array(counts), last], names)

    return run


def read_shards(spark: SparkSession, made: Materialised, first_slot: int = 0, digest: bool = False) -> DataFrame:
    """(slot, shard, row, sequence_id, n_tokens, ids) from first_slot on, read back from the shard files.

    ids are the sequence's own, little-endian; with `digest` their checksum as
    unsigned 32-bit ids stands instead (ids_crc32).
    """
    schema = "slot bigint, shard bigint, row bigint, sequence_id bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest else "ids binary")
    if not made.sequences:  # nothing was written
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary, shard bigint").load(made.path)
    return files.where(F.col("shard") >= first_slot // made.per_shard).select("shard", "content").mapInArrow(_reader(made, first_slot, digest), schema)
