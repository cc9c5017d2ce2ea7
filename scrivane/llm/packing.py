"""Packing by concatenating and cutting.

Pass one tokenises each partition and writes its documents' ids with their start
inside the partition. One total per partition is prefix-summed, which gives every
document its global offset; pass two cuts at the multiples of the sequence length
without moving any token. Only the last sequence is not full.

Ids are those that `tokenizers` gives for the vocabulary file, so a special token's
string in a text is that token. A null or empty text is the end id alone; very long
texts are cut like others; rows that repeat are packed one by one; an empty table gives
no pieces; a null id is carried along; other columns are not read, so their names
cannot clash. The numbers of sequences follow the order in which the table is read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.common import write_table

LENGTH = 2048
END_ID = 1
#: Input partitions whose first places are broadcast.
MOST_BASES = 2_000_000
#: Blanks in a row from which a text goes to `tokenizers`, as the pattern of the faster library overflows its stack on some million.
LONG_BLANK = 50_000
_BLANKS = re.compile(r"\s+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def has_long_blank(text: str) -> bool:
    return len(text) >= LONG_BLANK and any(m.end() - m.start() >= LONG_BLANK for m in _BLANKS.finditer(text))


def make_encoder(path: str):
    """Texts to lists of ids: the ids of the `tokenizers` file at path.

    Where the same vocabulary lies beside it as ranks, the faster library reads that, for
    all texts but those with a blank run of LONG_BLANK; the file's special tokens are its
    own too. Both give the same ids, so it does not matter for them whether the ranks are there.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(ranks_path):
        return lambda texts: [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in plain.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids_of(text: str) -> list[int]:
        if has_long_blank(text):
            return plain.encode(text, add_special_tokens=False).ids
        # A text without a special token's string is spared the search for them; the ids are the same.
        return fast.encode(text, allowed_special="all") if any(s in text for s in special) else fast.encode_ordinary(text)

    return lambda texts: [ids_of(t) for t in texts]


def _tokenise(path: str, end_id: int, wide: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        encode = make_encoder(path)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                encoded = encode([t or "" for t in piece.column(1).to_pylist()])
                starts, blobs = [], []
                for ids in encoded:
                    ids.append(end_id)
                    starts.append(at)
                    at += len(ids)
                    blobs.append(np.array(ids, kind).tobytes())
                n = len(blobs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), piece.column(0), pa.array(starts, pa.int64()), pa.array([len(x) for x in encoded], pa.int64()), pa.array(blobs, pa.binary())],
                    ["part", "id", "part_start", "doc_tokens", "ids"],
                )

    return run


def _cut(length: int, wide: bool, with_ids: bool):
    kind = np.dtype("<u4" if wide else "<u2")

    def run(batches):
        for batch in batches:
            ids, firsts, totals, blobs = (c.to_pylist() for c in batch.columns)
            held, size = [[] for _ in range(8)], 0
            for doc, g, total, blob in zip(ids, firsts, totals, blobs):
                values, start = np.frombuffer(blob, kind), 0
                while start < total:
                    n = min(total - start, length - g % length)
                    part = values[start : start + n]
                    row = (doc, start, n, zlib.crc32(part.astype("<u4").tobytes()), total, g // length, g % length, part.tobytes() if with_ids else None)
                    for x, y in zip(held, row):
                        x.append(y)
                    size += n if with_ids else 0
                    start += n
                    g += n
                if size > 2 << 20 or len(held[0]) >= 10_000:
                    yield _pieces(held)
                    held, size = [[] for _ in range(8)], 0
            if held[0]:
                yield _pieces(held)

    def _pieces(held):
        arrays = [pa.array(x, pa.int64()) for x in held[:7]]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array(held[7], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_table(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, bool]:
    """Pass one: (part, id, part_start, doc_tokens, ids), written, and whether an id takes 32 bits (16 up to a vocabulary of 65,536)."""
    from tokenizers import Tokenizer

    path = path or tokenizer_path()
    wide = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) > 1 << 16
    source = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = source.mapInArrow(_tokenise(path, end_id, wide), "part int, id bigint, part_start bigint, doc_tokens bigint, ids binary")
    return write_table(rows, "tokens", **{"parquet.compression.codec.zstd.level": "6"}), wide


def with_offsets(tokens: DataFrame) -> DataFrame:
    """(id, g, doc_tokens, ids): g is the document's first place in the whole concatenation."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    bases = write_table(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    # One row of 12 bytes per input partition: broadcast up to 24 MB, joined by part beyond.
    return tokens.join(F.broadcast(bases) if bases.count() <= MOST_BASES else bases, "part").select("id", (F.col("base") + F.col("part_start")).alias("g"), "doc_tokens", "ids")


def packed(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and on request the ids (little-endian)."""
    tokens, wide = token_table(docs, id, text, path, end_id)
    schema = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    return with_offsets(tokens).mapInArrow(_cut(length, wide, with_ids), schema).withColumnRenamed("id", id)


def boundaries(pieces: DataFrame, id: str = "doc_id") -> DataFrame:
    """The boundary records of each sequence: where which document begins in it, and the tokens it holds; at most `length` of them."""
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", F.col(id).alias("doc"), "start", "length"))).alias("boundaries"),
    )
