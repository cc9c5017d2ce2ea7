"""SimHash near-duplicates linked through sharded BK-trees.

A fingerprint of 64 bits is taken from the XXH64 values (seed 42) of the
document's lower-cased word shingles. Two fingerprints are linked if at most
`radius` bits differ. The fingerprints are dealt into shards such that linked
ones meet in at least one: of `blocks` bit blocks at most `radius` can hold a
difference, so the values of some `blocks - radius` blocks agree, and each such
choice of blocks with its values is a shard. In a shard a BK-tree, whose
children are keyed by integer Hamming distance to the parent, answers each
member's radius query, following only the edges within the radius.

A shard of more than SHARD_MOST members is dealt again by the bits that its choice
leaves free: cut into `radius + 1` blocks, one of them agrees. So a member of a hot
shard is copied `radius + 1` times for each time, however many members there are, and
no task holds a large tree. The trees are not broadcast, as nothing bounds their
number; neither they nor the links reach the driver.

Nulls, ties and the like: a null or wordless text has fingerprint zero, which
links like any other; texts with fewer words than a shingle are hashed whole, very
long ones whole too; rows with a null id get a fingerprint and the component of their
fingerprint class, but never name a component; rows that repeat, or share an id, have
the component of their own text's fingerprint; an empty table gives an empty one;
columns of clashing names keep their values.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import each_bytes, free_name, new_column, row_hash, write_table
from scrivane.llm.components import connected_components
from scrivane.llm.words import LOWER, word_spans

SEED = 42
BITS = 64
#: Members of a shard's tree; fuller shards are dealt again.
SHARD_MOST = 4096
#: Free bits below which a shard is not dealt again: its members are few enough by then.
LEAST_FREE = 12
#: Expected members of a shard beyond which longer keys (more blocks) are used.
SHARD_MEMBERS = 256


def fingerprint(data: np.ndarray, shingle: int = 3) -> int:
    """SimHash of one text's bytes, as a signed 64-bit integer."""
    low = LOWER[data]
    starts, ends = word_spans(low)
    n = len(starts)
    if not n:
        return 0
    lengths = ends - starts
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(lengths + 1, out=begin[1:])
    joined = b" ".join(low.tobytes().split())
    k = min(shingle, n)
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(joined[a:b], SEED) for a, b in zip(begin[: n - k + 1].tolist(), (begin[k:] - 1).tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", shingle: int = 3) -> DataFrame:
    """docs with a bigint fingerprint column, whose name may not be taken yet."""
    new_column(docs, out)

    @F.arrow_udf("bigint")
    def fingerprints(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x, shingle) for x in each_bytes(column)], pa.int64())

    return docs.withColumn(out, fingerprints(F.col(text)))


class BKTree:
    """Fingerprints under their integer Hamming distance to their parent."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, children = self.values, self.children
        values.append(value)
        children.append({})
        at, new = 0, len(values) - 1
        while new:
            d = (value ^ values[at]).bit_count()
            below = children[at].get(d)
            if below is None:
                children[at][d] = new
                return
            at = below

    def near(self, value: int) -> list[int]:
        """Indices of all members within the radius."""
        values, children, r = self.values, self.children, self.radius
        found, stack = [], [0] if values else []
        while stack:
            at = stack.pop()
            d = (value ^ values[at]).bit_count()
            if d <= r:
                found.append(at)
            edges = children[at]
            if edges:
                if len(edges) <= 2 * r + 1:
                    stack.extend(c for e, c in edges.items() if d - r <= e <= d + r)
                else:
                    stack.extend(edges[e] for e in range(d - r, d + r + 1) if e in edges)
        return found


def shard_keys(radius: int, fingerprints: int) -> list[tuple[int, ...]]:
    """Bit masks' blocks for each shard family: the fewest families whose shards are small enough, exact for any number."""
    for blocks in range(radius + 1, 2 * radius + 2):
        kept = blocks - radius
        bits = BITS * kept // blocks
        if fingerprints >> bits <= SHARD_MEMBERS or blocks == 2 * radius + 1:
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), kept)]


def finer(mask: int, parts: int) -> list[int]:
    """mask with one of `parts` blocks of its free bits each; bits of a block lie apart, as neighbours may vary together."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i::parts]) for i in range(parts)]


def _linker(radius: int):
    """Rows of a shard stand together: build its tree, ask it, and return a spanning forest of the links."""

    def link(batches):
        group: list[tuple[int, int]] = []
        last = None
        us: list[int] = []
        vs: list[int] = []

        def finish():
            tree = BKTree(radius)
            parent = list(range(len(group)))

            def root(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            # Each member asks for those before it, so each pair is met once.
            for i, (fp, _) in enumerate(group):
                for j in tree.near(fp):
                    a, b = root(i), root(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                tree.add(fp)
            for i, (_, rep) in enumerate(group):
                j = root(i)
                if j != i:
                    us.append(rep)
                    vs.append(group[j][1])

        for batch in batches:
            for mask, key, fp, rep in zip(*(c.to_pylist() for c in batch.columns)):
                if (mask, key) != last:
                    if len(group) > 1:
                        finish()
                    group, last = [], (mask, key)
                group.append((fp & 0xFFFFFFFFFFFFFFFF, rep))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us.clear()
                vs.clear()
        if len(group) > 1:
            finish()
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return link


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp, rep) for each of the masks."""
    shard = lambda m: F.struct(F.lit(_signed(m)).cast("bigint").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")).alias("key"))
    return rows.select("fp", "rep", F.explode(F.array(*map(shard, masks))).alias("s")).select("s.mask", "s.key", "fp", "rep")


def fingerprint_links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) between the class representatives: a spanning forest of each shard's links.

    classes: one row per distinct fingerprint, (fp bigint, rep bigint).
    """
    linked = None
    masks = shard_keys(radius, classes.count())
    rows = _dealt(classes.select("fp", "rep"), masks)
    while True:
        sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        sized = write_table(rows.join(sizes, ["mask", "key"]), "shards")
        final = BITS - masks[0].bit_count() <= LEAST_FREE
        small = sized if final else sized.where(F.col("members") <= SHARD_MOST)
        links = small.select("mask", "key", "fp", "rep").repartition("mask", "key").sortWithinPartitions("mask", "key", "rep").mapInArrow(_linker(radius), "u bigint, v bigint")
        linked = links if linked is None else linked.union(links)
        large = sized.where(F.col("members") > SHARD_MOST)
        if final or not (hot := [r[0] & 0xFFFFFFFFFFFFFFFF for r in large.select("mask").distinct().collect()]):  # one number for each mask
            return linked
        later = [finer(m, radius + 1) for m in hot]
        parts = [_dealt(large.where(F.col("mask") == F.lit(_signed(m)).cast("bigint")).select("fp", "rep"), more) for m, more in zip(hot, later)]
        rows, masks = parts[0], later[0]
        for part in parts[1:]:
            rows = rows.union(part)
        rows = rows.distinct()  # masks of different choices may be alike


def placed(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(id, t, fp, part, component_id) for every row of docs; t is the text's hash, part tells components apart."""
    named = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), F.col(text).alias("text"))
    prints = write_table(with_fingerprints(named, "text", "fp", shingle).select("id", "t", "fp"), "fingerprints")
    classes = write_table(prints.groupBy("fp").agg(F.min("id").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    roots = connected_components(fingerprint_links(classes.where("least is not null"), radius))
    parted = classes.join(roots, classes.rep == roots.node, "left").select("fp", "least", F.coalesce("root", "rep").alias("part"))
    named = parted.join(parted.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "part", "component_id")
    return prints.join(named, "fp").select("id", "t", "fp", "part", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """(id, fingerprint 16 hex digits, component_id) for every row of docs."""
    found = placed(docs, id, text, radius, shingle)
    return found.select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, least: float | None = None) -> DataFrame:
    """docs without the near-duplicates: of each component one row stays, all columns as they were.

    With `least`, a link also needs that Jaccard similarity of the shingles, and the
    shards follow it, as bit blocks cannot serve a wide radius (see `jaccard`). Of a
    component the row of the smallest id stays; of several such rows that of the
    smallest text hash, then of the smallest hash of all columns. Rows with a null id
    stay.
    """
    if least is None:
        found = placed(docs, id, text, radius, shingle)
    else:
        from scrivane.llm import jaccard

        found = jaccard.placed(docs, id, text, least, shingle, radius)
    return one_of_each(docs, found, id, text)


def one_of_each(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """docs with one row of each component of found (id, t, part) and the rows with a null id."""
    first = found.where("id is not null").groupBy("part").agg(F.min(F.struct("id", "t")).alias("first")).select("first.*")
    i, t, h = (free_name(docs, n) for n in ("_one_id", "_one_t", "_one_row"))
    kept = write_table(first.select(F.col("id").alias(i), F.col("t").alias(t)).distinct(), "kept")
    keyed = docs.withColumns({i: F.col(id).cast("bigint"), t: F.xxhash64(F.coalesce(F.col(text), F.lit(""))), h: row_hash(docs)})
    rows = kept.join(keyed.select(i, t, h), [i, t]).groupBy(i, t).agg(F.min(h).alias(h))
    # Merge joins at every size: texts are dealt the same way whether few or many rows are kept. Rows alike in all columns are one.
    out = keyed.join(rows.hint("merge"), [i, t, h], "left_semi").dropDuplicates([i, t, h])
    return out.select(docs.columns).unionByName(docs.where(F.col(id).isNull()))
