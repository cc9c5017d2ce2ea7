"""SimHash near-duplicates at a Jaccard similarity of word shingles.

Texts of similarity 0.8 differ in about ten of the 64 bits of their fingerprints,
which is too wide for shards by bit blocks. So the fingerprints are dealt by MinHash:
32 bands of 4 minima each, such that a pair of similarity 0.8 meets in no band with a
chance of 5e-8. In a shard a BK-tree answers each fingerprint's query within the
radius; what it finds and what 128 minima and the BOTTOM least shingles of both do not
rule out is held to the shingle sets themselves, so no link is an estimate.

A large group of near copies is not crossed with itself. In each round a member names
its nearest partners that stand in other components yet, the checked links join the
components, and the next round allows more partners; the last one allows all. A round's
links join the components found so far; links of earlier rounds are not met again.

A shard of more than SHARD_MOST members is dealt again by its next band, up to FINER
times; what is larger still is cut into blocks, and each block's first member also
joins the block before it. Such members agree on 16 minima and more. This joins most
of a large shard's copies soon, but may lose a pair, so what is left of it is searched
whole: its members are put into blocks by their component, and every two blocks that
are not of one component meet in a task of their own. That is quadratic in the members
that are still apart, and in bounded memory.

What can be missed: a pair at the edge of the radius (of those of similarity 0.8 and
more, sampled on the check tables, up to 0.5 percent differ in more than 16 bits). It
usually meets over a third text.

Texts with fewer words than a shingle are one shingle; texts without words are alike;
words are lower-cased in ASCII, as for the fingerprints. Rows of one id with different
texts are different texts; rows that repeat are one. Rows with a null id take no part.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import drop_table, each_bytes, write_table
from scrivane.llm.components import connected_components
from scrivane.llm.simhash import BKTree, fingerprint, keep_one as _keep_one
from scrivane.llm.words import LOWER, digests, mix, run_hashes

BANDS, ROWS = 32, 4
RADIUS = 16
#: Members of a shard's tree, and how often a fuller shard is dealt again.
SHARD_MOST, FINER = 1024, 3
#: Partners that a member names in a shard in each round; None is all.
PARTNERS = (2, 16, None)
#: Least shingle hashes that travel with a text; up to so many shingles they are the whole set.
BOTTOM = 256
#: Standard deviations of an estimate below which a pair is ruled out (a chance of 3e-5).
DOUBT = 4
#: A text that many pairs name is dealt to so many tasks.
SALTS = 16
_SALT, _FACTOR = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of one text's distinct shingles."""
    found = digests(LOWER[data].tobytes().split())[0]
    return np.unique(run_hashes(found, min(size, len(found)))) if len(found) else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def doubtful(least: float, of: int) -> float:
    """The estimate from so many samples below which the similarity is not reached."""
    return least - DOUBT * float(np.sqrt(least * (1 - least) / of))


def may_be_alike(a: np.ndarray, na: int, b: np.ndarray, nb: int, least: float) -> bool:
    """From the least shingles (their upper 32 bits) of two sets and their sizes: near exact for small sets, an estimate for others."""
    if na <= BOTTOM and nb <= BOTTOM:
        return similarity(a, b) >= least - 0.02
    whole = np.union1d(a, b)[:BOTTOM]
    both = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(both, whole[-1], "right") >= doubtful(least, len(whole)) * len(whole)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set; empty sets are given one common shingle."""
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    starts = np.cumsum([0, *map(len, sets[:-1])])
    whole = np.concatenate(sets)
    return np.stack([np.minimum.reduceat((whole ^ salt) * factor, starts) for salt, factor in zip(_SALT, _FACTOR)], axis=1)


def bands_of(least: np.ndarray) -> np.ndarray:
    """A row of band keys for each row of minima."""
    out = np.zeros((len(least), BANDS), np.uint64)
    for i in range(BANDS * ROWS):
        out[:, i // ROWS] = mix(out[:, i // ROWS] + least[:, i] + np.uint64(i + 1))
    return out


def _prints(size: int):
    kind = pa.struct([("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("bottom", pa.binary())])

    @F.arrow_udf("struct<c1: bigint, c2: bigint, n: int, fp: bigint, bands: array<bigint>, sketch: binary, bottom: binary>")
    def prints(column: pa.Array) -> pa.Array:
        out, sets, fps, held = [], [], [], 0

        def finish():
            least = minima(sets)
            short = mix(least).astype(np.uint16)
            for s, fp, keys, sketch in zip(sets, fps, bands_of(least).view(np.int64).tolist(), short):
                c1, c2 = (int(mix(mix(s * np.uint64(k) + np.uint64(k)).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) for k in (1, 3))
                out.append({"c1": c1, "c2": c2, "n": len(s), "fp": fp, "bands": keys, "sketch": sketch.tobytes(), "bottom": (s[:BOTTOM] >> np.uint64(32)).astype(np.uint32).tobytes()})
            sets.clear()
            fps.clear()

        for data in each_bytes(column):
            sets.append(shingles(data, size))
            fps.append(fingerprint(data, size))
            held += len(sets[-1])
            if held > 1 << 17:
                finish()
                held = 0
        if sets:
            finish()
        return pa.array(out, kind)

    return prints


def _rounds(least: float, radius: int, partners: int | None):
    """(u, v): each member's nearest partners, at most so many, in other components of its shard; rows come by shard.

    Rows of two blocks of a larger shard also tell that shard (home) and their block's
    side: 0 is searched by 1, a block by itself has side 2; side 0 comes first.
    """

    def pairs(shard, group):
        sides = None
        if len(group[0]) > 7:
            *group, homes, sides = zip(*group)
            shard, group = homes[0], zip(*group)
        *columns, sketches, bottoms, places = zip(*group)
        nodes, parts, ns, fps = (np.array(c, np.int64) for c in columns)
        if (parts == parts[0]).all():
            return
        # Every pair is met once, in the first shard that both are in.
        width = max(map(len, places))
        shards = np.array([p + p[:1] * (width - len(p)) for p in places], np.int64)
        sketch = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(nodes), -1)
        bottoms = [np.unique(np.frombuffer(b, np.uint32)) for b in bottoms]
        doubt = doubtful(least, sketch.shape[1]) * sketch.shape[1]
        tree = BKTree(radius)
        for i, fp in enumerate(x & 0xFFFFFFFFFFFFFFFF for x in fps.tolist()):
            near = np.array(tree.near(fp) if sides is None or sides[i] else (), np.int64)
            if sides is None or sides[i] != 1:
                tree.add(fp)
            if not len(near):
                continue
            near = near[(parts[near] != parts[i]) & (np.minimum(ns[near], ns[i]) >= least * np.maximum(ns[near], ns[i]))]
            near = near[(sketch[near] == sketch[i]).sum(axis=1) >= doubt]
            if len(near):
                both = shards[near]
                near = near[np.where(np.isin(both, shards[i]), both, np.iinfo(np.int64).max).min(axis=1) == shard]
            if len(near):
                far = np.bitwise_count(fps[near] ^ fps[i])
                named = (j for j in near[np.lexsort((nodes[near], far))].tolist() if may_be_alike(bottoms[j], ns[j], bottoms[i], ns[i], least))
                near = np.fromiter(islice(named, partners), np.int64)
            if len(near):
                yield np.minimum(nodes[near], nodes[i]), np.maximum(nodes[near], nodes[i])

    def run(batches):
        group, last, held = [], None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != last:
                    if len(group) > 1:
                        held.extend(pairs(last, group))
                    group, last = [], shard
                group.append(row)
            if held:
                u, v = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if len(group) > 1:
            held.extend(pairs(last, group))
        if held:
            u, v = (np.concatenate(x) for x in zip(*held))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _shards(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(shard, node): members of shards of two to SHARD_MOST members, and those of the shards that held more at first, if any did."""
    rows = classes.select("node", F.posexplode("bands").alias("band", "shard"))
    done = rest = None
    for again in range(FINER + 1):
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        sized = write_table(rows.join(sizes, "shard"), "buckets")
        small = sized.where(F.col("members") <= SHARD_MOST).select("shard", "node")
        done = small if done is None else done.union(small)
        large = sized.where(F.col("members") > SHARD_MOST).select("node", "band", "shard")
        if large.isEmpty():
            return done, rest
        if not again:
            rest = large.select("shard", "node")
        if again == FINER:
            break
        next_band = F.element_at("bands", F.pmod(F.col("band") + again + 1, F.lit(BANDS)) + 1)
        rows = large.join(classes.select("node", "bands"), "node").select("node", "band", F.xxhash64("shard", next_band).alias("shard"))
    # Blocks of what is larger still: a place by the node's hash, and the first of each block twice.
    blocks = F.ceil(F.col("members") / SHARD_MOST).cast("int")
    cut = sized.where(F.col("members") > SHARD_MOST).select("shard", "node", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    firsts = cut.groupBy("shard", "block").agg(F.min("node").alias("node")).select("shard", (F.col("block") - 1).alias("block"), "node").where("block >= 0")
    return done.union(cut.select("shard", "block", "node").union(firsts).select(F.xxhash64("shard", "block").alias("shard"), "node")), rest


def _block_pairs(rest: DataFrame) -> DataFrame:
    """(shard, node, part, home, side) of rest (shard, node, part): every two blocks of a shard whose members are not all of one component.

    A part of more than half of SHARD_MOST has blocks of its own, the others share blocks.
    """
    half = max(1, SHARD_MOST // 2)
    parts = rest.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") <= half, F.col("n"))
    shards = parts.groupBy("shard").agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum(small), F.lit(0)).alias("few")).where("parts > 1")
    known = parts.join(shards, "shard").select("shard", "part", F.when(F.col("n") > half, F.col("part")).alias("own"), F.ceil(F.when(F.col("n") > half, F.col("n")).otherwise(F.col("few")) / half).alias("blocks"))
    at = F.pmod(F.when(F.col("own").isNull(), F.xxhash64("part")).otherwise(F.xxhash64("node")), F.col("blocks"))
    placed = write_table(rest.join(known, ["shard", "part"]).select("shard", "node", "part", "own", F.struct(F.coalesce("own", F.lit(-1)).alias("own"), at.alias("at")).alias("block")), "rest-blocks")
    blocks = placed.select("shard", "own", "block").distinct()
    a, b = (blocks.select("shard", F.col("own").alias(f"own_{x}"), F.col("block").alias(x)) for x in "ab")
    met = a.join(b, "shard").where("a <= b AND (own_a IS NULL OR own_b IS NULL OR own_a <> own_b)").select("shard", "a", "b", F.xxhash64("shard", "a", "b").alias("key"))
    alone = F.col("a") == F.col("b")
    first = met.select("shard", F.col("a").alias("block"), "key", F.when(alone, 2).otherwise(0).alias("side"))
    ends = first.union(met.where(~alone).select("shard", "b", "key", F.lit(1)))
    return placed.join(ends, ["shard", "block"]).select(F.col("key").alias("shard"), "node", "part", F.col("shard").alias("home"), "side")


def _alike(pairs: DataFrame, texts: DataFrame, least: float, size: int) -> DataFrame:
    """The pairs (u, v) whose texts (node, text) reach the similarity."""

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(shingles(x, size), shingles(y, size)) >= least for x, y in zip(each_bytes(a), each_bytes(b))], pa.bool_())

    dealt = pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("s"), F.pmod(F.xxhash64("u"), F.lit(SALTS)).alias("t"))
    ends = dealt.select(F.col("u").alias("node"), F.col("s").alias("salt")).union(dealt.select("v", "t")).distinct()
    ends = write_table(texts.join(ends, "node"), "pair-texts")
    left = ends.select(F.col("node").alias("u"), F.col("salt").alias("s"), F.col("text").alias("a"))
    right = ends.select(F.col("node").alias("v"), F.col("salt").alias("t"), F.col("text").alias("b"))
    return dealt.join(left, ["u", "s"]).join(right, ["v", "t"]).where(alike("a", "b")).select("u", "v").distinct()


def _rooted(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root) after new links (u, v). Only the links themselves meet again: each stands for the roots of its ends so far."""
    if roots is None:
        return connected_components(links)
    of_u, of_v = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "uv")
    ends = links.join(of_u, "u", "left").join(of_v, "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    moved = connected_components(ends)
    after = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = roots.join(after, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return write_table(kept.union(moved.join(roots, "node", "left_anti")), "roots")


def placed(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5, radius: int = RADIUS) -> DataFrame:
    """(id, t, component_id) for every row with an id: components of linked texts, named by their smallest id; t is the text's hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(id).cast("bigint").alias("id"), F.xxhash64(body).alias("t"), body.alias("text")).where("id is not null")
    prints = write_table(named.select("id", "t", _prints(size)(F.col("text")).alias("p")).select("id", "t", "p.*"), "minhash")
    parts = [F.first(c).alias(c) for c in ("n", "fp", "bands", "sketch", "bottom")]
    classes = prints.groupBy("c1", "c2").agg(F.min(F.struct("id", "t")).alias("first"), *parts)
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "minhash-classes")
    shards, rest = _shards(classes)
    of_node = classes.select("node", "n", "fp", "sketch", "bottom").join(shards.groupBy("node").agg(F.collect_set("shard").alias("shards")), "node")
    members = write_table(shards.join(of_node, "node"), "members")
    of_rest = None if rest is None else write_table(classes.select("node", "n", "fp", "sketch", "bottom").join(rest.groupBy("node").agg(F.collect_set("shard").alias("shards")), "node"), "rest-members")
    searched = members.select("node") if rest is None else members.select("node").union(rest.select("node"))
    asked = classes.join(searched.distinct(), "node", "left_semi").select("node", "first.*")
    texts = write_table(named.join(asked.hint("merge"), ["id", "t"]).select("node", "text").dropDuplicates(["node"]), "member-texts")
    tried = roots = None
    done = set()
    for whole, partners in [(False, n) for n in PARTNERS] + [(True, n) for n in PARTNERS if rest is not None]:
        if whole in done:
            continue
        given = rest if whole else members
        apart = given.withColumn("part", F.col("node")) if roots is None else given.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
        columns = ["shard", "node", "part", "n", "fp", "sketch", "bottom", "shards"]
        if whole:
            apart = _block_pairs(apart.select("shard", "node", "part")).join(of_rest, "node")
            near = apart.select(*columns, "home", "side").repartition("shard").sortWithinPartitions("shard", "side", "node")
        else:
            near = apart.select(columns).repartition("shard").sortWithinPartitions("shard", "node")
        pairs = near.mapInArrow(_rounds(least, radius, partners), "u bigint, v bigint").distinct()
        pairs = write_table(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            done.add(whole)
            continue
        more = write_table(_alike(pairs, texts, least, size), "links")
        tried = pairs if tried is None else tried.union(pairs)
        if not more.isEmpty():
            roots = _rooted(more, roots)
    drop_table(members)
    drop_table(texts)
    nodes = classes.select("c1", "c2", "first", F.col("node").alias("part")) if roots is None else classes.join(roots, "node", "left").select("c1", "c2", "first", F.coalesce("root", "node").alias("part"))
    named = nodes.join(nodes.groupBy("part").agg(F.min("first.id").alias("component_id")), "part").select("c1", "c2", "part", "component_id")
    return prints.select("id", "t", "c1", "c2").join(named, ["c1", "c2"]).select("id", "t", "part", "component_id")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    """(id, component_id) for every row of docs that has an id."""
    return placed(docs, id, text, least, size).select(F.col("id").alias(id), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = 0.8, size: int = 5) -> DataFrame:
    return _keep_one(docs, id, text, RADIUS, size, least)
