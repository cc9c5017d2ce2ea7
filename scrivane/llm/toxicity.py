"""Convolutional text classifier for toxicity, trained in numpy.

Words (runs of bytes other than white space and ASCII punctuation, A-Z lower-cased)
are embedded as the sum of hashed vectors of the word and of its leading bytes.
Filters of several widths run over the whole text, are max-pooled, and feed a
logistic unit. All weights start at random; nothing of the labels is put in but by
gradients, in batches of documents.

All labelled rows outside the held-out fold are learned from, in shards of about
SHARD_ROWS that Spark deals by a hash of the id. In a round each task streams its shard
once, starting from the weights and Adagrad sums of the round before, and sends what it
changed, in packed blocks of BLOCK buckets; a weight becomes the mean over the tasks that
touched it. The sums are of whole numbers (2**-POINT is one), so their order does not
matter. The weights, of fixed size, and a bitmap of 2 bytes for each labelled id pass
through the driver.
Every document is scored from its whole text, by the mean logit of CROSS models, each
trained on the rows of the other folds. A row's own fold gives it a score that did not
see it; by these, counted in steps of 1 / STEP over all rows, the steepness of the scores
is set, and a threshold for each language, which is drawn towards the common one by
SHRINK toxic rows. Language never enters a score.

Nulls and the like: a null or empty text has the score of no words; very long texts
are scored whole; ids may be of any type; a row with a null id counts as held out;
labels that are null or whose id has no document teach nothing; of conflicting labels
of an id the toxic one counts, and all rows of an id teach; rows with equal texts
stand in one fold; without
both classes every score is 0; an empty table gives an empty one; a column of the
result's name may not be there yet, other clashing names keep their values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import each_bytes, free_name, new_column
from scrivane.llm.words import BYTE_BASE, LOWER, _powers, mix

FOLDS = 5
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7)
WIDTHS = (1, 2, 3)
DIM, FILTERS = 8, 8
#: Labelled rows of a shard, about, and batches that each model is to see in a shard: with fewer in a pass there are more rounds.
SHARD_ROWS, BATCHES, LEAST_ROUNDS = 16384, 400, 3
#: Binary places of summed changes of the table and of the rest, steps of a logit by which rows are counted, and the range of those.
POINT, FINE_POINT, STEP, RANGE = 12, 20, 1024, 64
#: Buckets whose numbers tasks send in one row.
BLOCK = 1 << 14
#: Bits of one bitmap of bitmap_construct_agg.
BITMAP = 32768
#: Words of a text that are convolved at once.
PIECE = 1 << 16
#: Training documents that a bucket must stand in.
MIN_DOCS = 3
EPOCHS, RATE, BATCH = 6, 0.05, 32
CROSS = 3
#: Toxic rows that the common threshold weighs in a language's, and the range that the latter stays in.
SHRINK, THRESHOLDS = 20, (0.2, 0.8)

_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_TAIL = max(WIDTHS) - 1
#: Numbers that tasks send of a bucket: its vector and its Adagrad sum.
WIDE = DIM + 1


def features(data: np.ndarray) -> np.ndarray:
    """(words, 1 + prefixes) hash buckets of a text's words."""
    edge = np.zeros(len(data) + 2, np.int8)
    np.logical_not(_BREAK[data], out=edge[1:-1].view(bool))
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    if not len(starts):
        return out
    up, down = _powers(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    low, back = sums[starts], down[starts]
    stops = np.minimum(ends[:, None], starts[:, None] + np.array([len(data), *PREFIXES]))
    h = sums[stops]
    h -= low[:, None]
    h *= back[:, None]
    h += np.arange(out.shape[1], dtype=np.uint64)
    out[:] = mix(h) & np.uint64(BUCKETS - 1)
    return out


@dataclass
class TextCNN:
    table: np.ndarray  # (BUCKETS, DIM)
    filters: np.ndarray  # (sum(WIDTHS), DIM, FILTERS): the taps of each width in turn
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    out: np.ndarray  # the same, the logistic unit
    shift: float = 0.0

    @classmethod
    def fresh(cls, seed: int) -> "TextCNN":
        rng = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return cls(
            np.zeros((BUCKETS, DIM), np.float32),
            rng.normal(0, 0.3, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32),
            np.zeros(n, np.float32),
            rng.normal(0, 0.3, n).astype(np.float32),
        )

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        """(words, DIM), the sum of the vectors of each word's buckets."""
        x = self.table.take(ids[:, 0], axis=0)
        for i in range(1, ids.shape[1]):
            x += self.table.take(ids[:, i], axis=0)
        return x

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(highest value of each filter over a text's word vectors, the first word where it stands); x ends in _TAIL rows of zeros."""
        taps = self.filters.transpose(0, 2, 1).reshape(-1, DIM)
        values, places = [], []
        for lo in range(0, len(x) - _TAIL, PIECE):
            part = x[lo : lo + PIECE + _TAIL]
            n = len(part) - _TAIL
            y = taps @ part.T
            tap, value, place = 0, [], []
            for w in WIDTHS:
                z = y[tap * FILTERS : (tap + 1) * FILTERS, :n]
                for j in range(1, w):
                    z = z + y[(tap + j) * FILTERS : (tap + j + 1) * FILTERS, j : n + j]
                tap += w
                at = z.argmax(axis=1)
                place.append(lo + at)
                value.append(z[np.arange(FILTERS), at])
            values.append(np.concatenate(value))
            places.append(np.concatenate(place))
        if len(values) == 1:
            return values[0], places[0]
        first = np.argmax(values, axis=0)
        every = np.arange(len(first))
        return np.array(values)[first, every], np.array(places)[first, every]

    def activations(self, ids: np.ndarray) -> np.ndarray:
        """Pooled activations of one text."""
        x = np.zeros((max(1, len(ids)) + _TAIL, DIM), np.float32)
        if len(ids):
            x[: len(ids)] = self.vectors(ids)
        return self.best(x)[0] + self.bias

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of each row, word vectors of each row, pooled activations, the rows they come from).

        The texts stand below each other, each followed by _TAIL rows of zeros; a text without words has one such row more.
        """
        spans = np.array([max(1, len(t)) + _TAIL for t in texts])
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]])
        rows = np.full((int(spans.sum()), 1 + len(PREFIXES)), -1, np.int32)
        x = np.zeros((len(rows) + _TAIL, DIM), np.float32)
        best, where = [], []
        for at, span, t in zip(starts.tolist(), spans.tolist(), texts):
            if len(t):
                rows[at : at + len(t)] = t
                x[at : at + len(t)] = self.vectors(t)
            value, place = self.best(x[at : at + span])
            best.append(value)
            where.append(at + place)
        return rows, x, np.array(best) + self.bias, np.array(where)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        """Each text by itself, as sums in another company may round otherwise."""
        return np.array([np.maximum(self.activations(t), 0) @ self.out for t in texts], float)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.logits(texts) - self.shift)

    def gradients(self, pooled: tuple, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, their gradients, those of filters, bias and out) for what `pooled` gave and the logits' gradients d."""
        rows, x, z, where = pooled
        dz = d[:, None] * self.out * (z > 0)
        g_filters = np.zeros_like(self.filters)
        buckets, parts, tap = [], [], 0
        for k, w in enumerate(WIDTHS):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(w):
                at = where[:, mine] + j
                g_filters[tap + j] = np.einsum("bf,bfd->df", dz[:, mine], x[at])
                part = dz[:, mine, None] * self.filters[tap + j].T
                use = (dz[:, mine] != 0) & (rows[np.minimum(at, len(rows) - 1), 0] >= 0) & (at < len(rows))
                buckets.append(rows[at[use]])
                parts.append(np.repeat(part[use], rows.shape[1], axis=0))
            tap += w
        found, back = np.unique(np.concatenate(buckets).reshape(-1), return_inverse=True)
        total = np.zeros((len(found), DIM), np.float32)
        np.add.at(total, back, np.concatenate(parts))
        return found, total, g_filters, dz.sum(axis=0), d @ np.maximum(z, 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Training:
    """A model with its Adagrad sums, one for each bucket's vector; only live buckets have vectors. `middle` is the logits' offset."""

    def __init__(self, live: np.ndarray, seed: int = 7):
        self.live, self.model = live, TextCNN.fresh(seed)
        self.model.table[live] = np.random.default_rng(seed + 2).normal(0, 0.1, (int(live.sum()), DIM)).astype(np.float32)
        self.grown = [np.full_like(a, 1e-2) for a in (self.model.table[:, 0], self.model.filters, self.model.bias, self.model.out)]
        self.middle = self.grown_middle = 0.0

    def step(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float = RATE) -> np.ndarray:
        """One batch; the live buckets that it changed."""
        model = self.model
        pooled = model.pooled(texts)
        z = np.maximum(pooled[2], 0) @ model.out
        d = (weights * (sigmoid(z + self.middle) - labels)).astype(np.float32) / np.float32(np.sqrt(len(texts)))
        found, g_table, *others = model.gradients(pooled, d)
        self.grown_middle += float(d.sum()) ** 2
        self.middle -= rate * float(d.sum()) / np.sqrt(1 + self.grown_middle)
        for a, g, s in zip((model.filters, model.bias, model.out), others, self.grown[1:]):
            s += g * g
            a -= rate * g / np.sqrt(s + 1e-8)
        keep = self.live[found]
        found, g_table = found[keep], g_table[keep]
        self.grown[0][found] += (g_table * g_table).mean(axis=1)
        model.table[found] -= rate * g_table / np.sqrt(self.grown[0][found] + 1e-8)[:, None]
        return found

    def done(self) -> TextCNN:
        self.model.shift = -self.middle
        return self.model

    def rest(self) -> np.ndarray:
        """All but the table and its sums, in rows of WIDE numbers."""
        every = np.concatenate([*(a.ravel() for a in self._small()), [self.middle, self.grown_middle]]).astype(float)
        return np.pad(every, (0, -len(every) % WIDE)).reshape(-1, WIDE)

    def _small(self) -> list[np.ndarray]:
        return [self.model.filters, self.model.bias, self.model.out, *self.grown[1:]]

    def add(self, buckets: np.ndarray, changes: np.ndarray) -> None:
        """Add changes, a row of WIDE numbers each, to rows of the table and their sums, and after BUCKETS to rows of the rest."""
        in_table = buckets < BUCKETS
        at = buckets[in_table]
        self.model.table[at] += changes[in_table, :DIM].astype(np.float32)
        self.grown[0][at] += changes[in_table, DIM].astype(np.float32)
        rest = self.rest()
        rest[buckets[~in_table] - BUCKETS] += changes[~in_table]
        flat, lo = rest.ravel(), 0
        for a in self._small():
            a[...] = flat[lo : lo + a.size].reshape(a.shape)
            lo += a.size
        self.middle, self.grown_middle = float(flat[lo]), float(flat[lo + 1])

    def packed(self) -> tuple:
        """What `unpacked` makes a Training of: live rows of the table only."""
        return np.packbits(self.live), self.model.table[self.live], self.grown[0][self.live], self.rest()

    @classmethod
    def unpacked(cls, packed: tuple) -> "Training":
        bits, table, grown, rest = packed
        one = cls(np.unpackbits(bits)[:BUCKETS].astype(bool))
        one.model.table[one.live], one.grown[0][one.live] = table, grown
        one.add(BUCKETS + np.arange(len(rest)), rest - one.rest())
        return one


def class_weights(rows: int, toxic: int) -> np.ndarray:
    """Of a clean and a toxic row, so that both classes weigh alike."""
    return np.array([rows / max(1, 2 * (rows - toxic)), rows / max(1, 2 * toxic)])


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, rate: float = RATE) -> TextCNN:
    """Adagrad on batches, both classes weighing alike; only buckets of MIN_DOCS training documents or more have vectors."""
    rng = np.random.default_rng(seed + 1)
    seen = np.zeros(BUCKETS, np.int64)
    for t in texts:
        seen[np.unique(t)] += 1
    one = Training(seen >= MIN_DOCS, seed)
    weight = class_weights(len(labels), int(labels.sum()))[labels]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            one.step([texts[i] for i in some], labels[some], weight[some], rate)
    return one.done()


@dataclass
class Judges:
    """Models that judge together; without any, every score is 0."""

    models: list[TextCNN]
    scale: float = 1.0

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not self.models or not texts:
            return np.zeros(len(texts))
        return sigmoid(self.scale * np.mean([m.logits(texts) - m.shift for m in self.models], axis=0))


def steepness(far: np.ndarray, labels: np.ndarray, rows: np.ndarray | int = 1) -> float:
    """The scale of a logistic curve through distances from the midpoint; one row of either class on the wrong side keeps it finite. A distance may stand for `rows`, `labels` of them toxic."""
    x, y = np.concatenate([far, [1, -1]]), np.concatenate([labels, [0, 1]])
    n = np.concatenate([np.broadcast_to(rows, len(far)), [1, 1]])
    grid = np.geomspace(0.05, 20, 200)
    loss = [-(y * np.log(p) + (n - y) * np.log(1 - p)).sum() for p in (np.clip(sigmoid(g * x), 1e-9, 1 - 1e-9) for g in grid)]
    return float(grid[int(np.argmin(loss))])


def best_cut(scores: np.ndarray, labels: np.ndarray, rows: np.ndarray | int = 1) -> float | None:
    """The middle of the cuts with the highest F1. A score may stand for `rows`, `labels` of them toxic."""
    n = np.broadcast_to(rows, len(scores))
    if labels.sum() in (0, n.sum()):
        return None
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n[order]) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


def fold(id) -> "F.Column":
    return F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(FOLDS))


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, lang: str | None, per_class: int, most_bytes: int, seed: int) -> list:
    """A bounded look at the rows (toxic, text, lang): 2 * per_class rows and most_bytes bytes at most. The classifier learns from all rows instead (taught)."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col(id)) != 0)).groupBy(F.col(id).alias("_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_at", F.xxhash64(F.lit(seed), F.col("_id")))
    chosen = known.where("toxic = 1").orderBy("_at", "_id").limit(per_class).union(known.where("toxic = 0").orderBy("_at", "_id").limit(per_class))
    # At most 2 * per_class ids: a proven bound for the broadcast. Rows and bytes are bounded after the join.
    body = F.coalesce(F.col(text), F.lit(""))
    picked = docs.select(F.col(id).alias("_own"), body.alias("text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
    joined = picked.join(F.broadcast(chosen), F.col("_own") == F.col("_id"))
    # Of an id one row, chosen by numbers alone; its text is fetched only if the bytes allow.
    sized = joined.groupBy("_id").agg(F.first("toxic").alias("toxic"), F.first("_at").alias("_at"), F.min(F.struct(F.xxhash64("text").alias("t"), F.octet_length("text").alias("bytes"))).alias("one"))
    some = sized.select("_id", "toxic", "_at", "one.t", "one.bytes")  # 2 * per_class rows at most
    room, taken = {0: most_bytes // 2, 1: most_bytes // 2}, []
    for r in sorted(some.collect(), key=lambda r: (r["_at"], str(r["_id"]))):
        if r["bytes"] <= room[r["toxic"]]:  # a text that does not fit leaves its place to the next
            room[r["toxic"]] -= r["bytes"]
            taken.append(tuple(r))
    fits = docs.sparkSession.createDataFrame(taken, some.schema).select(F.col("_id").alias("_own"), "t", "toxic", "_at")
    rows = picked.join(F.broadcast(fits), "_own").where(F.xxhash64("text") == F.col("t")).groupBy("_own").agg(*(F.min(c).alias(c) for c in ("_at", "t", "toxic", "lang")), F.min("text").alias("text"))
    return sorted(rows.collect(), key=lambda r: (r["_at"], str(r["_own"])))


def taught(docs: DataFrame, labels: DataFrame, id: str, text: str, lang: str | None, seed: int) -> tuple[DataFrame, int]:
    """(all rows to learn from: fold, toxic, lang, text; a task's rows in a fixed order; the shards they are dealt to)."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col(id)) != 0)).groupBy(F.col(id).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    shards = max(1, -(-n // SHARD_ROWS))
    name = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = docs.select(F.col(id).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("text"), name.alias("lang"))
    # A bit for the hash of each labelled id, 2 bytes an id: texts whose bit is not set have no label and are not dealt.
    bits = -(-16 * max(1, n) // BITMAP) * BITMAP
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(bits))
    bitmaps = known.select(at("_id").alias("at")).groupBy(F.floor(F.col("at") / BITMAP).alias("_map")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("_bits"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_at % {BITMAP} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = rows.withColumn("_at", at("_own")).withColumn("_map", F.floor(F.col("_at") / BITMAP)).join(F.broadcast(bitmaps), "_map").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    # Both sides are dealt by the id, and the parts then make up the shards, so a text moves once. With fewer parts than its own setting Spark would deal again.
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("_own", "text", "lang").repartition(parts, "_own").join(known.repartition(parts, "_id"), F.col("_own") == F.col("_id")).coalesce(shards)
    rows = rows.select(F.pmod(F.xxhash64("text"), F.lit(CROSS)).cast("int").alias("fold"), "toxic", "lang", "text", F.xxhash64(F.lit(seed), F.col("_own")).alias("_at"), F.xxhash64("text").alias("_t"))
    return rows.sortWithinPartitions("_at", "_t", "text", "toxic", "lang").select("fold", "toxic", "lang", "text"), shards


def _examples(batches):
    """(fold, toxic, features, language) of each row of taught."""
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for part, toxic, name, data in zip(*columns, each_bytes(batch.column(3))):
            yield part, toxic, features(data), name


def squeezed(whole: np.ndarray) -> bytes:
    """Whole numbers, the sign last, as planes of bytes: small numbers leave all but the lowest planes empty."""
    numbers = np.ascontiguousarray(((whole << 1) ^ (whole >> 63)).T, "<i8").view(np.uint8).reshape(-1, 8)
    z = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_RLE)
    return z.compress(numbers.T.tobytes()) + z.flush()


def restored(data: bytes, rows: int) -> np.ndarray:
    """(rows, numbers of each), what `squeezed` was given."""
    numbers = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8")
    return ((numbers >> np.uint64(1)).astype(np.int64) ^ -(numbers & np.uint64(1)).astype(np.int64)).reshape(-1, rows).T


_BLOCKS = "model int, block int, touched binary, numbers binary, tasks binary"


def _blocks(model: int, at: np.ndarray, whole: np.ndarray, tasks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of _BLOCKS: whole numbers of the places `at`, which rise, and the tasks that each comes from, else one."""
    edges = np.searchsorted(at, np.arange(0, (int(at[-1]) if len(at) else -1) + BLOCK + 1, BLOCK))
    for block, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if lo < hi:
            touched = np.zeros(BLOCK, bool)
            touched[at[lo:hi] - block * BLOCK] = True
            columns = [[np.packbits(touched).tobytes()], [squeezed(whole[lo:hi])], [None if tasks is None else squeezed(tasks[lo:hi, None])]]
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([block], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["model", "block", "touched", "numbers", "tasks"])


def _read(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, places, their numbers, tasks) of each row of _BLOCKS."""
    for batch in batches:
        for model, block, touched, numbers, tasks in zip(*(batch.column(i).to_pylist() for i in range(5))):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(touched, np.uint8)))
            yield model, block * BLOCK + at, restored(numbers, len(at)), np.ones(len(at), np.int64) if tasks is None else restored(tasks, len(at))[:, 0]


def _summed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of a model over all tasks, one row at a time."""
    model, block = (k.as_py() for k in key)
    sums, tasks = None, np.zeros(BLOCK, np.int64)
    for _, places, numbers, n in _read(batches):
        if sums is None:
            sums = np.zeros((BLOCK, numbers.shape[1]), np.int64)
        at = places - block * BLOCK
        sums[at] += numbers
        tasks[at] += n
    at = np.flatnonzero(tasks)
    yield from _blocks(model, block * BLOCK + at, sums[at], tasks[at])


def gathered(sent: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(model, places, sums, tasks) of each block of each model; of fixed size."""
    return list(_read(sent.groupBy("model", "block").applyInArrow(_summed, _BLOCKS).toArrow().to_batches()))


def _seen(batches):
    """Documents of each fold that a bucket stands in, of one task."""
    seen, mark = np.zeros((CROSS, BUCKETS), np.int64), np.zeros(BUCKETS, bool)
    for part, _, ids, _ in _examples(batches):
        mark[ids] = True
        found = np.flatnonzero(mark)
        seen[part, found] += 1
        mark[found] = False
    for part in range(CROSS):
        at = np.flatnonzero(seen[part])
        yield from _blocks(part, at, seen[part, at, None])


def unit(buckets: np.ndarray) -> np.ndarray:
    """What a one stands for in whole numbers of changes, a row for each bucket."""
    return np.where(buckets < BUCKETS, 2.0**-POINT, 2.0**-FINE_POINT)[:, None]


def _learned(shared):
    """What one pass over a task's rows changes in each model."""

    def run(batches):
        packed, weights = shared.value
        now = {k: Training.unpacked(p) for k, p in packed.items()}
        waiting, touched = {k: [] for k in now}, {k: np.zeros(BUCKETS, bool) for k in now}
        used = set()

        def step(k):
            texts, labels = zip(*waiting[k])
            labels = np.array(labels)
            touched[k][now[k].step(list(texts), labels, weights[k][labels])] = True
            waiting[k].clear()
            used.add(k)

        for part, toxic, ids, _ in _examples(batches):
            for k in now:
                if k != part:
                    waiting[k].append((ids, toxic))
                    if len(waiting[k]) == BATCH:
                        step(k)
        for k in now:
            if waiting[k]:
                step(k)
        for k in sorted(used):
            old, one = Training.unpacked(packed[k]), now[k]
            at, rest = np.flatnonzero(touched[k]), one.rest() - old.rest()
            table = np.hstack([one.model.table[at] - old.model.table[at], (one.grown[0][at] - old.grown[0][at])[:, None]])
            buckets = np.concatenate([at, BUCKETS + np.arange(len(rest))])
            yield from _blocks(k, buckets, np.rint(np.vstack([table, rest]) / unit(buckets)).astype(np.int64))

    return run


def _judged(shared):
    """The logit of each row by the model that did not see it, in steps."""

    def run(batches):
        models = {k: TextCNN(**m) for k, m in shared.value.items()}
        z, toxic, names = [], [], []
        for part, y, ids, name in _examples(batches):
            if part in models:
                z.append(models[part].logits([ids])[0] - models[part].shift)
                toxic.append(y)
                names.append(name)
        step = np.rint(np.clip(np.array(z, float), -RANGE, RANGE) * STEP).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(step, pa.int32()), pa.array(toxic, pa.int32())], ["lang", "step", "toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str | None = "lang", seed: int = 7) -> tuple[Judges, dict, float]:
    """(models, thresholds by language, threshold of the rest), from all labelled rows outside the held-out fold."""
    rows, shards = taught(docs, labels, id, text, lang, seed)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(rows, shards, seed)
    finally:
        rows.unpersist()


def _fitted(rows: DataFrame, shards: int, seed: int) -> tuple[Judges, dict, float]:
    context = rows.sparkSession.sparkContext
    counts = np.zeros((CROSS, 2), np.int64)
    for r in rows.groupBy("fold", "toxic").count().collect():
        counts[r["fold"], r["toxic"]] = r["count"]
    total = counts.sum(axis=0)
    if not total.all():
        return Judges([]), {}, 0.5
    # A model learns from the other folds if both classes are there; if none can, one learns from all rows (and is of no fold).
    others = {k: total - counts[k] for k in range(CROSS) if (total - counts[k]).all() and counts[k].any()} or {CROSS: total}
    seen = np.zeros((CROSS, BUCKETS), np.int64)
    for part, at, n, _ in gathered(rows.mapInArrow(_seen, _BLOCKS)):
        seen[part, at] = n[:, 0]
    models = {k: Training(seen.sum(axis=0) - (seen[k] if k < CROSS else 0) >= MIN_DOCS, seed + k) for k in others}
    weights = {k: class_weights(int(n.sum()), int(n[1])) for k, n in others.items()}
    a_pass = max(1, min(int(n.sum()) for n in others.values()) // (shards * BATCH))
    for _ in range(min(EPOCHS, max(LEAST_ROUNDS, -(-BATCHES // a_pass)))):
        shared = context.broadcast(({k: m.packed() for k, m in models.items()}, weights))
        for k, at, sums, tasks in gathered(rows.mapInArrow(_learned(shared), _BLOCKS)):
            models[k].add(at, sums / tasks[:, None] * unit(at))
        shared.destroy()
    done = {k: m.done() for k, m in models.items()}
    together, thresholds = Judges(list(done.values())), {}
    shared = context.broadcast({k: dict(vars(m)) for k, m in done.items()})
    # Every row counts; there are as many rows here as languages and steps at most.
    judged = rows.mapInArrow(_judged(shared), "lang string, step int, toxic int").groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).orderBy("lang", "step").toArrow()
    shared.destroy()
    z, n, y = judged["step"].to_numpy() / STEP, judged["n"].to_numpy(), judged["toxic"].to_numpy()
    if 0 < y.sum() < n.sum():
        together.scale = steepness(z, y, n)
    names, scores = np.array(judged["lang"].to_pylist(), object), sigmoid(together.scale * z)
    for name in sorted({x for x in names if x is not None}):
        at = names == name
        if (t := best_cut(scores[at], y[at], n[at])) is not None:
            toxic = int(y[at].sum())
            thresholds[name] = float(np.clip((toxic * t + SHRINK * 0.5) / (toxic + SHRINK), *THRESHOLDS))
    return together, thresholds, 0.5


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", lang: str | None = "lang", out: str = "toxicity", **options) -> DataFrame:
    """docs' columns plus `out`, a struct of held_out, score, predicted, threshold (its language's) and flagged (score at or over it)."""
    new_column(docs, out)
    together, thresholds, rest = fit(docs, labels, id, text, lang, **options)
    shared = docs.sparkSession.sparkContext.broadcast(([dict(vars(m)) for m in together.models], together.scale))  # of fixed size

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        models, scale = shared.value
        judges = Judges([TextCNN(**m) for m in models], scale)
        return pa.array(np.concatenate([np.zeros(0), *(judges.scores([features(data)]) for data in each_bytes(column))]), pa.float64())

    threshold = F.lit(rest)
    for name, t in sorted(thresholds.items()):
        threshold = F.when(F.col(lang) == name, F.lit(t)).otherwise(threshold)
    held = free_name(docs, "_score")
    return docs.withColumn(held, score(F.col(text))).withColumn(
        out,
        F.struct(
            F.coalesce(fold(F.col(id)) == 0, F.lit(True)).alias("held_out"),
            F.col(held).alias("score"),
            (F.col(held) >= 0.5).cast("int").alias("predicted"),
            threshold.alias("threshold"),
            (F.col(held) >= threshold).alias("flagged"),
        ),
    ).drop(held)
