"""Repeated-phrase automata: remove long passages that an earlier document has already.

A window is `window` consecutive words of one document. A word goes if a window
that covers it also starts in a document with a smaller id. The steps:

1. Confirm. Every window picks one phrase of `phrase` words, the one of least hash, so
   equal windows pick equal phrases. Of phrases picked in two documents or more, the
   smallest document owns the phrase, and the phrases of one owner's block of BLOCK
   words go to one shard. There the windows that picked them are held against each
   other; each window that stands in two documents or more is confirmed, once, where
   the smallest document has it. Runs of confirmed windows are the recurring passages.
2. Compile. The passages of a shard become one Aho-Corasick automaton. Its letters are
   numbered runs of half a window's words, its keys the windows of the passages, and each
   key names its owner.
3. Stream. All documents are cut into chunks of CHUNK windows, and a chunk streams
   whole through the automata of the shards whose phrases it holds. A hit says that a
   window stands there and who owns it; if the owner is smaller, its words go. A chunk
   without a confirmed phrase cannot hold a passage, so no automaton needs it.

Words are hashed by XXH3-128 and runs of words by mixing 128-bit hashes, without any
sum that crafted texts could balance.

Nothing depends on how often a passage occurs. Shards are sized by counted windows;
a block with more than SHARD_WINDOWS is confirmed in several tasks, whose windows meet
in one aggregation, and streams its documents in as many. An automaton of more than
KEYS windows is split by the keys' first letters, and a chunk goes to those parts that
its own letters name, so it is copied at most once for each of its windows.

Nulls and the like: a null text has no words; texts shorter than a window are never
touched; very long texts are streamed in chunks; rows with a null id neither lose words
nor cause losses; rows that share an id count as one document, whose rows never remove
each other; rows that repeat lose the same words; an empty table gives an empty one;
columns of clashing names keep their values.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import drop_table, each_bytes, free_name, new_column, write_table
from scrivane.llm.words import digests, minimizers, mix, run_hashes

WINDOW = 50
PHRASE = 8
#: Words of an owner whose phrases share a shard.
BLOCK = 1024
#: Windows that one task confirms; it bounds the task's memory (about 100 bytes each).
SHARD_WINDOWS = 500_000
#: Windows that one automaton holds (up to 600 bytes each).
KEYS = 200_000
#: Digits of a letter's number. The library looks through a node's edges one by one, so no node may have many.
DIGITS = 3
#: Windows of a document that travel as one row: pieces with confirmed phrases and passages, and chunks that stream.
PIECE, CHUNK = 4096, 512
_CONFIRMED = "shard int, parts int, h1 bigint, h2 bigint, doc_id bigint, t bigint, start int, stop int, last bigint"
_STREAMED = "shard int, salt int, kind int, doc_id bigint, t bigint, start int, parts int, part int, words binary"


def _picked(words: list[bytes], window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hashes, for each window the position of its phrase)."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    phrases = run_hashes(digests(words)[0], phrase)
    return phrases, minimizers(phrases, window - phrase + 1)


def _phrases(window: int, phrase: int):
    """(h, doc_id, at, n): a document's picked phrases, where each stands first and how many windows picked it."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [[], [], [], []]
            for doc, data in zip(ids, each_bytes(batch.column(1))):
                phrases, picks = _picked(data.tobytes().split(), window, phrase)
                if len(picks):
                    found, first, n = np.unique(phrases[picks], return_index=True, return_counts=True)
                    for x, y in zip(out, (found, np.full(len(found), doc, np.int64), picks[first], n)):
                        x.append(y)
            if out[0]:
                h, docs, at, n = map(np.concatenate, out)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(docs), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "doc_id", "at", "n"])

    return run


class _Rows:
    """Rows of arrays, flushed as record batches of about 4 MB of their last column."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.size = schema, [[] for _ in schema], 0

    def put(self, *row) -> None:
        for x, y in zip(self.columns, row):
            x.append(y)
        self.size += len(row[-1])

    def full(self) -> bool:
        return self.size > 4 << 20

    def flush(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.size = [[] for _ in self.schema], 0
        return batch


def _marked(marks: list[dict], hashes: np.ndarray) -> np.ndarray:
    """For each hash the index of its mark, -1 where it has none."""
    known = np.array([m["h"] for m in marks], np.int64).view(np.uint64)
    order = np.argsort(known)
    at = np.minimum(np.searchsorted(known[order], hashes), len(known) - 1)
    return np.where(known[order][at] == hashes, order[at], -1)


def _dealt(doc: int, t: int, at: int, parts: int) -> int:
    """The part that a piece of a document goes to."""
    return int(mix(np.array([(doc * 31 + t) & 0xFFFFFFFFFFFFFFFF], np.uint64) + np.uint64(at))[0] % np.uint64(parts)) if parts > 1 else 0


def _segments(window: int, phrase: int):
    """A document's runs of windows whose phrases are confirmed, for the shards that confirm passages."""
    schema = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def run(batches):
        out = _Rows(schema)
        for batch in batches:
            docs, ts, lists = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for doc, t, data, marks in zip(docs, ts, each_bytes(batch.column(2)), lists):
                words = data.tobytes().split()
                phrases, picks = _picked(words, window, phrase)
                if not len(picks):
                    continue
                mark = _marked(marks, phrases[picks])
                place = np.where(mark >= 0, np.array([m["shard"] for m in marks], np.int64)[mark], 1 << 40)
                cuts = np.flatnonzero(np.diff(place, prepend=-1 << 40, append=-1 << 40))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if mark[lo] < 0:
                        continue
                    # A shard of a hot block holds nothing else, so its windows agree on the parts.
                    shard, parts = int(place[lo]), marks[mark[lo]]["parts"]
                    for a in range(lo, hi, PIECE):
                        b = min(a + PIECE, hi)
                        out.put(shard, _dealt(doc, t, a, parts), parts, doc, t, a, b" ".join(words[a : b + window - 1]))
                if out.full():
                    yield out.flush()
        if out.columns[0]:
            yield out.flush()

    return run


class _Shard:
    """The windows of one shard's pieces, or of one part of a hot shard's."""

    def __init__(self, window: int, shard: int, parts: int):
        self.window, self.shard, self.parts = window, shard, parts
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: int, t: int, start: int, words: bytes) -> None:
        hashes = digests(words.split())
        n = hashes.shape[1] - self.window + 1
        self.found.append((run_hashes(hashes[0], self.window), run_hashes(hashes[1], self.window, 1), np.full(n, doc, np.int64), np.full(n, t, np.int64), np.arange(start, start + n)))

    def result(self) -> pa.RecordBatch | None:
        """Of each distinct window its first place and its largest document: all of them in a part, else the confirmed ones, as ranges."""
        h1, h2, docs, ts, starts = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((starts, ts, docs, h2, h1))
        h1, h2, docs, ts, starts = (x[order] for x in (h1, h2, docs, ts, starts))
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        last = docs[np.append(first[1:], len(h1)) - 1]
        if self.parts > 1:
            pick, stops = first, starts[first] + 1
            hashes = [pa.array(h[first].view(np.int64)) for h in (h1, h2)]
        else:
            kept = first[docs[first] < last]
            last = last[docs[first] < last]
            if not len(kept):
                return None
            order = np.lexsort((starts[kept], ts[kept], docs[kept]))
            kept, last = kept[order], last[order]
            new = np.ones(len(kept), bool)
            new[1:] = (docs[kept[1:]] != docs[kept[:-1]]) | (ts[kept[1:]] != ts[kept[:-1]]) | (starts[kept[1:]] != starts[kept[:-1]] + 1)
            begin = np.flatnonzero(new)
            pick, stops, last = kept[begin], starts[kept[np.append(begin[1:], len(kept)) - 1]] + 1, last[begin]
            hashes = [pa.nulls(len(pick), pa.int64())] * 2
        same = lambda v: pa.array(np.full(len(pick), v, np.int32))
        return pa.RecordBatch.from_arrays(
            [same(self.shard), same(self.parts), *hashes, pa.array(docs[pick]), pa.array(ts[pick]), pa.array(starts[pick].astype(np.int32)), pa.array(stops.astype(np.int32)), pa.array(last)],
            [c.split()[0] for c in _CONFIRMED.split(", ")],
        )


def _confirmer(window: int):
    def run(batches):
        now, shard = None, None
        for batch in batches:
            for key, salt, parts, doc, t, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, salt) != now:
                    if shard is not None and (out := shard.result()) is not None:
                        yield out
                    now, shard = (key, salt), _Shard(window, key, parts)
                shard.add(doc, t, start, words)
        if shard is not None and (out := shard.result()) is not None:
            yield out

    return run


class _Letters:
    """Runs of words as letters: `window / size` of them, `size` words apart, spell a window; as few as divide it."""

    def __init__(self, window: int):
        self.size = max(r for r in range(1, max(1, window // 2) + 1) if window % r == 0)
        self.count = window // self.size

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes = digests(words)
        return run_hashes(hashes[0], self.size), run_hashes(hashes[1], self.size, 1)


def _streams(window: int, phrase: int):
    """Rows for the automata: kind 0, a passage of its owner; kind 1, a chunk of a document."""
    schema = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("parts", pa.int32()), ("part", pa.int32()), ("words", pa.binary())])
    letters = _Letters(window)

    def run(batches):
        out = _Rows(schema)
        for batch in batches:
            docs, ts, lists, owned = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for doc, t, data, marks, own in zip(docs, ts, each_bytes(batch.column(2)), lists, owned):
                words = data.tobytes().split()
                n = len(words) - window + 1
                places = {m["shard"]: (m["parts"], m["key_parts"]) for m in marks}
                for o in own or []:
                    if o["t"] == t:
                        parts, key_parts = places[o["shard"]]
                        for lo in range(o["start"], o["stop"], PIECE):
                            piece = b" ".join(words[lo : min(lo + PIECE, o["stop"]) + window - 1])
                            for salt in range(parts * key_parts):
                                out.put(o["shard"], salt, 0, doc, t, lo, key_parts, salt % key_parts, piece)
                        if out.full():
                            yield out.flush()
                if n > CHUNK:
                    phrases, picks = _picked(words, window, phrase)
                    mark = _marked(marks, phrases[picks])
                for lo in range(0, n, CHUNK):
                    some = words[lo : lo + CHUNK + window - 1]
                    piece = b" ".join(some)
                    here = places if n <= CHUNK else {marks[i]["shard"] for i in set(mark[lo : lo + CHUNK].tolist()) if i >= 0}
                    for shard in here:
                        parts, key_parts = places[shard]
                        dealt = _dealt(doc, t, lo, parts) * key_parts
                        named = np.unique(letters.of(some)[0] % np.uint64(key_parts)).tolist() if key_parts > 1 else (0,)
                        for j in named:
                            out.put(shard, dealt + j, 1, doc, t, lo, key_parts, j, piece)
                    if out.full():
                        yield out.flush()
        if out.columns[0]:
            yield out.flush()

    return run


class _Automaton:
    """Aho-Corasick automaton over a shard's passages: every window is a key of `count` letters that names its owner.

    A letter is spelled by DIGITS digits; each place has digits of its own, so a hit cannot begin within a letter.
    """

    def __init__(self, window: int):
        self.window, self.letters = window, _Letters(window)
        self.passages: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.machine = None

    def add(self, owner: int, parts: int, part: int, words: bytes) -> None:
        a, b = self.letters.of(words.split())
        n = len(a) - (self.letters.count - 1) * self.letters.size
        keys = np.arange(n)
        if parts > 1:
            keys = keys[a[:n] % np.uint64(parts) == np.uint64(part)]
        self.passages.append((owner, a, b, keys))

    def compile(self) -> None:
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.owners = np.array([p[0] for p in self.passages], np.int64)
        a, b = (np.concatenate([np.zeros(0, np.uint64), *(p[i] for p in self.passages)]) for i in (1, 2))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.low, self.high = a[new], b[new]
        self.base = max(2, int(np.ceil((len(self.low) + 1) ** (1 / DIGITS))))
        steps = np.arange(self.letters.count) * self.letters.size
        for i, (_, x, y, keys) in enumerate(self.passages):
            for key in self.spelled(x, y)[keys[:, None] + steps].reshape(len(keys), self.letters.count * DIGITS).tolist():
                self.machine.add_word(tuple(key), i)
        self.passages.clear()
        self.machine.make_automaton()

    def spelled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(letters, digits) of the letters' numbers; a letter that no passage has is spelled by a digit of no place."""
        at = np.minimum(np.searchsorted(self.low, a), len(self.low) - 1)
        places = np.arange(DIGITS)
        digits = at[:, None] // self.base ** places % self.base + self.base * places
        digits[(self.low[at] != a) | (self.high[at] != b)] = self.base * DIGITS
        return digits

    def hits(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(window starts, owners) of the passages' windows that stand in the words."""
        if self.machine is None:
            self.compile()
        if not len(self.machine):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = digests(words.split())
        size, count = self.letters.size, self.letters.count
        a = run_hashes(hashes[0], size)
        known = self.low[np.minimum(np.searchsorted(self.low, a), len(self.low) - 1)] == a
        n = len(a) - (count - 1) * size
        # No key has an unknown letter, so only letters of windows of known ones need to stream.
        spelt = known[:n].copy()
        for k in range(1, count):
            spelt &= known[k * size : k * size + n]
        if not spelt.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        needed = np.zeros(len(a) + 1, bool)
        for k in range(count):
            needed[k * size : k * size + n] |= spelt
        # All phases stream as one: letters `size` words apart follow each other, and a letter of no key parts what does not.
        at = np.arange(size)[:, None] + size * np.arange(len(a) // size + 2)
        at = np.minimum(at, len(a)).reshape(-1)
        keep = needed[at]
        keep[1:] |= needed[at[:-1]]
        at = at[keep]
        digits = np.full((len(a) + 1, DIGITS), self.base * DIGITS)
        some = np.flatnonzero(needed)
        digits[some] = self.spelled(a[some], run_hashes(hashes[1], size, 1)[some])
        starts, owners = [], []
        for end, owner in self.machine.iter(tuple(digits[at].reshape(-1).tolist())):
            starts.append(end // DIGITS - count + 1)
            owners.append(owner)
        return at[starts].astype(np.int64) if starts else np.zeros(0, np.int64), self.owners[owners]


def merged(docs: np.ndarray, ts: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Windows as (doc, t, start, stop) spans, touching ones joined."""
    if not len(docs):
        return docs, ts, starts, starts
    order = np.lexsort((starts, ts, docs))
    docs, ts, starts = docs[order], ts[order], starts[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (ts[1:] != ts[:-1]) | (starts[1:] > starts[:-1] + window)
    first = np.flatnonzero(new)
    return docs[first], ts[first], starts[first], starts[np.append(first[1:], len(docs)) - 1] + window


def _locator(window: int):
    def run(batches):
        now, machine = None, None
        spans: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush():
            docs, ts, lo, hi = (np.concatenate(x) for x in zip(*spans))
            return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(ts), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc_id", "t", "start", "stop"])

        for batch in batches:
            for shard, salt, kind, doc, t, start, parts, part, words in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, salt) != now:
                    now, machine = (shard, salt), _Automaton(window)
                if not kind:
                    machine.add(doc, parts, part, words)
                    continue
                starts, owners = machine.hits(words)
                starts = starts[owners < doc] + start
                if len(starts):
                    n = len(starts)
                    spans.append(merged(np.full(n, doc, np.int64), np.full(n, t, np.int64), starts, window))
                    held += len(spans[-1][0])
                if held > 50_000:
                    yield flush()
                    held = 0
                    spans.clear()
        if spans:
            yield flush()

    return run


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, t, spans array<struct<start, stop>>): word spans that windows of smaller documents cover, for each id and text hash that has any."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("t"), body.alias("text")).where("doc_id is not null")

    # Confirm: phrases by hash, then windows by shard.
    phrases = write_table(source.select("doc_id", "text").mapInArrow(_phrases(window, phrase), "h bigint, doc_id bigint, at int, n int"), "phrases")
    first = F.min(F.struct("doc_id", "at")).alias("first")
    recurring = phrases.groupBy("h").agg(first, F.max("doc_id").alias("last")).where("first.doc_id < last").select("h", F.col("first.doc_id").alias("owner"), F.expr(f"first.at div {BLOCK}").cast("int").alias("block"))
    hits = write_table(phrases.join(recurring, "h").select("h", "doc_id", "n", "owner", "block"), "hits")
    drop_table(phrases)
    loads = hits.groupBy("owner", "block").agg(F.sum("n").alias("load"))
    shards = 1 + (hits.agg(F.sum("n")).first()[0] or 0) // SHARD_WINDOWS
    shared, own = F.pmod(F.xxhash64("owner", "block"), F.lit(shards)), F.pmod(F.xxhash64("block", "owner"), F.lit((1 << 30) - 1)) + 1
    # A hot block has a shard of its own, named below zero; should two names meet, the larger number of parts holds.
    hot = loads.where(F.col("load") > SHARD_WINDOWS).select("owner", "block", (-own).cast("int").alias("hot"), F.ceil(F.col("load") / SHARD_WINDOWS).cast("int").alias("parts"))
    hot = hot.drop("parts").join(hot.groupBy("hot").agg(F.max("parts").alias("parts")), "hot")
    marked = hits.join(hot, ["owner", "block"], "left").select(
        "doc_id", "h", F.coalesce(F.col("hot"), shared.cast("int")).alias("shard"), F.coalesce("parts", F.lit(1)).alias("parts"),
    )
    marked = write_table(marked, "marks")
    drop_table(hits)
    marks = marked.groupBy("doc_id").agg(F.collect_set(F.struct("h", "shard", "parts")).alias("marks"))
    # Merge joins at every size: the plan must not hang on how little a small table repeats.
    pieces = source.join(marks.hint("merge"), "doc_id").select("doc_id", "t", "text", "marks").mapInArrow(
        _segments(window, phrase), "shard int, salt int, parts int, doc_id bigint, t bigint, start int, words binary"
    )
    met = pieces.repartition("shard", "salt").sortWithinPartitions("shard", "salt")
    confirmed = write_table(met.mapInArrow(_confirmer(window), _CONFIRMED), "confirmed")
    sure = confirmed.where("h1 is null").select("shard", "doc_id", "t", "start", "stop")
    parted = confirmed.where("h1 is not null").groupBy("shard", "h1", "h2").agg(F.min(F.struct("doc_id", "t", "start", "stop")).alias("first"), F.max("last").alias("last"))
    passages = write_table(sure.union(parted.where("first.doc_id < last").select("shard", "first.*")), "passages")
    drop_table(confirmed)

    # Compile and stream.
    sized = passages.groupBy("shard").agg(F.ceil(F.sum(F.col("stop") - F.col("start")) / KEYS).cast("int").alias("key_parts"))
    places = marked.join(sized, "shard").groupBy("doc_id").agg(F.collect_set(F.struct("h", "shard", "parts", "key_parts")).alias("marks"))
    owned = passages.groupBy("doc_id").agg(F.collect_list(F.struct("t", "shard", "start", "stop")).alias("owned"))
    both = places.join(owned, "doc_id", "left")
    rows = source.join(both.hint("merge"), "doc_id").select("doc_id", "t", "text", "marks", "owned").mapInArrow(_streams(window, phrase), _STREAMED)
    dealt = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = write_table(dealt.mapInArrow(_locator(window), "doc_id bigint, t bigint, start int, stop int"), "located")
    drop_table(marked)
    drop_table(passages)
    return spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def cut_words(data: np.ndarray, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    words = data.tobytes().split()
    if not spans:
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, out: str = "repeats") -> DataFrame:
    """docs' columns plus `out`, a struct of n_words, n_removed and kept (the kept words joined by one space).

    A column of that name may not be there yet.
    """
    new_column(docs, out)

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept: string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        done = [cut_words(data, s) for data, s in zip(each_bytes(texts), spans.to_pylist())]
        words, removed, kept = zip(*done) if done else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    key, t, found = (free_name(docs, n) for n in ("_repeats_id", "_repeats_t", "_repeats_spans"))
    spans = repeated_spans(docs, id, text, window, phrase).select(F.col("doc_id").alias(key), F.col("t").alias(t), F.col("spans").alias(found))
    same = (F.col(id).cast("bigint") == F.col(key)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(t))
    return docs.join(spans.hint("merge"), same, "left").withColumn(out, cut(F.col(text), F.col(found))).drop(key, t, found)
