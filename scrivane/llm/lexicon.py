"""BPE encoding through a lexicon of frequent words, and decoding.

Two passes. The first counts the words of all texts, by partial sums, and the most
frequent ones are compiled into a minimal acyclic transducer: states of equal futures
are one, so suffixes are shared, and the numbers on the transitions of a word add up to
its row in a table of ids. The arrays lie in one file in the shared folder, which every
executor maps into memory. The second pass splits each text, finds its distinct words
in the transducer, all of them letter by letter at once, and merges those it has not by
the vocabulary's ranks, lowest rank and leftmost place first.

Texts are normalised and split as the vocabulary file says, for files of one shape: NFC,
white space as separator, lower case, contractions, runs of letters, single digits and
runs of anything else, byte letters, and a mark at the end of a word. How single
characters behave is asked of the `tokenizers` library, once each; a text with
characters whose handling by NFC may differ between versions of Unicode is encoded by
that library as a whole. The special tokens' strings are their tokens.

Nulls and the like: a null or empty text has no ids; a very long one is split as a
whole, in one slice, and a word of any length is merged in one piece; bytes that are not
UTF-8 are read as replacement characters; repeated rows are encoded one by one; an
empty table gives an empty one; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.llm.common import byte_views, drop_table, shared_folder, write_table
from scrivane.llm.packing import tokenizer_path
from scrivane.llm.words import eights, grouped_words, word_hashes

#: Words in the lexicon, at most, and their longest in bytes.
MOST_WORDS, MOST_LETTERS = 1 << 17, 64
#: Bytes of text that are split at once; distinct words that a task counts before it hands them on.
SLICE, MOST_COUNTED = 2 << 20, 500_000
_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter of each byte: printable ones of Latin-1 are themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """The ranks of a BPE vocabulary, and its merging of byte words."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.table: dict[int, tuple[int, int]] | None = None

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE), self.made[at]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words in turn)."""
        out: list = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if 0 < len(w) <= MOST_LETTERS:
                short.append(i)
            else:
                out[i] = self.one(w)
        own = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short])
        data = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        closes = np.append(own[1:] != own[:-1], True)[: len(own)]
        symbols = np.where(closes, self.last[data], self.inner[data])
        ranks, made = np.full(len(own), _NONE), np.zeros(len(own), np.int64)
        pairs = np.flatnonzero(own[1:] == own[:-1])
        ranks[pairs], made[pairs] = self._ranks(symbols[pairs], symbols[pairs + 1])
        while len(own):
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sizes = np.diff(np.append(starts, len(own)))
            least = np.minimum.reduceat(ranks, starts)
            open_ = least != _NONE
            # The words that are done leave; in each of the others the leftmost pair of least rank becomes one.
            for k in np.flatnonzero(~open_).tolist():
                out[own[starts[k]]] = symbols[starts[k] : starts[k] + sizes[k]].tolist()
            if not open_.any():
                break
            here = (ranks == np.repeat(least, sizes)) & (ranks != _NONE)
            at = np.minimum.reduceat(np.where(here, np.arange(len(own)), len(own)), starts)[open_]
            symbols[at] = made[at]
            stay = np.repeat(open_, sizes)
            stay[at + 1] = False
            own, symbols, ranks, made = own[stay], symbols[stay], ranks[stay], made[stay]
            # Only the pairs before and after the new symbols have changed.
            new = (np.cumsum(stay) - 1)[at]
            ranks[new] = _NONE
            pairs = np.concatenate([new[new > 0] - 1, new[new + 1 < len(own)]])
            pairs = pairs[own[pairs] == own[pairs + 1]]
            ranks[pairs], made[pairs] = self._ranks(symbols[pairs], symbols[pairs + 1])
        return np.array([len(x) for x in out], np.int64), np.array([i for x in out for i in x], np.int64)

    def one(self, word: bytes) -> list[int]:
        """A word of any length, by a heap of (rank, place)."""
        if not word:
            return []
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        symbols = self.inner[np.frombuffer(word, np.uint8)].tolist()
        symbols[-1] = int(self.last[word[-1]])
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap = [(*found, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := self.table.get(a << 32 | b))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or self.table.get(symbols[i] << 32 | symbols[j]) != (rank, made):
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (found := self.table.get(symbols[x] << 32 | symbols[after[x]])):
                    heapq.heappush(heap, (found[0], x, found[1]))
        return [s for s in symbols if s >= 0]


class Splitter:
    """Texts to byte words, as the vocabulary file normalises and splits them."""

    # The kinds of steps that this class knows, and the contractions' letters after the apostrophe.
    STEPS = ("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel")
    ONE, TWO = "stmd", ("re", "ve", "ll")
    SPACE, LETTER, DIGIT, OTHER = range(4)
    UNKNOWN, SAFE, ODD = range(3)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        steps = tuple(s["type"] for s in self.file["normalizer"]["normalizers"]), tuple(s["type"] for s in self.file["pre_tokenizer"]["pretokenizers"])
        if steps != self.STEPS or self.file["decoder"] is not None or self.file["model"]["type"] != "BPE":
            raise ValueError(f"{path} is not a word vocabulary of the shape that is read here")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # Each special token's string becomes one character that no text may hold.
        self.special = {t["content"]: chr(0x10FFFF - i) for i, t in enumerate(self.file["added_tokens"])}
        self.marks = {m: self.library.token_to_id(s) for s, m in self.special.items()}
        self.known = np.zeros(0x110000, np.uint8)
        self.kind = np.full(0x110000, self.OTHER, np.uint8)
        for m in self.marks:
            self.kind[ord(m)] = self.DIGIT  # a word of its own
        self._learn(range(128))

    def _own(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _learn(self, points) -> None:
        for p in points:
            c = chr(p)
            if c in self.marks or unicodedata.ucd_3_2_0.category(c) == "Cn" and unicodedata.category(c)[0] != "S":
                self.known[p] = self.ODD
                continue
            theirs, ours = self.library.normalizer.normalize_str(c), self._own(c)
            spans = [s for _, s in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}!")]
            if theirs == " ":
                self.kind[p] = self.SPACE
            elif theirs != ours:
                self.known[p] = self.ODD
                continue
            else:
                self.kind[p] = self.LETTER if (0, 2) in spans else self.DIGIT if (1, 2) in spans else self.OTHER if (1, 3) in spans else self.SPACE
                if self.kind[p] == self.SPACE:
                    self.known[p] = self.ODD
                    continue
            self.known[p] = self.SAFE

    def _plain(self, text: str) -> bool:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known = self.known[codes]
        if not known.all():
            self._learn(np.unique(codes[known == self.UNKNOWN]).tolist())
            known = self.known[codes]
        return not (known == self.ODD).any()

    def normal(self, text: str) -> str | None:
        """The normalised text, its white space as it was; None if the library has to encode it."""
        if text.isascii():
            normal = text.lower()
        else:
            normal = self._own(text)
            if not self._plain(text) or not self._plain(normal):
                return None
        if "<|" in text:
            if text.lower() == normal:
                for s, m in self.special.items():
                    text = text.replace(s, m)
                return self._own(text)
            for s, m in self.special.items():
                text = text.replace(s, m)
            return self._own(text)
        return normal

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all texts, where words start and end in them, words of each text) of normalised texts."""
        joined = "\n".join(texts)
        codes = np.frombuffer(f"{joined}\n\n\n".encode("utf-32-le"), np.uint32)
        kind = self.kind[codes]
        start = np.empty(len(kind), bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        start |= kind == self.DIGIT
        start &= kind != self.SPACE
        # An apostrophe that is alone takes the letters of a contraction with it; those that follow are a word.
        n = len(codes) - 3
        at = np.flatnonzero((codes[:n] == 39) & start[:n] & (kind[1 : n + 1] == self.LETTER))
        a, b = codes[at + 1], codes[at + 2]
        taken = np.isin(a, [ord(c) for c in self.ONE]).astype(np.int64)
        for x, y in self.TWO:
            taken[(a == ord(x)) & (b == ord(y))] = 2
        at, taken = at[taken > 0], taken[taken > 0]
        start[at + 1] = False
        rest = at + 1 + taken
        start[rest] |= kind[rest] == self.LETTER
        word = kind != self.SPACE
        last = word.copy()
        last[:-1] &= ~word[1:] | start[1:]
        width = np.ones(len(codes), np.int64)
        for limit in (0x7F, 0x7FF, 0xFFFF):
            width += codes > limit
        place = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(width, out=place[1:])
        starts = np.flatnonzero(start)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
        return np.frombuffer(joined.encode(), np.uint8), place[starts], place[np.flatnonzero(last) + 1], counts


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each distinct word, each word's number among them), exact."""
    view, lengths = eights(data), ends - starts
    order, first, clash = grouped_words(word_hashes(view, data, starts, lengths), view, data, starts, lengths)
    if len(clash):  # two words of one hash: all by their bytes
        numbers: dict[bytes, int] = {}
        found = np.array([numbers.setdefault(data[a:b].tobytes(), len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        return np.unique(found, return_index=True)[1], found
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    return order[first], number


def compiled(words: list[bytes], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The transducer of sorted, different words and their ids, as the bytes of one file."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    below: list[int] = []  # words from each state on

    def settled(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (s := register.get(key)) is None:
            s = register[key] = len(states)
            states.append(key)
            below.append(int(node[0]) + sum(below[t] for _, t in node[1]))
        return s

    path: list[list] = [[False, []]]
    previous = b""
    for word in [*words, b""]:
        shared = len(os.path.commonprefix([previous, word]))
        while len(path) - 1 > shared:
            letter = previous[len(path) - 2]
            done = settled(path.pop())
            path[-1][1].append((letter, done))
        for _ in word[shared:]:
            path.append([False, []])
        if word:
            path[-1][0] = True
        previous = word
    root = settled(path[0])
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):
        skip = int(final)
        for letter, t in edges:
            keys.append(s << 8 | letter)
            targets.append(t)
            skips.append(skip)
            skip += below[t]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    head = np.array([root, len(states), len(keys), len(words), len(ids), 0, 0, 0], np.int64)
    parts = (head, np.array(keys, np.int64), offsets.astype(np.int64), np.array(ids, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([f for f, _ in states], np.uint8))
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled transducer, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, mode="r")
        self.root, states, edges, words, ids = raw[:40].view(np.int64).tolist()
        at = 64
        for name, kind, n in (("keys", np.int64, edges), ("offsets", np.int64, words + 1), ("ids", np.int64, ids), ("targets", np.int32, edges), ("skips", np.int32, edges), ("final", np.uint8, states)):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + size].view(kind))
            at += size

    def rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The row of each word's ids; -1 for words that the lexicon has not."""
        out = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(lengths <= MOST_LETTERS)
        state, row, k = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live) and len(self.keys):
            done = lengths[live] == k
            over = done & (self.final[state] == 1)
            out[live[over]] = row[over]
            live, state, row = live[~done], state[~done], row[~done]
            wanted = state << 8 | data[starts[live] + k]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            at, live = at[hit], live[hit]
            state, row, k = self.targets[at].astype(np.int64), row[hit] + self.skips[at], k + 1
        return out


class Encoder:
    """Texts to ids, through a lexicon if there is one."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.splitter = Splitter(path)
        self.merges = Merges(self.splitter.file["model"])
        self.lexicon = lexicon
        size = self.splitter.library.get_vocab_size()
        self.names = [self.splitter.library.id_to_token(i) for i in range(size)]

    def word_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids in turn), by merging; a special token's mark is its token."""
        marks = {m.encode(): i for m, i in self.splitter.marks.items()}
        lengths, ids = self.merges.merged([b"" if w in marks else w for w in words])
        held = [i for i, w in enumerate(words) if w in marks]
        if held:
            ids = np.insert(ids, (np.cumsum(lengths) - lengths)[held], [marks[words[i]] for i in held])
            lengths[held] = 1
        return lengths, ids

    def counts(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """The distinct words of the texts and how often each stands there."""
        plain = [t for t in map(self.splitter.normal, texts) if t]
        if not plain:
            return [], []
        data, starts, ends, _ = self.splitter.split(plain)
        place, number = distinct(data, starts, ends)
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist())], np.bincount(number, minlength=len(place)).tolist()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        normal = [self.splitter.normal(t) for t in texts]
        data, starts, ends, counts = self.splitter.split([t or "" for t in normal])
        place, number = distinct(data, starts, ends)
        first, lengths = starts[place], ends[place] - starts[place]
        rows = self.lexicon.rows(data, first, lengths) if self.lexicon else np.full(len(place), -1, np.int64)
        new = np.flatnonzero(rows < 0)
        raw = data.tobytes()
        new_lengths, new_ids = self.word_ids([raw[a : a + n] for a, n in zip(first[new].tolist(), lengths[new].tolist())])
        n_ids, at, known = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.zeros(0, np.int64)
        if self.lexicon:
            seen = rows >= 0
            known = self.lexicon.ids
            at[seen] = self.lexicon.offsets[rows[seen]]
            n_ids[seen] = self.lexicon.offsets[rows[seen] + 1] - at[seen]
        at[new], n_ids[new] = len(known) + np.cumsum(new_lengths) - new_lengths, new_lengths
        pool = np.concatenate([known, new_ids])
        each = n_ids[number]
        ends_ = np.cumsum(each)
        ids = pool[np.repeat(at[number] - (ends_ - each), each) + np.arange(int(each.sum()))] if len(each) else np.zeros(0, np.int64)
        upto = np.append(0, ends_)[np.cumsum(counts)]
        out = np.split(ids, upto[:-1])
        for i, t in enumerate(normal):
            if t is None:
                out[i] = np.array(self.splitter.library.encode(texts[i], add_special_tokens=False).ids, np.int64)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a blank between, as the library joins them for a file without a decoder."""
        return " ".join(map(self.names.__getitem__, ids))


def _texts(column: pa.Array):
    """Runs of texts of about SLICE bytes, with the rows they come from."""
    data, offsets = byte_views(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist())]
        lo = hi


def _counted(path: str):
    def run(batches):
        encoder, total = Encoder(path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, texts in _texts(batch.column(0)):
                words, counts = encoder.counts(texts)
                for w, n in zip(words, counts):
                    if len(w) <= MOST_LETTERS:
                        total[w] += n
                if len(total) >= MOST_COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    return run


def word_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(word, n): how often each word of MOST_LETTERS bytes or fewer stands in all texts."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_counted(path or tokenizer_path("word_bpe_49k.json")), "word binary, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def share_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Write bytes to the shared folder and hand the file to all executors, later ones too; the name to ask SparkFiles for."""
    name = f"{name}-{uuid.uuid4().hex}.bin"
    target = f"{shared_folder(spark)}/scrivane/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for lo in range(0, len(content), 1 << 20):
            out.write(bytearray(content[lo : lo + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(target)
    return name


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words of (word, n) from a count on, `most` or fewer: as many of the sixteenths of powers of two, from the highest down, as fit.

    Only the sizes of these classes come to the driver, so no task sends it words that are left out.
    """
    of = F.floor(F.log2("n") * 16)
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(of.alias("class")).count().collect()), reverse=True)  # 16 classes for each bit of a count
    least, held = None, 0
    for c, n in sizes:
        if (held := held + n) > most:
            break
        least = c
    return counts.where(of >= least if least is not None else F.lit(False))


def build_lexicon(docs: DataFrame, text: str = "text", path: str | None = None, most: int = MOST_WORDS) -> str:
    """Compile the most frequent words of all texts, `most` at the most; the name of the shared file."""
    path = path or tokenizer_path("word_bpe_49k.json")
    counts = write_table(word_counts(docs, text, path), "word-counts")
    top = most_frequent(counts, most).select("word").collect()  # `most` words of MOST_LETTERS bytes: a proven bound
    drop_table(counts)
    words = sorted(bytes(r[0]) for r in top)
    return share_file(docs.sparkSession, compiled(words, *Encoder(path).word_ids(words)), "lexicon")


def _encoded(path: str, lexicon: str | None, digest: bool):
    def run(batches):
        encoder = Encoder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
        kind = np.dtype("<u2" if len(encoder.names) <= 1 << 16 else "<u4")
        spelled = [str(i) for i in range(len(encoder.names))]
        for batch in batches:
            for lo, texts in _texts(batch.column(1)):
                all_ids = encoder.encode(texts)
                columns = [batch.column(0).slice(lo, len(texts)), pa.array([len(x) for x in all_ids], pa.int64())]
                if digest:
                    ids = [x.tolist() for x in all_ids]
                    columns.append(pa.array([hashlib.sha256(" ".join(map(spelled.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()))
                    columns.append(pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], pa.string()))
                else:
                    columns.append(pa.array([x.astype(kind).tobytes() for x in all_ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids"])])

    return run


def _with_ids(docs: DataFrame, id: str, text: str, path: str | None, lexicon: str | None, most: int, digest: bool) -> DataFrame:
    path = path or tokenizer_path("word_bpe_49k.json")
    lexicon = lexicon or build_lexicon(docs, text, path, most)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    more = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary"
    return rows.mapInArrow(_encoded(path, lexicon, digest), f"id {dict(rows.dtypes)['id']}, n_tokens bigint, {more}").withColumnRenamed("id", id)


def encoded(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, lexicon: str | None = None, most: int = MOST_WORDS) -> DataFrame:
    """(id, n_tokens, ids): little-endian ids of 16 bits up to a vocabulary of 65,536, else of 32; lexicon: the name that build_lexicon gave."""
    return _with_ids(docs, id, text, path, lexicon, most, False)


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids have none."""
    path = path or tokenizer_path("word_bpe_49k.json")
    names: list[str] = []

    @F.arrow_udf("string")
    def told(column: pa.Array) -> pa.Array:
        if not names:
            names.extend(Encoder(path).names)
        kind = np.dtype("<u2" if len(names) <= 1 << 16 else "<u4")
        return pa.array([None if v is None else " ".join(map(names.__getitem__, np.frombuffer(v, kind).tolist())) for v in column.to_pylist()], pa.string())

    return rows.withColumn(out, told(F.col(ids)))


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): of the decimal ids with blanks between, and of the text that decoding them gives."""
    return _with_ids(docs, id, text, path, None, MOST_WORDS, True)
