"""Prefix trie, lexicon encoding and filter audit against brute force and the tokenizers library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivane.llm import audit, lexicon, trie
from scrivane.llm.common import spread_join, write_table

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string, k string, CONV int"


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        leaves, saved = int(not kids[p]), (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for q in kids[p]:
            a, b = below(q)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=60, most=12, letters=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-3, 3 * n), n):
        if c < 0:
            continue
        for t in range(rng.randrange(0, most) if c % 7 else rng.choice([1, 3, 40])):
            rows.append((c, rng.choice([t, t, None, 0]) if c % 11 == 0 else t, rng.choice(["user", "user", "user", None]), rng.choice(["a", "é", None][:letters]), "x", 1))
    rows += [(None, 1, "user", "a", "x", 1), (5, 0, "u", "long " * 5000, "x", 1)]
    return rows + rows[:3]


@pytest.mark.parametrize("seed,block,width,piece", [(1, 1 << 14, 64, 4096), (2, 4, 2, 3), (3, 1, 3, 1), (4, 7, 2, 2)])
def test_trie(spark, monkeypatch, seed, block, width, piece):
    monkeypatch.setattr(trie, "WIDTH", width)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    got = [tuple(r) for r in trie.trie(trie.rebuilt(df), block=block).collect()]
    want = brute_trie(brute_rebuilt(rows))
    assert sorted(got, key=str) == want


def test_trie_of_a_hot_conversation_and_of_copies(spark):
    """A third of all rows are one conversation, a third of the conversations are copies of each other."""
    rows = [(0, t, "user", f"t{t}", "", 0) for t in range(900)] + [(5 * c, t, "user", f"s{t}", "", 0) for c in range(1, 300) for t in range(3)]
    rows += [(5 * c, t, "user", f"{c}", "", 0) for c in range(300, 600) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS)
    turns = trie.turns_of(df)
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        own[c].append((role, text))
    import sys

    sys.setrecursionlimit(5000)
    assert sorted((tuple(r) for r in trie.trie(turns, block=100).collect()), key=str) == brute_trie(own)


def test_trie_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.trie(trie.rebuilt(empty)).collect() == []
    one = spark.createDataFrame([(7, 0, "u", "x", "", 0)], TURNS)
    assert sorted((tuple(r) for r in trie.trie(trie.rebuilt(one)).collect()), key=str) == brute_trie(brute_rebuilt([(7, 0, "u", "x")]))


def test_minima_find_the_nearest_blocks():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 20):
        v = np.array([rng.randrange(5) for _ in range(n)])
        tree = trie.Minima(v)
        for b in range(n):
            for x in range(7):
                assert tree.after(b, x) == next((i for i in range(b + 1, n) if v[i] < x), -1)
                assert tree.before(b, x) == next((i for i in range(b - 1, -1, -1) if v[i] < x), -1)
            for hi in range(b, n + 1):
                assert tree.least(b, hi) == min(v[b:hi], default=np.iinfo(np.int64).max)


def test_heavy_keys_lose_nothing(spark):
    left = write_table(spark.createDataFrame([(i % 3 if i < 5000 else i, i) for i in range(6000)] + [(None, -1)] * 3, "k int, v int"), "left")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(0, 6000, 2)], "k int, w string")
    for how in ("inner", "left"):
        assert sorted(map(str, spread_join(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).select("k", "v", "w").collect()))


# Lexicon encoding -----------------------------------------------------------------------------------------------------------------

POOL = list("abcde 'srtvlmd'S .,!?12\n\té́İΣσß中文١½Ⅷ 　 \u0085\x1c\x1f\x00​᠎\U0001f600ͅक्<|>")
PHRASES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "it's we'll they've I'M 'sand don't ''s !'s", "�\U0010ffff", "ẛ̣", "가각", "\U00016d68", "\U00011384\U000113bb"]


def texts(seed=1, n=3000):
    rng = random.Random(seed)
    out = ["".join(rng.choice(POOL) for _ in range(rng.randrange(0, 25))) + (rng.choice(PHRASES) + rng.choice(POOL) if rng.random() < 0.2 else "") for _ in range(n)]
    return out + ["a" * 5000, "'" * 300, "x" * 64, "y" * 65, "", "ཱི" * 50, " " * 100_000, "the quick " * 20_000, "\n\t" * 400_000]


@pytest.fixture(scope="module")
def encoder():
    return lexicon.Encoder(lexicon.tokenizer_path("word_bpe_49k.json"))


def test_ids_are_those_of_the_library(encoder, tmp_path):
    all_texts = texts()
    want = [encoder.splitter.library.encode(t, add_special_tokens=False).ids for t in all_texts]
    assert [x.tolist() for x in encoder.encode(all_texts)] == want
    words, counts = encoder.counts(all_texts)
    some = sorted(set(words[::2]))
    (tmp_path / "lexicon").write_bytes(lexicon.compiled(some, *encoder.word_ids(some)))
    encoder.lexicon = lexicon.Lexicon(str(tmp_path / "lexicon"))
    assert [x.tolist() for x in encoder.encode(all_texts)] == want
    encoder.lexicon = None
    for ids in want[:300]:
        assert encoder.decode(ids) == encoder.splitter.library.decode(ids, skip_special_tokens=False)


def test_the_transducer_is_minimal_and_finds_its_words(tmp_path):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))).encode() + rng.choice([b"ing", b"ed", b""]) for _ in range(200)})
    (tmp_path / "l").write_bytes(lexicon.compiled(words, np.ones(len(words), np.int64), np.arange(len(words))))
    found = lexicon.Lexicon(str(tmp_path / "l"))
    asked = [*words, *(w + b"x" for w in words), b"", b"zz", b"q" * 100]
    starts = np.cumsum([0, *map(len, asked)])[:-1]
    rows = found.rows(np.frombuffer(b"".join(asked), np.uint8), starts, np.array([len(w) for w in asked]))
    assert rows.tolist() == [words.index(w) if w in words else -1 for w in asked]
    # A state for each different set of endings, no more.
    futures = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(found.final) == len(futures)


def test_words_of_one_hash_stay_apart(monkeypatch, encoder):
    want = [x.tolist() for x in encoder.encode(["one two one three two", "two"])]
    monkeypatch.setattr(lexicon, "word_hashes", lambda view, data, starts, lengths: np.zeros(len(starts), np.uint64))
    assert [x.tolist() for x in encoder.encode(["one two one three two", "two"])] == want


def test_encoding_tables(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "SLICE", 3000)
    rows = [(i, t, "w") for i, t in enumerate([*texts(4, 400), None, "same", "same"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, N_TOKENS string").repartition(4)
    library = lexicon.Encoder(lexicon.tokenizer_path("word_bpe_49k.json")).splitter.library
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    done = lexicon.decoded(lexicon.encoded(df, most=50)).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in done} == want
    assert all(r["decoded"] == library.decode(want[r["doc_id"]], skip_special_tokens=False) and r["n_tokens"] == len(want[r["doc_id"]]) for r in done)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {tuple(r) for r in lexicon.digests(df).collect()} == {(i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in want.items()}
    counted = {bytes(r["word"]): r["n"] for r in lexicon.word_counts(spark.createDataFrame([(" ab it's AB",), ("ab",), (None,)], "text string")).collect()}
    assert counted == {b"ab": 3, b"it": 1, b"'s": 1}
    assert lexicon.digests(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    some = spark.createDataFrame([(w.encode(), n) for w, n in [("a", 900), ("b", 800), ("c", 3), ("d", 3), ("e", 1)]], "word binary, n bigint")
    assert [sorted(bytes(r[0]).decode() for r in lexicon.most_frequent(some, k).collect()) for k in (0, 1, 3, 4, 9)] == [[], ["a"], ["a", "b"], ["a", "b", "c", "d"], list("abcde")]


# Filter audit ---------------------------------------------------------------------------------------------------------------------


def brute_bits(t):
    ws = [w for w in SPLIT.split(t) if w]
    return (len(ws) < 50) + 2 * (100 * len(set(ws)) < 65 * len(ws)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + 8 * bool(re.search("[#$%&*|]", t))


def audit_rows(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(90)] + ["Ab", "ÉÄ", "#", "x" * 300, "y" * 9, "y" * 17, "z|"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 3, 49, 50, 51, 60, 400])
        t = rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(vocabulary[: rng.choice([5, 60, 90, 97])]) for _ in range(k))
        if i % 6 == 0 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, rng.choice([t, t, t, None, ""]), rng.choice(["s1", "s2", None, ""]), "bits"))
    return rows + rows[:5] + [(None, rows[3][1], "s1", ""), (n, "w " * 900_000 + "q" * 3_000_000, "long", "")]


def test_audit(spark):
    rows = audit_rows()
    labels = [(i, i % 3 and 1, None if i % 5 else 1) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1)]
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    cells = defaultdict(Counter)
    for i, t, s, _ in rows:
        b = brute_bits(t or "") + 16 * (i is not None and i > first[t or ""])
        cells[s or ""][b, i in good, i in toxic] += 1
    want = set()
    for part, c in cells.items():
        shapley, own = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            before = 0
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                count = lambda test: sum(n for (b, g, x), n in c.items() if test(b, g, x))  # noqa: E731, B023
                hit = lambda b: b & bit and not b & before  # noqa: E731, B023
                removed = count(lambda b, g, x: hit(b))
                shapley[f] += removed
                own.append((part, order, k + 1, count(lambda b, g, x: not b & (before | bit)), removed, count(lambda b, g, x: b & bit and b & before), count(lambda b, g, x: b == bit), count(lambda b, g, x: hit(b) and g), count(lambda b, g, x: hit(b) and x), f))
                before |= bit
        want |= {(*r[:-1], shapley[r[-1]]) for r in own}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, BITS string").repartition(3)
    got = audit.interactions(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {tuple(r) for r in got.collect()} == want
    assert audit.interactions(docs.where("false")).collect() == []


def test_scan_of_clashing_hashes_and_of_pieces(monkeypatch):
    texts_ = [t or "" for _, t, *_ in audit_rows(2, 60)]
    data = np.frombuffer("".join(texts_).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts_)])
    want = [brute_bits(t) for t in texts_]
    assert audit.failures(audit.scan(data, offsets)).tolist() == want
    monkeypatch.setattr(audit, "SLICE", 50)
    assert [int(audit.failures(audit.scan_long(data[a:b]))[0]) for a, b in zip(offsets, offsets[1:])] == want
    monkeypatch.setattr(audit, "word_hashes", lambda view, data, starts, lengths: lengths.astype(np.uint64) << np.uint64(40))
    assert audit.failures(audit.scan(data, offsets)).tolist() == want
