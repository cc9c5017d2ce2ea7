"""Parts of the training-data operators against plain forms of the same, without Spark."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from scrivane.llm import ogg, packing, repeats, simhash, toxicity, training_order, words


def arr(text):
    return np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)


def test_word_hashes_do_not_hang_on_place_or_spaces():
    for lane in (0, 1):
        a, b = words.digests(b"x yy  zzz\tyy".split())[lane], words.digests(b"\n\nyy zzz x".split())[lane]
        assert a[1] == a[3] == b[0] and a[2] == b[1] and a[0] == b[2] and len(set(a.tolist())) == 3


def test_word_spans_know_the_separators_only():
    data = arr("a\x0bb\x0cc\rd\ne\tf g h\x1ci")
    s, e = words.word_spans(data)
    assert [data[i:j].tobytes().decode() for i, j in zip(s, e)] == ["a", "b", "c", "d", "e", "f", "g h\x1ci"]
    assert len(words.word_spans(arr(""))[0]) == len(words.word_spans(arr(" \n"))[0]) == 0


def test_run_hashes_and_minimizers_agree_for_equal_windows():
    rng = random.Random(1)
    ws = [str(rng.randrange(5)) for _ in range(300)]
    h = words.digests([w.encode() for w in ws])[0]
    for k in range(1, 12):
        found = {}
        for i, r in enumerate(words.run_hashes(h, k, k % 2).tolist()):
            assert found.setdefault(r, tuple(ws[i : i + k])) == tuple(ws[i : i + k])
        assert len(set(found.values())) == len(found) and len(words.run_hashes(h, k)) == len(ws) - k + 1
    assert len(words.run_hashes(h[:3], 4)) == 0
    runs = words.run_hashes(h, 4)
    same = {}
    for i, r in enumerate(runs.tolist()):
        assert same.setdefault(r, tuple(ws[i : i + 4])) == tuple(ws[i : i + 4])
    picks = words.minimizers(runs, 7)
    by_window = {}
    for i, p in enumerate(picks.tolist()):
        assert i <= p < i + 7
        assert by_window.setdefault(tuple(ws[i : i + 10]), runs[p]) == runs[p]


def naive_ogg_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_page_checksum():
    rng = random.Random(2)
    for n in (0, 1, 2, 27, 300):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert ogg.page_checksum(data) == naive_ogg_crc(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 959, 960, 961, 5000, 70_000, 700_000])
def test_ogg_round_trip(n):
    payload = ogg.padded(bytes(i * 7 % 251 for i in range(n)))
    assert len(payload) % 192 == 0 and len(payload) >= max(n, 192)
    media = ogg.mux(payload)
    back, found = ogg.decode(media)
    assert back == payload and found["streams"] == 2 and found["packets"] == -(-len(payload) // 960)
    streams = ogg.demux(media)
    starts = sorted(s for p in streams.values() for s, _ in ogg.timed(p[1:], 960))
    assert starts == list(range(0, len(payload), 960))
    pages = list(ogg.read_pages(media))
    assert all(len(p[4]) <= ogg.PAGE_SEGMENTS for p in pages) and sum(bool(p[0] & ogg.LAST) for p in pages) == 2


def test_ogg_packets_go_on_over_pages(monkeypatch):
    monkeypatch.setattr(ogg, "PAGE_SEGMENTS", 3)
    payload = bytes(range(256)) * 20
    media = ogg.mux(payload)
    assert any(p[0] & ogg.CONTINUED for p in ogg.read_pages(media)) and any(p[1] == -1 for p in ogg.read_pages(media))
    assert ogg.decode(media)[0] == payload


def test_ogg_damage_is_found():
    media = bytearray(ogg.mux(b"x" * 9600))
    for at in (5, 60, len(media) // 2, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))
    for bad in (media[:-1], media[1:], b"", media + b"OggS"):
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(bad))


def test_ogg_headers_of_other_makers_are_errors():
    for change in ({"rate": 0}, {"per": 0}, {"magic": b"\x01vorbi"}, {"count": 3}):
        head = {"magic": ogg.MAGIC, "count": 1, "rate": ogg.RATE, "per": ogg.PACKET} | change
        import struct

        packet = struct.pack(ogg.INFO, head["magic"], 0, head["count"], head["rate"], head["per"], 4)
        media = b"".join(p for _, p in ogg._stream_pages(1, [(packet, 0), (b"abcd", 4)]))
        with pytest.raises(ogg.OggError):
            ogg.decode(media)
        assert ogg.read_back(media)[0] is None and ogg.read_back(media)[-1]


def test_records_do_not_pad_over_lost_pieces():
    import pyarrow as pa
    import zstandard

    order, pack = training_order.Feistel(1), zstandard.ZstdCompressor()
    piece = lambda lo, hi: pack.compress(np.arange(lo, hi).astype("<u2").tobytes())
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([piece(*r) for r in rows], pa.binary())], ["slot", "offset", "ids"])
    made = training_order._records(8, False, 4, 0, 6, order)
    (out,) = made([batch([(0, 4), (4, 6)])])
    assert np.frombuffer(out.column(2)[0].as_py(), "<u2").tolist() == [0, 1, 2, 3, 4, 5, 0, 0]
    for rows in ([(0, 4)], [(4, 6)], [(0, 3), (4, 6)]):
        with pytest.raises(ValueError):
            list(made([batch(rows)]))


def naive_simhash(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", " \n", "One", "One two", "a b c", "ÄB c d e f", "x " * 5000, "The quick\tbrown fox\x0bjumps OVER the lazy dog"])
def test_fingerprint(text):
    assert simhash.fingerprint(arr(text)) & 0xFFFFFFFFFFFFFFFF == naive_simhash(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values for _ in range(3)]
    tree = simhash.BKTree(3)
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


@pytest.mark.parametrize("n", [10, 10**8, 10**12, 10**18])
def test_shard_keys_miss_no_pair(n):
    masks = simhash.shard_keys(3, n)
    rng = random.Random(n)
    for _ in range(2000):
        d = 0
        for _ in range(3):
            d |= 1 << rng.randrange(64)
        assert any(d & m == 0 for m in masks)


def test_feistel_is_a_permutation_and_goes_back():
    for n in (1, 2, 3, 10, 257, 5000):
        f = training_order.Feistel(n)
        slots = f.apply(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and f.apply(slots, back=True).tolist() == list(range(n))
    assert training_order.Feistel(5000).apply(np.arange(9)).tolist() != training_order.Feistel(5000, 1).apply(np.arange(9)).tolist()


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["say <|endoftext|> now", "<|endoftext|><|endoftext|>x <|endoftext", "a" * 3000 + "<|endoftext|>", "ab" * 30_000, "", " ", "Hello, world's  end\n\n\tx", "naïve café 12345", "<|endoftext|> a", "a" * 25_000, " " * 25_000 + "x", "é" * 500, "​\U0001f600 ok", "it's we'll THEY'RE"]
    encode = packing.make_encoder(packing.tokenizer_path())
    assert encode(["say <|endoftext|> now"]) == [[16706, 220, 50256, 783]]
    assert encode(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_cut_words():
    assert repeats.cut_words(arr(" a  b\nc "), None) == (3, 0, b"a b c")
    assert repeats.cut_words(arr("a b c d"), [{"start": 1, "stop": 3}, {"start": 2, "stop": 3}]) == (4, 2, b"a d")
    assert repeats.cut_words(arr(""), []) == (0, 0, b"")


def test_classifier_learns_and_scores_alike():
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    def doc(bad):
        ws = [rng.choice(base) for _ in range(80)]
        if bad:
            for _ in range(3):
                ws[rng.randrange(80)] = rng.choice(["vilex", "vilest,", "Crudd"])
        return toxicity.features(arr(" ".join(ws)))
    y = np.array([i % 2 for i in range(400)])
    x = [doc(b) for b in y]
    model = toxicity.train(x[:300], y[:300])
    assert ((model.scores(x[300:]) >= 0.5) == y[300:]).sum() >= 95
    again = toxicity.train(x[:300], y[:300])
    assert model.scores(x[300:310]).tolist() == again.scores(x[300:310]).tolist()
    untrained = toxicity.train(x[:300], y[:300], epochs=0)
    assert ((untrained.scores(x[300:]) >= 0.5) == y[300:]).sum() <= 75  # nothing of the labels is put in beforehand
    (empty,) = model.scores([toxicity.features(arr(""))])
    assert 0 <= empty <= 1 and len(model.scores([])) == 0


def small_model(seed=5):
    rng = np.random.default_rng(seed)
    model = toxicity.TextCNN.fresh(seed)
    model.table[:] = rng.normal(0, 0.5, model.table.shape)
    model.bias[:] = rng.normal(0, 0.2, model.bias.shape)
    words_ = [f"u{i}" for i in range(9)]
    texts = [toxicity.features(arr(" ".join(rng.choice(words_, n)))) for n in (0, 1, 2, 3, 7, 40)]
    return model, texts


def plain_logit(model, ids):
    """Convolution and max pooling word by word."""
    n = max(1, len(ids))
    x = [sum((model.table[b].astype(float) for b in word), np.zeros(toxicity.DIM)) for word in ids] + [np.zeros(toxicity.DIM)] * (n + 4 - len(ids))
    total, tap = 0.0, 0
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(x[i + j] @ model.filters[tap + j, :, f].astype(float)) for j in range(w)) for i in range(n))
            total += max(0.0, best + float(model.bias[k * toxicity.FILTERS + f])) * float(model.out[k * toxicity.FILTERS + f])
        tap += w
    return total


def test_forward_pass_against_plain_loops():
    model, texts = small_model()
    assert model.logits(texts) == pytest.approx([plain_logit(model, t) for t in texts], abs=1e-4)
    assert np.maximum(model.pooled(texts)[2], 0) @ model.out == pytest.approx(model.logits(texts), abs=1e-4)
    assert model.logits(texts[::-1])[::-1] == pytest.approx(model.logits(texts), abs=1e-5)


def test_gradients_against_differences():
    model, texts = small_model(6)
    d = np.random.default_rng(1).normal(0, 1, len(texts)).astype(np.float32)
    loss = lambda: float(sum(a * plain_logit(model, t) for a, t in zip(d, texts)))
    found, g_table, *others = model.gradients(model.pooled(texts), d)
    rng = np.random.default_rng(2)
    for part, g in zip((model.filters, model.bias, model.out), others):
        for _ in range(12):
            at = tuple(int(rng.integers(s)) for s in part.shape)
            old = part[at]
            part[at] = old + 1e-3
            up = loss()
            part[at] = old - 1e-3
            down = loss()
            part[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-3, abs=2e-2)
    for i in rng.integers(0, len(found), 12):
        k = int(rng.integers(toxicity.DIM))
        old = model.table[found[i], k]
        model.table[found[i], k] = old + 1e-3
        up = loss()
        model.table[found[i], k] = old - 1e-3
        down = loss()
        model.table[found[i], k] = old
        assert g_table[i, k] == pytest.approx((up - down) / 2e-3, abs=2e-2)


def test_steepness_follows_how_far_the_classes_lie_apart():
    y = np.array([0, 1] * 50)
    assert toxicity.steepness((2 * y - 1) * 5.0, y) < toxicity.steepness((2 * y - 1) * 1.0, y)


def test_best_cut():
    assert toxicity.best_cut(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert toxicity.best_cut(np.array([0.9, 0.8]), np.array([1, 1])) is None


def test_crc_of_pieces_is_of_32_bit_ids():
    assert zlib.crc32(np.array([1, 2], "<u2").astype("<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_phrases_count_the_windows_they_stand_for():
    """Shards are sized by windows, however often one text repeats a passage."""
    import pyarrow as pa

    text = " ".join(f"p{i % 50}" for i in range(50 * 400))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "a " * 60])], ["doc_id", "text"])
    (out,) = repeats._phrases(50, 8)([batch])
    rows = out.to_pylist()
    assert sum(r["n"] for r in rows if r["doc_id"] == 1) == 50 * 400 - 49 and sum(r["n"] for r in rows if r["doc_id"] == 2) == 11


def test_minimizers_cost_little_more_in_wide_windows():
    """Equal to looking at every phrase of every window, and not dearer by the window's width."""
    import time

    rng = np.random.default_rng(5)
    for n in (0, 1, 9, 60):
        for width in (1, 2, 7, 43):
            for most in (3, 1 << 60):
                h = rng.integers(0, most, n).astype(np.uint64)
                assert words.minimizers(h, width).tolist() == [i + int(h[i : i + width].argmin()) for i in range(n - width + 1)]

    def spent(width):
        best = 9.0
        for _ in range(3):
            t = time.process_time()
            words.minimizers(h, width)
            best = min(best, time.process_time() - t)
        return best

    h = rng.integers(0, 1 << 60, 60_000).astype(np.uint64)
    assert spent(16_000) < 10 * spent(64)


def test_automaton_streams_all_phases_at_once(monkeypatch):
    """Hits in every phase, in unknown words and across passages, by one spelling for a chunk."""
    words_ = [b"w%d" % i for i in range(400)]
    machine = repeats._Automaton(50)
    machine.add(3, 1, 0, b" ".join(words_[:120]))
    machine.add(7, 1, 0, b" ".join(words_[200:260]))
    machine.hits(b"a")
    calls = []
    spelled = repeats._Automaton.spelled
    monkeypatch.setattr(repeats._Automaton, "spelled", lambda self, a, b: calls.append(len(a)) or spelled(self, a, b))
    chunk = [b"x", *words_[10:90], b"y", *words_[200:260], *words_[:50], *words_[230:255], *words_[60:85], b"z"]
    starts, owners = machine.hits(b" ".join(chunk))
    keys = {tuple(words_[i : i + 50]): 3 for i in range(71)} | {tuple(words_[i : i + 50]): 7 for i in range(200, 211)}
    want = [(i, keys[tuple(chunk[i : i + 50])]) for i in range(len(chunk) - 49) if tuple(chunk[i : i + 50]) in keys]
    assert sorted(zip(starts.tolist(), owners.tolist())) == want and len(want) == 31 + 11 + 1
    assert len(calls) == 1
