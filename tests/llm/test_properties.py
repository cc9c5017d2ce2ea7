"""Properties over generated inputs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scrivane.llm import ogg, repeats, simhash, training_order, words

TEXT = st.text(alphabet=st.sampled_from("ab \n\té€Z.#\x0b"), max_size=200)


def arr(text):
    return np.frombuffer(text.encode(), np.uint8)


@given(st.binary(max_size=6000))
@settings(max_examples=60, deadline=None)
def test_ogg_round_trip(data):
    assert ogg.decode(ogg.mux(ogg.padded(data)))[0] == ogg.padded(data)


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_words_split_like_bytes(text):
    data = arr(text)
    starts, ends = words.word_spans(data)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == text.encode().split()
    hashes = list(zip(*words.digests(found).tolist()))
    assert len(set(zip(found, hashes))) == len(set(found)) == len(set(hashes))


@given(TEXT, TEXT)
@settings(max_examples=100, deadline=None)
def test_fingerprints_of_equal_words_are_equal(a, b):
    same = a.encode().lower().split() == b.encode().lower().split()
    if same:
        assert simhash.fingerprint(arr(a)) == simhash.fingerprint(arr(b))
    assert simhash.fingerprint(arr(a)) == simhash.fingerprint(arr("\n " + "\t".join(a.split()) if a.split() == [w.decode() for w in a.encode().split()] else a))


@given(st.integers(1, 3000), st.integers(0, 2**63 - 1))
@settings(max_examples=40, deadline=None)
def test_feistel(n, key):
    f = training_order.Feistel(n, key)
    slots = f.apply(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (f.apply(slots, back=True) == np.arange(n)).all()


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 60)), max_size=60))
@settings(max_examples=100, deadline=None)
def test_merged_spans_cover_the_same_words(windows):
    docs, starts = np.array([w[0] for w in windows], np.int64), np.array([w[1] for w in windows], np.int64)
    doc, _, lo, hi = repeats.merged(docs, np.zeros(len(docs), np.int64), starts, 5)
    cover = lambda spans: {(d, i) for d, a, b in spans for i in range(a, b)}
    assert cover(zip(doc, lo, hi)) == cover((d, s, s + 5) for d, s in windows)
    assert len(doc) <= len(set(windows))


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40, unique=True), st.integers(0, 2**64 - 1))
@settings(max_examples=100, deadline=None)
def test_bk_tree(values, asked):
    values += [asked ^ 1, asked ^ 6, asked ^ 15]
    tree = simhash.BKTree(3)
    for v in values:
        tree.add(v)
    assert sorted(tree.near(asked)) == [i for i, v in enumerate(values) if (v ^ asked).bit_count() <= 3]
