"""Word spans, word digests, exact groups of equal words, and hashes of runs of words (numpy and XXH3 only)."""

from __future__ import annotations

import numpy as np
import xxhash

# The separators between words, and odd 64-bit multipliers.
SEPARATORS = (32, 9, 10, 11, 12, 13)
BYTE_BASE = 0x9E3779B97F4A7C15
LANES = ((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(14, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    edge = np.zeros(len(data) + 2, np.int8)
    np.logical_not(IS_SPACE[data], out=edge[1:-1].view(bool))
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def digests(words: list[bytes]) -> np.ndarray:
    """(2, words) halves of each word's XXH3-128."""
    whole = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64)
    return np.ascontiguousarray(whole.reshape(-1, 2).T)


def run_hashes(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """64-bit hash of every run of k consecutive words, from hashes of single words.

    Runs of doubled length are hashed from two hashed halves, the last step from two
    that overlap; every step mixes, so no step is linear in the words.
    """
    if len(words) < k:
        return np.zeros(0, np.uint64)
    a, b = map(np.uint64, LANES[lane])
    size = 1
    while size < k:
        step = min(size, k - size)
        words = mix(words[: len(words) - step] * a + words[step:] * b)
        size += step
    return words


def minimizers(phrases: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` consecutive phrases, the position of its least hash (the leftmost of equal ones)."""
    if len(phrases) < width:
        return np.zeros(0, np.int64)
    least, at, size = phrases, np.arange(len(phrases)), 1
    while size < width:  # windows of doubled length, the last step from two that overlap
        step = min(size, width - size)
        later = least[step:] < least[:-step]
        at = np.where(later, at[step:], at[:-step])
        least = np.minimum(least[:-step], least[step:])
        size += step
    return at


#: Words of more bytes are hashed and compared one by one.
LONG = 256
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of data on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def word_hashes(view: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from all its bytes; view is eights(data)."""
    a, b = map(np.uint64, LANES[0])
    h = mix((view[starts] & _MASKS[np.minimum(lengths, 8)]) * a + lengths.astype(np.uint64) * b)
    left, at = np.flatnonzero(lengths > 8), 8
    while len(left) and at < LONG:
        rest = lengths[left] - at
        h[left] = mix(h[left] * a + (view[starts[left] + at] & _MASKS[np.minimum(rest, 8)]))
        left, at = left[rest > 8], at + 8
    for i in left.tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return h


def equal_words(view: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words a[i] and b[i] have the same bytes."""
    same = lengths[a] == lengths[b]
    left, at = np.flatnonzero(same), 0
    while len(left) and at < LONG:
        x, y = a[left], b[left]
        rest = lengths[x] - at
        equal = (view[starts[x] + at] ^ view[starts[y] + at]) & _MASKS[np.clip(rest, 0, 8)] == 0
        same[left[~equal]] = False
        left, at = left[equal & (rest > 8)], at + 8
    for i in left.tolist():
        x, y, n = starts[a[i]], starts[b[i]], lengths[a[i]]
        same[i] = np.array_equal(data[x : x + n], data[y : y + n])
    return same


def grouped_words(keys: np.ndarray, view: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, whether a word in that order is the first of its key, words whose key equals a different word's).

    Neighbours of one key are compared byte by byte; where the last array is empty,
    equal keys mean equal words.
    """
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = keys[order[1:]] != keys[order[:-1]]
    pairs = np.flatnonzero(~first)
    clash = ~equal_words(view, data, starts, lengths, order[pairs - 1], order[pairs])
    return order, first, order[pairs[clash]]
