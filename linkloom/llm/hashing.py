"""Vectorised word and window hashes over UTF-8 bytes.

A word's hash is the sum of a pseudo-random 64-bit value for each of its bytes and that byte's place (tabulation), so
any two different words collide with a chance of about 2**-64, whatever their length. A window's is a Rabin-Karp
hash: the word hashes as a polynomial at a random base modulo the prime 2**61 - 1, so any two different windows of k words
collide with a chance of at most k / 2**61. All windows are hashed at once, by doubling: a window's hash comes from its halves'.
"""

from __future__ import annotations

import numpy as np

#: [^\x20\x09-\x0D]+ are words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

PRIME = (1 << 61) - 1
_P, _61, _32, _29 = np.uint64(PRIME), np.uint64(61), np.uint64(32), np.uint64(29)
_LOW32, _LOW29 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_BASES = dict(zip(("word", "word2"), np.random.default_rng(20_011).integers(1 << 32, PRIME, 2).tolist()))
#: Bytes of a word with a value in the table; further ones' are worked out.
_PLACES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(cells: np.ndarray) -> np.ndarray:
    """The value of each cell (place * 256 + byte)."""
    return mixed(mixed(cells.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(0xD1342543DE82EF95))


_TABLE = _byte_values(np.arange(_PLACES * 256))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of the documents raw[offsets[i]:offsets[i+1]], and n+1 word offsets."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the segments raw[starts[i]:ends[i]], which are sorted and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.zeros(len(raw), np.int32 if len(raw) < 1 << 31 else np.int64)
    begin[starts] = starts
    place = np.arange(len(raw), dtype=begin.dtype) - np.maximum.accumulate(begin)
    value = _TABLE[np.minimum(place, _PLACES - 1) << 8 | raw]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        value[far] = _byte_values(place[far].astype(np.int64) << 8 | raw[far])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mixed(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x below 2**64 modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    """x * factor modulo the prime, without the last reduction (below 2**63); both are below the prime.

    By halves of 32 bits: 2**64 is 8, and 2**32 * m is (m >> 29) + ((m & (2**29 - 1)) << 32), as 2**61 is 1.
    """
    hi, lo = np.uint64(factor >> 32), np.uint64(factor & ((1 << 32) - 1))
    x_hi, x_lo = x >> _32, x & _LOW32
    middle = x_hi * lo
    middle += x_lo * hi
    low = x_lo * lo
    out = x_hi * (hi << np.uint64(3))
    out += middle >> _29
    out += (middle & _LOW29) << _32
    out += low & _P
    out += low >> _61
    return out


def window_hashes(hashes: np.ndarray, k: int, kind: str = "word") -> np.ndarray:
    """Hash of hashes[i:i+k] for each i, all 64 bits in use; windows may cross documents, so callers mask them."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    base = _BASES[kind]
    one = _reduced(hashes)
    out, length = one, 1
    for bit in bin(k)[3:]:  # from the highest bit on: double, and one more where it is set
        out = _reduced(_times(out[:-length], pow(base, length, PRIME)) + out[length:])
        length *= 2
        if bit == "1":
            out = _reduced(_times(out[:-1], base) + one[length:])
            length += 1
    return mixed(out)


def inside(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Whether window i of k words lies in one document, for each of the n - k + 1 windows."""
    n = int(word_offsets[-1])
    if n < k:
        return np.zeros(0, bool)
    ends = np.repeat(word_offsets[1:], np.diff(word_offsets))
    return np.arange(n - k + 1) + k <= ends[: n - k + 1]
