"""Word positions and hashes of a text as numpy arrays, the same in every process.

A word is read as 8-byte little-endian characters, each scrambled with its place in the word by a bijective
mixing function and then summed: words of up to 8 bytes never collide, and no linear relation between
words survives the scrambling. A window's hash takes in the hashes of its words one after the other, scrambling
after each. Hashes find candidates; where a result depends on equality, digest() of the words decides.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: By which places of a word differ.
_PLACE = tuple(np.uint64(int(x) ** 2 % 2**64) for x in _ODD)
#: Keeps the first 0 to 8 bytes of a character.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: True for bytes of words: all but the six ASCII white-space bytes.
BARE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
#: True for ASCII letters and digits and all bytes of other characters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(raw: bytes, word: np.ndarray = BARE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word[np.frombuffer(raw, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def characters(raw: bytes) -> np.ndarray:
    """The 8 bytes from every place of a text as one number, zeros behind its end."""
    return np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))


def range_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes of each range; ranges may overlap. Memory is a small multiple of the ranges' bytes in all."""
    size = ends - starts
    at = characters(raw)
    seed, odd = _SEEDS[which], _ODD[which]
    out = at[starts]
    out &= _FIRST[np.minimum(size, 8)]
    out ^= size.view(np.uint64) * odd + seed
    out = mix(out)
    more = np.flatnonzero(size > 8)
    if len(more):
        n = (size[more] - 1) >> 3  # characters after the first
        upto = np.cumsum(n)
        place = np.arange(1, int(upto[-1]) + 1) - np.repeat(upto - n, n)
        first = np.repeat(starts[more], n) + 8 * place
        value = at[first] & _FIRST[np.minimum(np.repeat(ends[more], n) - first, 8)]
        scrambled = mix(value ^ (place.view(np.uint64) * _PLACE[which] + seed))
        out[more] = mix(out[more] + np.add.reduceat(scrambled, upto - n))
    return out


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each word."""
    return range_hashes(raw, starts, ends, which) if len(starts) else np.zeros(0, np.uint64)


def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each window of n consecutive values; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    odd = _ODD[1 - which]
    acc = h[:m].copy()
    for k in range(1, n):
        acc ^= acc >> np.uint64(32)
        acc *= odd
        acc += h[k : k + m]
    return mix(acc)


def digest(words: bytes) -> bytes:
    """Sixteen bytes that stand for words joined by one space: a cryptographic digest, so equal ones mean equal words."""
    return hashlib.blake2b(words, digest_size=16).digest()
