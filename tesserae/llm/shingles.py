"""Distinct word-shingle sets of whole texts as sorted 64-bit hashes, a block of documents at a time."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix64, words_of

#: Fixed values that make the two families: a seed and the factor between the words of a shingle.
FAMILIES = ((0x243F6A8885A308D3, 0xD6E8FEB86659FD93), (0x13198A2E03707344, 0xA0761D6478BD642F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_LONG = 256  #: bytes from which a word is digested by itself


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time go through the finaliser, chained; unlike a polynomial, no pattern of bytes cancels out."""
    seed = np.uint64(FAMILIES[family][0])
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from every place
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
    live = np.flatnonzero(size <= _LONG)
    for k in range(0, _LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = mix64((out[live] ^ (eights[starts[live] + k] & _MASKS[np.minimum(size[live] - k, 8)])) * np.uint64(0x9FB21C651E98DF25) + seed)
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([family])).digest(), "little")
    return out


def shingle_sets(texts: list[bytes], width: int = 5, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every distinct shingle, sorted by both; ASCII letters count as lower case.

    Words are runs without space, tab, LF, VT, FF or CR.  A text of fewer than ``width`` words is
    one shingle of all its words; one without words has none.  The hashes of the two families have nothing in common.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    step = FAMILIES[family][1]
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1])).astype(np.int64)
    ws, we = words_of(data)
    if not len(ws):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    word = word_hashes(data, ws, we, family)
    doc = np.searchsorted(starts, ws, side="right") - 1
    count = np.bincount(doc, minlength=len(texts))
    n = len(word)
    padded = np.concatenate((word, np.zeros(width - 1, dtype=np.uint64)))
    total, factor = np.zeros(n, dtype=np.uint64), 1
    for k in range(width):
        total += padded[k : k + n] * np.uint64(factor)
        factor = factor * step % (1 << 64)
    first = np.cumsum(count) - count
    room = (first + count)[doc] - np.arange(n)
    full = room >= width
    gram, owner = mix64(total[full]), doc[full]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        factor = 1
        for k in range(width - 1):
            has = count[short] > k
            extra[has] += word[first[short][has] + k] * np.uint64(factor)
            factor = factor * step % (1 << 64)
        gram = np.concatenate((gram, mix64(extra + count[short].astype(np.uint64))))
        owner = np.concatenate((owner, short))
    order = np.lexsort((gram, owner))
    gram, owner = gram[order], owner[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], gram[new]
