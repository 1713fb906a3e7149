"""Content-defined anchors: any two equal byte strings of ``length`` bytes hold the same anchor at the same offset."""

from __future__ import annotations

import numpy as np

from .common import prefix_sums, range_hashes

_BITS = 22
_SPOT = np.uint64((1 << _BITS) - 1)
WINDOW = 1 << _BITS  #: bytes of a block looked at together, so that an offset fits its bits


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, byte offset, hash of the ``gram`` bytes there), by document and offset.

    The anchor of a string is the start of its smallest-hashed gram (the leftmost of equals), so
    it depends on nothing outside the string.
    """
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, np.zeros(0, dtype=np.uint64)
    step = WINDOW - length + 1  # strings that start in a window end in it
    spots, hashes = [], []
    inside = _within(starts, sizes, length, n)
    for begin in range(0, n - length + 1, step):
        part = data[begin : begin + WINDOW]
        spot, hashed = _smallest(part, inside[begin : begin + len(part) - length + 1], length, gram)
        spots.append(spot + begin)
        hashes.append(hashed)
    spot, hashed = np.concatenate(spots), np.concatenate(hashes)
    if not len(spot):
        return none, none, np.zeros(0, dtype=np.uint64)
    new = np.concatenate(([True], spot[1:] != spot[:-1]))  # neighbouring windows may share one
    spot, hashed = spot[new], hashed[new]
    doc = np.searchsorted(starts, spot, side="right") - 1
    return doc, spot - starts[doc], hashed


def _within(starts: np.ndarray, sizes: np.ndarray, length: int, n: int) -> np.ndarray:
    """Whether the string that starts at each byte lies within one text."""
    ok = np.zeros(n + 1, dtype=np.int64)
    long = sizes >= length
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, (starts + sizes - length + 1)[long], -1)
    return np.cumsum(ok) > 0


def _smallest(data: np.ndarray, inside: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, hash) of the smallest-hashed gram of every string inside, once each, ascending."""
    at = np.arange(len(data) - gram + 1)
    hashed = range_hashes(prefix_sums(data), at, at + gram)
    low = (hashed & ~_SPOT) | at.astype(np.uint64)
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[: len(low) - (span - have)], low[span - have :]) if span > have else low
    spot = (low[inside] & _SPOT).astype(np.int64)
    if len(spot):
        spot = spot[np.concatenate(([True], spot[1:] != spot[:-1]))]
    return spot, hashed[spot]
