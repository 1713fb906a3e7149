"""Helpers shared by the operators: the engine's table access and shared folder, byte hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from ..sources.tables import discard, saved, shared_dir, table  # noqa: F401  (for the operators)


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The public murmur3 64-bit finaliser, vectorised (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: One odd-looking 64-bit value per byte, from the finaliser, so that no byte is weak.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Powers:
    """base**i and base**-i modulo 2**64 for i below the longest block seen so far."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = powers(_BASE, self.n), powers(_INV, self.n)
        return self.up, self.down


POWERS = Powers()


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """S with S[j]-S[i] = sum of value[byte k] * base**k for i <= k < j."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of byte ranges."""
    _, down = POWERS.upto(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without space, tab, LF, VT, FF, CR in one block of bytes."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def blocks(texts: list[bytes], limit: int = 1 << 20):
    """Runs of whole texts of about ``limit`` bytes: yields (first index, texts)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > limit:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
