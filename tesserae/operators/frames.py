"""Frames as bytes: one pass over a gray frame for its deviation, entropy, dark bands and hash.

A frame is a row (width, height, gray binary): height rows of ``width`` bytes.  Memory is that of the
frame's own bytes and of a strip of STRIP pixels, whatever its size; Spark bounds a batch by bytes.

Defined results: a null frame has null features; an empty one (no pixels) too; bytes that are not width *
height are refused; a uniform frame has deviation and entropy 0; all rows dark: both bands end at a third of
the height; hashes of frames smaller than the reduced grid take shares of their pixels.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .image import hash_of, shares

STRIP = 1 << 20
GRID = 32


def strips(height: int, width: int):
    """Row ranges of about STRIP pixels."""
    step = max(1, STRIP // max(width, 1))
    for lo in range(0, height, step):
        yield lo, min(height, lo + step)


def measures(gray: np.ndarray, dark: float = 8.0, bins: int = 64) -> tuple[float, float, int, int, int]:
    """(population deviation, entropy in bits, dark rows at the top and at the bottom, 64-bit hash) of bytes (height, width)."""
    h, w = gray.shape
    count, sums, grid = np.zeros(256, dtype=np.int64), np.zeros(h, dtype=np.int64), np.zeros((GRID, GRID))
    down, across = shares(h, GRID), shares(w, GRID)
    for lo, hi in strips(h, w):
        part = gray[lo:hi]
        count += np.bincount(part.ravel(), minlength=256)
        sums[lo:hi] = part.sum(1, dtype=np.int64)
        grid += down[:, lo:hi] @ (part @ across.T)
    value, n = np.arange(256), int(count.sum())
    s, q = int((count * value).sum()), int((count * value * value).sum())
    # whole numbers up to the root: a uniform frame has deviation 0
    std = float(np.sqrt((n * q - s * s) / (n * n)))
    at = np.minimum(np.floor(value * bins / 255.0), bins - 1).astype(int)
    share = np.bincount(at, count, bins) / n
    share = share[share > 0]
    entropy = abs(float(-(share * np.log2(share)).sum()))
    bright = sums / w >= dark
    ends = [min(h // 3, int(b.argmax()) if b.any() else h) for b in (bright, bright[::-1])]
    return std, entropy, ends[0], ends[1], hash_of(grid)


def many(gray: np.ndarray, dark: float = 8.0, bins: int = 64) -> tuple[np.ndarray, ...]:
    """(deviations, entropies, dark rows at the top and at the bottom) of frames (n, height, width) in whole-array steps."""
    m, h, w = gray.shape
    n = h * w
    count = np.bincount((np.arange(m, dtype=np.int64)[:, None] * 256 + gray.reshape(m, n)).ravel(), minlength=m * 256).reshape(m, 256)
    value = np.arange(256)
    s, q = count @ value, count @ (value * value)
    at = np.minimum(np.floor(value * bins / 255.0), bins - 1).astype(int)
    share = np.add.reduceat(count, np.searchsorted(at, np.arange(bins)), axis=1) / n
    entropy = np.abs(-(share * np.log2(np.where(share > 0, share, 1.0))).sum(1))
    bright = gray.sum(2, dtype=np.int64) / w >= dark
    some = bright.any(1)
    ends = [np.minimum(h // 3, np.where(some, b.argmax(1), h)) for b in (bright, bright[:, ::-1])]
    return np.sqrt((n * q - s * s) / (n * n)), entropy, *ends


def hashed(gray: np.ndarray) -> int:
    """The hash alone, as measures gives it for a frame of one strip."""
    h, w = gray.shape
    return hash_of(shares(h, GRID) @ (gray @ shares(w, GRID).T))


def features(frames: DataFrame, low: float = 10.0, hashes: bool = True) -> DataFrame:
    """Adds std, entropy, top, bottom, phash and low_info (a deviation under ``low``) to rows with width, height, gray; gray itself does not leave the task.

    Frames of one size are measured together, STRIP pixels at a time; without ``hashes``, phash is null.
    """
    import pyarrow as pa

    added = [("std", pa.float64()), ("entropy", pa.float64()), ("top", pa.int32()), ("bottom", pa.int32()), ("phash", pa.int64())]
    kept = [c for c in frames.columns if c != "gray"]
    schema = frames.select(*kept, *[F.lit(None).cast(k).alias(n) for n, k in zip([n for n, _ in added], ["double", "double", "int", "int", "long"], strict=True)]).schema

    def run(batches):
        for b in batches:
            gray, width, height = b.column("gray"), b.column("width").to_pylist(), b.column("height").to_pylist()
            out: list[tuple] = [(None,) * 5] * b.num_rows
            sizes = defaultdict(list)
            for i in range(b.num_rows):
                if not gray[i].is_valid or not width[i] or not height[i]:
                    continue
                if len(gray[i].as_buffer()) != width[i] * height[i]:
                    raise ValueError(f"{len(gray[i].as_buffer())} bytes are no frame of {width[i]} x {height[i]}")
                sizes[height[i], width[i]].append(i)
            for (h, w), rows in sizes.items():
                step = STRIP // (h * w)
                if not step:  # larger than a strip
                    for i in rows:
                        out[i] = measures(np.frombuffer(gray[i].as_buffer(), dtype=np.uint8).reshape(h, w))
                    continue
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    px = np.frombuffer(b"".join([gray[i].as_buffer() for i in part]), dtype=np.uint8).reshape(len(part), h, w)
                    got = [x.tolist() for x in many(px)]
                    for i, g, *rest in zip(part, px, *got, strict=True):
                        out[i] = (*rest, hashed(g) if hashes else None)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(added)]], names=[*kept, *[n for n, _ in added]])

    return frames.select(*kept, "gray").mapInArrow(run, schema).withColumn("low_info", F.col("std") < low)


def luma(px: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma of blue-green-red bytes (height, width, channels), or the one channel there is, strip by strip."""
    if px.shape[2] == 1:
        return px[:, :, 0]
    out = np.empty(px.shape[:2], dtype=np.uint8)
    for lo, hi in strips(*px.shape[:2]):
        wide = px[lo:hi].astype(np.uint32)
        out[lo:hi] = (wide[:, :, 2] * 19595 + wide[:, :, 1] * 38470 + wide[:, :, 0] * 7471 + 32768) >> 16
    return out


def cropped(px: np.ndarray, dark: float = 8.0) -> np.ndarray:
    """Without the dark rows at the top and the bottom, a third of the height each at most."""
    gray = luma(px)
    bright = gray.sum(1, dtype=np.int64) / max(1, gray.shape[1]) >= dark
    ends = [min(len(bright) // 3, int(b.argmax()) if b.any() else len(b)) for b in (bright, bright[::-1])]
    return px[ends[0] : len(px) - ends[1]]


def scaled(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of (height, width, channels) bytes on a smaller grid, strip by strip."""
    h, w, c = px.shape
    # a pixel lies in one or two areas: cumulated sums along the rows, then weights along the columns
    edge = np.linspace(0, w, width + 1)
    low, part = np.floor(edge).astype(int), edge - np.floor(edge)
    out = np.zeros((height, width, c))
    rows = np.linspace(0, h, height + 1)
    for lo, hi in strips(h, w * c):
        total = np.concatenate((np.zeros((hi - lo, 1, c)), np.cumsum(px[lo:hi], axis=1, dtype=np.float64)), 1)
        narrow = np.diff(total[:, low] + part[:, None] * (total[:, np.minimum(low + 1, w)] - total[:, low]), axis=1) / (w / width)
        first, last = np.searchsorted(rows, lo, side="right") - 1, np.searchsorted(rows, hi, side="left")
        at = np.arange(lo, hi)
        span = slice(max(first, 0), last)
        part_of = np.clip(np.minimum(at + 1, rows[1:, None][span]) - np.maximum(at, rows[:-1, None][span]), 0, None) * (height / h)
        out[span] += np.einsum("ij,jwc->iwc", part_of, narrow)
    return np.rint(np.clip(out, 0, 255)).astype(np.uint8)
