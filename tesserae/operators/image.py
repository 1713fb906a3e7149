"""Frame features: perceptual hashes in numpy batches, the rest as column expressions."""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

DUPLICATE = 6


@functools.cache
def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None] + 1) / (2 * n))


def area_means(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over a height x width grid of areas; edges inside a pixel take their share of it."""
    for axis, size in ((0, height), (1, width)):
        n = gray.shape[axis]
        edge = np.linspace(0, n, size + 1)
        total = np.concatenate((np.zeros_like(np.take(gray, [0], axis)), np.cumsum(gray, axis)), axis)
        low = np.floor(edge).astype(int)
        part = edge - low
        at = np.take(total, low, axis) + np.expand_dims(part, 1 - axis) * (np.take(total, np.minimum(low + 1, n), axis) - np.take(total, low, axis))
        gray = np.diff(at, axis=axis) / (n / size)
    return gray


@functools.lru_cache(64)
def shares(n: int, size: int) -> np.ndarray:
    """(size, n): the part that each of n pixels has in each of ``size`` equal areas; every row sums to 1."""
    edge = np.linspace(0, n, size + 1)
    at = np.arange(n)
    return np.clip(np.minimum(at + 1, edge[1:, None]) - np.maximum(at, edge[:-1, None]), 0, None) * (size / n)


def phash_array(gray: np.ndarray) -> int:
    """64-bit perceptual hash: signs of the low 8 x 8 cosine terms of a 32 x 32 reduction against their median."""
    return hash_of(shares(gray.shape[0], 32) @ (gray @ shares(gray.shape[1], 32).T))


def hash_of(grid: np.ndarray) -> int:
    """The hash of a 32 x 32 reduction, as a signed number."""
    m = _dct(32)
    low = (m @ grid @ m.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def phash(frames: DataFrame, column: str = "gray", out: str = "phash") -> DataFrame:
    """Adds the hash of a gray frame (null stays null), in Arrow batches."""
    schema = frames.withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = [None if g.as_py() is None else phash_array(np.array(g.as_py())) for g in b.column(column)]
            yield b.append_column(out, pa.array(values, pa.int64()))

    return frames.mapInArrow(run, schema)


def pair_distances(hashes: list[Column]) -> list[Column]:
    return [A.hamming(hashes[i], hashes[j]) for i, j in itertools.combinations(range(len(hashes)), 2)]


def frame_features(frames: DataFrame) -> DataFrame:
    """Adds std, entropy, low_info, letterbox_px, width, height to rows with ``gray``."""
    g = F.col("gray")
    top, bottom = A.letterbox(g)
    return frames.withColumns({"std": A.pixel_std(g), "entropy": A.entropy(g), "letterbox_px": top + bottom, "width": F.size(F.get(g, F.lit(0))), "height": F.size(g)}).withColumn("low_info", F.col("std") < 10.0)


def sample_features(frames: DataFrame) -> DataFrame:
    """(id, min_phash_dist, n_dup_pairs, n_low_info, min_std, min_entropy, any_letterbox) of four frames a sample (id, slot)."""
    g = frames.groupBy("id").agg(*[F.max(F.when(F.col("slot") == i, F.col("phash"))).alias(f"h{i}") for i in range(4)], F.sum(F.col("low_info").cast("int")).alias("n_low_info"), F.min("std").alias("min_std"), F.min("entropy").alias("min_entropy"), F.max((F.col("letterbox_px") > 0)).alias("any_letterbox"))
    d = F.array(*pair_distances([F.col(f"h{i}") for i in range(4)]))
    return g.select("id", F.array_min(d).alias("min_phash_dist"), F.size(F.filter(d, lambda x: x <= DUPLICATE)).alias("n_dup_pairs"), "n_low_info", "min_std", "min_entropy", "any_letterbox")


def feature_table(samples: DataFrame, n_events: Column, n_words: Column) -> DataFrame:
    """Low-level features of a sample plus its caption's: events_deficit is how many events are missing to four."""
    return samples.withColumns({"n_events": n_events, "n_words": n_words, "events_deficit": F.greatest(F.lit(0), 4 - n_events)})


def stats_scalars(sample: dict[str, Column]) -> list[Column]:
    """Per frame: low_info, letterbox_frac, least pair distance / 64; zeros where the statistics are missing."""
    out = []
    for i in range(4):
        dists = [sample[f"d{a}{b}"] for a, b in itertools.combinations(range(4), 2) if i in (a, b)]
        out.append(F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in (sample[f"low_info_{i}"], sample[f"letterbox_frac_{i}"], F.least(*dists) / 64)]))
    return out
