"""Embedding features in blocks: a batch of vectors becomes one matrix, all its products one call.

functions.arrays has the same features as column expressions, for short vectors and single
values; here a component costs a few nanoseconds whatever their number.

Defined results: a null vector counts as zeros of the sample's length, a null component as 0;
a sample all of whose vectors are null has null features; vectors of one sample that differ in length
are refused; ties go to the first event; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

N = 4
_PAIRS = list(itertools.combinations(range(N), 2))
CELLS = 1 << 19  #: numbers of a block: memory is bounded however long the vectors are


def blocks(b, names: list[str]):
    """(rows, array (n, vectors, d)) of a batch, by length of the vectors, of about CELLS numbers; rows without any vector are left out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.stack([b.column(c).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for c in names], 1)
    width = sizes.max(1)
    if ((sizes != width[:, None]) & (sizes >= 0)).any():
        raise ValueError("the vectors of a sample differ in length")
    for d in np.unique(width[width >= 0]):
        rows = np.flatnonzero(width == d)
        step = max(1, CELLS // max(1, int(d) * len(names)))
        for lo in range(0, len(rows), step):
            at = rows[lo : lo + step]
            out = np.zeros((len(at), len(names), int(d)))
            for k, c in enumerate(names):
                part = b.column(c).take(pa.array(at))
                there = np.flatnonzero(sizes[at, k] >= 0)
                out[there, k] = pc.fill_null(part.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(len(there), int(d))
            yield at, out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, i, j) inner products of (n, i, d) and (n, j, d); equal vectors give equal numbers wherever they stand."""
    return np.einsum("nid,njd->nij", x, y)


def matches(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the last axis: the first best place, its value, and how far the second one is below (0 where there is none)."""
    ranked = np.sort(sims, -1)
    margin = ranked[..., -1] - ranked[..., -2] if sims.shape[-1] > 1 else np.zeros(sims.shape[:-1])
    return sims.argmax(-1), ranked[..., -1], margin


def frame_scalars(v: np.ndarray, n_events: int) -> np.ndarray:
    """(n, 4, 5) of frames, events in (n, 4 + events, d): greatest, mean and least product with the other frames, best with an event, its margin."""
    frames, events = v[:, :N], v[:, N : N + n_events]
    ff = products(frames, frames)
    others = np.stack([np.stack([ff[:, i, j] for j in range(N) if j != i], 1) for i in range(N)], 1)
    _, best, margin = matches(products(frames, events))
    return np.stack((others.max(2), others.sum(2) / (N - 1), others.min(2), best, margin), 2)


def sample_features(v: np.ndarray, n_events: int) -> np.ndarray:
    """(n, 8) of frames, events and caption in (n, 4 + events + 1, d): ff max, mean, min; most frames on one event; least best event; mean margin; least and mean product with the caption."""
    frames, events, caption = v[:, :N], v[:, N : N + n_events], v[:, N + n_events :]
    ff = np.stack([products(frames, frames)[:, i, j] for i, j in _PAIRS], 1)
    at, best, margin = matches(products(frames, events))
    shared = np.stack([(at == e).sum(1) for e in range(n_events)], 1).max(1)
    fc = products(frames, caption)[:, :, 0]
    return np.stack((ff.max(1), ff.sum(1) / len(_PAIRS), ff.min(1), shared, best.min(1), margin.sum(1) / N, fc.min(1), fc.sum(1) / N), 1)


SEMANTIC = ["ff_max_sim", "ff_mean_sim", "ff_min_sim", "fe_collision", "fe_min_maxsim", "fe_mean_margin", "fc_min_sim", "fc_mean_sim"]
SCALARS = ["ff_max", "ff_mean", "ff_min", "ev_best", "margin"]


def _mapped(df: DataFrame, key: str, columns: list[str], fields: list[T.StructField], compute) -> DataFrame:
    """Key and ``fields`` of every row; compute(block (n, vectors, d)) gives an array for each field, and rows without a vector have nulls."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            got = [(at, compute(x)) for at, x in blocks(b, columns)]
            rows = np.concatenate([at for at, _ in got]) if got else np.zeros(0, dtype=np.int64)
            back = np.full(b.num_rows, len(rows))
            back[rows] = np.arange(len(rows))
            place = pa.array(back, mask=back == len(rows))
            out = [b.column(key)]
            for k in range(len(fields)):
                parts = [a if isinstance(a := value[k], pa.Array) else pa.array(a) for _, value in got]
                out.append(pa.concat_arrays(parts).take(place) if parts else pa.nulls(b.num_rows, pa.float64()))
            names = [key, *[f.name for f in fields]]
            kinds = [to_arrow(f.dataType) for f in fields]
            yield pa.RecordBatch.from_arrays([out[0], *[x.cast(t) for x, t in zip(out[1:], kinds, strict=True)]], names=names)

    from pyspark.sql.pandas.types import to_arrow_type as to_arrow

    schema = T.StructType([df.schema[key], *fields])
    return df.select(key, *columns).mapInArrow(run, schema)


def semantic_features(df: DataFrame, frames: list[str], events: list[str], caption: str, key: str = "id") -> DataFrame:
    """(key, *SEMANTIC) for columns of vectors; fe_collision is a whole number."""
    def compute(x):
        f = sample_features(x, len(events))
        return [f[:, k].astype(np.int64) if name == "fe_collision" else f[:, k] for k, name in enumerate(SEMANTIC)]

    fields = [T.StructField(n, T.LongType() if n == "fe_collision" else T.DoubleType()) for n in SEMANTIC]
    return _mapped(df, key, [*frames, *events, caption], fields, compute)


def embedding_scalars(df: DataFrame, frames: list[str], events: list[str], key: str = "id") -> DataFrame:
    """(key, frame, *SCALARS): a row a frame."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def compute(x):
        f = frame_scalars(x, len(events)).reshape(len(x), -1)
        return [pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), f.shape[1]).cast(pa.list_(pa.float64()))]

    flat = _mapped(df, key, [*frames, *events], [T.StructField("f", T.ArrayType(T.DoubleType()))], compute)
    rows = [F.struct(F.lit(i).cast("long").alias("frame"), *[F.get("f", F.lit(len(SCALARS) * i + k)).alias(n) for k, n in enumerate(SCALARS)]) for i in range(N)]
    return flat.select(key, F.inline(F.array(*rows)))


def unit_vectors(df: DataFrame, column: str, key: str = "id") -> DataFrame:
    """(key, column): vectors divided by their norm; one of norm 0 becomes zeros, a null one stays null."""
    import pyarrow as pa

    def compute(x):
        norm = np.sqrt((x[:, 0] ** 2).sum(1, keepdims=True))
        unit = np.divide(x[:, 0], norm, out=np.zeros_like(x[:, 0]), where=norm > 0)
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[2]
        return [pa.ListArray.from_arrays(ends, unit.ravel())]

    return _mapped(df, key, [column], [T.StructField(column, T.ArrayType(T.DoubleType()))], compute)
