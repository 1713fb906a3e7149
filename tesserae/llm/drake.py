"""Exact k-means over whole-number vectors with Drake's adaptive bounds.

A vector's row keeps its centroid, an upper bound of its distance to it, the next nearest centroids
in order with a lower bound of the distance to each, and one remainder bound for all others.  After
the centroids move, the bounds give way by the distances moved.  The first bounds that do not exceed
the upper bound name the centroids that could have become nearer: only these are measured again and
put in order; where even the remainder bound does not exceed it, no ordering can be certified and the
vector is compared with every centroid.  The number of bounds starts at a quarter of the centroids
and falls, not under an eighth, to what the last round used.

A round is one pass without a shuffle over rows that carry their bounds, written to the shared folder;
the sums of the clusters are then corrected by the vectors that changed theirs, so only centroids,
sums and counts, k of each, are on the driver.  Bounds are doubles widened beyond their rounding;
distances, sums and means are whole numbers throughout.

Defined results: vectors that are null, have another number of components than asked for, or hold
null or non-finite components take no part, nor do those with a component beyond 2**27 after scaling
(their squared distance would not fit a long); every other row counts, also where ids repeat; rows
without an id start as a centroid only where too few others are there; of equal ids the smaller
vector starts first; ties go to the smaller centroid number; a centroid without vectors stays; with
fewer vectors than centroids each starts as one; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

LARGEST = 1 << 27
WIDEN = 1e-12  #: of a bound, against its own rounding
BLOCK = 4096
STATE = "vec_id long, v array<int>, cluster int, before int, upper double, near binary, low binary, used int"


def whole(vectors: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    ok = vectors.filter(F.size("embedding") == dim).filter(~F.exists(F.col("embedding").cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c * scale) > float(LARGEST))))
    return ok.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<int>").alias("v"))


def squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(len(v), len(c)) squared distances, exactly."""
    big = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    if 4 * v.shape[1] * float(big) ** 2 < 2**53:  # every sum is then a whole number that a double holds
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((v.astype(np.int64) - x) ** 2).sum(1) for x in c.astype(np.int64)], 1)


def listed_squares(v: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to the centroids listed for it."""
    out = np.empty(which.shape, dtype=np.int64)
    for at in range(0, len(v), 512):
        out[at : at + 512] = ((v[at : at + 512, None].astype(np.int64) - c[which[at : at + 512]]) ** 2).sum(2)
    return out


def _down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - WIDEN)


def _up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + WIDEN)


class Bounds:
    """A block's centroid, upper bound, listed centroids and their lower bounds; the last bound is that of all others."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, near: np.ndarray, low: np.ndarray) -> None:
        self.own, self.upper, self.near, self.low = own, upper, near, low

    @classmethod
    def fresh(cls, v: np.ndarray, c: np.ndarray, keep: int) -> Bounds:
        """Every centroid measured; ``keep`` of the others are listed."""
        d = squares(v, c)
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
        near = np.take_along_axis(d, order, 1)
        rest = _down(near[:, keep + 1]) if keep + 1 < len(c) else np.full(len(v), np.inf)
        return cls(order[:, 0].astype(np.int16), _up(near[:, 0]), order[:, 1 : keep + 1].astype(np.int16), np.concatenate((_down(near[:, 1 : keep + 1]), rest[:, None]), 1))

    def shrink(self, keep: int) -> None:
        """Lists only the first ``keep`` centroids; the remainder takes the bounds of the others in."""
        if keep < self.near.shape[1]:
            rest = self.low[:, keep:].min(1)
            self.near, self.low = self.near[:, :keep], np.concatenate((self.low[:, :keep], rest[:, None]), 1)

    def advance(self, v: np.ndarray, c: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """The assignment after the centroids moved to c by at most ``moved``; returns how many listed centroids each vector needed, one more than are listed where all were."""
        keep = self.near.shape[1]
        self.upper = (self.upper + moved[self.own]) * (1 + WIDEN)
        self.low[:, :keep] -= moved[self.near] * (1 + WIDEN)
        self.low[:, keep] -= moved.max(initial=0) * (1 + WIDEN)
        self.low = np.where(self.low > 0, self.low * (1 - WIDEN), self.low * (1 + WIDEN))
        need = self._need()
        ask = np.flatnonzero(need)
        if len(ask):  # the exact distance to its own centroid often is enough
            self.upper[ask] = _up(((v[ask].astype(np.int64) - c[self.own[ask]]) ** 2).sum(1))
            need = self._need()
        for z in range(1, keep + 1):
            rows = np.flatnonzero(need == z)
            if len(rows):
                which = np.concatenate((self.own[rows, None], self.near[rows, :z]), 1)
                d = listed_squares(v[rows], c, which)
                order = np.lexsort((which, d), axis=1)
                which, d = np.take_along_axis(which, order, 1), np.take_along_axis(d, order, 1)
                self.own[rows], self.upper[rows] = which[:, 0], _up(d[:, 0])
                self.near[rows, :z], self.low[rows, :z] = which[:, 1:], _down(d[:, 1:])
        rows = np.flatnonzero(need > keep)
        if len(rows):
            again = Bounds.fresh(v[rows], c, keep)
            self.own[rows], self.upper[rows], self.near[rows], self.low[rows] = again.own, again.upper, again.near, again.low
        return need

    def _need(self) -> np.ndarray:
        """How many of the listed centroids may be as near as the own one: those before the first bound from which on all exceed the upper bound."""
        over = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1] > self.upper[:, None]
        return np.where(over.any(1), over.argmax(1), self.low.shape[1])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(rows: DataFrame, c: np.ndarray, moved: np.ndarray | None, keep: int, had: int) -> DataFrame:
    """The state after one assignment; without ``moved`` the first one.  ``had`` centroids are listed in the rows, ``keep`` shall be."""

    def run(batches):
        import pyarrow as pa

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                b = whole_batch.slice(at, BLOCK)
                v = _matrix(b.column(1))
                if moved is None:
                    s = Bounds.fresh(v, c, keep)
                    before, used = np.full(len(v), -1, dtype=np.int32), np.zeros(len(v), dtype=np.int32)
                else:
                    before = b.column(2).to_numpy()
                    near = np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=np.int16).reshape(len(v), had).copy()
                    low = np.frombuffer(b"".join(b.column(6).to_pylist()), dtype=np.float64).reshape(len(v), had + 1).copy()
                    s = Bounds(before.astype(np.int16), b.column(4).to_numpy(), near, low)
                    s.shrink(keep)
                    used = s.advance(v, c, moved).astype(np.int32)
                lists = [pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary()) for x in (s.near, s.low)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.own.astype(np.int32)), pa.array(before, pa.int32()), pa.array(s.upper), *lists, pa.array(used)], names=["vec_id", "v", "cluster", "before", "upper", "near", "low", "used"])

    return saved(rows.mapInArrow(run, STATE))


def _changes(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, s): count and sums of what the vectors that changed their cluster add to one and take from the other."""
    sides = F.explode(F.filter(F.array(F.struct(F.col("cluster").alias("at"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("before").alias("at"), F.lit(-1).cast("long").alias("sign"))), lambda x: x["at"] >= 0))
    x = state.filter("cluster <> before").select(sides.alias("x"), "v").select(F.col("x.at").alias("cluster"), F.col("x.sign").alias("sign"), "v")
    sums = [F.sum(F.col("v")[i] * F.col("sign")).alias(f"s{i}") for i in range(dim)]
    return x.groupBy("cluster").agg(F.sum("sign").alias("n"), *sums).select("cluster", "n", F.array(*[f"s{i}" for i in range(dim)]).alias("s"))


def cluster(rows: DataFrame, k: int, rounds: int, dim: int = 64, salt: str = "2:", on_round=None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of rows (vec_id, v) after ``rounds`` updates and one more assignment, and the centroids.

    ``on_round`` is told the number of bounds and how many vectors were compared with every
    centroid, if given.
    """
    if not 0 < k <= np.iinfo(np.int16).max:
        raise ValueError("k must lie between 1 and 32767")
    rows = saved(rows)
    first = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()  # k vectors
    c = np.array([r.v for r in first], dtype=np.int64).reshape(-1, dim)
    k = len(c)
    if not k:
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), c
    keep = max(1, k // 4) if k > 1 else 0
    count, total = np.zeros(k, dtype=object), np.zeros((k, dim), dtype=object)
    state, moved, had = _assign(rows, c, None, keep, keep), None, keep
    discard(rows)
    for step in range(rounds):
        for r in _changes(state, dim).collect():  # a row for each centroid
            count[r.cluster] += r.n
            total[r.cluster] += np.array(r.s, dtype=object)
        new = np.array([total[i] // count[i] if count[i] else c[i] for i in range(k)], dtype=object).astype(np.int64)
        moved, c = np.sqrt(((new - c).astype(np.float64) ** 2).sum(1)) * (1 + WIDEN), new
        if step:  # what the last assignment used decides how many bounds go on
            most = state.filter(F.col("used") <= had).agg(F.max("used")).first()[0]
            keep = min(had, max(k // 8, most or 0, 1)) if k > 1 else 0
        old, state = state, _assign(state, c, moved, keep, had)
        discard(old)
        had = keep
        if on_round:
            on_round(keep, state.filter(F.col("used") > keep).count())
    own = F.broadcast(rows.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "cluster int, c array<long>"))  # k rows
    apart = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda t, x: t + x)
    return state.join(own, "cluster").select("vec_id", "cluster", apart.alias("distance")), c


def digest(assigned: DataFrame, c: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    names = [(i, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for i, x in enumerate(c)]
    made = assigned.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    per = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole_sum = per.agg(F.sum("cluster_inertia").alias("inertia"))
    small = per.join(F.broadcast(made), "cluster").crossJoin(F.broadcast(whole_sum))  # a row for each centroid
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
