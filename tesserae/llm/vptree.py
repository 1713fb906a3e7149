"""Nearest neighbours by one vantage-point tree per shard.

Vectors are dealt to cells by their nearest pivot (a bounded sample of the vectors), and a cell
of more than SHARD vectors to several shards by a hash of the id, so that copies of one vector
never crowd a shard.  Each shard becomes one tree row, written once.  A node keeps a vantage
point and, for either child, the least and the greatest distance of its points to it; a child is
skipped when the triangle inequality puts all its points beyond the current k-th distance.
``relax`` multiplies that lower bound: above one it prunes more than is proven, one is the exact
search.

A query first visits one shard of its nearest cell, which gives a k-th distance.  Then the same
inequality on the cells (a pivot and the least and greatest distance of its members) names the
cells it must still visit; only (query, shard) rows travel, and a tree meets all its queries in
one place, in waves of at most WAVE queries.  The k best are merged by (distance, id).

Defined results: vectors that are null, empty, all zero or hold null or non-finite components
take no part; vectors of different lengths are never compared; of rows that repeat an id the
smallest vector stays; a query is never its own neighbour; ties go to the smaller id; fewer
candidates than k give fewer rows; distances are exact to the last double also where squares
overflow or vanish; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SHARD = 8192
BLOCK = 512
LEAF = 64
CELLS = 1024  #: pivots at most: the bound of the sample that is fitted on and of what travels with a task
WAVE = 65_536  #: queries that meet a tree in one task


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    ok = ok.filter(~bad & F.exists("v", lambda x: x != 0))
    return ok.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("dim"), "v")


def _repair(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances whose squares overflowed or vanished, again with each pair's own scale."""
    bad = np.flatnonzero(~(d < np.inf) | (d < 1e-150))
    for at in range(0, len(bad), 4096):
        i = bad[at : at + 4096]
        x = np.abs(a[i] / 2 - b[i] / 2)
        top = x.max(1)
        unit = x / np.where(top > 0, top, 1)[:, None]
        d[i] = np.sqrt((unit**2).sum(1)) * top * 2
    return d


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of matching rows, components added in order."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for x in np.ascontiguousarray((a - b).T):
            total += x * x
        return _repair(np.sqrt(total), a, b)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) Euclidean distances, as pair_distances."""
    i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
    out = [pair_distances(a[i[at : at + 8192]], b[j[at : at + 8192]]) for at in range(0, len(i), 8192)]
    return np.concatenate(out).reshape(len(a), len(b)) if out else np.zeros((len(a), len(b)))


def build(points: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """A vantage-point tree as flat arrays; leaves are runs of ``order``."""
    rng = np.random.default_rng(seed)
    order = np.arange(len(points))
    nodes: list[list[float]] = []  # vantage, left, right, start, end, left low, left high, right low, right high

    def make(start: int, end: int) -> int:
        at = len(nodes)
        nodes.append([-1, -1, -1, start, end, 0, 0, 0, 0])
        if end - start <= LEAF:
            return at
        pick = start + int(rng.integers(end - start))
        order[[start, pick]] = order[[pick, start]]
        d = distances(points[order[start]][None], points[order[start + 1 : end]])[0]
        half = np.argsort(d, kind="stable")
        mid = len(half) // 2
        if d[half[0]] == d[half[-1]]:
            return at  # nothing to split by: a leaf, however long
        order[start + 1 : end] = order[start + 1 : end][half]
        d = d[half]
        nodes[at] = [order[start], 0, 0, start, end, d[0], d[mid - 1], d[mid], d[-1]]
        nodes[at][1] = make(start + 1, start + 1 + mid)
        nodes[at][2] = make(start + 1 + mid, end)
        return at

    if len(points):
        make(0, len(points))
    return {"order": order, "nodes": np.array(nodes, dtype=np.float64).reshape(-1, 9)}


def _may_hold(d: np.ndarray, lo, hi, limit: np.ndarray, relax: float) -> np.ndarray:
    """Whether a point whose distance to the vantage point lies in [lo, hi] can be within ``limit`` of a query at distance d."""
    with np.errstate(invalid="ignore", over="ignore"):
        bound = np.maximum(np.maximum(d - hi, lo - d), 0) * relax
        return ~(bound > limit * (1 + 1e-9) + 1e-300)


class Search:
    """The k nearest of a block of queries within one tree; keeps (distance, id) per query."""

    def __init__(self, tree: dict[str, np.ndarray], ids: np.ndarray, points: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int, relax: float, limit: np.ndarray | None = None) -> None:
        self.t, self.ids, self.p, self.qid, self.q, self.k, self.relax = tree, ids, points, qid, q, k, relax
        self.dist = np.full((len(q), k), np.inf)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max, dtype=np.int64)
        self.limit = np.full(len(q), np.inf) if limit is None else limit  # no candidate beyond it is wanted
        with np.errstate(over="ignore"):
            self.qq, self.pp = (q * q).sum(1), (points * points).sum(1)
        self.compared = 0
        if len(points) and len(q):
            self.visit(0, np.arange(len(q)))

    def offer(self, who: np.ndarray, rows: np.ndarray) -> None:
        """Exact distances only where the squares' expansion, with its rounding error, does not rule a point out."""
        for at in range(0, len(rows), 8 * LEAF):
            part = rows[at : at + 8 * LEAF]
            self.compared += len(who) * len(part)
            with np.errstate(over="ignore", invalid="ignore"):
                squares = self.qq[who][:, None] + self.pp[part][None]
                wanted = np.minimum(self.dist[who, -1], self.limit[who])[:, None] ** 2 * (1 + 1e-9)
                go = ~(squares - 2 * (self.q[who] @ self.p[part].T) > wanted + 1e-11 * squares)
            go &= self.ids[part][None] != self.qid[who][:, None]
            some = np.flatnonzero(go.any(1))
            if not len(some):
                continue
            i, j = np.nonzero(go[some])
            d, ids = np.full((len(some), len(part)), np.inf), np.full((len(some), len(part)), np.iinfo(np.int64).max)
            d[i, j], ids[i, j] = pair_distances(self.q[who[some[i]]], self.p[part[j]]), self.ids[part[j]]
            own = who[some]
            dist, best = np.concatenate((self.dist[own], d), 1), np.concatenate((self.best[own], ids), 1)
            keep = np.lexsort((best, dist), axis=1)[:, : self.k]
            self.dist[own], self.best[own] = np.take_along_axis(dist, keep, 1), np.take_along_axis(best, keep, 1)

    def visit(self, at: int, who: np.ndarray) -> None:
        vantage, left, right, start, end, llo, lhi, rlo, rhi = self.t["nodes"][at]
        if vantage < 0:
            for a in range(0, len(who), BLOCK):
                self.offer(who[a : a + BLOCK], self.t["order"][int(start) : int(end)])
            return
        self.offer(who, np.array([int(vantage)]))
        d = distances(self.q[who], self.p[int(vantage)][None])[:, 0]
        with np.errstate(invalid="ignore"):
            near_left = d - lhi <= rlo - d
        for first in (True, False):
            side = who[near_left == first]
            far = d[near_left == first]
            for child, lo, hi in (((left, llo, lhi), (right, rlo, rhi)) if first else ((right, rlo, rhi), (left, llo, lhi))):
                go = _may_hold(far, lo, hi, np.minimum(self.dist[side, -1], self.limit[side]), self.relax)
                if go.any():
                    self.visit(int(child), side[go])


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column) -> np.ndarray:
    col = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


class Index:
    """Trees (dim, cell, salt, tree), the salts of each cell, and the pivots with the distances of their members."""

    def __init__(self, trees: DataFrame, sizes: DataFrame, pivots: dict[int, np.ndarray], reach: dict[int, np.ndarray]) -> None:
        self.trees, self.sizes, self.pivots, self.reach = trees, sizes, pivots, reach


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance) of a batch of points of one length."""
    with np.errstate(over="ignore", invalid="ignore"):
        at = ((pivots * pivots).sum(1)[None] - 2 * (points @ pivots.T)).argmin(1)  # near enough: the distance kept is that to the pivot named
    return at, pair_distances(points, pivots[at])


def _groups(dims: np.ndarray):
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _cells(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell and far, the distance to its pivot; lengths without a pivot are one cell, -1."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cell, far = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for dim, rows in _groups(b.column("dim").to_numpy()):
                if dim in pivots:
                    for at in range(0, len(rows), 2048):
                        part = rows[at : at + 2048]
                        cell[part], far[part] = _nearest(_matrix(b.column("v").take(pa.array(part))), pivots[dim])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    return vectors.select("vec_id", "dim", "v").mapInArrow(run, "vec_id long, dim int, v array<double>, cell int, far double")


def index(vectors: DataFrame, shard: int | None = None, cells: int = CELLS) -> Index:
    """One tree a shard; fitted on at most ``cells`` pivots, taken in hash order.  Every vector is in a tree."""
    shard = shard or SHARD
    n = min(cells, max(1, -(-vectors.count() // shard)))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()  # at most ``cells`` vectors
    pivots = {dim: np.array([r.v for r in rows if r.dim == dim]) for dim in {r.dim for r in rows}}
    placed = saved(_cells(vectors, pivots))
    sizes = saved(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("salts"), F.min("far").alias("lo"), F.max("far").alias("hi")))
    reach = {dim: np.array([[np.inf, -np.inf]] * len(p)) for dim, p in pivots.items()}
    for r in sizes.filter("cell >= 0").collect():  # a row for each pivot
        reach[r.dim][r.cell] = r.lo, r.hi

    def one(t):
        import pyarrow as pa

        t = t.sort_by("vec_id")
        points = _matrix(t["v"])
        tree = build(points)
        return pa.table({"dim": t["dim"][:1], "cell": t["cell"][:1], "salt": t["salt"][:1], "tree": pa.array([_packed(ids=t["vec_id"].to_numpy(), points=points, **tree)], pa.binary())})

    dealt = placed.join(sizes.select("dim", "cell", "salts"), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    trees = dealt.select("vec_id", "dim", "v", "cell", "salt").groupBy("dim", "cell", "salt").applyInArrow(one, "dim int, cell int, salt int, tree binary")
    return Index(saved(trees), sizes.select("dim", "cell", "salts"), pivots, reach)


def _routes(queries: DataFrame, made: Index, relax: float, first: bool) -> DataFrame:
    """(vec_id, dim, v, limit, cell): the nearest cell of each query, or else all others that may hold something within its limit."""
    pivots, reach = made.pivots, made.reach

    def run(batches):
        import pyarrow as pa

        for b in batches:
            limit = b.column("limit").to_numpy(zero_copy_only=False)
            for dim, rows in _groups(b.column("dim").to_numpy()):
                if dim not in pivots:
                    who, cell = rows if first else rows[:0], np.full(len(rows) if first else 0, -1)
                else:
                    d = distances(_matrix(b.column("v").take(pa.array(rows))), pivots[dim])
                    lo, hi = reach[dim].T
                    home = np.where(np.isfinite(lo), d, np.inf).argmin(1)
                    if first:
                        who, cell = rows, home
                    else:
                        go = _may_hold(d, lo[None], hi[None], limit[rows][:, None], relax) & np.isfinite(lo)[None]
                        at, cell = np.nonzero(go)
                        who = rows[at]
                for at in range(0, len(who), 4096):
                    part = b.take(pa.array(who[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[at : at + 4096], pa.int32())], names=[*b.schema.names, "cell"])

    return queries.select("vec_id", "dim", "v", "limit").mapInArrow(run, "vec_id long, dim int, v array<double>, limit double, cell int")


def _visit(made: Index, routes: DataFrame, waves: int, k: int, relax: float) -> DataFrame:
    """(query_id, vec_id, score): the k best of each visited shard for routes (vec_id, dim, v, limit, cell, salt)."""

    def run(trees, asked):
        import pyarrow as pa

        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not trees.num_rows or not asked.num_rows:
            return none
        tree, parts = np.load(io.BytesIO(trees["tree"][0].as_py())), [none]
        for at in range(0, asked.num_rows, BLOCK):
            t = asked.slice(at, BLOCK)
            qid, q, limit = t["vec_id"].to_numpy(), _matrix(t["v"]), t["limit"].to_numpy()
            s = Search({"order": tree["order"], "nodes": tree["nodes"]}, tree["ids"], tree["points"], qid, q, k, relax, limit)
            hit = s.best != np.iinfo(np.int64).max
            parts.append(pa.table({"query_id": np.repeat(qid, k)[hit.ravel()], "vec_id": s.best[hit], "score": s.dist[hit]}))
        return pa.concat_tables(parts)

    keys = ["dim", "cell", "salt", "wave"]
    asked = routes.withColumn("wave", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(waves)).cast("int"))
    trees = made.trees.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    return trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def search(made: Index, queries: DataFrame, k: int = 10, relax: float = 1.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (vec_id, dim, v)."""
    waves = max(1, -(-queries.count() // WAVE))
    open_ = queries.withColumn("limit", F.lit(float("inf")))
    home = _routes(open_, made, relax, True).join(made.sizes, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("salts")).cast("int"))
    home = saved(home.drop("salts"))
    first = saved(_visit(made, home, waves, k, relax))
    limits = _best(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("kth"))
    limits = limits.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") == k, F.col("kth")).otherwise(float("inf")).alias("limit"))
    bounded = queries.join(limits, "vec_id", "left").fillna(float("inf"), ["limit"])
    rest = _routes(bounded, made, relax, False).unionByName(_unplaced(bounded, made)).join(made.sizes, ["dim", "cell"])
    rest = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    rest = rest.join(home.select("vec_id", "dim", "cell", "salt"), ["vec_id", "dim", "cell", "salt"], "left_anti")
    return _best(first.unionByName(_visit(made, rest, waves, k, relax)), k)


def _unplaced(queries: DataFrame, made: Index) -> DataFrame:
    """Routes to the one cell of lengths that no pivot has."""
    known = list(made.pivots) or [-1]
    return queries.filter(~F.col("dim").isin(known)).select("vec_id", "dim", "v", "limit", F.lit(-1).alias("cell"))
