"""Hard negatives by largest inner product, searched through one-dimensional distance keys.

Every vector x gets one more component, the root of (largest squared norm - its own squared norm).  All then lie
on one sphere, and the squared distance of a query (with 0 there) to x is a constant less twice their
inner product: the largest products are the nearest neighbours.  A vector's key is (pivot, distance
to it) for its nearest pivot; the pivots are a bounded sample.  The table is stored sorted by that key, cut into blocks
of about BYTES, each with the interval of its keys.

A search first scans the block at the query's own key, then the key intervals within a growing
radius around its distance to every pivot: a vector within r of the query lies, by the triangle
inequality, in the annulus [d - r, d + r] of its pivot.  Each query stops when its k-th distance, or that of the least score it wants, is
no more than the radius: what was not scanned is farther.  Scores are whole numbers, computed exactly; distances
only rule blocks and rows out, with a margin for their rounding.  Only (query, block) rows travel; a
block meets its queries in one place, in waves of at most WAVE of them.  Nothing is capped: where the keys rule nothing
out, every block is scanned.

Defined results: rows whose id, label or vector is null, or that hold a null or non-finite component, take no part; nor do those
whose scaled squared norm passes 2**55, whose products would not fit; of rows that repeat an id the
smallest (vector, label) stays; vectors of different lengths are never compared; a zero vector takes part, with score 0 to all;
ties go to the smaller id; fewer candidates than asked for give fewer rows; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved

BYTES = 1 << 19  #: of vectors in a block
PIVOTS = 64  #: at most: the bound of the sample that the keys are made with and of what travels with a task
WAVE = 16_384  #: queries that meet a block in one task
FAR = 1 << 61
STEPS = (0.5, 1.0)  #: parts of the radius that would certify a query


def whole(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, dim, v, norm2): floor(scale * component) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = vectors.filter("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).filter(~bad)
    ok = ok.filter(F.aggregate("x", F.lit(0.0), lambda t, c: t + c * scale * c * scale) < float(1 << 55) / 4)
    ok = ok.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).cast("array<int>").alias("v"))
    one = ok.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("m")).select("vec_id", "m.label", "m.v")
    norm2 = F.aggregate(F.col("v").cast("array<long>"), F.lit(0).cast("long"), lambda t, c: t + c * c)
    return one.select("vec_id", "label", F.size("v").alias("dim"), "v", norm2.alias("norm2"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) inner products, exactly."""
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if a.shape[1] * big < 2**53:  # every sum is then a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _matrix(column, dim: int) -> np.ndarray:
    col = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _to_pivots(v: np.ndarray, norm2: np.ndarray, extra: np.ndarray, pivots: np.ndarray, top: int) -> np.ndarray:
    """Distances of vectors with the given additional component to the pivots with theirs."""
    own = (pivots.astype(np.int64) ** 2).sum(1)
    square = (norm2[:, None] + own[None] - 2 * products(v, pivots)).astype(np.float64) + (extra[:, None] - np.sqrt(np.maximum(top - own, 0))[None]) ** 2
    return np.sqrt(np.maximum(square, 0))


class Index:
    """Blocks (block, dim, pack), their directory (block, dim, pivot, lo, hi), the pivots by dim, and the largest squared norm."""

    def __init__(self, vectors: DataFrame, blocks: DataFrame, pivots: dict[int, np.ndarray], top: int) -> None:
        self.vectors, self.blocks, self.pivots, self.top = vectors, blocks.select("block", "dim", "pack"), pivots, top
        self.directory = blocks.select("block", F.col("dim").alias("of_dim"), F.col("pivot").alias("of_pivot"), "lo", "hi")


def index(vectors: DataFrame, per_pivot: int = 8192) -> Index:
    """Blocks of every vector of ``vectors`` (vec_id, label, dim, v, norm2), a saved table, sorted by (pivot, distance)."""
    n, top, width = vectors.agg(F.count(F.lit(1)), F.max("norm2"), F.max("dim")).first()
    top = int(top or 0)
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("dim", "v").limit(min(PIVOTS, -(-n // per_pivot)) if n else 1).collect()  # PIVOTS rows at most
    pivots = {dim: np.array([r.v for r in few if r.dim == dim], dtype=np.int64).reshape(-1, dim) for dim in {r.dim for r in few}}

    def keyed(batches):
        import pyarrow as pa

        for b in batches:
            pivot, dist, dims, norm2 = np.full(b.num_rows, -1, dtype=np.int32), np.zeros(b.num_rows), b.column("dim").to_numpy(), b.column("norm2").to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) in pivots:
                    for at in range(0, len(rows), 2048):
                        part = rows[at : at + 2048]
                        d = _to_pivots(_matrix(b.column("v").take(pa.array(part)), int(dim)), norm2[part], np.sqrt(np.maximum(top - norm2[part], 0)), pivots[int(dim)], top)
                        pivot[part] = d.argmin(1)
                        dist[part] = d[np.arange(len(part)), pivot[part]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("vec_id", "label", "dim", "v")], pa.array(pivot), pa.array(dist)], names=["vec_id", "label", "dim", "v", "pivot", "dist"])

    placed = vectors.mapInArrow(keyed, "vec_id long, label long, dim int, v array<int>, pivot int, dist double")
    parts = max(1, -(-n * (4 * (width or 0) + 24) // (4 * BYTES)))
    placed = placed.repartitionByRange(parts, "dim", "pivot", "dist", "vec_id").sortWithinPartitions("dim", "pivot", "dist", "vec_id")

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        made, held, of = TaskContext.get().partitionId() << 32, [], None
        size = lambda: sum(h.num_rows for h in held)

        def block():
            nonlocal made, held
            t, held = pa.Table.from_batches(held), []
            dist = t["dist"].to_numpy()
            out = io.BytesIO()
            np.savez(out, ids=t["vec_id"].to_numpy(), labels=t["label"].to_numpy(), dist=dist, v=_matrix(t["v"], of[0]))
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([of[0]], pa.int32()), pa.array([of[1]], pa.int32()), pa.array([dist[0]]), pa.array([dist[-1]]), pa.array([out.getvalue()], pa.binary())], names=["block", "dim", "pivot", "lo", "hi", "pack"])

        for b in batches:
            key = np.stack((b.column("dim").to_numpy(), b.column("pivot").to_numpy()), 1)
            at = 0
            while at < b.num_rows:
                here = (int(key[at][0]), int(key[at][1]))
                if held and (here != of or size() >= limit):
                    yield block()
                of, limit = here, max(64, BYTES // (4 * here[0] + 24))
                same = (key[at:] == key[at]).all(1)
                run = len(same) if same.all() else int(same.argmin())
                take = min(run, limit - size())
                held.append(b.slice(at, take))
                at += take
        if held:
            yield block()

    return Index(vectors, saved(placed.mapInArrow(cut, "block long, dim int, pivot int, lo double, hi double, pack binary")), pivots, top)


def _distances(made: Index, queries: DataFrame) -> DataFrame:
    """(vec_id, dim, pivot, d): each query's distance to every pivot of its length; lengths without one have pivot -1."""
    pivots, top = made.pivots, made.top

    def run(batches):
        import pyarrow as pa

        for b in batches:
            dims, ids, norm2 = b.column("dim").to_numpy(), b.column("vec_id").to_numpy(), b.column("norm2").to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                if int(dim) in pivots:
                    d = _to_pivots(_matrix(b.column("v").take(pa.array(rows)), int(dim)), norm2[rows], np.zeros(len(rows)), pivots[int(dim)], top)
                else:
                    d = np.zeros((len(rows), 1))
                m = d.shape[1]
                pivot = np.arange(m) if int(dim) in pivots else np.array([-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], m)), pa.array(np.full(len(rows) * m, dim), pa.int32()), pa.array(np.tile(pivot, len(rows)), pa.int32()), pa.array(d.ravel())], names=["vec_id", "dim", "pivot", "d"])

    return queries.select("vec_id", "dim", "v", "norm2").mapInArrow(run, "vec_id long, dim int, pivot int, d double")


def best_in_block(block: dict[str, np.ndarray], who: np.ndarray, label: np.ndarray, q: np.ndarray, asker: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, span: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, row of the block, score): the k best of each ask.  Query i is (who, label, q); ask j is of query asker[j], wants scores in [low, high] and looks at the key interval span of its query only."""
    begin, end = (np.searchsorted(block["dist"], s, side) for s, side in zip(span, ("left", "right"), strict=True))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(begin[asker], kind="stable")  # asks with like intervals side by side
    for at in range(0, len(order), 128):
        asks = order[at : at + 128]
        own, back = np.unique(asker[asks], return_inverse=True)
        lo, hi = int(begin[own].min()), int(end[own].max())
        if lo >= hi:
            continue
        score = products(q[own], block["v"][lo:hi])
        wanted = ((block["labels"][None, lo:hi] == label[own][:, None]) == same) & (block["ids"][None, lo:hi] != who[own][:, None])
        place = np.arange(lo, hi)[None]
        wanted &= (place >= begin[own][:, None]) & (place < end[own][:, None])
        score = np.where(wanted, score, -FAR)[back]
        score = np.where((score >= low[asks][:, None]) & (score <= high[asks][:, None]), score, -FAR)
        if hi - lo > k:
            kth = np.partition(score, hi - lo - k, axis=1)[:, hi - lo - k]
            score = np.where(score >= kth[:, None], score, -FAR)
        i, j = np.nonzero(score > -FAR)
        got = score[i, j]
        put = np.lexsort((block["ids"][lo + j], -got, i))  # ties: the smaller id
        i, j, got = i[put], j[put], got[put]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((asks[i[rank < k]], lo + j[rank < k], got[rank < k]))
    return tuple(np.concatenate([o[x] for o in out]) if out else np.zeros(0, dtype=np.int64) for x in range(3))


def _visit(made: Index, routes: DataFrame, waves: int, same: bool, k: int) -> DataFrame:
    """(vec_id, slot, mate, score) for routes (block, vec_id, label, dim, v, d, r, asks)."""

    def run(block, asked):
        import pyarrow as pa

        names = ["vec_id", "slot", "mate", "score"]
        if not block.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
        with np.load(io.BytesIO(block["pack"][0].as_py())) as got:
            b = dict(got)
        lists = asked["asks"].combine_chunks()
        asks, counts = lists.flatten(), lists.value_lengths().to_numpy()
        who, d, r = asked["vec_id"].to_numpy(), asked["d"].to_numpy(), asked["r"].to_numpy()
        asker = np.repeat(np.arange(len(who)), counts)
        low, high = asks.field("low").to_numpy(), asks.field("high").to_numpy()
        q = _matrix(asked["v"], b["v"].shape[1])
        a, row, score = best_in_block(b, who, asked["label"].to_numpy(), q, asker, low, high, same, k, (d - r, d + r))
        return pa.table([pa.array(who[asker[a]]), pa.array(asks.field("slot").to_numpy()[a], pa.int32()), pa.array(b["ids"][row]), pa.array(score)], names=names)

    wave = F.pmod(F.xxhash64("vec_id"), F.lit(waves)).cast("int")
    blocks = made.blocks.withColumn("wave", F.explode(F.sequence(F.lit(0), F.lit(waves - 1))))
    return blocks.groupBy("block", "wave").cogroup(routes.withColumn("wave", wave).groupBy("block", "wave")).applyInArrow(run, "vec_id long, slot int, mate long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "mate"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(made: Index, queries: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """(vec_id, slot, mate, score, rank): for each ask (vec_id, slot, low, high) the k other rows with the largest score in [low, high] among those of the query's label, or of all other labels.

    ``queries`` are rows of the indexed table; a query has few asks.
    """
    queries, asks = saved(queries.select("vec_id", "label", "dim", "v", "norm2")), saved(asks)
    near = saved(_distances(made, queries))
    top, slack = float(made.top), 1e-6 * (made.top**0.5 + 1)
    waves = max(1, -(-queries.count() // WAVE))
    to = F.least("hi", F.greatest("lo", "d"))
    nearest = near.groupBy("vec_id").agg(F.min(F.struct("d", "pivot", "dim")).alias("m")).select("vec_id", "m.*")
    at_key = nearest.join(made.directory, (F.col("dim") == F.col("of_dim")) & (F.col("pivot") == F.col("of_pivot"))).groupBy("vec_id")
    home = saved(at_key.agg(F.min_by("block", F.struct(F.abs(to - F.col("d")), "block")).alias("block")))

    def scan(routes: DataFrame, wanted: DataFrame) -> DataFrame:
        """What the routes (vec_id, block, d, r) find for the asks ``wanted`` (vec_id, slot, low, high)."""
        grouped = wanted.groupBy("vec_id").agg(F.collect_list(F.struct("slot", "low", "high")).alias("asks"))
        return _visit(made, routes.join(queries.select("vec_id", "label", "dim", "v").join(grouped, "vec_id"), "vec_id"), waves, same, k)

    found = saved(_best(scan(home.select("vec_id", "block", F.lit(0.0).alias("d"), F.lit(float("inf")).alias("r")), asks), k).drop("rank"))
    seen, reached, spent = home, None, [queries, asks, near, home]
    for part in STEPS:
        kth = found.groupBy("vec_id", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
        now = asks.join(kth.select("vec_id", "slot", "kth"), ["vec_id", "slot"], "left").join(queries.select("vec_id", "norm2"), "vec_id")
        radius = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.lit(top) + F.col("norm2") - 2 * F.col(s).cast("double")))
        farthest = F.sqrt(F.lit(top)) + F.sqrt(F.col("norm2").cast("double"))
        now = now.withColumn("low", F.greatest("low", F.coalesce("kth", "low"))).withColumn("limit", F.least(radius("low"), farthest) + slack)
        if reached is not None:  # what the radius scanned before certifies is done
            now = now.join(reached, "vec_id", "left").filter(F.col("reached").isNull() | (F.col("limit") > F.col("reached")))
        open_ = saved(now.select("vec_id", "slot", "low", "high", "limit", (radius("high") - slack).alias("inner")))
        spent.append(open_)
        if open_.isEmpty():
            break
        reach = saved(open_.groupBy("vec_id").agg(F.max("limit").alias("limit"), (F.max("limit") * part).alias("reached"), F.min("inner").alias("inner")))
        meets = (F.col("lo") <= F.col("d") + F.col("reached")) & (F.col("hi") >= F.col("d") - F.col("reached")) & ((F.col("pivot") == -1) | (F.col("hi") + F.col("d") >= F.col("inner")))
        routes = near.join(reach, "vec_id").join(made.directory, (F.col("dim") == F.col("of_dim")) & (F.col("pivot") == F.col("of_pivot")) & meets)
        # inside a block the whole limit counts: it is not scanned again
        routes = saved(routes.select("vec_id", "block", "d", F.col("limit").alias("r")).join(seen, ["vec_id", "block"], "left_anti"))
        old, found = found, saved(_best(found.unionByName(scan(routes, open_.select("vec_id", "slot", "low", "high"))), k).drop("rank"))
        seen, reached = seen.unionByName(routes.select("vec_id", "block")), reach.select("vec_id", "reached")
        spent += [old, routes, reach]
    discard(*spent)
    return _best(found, k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors (vec_id) among vectors (vec_id, label, dim, v, norm2).

    A positive is one of the ``n_positives`` best rows of the anchor's label; its negatives are the best rows of other labels
    whose score is between low and high percent of the positive's.  A negative positive score leaves none between.
    """
    vectors = saved(vectors)
    made = index(vectors)
    queries = saved(vectors.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi"))
    first = queries.select("vec_id", F.lit(0).alias("slot"), F.lit(-FAR).alias("low"), F.lit(FAR).alias("high"))
    positives = saved(search(made, queries, first, True, n_positives).select("vec_id", F.col("rank").alias("slot"), F.col("mate").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    bands = positives.filter(p >= 0).select("vec_id", "slot", F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"))
    got = search(made, queries, bands, False, n_negatives)
    discard(vectors, queries, made.blocks)
    out = got.join(positives, ["vec_id", "slot"])
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("mate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
