"""Quality classifier: a factorisation machine over hashed words, text structure and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum costs time
linear in the features by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
Features: word buckets (unit-length counts), structure statistics of the text, and the row's
``n_chars`` as metadata.  Labels, lang, source and doc_id are never inputs.

The machine is fitted on a bounded sample: at most ``max_rows`` labelled rows outside the
held-out fold (crc32 of doc_id as text, modulo 5, is 0), taken in hash order.  Every document
is scored, over its whole text.

Defined results: null text counts as empty and is scored like any other; null n_chars counts as
the text's own length; labels that are null or whose document is absent are not learned from; a
document labelled twice is learned from twice; of rows that repeat a doc_id the smallest text is
learned from, and each is scored; with no label of one class every score is the
other's share; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_VALUES, blocks, fresh, prefix_sums, range_hashes, saved, text_bytes, words_of

BUCKETS = 1 << 13
FACTORS = 8
STATS = 14
D = BUCKETS + STATS

_CLASS = np.zeros(256, dtype=np.uint8)  # 1 digit, 2 upper, 3 lower, 4 space, 5 sentence mark, 6 other ASCII, 7 beyond ASCII
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[33, 44, 46, 58, 59, 63]] = 5
_CLASS[_CLASS == 0] = 6


def featurise(texts: list[bytes], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a block of whole texts: (row, column, value), sorted by row."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ws, we = words_of(data)
    doc = np.searchsorted(starts, ws, side="right") - 1
    hashes = range_hashes(prefix_sums(data, LOWER_VALUES), ws, we)
    keys, counts = np.unique(doc * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    row, col = keys // BUCKETS, keys % BUCKETS
    norm = np.sqrt(np.bincount(row, counts.astype(float) ** 2, n))
    val = counts / norm[row]
    words = np.bincount(doc, minlength=n).astype(float)
    kinds = np.zeros((n, 8))
    owner = np.repeat(np.arange(n), lengths + 1)
    np.add(kinds, np.bincount(owner * 8 + _CLASS[data], minlength=n * 8).reshape(n, 8), out=kinds)
    kinds[:, 4] -= 1  # the line feed that ends each text here
    size = np.maximum(lengths, 1)
    lines = np.bincount(owner[data == 10], minlength=n)
    pipes = np.bincount(owner[(data == 124) | (data == 35) | (data == 123) | (data == 60)], minlength=n)
    word_len = (we - ws).astype(float)
    total_len = np.bincount(doc, word_len, n)
    mean_len = total_len / np.maximum(words, 1)
    var_len = np.bincount(doc, word_len**2, n) / np.maximum(words, 1) - mean_len**2
    last = data[np.maximum(we - 1, 0)]
    ended = np.bincount(doc, _CLASS[last] == 5, n) / np.maximum(words, 1)
    meta = np.array([lengths[i] if c is None else max(0, c) for i, c in enumerate(n_chars)], dtype=float)
    stats = np.stack([
        np.log1p(lengths) / 10, mean_len / 10, np.sqrt(np.maximum(var_len, 0)) / 10, np.bincount(row, minlength=n) / np.maximum(words, 1),
        kinds[:, 1] / size * 5, kinds[:, 2] / size * 5, kinds[:, 4] / size * 3, kinds[:, 5] / size * 10, kinds[:, 6] / size * 10, kinds[:, 7] / size * 3,
        lines / np.maximum(words, 1) * 5, pipes / np.maximum(words, 1), ended * 3, np.log1p(meta) / 10,
    ], axis=1)
    stats = np.clip(stats, 0, 3)
    row = np.concatenate((row, np.repeat(np.arange(n), STATS)))
    col = np.concatenate((col, np.tile(np.arange(BUCKETS, D), n)))
    val = np.concatenate((val, stats.ravel()))
    order = np.argsort(row, kind="stable")
    return row[order], col[order], val[order].astype(np.float32)


def raw_score(model: dict, row: np.ndarray, col: np.ndarray, val: np.ndarray) -> np.ndarray:
    """The machine's sum for each row, in linear time; every row has at least its statistics."""
    at = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
    vx = model["v"][col] * val[:, None]
    pair = np.add.reduceat(vx, at) ** 2 - np.add.reduceat(vx * vx, at)
    return model["w0"] + np.add.reduceat(model["w"][col] * val, at) + 0.5 * pair.sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, batch: int = 64, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> dict:
    """Adagrad on the mean log-loss; rows are (columns, values, label)."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(np.mean([y for *_, y in rows]) if rows else 0.5, 1e-3, 1 - 1e-3))
    m = {"w0": np.log(share / (1 - share)), "w": np.zeros(D), "v": rng.normal(0, 0.01, (D, FACTORS))}
    if len({y for *_, y in rows}) < 2:
        return m | {"v": m["v"] * 0}
    gw, gv, g0 = np.full(D, 1e-4), np.full((D, FACTORS), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            part = [rows[i] for i in order[a : a + batch]]
            row = np.repeat(np.arange(len(part)), [len(c) for c, *_ in part])
            col = np.concatenate([c for c, *_ in part])
            val = np.concatenate([v for _, v, _ in part]).astype(float)
            y = np.array([t for *_, t in part])
            err = ((sigmoid(raw_score(m, row, col, val)) - y) / len(part))[row]
            at = np.flatnonzero(np.concatenate(([True], np.diff(row) > 0)))
            vx = m["v"][col] * val[:, None]
            sums = np.add.reduceat(vx, at)[row]
            used, back = np.unique(col, return_inverse=True)
            dw = np.bincount(back, err * val) + l2 * m["w"][used]
            dv = np.stack([np.bincount(back, err * val * (sums[:, f] - vx[:, f])) for f in range(FACTORS)], 1) + l2 * m["v"][used]
            gw[used] += dw**2
            gv[used] += dv**2
            m["w"][used] -= rate * dw / np.sqrt(gw[used])
            m["v"][used] -= rate * dv / np.sqrt(gv[used])
            d0 = err[at].sum()
            g0 += d0**2
            m["w0"] -= rate * d0 / np.sqrt(g0)
    return m


def held_out(c) -> F.Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, chars, y = text_bytes(b.column(1)), b.column(2).to_pylist(), b.column(0)
            for at, part in blocks(texts):
                row, col, val = featurise(part, chars[at : at + len(part)])
                cut = np.searchsorted(row, np.arange(len(part) + 1))
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_arrays([y.slice(at, len(part)), pa.array([col[s:e].astype(np.int32).tobytes() for s, e in spans], pa.binary()), pa.array([val[s:e].tobytes() for s, e in spans], pa.binary())], names=["quality", "cols", "vals"])

    return docs.select("quality", "text", "n_chars").mapInArrow(run, "quality int, cols binary, vals binary")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> dict:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold (hash order; the bound of the sample)."""
    usable = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    some = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    chosen = saved(some)  # max_rows rows at most
    text = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars")).alias("d"))
    # of rows that repeat a doc_id one is learned from, so that no more than max_rows come back
    one = text.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("d").alias("d"))
    got = _features(one.join(F.broadcast(chosen), "doc_id").select("quality", "d.text", "d.n_chars")).collect()
    rows = [(np.frombuffer(r.cols, np.int32), np.frombuffer(r.vals, np.float32), float(r.quality)) for r in got]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[1].tobytes()))
    m = fit(rows)
    return {"w0": np.float32(m["w0"]), "w": m["w"].astype(np.float32), "v": m["v"].astype(np.float32)}


def score(docs: DataFrame, model: dict, threshold: float = 0.3, keep_columns: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; with keep_columns the rows themselves plus fm_score (underscores added where docs has that column)."""
    import pyarrow as pa

    def scored(b):
        i = {n: k for k, n in enumerate(b.schema.names)}
        texts, chars = text_bytes(b.column(i["text"])), b.column(i["n_chars"]).to_pylist()
        out = [sigmoid(raw_score(model, *featurise(part, chars[at : at + len(part)]))) for at, part in blocks(texts)]
        return np.concatenate(out) if out else np.zeros(0)

    if keep_columns:
        name = fresh("fm_score", docs.columns)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scored(b))], names=[*b.schema.names, name])

        return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)

    def slim(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scored(b))], names=["doc_id", "score"])

    got = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(slim, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
