"""Language identification by error-correcting output codes.

Every language of the labels gets a codeword of +1 and -1 bits: all different splits of the
languages where there are at most five, else a fixed random code, the one of many draws whose
closest codewords lie farthest apart.  One binary n-gram classifier a bit tells the languages with
+1 from those with -1: the log-ratio of their mean n-gram distributions.  These counts come from
all training rows, aggregated by Spark; a document adds its shares of hashed byte 2- to 4-grams, as
integers, so that neither a long document nor the order of rows matters.

A bit's sum over a text, divided by its length and weighed by the root of it, becomes a margin by a
logistic fit on rows that took no part in the counts: at most ``max_rows`` of them, taken in hash
order (the bound of that sample).  Decoding is loss-weighted: the codeword with the smallest sum of
log(1 + exp(-bit * margin)) wins, ties go to the first language by name.  ``score`` is its share of
exp(-loss) among all codewords, ``runner_up`` the next codeword, and ``ambiguous`` says that the two
losses differ by less than ln 3.

Only text and lang of rows whose crc32(doc_id as text) modulo 3 is not 1 are learned from.  Of these,
one id in five (by hash) is for the margins and the others are for the counts.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and not ambiguous;
rows with a null lang, or such texts, are not learned from; a null doc_id counts as an empty one and
is not held out; repeated rows are each learned from in the counts and each get a row; whole texts
are read whatever their length; with one language every text that has a letter is that language
with score 1; without any it is ``und``; an empty table gives an empty result; other columns are
ignored.  More than MAX_LANGS different values of lang are refused: counts of each go to the driver.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, text_bytes

ORDERS = (2, 3, 4)
D = 1 << 15  #: hashed n-grams
SHARE = 1 << 20  #: a document's shares sum up to about this
UNIT = 1 << 12  #: weights are whole multiples of 1 / UNIT, so that sums do not depend on the order
SMOOTH = 0.01  #: part of every distribution that is uniform
LONGEST = 4096  #: n-grams beyond which a longer text makes a margin no wider
MAX_LANGS = 1000
CHUNK = 1 << 17

_SPACE = np.full(256, 32, dtype=np.uint8)  # what is neither a letter of ASCII nor beyond ASCII is a space
_SPACE[97:123], _SPACE[128:] = np.arange(97, 123), np.arange(128, 256)
_SPACE[65:91] = np.arange(97, 123)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """(n, bits) of +1 and -1; every bit splits the languages, no two bits split them alike."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int64)
    rng, bits, best, found = np.random.default_rng(seed), max(15, math.ceil(10 * math.log2(n))), -1, None
    # the first language has +1 throughout, so that no two columns are a split and its mirror image
    splits = np.array([(1, *b) for b in itertools.product((1, -1), repeat=n - 1) if -1 in b]).T if n <= 12 else None
    if n <= 5:
        return splits.astype(np.int64)
    for _ in range(60):
        if splits is not None:
            code = splits[:, np.sort(rng.choice(splits.shape[1], bits, replace=False))]
        else:
            code = np.unique(np.concatenate((np.ones((1, bits), dtype=np.int64), rng.choice((-1, 1), size=(n - 1, bits)))), axis=1)
            if code.shape[1] < bits or (code.sum(0) == n).any():
                continue
        far = (bits - code @ code.T)[np.triu_indices(n, 1)].min() // 2
        if far > best:
            best, found = far, code
    if found is None:
        raise ValueError(f"no code found for {n} languages")
    return found


def grams(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n of ORDERS: (text index, bucket) of the n-grams of lower-cased texts, by text; runs of other ASCII than letters are one space, also around the text."""
    data = _SPACE[np.frombuffer(b" " + b"\n\n".join(texts) + b" ", dtype=np.uint8)]
    lengths = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint32), owner[keep]
    out, code = [], data.copy()
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] | (data[n - 1 :] << np.uint32(8 * (n - 1)))
        if n in ORDERS:
            inside = owner[: len(code)] == owner[n - 1 :]
            mixed = (code[inside] ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out.append((owner[: len(code)][inside], (mixed >> np.uint32(17)).astype(np.int32)))
    return out


def shares(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket, share): a text's n-gram counts times SHARE by its number of n-grams, rounded down."""
    found = grams(texts)
    owner = np.concatenate([o for o, _ in found])
    total = np.bincount(owner, minlength=len(texts))
    keys, count = np.unique(owner * D + np.concatenate([b for _, b in found]), return_counts=True)
    return keys // D, keys % D, count * SHARE // total[keys // D]


def _lower(column):
    import pyarrow.compute as pc

    return text_bytes(pc.utf8_lower(column))


def held_out(c) -> F.Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _has_letter() -> F.Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n): summed shares of the rows (lang, text); a task sends one row for each pair it has."""

    def run(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            names, texts = b.column(0).to_pylist(), _lower(b.column(1))
            for at, part in blocks(texts, 1 << 18):
                for own in sorted({*names[at : at + len(part)]}):
                    some = [t for t, name in zip(part, names[at:], strict=False) if name == own]
                    _, bucket, share = shares(some)
                    sums[own] = sums.get(own, 0) + np.bincount(bucket, share, D).astype(np.int64)
                if len(sums) > 256:
                    yield from flush()
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(D, bits) whole weights from (languages, D) counts: log-ratios of the two sides' mean distributions."""
    p = (1 - SMOOTH) * counts / np.maximum(counts.sum(1, keepdims=True), 1) + SMOOTH / D
    sides = [np.log((code.T == s) @ p / (code.T == s).sum(1)[:, None]) for s in (1, -1)]
    return np.rint((sides[0] - sides[1]).T * UNIT).astype(np.int32)


def evidence(texts: list[bytes], w: np.ndarray) -> np.ndarray:
    """(texts, bits): a bit's mean weight over a text's n-grams, times the root of their number (LONGEST at most)."""
    total, count = np.zeros((len(texts), w.shape[1]), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for owner, bucket in grams(texts):
        count += np.bincount(owner, minlength=len(texts))
        for at in range(0, len(owner), CHUNK):
            o = owner[at : at + CHUNK]
            begin = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
            total[o[begin]] += np.add.reduceat(w[bucket[at : at + CHUNK]], begin, axis=0, dtype=np.int64)
    return total / UNIT / np.maximum(count, 1)[:, None] * np.sqrt(np.minimum(count, LONGEST))[:, None]


def slope_of(x: np.ndarray, y: np.ndarray) -> float:
    """The factor of a margin for y in {-1, 1}: a logistic fit without a shift (a text says nothing of how frequent a language is), drawn a little towards 1 / mean |x|."""
    unit = max(float(np.abs(x).mean()), 1e-9) if len(x) else 1.0
    z, p = x / unit * y, 1.0
    for _ in range(50):
        s = 1 / (1 + np.exp(np.clip(z * p, -30, 30)))
        step = ((z * s).sum() - (p - 1)) / ((z * z * s * (1 - s)).sum() + 1)
        p = max(p + float(np.clip(step, -1, 1)), 1e-3)
        if abs(step) < 1e-9:
            break
    return p / unit


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best, score, next, gap): the codeword of the smallest loss, its share, the second one and how much more it loses."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None]).sum(2)
    order = np.argsort(loss, axis=1, kind="stable")
    low = np.take_along_axis(loss, order, 1)
    share = 1 / np.exp(low[:, :1] - low).sum(1)
    return order[:, 0], share, order[:, min(1, loss.shape[1] - 1)], low[:, min(1, loss.shape[1] - 1)] - low[:, 0]


def train(docs: DataFrame, max_rows: int = 4000) -> dict:
    """Counts over all training rows; margins from at most ``max_rows`` others, one row a doc_id."""
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & _has_letter()).select("doc_id", "lang", "text")
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)) == 0
    names = [r.lang for r in rows.select("lang").distinct().orderBy("lang").limit(MAX_LANGS + 1).collect()]
    if len(names) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    code = codewords(len(names))
    if len(names) < 2:
        return {"names": names, "code": code, "w": np.zeros((D, 0), np.int32), "slope": np.zeros(0)}
    got, counts = _counts(rows.filter(~apart)).toArrow(), np.zeros((len(names), D))
    counts[np.searchsorted(np.array(names, dtype=object), np.array(got["lang"].to_pylist(), dtype=object)), got["bucket"].to_numpy()] = got["n"].to_numpy()
    w, slope = weights(counts, code), np.ones(code.shape[1])
    some = rows.filter(apart).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    one = rows.join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("d")).select("d.lang", "d.text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, part in blocks(_lower(b.column(1)), 1 << 18):
                x = evidence(part, w)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    margins = one.mapInArrow(run, "lang string, x binary").toArrow()  # max_rows rows at most
    if margins.num_rows:
        x = np.array([np.frombuffer(r) for r in margins["x"].to_pylist()])
        y = code[np.searchsorted(np.array(names, dtype=object), np.array(margins["lang"].to_pylist(), dtype=object))]
        slope = np.array([slope_of(x[:, k], y[:, k]) for k in range(code.shape[1])])
    return {"names": names, "code": code, "w": w, "slope": slope}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, runner_up, ambiguous) per row."""
    names, code = model["names"], model["code"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lettered, texts = b.column(2).to_numpy(zero_copy_only=False), _lower(b.column(1))
            for at, part in blocks(texts, 1 << 18):
                ok = lettered[at : at + len(part)] & bool(names)
                pred, score, second, close = np.full(len(part), "und", dtype=object), np.zeros(len(part)), np.full(len(part), None, dtype=object), np.zeros(len(part), dtype=bool)
                if len(names) == 1:
                    pred[ok], score[ok] = names[0], 1.0
                elif ok.any():
                    x = evidence([t for t, o in zip(part, ok, strict=True) if o], model["w"])
                    best, share, other, gap = decode(x * model["slope"], code)
                    named = np.array(names, dtype=object)
                    pred[ok], score[ok], second[ok], close[ok] = named[best], share, named[other], gap < math.log(3)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score), pa.array(second, pa.string()), pa.array(close)], names=["doc_id", "lang_pred", "score", "runner_up", "ambiguous"])

    slim = docs.select("doc_id", "text", _has_letter().alias("lettered"))
    got = slim.mapInArrow(run, "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")
