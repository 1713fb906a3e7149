"""Embedding, logit and frame arithmetic on arrays, as column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .perm import N, PERMS

PAIRS = list(itertools.combinations(range(N), 2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean(xs: list[Column]) -> Column:
    total = xs[0]
    for x in xs[1:]:
        total = total + x
    return total / float(len(xs))


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def frame_similarity(frames: list[Column]) -> dict[str, Column]:
    """Over the six pairs of frames: greatest, mean and least cosine (unit vectors)."""
    sims = [dot(frames[i], frames[j]) for i, j in PAIRS]
    return {"ff_max": F.greatest(*sims), "ff_mean": mean(sims), "ff_min": F.least(*sims)}


def per_frame_similarity(frames: list[Column], i: int) -> tuple[Column, Column, Column]:
    """Greatest, mean and least cosine of one frame to the others."""
    sims = [dot(frames[i], frames[j]) for j in range(N) if j != i]
    return F.greatest(*sims), mean(sims), F.least(*sims)


def event_match(frame: Column, events: list[Column]) -> tuple[Column, Column, Column]:
    """(best event from 0, its similarity, margin to the second; 0 with fewer than two events)."""
    sims = F.array(*[dot(frame, e) for e in events])
    ranked = F.sort_array(sims, asc=False)
    margin = F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1)) if len(events) > 1 else F.lit(0.0)
    return (F.array_position(sims, F.array_max(sims)) - 1).cast("int"), F.array_max(sims), margin


def collision(best: list[Column], n_events: int) -> Column:
    """Most frames that share one best event."""
    return F.greatest(*[sum((b == e).cast("int") for b in best) for e in range(n_events)]) if n_events > 1 else F.lit(len(best))


def pad_events(events: Column, width: int, empty: Column) -> tuple[Column, Column]:
    """The first ``width`` events, padded with ``empty``, and their mask."""
    cut = F.slice(events, 1, width)
    gap = F.lit(width) - F.size(cut)
    return F.concat(cut, F.array_repeat(empty, gap)), F.concat(F.array_repeat(F.lit(True), F.size(cut)), F.array_repeat(F.lit(False), gap))


def log_softmax(row: Column) -> Column:
    top = F.array_max(row)
    lse = F.log(F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return F.transform(row, lambda x: x - lse)


def perm_scores(logits: Column) -> Column:
    """Sum over frames of the log-probability of their rank, for the 24 ranks in order."""
    rows = F.transform(logits, log_softmax)
    cell = lambda ls, i, r: F.get(F.get(ls, F.lit(i)), F.lit(r - 1))
    # one let-binding through a one-element array, so that the softmax is computed once
    scored = F.transform(F.array(rows), lambda ls: F.array(*[cell(ls, 0, p[0]) + cell(ls, 1, p[1]) + cell(ls, 2, p[2]) + cell(ls, 3, p[3]) for p in PERMS]))
    return F.get(scored, F.lit(0))


def perm_nll(scores: Column, target: Column, smoothing: float = 0.05) -> Column:
    """Label-smoothed cross-entropy over the 24 ranks."""
    ls = log_softmax(scores)
    average = F.aggregate(ls, F.lit(0.0), lambda s, x: s - x) / float(len(PERMS))
    return (1 - smoothing) * -F.get(ls, target.cast("int")) + smoothing * average


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gate_loss(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, positives weighted."""
    return F.when(target, pos_weight * softplus(-logit)).otherwise(softplus(logit))


def frame_loss(logits: Column, rank: Column) -> Column:
    """Mean cross-entropy of each frame's position."""
    rows = F.transform(logits, log_softmax)
    cells = [-F.get(F.get(rows, F.lit(i)), F.get(rank, F.lit(i)) - 1) for i in range(N)]
    return mean(cells)


def best_index(scores: Column, ban_identity: bool) -> Column:
    """First index of the greatest score; index 0, the identity, can be banned."""
    s = F.transform(scores, lambda x, i: F.when(i == 0, float("-inf")).otherwise(x)) if ban_identity else scores
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


# ---- gray frames: array<array<int>> ----------------------------------------------------------


def _flat(gray: Column) -> Column:
    return F.transform(F.flatten(gray), lambda x: x.cast("double"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def pixel_std(gray: Column) -> Column:
    """Population standard deviation, in one pass over the pixels (their sums are exact)."""
    flat = _flat(gray)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    add = lambda t, x: F.struct((t["n"] + 1).alias("n"), (t["s"] + x).alias("s"), (t["q"] + x * x).alias("q"))
    return F.aggregate(flat, zero, add, lambda t: F.sqrt(F.greatest(F.lit(0.0), t["q"] / t["n"] - (t["s"] / t["n"]) * (t["s"] / t["n"]))))


def entropy(gray: Column, bins: int = 64) -> Column:
    """Bits of the histogram over [0, 255]."""
    cells = F.transform(_flat(gray), lambda v: F.least(F.floor(v * bins / 255.0), F.lit(bins - 1).cast("long")))
    # bound to a name once, so that the cells are not computed again for each bin
    held = F.transform(F.array(cells), lambda at: F.transform(F.array_distinct(at), lambda b: F.size(F.filter(at, lambda x: x == b)) / F.size(at)))
    return F.aggregate(F.get(held, F.lit(0)), F.lit(0.0), lambda s, p: s - p * F.log2(p))


def is_low_info(gray: Column, threshold: float = 10.0) -> Column:
    return pixel_std(gray) < threshold


def letterbox(gray: Column, dark: float = 8.0) -> tuple[Column, Column]:
    """(top, bottom): dark rows from either edge, a third of the height at most."""
    bright = F.transform(gray, lambda row: _mean(F.transform(row, lambda x: x.cast("double"))) >= dark)
    most = F.floor(F.size(gray) / 3).cast("int")

    def run(flags: Column) -> Column:
        first = F.array_position(flags, F.lit(True)).cast("int")
        return F.least(F.when(first == 0, F.size(flags)).otherwise(first - 1), most)

    return run(bright), run(F.reverse(bright))


def crop(gray: Column, top: Column, bottom: Column) -> Column:
    return F.slice(gray, top + 1, F.size(gray) - top - bottom)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cap_pixels(width: Column, height: Column, limit: int = 250_880) -> tuple[Column, Column]:
    """Dimensions scaled down to the pixel limit, truncated, at least 1; never up."""
    scale = F.sqrt(F.lit(float(limit)) / (width * height))
    small = lambda x: F.greatest(F.lit(1), F.floor(x * scale).cast("int"))
    over = width * height > limit
    return F.when(over, small(width)).otherwise(width), F.when(over, small(height)).otherwise(height)
