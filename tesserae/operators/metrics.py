"""Scores of predictions against truth, and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.perm import identity, is_valid, kendall_tau
from ..sources.tables import saved


def scored(pred: DataFrame, truth: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """truth (id, truth, no_ordering) with rank, em, tau and the columns of pred to keep; raises where a prediction is missing or no permutation."""
    x = truth.join(pred.select("id", "rank", *keep), "id", "left")
    ok = F.when(is_valid(F.col("rank")), F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("missing or invalid prediction: "), F.col("id").cast("string"))).cast("array<int>"))
    x = x.withColumn("rank", ok)
    return x.withColumn("em", (F.col("rank") == F.col("truth")).cast("int")).withColumn("tau", kendall_tau(F.col("rank"), F.col("truth")))


def evaluate(s: DataFrame) -> DataFrame:
    """One row over scored rows; a ratio without denominator is NaN."""
    nan = F.lit(float("nan"))
    flag = F.col("rank") == identity()
    ratio = lambda top, bottom: F.coalesce(F.avg(F.when(bottom, top.cast("double"))), nan)
    no = F.col("no_ordering")
    return s.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg("em"), nan), 6).alias("em"),
        F.round(F.coalesce(F.avg("tau"), nan), 6).alias("kendall_tau"),
        F.round(F.coalesce(F.avg(flag.cast("double")), nan), 6).alias("identity_rate"),
        F.round(ratio(F.col("em"), ~no), 6).alias("em_orderable"),
        F.round(ratio(F.col("em"), no), 6).alias("em_no_ordering"),
        F.round(ratio(no, flag), 6).alias("gate_precision"),
        F.round(ratio(flag, no), 6).alias("gate_recall"),
    )


def em_by(s: DataFrame, column: str, bins: DataFrame | None = None) -> DataFrame:
    """(column, n, em, no_ordering_rate); with ``bins`` (one row per value) empty ones stay, with NaN means."""
    g = s.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg("em").alias("em"), F.avg(F.col("no_ordering").cast("double")).alias("no_ordering_rate"))
    if bins is not None:
        g = F.broadcast(bins.select(column)).join(g, column, "left")
    nan = F.lit(float("nan"))
    return g.select(column, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("em", nan), 4).alias("em"), F.round(F.coalesce("no_ordering_rate", nan), 4).alias("no_ordering_rate"))


def project(val: DataFrame, test: DataFrame) -> DataFrame:
    """(projected, val_em): the val EM per consensus level weighted by the test levels; unseen levels take the overall EM."""
    level = val.groupBy("consensus").agg(F.avg("em").alias("em"))
    overall = val.agg(F.avg("em").alias("val_em"))
    dist = test.groupBy("consensus").agg(F.count(F.lit(1)).alias("n"))
    x = dist.join(level, "consensus", "left").crossJoin(F.broadcast(overall))
    return x.groupBy("val_em").agg((F.sum(F.col("n") * F.coalesce("em", "val_em")) / F.sum("n")).alias("p")).select(F.round("p", 4).alias("projected"), F.round("val_em", 4).alias("val_em"))


def one_to_one(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner join that raises if either side repeats a key or the left finds no match."""
    single = lambda d, side: d.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side} repeats a key")).isNotNull()).otherwise(True)).select(key)
    l, r = left.join(single(left, "left"), key, "left_semi"), right.join(single(right, "right"), key, "left_semi")
    hit = r.withColumn("_hit", F.lit(1))
    return l.join(hit, key, "left").filter(F.when(F.col("_hit").isNull(), F.raise_error(F.lit("no match for a key")).isNotNull()).otherwise(True)).drop("_hit")


def order_statistics(df: DataFrame, column: str, places: list[int], few: int = 10_000, accuracy: int = 1000) -> dict[int, float]:
    """The values at given places (from 0) of the sorted non-null column, exactly, without a buffer of its values.

    A mergeable quantile summary names two values around each place; one pass counts what lies below
    and between them, and the range narrows until it has at most ``few`` different values, which are counted.
    """
    x = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    spans = {k: (None, None) for k in places}

    def inside(lo, hi):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("v") >= F.lit(lo))
        return cond & (F.col("v") <= F.lit(hi)) if hi is not None else cond

    below = lambda lo: F.col("v") < F.lit(lo) if lo is not None else F.lit(False)
    out, open_ = {}, list(places)
    while open_:
        row = x.agg(*[c for k in open_ for c in (
            F.count_if(below(spans[k][0])).alias(f"b{k}"), F.count_if(inside(*spans[k])).alias(f"n{k}"), F.approx_count_distinct(F.when(inside(*spans[k]), F.col("v"))).alias(f"d{k}"),
            F.percentile_approx(F.when(inside(*spans[k]), F.col("v")), [i / 64 for i in range(65)], accuracy).alias(f"q{k}"),
        )]).first()
        done = []
        for k in open_:
            at, n, marks = k - row[f"b{k}"], row[f"n{k}"], row[f"q{k}"]
            slack = 2 * n // accuracy + 2
            lo = [m for i, m in enumerate(marks) if i / 64 * n + slack <= at]
            hi = [m for i, m in enumerate(marks) if i / 64 * n - slack >= at]
            span = (lo[-1] if lo else spans[k][0], hi[0] if hi else spans[k][1])
            if row[f"d{k}"] <= few // 2 or span == spans[k]:
                done.append(k)
            spans[k] = span if k not in done else spans[k]
        for k in done:
            seen = 0
            for r in x.filter(inside(*spans[k])).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").toLocalIterator():
                seen += r.n
                if seen > k - row[f"b{k}"]:
                    out[k] = r.v
                    break
        open_ = [k for k in open_ if k not in done]
    return out


def summary(df: DataFrame, column: str) -> DataFrame:
    """(count, mean, std, min, p25, p50, p75, max); quartiles are interpolated between neighbours, exactly."""
    c, df = F.col(column), saved(df.select(column))  # read a few times
    n = df.agg(F.count(c)).first()[0]
    spots = {p: (n - 1) * p for p in (0.25, 0.5, 0.75)}
    got = order_statistics(df, column, sorted({int(f) for s in spots.values() for f in (s // 1, -(-s // 1))})) if n else {}

    def quartile(p: float):
        if not n:
            return F.lit(None).cast("double")
        lo, hi = int(spots[p] // 1), int(-(-spots[p] // 1))
        return F.lit(got[lo] if lo == hi else (hi - spots[p]) * got[lo] + (spots[p] - lo) * got[hi])

    mid = [quartile(p).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    agg = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    return agg.select("count", "mean", "std", "min", *mid, "max")


def fold_metrics(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation over folds."""
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def merge_check(matches: DataFrame, least: int = 4, of: int = 8) -> DataFrame:
    """Raises unless at least ``least`` of at least ``of`` rows match."""
    n = matches.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("match").cast("int")).alias("hits"))
    return n.filter(F.when((F.col("n") < of) | (F.col("hits") < least), F.raise_error(F.lit("merge check failed")).isNotNull()).otherwise(True))


def budget_estimate(timings: DataFrame, n_test: int = 819, factor: float = 3.0, limit_hours: float = 20.0) -> DataFrame:
    """(sec_per_sample, hours, hours_scaled, ok) from timings (pos, seconds); the first row is a warm-up."""
    mean = F.coalesce(F.sum(F.when(F.col("pos") > 0, F.col("seconds"))), F.lit(0.0)) / F.greatest(F.sum((F.col("pos") > 0).cast("int")), F.lit(1))
    x = timings.agg(mean.alias("m")).select("m", (F.col("m") * n_test / 3600).alias("h"))
    return x.select(F.round("m", 6).alias("sec_per_sample"), F.round("h", 6).alias("hours"), F.round(F.col("h") * factor, 6).alias("hours_scaled"), (F.col("h") * factor <= limit_hours).alias("ok"))
