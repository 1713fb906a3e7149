"""Votes over shuffled views: parsing, decision, consensus and profiles.

A sample's votes collapse to 24 counters (one per rank) plus a few totals in one hash
aggregation with map-side combine, so a sample's row is of fixed width however many votes it has
and each query shuffles once, on the sample id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.perm import PERMS, identity, index_of, is_unorderable, ints, parse_last, unshuffle


def parse_votes(raw: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, *keep, kind, rank) of raw votes (id, perm, text): fail, unorderable (no rank) or orderable in original coordinates."""
    shown = parse_last(F.col("text"))
    kind = F.when(shown.isNull(), "fail").when(is_unorderable(F.col("text")), "unorderable").otherwise("orderable")
    return raw.select("id", *keep, kind.alias("kind"), F.when(kind == "orderable", unshuffle(shown, F.col("perm"))).alias("rank"))


def tally(votes: DataFrame, by: str = "id") -> DataFrame:
    """(id, n_votes, n_fail, n_unorderable, counts array<long> of the 24 ranks)."""
    v = votes.select(by, "kind", index_of(F.col("rank")).alias("at"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    cells = [n((F.col("kind") == "orderable") & (F.col("at") == i)) for i in range(len(PERMS))]
    agg = v.groupBy(by).agg(F.count(F.lit(1)).alias("n_votes"), n(F.col("kind") == "fail").alias("n_fail"), n(F.col("kind") == "unorderable").alias("n_unorderable"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    return agg.select(by, "n_votes", "n_fail", "n_unorderable", F.array(*[F.col(f"c{i}") for i in range(len(PERMS))]).alias("counts"))


def consensus(counts: Column) -> Column:
    """Most votes for one rank; 0 without an orderable vote."""
    return F.array_max(counts)


def decide(tallies: DataFrame, ban_identity: bool = False, disperse_gate: bool = True, disperse_top: int = 1, identity_quota: int | None = None) -> DataFrame:
    """tallies plus (rank, reason).

    In order: parse_fail, unorderable_majority, identity_quota, all_identity_votes,
    disperse_gate, mode, borda_tie.  A tie goes to the rank nearest the mean of all orderable
    ranks, in exact integers, then to the lexicographically smallest.
    """
    counts = F.col("counts")
    orderable = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    sums = []
    for f in range(4):
        total = F.lit(0).cast("long")
        for i, p in enumerate(PERMS):
            total = total + F.get(counts, F.lit(i)) * p[f]
        sums.append(total.alias(f"s{f}"))
    t = tallies.select("*", orderable.alias("n_orderable"), F.get(counts, F.lit(0)).alias("n_identity"), *sums)
    ranks = F.array(*[ints(p) for p in PERMS])
    far = lambda p: sum((F.col("n_orderable") * F.get(p, F.lit(f)) - F.col(f"s{f}")) * (F.col("n_orderable") * F.get(p, F.lit(f)) - F.col(f"s{f}")) for f in range(4))
    usable = F.transform(counts, lambda c, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(c)) if ban_identity else counts
    top = F.array_max(usable)
    t = t.withColumn("usable", usable).withColumn("top", top)
    best = F.filter(F.transform(F.col("usable"), lambda c, i: F.when(c == F.col("top"), i)), lambda i: i.isNotNull())
    t = t.withColumn("best", best)
    nearest = F.array_min(F.transform("best", lambda i: F.struct(far(F.get(ranks, i)).alias("d"), i.alias("i"))))["i"]
    valid = F.col("n_votes") - F.col("n_fail")
    reason = F.when(valid == 0, "parse_fail").when(2 * F.col("n_unorderable") > valid, "unorderable_majority")
    if identity_quota:
        reason = reason.when(F.col("n_identity") >= identity_quota, "identity_quota")
    if ban_identity:
        reason = reason.when(F.col("top") == 0, "all_identity_votes")
    if disperse_gate:
        reason = reason.when(F.col("top") <= disperse_top, "disperse_gate")
    reason = reason.when(F.size("best") == 1, "mode").otherwise("borda_tie")
    rank = F.when(reason.isin("mode", "borda_tie"), F.get(ranks, nearest)).otherwise(identity())
    return t.select(*tallies.columns, F.col("n_identity").alias("identity_votes"), consensus(counts).alias("consensus"), rank.alias("rank"), reason.alias("reason"))


def profile(decided: DataFrame) -> DataFrame:
    """One row: sizes and rates of a vote file; every denominator is at least 1."""
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = lambda c: F.greatest(c, F.lit(1))
    total, fail, un = s("n_votes"), s("n_fail"), s("n_unorderable")
    same = F.when(F.col("rank") == identity(), 1.0).otherwise(0.0)
    return decided.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(total / one(F.count(F.lit(1))), 2).alias("votes_per_sample"),
        F.round(fail / one(total), 4).alias("parse_fail_rate"),
        F.round(un / one(total), 4).alias("unorderable_vote_rate"),
        F.round(s("identity_votes") / one(total - fail - un), 4).alias("identity_vote_rate"),
        F.round(F.avg(same), 4).alias("pred_identity_rate"),
    )


def share(df: DataFrame, column: str, digits: int = 4, levels: list | None = None) -> DataFrame:
    """(column, n, share) of its values, sorted; with ``levels`` these are the rows, 0 where a level does not occur."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    if levels is not None:
        named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x).cast(df.schema[column].dataType) for x in levels])).alias(column))
        counted = F.broadcast(named).join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return counted.crossJoin(F.broadcast(total)).select(column, "n", F.round(F.col("n") / F.col("total"), digits).alias("share")).orderBy(column)
