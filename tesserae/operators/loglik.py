"""Log-likelihood aggregation, decision, fusion with votes, and sweeps.

Views are summed once per sample and rank; everything a margin grid needs of a sample is its
best allowed score and its unorderable score, so a whole sweep is one pass over the samples with
the grid expanded per row, and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.perm import PERMS, identity, rank_at
from ..sources.tables import saved
from .votes import consensus

UNORDERABLE = "unorderable"
KEYS = ["[" + ", ".join(map(str, p)) + "]" for p in PERMS]


def aggregate_ll(views: DataFrame, length_norm: bool = True) -> DataFrame:
    """(id, scores array<double> of the 24 ranks, unord) from views (id, lls map<key, struct<lp, n>>)."""
    long = views.select("id", F.explode("lls").alias("key", "v"))
    return from_long(long.select("id", "key", F.col("v.lp").alias("lp"), F.col("v.n").alias("n")), length_norm)


def from_long(rows: DataFrame, length_norm: bool = True) -> DataFrame:
    """As aggregate_ll, from rows (id, key, lp, n)."""
    score = lambda k: F.sum(F.when(F.col("key") == k, F.col("lp"))) / (F.greatest(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(1)) if length_norm else F.lit(1))
    agg = rows.groupBy("id").agg(*[score(k).alias(f"k{i}") for i, k in enumerate(KEYS)], score(UNORDERABLE).alias("unord"))
    return agg.select("id", F.array(*[F.col(f"k{i}") for i in range(len(KEYS))]).alias("scores"), "unord")


def best_key(scores: Column, ban_identity: bool = False, allowed: Column | None = None) -> tuple[Column, Column]:
    """(index, score) of the greatest score; ties go to the smaller rank.  A restriction or a ban that leaves nothing is dropped."""
    # the least of (not allowed, banned, -score, rank): a restriction or ban comes first, and decides nothing where it holds for all
    no = F.lit(False)
    shut = (lambda i: ~F.coalesce(F.get(allowed, i), no)) if allowed is not None else (lambda i: no)
    all_ = F.transform(scores, lambda s, i: F.struct(shut(i).alias("shut"), (i == 0 if ban_identity else no).alias("ban"), (-s).alias("m"), i.alias("i")))
    top = F.array_min(F.filter(all_, lambda x: x["m"].isNotNull()))
    return top["i"], -top["m"]


def decide_ll(ll: DataFrame, margin: float = 0.0, ban_identity: bool = False) -> DataFrame:
    """(id, rank): identity iff the unorderable score exceeds the best by more than the margin."""
    at, score = best_key(F.col("scores"), ban_identity)
    return ll.select("id", at.alias("at"), score.alias("best"), "unord").select("id", F.when(F.col("unord") - F.col("best") > margin, identity()).otherwise(_rank(F.col("at"))).alias("rank"))


def _rank(at: Column) -> Column:
    return rank_at(at)


POLICIES = ("vote", "ll", "h1", "h2")


def fuse(votes: DataFrame, ll: DataFrame, policy: str, k: int = 3, margin: float = 0.0, ban_identity: bool = False) -> DataFrame:
    """(id, rank).  votes: decided tallies.  vote and ll use one side; h1 and h2 trust votes from consensus k on,
    else the log-likelihoods over all ranks (h1) or over the voted ones (h2); a sample without them keeps its vote."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}, not {policy}")
    if policy == "vote":
        return votes.select("id", "rank")
    if policy == "ll":
        return decide_ll(ll, margin, ban_identity)
    both = votes.join(ll, "id", "left")
    allowed = F.transform("counts", lambda c: c > 0) if policy == "h2" else None
    at, score = best_key(F.col("scores"), ban_identity, allowed)
    x = both.select("id", "rank", consensus(F.col("counts")).alias("consensus"), at.alias("at"), score.alias("best"), "unord")
    from_ll = F.when(F.col("unord") - F.col("best") > margin, identity()).otherwise(_rank(F.col("at")))
    return x.select("id", F.when((F.col("consensus") >= k) | F.col("best").isNull(), F.col("rank")).otherwise(from_ll).alias("rank"))


def margin_grid(low: int = -20, high: int = 20, step: float = 0.025) -> list[float]:
    return [i * step for i in range(low, high + 1)]


def sweep_margins(ll: DataFrame, truth: DataFrame, margins: list[float], ban_identity: bool = False) -> DataFrame:
    """(margin, em) over truth (id, truth)."""
    at, score = best_key(F.col("scores"), ban_identity)
    x = ll.select("id", at.alias("at"), score.alias("best"), "unord").join(truth, "id")
    x = x.select((F.col("unord") - F.col("best")).alias("lead"), (_rank(F.col("at")) == F.col("truth")).cast("int").alias("hit"), (F.col("truth") == identity()).cast("int").alias("id_hit"))
    hits = [F.avg(F.when(F.col("lead") > m, F.col("id_hit")).otherwise(F.col("hit"))).alias(f"m{i}") for i, m in enumerate(margins)]
    row = x.agg(*hits)
    pairs = F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"m{i}").alias("em")) for i, m in enumerate(margins)])
    return row.select(F.inline(pairs))


def best_margin(curve: DataFrame) -> DataFrame:
    """(margin, em): the first margin of the greatest EM of a sweep."""
    top = curve.agg(F.max(F.struct("em", (-F.col("margin")).alias("low"))).alias("b"))
    return top.select((-F.col("b.low")).alias("margin"), F.col("b.em").alias("em"))


def sweep_policies(votes: DataFrame, ll: DataFrame, truth: DataFrame, margins: list[float], ks: list[int] = [2, 3, 4]) -> DataFrame:  # noqa: B006
    """(policy, k, ban_identity, margin, em): the first best margin of each configuration, best first.

    Of a sample a configuration needs three things: how many margins its lead passes, and whether
    it hits on either side of the margin.  Their counts per configuration and number of margins
    passed are one aggregation of fixed size; a margin's EM is a running sum over it.
    """
    grid = sorted(margins)
    x = votes.join(ll, "id").join(truth, "id")
    voted = F.transform("counts", lambda c: c > 0)
    x = x.withColumn("agreed", consensus(F.col("counts"))).withColumn("vote_hit", (F.col("rank") == F.col("truth")).cast("int"))
    x = x.withColumn("id_hit", (F.col("truth") == identity()).cast("int"))
    marks = F.expr(f"array({', '.join(f'{m!r}D' for m in map(float, grid))})")
    passed = lambda lead: F.size(F.filter(marks, lambda m: F.coalesce(F.col(lead) > m, F.lit(False))))
    sides = {}
    for ban in (False, True):
        for side, allowed in (("all", None), ("voted", voted)):
            at, score = best_key(F.col("scores"), ban, allowed)
            sides[f"{side}_{ban}"] = F.struct((_rank(at) == F.col("truth")).cast("int").alias("hit"), (F.col("unord") - score).alias("lead"))
    x = saved(x.select("agreed", "vote_hit", "id_hit", *[c.alias(n) for n, c in sides.items()]))  # a short row a sample
    cells = []
    for ban in (False, True):
        for policy, k in [("ll", None), *[(p, k) for p in ("h1", "h2") for k in ks]]:
            side = f"voted_{ban}" if policy == "h2" else f"all_{ban}"
            by_vote = F.col("agreed") >= k if k else F.lit(False)
            pick = lambda c, v=by_vote: F.when(v, F.col("vote_hit")).otherwise(F.col(c))
            cells.append(F.struct(F.lit(policy).alias("policy"), F.lit(k).cast("int").alias("k"), F.lit(ban).alias("ban_identity"), F.col(f"passed_{side}").alias("passed"), pick(f"{side}.hit").alias("under"), pick("id_hit").alias("over")))
    counted = x.select("*", *[passed(f"{n}.lead").alias(f"passed_{n}") for n in sides])
    config = ["policy", "k", "ban_identity"]
    counts = counted.select(F.inline(F.array(*cells))).groupBy(*config, "passed").agg(F.count(F.lit(1)).alias("n"), F.sum("under").alias("under"), F.sum("over").alias("over"))
    # as many rows a configuration as there are margins, times as many: nothing that grows with the samples
    lines = counts.sparkSession.createDataFrame([(j, m) for j, m in enumerate(grid)], "j int, margin double")
    hits = F.sum(F.when(F.col("passed") > F.col("j"), F.col("over")).otherwise(F.col("under")))
    curve = counts.crossJoin(F.broadcast(lines)).groupBy(*config, "margin").agg((hits / F.sum("n")).alias("em"))
    first = curve.groupBy(*config).agg(F.max(F.struct("em", (-F.col("margin")).alias("low"))).alias("b"))
    first = first.select(*config, (-F.col("b.low")).alias("margin"), F.col("b.em").alias("em"))
    none = lambda kind: F.lit(None).cast(kind)
    plain = x.agg(F.avg("vote_hit").alias("em")).select(F.lit("vote").alias("policy"), none("int").alias("k"), none("boolean").alias("ban_identity"), none("double").alias("margin"), "em")
    return plain.unionByName(first).orderBy(F.desc("em"), *config)


def candidates(samples: DataFrame, views: DataFrame, perm_dim: DataFrame, style: str = "short") -> DataFrame:
    """(id, view, key, text): 24 answers per view, keyed in original coordinates and worded in shuffled ones, and the refusal."""
    from ..functions.perm import shuffle
    from ..functions.text import build_target

    none = F.array().cast("array<string>")
    jobs = samples.crossJoin(F.broadcast(views))
    ranks = jobs.crossJoin(F.broadcast(perm_dim.select("rank", "key")))
    told = ranks.select("id", "view", "key", build_target(style, none, shuffle(F.col("rank"), F.col("perm")), F.lit(False)).alias("text"))
    refused = jobs.select("id", "view", F.lit(UNORDERABLE).alias("key"), build_target(style, none, identity(), F.lit(True)).alias("text"))
    return told.unionByName(refused)

