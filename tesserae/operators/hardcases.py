"""Hard-case weighting, training-set expansion and the budget of rewrites."""

from __future__ import annotations

from decimal import ROUND_FLOOR, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.perm import format_rank, identity, is_valid, kendall_tau
from ..functions.text import clamp01, cost_usd, hard_score
from ..sources.tables import saved


def score_case(pred: Column, truth: Column, no_ordering: Column) -> tuple[Column, Column, Column]:
    """(em, tau, score): 0 for exact, 1 for invalid, else at least one half, more where the gate was wrong."""
    ok, exact = is_valid(pred), F.coalesce(pred == truth, F.lit(False))
    tau = F.when(ok, kendall_tau(pred, truth)).otherwise(-1.0)
    wrong = F.greatest(F.lit(0.5), (1 - tau) / 2)
    same = F.coalesce(pred == identity(), F.lit(False))
    wrong = F.when(no_ordering & ~same, F.greatest(wrong, F.lit(0.9))).when(~no_ordering & same, F.greatest(wrong, F.lit(0.75))).otherwise(wrong)
    return exact & ok, tau, F.when(~ok, 1.0).when(exact, 0.0).otherwise(F.least(F.lit(1.0), wrong))


def hard_cases(truth: DataFrame, pred: DataFrame, max_repeats: int = 5, base_prob: float = 0.3, hard_prob: float = 0.9, only_wrong: bool = False) -> DataFrame:
    """One row per truth row (id, truth, no_ordering); a missing prediction scores worst."""
    x = truth.join(pred.select("id", F.col("rank").alias("pred")), "id", "left")
    em, tau, score = score_case(F.col("pred"), F.col("truth"), F.col("no_ordering"))
    x = x.select("id", em.alias("em"), tau.alias("tau"), "no_ordering", F.coalesce(format_rank(F.col("pred")), F.lit("")).alias("pred"), format_rank(F.col("truth")).alias("truth"), score.alias("s"))
    x = x.filter(~F.col("em")) if only_wrong else x
    repeats = (1 + F.ceil(F.col("s") * (max_repeats - 1))).cast("int")
    return x.select("id", "em", F.round("tau", 6).alias("tau"), "no_ordering", "pred", "truth", F.round("s", 6).alias("hard_score"), repeats.alias("caption_aug_repeats"), F.round(base_prob + (hard_prob - base_prob) * F.col("s"), 6).alias("caption_aug_prob"))


def variant_budget(score: Column, base: int = 2, extra: int = 4, most: int = 6) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), base + F.ceil(score * extra).cast("int")))


def annotate(records: DataFrame, hard: DataFrame, max_repeats: int = 5, base_prob: float = 0.3, hard_prob: float = 0.9) -> DataFrame:
    """records with caption_aug_repeats, caption_aug_prob and hard_score; hard (id, hard_score, em, correct, caption_aug_repeats, caption_aug_prob) as text, blanks missing."""
    x = records.join(hard.select("id", *[F.col(c).cast("string").alias(f"_{c}") for c in ("hard_score", "em", "correct", "caption_aug_repeats", "caption_aug_prob")]), "id", "left")
    score = hard_score(F.col("_hard_score"), F.col("_em"), F.col("_correct"))
    given = lambda c: F.when(F.col(c) != "", F.col(c).cast("double"))
    repeats = F.coalesce(given("_caption_aug_repeats").cast("int"), (1 + F.ceil(score * (max_repeats - 1))).cast("int"))
    prob = F.coalesce(given("_caption_aug_prob"), base_prob + (hard_prob - base_prob) * score)
    new = {"caption_aug_repeats": F.greatest(F.lit(1), F.least(F.lit(max_repeats), repeats)), "caption_aug_prob": F.round(clamp01(prob), 6), "hard_score": F.round(score, 6)}
    return x.select(*[c for c in records.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def merge_overrides(records: DataFrame, overrides: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Non-null fields of the last override of a key (by ``pos``) replace the record's."""
    last = overrides.groupBy(key).agg(F.max_by(F.struct(*fields), "pos").alias("o"))
    x = records.alias("r").join(last.alias("o"), key, "left")
    return x.select(*[F.coalesce(F.col(f"o.o.{c}"), F.col(f"r.{c}")).alias(c) if c in fields else F.col(key if c == key else f"r.{c}") for c in records.columns])


def expand(records: DataFrame, oversample: int = 1, most: int = 5) -> DataFrame:
    """Rows (…, part, copy): each record repeated by its count, then the no-ordering ones again ``oversample`` - 1 times."""
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.col("caption_aug_repeats").cast("string").try_cast("double").cast("int"), F.lit(1))))
    base = records.withColumn("part", F.lit(0)).withColumn("copy", F.explode(F.sequence(F.lit(0), n - 1)))
    if oversample <= 1:
        return base
    again = base.filter("no_ordering").drop("part").withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(oversample - 1))))
    return base.unionByName(again)


def budget_plan(calls: DataFrame, max_cost_krw: float, krw_per_usd: float = 1400.0, run: str = "run", slice_rows: int = 100_000) -> DataFrame:
    """(run, pos, usd, status) of calls (run, pos, tokens_in, tokens_out): taken in order of pos, a call that would
    pass the budget is skipped and later, cheaper ones may still fit.

    The fold is found by prefix sums.  Of a run's open calls only those that cost no more than what is left count; they
    are called up to the first whose sum passes it, which is skipped, and the rest is open with what is then left.  Sums over
    slices of about ``slice_rows`` calls find the slice of that call, and only there rows are summed one by one, so a run
    of any length is spread over all tasks.  What is left after the first round is under the greatest cost and every round spends
    the least cost or more: there are no more rounds than two and their ratio.  Costs are summed as decimals, exactly.
    Calls at equal pos are in order of cost; one without a cost is skipped; one that costs nothing is called.
    """
    limit = (Decimal(repr(float(max_cost_krw))) / Decimal(repr(float(krw_per_usd)))).quantize(Decimal(10) ** -15, ROUND_FLOOR)
    money, usd = "decimal(38,15)", cost_usd(F.col("tokens_in"), F.col("tokens_out"))
    x = calls.select(F.col(run).alias("run"), "pos", usd.alias("usd"))
    slices = max(1, -(-x.count() // slice_rows))
    rows = x.repartitionByRange(slices, "run", "pos", "usd").sortWithinPartitions("run", "pos", "usd")
    rows = saved(rows.withColumn("k", F.monotonically_increasing_id()).withColumn("cost", F.col("usd").cast(money)))
    left = saved(rows.select("run").distinct().select("run", F.lit(-1).cast("long").alias("after"), F.lit(limit).cast(money).alias("left")))
    open_, rounds = rows.filter("cost > 0").select("run", "k", "cost"), []
    while True:
        of = left.select(F.col("run").alias("own"), "after", "left")
        now = saved(open_.join(of, F.col("run").eqNullSafe(F.col("own"))).filter("k > after and cost <= left").select("run", "k", "cost", "after", "left"))
        part = F.shiftright("k", 33).alias("part")
        sums = now.groupBy("run", part).agg(F.sum("cost").cast(money).alias("cost"), F.first("left").alias("left"))
        ahead = F.coalesce(F.sum("cost").over(Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(money)).cast(money)
        crossing = sums.withColumn("ahead", ahead).filter("ahead <= left and ahead + cost > left").select(F.col("run").alias("own"), F.col("part").alias("of_part"), "ahead")  # one a run
        inside = now.withColumn("part", part).join(crossing, F.col("run").eqNullSafe(F.col("own")) & (F.col("part") == F.col("of_part")))
        total = (F.col("ahead") + F.sum("cost").over(Window.partitionBy("run").orderBy("k"))).cast(money)
        first = inside.withColumn("total", total).filter("total > left").groupBy("run").agg(F.min(F.struct("k", "total", "cost")).alias("m"), F.first("after").alias("after"), F.first("left").alias("left"))
        cut = saved(first.select("run", "after", F.col("m.k").alias("until"), "left", (F.col("left") - (F.col("m.total") - F.col("m.cost"))).cast(money).alias("rest")))
        # runs without such a call are done: all that fit are called
        done = left.join(cut.select(F.col("run").alias("own")), F.col("run").eqNullSafe(F.col("own")), "left_anti").select("run", "after", F.lit((1 << 63) - 1).alias("until"), "left")
        rounds.append(saved(done.unionByName(cut.select("run", "after", "until", "left"))))
        if cut.isEmpty():
            break
        left, open_ = cut.select("run", F.col("until").alias("after"), F.col("rest").alias("left")), now.select("run", "k", "cost")
    spans = reduce(DataFrame.unionByName, rounds).select(F.col("run").alias("own"), "after", "until", "left")
    hit = rows.join(spans, F.col("run").eqNullSafe(F.col("own")) & (F.col("k") > F.col("after")) & (F.col("k") <= F.col("until")))
    called = (F.col("cost") <= F.col("left")) & ((F.col("k") < F.col("until")) | (F.col("cost") == 0))
    return hit.select(F.col("run").alias(run), "pos", "usd", F.when(called, "called").otherwise("skipped_budget").alias("status"))


def sample_rows(df: DataFrame, n: int, order: Column, key: str = "id") -> DataFrame:
    """n rows in hash order; the same rows every time."""
    return df.orderBy(order, key).limit(n)
