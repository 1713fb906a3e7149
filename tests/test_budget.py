"""The budget plan against the fold that defines it."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tesserae.operators import hardcases


def folded(calls, limit):
    """Call by call, with exact sums of the same costs."""
    spent, out = {}, {}
    for run, pos, tin, tout in sorted(calls, key=lambda c: (c[0] is not None, c[0] or "", c[1])):
        cost = None if tin is None else Decimal(tin) * Decimal("0.1") / 10**6 + Decimal(tout) * Decimal("0.625") / 10**6
        ok = cost is not None and spent.get(run, Decimal(0)) + cost <= limit
        if ok:
            spent[run] = spent.get(run, Decimal(0)) + cost
        out[(run, pos)] = "called" if ok else "skipped_budget"
    return out


@pytest.mark.parametrize(("seed", "slice_rows"), [(1, 100_000), (2, 40), (3, 7)])
def test_plan_is_the_sequential_fold(spark, seed, slice_rows):
    r = random.Random(seed)
    calls = [(f"r{r.randint(0, 3)}", i, r.choice([1, 10, 100, 1000, 5000]) * r.randint(1, 9), r.choice([0, 900, 3000])) for i in range(400)]
    calls += [("hot", i, r.randint(1, 4000), 16) for i in range(900)] + [(None, i, 100 * i, 0) for i in range(20)] + [("free", i, 0, 0) for i in range(3)] + [("hot", 950, None, 1)]
    r.shuffle(calls)
    df = spark.createDataFrame(calls, "job string, pos int, tokens_in long, tokens_out long")
    limit = Decimal("0.02")
    got = hardcases.budget_plan(df, 28.0, 1400.0, "job", slice_rows)
    assert got.columns == ["job", "pos", "usd", "status"]
    assert {(x.job, x.pos): x.status for x in got.collect()} == folded(calls, limit)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_plan_of_alternating_costs_and_ties(spark):
    """Every second call just fails to fit; calls at one pos go by cost; a budget that is met exactly is met."""
    calls = [("a", i, 10 if i % 2 == 0 else 1000 - 10 * (i // 2), 0) for i in range(60)] + [("b", 1, 600, 0), ("b", 1, 400, 0), ("b", 1, 500, 0), ("b", 2, 100, 0)]
    df = spark.createDataFrame(calls, "run string, pos int, tokens_in long, tokens_out long")
    got = hardcases.budget_plan(df, 1400.0 * 0.0001, slice_rows=8).collect()
    a = {x.pos: x.status for x in got if x.run == "a"}
    assert a == {p: s for (run, p), s in folded([c for c in calls if c[0] == "a"], Decimal("0.0001")).items()}
    assert sorted((round(x.usd * 1e7), x.status) for x in got if x.run == "b") == [(100, "called"), (400, "called"), (500, "called"), (600, "skipped_budget")]
    assert hardcases.budget_plan(df.limit(0), 10.0).count() == 0
    none = hardcases.budget_plan(df, 0.0)
    assert none.filter("status = 'called'").count() == 0 and none.count() == len(calls)
    assert hardcases.budget_plan(df.withColumn("tokens_in", F.lit(0)), 0.0).filter("status = 'called'").count() == len(calls)
