"""Permutation algebra over ranks of four frames, as column expressions."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 4
PERMS = [list(p) for p in itertools.permutations(range(1, N + 1))]  # lexicographic


def ints(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")  # one call to the JVM, however many values


def _ranks() -> Column:
    """The 24 ranks as one literal."""
    return F.expr(f"array({', '.join('array(' + ', '.join(map(str, p)) + ')' for p in PERMS)})")


def identity() -> Column:
    return ints([1, 2, 3, 4])


def perm_dim(spark: SparkSession) -> DataFrame:
    """(idx, rank, key): the 24 ranks in lexicographic order."""
    table = _ranks()
    return spark.range(len(PERMS)).select(F.col("id").alias("idx"), F.get(table, F.col("id").cast("int")).alias("rank")).withColumn("key", format_rank(F.col("rank")))


def rank_at(idx: Column) -> Column:
    """The rank of a lexicographic index."""
    return F.get(_ranks(), idx.cast("int"))


def index_of(rank: Column) -> Column:
    """The lexicographic index of a rank, -1 if it is none."""
    return (F.array_position(_ranks(), rank) - 1).cast("int")


def is_valid(p: Column) -> Column:
    return F.coalesce(F.array_sort(p) == identity(), F.lit(False))


def invert(p: Column) -> Column:
    """order -> rank and rank -> order."""
    return F.transform(F.sequence(F.lit(1), F.lit(N)), lambda i: F.array_position(p, i).cast("int"))


def shuffle(rank: Column, perm: Column) -> Column:
    """Label of a shuffled view: out[j] = rank[perm[j]] (perm counts from 0)."""
    return F.transform(perm, lambda j: F.get(rank, j))


def unshuffle(shown: Column, perm: Column) -> Column:
    """Inverse of shuffle: out[perm[j]] = shown[j]."""
    return F.transform(F.sequence(F.lit(0), F.lit(N - 1)), lambda i: F.get(shown, (F.array_position(perm, i) - 1).cast("int")))


_LIST = r"^\[\s*[1-4]\s*(?:,\s*[1-4]\s*){3},?\s*\]$"


def parse_last(text: Column) -> Column:
    """The last bracketed list in the text that is a permutation of 1-4, else null."""
    lists = F.filter(F.regexp_extract_all(text, F.lit(r"(\[[^\[\]]*\])"), F.lit(1)), lambda x: x.rlike(_LIST))
    ranks = F.filter(F.transform(lists, digits), is_valid)
    return F.try_element_at(ranks, F.lit(-1))


def digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([1-4])"), F.lit(1)), lambda d: d.cast("int"))


def parse_answer(text: Column) -> Column:
    """Strict: raises on a text without a valid list."""
    rank = parse_last(text)
    return F.when(rank.isNotNull(), rank).otherwise(F.raise_error(F.concat(F.lit("not a permutation: "), F.coalesce(text, F.lit("null")))).cast("array<int>"))


def parse_outermost(text: Column) -> Column:
    """First '[' to last ']' read as an order, turned into a rank; identity on any failure."""
    start = F.locate("[", text)
    end = F.length(text) - F.locate("]", F.reverse(text)) + 1
    span = F.substring(text, start, end - start + 1)
    order = F.when((start > 0) & F.contains(text, F.lit("]")) & (end > start) & span.rlike(_LIST), digits(span))
    return F.coalesce(F.when(is_valid(order), invert(order)), identity())


def format_rank(rank: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(rank, lambda r: r.cast("string")), ", "), F.lit("]"))


def is_unorderable(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("UNORDERABLE")), F.lit(False))


def views(n: int, seed: int = 42) -> list[list[int]]:
    """Identity and n-1 different seeded shuffles shared by all samples; a longer list extends a shorter one."""
    if not 1 <= n <= len(PERMS):
        raise ValueError(f"there are between 1 and {len(PERMS)} different views, not {n}")
    rng, out = random.Random(seed), [list(range(N))]
    while len(out) < n:
        p = list(range(N))
        rng.shuffle(p)
        if p not in out:
            out.append(p)
    return out


def hash_int(*parts: Column | str) -> Column:
    """A 32-bit number from md5 of the parts joined by ':'; the same in other SQL engines."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary")), 1, 8), 16, 10).cast("long")


def augment(rank: Column, no_ordering: Column, draw: Column) -> tuple[Column, Column]:
    """(perm, new rank): one of the views allowed, picked by ``draw``; an orderable sample never becomes identity."""
    all_views = F.array(*[ints([x - 1 for x in p]) for p in PERMS])
    allowed = F.filter(all_views, lambda p: no_ordering | (shuffle(rank, p) != identity()))
    perm = F.get(allowed, F.pmod(draw, F.size(allowed)).cast("int"))
    return perm, F.when(no_ordering, identity()).otherwise(shuffle(rank, perm))


def kendall_tau(a: Column, b: Column) -> Column:
    """(concordant - discordant) / 6 over the pairs of frames; a tie counts as discordant."""
    total = F.lit(0)
    for i, j in itertools.combinations(range(N), 2):
        total = total + F.when((F.get(a, F.lit(i)) - F.get(a, F.lit(j))) * (F.get(b, F.lit(i)) - F.get(b, F.lit(j))) > 0, 1).otherwise(-1)
    return total / 6.0
