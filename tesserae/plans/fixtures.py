"""Inputs derived from the driver's tables; every expression string is read alike by Spark and by the oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import perm as P
from ..functions import text as X
from ..sources.tables import spread, table

TRUTH_AT = "CASE WHEN id % 13 < 2 THEN 0 WHEN (id * 5) % 24 = 0 THEN 1 ELSE (id * 5) % 24 END"
VOTE_AT = "CASE WHEN user_id % 3 = 0 THEN user_id % 24 ELSE truth_at END"
KIND = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'unorderable' ELSE 'orderable' END"
CAPTION = """CASE WHEN k % 17 = 0 THEN p_name || '.' WHEN k % 17 = 1 THEN p_name || ', then ' || p_type || ' followed by ' || p_brand || ', finally it stops.'
WHEN k % 7 = 0 THEN 'After ' || p_name || ', ' || p_type || ', then ' || p_brand || '.' WHEN k % 7 = 1 THEN 'Before ' || p_name || ', ' || p_type || '.'
ELSE p_name || (CASE k % 11 WHEN 0 THEN ', then ' WHEN 1 THEN ' followed by ' WHEN 2 THEN ', and finally ' WHEN 3 THEN ', next, ' WHEN 4 THEN ', ending with ' WHEN 5 THEN ', afterwards, '
WHEN 6 THEN ', subsequently ' WHEN 7 THEN '; ' WHEN 8 THEN ' before ' WHEN 9 THEN ' after ' ELSE ' as ' END) || p_type || (CASE WHEN k % 5 = 0 THEN '.' ELSE ', then ' || p_brand || '.' END) END"""
LISTS = """CASE event_id % 9 WHEN 0 THEN 'x [1, 2, 3, 4] then [3, 1, 2, 4]' WHEN 1 THEN '[1,2] [2,1,4,3]' WHEN 2 THEN 'a [4, 3, 2, 1] and [1, 1, 2, 3]' WHEN 3 THEN 'none'
WHEN 4 THEN '[1, 2, 3]' WHEN 5 THEN NULL WHEN 6 THEN 'Answer: [ 2, 4 ,1,3, ] end' WHEN 7 THEN '' ELSE 'k [[4,1,2,3]] [' END"""
VARIANT = """CASE k % 6 WHEN 0 THEN '{"variants": [" one ' || p_name || '", "", "two"]}' WHEN 1 THEN 'Sure: {"variants": ["' || p_type || '"]} done' WHEN 2 THEN '["a", " b "]'
WHEN 3 THEN p_name || '|||' || p_type || '||| ' WHEN 4 THEN 'no json here' ELSE '' END"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, view, perm, text): raw generations over shuffled views."""
    e = table(spark, sf_dir, "events").selectExpr("event_id div 4 AS id", "event_id % 4 AS view", "user_id", f"{KIND} AS kind")
    e = e.withColumn("truth_at", F.expr(TRUTH_AT)).withColumn("at", F.expr(VOTE_AT))
    perm = F.transform(P.rank_at((F.col("view") * 7) % 24), lambda x: x - 1)
    e = e.withColumn("perm", perm)
    shown = P.shuffle(P.rank_at(F.col("at")), F.col("perm"))
    none = F.array().cast("array<string>")
    said = F.when(F.col("kind") == "fail", F.lit("I cannot tell [1, 1, 2]")).otherwise(X.build_target("mid", none, shown, F.col("kind") == "unorderable"))
    return e.select("id", "view", "perm", said.alias("text"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, no_ordering, fold)."""
    e = table(spark, sf_dir, "events").selectExpr("event_id div 4 AS id").distinct()
    return e.select("id", P.rank_at(F.expr(TRUTH_AT)).alias("truth"), (F.col("id") % 13 < 2).alias("no_ordering"), F.expr("CASE WHEN id % 10 < 3 THEN 'val' ELSE 'test' END").alias("fold"))


def md5_int(text: str) -> Column:
    return F.conv(F.substring(F.md5(F.expr(text).cast("binary")), 1, 8), 16, 10).cast("long")


def ll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key, lp, n): one view's log-likelihoods of 24 ranks and the refusal, for every sample."""
    t = truth(spark, sf_dir).withColumn("truth_at", F.expr(TRUTH_AT)).filter("id % 29 <> 5")
    x = t.select("id", "truth_at", "no_ordering", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("at"))
    noise = md5_int("'ll:' || CAST(id AS STRING) || ':' || CAST(at AS STRING)") % 5000
    lp = F.when(F.col("at") < 24, -noise / 100.0 + F.when(F.col("at") == F.col("truth_at"), 12.0).otherwise(0.0)).otherwise(-noise / 100.0 * 0.6 + F.when(F.col("no_ordering"), 12.0).otherwise(0.0))
    key = F.when(F.col("at") < 24, P.format_rank(P.rank_at(F.least(F.col("at"), F.lit(23))))).otherwise("unorderable")
    return x.select("id", key.alias("key"), lp.alias("lp"), F.when(F.col("at") < 24, 20).otherwise(12).alias("n"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, caption, events, rank, no_ordering)."""
    p = spread(table(spark, sf_dir, "part")).withColumn("k", F.col("p_partkey"))
    x = p.select(F.col("p_partkey").alias("id"), F.expr(CAPTION).alias("caption"), "p_name", "p_type", "p_brand", "k")
    return x.withColumn("events", X.split_events(F.col("caption"))).withColumn("rank", P.rank_at(F.expr(TRUTH_AT))).withColumn("no_ordering", F.col("id") % 13 < 2)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): every document's whole text, as a caption with near copies."""
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def embeddings(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """(id, e0..e7): eight vectors a sample (frames, events, caption); a slot without a vector is zero."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 8 AS id", "vec_id % 8 AS slot", "embedding")
    g = e.groupBy("id").agg(*[F.max(F.when(F.col("slot") == i, F.struct("embedding"))).alias(f"s{i}") for i in range(8)])
    zero = F.array_repeat(F.lit(0.0), dim)
    return g.select("id", *[F.coalesce(F.col(f"s{i}.embedding").cast("array<double>"), zero).alias(f"e{i}") for i in range(8)])


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, logits 4x4, gate, target)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 8).alias("v"))
    rows = F.array(*[F.slice("v", 1 + 4 * i, 4) for i in range(4)])
    return e.select("id", rows.alias("logits"), (1 / (1 + F.exp(-F.element_at("v", 17)))).alias("gate"), F.expr(TRUTH_AT).cast("int").alias("target"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, width, height, gray): a 24 x 32 synthetic frame for every part row as bytes, some dark, some with bands."""
    p = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))
    r, c = np.mgrid[:24, :32]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                ids = b.column("id").slice(at, 1024)
                n = ids.fill_null(0).to_numpy()[:, None, None]
                px = np.where(n % 3 == 0, 30 + (r + c) % 4, (r * 37 + c * 11 + n * 7) % 256)
                px = np.where((r < n % 9) | (r >= 24 - n % 5), 2, px).astype(np.uint8)
                gray = [None if x is None else g.tobytes() for x, g in zip(ids.to_pylist(), px, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), 32, np.int32)), pa.array(np.full(len(ids), 24, np.int32)), pa.array(gray, pa.binary())], names=["id", "width", "height", "gray"])

    return p.mapInArrow(run, "id long, width int, height int, gray binary")
