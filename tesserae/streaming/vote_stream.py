"""Votes that arrive as files: a structured stream over the raw vote directory.

The state is one row a sample: for each of the 24 views the code of its vote, or null.  A vote that is
delivered again falls into its own place and changes nothing, so no vote is remembered by itself and
the state grows with the samples, not with the deliveries.  Of different texts for one view the
greatest code counts (fail over unorderable over the later rank), in whatever order they come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.perm import PERMS, index_of
from ..operators.votes import decide, parse_votes
from ..sources.tables import VOTE

UNORDERABLE, FAIL = len(PERMS), len(PERMS) + 1


def read_votes(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(id, perm, text) as delivered."""
    return spark.readStream.schema(VOTE).option("maxFilesPerTrigger", files_per_batch).json(path).withColumnRenamed("Id", "id")


def running_tallies(votes: DataFrame) -> DataFrame:
    """(id, n_votes, n_fail, n_unorderable, counts), as votes.tally, each view of a sample counted once; a vote whose perm is none of the 24 is left out."""
    seen = votes.withColumn("view", index_of(F.transform("perm", lambda x: x + 1)))
    coded = parse_votes(seen, keep=["view"]).filter("view >= 0")
    code = F.when(F.col("kind") == "fail", FAIL).when(F.col("kind") == "unorderable", UNORDERABLE).otherwise(index_of(F.col("rank")))
    coded = coded.select("id", "view", code.alias("code"))
    places = coded.groupBy("id").agg(*[F.max(F.when(F.col("view") == i, F.col("code"))).alias(f"v{i}") for i in range(len(PERMS))])
    codes = F.array_compact(F.array(*[F.col(f"v{i}") for i in range(len(PERMS))]))
    x = places.select("id", codes.alias("codes"))
    n = lambda code: F.size(F.filter("codes", lambda c: c == code)).cast("long")
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(PERMS) - 1)), lambda i: F.size(F.filter("codes", lambda c: c == i)).cast("long"))
    return x.select("id", F.size("codes").cast("long").alias("n_votes"), n(FAIL).alias("n_fail"), n(UNORDERABLE).alias("n_unorderable"), counts.alias("counts"))


def decide_stream(votes: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Runs until the files present are read; sink gets the new decisions of the samples a batch touched."""
    query = running_tallies(votes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return query.foreachBatch(lambda df, n: sink(decide(df, **options), n)).start()
