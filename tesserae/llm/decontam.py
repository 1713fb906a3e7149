"""Benchmark decontamination (DataFrame and SQL functions only).

Items are short, documents may be very long, so resemblance says little; what counts is the
share of an item's distinct word shingles that a document contains.  Items are partitioned by
the size of their shingle set, and each partition fixes how many of the smallest hash values
(a bottom-k MinHash sketch) an item must publish: a document that holds ``share`` of n shingles
misses at most n - ceil(share * n) of them, so of the n - ceil(share * n) + 1 smallest at least
one occurs in it.  The sketch join therefore finds every containing document; candidates are
then confirmed by exact containment of the shingle strings.

Words are maximal runs of letters and digits, lower-cased.  An item of fewer than ``width``
words is one shingle of all its words.  Defined results: null or wordless texts and items match
nothing; a repeated item id counts once per distinct text; repeated document rows give one row
(the larger containment); empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Bytes of a sketch, candidate or item table that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64  #: what a row of a broadcast table takes beside its strings


def _bytes(df: DataFrame) -> int:
    """Bytes of a saved table once broadcast, an upper bound: a row's fixed part and all its values as strings."""
    strings = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns), F.lit(ROW_BYTES))
    return df.agg(F.sum(strings)).first()[0] or 0


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(w: str, width: int, make) -> Column:
    """make(list of width word columns) for each position of the array column w."""
    last = F.size(w) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make([F.get(F.col(w), i + k) for k in range(width)])))


def find(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of documents that contain at least ``share`` of an item's shingles."""
    it = items.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0").withColumn("width", F.least(F.size("w"), F.lit(width)))
    per_width = []
    widths = sorted(r.width for r in it.select("width").distinct().collect())  # at most ``width`` values
    for k in widths:
        g = it.filter(F.col("width") == k).withColumn("grams", F.array_distinct(_grams("w", k, lambda ws: F.concat_ws(" ", *ws))))
        per_width.append(g.select(F.xxhash64("item_id", F.array_join("w", " ")).alias("item_key"), "item_id", "width", "grams"))
    if not per_width:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)
    all_items = per_width[0]
    for more in per_width[1:]:
        all_items = all_items.unionByName(more)
    sized = all_items.dropDuplicates(["item_key"]).withColumn("n_item", F.size("grams")).withColumn("need", F.ceil(F.col("n_item") * share).cast("int"))
    sized = saved(sized.withColumn("part", F.floor(F.log2("n_item"))).withColumn("hashes", F.array_sort(F.transform("grams", lambda g: F.xxhash64(g)))))
    publish = sized.groupBy("part").agg(F.max(F.col("n_item") - F.col("need") + 1).alias("k"))
    sketch = saved(sized.join(publish, "part").select("item_key", "width", F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("gram_hash")))
    sketch_size = _bytes(sketch)
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    found = None
    for k in widths:
        hashed = texts.select("doc_id", F.explode(_grams("w", k, lambda ws: F.xxhash64(F.concat_ws(" ", *ws)))).alias("gram_hash"))
        hit = hashed.join(_small(sketch.filter(F.col("width") == k).select("item_key", "gram_hash"), sketch_size), "gram_hash").select("doc_id", "item_key").distinct()
        found = hit if found is None else found.unionByName(hit)
    pairs = saved(found)
    suspects = pairs.select("doc_id").distinct()
    ids = _small(suspects, _bytes(pairs))
    again = docs.alias("d").join(ids.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = again.select("doc_id", F.xxhash64("text").alias("row_key"), words(F.col("text")).alias("w"))
    goal = sized.select("item_key", "item_id", "width", "n_item", "need", F.explode("grams").alias("gram"))
    goal_size = _bytes(goal)
    shared = None
    for k in widths:
        own = again.select("doc_id", "row_key", F.explode(F.array_distinct(_grams("w", k, lambda ws: F.concat_ws(" ", *ws)))).alias("gram"))
        part = own.join(_small(goal.filter(F.col("width") == k), goal_size), "gram").select("doc_id", "row_key", "item_key", "item_id", "n_item", "need", "gram")
        shared = part if shared is None else shared.unionByName(part)
    count = shared.groupBy("doc_id", "row_key", "item_key", "item_id", "n_item", "need").agg(F.countDistinct("gram").alias("n_shared")).filter("n_shared >= need")
    best = count.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_item").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"), F.col("b.containment").alias("containment"))
