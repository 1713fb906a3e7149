"""Line dedup by distinct-site spread.

Each non-blank line (spaces trimmed) is known by a 96-bit hash.  A HyperLogLog sketch of the
sites it occurs on is built per line before the shuffle and merged by the aggregation, so a line
that fills a third of the corpus costs one sketch per map task.  Lines whose estimate lies near
the threshold get an exact distinct count; lines on at least ``threshold`` sites are boilerplate
and are removed from every document, wherever they stand.

Defined results: null text counts as empty, a null site is one site of its own; blank lines are
never boilerplate; a document all of whose lines go keeps an empty text; repeated rows are each
cleaned; empty tables give empty results; other columns are kept untouched by ``clean``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

KEY = ["h1", "h2"]


def _lines(docs: DataFrame, site: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(F.xxhash64(site), F.lit(0)).alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "raw"))
    line = F.trim("raw")
    return rows.filter(line != "").select("doc_id", "text_hash", "site", "pos", F.xxhash64(line).alias("h1"), F.hash(line).alias("h2"))


def boilerplate(docs: DataFrame, site: str = "source", threshold: int = 10, lg_k: int = 12) -> DataFrame:
    """(h1, h2) of the lines that occur on at least ``threshold`` distinct sites."""
    lines = _lines(docs, site)
    error = max(1, math.ceil(threshold * 6 * 1.04 / math.sqrt(2**lg_k)))
    spread = lines.groupBy(*KEY).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")).filter(F.col("sites") >= threshold - error)
    spread = saved(spread)
    sure = spread.filter(F.col("sites") > threshold + error).select(*KEY)
    near = spread.filter(F.col("sites") <= threshold + error).select(*KEY)
    exact = lines.join(near, KEY, "left_semi").select(*KEY, "site").distinct().groupBy(*KEY).count().filter(F.col("count") >= threshold).select(*KEY)
    return saved(sure.unionByName(exact))


def clean(docs: DataFrame, site: str = "source", threshold: int = 10) -> DataFrame:
    """The rows of docs with ``text`` cleaned, plus n_lines and n_removed (with underscores added where docs has such a column)."""
    import pyarrow as pa

    bad = boilerplate(docs, site, threshold)
    hits = _lines(docs, site).join(bad, KEY).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("hit_pos"))
    key, found, total_name, gone_name = (fresh(n, docs.columns) for n in ("text_hash", "hit_pos", "n_lines", "n_removed"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    both = keyed.alias("d").join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col(f"d.{key}") == F.col("h.text_hash")), "left")
    both = both.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.col("h.hit_pos").alias(found))
    shown = both.drop(found).withColumns({total_name: F.lit(0).cast("long"), gone_name: F.lit(0).cast("long")})

    def run(batches):
        for b in batches:
            at = b.schema.names.index("text")
            texts, hit = b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            out, total, gone = [], [], []
            for t, h in zip(texts, hit, strict=True):
                lines = (t or "").split("\n")
                drop = set(h or ())
                out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else t or "")
                total.append(len(lines))
                gone.append(len(drop))
            columns = list(b.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*b.schema.names[:-1], total_name, gone_name])

    return both.mapInArrow(run, shown.schema)
