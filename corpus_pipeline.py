"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last,
which returns the token ids.  run() writes each stage's rows and reads them back for the next.

Defined results of every stage: a null text is an empty one; whole texts are read whatever their
length; other columns pass through the first four stages as they are, also under names that the
operators use inside; an empty table gives an empty one.  What a stage does with null ids,
repeated rows and ties is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontam, fm_quality, hyperminhash, line_dedup, piece_match
from tesserae.llm.common import fresh, saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores under 0.3 go.

    Every row is scored by itself: repeated rows stay or go together, a score of exactly 0.3 stays,
    empty texts are scored like others.  Rows without a doc_id are scored, but not learned from.
    """
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"))
    return fm_quality.score(docs, model, keep_columns=True).filter(F.col(fresh("fm_score", docs.columns)) >= 0.3).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found on ten or more sources go from every document; n_chars, if there, is counted again.

    No row goes: a text all of whose lines go stays as an empty one, and a null text becomes one.
    A null source is one source of its own; a line on exactly ten goes; repeated rows, and rows
    without a doc_id, are each cleaned.
    """
    out = line_dedup.clean(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard index of 0.8 or more the one with the smallest id stays.

    The threshold is the stage's own; op8_minhash keeps 0.85.  ``slack`` is again seven standard
    deviations of the estimate at the threshold.  A pair at exactly 0.8 is linked; texts without
    words are linked with nothing.  Rows that share a doc_id are one group, of which the smallest
    text stays (ties: any, the rows then differ in no column that has an order); rows without a
    doc_id all stay, since nothing can be said of them.
    """
    kept = hyperminhash.near_duplicates(docs, num=80, den=100, slack=0.25).filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"))
    kept = saved(kept)
    one = docs.join(kept.filter("times = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if not kept.filter("times > 1").isEmpty():
        again = docs.join(kept.filter("times > 1").select("doc_id"), "doc_id", "left_semi")
        ordered = [c for c, kind in docs.dtypes if c != "text" and not kind.startswith(("map", "variant"))]
        row = F.min_by(F.struct(*docs.columns), F.struct("text", *ordered))
        one = one.unionByName(again.groupBy(F.col("doc_id").alias("of")).agg(row.alias("row")).select("row.*"))
    return one.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain four fifths of a benchmark item's shingles go, at exactly four fifths too.

    Repeated rows go or stay together, and so do all rows of a doc_id that has one such row; rows
    without a doc_id stay; texts and items without words match nothing.
    """
    hit = decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left: a row for each row, none for an empty text; of joins that tie the leftmost is first."""
    return piece_match.tokenize(docs, with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pieces", pieces)]

#: The classifier and the segmentation have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
