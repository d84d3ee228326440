"""Corpus pipeline: quality rules, line dedup, near-duplicate groups, source mixing, packing.

Each stage gets the documents that its predecessor kept and returns the columns of documents; the last
returns packed pieces. n_chars is the number of characters of the text as it is now.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from tallyforge.llm._spark import keyed, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rule and the learned decision list keep."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs.select(*COLUMNS), rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: later copies of repeated line runs, and of single lines of more than 50 words, are cut;
    documents of which nothing but copies was left are dropped."""
    got = line_dedup.dedup(docs.select(*COLUMNS), min_words=line_dedup.PASSAGE_WORDS)
    return got.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8 with five-word shingles and Jaccard of 0.8: one row of each group stays, that with the
    smallest id (null after all others). Documents without words are in no group and stay. Rows are told
    apart by a number of their own, as ids may repeat."""
    docs = keyed(docs.select(*COLUMNS))
    rows, _ = jaccard_join.join(docs.select(F.col("_row").alias("doc_id"), "text"), t=0.8, n=5)
    rows = rows.select(F.col("doc_id").alias("_row"), "component_id").join(docs.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))["_row"].alias("_row")
    kept = rows.groupBy("component_id").agg(first).select("_row")
    return docs.join(kept.hint("merge"), "_row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: whole documents, as often as the mix takes them, row by row."""
    docs = keyed(docs.select(*COLUMNS))
    got = mixing.mix(docs.select(F.col("_row").alias("doc_id"), "source", "text")).where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    return docs.join(got.hint("merge"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
#: The learned rules and the solved packing are not expressible in SQL; stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
