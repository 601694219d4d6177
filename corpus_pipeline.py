"""A corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that the next one reads, written as
Parquet in between; the last gives packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from roadloom.llm.cluster import fresh, stored
from roadloom.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the documents of this stage and their labels."""
    names = tuple(fresh(docs, f"quality_{n}") for n in ("held_out", "score", "predicted"))
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), names=names)
    return scored.where(F.col(names[2]) == 1).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are similar to an earlier one; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the smallest id of each class of the n-gram Jaccard join, which is made by rows; null ids stay."""
    key = fresh(docs, "row_key")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    joined = ngram_join.ngram_jaccard_join(keyed.where("doc_id is not null"), id_col=key).where("n_links > 0")
    members = joined.select(key, "class_id").join(keyed.select(key, "doc_id"), key)
    least = members.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    gone = members.join(least, "class_id").where("doc_id != least").select(key)
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within the error budget of a benchmark item; rows are told by their text, whatever their id."""
    key = fresh(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.col("text").cast("binary"), 256))
    hits = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    gone = stored(hits.select(key).distinct(), "contaminated")
    return keyed.join(line_dedup.within(gone), key, "left_anti").select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: Learned models and tokenizers can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, with each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
