"""A corpus pipeline of four stages: quality rules, SimHash near-dedup, substring dedup, packing.

Counted as part of subpackage llm. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import packing, phrases, quality, simhash
from feedloom.llm.common import read, saved
from feedloom.llm.tokens import BYTE_BPE, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SEQUENCE_TOKENS = 1024


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's fertility bands."""
    docs = docs.select(*COLUMNS)
    return quality.with_quality(docs, quality.LABELLED_BANDS, prefix="_quality_").filter("_quality_kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id. A row goes by
    its own text, so that another text of the same id stays."""
    docs = docs.select(*COLUMNS)
    found = simhash.near_duplicate_groups(docs).select(F.col("doc_id").alias("_id"), "text_hash")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return docs.join(found, same, "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that a document with a smaller id holds. A document that
    loses nothing keeps its text as it is; of the others the kept words stay, joined by one space; a document of which
    no word stays is dropped, since all it says is said elsewhere."""
    docs = docs.select(*COLUMNS)
    found = phrases.dedup_substrings(docs, with_text=True, carry=("lang", "source", "n_chars")).filter("n_removed = 0 or n_removed < n_words")
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).withColumnRenamed("kept_text", "text").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of token ids, each a piece of one document of a length that is a power of two."""
    return packing.pack(docs, vocabulary_path(BYTE_BPE), longest=SEQUENCE_TOKENS)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", packed)]

#: Tokenisers and automata are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
    return docs
