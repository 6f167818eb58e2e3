"""From raw documents to packed training sequences, each stage an operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its
result is written as Parquet and read again. All stages but the last return the columns
of documents; the last returns the packed pieces.

1. language: documents without a letter or a text (``und``) and those whose language the
   model can't tell (probability under LEAST_SCORE) go.
2. lines: every line that a document with a smaller doc_id also holds goes, and n_chars
   follows the text. Documents whose lines are all gone stay, with an empty text.
3. near_duplicates: of documents linked at Jaccard 0.8 on five-word shingles the one with
   the smallest doc_id stays; documents without words stay.
4. decontamination: documents with a passage of the benchmark go.
5. packing: pieces in sequences of 1024 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.language import fit_language, identify
from tidemark.llm.lines import dedup_lines
from tidemark.llm.packing import pack, pieces
from tidemark.llm.runtime import Workspace, table
from tidemark.llm.setjoin import near_duplicates

LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = identify(docs, fit_language(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.col("n_dropped") > 0
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_duplicates(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicate_documents),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language ID, set similarity and packing are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
