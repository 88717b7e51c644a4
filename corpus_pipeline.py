"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, encoding.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame, which `run` writes as Parquet in the shared folder and reads
again as the next one's docs; what a stage has read is deleted when its own result is written.

Defined cases: null and empty texts fail the quality rules and go there; rows with a null doc_id are kept by near-dedup and judged by their text
in every other stage; rows that repeat doc_id and text stay together in near-dedup, and if they have a passage's length lose it in the
suffix-array stage, as each repeats the other; very long texts are read whole; extra columns are kept up to the last
stage; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard, pieces_fst, quality, suffixes, tiling
from graphloom.llm.common import remove, shared_dir, table

#: Bytes from which a string that repeats goes; at sf0.01 over 99.6 % of the runs of 50 words have as many, in each language.
PASSAGE = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets of five-word XXH64 shingles at a Jaccard similarity of 0.8 or more.  There fingerprints often differ in too many bits for
    anchors, so SimHash's links come first, each checked by its whole sets, and a join by prefixes finds the others with no loss."""
    return jaccard.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs, PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces_fst.digests(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", suffix_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding", encoding)]

#: Transducers and suffix comparison are not SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
