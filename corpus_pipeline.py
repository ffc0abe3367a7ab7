"""Corpus pipeline: toxicity, line dedup, near duplicates, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives documents again (the last gives packed
pieces). Between stages the documents are written as Parquet and read back, so a lost executor costs one stage's tasks only.

Defined results: extra columns of any name pass all stages but the last; a null text stays null (and counts as empty); a null doc_id is kept; repeated rows are
each judged alike; an empty table gives an empty result. What a stage does with ties and such is said with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import lines, near, packing, secrets, toxic
from larkspur.llm.common import table
from larkspur.operators.store import remove, shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; all others stay as they are. Null and empty texts are scored like documents without features; rows repeated go or stay together."""
    return toxic.reject(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller doc_id holds go from ``text``; every document stays, if with an empty text. A null doc_id comes before all others;
    rows of one doc_id are one document, so they do not take lines from each other."""
    return lines.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates stays (all of its rows in the group, if it is repeated). Of rows that share a doc_id each is judged by its own
    text: the row of one text may go and that of another stay. Documents without words are in no group; documents without doc_id all stay, and their group keeps no other."""
    return near.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in ``text`` are replaced by their kinds in brackets, overlapping ones by the first one's; every document stays, a null text null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 tokens; a null or empty text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Tokenising, Viterbi decoding and Jaccard components have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what goes between them lies in the folder named in spark.checkpoint.dir, each stage's until the next one is written."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if before:
            remove(spark, f"{place}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
