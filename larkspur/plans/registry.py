"""Registration of queries with the DuckDB SQL that they equal, and tables that several queries share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import store
from larkspur.operators.textindex import TextIndex, digest_of
from larkspur.operators.vectorindex import VectorIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: a document's tenant is its language, its collection its source."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("lang").alias("tenant"),
        F.col("source").alias("collection"),
        F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
        "text",
    )


#: Fields of the corpus's kept index, the text first.
FIELDS = {"text": "text", "collection": "collection", "path": "path"}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The kept index of the corpus: built by the first question that needs it, and used as long as the table's files stay as they are."""
    folder = f"{store.shared_folder(spark)}/text-index/{digest_of(spark, f'{sf_dir}/documents.parquet', FIELDS)}"
    return TextIndex.kept(spark, folder, lambda: documents(spark, sf_dir), FIELDS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the corpus: a vector belongs to the document of its id."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _kept_vectors(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], columns: dict[str, str]) -> VectorIndex:
    tables = [f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings")]
    folder = f"{store.shared_folder(spark)}/{name}/{digest_of(spark, tables[0], columns)}-{digest_of(spark, tables[1], columns)}"
    marker = f"{folder}/CURRENT"
    current = store.read_text(spark, marker)
    if current is None:
        own = f"build-{uuid.uuid4().hex}"
        VectorIndex.create(make(), f"{folder}/{own}", columns=list(columns))
        current = own if store.create_once(spark, marker, own) else store.read_text(spark, marker)
    return VectorIndex(spark, f"{folder}/{current}", columns=columns)


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The kept index of all vectors: built by the first question that needs it."""
    return _kept_vectors(spark, sf_dir, "vector-index", lambda: vectors(spark, sf_dir), {})


def search_vectors(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The kept index of the vectors of documents, each with what searches filter by, so that no question has to join them."""
    columns = {"tenant": "string", "collection": "string", "path": "string"}
    make = lambda: vectors(spark, sf_dir).join(documents(spark, sf_dir).drop("text"), "doc_id")
    return _kept_vectors(spark, sf_dir, "search-vectors", make, columns)


#: The same two tables for DuckDB.
DOCS = "docs AS (SELECT doc_id, lang AS tenant, source AS collection, 'docs/' || source || '/' || doc_id || '.txt' AS path, text FROM documents)"
VECS = "vecs AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings)"
