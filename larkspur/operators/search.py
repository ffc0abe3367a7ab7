"""Search: vector and lexical recall, reciprocal-rank fusion, normalisation, reranking, and the options around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.vectors import cosine_similarity
from larkspur.operators import fulltext
from larkspur.operators.textindex import TextIndex
from larkspur.operators.vectorindex import VectorIndex

# Fixed value of reciprocal-rank fusion.
RRF = 60
RERANKERS = ("heuristic", "bm25", "ensemble")
MODES = {"vector": "vector", "fts": "fts", "bm25": "fts", "hybrid": "hybrid"}


@dataclass
class SearchOptions:
    """How to search. ``tenant`` None means all tenants."""

    top_k: int = 10
    mode: str = "hybrid"
    tenant: str | None = None
    path_prefix: str | None = None
    min_score: float | None = None
    collections: Sequence[str] = field(default_factory=tuple)
    match_all: bool = False
    #: the name of a reranker, or a function (hits, query) -> hits with new scores
    rerank: str | Callable[[DataFrame, str], DataFrame] | None = None

    def __post_init__(self):
        if self.rerank not in (None, *RERANKERS) and not callable(self.rerank):
            raise ValueError(f"unknown reranker {self.rerank!r}")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.top_k <= 0:
            raise ValueError("top_k must be positive")


def live(docs: DataFrame, options: SearchOptions) -> DataFrame:
    """Documents that may be found: the filters go to the scan, before any top-k."""
    if options.tenant is not None:
        docs = docs.filter(F.col("tenant") == options.tenant)
    if options.path_prefix:
        docs = docs.filter(F.col("path").startswith(options.path_prefix))
    if options.collections:
        docs = docs.filter(F.col("collection").isin(*options.collections))
    return docs


def vector_scores(vecs: DataFrame, q: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, score): cosine similarity to the one vector of ``q`` (column q), which is broadcast."""
    return vecs.filter(F.size("embedding") > 0).crossJoin(F.broadcast(q.limit(1))).select(key, cosine_similarity(F.col("embedding"), F.col("q")).alias("score"))


def vector_top(docs: DataFrame, vecs: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """The ``k`` live documents nearest to the query vector."""
    return fulltext.top(vector_scores(vecs.join(docs.select("doc_id"), "doc_id", "left_semi"), q), k)


def vector_live(docs: DataFrame, vecs: DataFrame | VectorIndex, q: DataFrame, k: int, options: SearchOptions) -> DataFrame:
    """The same by the options: from an index, or from vectors that carry what is filtered by, or by a join with the live documents ``docs``."""
    if isinstance(vecs, VectorIndex):
        where = [F.col("path").startswith(options.path_prefix)] if options.path_prefix else []
        where += [F.col("collection").isin(*options.collections)] if options.collections else []
        return vecs.search(q.first()["q"], k, reduce(lambda a, b: a & b, where) if where else None, options.tenant)
    if {"tenant", "collection", "path"} <= set(vecs.columns):
        return fulltext.top(vector_scores(live(vecs, options), q), k)
    return vector_top(docs, vecs, q, k)


def lexical_top(corpus: DataFrame | TextIndex, found: DataFrame | None, terms: list[str], k: int, match_all: bool = False) -> DataFrame:
    """The ``k`` best of the ``found`` documents (None: of all) by BM25; its statistics are of the whole corpus, texts or index."""
    if isinstance(corpus, TextIndex) and not match_all:
        return corpus.top(terms, k, found)
    scored = corpus.bm25(terms) if isinstance(corpus, TextIndex) else fulltext.bm25(corpus, terms)
    if match_all:
        scored = scored.filter(F.col("n_terms") == len(terms))
    if found is not None:
        scored = scored.join(found.select("doc_id"), "doc_id", "left_semi")
    return fulltext.top(scored.select("doc_id", "score"), k)


def ranked(hits: DataFrame, name: str) -> DataFrame:
    """Zero-based rank of a bounded list of hits."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1)


def rrf(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """(doc_id, score, vector_score, fts_score): reciprocal ranks of both lists added, both scores kept."""
    v = ranked(vector, "vr").withColumnRenamed("score", "vector_score")
    f = ranked(lexical, "fr").withColumnRenamed("score", "fts_score")
    share = lambda r: F.coalesce(1 / (F.lit(RRF + 1.0) + F.col(r)), F.lit(0.0))
    return v.join(f, "doc_id", "full_outer").select("doc_id", F.round(share("vr") + share("fr"), 12).alias("score"), "vector_score", "fts_score")


def normalise(hits: DataFrame) -> DataFrame:
    """Scores as shares of the largest, if that is positive."""
    most = F.max("score").over(Window.partitionBy())
    return hits.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score")))


def number(hits: DataFrame) -> DataFrame:
    """Final rank from 1."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))


def search(corpus: DataFrame, vecs: DataFrame | VectorIndex, query: str, q: DataFrame, options: SearchOptions | None = None, index: TextIndex | None = None) -> DataFrame:
    """(doc_id, score, vector_score, fts_score, rank): recall twice as many by either way, fuse, cut, normalise, rank.

    ``corpus``: doc_id, tenant, collection, path, text; ``vecs``: doc_id, embedding, and best also tenant, collection and path, as no join is needed then, or an index with
    these columns; ``q``: one row with the query's vector; ``index``: the corpus's kept index, without which its texts are read.
    """
    o = options or SearchOptions()
    found, mode = live(corpus, o), MODES[o.mode]
    many = 2 * o.top_k
    nothing = F.lit(None).cast("double")
    terms = fulltext.query_terms(query)
    filtered = o.tenant is not None or bool(o.path_prefix) or bool(o.collections)
    texts, among = (corpus, found) if index is None else (index, found if filtered else None)
    if mode == "vector":
        hits = vector_live(found, vecs, q, many, o).select("doc_id", "score", F.col("score").alias("vector_score"), nothing.alias("fts_score"))
    elif mode == "fts":
        hits = lexical_top(texts, among, terms, many, o.match_all).select("doc_id", "score", nothing.alias("vector_score"), F.col("score").alias("fts_score"))
    else:
        hits = rrf(vector_live(found, vecs, q, many, o), lexical_top(texts, among, terms, many, o.match_all))
    hits = normalise(hits.orderBy(F.desc("score"), "doc_id").limit(o.top_k)).withColumn("score", F.round("score", 6))
    if o.min_score is not None:
        hits = hits.filter(F.col("score") >= o.min_score)
    return number(hits)


def enrich(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits with their documents' columns; the path falls back on the id where the document is gone."""
    return docs.withColumnRenamed("doc_id", "__id").join(F.broadcast(hits), F.col("__id") == F.col("doc_id"), "right").withColumn("path", F.coalesce("path", F.col("doc_id").cast("string"))).drop("__id")


# --- rerankers: expressions over bounded hits with columns score, heading, content, line_start


def heuristic(query: str) -> Column:
    """Word matches, heading and phrase hits, the score so far, an early line, and length."""
    q, content, heading = F.lit(query), F.col("content"), F.coalesce("heading", F.lit(""))
    size = F.octet_length("content")
    return (
        0.1 * T.word_matches(q, content)
        + F.when(T.contains_any_word(q, heading), 2.0).otherwise(0.0)
        + 0.3 * T.word_matches(q, heading)
        + F.when(T.contains_phrase(q, content), 1.5).otherwise(0.0)
        + F.when(T.contains_phrase(q, heading), 2.0).otherwise(0.0)
        + 3.0 * F.col("score")
        + F.when((F.col("line_start") > 0) & (F.col("line_start") < 50), 0.2).otherwise(0.0)
        + F.when(size < 50, -0.5).when(size > 500, 0.1).otherwise(0.0)
    )


def candidate_bm25(query: str) -> Column:
    """Half the score so far, half a BM25 without idf over the candidates, lengths in bytes."""
    words = F.filter(T.split_words(T.ascii_lower(F.lit(query))), lambda w: F.octet_length(w) >= 2)
    content = T.split_words(T.ascii_lower(F.col("content")))
    size = F.octet_length("content").cast("double")
    mean = F.avg(size).over(Window.partitionBy())
    mean = F.when(mean > 0, mean).otherwise(F.lit(1.0))
    saturate = 1.5 * (1 - 0.75 + 0.75 * size / mean)

    def gain(w):
        f = F.size(F.filter(content, lambda c: c == w)).cast("double")
        return F.when(f > 0, f / (f + saturate)).otherwise(F.lit(0.0))

    return 0.5 * F.aggregate(words, F.lit(0.0), lambda s, w: s + gain(w)) + 0.5 * F.col("score")


def ensemble(scores: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """Weighted reciprocal ranks of several rerankers' score columns; a wrong number of weights means 1 each."""
    if not weights or len(weights) != len(scores):
        weights = [1.0] * len(scores)
    if len(scores) == 1:
        return F.col(scores[0])
    total = F.lit(0.0)
    for name, w in zip(scores, weights):
        rank = F.row_number().over(Window.orderBy(F.desc(F.round(name, 6)), "doc_id"))
        total = total + F.lit(float(w)) / rank
    return total


def reranked(hits: DataFrame, query: str, how: str | Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Bounded hits (doc_id, score, heading, content, line_start, ...) with the scores and ranks that a reranker gives."""
    if callable(how):
        return number(how(hits, query).drop("rank"))
    scored = hits.withColumns({"__heuristic": heuristic(query), "__bm25": candidate_bm25(query)})
    score = F.col(f"__{how}") if how != "ensemble" else ensemble(["__heuristic", "__bm25"], [0.7, 0.3])
    return number(scored.withColumn("score", F.round(score, 6)).drop("rank", "__heuristic", "__bm25"))
