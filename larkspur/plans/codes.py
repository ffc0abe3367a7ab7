"""Queries on product quantisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.vectors import hamming, squared_euclidean
from larkspur.operators import quantise as Q
from larkspur.plans.registry import VECS, query, vectors

N, WIDTH = Q.SUBSPACES, 64 // Q.SUBSPACES
#: The parts of the vectors with the smallest ids are the codebook's centroids.
BOOK = f"""{VECS}, book AS (SELECT doc_id AS code, s AS sub, (embedding::DOUBLE[])[s * {WIDTH} + 1:(s + 1) * {WIDTH}] AS c FROM (SELECT * FROM vecs ORDER BY doc_id LIMIT {Q.CODES}), range({N}) t(s)),
part AS (SELECT doc_id, s AS sub, (embedding::DOUBLE[])[s * {WIDTH} + 1:(s + 1) * {WIDTH}] AS p FROM vecs, range({N}) t(s)),
near AS (SELECT doc_id, p.sub, code, round(list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: (p[i] - c[i]) ** 2)), 9) AS d FROM part p JOIN book b ON p.sub = b.sub),
coded AS (SELECT doc_id, sub, arg_min(code, (d, code)) AS code, min(d) AS d FROM near GROUP BY 1, 2),
codes AS (SELECT doc_id, list(code::INT ORDER BY sub) AS codes, sum(d) AS error FROM coded GROUP BY 1)"""


def book_and_vectors(spark, sf_dir):
    vecs = vectors(spark, sf_dir)
    return Q.fixed_codebook(vecs), vecs


@query("pq_encode", f"WITH {BOOK} SELECT doc_id, array_to_string(codes, ',') AS codes FROM codes")
def pq_encode(spark, sf_dir):
    book, vecs = book_and_vectors(spark, sf_dir)
    return Q.encode(vecs, book).select("doc_id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


@query("pq_reconstruction_error", f"WITH {BOOK} SELECT doc_id, round(error, 4) AS error FROM codes")
def pq_reconstruction_error(spark, sf_dir):
    book, vecs = book_and_vectors(spark, sf_dir)
    back = Q.decode(Q.encode(vecs, book), book).withColumnRenamed("embedding", "back")
    return vecs.join(back, "doc_id").select("doc_id", F.round(squared_euclidean(F.col("embedding"), F.col("back")), 4).alias("error"))


@query("pq_hamming_topk", f"WITH {BOOK}, q AS (SELECT codes AS qc FROM codes WHERE doc_id = 0) SELECT doc_id, round(list_sum(list_transform(range(1, {N + 1}), lambda i: bit_count(xor(codes[i], qc[i])))) * {WIDTH} * 0.1e0, 6) AS distance FROM codes, q ORDER BY distance, doc_id LIMIT 20")
def pq_hamming_topk(spark, sf_dir):
    book, vecs = book_and_vectors(spark, sf_dir)
    codes = Q.encode(vecs, book)
    asked = codes.filter("doc_id = 0").select(F.col("codes").alias("qc"))
    scored = codes.crossJoin(F.broadcast(asked)).select("doc_id", F.round(hamming(F.col("codes"), F.col("qc")) * WIDTH * 0.1, 6).alias("distance"))
    return scored.orderBy("distance", "doc_id").limit(20)


@query("pq_adc_topk", f"WITH {BOOK}, q AS (SELECT sub, code, d FROM near WHERE doc_id = 0) SELECT c.doc_id, round(sum(q.d), 6) AS distance FROM coded c JOIN q ON q.sub = c.sub AND q.code = c.code GROUP BY 1 ORDER BY distance, c.doc_id LIMIT 20")
def pq_adc_topk(spark, sf_dir):
    book, vecs = book_and_vectors(spark, sf_dir)
    lookup = Q.adc_table(vecs.filter("doc_id = 0").select(F.col("embedding").alias("q")), book)
    scored = Q.encode(vecs, book).crossJoin(F.broadcast(lookup)).select("doc_id", F.round(Q.adc_distance(F.col("codes"), F.col("lookup")), 6).alias("distance"))
    return scored.orderBy("distance", "doc_id").limit(20)


@query("pq_memory", f"WITH {VECS} SELECT count(*) AS vectors, count(*) * {N} AS code_bytes, {Q.CODES * 64 * 4}::BIGINT AS codebook_bytes, (count(*) * 64 * 4)::BIGINT AS raw_bytes FROM vecs")
def pq_memory(spark, sf_dir):
    n = vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("vectors"))
    return n.select("vectors", (F.col("vectors") * N).alias("code_bytes"), F.lit(Q.CODES * 64 * 4).cast("long").alias("codebook_bytes"), (F.col("vectors") * 64 * 4).alias("raw_bytes"))


@query("pq_train")
def pq_train(spark, sf_dir):
    """A trained codebook; its error against the fixed one is tested."""
    return Q.train(vectors(spark, sf_dir))
