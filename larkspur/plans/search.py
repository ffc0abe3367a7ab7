"""Queries on full-text search, vector search, fusion and reranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import fulltext as X
from larkspur.operators import search as S
from larkspur.operators import store
from larkspur.operators.textindex import TextIndex
from larkspur.plans.registry import DOCS, VECS, documents, query, search_vectors, table, text_index, vectors

ASK = "was for pathetic"
TERMS = X.query_terms(ASK)
K = 10


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({text}), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(terms: list[str]) -> str:
    """Relations tok, len, st, tf, df, bm and bmr (doc_id, score, n_terms) of docs."""
    return f"""tok AS (SELECT doc_id, tenant, {tokens_sql('text')} AS terms FROM docs), len AS (SELECT doc_id, len(terms) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS t FROM tok) WHERE t IN ({', '.join(repr(t) for t in terms)}) GROUP BY 1, 2),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS raw, count(*) AS n_terms FROM tf JOIN df USING (t) JOIN len USING (doc_id), st GROUP BY doc_id),
bmr AS (SELECT doc_id, round(raw, 6) AS score, n_terms FROM bm)"""


TOK = f"{DOCS}, tok AS (SELECT doc_id, tenant, {tokens_sql('text')} AS terms FROM docs)"
COS = f"""{VECS}, cos AS (SELECT v.doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM vecs v, vecs q WHERE q.doc_id = 0)"""


def top_sql(source: str, k: int, where: str = "true") -> str:
    return f"(SELECT doc_id, score FROM {source} WHERE {where} ORDER BY score DESC, doc_id LIMIT {k})"


BMR = f"{DOCS}, {bm25_sql(TERMS)}"
#: A question in the language of one tenant.
FRENCH, ASK_FRENCH = "fr", ["entre", "pour", "rementelle", "la"]
HYBRID = f"""{BMR}, {COS},
v AS (SELECT doc_id, score AS vector_score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM {top_sql('cos', 2 * K, 'doc_id IN (SELECT doc_id FROM docs)')}),
f AS (SELECT doc_id, score AS fts_score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM {top_sql('bmr', 2 * K)}),
fused AS (SELECT coalesce(v.doc_id, f.doc_id) AS doc_id, round(coalesce(1e0 / (61 + v.r), 0) + coalesce(1e0 / (61 + f.r), 0), 12) AS score, vector_score, fts_score FROM v FULL JOIN f ON v.doc_id = f.doc_id),
cut AS (SELECT * FROM fused ORDER BY score DESC, doc_id LIMIT {K}),
norm AS (SELECT doc_id, round(CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE score END, 6) AS score, vector_score, fts_score FROM cut),
hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::BIGINT AS rank FROM norm)"""


def probe(spark, sf_dir):
    return vectors(spark, sf_dir).filter("doc_id = 0").select(F.col("embedding").alias("q"))


def hybrid(spark, sf_dir, **options):
    vecs = search_vectors(spark, sf_dir).vectors()
    return S.search(documents(spark, sf_dir), vecs, ASK, probe(spark, sf_dir), S.SearchOptions(**({"top_k": K} | options)), text_index(spark, sf_dir))


def live_vectors(spark, sf_dir, k, **options):
    return S.vector_live(documents(spark, sf_dir), search_vectors(spark, sf_dir).vectors(), probe(spark, sf_dir), k, S.SearchOptions(**options))


def bm25(spark, sf_dir):
    return text_index(spark, sf_dir).bm25(TERMS)


@query("fts_tokenize", f"WITH {TOK} SELECT doc_id, len(terms)::BIGINT AS n, sha256(array_to_string(terms, ' ')) AS digest FROM tok")
def fts_tokenize(spark, sf_dir):
    t = T.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("fts_postings", f"WITH {TOK} SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY 1, 2")
def fts_postings(spark, sf_dir):
    return X.postings(documents(spark, sf_dir))


@query("term_frequency", f"WITH {TOK}, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY 1, 2) SELECT doc_id, count(*) AS n_terms, max(tf) AS max_tf, sum(tf)::BIGINT AS dl FROM p GROUP BY 1")
def term_frequency(spark, sf_dir):
    return X.postings(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.max("tf").alias("max_tf"), F.sum("tf").alias("dl"))


@query("bm25_term_stats", f"WITH {TOK}, p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY 1, 2), n AS (SELECT count(*) AS n, avg(len(terms)) AS a FROM tok) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(n) AS n_docs, round(any_value(a), 6) AS avgdl FROM p, n GROUP BY term")
def bm25_term_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    whole = X.lengths(docs).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return X.term_stats(X.postings(docs)).crossJoin(F.broadcast(whole))


@query("bm25_search", f"WITH {BMR} SELECT doc_id, score, n_terms FROM bmr ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark, sf_dir):
    return X.top(bm25(spark, sf_dir), 20)


@query("fts_topk", f"WITH {BMR} SELECT doc_id, score FROM bmr ORDER BY score DESC, doc_id LIMIT 5")
def fts_topk(spark, sf_dir):
    return X.top(bm25(spark, sf_dir).select("doc_id", "score"), 5)


TENANT_SQL = f"WITH {DOCS}, {bm25_sql(ASK_FRENCH)} SELECT doc_id, score FROM bmr JOIN docs USING (doc_id) WHERE tenant = '{FRENCH}' ORDER BY score DESC, doc_id LIMIT 20"


@query("bm25_tenant", TENANT_SQL)
@query("tenant_filtered_search", TENANT_SQL)
def bm25_tenant(spark, sf_dir):
    return S.lexical_top(text_index(spark, sf_dir), S.live(documents(spark, sf_dir), S.SearchOptions(tenant=FRENCH)), ASK_FRENCH, 20)


@query("bm25_topk_skipping", f"WITH {BMR} SELECT doc_id, score FROM bmr ORDER BY score DESC, doc_id LIMIT 5")
def bm25_topk_skipping(spark, sf_dir):
    """Only documents with a posting of a level that can reach the fifth score are scored."""
    return text_index(spark, sf_dir).top(TERMS, 5, skip=True)


#: The corpus after changes: one source's texts are longer, another one's documents are gone, and benchmark items have come.
CHANGED = """docs AS (SELECT doc_id, lang AS tenant, CASE WHEN source = 'src1' THEN text || ' was pathetic' ELSE text END AS text FROM documents WHERE coalesce(source, '') <> 'src2'
 UNION ALL SELECT 1000000000 + item_id, NULL, text FROM benchmark)"""


def changed_index(spark, sf_dir):
    """An index of the corpus that has taken these changes one by one."""
    docs = documents(spark, sf_dir).select("doc_id", "collection", "text")
    index = TextIndex.build(docs, f"{store.shared_folder(spark)}/text-index/changed-{uuid.uuid4().hex}", {"text": "text"})
    for new, gone in (
        (docs.filter("collection = 'src1'").withColumn("text", F.concat("text", F.lit(" was pathetic"))), None),
        (None, docs.filter("collection = 'src2'").select("doc_id")),
        (table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text"), None),
    ):
        index.change(new, gone, {"text": "text"})
    return index.as_it_is()


@query("index_changes_bm25", f"WITH {CHANGED}, {bm25_sql(TERMS)} SELECT doc_id, score, n_terms FROM bmr")
def index_changes_bm25(spark, sf_dir):
    return changed_index(spark, sf_dir).bm25(TERMS).withColumn("score", F.round("score", 6))


@query("index_changes_match", f"WITH {CHANGED}, t AS (SELECT doc_id, {tokens_sql('text')} AS terms FROM docs) SELECT doc_id FROM t WHERE contains(' ' || array_to_string(terms, ' ') || ' ', ' was pathetic ') OR list_contains(terms, 'for')")
def index_changes_match(spark, sf_dir):
    return changed_index(spark, sf_dir).match('"was pathetic" OR for')


@query("index_changes_terms", f"WITH {CHANGED}, t AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM docs) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def index_changes_terms(spark, sf_dir):
    return changed_index(spark, sf_dir).terms().select("term", "df", "cf")


@query(
    "bm25_multicolumn",
    f"""WITH {DOCS}, tok AS (SELECT doc_id, {tokens_sql('text')} AS a, {tokens_sql('collection')} AS b, {tokens_sql('path')} AS c FROM docs),
    cnt AS (SELECT doc_id, len(a) + len(b) + len(c) AS dl, {', '.join(f"(len(list_filter(a, lambda x: x = '{t}')) + 2 * len(list_filter(b, lambda x: x = '{t}')) + len(list_filter(c, lambda x: x = '{t}')))::DOUBLE AS f{i}" for i, t in enumerate(['src3', 'was']))} FROM tok),
    st AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM cnt)
    SELECT doc_id, round({' + '.join(f'greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / a))' for i in range(2))}, 6) AS score FROM cnt, st WHERE f0 > 0 OR f1 > 0 ORDER BY score DESC, doc_id LIMIT 20""",
)
def bm25_multicolumn(spark, sf_dir):
    return X.top(text_index(spark, sf_dir).bm25(["src3", "was"], {"text": 1.0, "collection": 2.0, "path": 1.0}).select("doc_id", "score"), 20)


def matching(name: str, q: str, sql: str):
    @query(name, f"WITH {DOCS}, t AS (SELECT doc_id, {tokens_sql('text')} AS terms, {tokens_sql('collection')} AS col FROM docs) SELECT doc_id FROM t WHERE {sql}")
    def run(spark, sf_dir):
        return text_index(spark, sf_dir).match(q, ("text", "collection"))


matching("fts_match_and", "was Pathetic", "list_contains(terms, 'was') AND list_contains(terms, 'pathetic')")
matching("fts_match_or", "pathetic OR idiot", "list_contains(terms, 'pathetic') OR list_contains(terms, 'idiot')")
matching("fts_match_not", "was NOT (for OR pathetic)", "list_contains(terms, 'was') AND NOT (list_contains(terms, 'for') OR list_contains(terms, 'pathetic'))")
matching("fts_phrase", '"of the"', "contains(' ' || array_to_string(terms, ' ') || ' ', ' of the ')")
matching("fts_prefix", "path* was", "len(list_filter(terms, lambda x: starts_with(x, 'path'))) > 0 AND list_contains(terms, 'was')")
matching("fts_column", "collection:src3 AND text:was", "list_contains(col, 'src3') AND list_contains(terms, 'was')")
matching(
    "fts_near",
    "NEAR(for was, 5)",
    "len(list_filter(range(1, len(terms) + 1), lambda i: terms[i] = 'for' AND list_contains(terms[greatest(i - 6, 1):i + 6], 'was'))) > 0",
)


@query("fts_join_search", f"WITH {BMR}, h AS (SELECT doc_id, score FROM bmr WHERE n_terms = {len(TERMS)} ORDER BY score DESC, doc_id LIMIT 20) SELECT doc_id, score, tenant, collection, path FROM h JOIN docs USING (doc_id)")
def fts_join_search(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = S.lexical_top(text_index(spark, sf_dir), None, TERMS, 20, match_all=True)
    return docs.select("doc_id", "tenant", "collection", "path").join(F.broadcast(hits), "doc_id")


@query("vector_topk_exact", f"WITH {DOCS}, {COS} SELECT doc_id, score FROM cos WHERE doc_id IN (SELECT doc_id FROM docs) ORDER BY score DESC, doc_id LIMIT 20")
def vector_topk_exact(spark, sf_dir):
    return live_vectors(spark, sf_dir, 20)


@query("vector_join_search", f"WITH {DOCS}, {COS} SELECT doc_id, score, path FROM cos JOIN docs USING (doc_id) WHERE tenant = 'en' ORDER BY score DESC, doc_id LIMIT 10")
def vector_join_search(spark, sf_dir):
    docs = S.live(documents(spark, sf_dir), S.SearchOptions(tenant="en"))
    return S.enrich(live_vectors(spark, sf_dir, 10, tenant="en"), docs).select("doc_id", "score", "path")


@query("hit_enrichment", f"WITH {DOCS}, {COS}, h AS {top_sql('cos', 10, 'doc_id IN (SELECT doc_id FROM docs)')} SELECT doc_id, score, tenant, collection, path, (strlen(text) // 4)::BIGINT AS token_count FROM h JOIN docs USING (doc_id)")
def hit_enrichment(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = live_vectors(spark, sf_dir, 10)
    return S.enrich(hits, docs).select("doc_id", "score", "tenant", "collection", "path", T.token_estimate(F.col("text")).alias("token_count"))


@query("overfetch_then_filter", f"WITH {DOCS}, {COS}, h AS {top_sql('cos', 60)} SELECT doc_id, round(1 - round(1 - score, 6), 6) AS score FROM h JOIN docs USING (doc_id) WHERE tenant = 'en' ORDER BY score DESC, doc_id LIMIT 10")
def overfetch_then_filter(spark, sf_dir):
    """Three times twice as many hits as asked for, filtered afterwards, so fewer may be left."""
    hits = X.top(S.vector_scores(vectors(spark, sf_dir), probe(spark, sf_dir)), 60)
    docs = documents(spark, sf_dir).filter("tenant = 'en'").select("doc_id")
    kept = docs.join(F.broadcast(hits), "doc_id").select("doc_id", F.round(1 - F.round(1 - F.col("score"), 6), 6).alias("score"))
    return kept.orderBy(F.desc("score"), "doc_id").limit(10)


@query("enrich_with_fallback", f"WITH {DOCS}, {COS}, h AS {top_sql('cos', 20)} SELECT h.doc_id, score, coalesce(path, h.doc_id::VARCHAR) AS path FROM h LEFT JOIN (SELECT * FROM docs WHERE doc_id % 2 = 0) d ON d.doc_id = h.doc_id")
def enrich_with_fallback(spark, sf_dir):
    hits = X.top(S.vector_scores(vectors(spark, sf_dir), probe(spark, sf_dir)), 20)
    return S.enrich(hits, documents(spark, sf_dir).filter("doc_id % 2 = 0")).select("doc_id", "score", "path")


@query("rrf_full_outer", f"WITH {HYBRID} SELECT doc_id, score, vector_score, fts_score FROM fused")
def rrf_full_outer(spark, sf_dir):
    return S.rrf(live_vectors(spark, sf_dir, 2 * K), S.lexical_top(text_index(spark, sf_dir), None, TERMS, 2 * K))


@query("hybrid_rrf_search", f"WITH {HYBRID} SELECT doc_id, score, vector_score, fts_score, rank FROM hits")
@query("rank_assign", f"WITH {HYBRID} SELECT doc_id, score, vector_score, fts_score, rank FROM hits")
def hybrid_rrf_search(spark, sf_dir):
    return hybrid(spark, sf_dir)


@query("normalize_scores", f"WITH {BMR}, h AS {top_sql('bmr', 20)} SELECT doc_id, round(score / max(score) OVER (), 6) AS score FROM h")
def normalize_scores(spark, sf_dir):
    return S.normalise(X.top(bm25(spark, sf_dir).select("doc_id", "score"), 20)).select("doc_id", F.round("score", 6).alias("score"))


def single_mode(source: str) -> str:
    return f"h AS {top_sql(source, K, 'doc_id IN (SELECT doc_id FROM docs)')} SELECT doc_id, round(score / max(score) OVER (), 6) AS score, row_number() OVER (ORDER BY round(score / (SELECT max(score) FROM h), 6) DESC, doc_id)::BIGINT AS rank FROM h"


@query("search_mode_vector", f"WITH {DOCS}, {COS}, {single_mode('cos')}")
def search_mode_vector(spark, sf_dir):
    return hybrid(spark, sf_dir, mode="vector").select("doc_id", "score", "rank")


@query("search_by_indexes", f"WITH {HYBRID}, plain AS (SELECT count(*) AS n FROM hits) SELECT 'hybrid' AS mode, n >= 1 AS found, true AS enough FROM plain")
def search_by_indexes(spark, sf_dir):
    """A hybrid search whose vectors come from the index, not from a scan: at least nine tenths of the hits of the exact one."""
    exact = {r["doc_id"] for r in hybrid(spark, sf_dir).collect()}
    found = S.search(documents(spark, sf_dir), search_vectors(spark, sf_dir), ASK, probe(spark, sf_dir), S.SearchOptions(top_k=K), text_index(spark, sf_dir))
    hits = {r["doc_id"] for r in found.collect()}
    return spark.createDataFrame([("hybrid", bool(hits), len(hits & exact) >= 0.9 * len(exact))], "mode string, found boolean, enough boolean")


@query("search_mode_fts", f"WITH {BMR}, {single_mode('bmr')}")
def search_mode_fts(spark, sf_dir):
    return hybrid(spark, sf_dir, mode="fts").select("doc_id", "score", "rank")


@query("search_min_score", f"WITH {HYBRID} SELECT doc_id, score, rank FROM hits WHERE score >= 0.5")
def search_min_score(spark, sf_dir):
    return hybrid(spark, sf_dir, min_score=0.5).select("doc_id", "score", "rank")


def filtered_fts(where: str) -> str:
    return f"WITH {BMR}, h AS (SELECT doc_id, score FROM bmr JOIN docs USING (doc_id) WHERE {where} ORDER BY score DESC, doc_id LIMIT {K}) SELECT doc_id, round(score / max(score) OVER (), 6) AS score FROM h"


@query("search_path_filter", filtered_fts("starts_with(path, 'docs/src1')"))
def search_path_filter(spark, sf_dir):
    return hybrid(spark, sf_dir, mode="fts", path_prefix="docs/src1").select("doc_id", "score")


@query("search_collections", filtered_fts("collection IN ('src3', 'src5')"))
def search_collections(spark, sf_dir):
    return hybrid(spark, sf_dir, mode="fts", collections=("src3", "src5")).select("doc_id", "score")


@query("search_projection", f"WITH {HYBRID} SELECT rank, score, coalesce(path, hits.doc_id::VARCHAR) AS path, collection AS section, substr(text, 1, 300) AS content, (strlen(text) // 4)::BIGINT AS token_count FROM hits LEFT JOIN docs USING (doc_id)")
def search_projection(spark, sf_dir):
    found = S.enrich(hybrid(spark, sf_dir), documents(spark, sf_dir))
    return found.select("rank", "score", "path", F.col("collection").alias("section"), F.substring("text", 1, 300).alias("content"), T.token_estimate(F.col("text")).alias("token_count"))


@query("tool_search_text", f"WITH {HYBRID} SELECT rank, '[' || rank || '] ' || path || chr(10) || CASE WHEN strlen(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS line FROM hits JOIN docs USING (doc_id)")
def tool_search_text(spark, sf_dir):
    found = S.enrich(hybrid(spark, sf_dir), documents(spark, sf_dir))
    return found.select("rank", F.concat(F.lit("["), "rank", F.lit("] "), "path", F.lit("\n"), T.ellipsis(F.col("text"), 300)).alias("line"))


# --- rerankers over the ten best by BM25

WORDS = "list_filter(regexp_split_to_array({0}, '[ ,.\\n\\t]+'), lambda x: x <> '')"
LOW = f"translate({{0}}, '{T.UPPER}', '{T.LOWER}')"
_Q = WORDS.format(LOW.format(f"'{ASK}'"))


def matches_sql(column: str) -> str:
    return f"len(list_filter({_Q}, lambda w: strlen(w) >= 2 AND list_contains({WORDS.format(LOW.format(column))}, w)))"


CAND = f"""{BMR}, h AS {top_sql('bmr', 20)}, cand AS (SELECT doc_id, score, collection AS heading, text AS content, (doc_id % 80)::BIGINT AS line_start, avg(strlen(text)) OVER () AS mean FROM h JOIN docs USING (doc_id)),
heur AS (SELECT *, 0.1e0 * {matches_sql('content')} + CASE WHEN {matches_sql('heading')} > 0 THEN 2.0e0 ELSE 0 END + 0.3e0 * {matches_sql('heading')}
 + CASE WHEN contains({LOW.format('content')}, '{ASK}') THEN 1.5e0 ELSE 0 END + CASE WHEN contains({LOW.format('heading')}, '{ASK}') THEN 2.0e0 ELSE 0 END + 3.0e0 * score
 + CASE WHEN line_start > 0 AND line_start < 50 THEN 0.2e0 ELSE 0 END + CASE WHEN strlen(content) < 50 THEN -0.5e0 WHEN strlen(content) > 500 THEN 0.1e0 ELSE 0 END AS a FROM cand),
cb AS (SELECT *, 0.5e0 * list_sum(list_transform({_Q}, lambda w: CASE WHEN strlen(w) < 2 THEN 0e0 ELSE len(list_filter({WORDS.format(LOW.format('content'))}, lambda c: c = w))::DOUBLE / nullif(len(list_filter({WORDS.format(LOW.format('content'))}, lambda c: c = w)) + 1.5e0 * (0.25e0 + 0.75e0 * strlen(content) / mean), 0) END)) + 0.5e0 * score AS b FROM heur)"""


def candidates(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = S.lexical_top(text_index(spark, sf_dir), None, TERMS, 20)
    found = S.enrich(hits, docs)
    return found.select("doc_id", "score", F.col("collection").alias("heading"), F.col("text").alias("content"), (F.col("doc_id") % 80).alias("line_start"))


@query("rerank_heuristic", f"WITH {CAND} SELECT doc_id, round(a, 6) AS score FROM heur")
def rerank_heuristic(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", F.round(S.heuristic(ASK), 6).alias("score"))


@query("rerank_bm25", f"WITH {CAND} SELECT doc_id, round(b, 6) AS score FROM cb")
def rerank_bm25(spark, sf_dir):
    return candidates(spark, sf_dir).select("doc_id", F.round(S.candidate_bm25(ASK), 6).alias("score"))


@query("rerank_ensemble", f"WITH {CAND} SELECT doc_id, round(0.7e0 / row_number() OVER (ORDER BY round(a, 6) DESC, doc_id) + 0.3e0 / row_number() OVER (ORDER BY round(b, 6) DESC, doc_id), 6) AS score FROM cb")
def rerank_ensemble(spark, sf_dir):
    both = candidates(spark, sf_dir).select("doc_id", S.heuristic(ASK).alias("a"), S.candidate_bm25(ASK).alias("b"))
    return both.select("doc_id", F.round(S.ensemble(["a", "b"], [0.7, 0.3]), 6).alias("score"))


# --- memories: conversation turns as documents of type memory

MEM = "mem AS (SELECT substr(sha256(text), 1, 32) AS memory_id, min(conv_id) AS conv_id, any_value(text) AS text, min(role) AS source FROM conversations GROUP BY text)"


def memories(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("text is not null")
    return turns.groupBy("text").agg(F.min("conv_id").alias("conv_id"), F.min("role").alias("source")).select(T.hash_id(F.col("text"), 32).alias("memory_id"), "conv_id", "text", "source")


_UNION = f"{DOCS}, {MEM}, both_kinds AS (SELECT 'd' || doc_id AS id, 'text' AS file_type, text FROM docs UNION ALL SELECT 'm' || memory_id, 'memory', text FROM mem WHERE strlen(trim(text)) + 2 > 50)"
_UB = f"""{_UNION}, tok AS (SELECT id, file_type, {tokens_sql('text')} AS terms FROM both_kinds), cnt AS (SELECT id, file_type, len(terms) AS dl, len(list_filter(terms, lambda x: x = 'was'))::DOUBLE AS f FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f > 0) AS d FROM cnt), sc AS (SELECT id, file_type, round(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score FROM cnt, st WHERE f > 0)"""


def both_kinds(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("text").alias("file_type"), "text")
    mem = memories(spark, sf_dir).filter(F.octet_length(F.trim("text")) + 2 > 50)
    return docs.unionByName(mem.select(F.concat(F.lit("m"), "memory_id").alias("id"), F.lit("memory").alias("file_type"), "text"))


@query("memory_search_pre", f"WITH {_UB} SELECT id, score FROM sc WHERE file_type = 'memory' ORDER BY score DESC, id LIMIT 10")
def memory_search_pre(spark, sf_dir):
    both = both_kinds(spark, sf_dir)
    scored = X.bm25(both, ["was"], "id").join(both.filter("file_type = 'memory'").select("id"), "id", "left_semi")
    return X.top(scored.select("id", "score"), 10, "id")


@query("memory_search_post", f"WITH {_UB}, h AS (SELECT id, file_type, score FROM sc ORDER BY score DESC, id LIMIT 20) SELECT id, score FROM h WHERE file_type = 'memory'")
def memory_search_post(spark, sf_dir):
    both = both_kinds(spark, sf_dir)
    hits = X.top(X.bm25(both, ["was"], "id").select("id", "score"), 20, "id")
    return both.filter("file_type = 'memory'").select("id").join(F.broadcast(hits), "id")


@query("memory_write", f"WITH {MEM} SELECT memory_id, 'memory://' || memory_id AS path, source, CASE WHEN strlen(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS summary, (strlen(text) // 4)::BIGINT AS token_count, strlen(trim(text)) + 2 > 50 AS searchable FROM mem")
def memory_write(spark, sf_dir):
    return memories(spark, sf_dir).select(
        "memory_id", F.concat(F.lit("memory://"), "memory_id").alias("path"), "source", T.ellipsis(F.col("text"), 100).alias("summary"), T.token_estimate(F.col("text")).alias("token_count"), (F.octet_length(F.trim("text")) + 2 > 50).alias("searchable")
    )


@query("memory_batch", "SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'error: role' WHEN trim(text) = '' THEN 'error: empty' ELSE 'saved' END AS outcome, substr(sha256(text), 1, 32) AS memory_id FROM conversations")
def memory_batch(spark, sf_dir):
    outcome = F.when(F.col("role") == "system", "error: role").when(F.trim("text") == "", "error: empty").otherwise("saved")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", outcome.alias("outcome"), T.hash_id(F.col("text"), 32).alias("memory_id"))


@query("memory_delete", f"WITH {MEM} SELECT memory_id, 'memory://' || memory_id AS path FROM mem WHERE memory_id NOT IN (SELECT substr(sha256(text), 1, 32) FROM conversations WHERE turn = 0)")
def memory_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "conversations").filter("turn = 0").select(T.hash_id(F.col("text"), 32).alias("memory_id"))
    return memories(spark, sf_dir).join(gone, "memory_id", "left_anti").select("memory_id", F.concat(F.lit("memory://"), "memory_id").alias("path"))


@query("memory_unsearchable", f"WITH {MEM} SELECT source, count(*) AS n FROM mem WHERE strlen(trim(text)) + 2 <= 50 GROUP BY source")
def memory_unsearchable(spark, sf_dir):
    return memories(spark, sf_dir).filter(F.octet_length(F.trim("text")) + 2 <= 50).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
