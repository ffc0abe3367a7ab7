"""Queries on the text and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as V
from larkspur.plans.registry import DOCS, VECS, documents, query, table, vectors

WORDS = "list_filter(regexp_split_to_array({0}, '[ ,.\\n\\t]+'), lambda x: x <> '')"
A_LOWER = f"translate({{0}}, '{T.UPPER}', '{T.LOWER}')"
PROBE = "the of and, La DE token"
DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"


def probe(spark, sf_dir):
    """Documents' vectors beside the vector of id 0."""
    vecs = vectors(spark, sf_dir)
    return vecs.crossJoin(F.broadcast(vecs.filter("doc_id = 0").select(F.col("embedding").alias("q"))))


WITH_PROBE = f"{VECS}, probe AS (SELECT v.*, q.embedding AS q FROM vecs v, vecs q WHERE q.doc_id = 0)"


@query("cosine_similarity", f"WITH {WITH_PROBE} SELECT doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM probe")
def cosine_similarity(spark, sf_dir):
    return probe(spark, sf_dir).select("doc_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("cosine_distance", f"WITH {WITH_PROBE} SELECT doc_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM probe")
def cosine_distance(spark, sf_dir):
    return probe(spark, sf_dir).select("doc_id", F.round(V.cosine_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("l2_distance", f"WITH {WITH_PROBE} SELECT doc_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 6) AS distance FROM probe")
def l2_distance(spark, sf_dir):
    return probe(spark, sf_dir).select("doc_id", F.round(V.l2_distance(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query("sq_euclidean", f"WITH {WITH_PROBE} SELECT doc_id, round(list_distance(embedding::DOUBLE[], q::DOUBLE[]) ** 2, 6) AS distance FROM probe")
def sq_euclidean(spark, sf_dir):
    return probe(spark, sf_dir).select("doc_id", F.round(V.squared_euclidean(F.col("embedding"), F.col("q")), 6).alias("distance"))


@query(
    "vector_normalize",
    f"""WITH {VECS}, n AS (SELECT doc_id, embedding::DOUBLE[] AS v, sqrt({DOT.format('embedding', 'embedding')}) AS n FROM vecs)
    SELECT doc_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) AS norm FROM n""",
)
def vector_normalize(spark, sf_dir):
    unit = vectors(spark, sf_dir).select("doc_id", V.normalize(F.col("embedding")).alias("u"))
    return unit.select("doc_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.round(V.norm(F.col("u")), 6).alias("norm"))


@query("zero_vector_filter", f"WITH {VECS} SELECT doc_id, label::BIGINT AS label FROM vecs WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def zero_vector_filter(spark, sf_dir):
    return vectors(spark, sf_dir).filter(~V.is_zero(F.col("embedding"))).select("doc_id", F.col("label").cast("long").alias("label"))


@query("vector_dimension", f"WITH {VECS} SELECT len(embedding)::BIGINT AS dim, count(*) AS n FROM vecs GROUP BY 1")
def vector_dimension(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "hamming_codes",
    f"""WITH {WITH_PROBE}, c AS (SELECT doc_id, list_transform(list_slice(embedding, 1, 8), lambda x: floor(x::DOUBLE * 100)::INT + 128) AS a, list_transform(list_slice(q, 1, 8), lambda x: floor(x::DOUBLE * 100)::INT + 128) AS b FROM probe)
    SELECT doc_id, list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a[i], b[i]))))::BIGINT AS bits FROM c""",
)
def hamming_codes(spark, sf_dir):
    code = lambda c: F.transform(F.slice(c, 1, 8), lambda x: (F.floor(x.cast("double") * 100) + 128).cast("int"))
    return probe(spark, sf_dir).select("doc_id", V.hamming(code(F.col("embedding")), code(F.col("q"))).cast("long").alias("bits"))


@query("pq_ratio", "SELECT s::BIGINT AS subspaces, (64 * 4 / s)::DOUBLE AS ratio FROM (VALUES (4), (8), (16)) t(s)")
def pq_ratio(spark, sf_dir):
    return spark.createDataFrame([(s, V.compression_ratio(64, s)) for s in (4, 8, 16)], "subspaces long, ratio double")


@query("ascii_lower", f"WITH {DOCS} SELECT doc_id, sha256({A_LOWER.format('text')}) AS digest FROM docs")
def ascii_lower(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.sha2(T.ascii_lower(F.col("text")), 256).alias("digest"))


@query("split_words", f"WITH {DOCS}, w AS (SELECT doc_id, {WORDS.format('text')} AS words FROM docs) SELECT doc_id, len(words)::BIGINT AS n, array_to_string(words[1:5], '|') AS head FROM w")
def split_words(spark, sf_dir):
    w = documents(spark, sf_dir).select("doc_id", T.split_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 5), "|").alias("head"))


MATCHES = f"""len(list_filter({WORDS.format(A_LOWER.format("'" + PROBE + "'"))}, lambda w: strlen(w) >= 2 AND list_contains({WORDS.format(A_LOWER.format('text'))}, w)))::BIGINT"""


@query("count_word_matches", f"WITH {DOCS} SELECT doc_id, {MATCHES} AS matches FROM docs")
def count_word_matches(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.word_matches(F.lit(PROBE), F.col("text")).cast("long").alias("matches"))


@query("contains_word", f"WITH {DOCS} SELECT doc_id, {MATCHES} > 0 AS found FROM docs")
def contains_word(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.contains_any_word(F.lit(PROBE), F.col("text")).alias("found"))


@query("contains_sequential", f"WITH {DOCS} SELECT doc_id, contains({A_LOWER.format('text')}, 'of the') AS found FROM docs")
def contains_sequential(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.contains_phrase(F.lit("Of The"), F.col("text")).alias("found"))


@query("content_hash_ids", f"WITH {DOCS} SELECT doc_id, substr(sha256(path || text), 1, 16) AS chunk_id, substr(sha256(text), 1, 16) AS content_id, substr(sha256(text), 1, 32) AS memory_id FROM docs")
def content_hash_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.hash_id(F.concat("path", "text")).alias("chunk_id"), T.hash_id(F.col("text")).alias("content_id"), T.hash_id(F.col("text"), 32).alias("memory_id"))


@query("token_estimate", f"WITH {DOCS} SELECT doc_id, (strlen(text) // 4)::BIGINT AS tokens FROM docs")
def token_estimate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("summary_truncate", f"WITH {DOCS} SELECT doc_id, CASE WHEN strlen(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS summary, CASE WHEN strlen(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS preview FROM docs")
def summary_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.ellipsis(F.col("text"), 100).alias("summary"), T.ellipsis(F.col("text"), 300).alias("preview"))


def smart_sql(source: str, text: str, budget: str, keep: str) -> str:
    """SELECT ``keep``, ``cut`` of smart truncation over a relation, place by place of the sentence ends."""
    steps, best = [], "0"
    for i, end in enumerate("。.！!？?\n"):
        literal = "chr(10)" if end == "\n" else f"'{end}'"
        at = f"CASE WHEN contains(head, {literal}) THEN length(head) - strpos(reverse(head), {literal}) + 1 ELSE 0 END"
        steps.append(f"s{i} AS (SELECT *, CASE WHEN {at} > CASE WHEN {best} > 0 THEN {best} + 1 ELSE 0 END THEN {at} ELSE {best} END AS b{i} FROM {'s' + str(i - 1) if i else 'cutting'})")
        best = f"b{i}"
    return f"""cutting AS (SELECT *, substr({text}, 1, ({budget}) * 2) AS head FROM {source}), {', '.join(steps)},
    smart AS (SELECT {keep}, CASE WHEN strlen({text}) <= ({budget}) * 2 THEN {text} WHEN b6 > 0 THEN substr(head, 1, b6) || '{T.CUT_MARK}' ELSE head || '...' END AS cut FROM s6)"""


@query("smart_truncate", f"WITH {DOCS}, {smart_sql('docs', 'text', '60', 'doc_id')} SELECT doc_id, cut FROM smart")
def smart_truncate(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.smart_truncate(F.col("text"), F.lit(60)).alias("cut"))


@query(
    "highlights",
    f"""WITH {DOCS}, p AS (SELECT doc_id, text, strpos({A_LOWER.format('text')}, 'the') AS place FROM docs)
    SELECT doc_id, substr(text, greatest(place - 20, 1), 43) AS snippet, (place - 1)::BIGINT AS start, (place + 2)::BIGINT AS "end" FROM p WHERE place > 0""",
)
def highlights(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", T.highlights("the", F.col("text")).alias("h")).filter("h is not null")
    return found.select("doc_id", F.col("h.text").alias("snippet"), "h.start", "h.end")


#: A document as Markdown and as code: a heading that depends on the id before its text.
HEADED = "CASE doc_id % 4 WHEN 0 THEN '# ' || collection || chr(10) || text WHEN 1 THEN '### Part ' || doc_id || chr(10) || text WHEN 2 THEN 'title:' || doc_id || chr(10) || text ELSE text END"
CODED = "CASE doc_id % 4 WHEN 0 THEN 'func (r *Row) Read' || doc_id || '() {' || chr(10) || text WHEN 1 THEN 'type Row' || doc_id || ' struct {' || chr(10) || text WHEN 2 THEN 'const (' || chr(10) || text ELSE text END"


@query(
    "detect_heading",
    f"""WITH {DOCS}, h AS (SELECT doc_id, trim(split_part({HEADED}, chr(10), 1)) AS line FROM docs), m AS (SELECT doc_id, line, regexp_extract(line, '^(#{{1,3}}) ', 1) AS marks FROM h)
    SELECT doc_id, CASE WHEN marks <> '' THEN trim(regexp_replace(line, '^#{{1,3}} ', '')) WHEN contains(line, ':') AND NOT contains(line, ' ') THEN line ELSE 'section' END AS heading,
    (CASE WHEN marks <> '' THEN length(marks) WHEN contains(line, ':') AND NOT contains(line, ' ') THEN 1 ELSE 0 END)::INT AS level FROM m""",
)
def detect_heading(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.detect_heading(F.expr(HEADED)).alias("h")).select("doc_id", "h.heading", "h.level")


@query(
    "go_heading",
    f"""WITH {DOCS}, h AS (SELECT doc_id, trim(split_part({CODED}, chr(10), 1)) AS line FROM docs),
    m AS (SELECT doc_id, regexp_extract(line, '^(func|type|package|const|var)\\b', 1) AS kind, regexp_extract(line, '^(?:func\\s+(?:\\([^)]*\\)\\s*)?|type\\s+|package\\s+|const\\s+|var\\s+)([A-Za-z_]\\w*)', 1) AS name FROM h)
    SELECT doc_id, CASE WHEN kind = '' THEN 'code' WHEN name = '' THEN kind ELSE kind || ' ' || name END AS heading, (CASE WHEN kind IN ('func', 'type') THEN 2 WHEN kind <> '' THEN 1 ELSE 0 END)::INT AS level FROM m""",
)
def go_heading(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.code_heading(F.expr(CODED)).alias("h")).select("doc_id", "h.heading", "h.level")


@query("breadcrumb", f"WITH {DOCS} SELECT doc_id, 'Section: [' || path || '] > ' || collection || chr(10) || chr(10) AS section, 'File: ' || path || ' | ' || collection || chr(10) || chr(10) AS file FROM docs")
def breadcrumb(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.breadcrumb(F.col("path"), F.col("collection")).alias("section"), T.breadcrumb(F.col("path"), F.col("collection"), "file").alias("file"))


@query("cache_key", f"WITH {DOCS} SELECT doc_id, sha256('q=' || substr(text, 1, 20) || '_top=10_mode=hybrid_user=' || tenant) AS l1, substr(sha256(tenant || '|' || substr(text, 1, 20) || '|hybrid|10'), 1, 32) AS l2 FROM docs")
def cache_key(spark, sf_dir):
    q = F.substring("text", 1, 20)
    l1 = F.sha2(F.concat(F.lit("q="), q, F.lit("_top=10_mode=hybrid_user="), "tenant"), 256)
    return documents(spark, sf_dir).select("doc_id", l1.alias("l1"), T.hash_id(F.concat_ws("|", "tenant", q, F.lit("hybrid"), F.lit("10")), 32).alias("l2"))


@query("apikey_prefix", "SELECT 'ck_' || user_id || '_' || max(event_id) || '_x' AS key, 'ck_' || user_id AS prefix, max(event_id) || '_x' AS rest FROM events GROUP BY user_id")
def apikey_prefix(spark, sf_dir):
    keys = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("e")).select(F.concat(F.lit("ck_"), "user_id", F.lit("_"), "e", F.lit("_x")).alias("key"))
    parts = F.split("key", "_", 3)
    return keys.select("key", F.concat_ws("_", parts[0], parts[1]).alias("prefix"), parts[2].alias("rest"))


@query("backoff_schedule", "SELECT n::BIGINT AS attempt, least(200 * 2 ** (n - 1), 5000)::BIGINT AS wait_ms FROM range(1, 9) t(n)")
def backoff_schedule(spark, sf_dir):
    return spark.range(1, 9).select(F.col("id").alias("attempt"), F.least(200 * F.pow(F.lit(2), F.col("id") - 1), F.lit(5000)).cast("long").alias("wait_ms"))


PATHS = "CASE doc_id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN '.git/objects/' WHEN 2 THEN 'web/node_modules/x/' WHEN 3 THEN '.venv/lib/' WHEN 4 THEN 'vendor/' ELSE 'my.git.notes/' END || doc_id || CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.YML' WHEN 2 THEN '.cxx' WHEN 3 THEN '.h' WHEN 4 THEN '.exe' WHEN 5 THEN '.bash' ELSE '' END"
_SUFFIX = "lower(regexp_extract(p, '\\.([^./\\\\]+)$', 1))"
_KIND = f"CASE {_SUFFIX} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.SAME_TYPE.items()) + f" ELSE {_SUFFIX} END"


@query("file_type_dispatch", f"WITH {DOCS}, f AS (SELECT doc_id, {PATHS} AS p FROM docs), k AS (SELECT doc_id, p, {_KIND} AS kind FROM f) SELECT doc_id, p AS path, CASE WHEN kind IN ({', '.join(repr(x) for x in T.SUPPORTED)}) THEN kind END AS file_type FROM k")
def file_type_dispatch(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(PATHS).alias("path")).withColumn("file_type", T.file_type(F.col("path")))


@query("scan_exclude", f"WITH {DOCS}, f AS (SELECT doc_id, {PATHS} AS path FROM docs) SELECT doc_id, path FROM f WHERE len(list_filter(string_split(path, '/'), lambda x: x IN ({', '.join(repr(x) for x in T.EXCLUDED)}))) = 0")
def scan_exclude(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.expr(PATHS).alias("path")).filter(~T.excluded(F.col("path")))


@query("scan_pages", "SELECT page_id, url AS path, strlen(html)::BIGINT AS file_size, substr(sha256(html), 1, 16) AS content_hash FROM pages")
def scan_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("long").alias("file_size"), T.hash_id(F.col("html")).alias("content_hash"))


@query("min_chars_filter", f"WITH {DOCS} SELECT doc_id FROM docs WHERE strlen(trim(text)) + 2 > 50")
def min_chars_filter(spark, sf_dir):
    return documents(spark, sf_dir).filter(F.octet_length(F.trim("text")) + 2 > 50).select("doc_id")


@query(
    "embed_hash_provider",
    f"""WITH {DOCS}, t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(lower(text), '{T.MARKED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS term FROM docs),
    b AS (SELECT doc_id, (('0x' || substr(md5(term), 1, 4))::BIGINT % 64)::BIGINT AS bucket, count(*)::DOUBLE AS n FROM t GROUP BY 1, 2),
    s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1)
    SELECT doc_id, bucket, round(n / norm, 6) AS weight FROM b JOIN s USING (doc_id)""",
)
def embed_hash_provider(spark, sf_dir):
    from larkspur.operators.embed import hash_embedding

    return hash_embedding(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "bucket", F.round("weight", 6).alias("weight"))
