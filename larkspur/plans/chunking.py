"""Queries on chunkers, context packing and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import chunkers as C
from larkspur.operators import context as G
from larkspur.operators import folds, markdown
from larkspur.operators import search as S
from larkspur.plans.registry import DOCS, documents, query, table, text_index
from larkspur.plans.scalars import smart_sql
from larkspur.plans.search import BMR, TERMS, both_kinds, tokens_sql, top_sql

#: Documents with a heading, or a declaration, before every third line.
MARKED = "array_join(transform(split(text, '\n'), (x, i) -> CASE WHEN i % 3 = 0 THEN concat({0}, '\n', x) ELSE x END), '\n')"
MARKED_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN {0} || chr(10) || x ELSE x END), chr(10))"
HEADS = ("concat('## Part ', doc_id, ' ', i)", "'## Part ' || doc_id || ' ' || (i - 1)")
CODE = ("concat('func f', i, '() {')", "'func f' || (i - 1) || '() {'")
MAX = 128


def packed_sql(pieces: str, opens: str = "false", sep: str = "chr(10)", separator: int = 1, limit: int = MAX) -> str:
    """Relations piece(doc_id, pos, piece, tokens, bytes, opens) and packed(doc_id, chunk, pos, ...) by recursion over the pieces."""
    return f"""split AS (SELECT doc_id, {pieces} AS pieces FROM src), flat AS (SELECT doc_id, pieces, generate_subscripts(pieces, 1) AS pos FROM split),
    piece AS (SELECT doc_id, pos::BIGINT AS pos, pieces[pos] AS piece, (strlen(pieces[pos]) // 4)::BIGINT AS tokens, (strlen(pieces[pos]) + {separator})::BIGINT AS bytes, {opens} AS opens FROM flat),
    fold AS (SELECT doc_id, pos, 0::BIGINT AS chunk, tokens AS t, bytes AS b FROM piece WHERE pos = 1
      UNION ALL SELECT p.doc_id, p.pos, f.chunk + CASE WHEN f.b > 50 AND (f.t + p.tokens > {limit} OR p.opens) THEN 1 ELSE 0 END,
        CASE WHEN f.b > 50 AND (f.t + p.tokens > {limit} OR p.opens) THEN p.tokens ELSE f.t + p.tokens END,
        CASE WHEN f.b > 50 AND (f.t + p.tokens > {limit} OR p.opens) THEN p.bytes ELSE f.b + p.bytes END
      FROM fold f JOIN piece p ON p.doc_id = f.doc_id AND p.pos = f.pos + 1),
    packed AS (SELECT doc_id, pos, chunk, piece, tokens, bytes FROM fold JOIN piece USING (doc_id, pos)),
    chunk AS (SELECT doc_id, chunk, string_agg(piece, {sep} ORDER BY pos) AS content, sum(tokens)::BIGINT AS token_count, count(*) AS n_pieces, arg_min(piece, pos) AS first_piece FROM packed GROUP BY 1, 2 HAVING sum(bytes) > 50)"""


def keep(pieces: str) -> str:
    return f"list_filter({pieces}, lambda x: trim(x) <> '')"


NL = "chr(10)"
LINES = packed_sql(keep(f"string_split(text, {NL})"))
TITLED = r"'^#{1,6}\s+\S'"
SECTIONS = keep(r"string_split(regexp_replace(text, '(?m)^(#{1,6}\s)', chr(1) || '\1', 'g'), chr(1))")
DECLARED = keep(r"string_split(regexp_replace(text, '(?m)^(func|package|type|const|var)(\s)', chr(1) || '\1\2', 'g'), chr(1))")
BARE = r"'^#{1,6}\s+'"
DIGEST = "SELECT doc_id, chunk, sha256(content) AS digest, token_count, n_pieces FROM chunk"


def digest(chunks, *more):
    return chunks.select("doc_id", "chunk", F.sha2("content", 256).alias("digest"), "token_count", "n_pieces", *more)


def packed_lines(spark, sf_dir):
    return C.pack(documents(spark, sf_dir), C.lines(F.col("text")), max_tokens=MAX)


def chunked_lines(spark, sf_dir):
    return C.chunks(documents(spark, sf_dir), C.lines(F.col("text")), max_tokens=MAX)


@query("greedy_pack", f"WITH RECURSIVE {DOCS}, src AS (SELECT doc_id, text FROM docs), {LINES} SELECT doc_id, pos, chunk FROM packed")
def greedy_pack(spark, sf_dir):
    return packed_lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("pos"), "chunk")


@query("chunk_paragraphs", f"WITH RECURSIVE {DOCS}, src AS (SELECT doc_id, text FROM docs), {LINES} {DIGEST}")
def chunk_paragraphs(spark, sf_dir):
    return digest(chunked_lines(spark, sf_dir))


@query("chunk_overlap", f"WITH RECURSIVE {DOCS}, src AS (SELECT doc_id, text FROM docs), {LINES}, o AS (SELECT doc_id, chunk, content, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM chunk) SELECT doc_id, chunk, sha256(CASE WHEN before IS NULL THEN content ELSE right(before, 80) || chr(10) || content END) AS digest FROM o")
def chunk_overlap(spark, sf_dir):
    return C.overlapped(chunked_lines(spark, sf_dir), 80).select("doc_id", "chunk", F.sha2("content", 256).alias("digest"))


@query(
    "chunk_markdown",
    f"""WITH RECURSIVE {DOCS}, src AS (SELECT doc_id, {MARKED_SQL.format(HEADS[1])} AS text FROM docs), {packed_sql(keep(f'string_split(text, {NL})'), f'regexp_matches(pieces[pos], {TITLED})')},
    titled AS (SELECT doc_id, pos, chunk, last_value(CASE WHEN regexp_matches(piece, {TITLED}) THEN trim(regexp_replace(piece, {BARE}, '')) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM packed),
    first AS (SELECT doc_id, chunk, arg_min(coalesce(heading, 'section'), pos) AS heading FROM titled GROUP BY 1, 2)
    SELECT doc_id, chunk, sha256(content) AS digest, token_count, n_pieces, heading FROM chunk JOIN first USING (doc_id, chunk)""",
)
def chunk_markdown(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(MARKED.format(HEADS[0])).alias("text"))
    packed = C.pack(docs, C.lines(F.col("text")), C.is_heading, max_tokens=MAX)
    first = C.heading_in_effect(packed).groupBy("doc_id", "chunk").agg(F.min_by("heading", "pos").alias("heading"))
    return digest(C.chunks(docs, C.lines(F.col("text")), C.is_heading, max_tokens=MAX).join(first, ["doc_id", "chunk"]), "heading")


#: Documents as Markdown of all kinds of blocks: a line of words is a paragraph, a fenced block, a list or a quotation, with headings of both kinds between.
WORDY = r"filter(transform(split(text, '\n'), x -> trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', ' '))), x -> x <> '')"
AS_MARKDOWN = f"""array_join(transform({WORDY}, (x, i) -> concat(CASE WHEN i % 5 = 0 THEN concat('## Part ', i, ' ##\n\n') ELSE '' END,
 CASE i % 4 WHEN 0 THEN x WHEN 1 THEN concat('```\n# ', x, '\n```') WHEN 2 THEN concat('- ', x, '\n- again') ELSE concat('> ', x) END,
 CASE WHEN i % 7 = 6 THEN concat('\n\nUnder ', i, '\n-----\n\n***') ELSE '' END)), '\n\n')"""


@query(
    "chunk_markdown_blocks",
    r"""WITH src AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
    line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM src),
    block AS (SELECT doc_id, i, 0 AS j, 'heading' AS kind, 2 AS level, 'Part ' || i AS text FROM line WHERE i % 5 = 0
      UNION ALL SELECT doc_id, i, 1, CASE i % 4 WHEN 0 THEN 'paragraph' WHEN 1 THEN 'code' WHEN 2 THEN 'list' ELSE 'quote' END, CASE WHEN i % 4 = 1 THEN 1 ELSE 0 END,
        CASE i % 4 WHEN 1 THEN '```' || chr(10) || '# ' || l || chr(10) || '```' WHEN 2 THEN '- ' || l || chr(10) || '- again' ELSE l END FROM line
      UNION ALL SELECT doc_id, i, 2, 'heading', 2, 'Under ' || i FROM line WHERE i % 7 = 6)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j)::INT - 1 AS pos, kind, level::INT AS level, sha256(text) AS digest FROM block""",
)
def chunk_markdown_blocks(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(AS_MARKDOWN).alias("text"))
    return docs.select("doc_id", F.posexplode(markdown.blocks("text")).alias("pos", "b")).select("doc_id", "pos", "b.kind", "b.level", F.sha2("b.text", 256).alias("digest"))


@query(
    "chunk_text",
    f"""WITH RECURSIVE {DOCS}, src AS (SELECT doc_id, {MARKED_SQL.format(HEADS[1])} AS text FROM docs), {packed_sql(SECTIONS, 'true')}
    SELECT doc_id, chunk, sha256(content) AS digest, token_count, n_pieces, trim(regexp_replace(trim(split_part(first_piece, {NL}, 1)), {BARE}, '')) AS heading FROM chunk""",
)
def chunk_text(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(MARKED.format(HEADS[0])).alias("text"))
    chunks = C.chunks(docs, C.sections(F.col("text")), lambda p: F.lit(True), max_tokens=MAX)
    return digest(chunks, T.detect_heading(F.col("first_piece"))["heading"].alias("heading"))


@query(
    "chunk_code",
    f"""WITH RECURSIVE {DOCS}, src AS (SELECT doc_id, {MARKED_SQL.format(CODE[1])} AS text FROM docs), {packed_sql(DECLARED, 'true')}
    SELECT doc_id, chunk, sha256(content) AS digest, token_count, n_pieces, 'func ' || regexp_extract(first_piece, '^func\\s+([A-Za-z_]\\w*)', 1) AS heading FROM chunk""",
)
def chunk_code(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(MARKED.format(CODE[0])).alias("text"))
    chunks = C.chunks(docs, C.declarations(F.col("text")), lambda p: F.lit(True), max_tokens=MAX)
    return digest(chunks, T.code_heading(F.col("first_piece"))["heading"].alias("heading"))


@query(
    "chunk_pages",
    f"""WITH RECURSIVE src AS (SELECT page_id AS doc_id, replace(html, '</p>', {NL} || {NL}) AS text FROM pages), {packed_sql(keep(f'string_split(text, {NL} || {NL})'), 'false', f'{NL} || {NL}', 2)}
    SELECT doc_id, chunk, sha256(content) AS digest, token_count, n_pieces, 'Page ' || doc_id AS heading FROM chunk""",
)
def chunk_pages(spark, sf_dir):
    """Rows of ``pages`` as the pages of one print file."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.replace("html", F.lit("</p>"), F.lit("\n\n")).alias("text"))
    chunks = C.chunks(pages, C.paragraphs(F.col("text")), separator="\n\n", max_tokens=MAX)
    return digest(chunks, F.concat(F.lit("Page "), "doc_id").alias("heading"))


# --- token-budgeted context

HITS = f"h AS {top_sql('bmr', 50)}, hits AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, text AS content, (strlen(text) // 4)::BIGINT AS token_count FROM h JOIN docs USING (doc_id))"


def context_sql(budget: int) -> str:
    return f"""run AS (SELECT *, sum(token_count) OVER (ORDER BY rank) + 2 * (rank - 1) AS total FROM hits), seen AS (SELECT *, coalesce(lag(total) OVER (ORDER BY rank), 0) AS before FROM run),
    roomy AS (SELECT *, {budget} - CASE WHEN rank > 1 THEN before + 2 ELSE 0 END AS room FROM seen),
    parted AS (SELECT *, CASE WHEN total <= {budget} THEN 'full' WHEN rank = 1 OR (before <= {budget} AND room > 50) THEN 'cut' END AS part FROM roomy),
    cuttable AS (SELECT rank, content, room::INT AS room FROM parted WHERE part = 'cut'),
    {smart_sql('cuttable', 'content', 'room', 'rank')},
    pieces AS (SELECT p.rank, p.part, CASE WHEN part = 'full' THEN content ELSE cut END AS piece, CASE WHEN part = 'full' THEN token_count + CASE WHEN p.rank > 1 THEN 2 ELSE 0 END ELSE room END AS tokens FROM parted p LEFT JOIN smart s ON s.rank = p.rank WHERE part IS NOT NULL)
    SELECT coalesce(string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '') AS context, coalesce(sum(tokens), 0)::BIGINT AS token_count, {budget}::BIGINT AS token_budget, coalesce((SELECT max(total) FROM parted) > {budget}, false) AS truncated FROM pieces"""


def text_hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = S.number(S.lexical_top(text_index(spark, sf_dir), None, TERMS, 50))
    return docs.join(F.broadcast(hits), "doc_id").select("rank", F.col("text").alias("content"), T.token_estimate(F.col("text")).alias("token_count"))


@query("rag_context", f"WITH {BMR}, {HITS}, {context_sql(1500)}")
def rag_context(spark, sf_dir):
    return G.context(text_hits(spark, sf_dir), 1500)


@query("rag_prefix_budget", f"WITH {BMR}, {HITS}, run AS (SELECT rank, token_count, (sum(token_count) OVER (ORDER BY rank) + 2 * (rank - 1))::BIGINT AS total FROM hits) SELECT rank, token_count, total FROM run WHERE total <= 3000")
def rag_prefix_budget(spark, sf_dir):
    return G.budgeted(text_hits(spark, sf_dir), 3000).filter("part = 'full'").select("rank", "token_count", F.col("total").cast("long").alias("total"))


_MEMORY = f"""docs AS (SELECT substr(sha256(text), 1, 32) AS doc_id, text FROM conversations WHERE strlen(trim(text)) + 2 > 50 GROUP BY text), tok AS (SELECT doc_id, {tokens_sql('text')} AS terms FROM docs),
cnt AS (SELECT doc_id, len(terms) AS dl, len(list_filter(terms, lambda x: x = 'was'))::DOUBLE AS f FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f > 0) AS d FROM cnt),
bmr AS (SELECT doc_id, round(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a)), 6) AS score FROM cnt, st WHERE f > 0)"""


@query("memory_context", f"WITH {_MEMORY}, {HITS}, {context_sql(400)}")
def memory_context(spark, sf_dir):
    from larkspur.operators import fulltext

    memories = both_kinds(spark, sf_dir).filter("file_type = 'memory'").select(F.substring("id", 2, 32).alias("doc_id"), "text")
    hits = S.number(fulltext.top(fulltext.bm25(memories, ["was"]).select("doc_id", "score"), 50))
    found = memories.join(F.broadcast(hits), "doc_id").select("rank", F.col("text").alias("content"), T.token_estimate(F.col("text")).alias("token_count"))
    return G.context(found, 400)


# --- ordered folds over the event log

EVENTS = "ev AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


GAP = 6 * 3600


@query(
    "debounce_events",
    f"""WITH RECURSIVE {EVENTS}, f AS (SELECT user_id, event_id, i, us AS last, true AS accepted FROM ev WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - f.last >= {GAP}000000 THEN e.us ELSE f.last END, e.us - f.last >= {GAP}000000 FROM f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, event_id, accepted FROM f""",
)
def debounce_events(spark, sf_dir):
    return folds.debounce(events(spark, sf_dir), "user_id", "us", GAP).select("user_id", "event_id", "accepted")


RATE, BURST = 1 / 28800, 3


@query(
    "token_bucket",
    f"""WITH RECURSIVE {EVENTS}, f AS (SELECT user_id, event_id, i, us, {BURST - 1}::DOUBLE AS tokens, true AS allowed FROM ev WHERE i = 1
    UNION ALL SELECT user_id, event_id, i, us, CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1 FROM (SELECT e.user_id, e.event_id, e.i, e.us, least({BURST}::DOUBLE, f.tokens + (e.us - f.us) / 1e6 / 28800e0) AS have FROM f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1))
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE allowed) AS allowed, round(min(tokens), 4) AS least FROM f GROUP BY user_id""",
)
def token_bucket(spark, sf_dir):
    seen = folds.token_bucket(events(spark, sf_dir), "user_id", "us", RATE, BURST)
    return seen.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("allowed").alias("allowed"), F.round(F.min("tokens"), 4).alias("least"))


@query(
    "cache_hit_simulation",
    f"""WITH RECURSIVE {EVENTS}, f AS (SELECT user_id, event_id, i, us AS written, false AS hit FROM ev WHERE i = 1
    UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.us - f.written < 43200000000 THEN f.written ELSE e.us END, e.us - f.written < 43200000000 FROM f JOIN ev e ON e.user_id = f.user_id AND e.i = f.i + 1)
    SELECT user_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM f GROUP BY user_id""",
)
def cache_hit_simulation(spark, sf_dir):
    seen = folds.ttl_cache(events(spark, sf_dir), "user_id", "us", 43200)
    return seen.groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
