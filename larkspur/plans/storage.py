"""Queries on stored tables: lookups, counts, pages, upserts, deletes, sync, identities, progress, metrics."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import store
from larkspur.plans.registry import DOCS, VECS, documents, query, search_vectors, table, vector_index, vectors

#: Literal tables that both engines build alike.
PROGRESS = """SELECT * FROM (VALUES
 (1, '/a', 5, 100, 50, 'running', TIMESTAMP '2024-01-01 10:00:00', CAST(NULL AS STRING)), (2, '/a', 9, 100, 90, 'running', TIMESTAMP '2024-01-02 10:00:00', NULL),
 (3, '/b', 7, 7, 7, 'completed', TIMESTAMP '2024-01-03 10:00:00', NULL), (4, '/c', 1, 9, 1, 'failed', TIMESTAMP '2024-01-04 10:00:00', 'disk'),
 (5, '/d', 2, 20, 2, 'running', TIMESTAMP '2024-01-05 10:00:00', NULL)) AS p(id, root_path, last_file_index, total_files, indexed_files, status, updated_at, error)"""
PROGRESS_SQL = f"progress AS ({PROGRESS.replace('STRING', 'VARCHAR')})"
#: Keys of users: one for each user of the event log, every third expired; one user in ten is an administrator.
KEYS_SQL = "keys AS (SELECT user_id, 'ck_' || user_id AS token, max(ts) + INTERVAL 10 DAY * (user_id % 3) AS expires_at, user_id % 10 = 0 AS is_admin FROM events GROUP BY user_id)"
AS_OF = "2024-02-05 00:00:00"


def progress(spark):
    return spark.sql(PROGRESS.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))


def keys(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    days = F.make_dt_interval((F.col("user_id") % 3).cast("int") * 10)
    return by.select("user_id", F.concat(F.lit("ck_"), "user_id").alias("token"), (F.col("last") + days).alias("expires_at"), (F.col("user_id") % 10 == 0).alias("is_admin"))


@query("doc_by_id", f"WITH {DOCS} SELECT doc_id, path, collection FROM docs WHERE doc_id = 7 AND tenant = (SELECT tenant FROM docs WHERE doc_id = 7)")
def doc_by_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    own = docs.filter("doc_id = 7").select("tenant").limit(1)
    return docs.filter("doc_id = 7").join(F.broadcast(own), "tenant", "left_semi").select("doc_id", "path", "collection")


@query("doc_by_path", f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE tenant = 'en' AND path = (SELECT path FROM docs WHERE doc_id = (SELECT max(doc_id) FROM docs WHERE tenant = 'en'))")
def doc_by_path(spark, sf_dir):
    """The path of the tenant's newest document, then the document of that path."""
    docs = documents(spark, sf_dir)
    newest = docs.filter("tenant = 'en'").agg(F.max_by("path", "doc_id").alias("path")).first()["path"]
    return docs.filter((F.col("path") == newest) & (F.col("tenant") == "en")).select("doc_id", "path")


@query("doc_by_id_any", f"WITH {DOCS} SELECT doc_id, tenant, path FROM docs WHERE doc_id = 7")
def doc_by_id_any(spark, sf_dir):
    return documents(spark, sf_dir).filter("doc_id = 7").select("doc_id", "tenant", "path")


@query("chunk_by_id", f"WITH {DOCS}, chunks AS (SELECT substr(sha256(path || text), 1, 16) AS chunk_id, doc_id, (strlen(text) // 4)::BIGINT AS token_count FROM docs) SELECT chunk_id, c.doc_id, token_count, path FROM chunks c JOIN docs d ON c.doc_id = d.doc_id WHERE tenant = 'en'")
def chunk_by_id(spark, sf_dir):
    """All chunks of the tenant, by id, each with its document."""
    docs = documents(spark, sf_dir)
    chunks = docs.select(T.hash_id(F.concat("path", "text")).alias("chunk_id"), "doc_id", T.token_estimate(F.col("text")).alias("token_count"))
    return chunks.join(docs.filter("tenant = 'en'").select("doc_id", "path"), "doc_id").select("chunk_id", "doc_id", "token_count", "path")


@query("count_documents", f"WITH {DOCS} SELECT tenant, count(*) AS n FROM docs GROUP BY tenant UNION ALL SELECT 'all', count(*) FROM docs")
def count_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.groupBy("tenant").agg(F.count(F.lit(1)).alias("n")).unionByName(docs.agg(F.lit("all").alias("tenant"), F.count(F.lit(1)).alias("n")))


@query("count_chunks", f"WITH {DOCS} SELECT tenant, count(*) AS n FROM docs WHERE strlen(trim(text)) + 2 > 50 GROUP BY tenant")
def count_chunks(spark, sf_dir):
    return documents(spark, sf_dir).filter(F.octet_length(F.trim("text")) + 2 > 50).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("count_vectors", f"WITH {DOCS}, {VECS} SELECT tenant, count(*) AS n FROM vecs JOIN docs USING (doc_id) GROUP BY tenant")
def count_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "tenant"), "doc_id").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_stats", f"WITH {DOCS}, {VECS} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM docs WHERE strlen(trim(text)) + 2 > 50) AS chunks, (SELECT count(*) FROM vecs) AS vectors")
def corpus_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.octet_length(F.trim("text")) + 2 > 50).alias("chunks"))
    return docs.crossJoin(vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("vectors")))


@query("cache_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') AS expired, sum(user_id)::BIGINT AS hits, round(avg(user_id), 6) AS avg_hits FROM events")
def cache_stats(spark, sf_dir):
    old = F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(old).alias("expired"), F.sum("user_id").alias("hits"), F.round(F.avg("user_id"), 6).alias("avg_hits"))


_OUTCOME = "CASE WHEN strlen(trim(text)) + 2 <= 50 THEN 'skipped' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'indexed' END"


@query("index_result_rollup", f"WITH {DOCS}, o AS (SELECT {_OUTCOME} AS o FROM docs) SELECT count(*) AS total, count(*) FILTER (WHERE o = 'indexed') AS indexed, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed FROM o")
def index_result_rollup(spark, sf_dir):
    o = F.when(F.octet_length(F.trim("text")) + 2 <= 50, "skipped").when(F.col("doc_id") % 17 == 0, "failed").otherwise("indexed")
    return documents(spark, sf_dir).select(o.alias("o")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("o") == x).alias(x) for x in ("indexed", "skipped", "failed")])


@query("list_documents_page", f"WITH {DOCS} SELECT doc_id, path FROM docs WHERE tenant = 'en' ORDER BY doc_id DESC LIMIT 10 OFFSET 20")
def list_documents_page(spark, sf_dir):
    return store.page(documents(spark, sf_dir).filter("tenant = 'en'").select("doc_id", "path"), [F.desc("doc_id")], 10, 20)


@query("list_progress_page", f"WITH {PROGRESS_SQL} SELECT id::INT AS id, root_path, status FROM progress ORDER BY updated_at DESC, id LIMIT 2 OFFSET 2")
def list_progress_page(spark, sf_dir):
    return store.page(progress(spark), [F.desc("updated_at"), "id"], 2, 2).select("id", "root_path", "status")


@query("latest_progress", f"WITH {PROGRESS_SQL} SELECT id::INT AS id, root_path, last_file_index::INT AS last_file_index FROM progress WHERE status = 'running' AND root_path = '/a' ORDER BY updated_at DESC LIMIT 1")
def latest_progress(spark, sf_dir):
    return progress(spark).filter("status = 'running' AND root_path = '/a'").orderBy(F.desc("updated_at")).limit(1).select("id", "root_path", "last_file_index")


@query("progress_running", f"WITH {PROGRESS_SQL} SELECT id::INT AS id, root_path FROM progress WHERE status = 'running'")
def progress_running(spark, sf_dir):
    return progress(spark).filter("status = 'running'").select("id", "root_path")


@query("progress_transitions", f"WITH {PROGRESS_SQL} SELECT id::INT AS id, root_path, CASE WHEN root_path = '/a' AND status = 'running' THEN 'completed' WHEN root_path = '/d' AND status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN root_path = '/d' AND status = 'running' THEN 'gone' WHEN root_path = '/a' AND status = 'running' THEN NULL ELSE error END AS error FROM progress")
def progress_transitions(spark, sf_dir):
    done = store.transition(progress(spark), "/a", "completed")
    return store.transition(done, "/d", "failed", "gone").select("id", "root_path", "status", "error")


@query("checkpoint_progress", f"WITH {DOCS}, f AS (SELECT doc_id, row_number() OVER (ORDER BY path) AS i FROM docs) SELECT max(i) FILTER (WHERE i % 10 = 0) AS last_saved, count(*) AS total_files, count(*) - max(i) FILTER (WHERE i % 10 = 0) AS to_redo FROM f")
def checkpoint_progress(spark, sf_dir):
    """Saved every ten files in path order: what a stop after the last file would leave to redo."""
    n = documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    saved = F.floor(F.col("n") / 10) * 10
    return n.select(F.when(saved > 0, saved).alias("last_saved"), F.col("n").alias("total_files"), F.when(saved > 0, F.col("n") - saved).alias("to_redo"))


@query("metadata_lookup", "SELECT k, coalesce(max(v), '') AS value FROM (VALUES ('schema'), ('missing')) q(k) LEFT JOIN (VALUES ('schema', '7'), ('model', 'hash')) m(mk, v) ON mk = k GROUP BY k")
def metadata_lookup(spark, sf_dir):
    stored = spark.createDataFrame([("schema", "7"), ("model", "hash")], "k string, v string")
    return spark.createDataFrame([("schema",), ("missing",)], "k string").join(stored, "k", "left").select("k", F.coalesce("v", F.lit("")).alias("value"))


@query("expired_entries", f"WITH {KEYS_SQL} SELECT user_id, expires_at FROM keys WHERE expires_at <= TIMESTAMP '{AS_OF}'")
def expired_entries(spark, sf_dir):
    return keys(spark, sf_dir).filter(F.col("expires_at") <= F.lit(AS_OF).cast("timestamp_ntz")).select("user_id", "expires_at")


@query("apikey_user_resolution", f"WITH {KEYS_SQL} SELECT e.event_id, k.user_id, k.is_admin FROM events e JOIN keys k ON 'ck_' || e.user_id = k.token WHERE k.expires_at > TIMESTAMP '{AS_OF}'")
def apikey_user_resolution(spark, sf_dir):
    """The user and role of every event's token that has not expired."""
    asked = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("ck_"), "user_id").alias("token"))
    return asked.join(store.live_only(keys(spark, sf_dir), AS_OF), "token").select("event_id", "user_id", "is_admin")


@query("admin_or_owner", f"WITH {KEYS_SQL} SELECT k.user_id, count(*) AS visible FROM keys k JOIN events e ON k.is_admin OR k.user_id = e.user_id GROUP BY 1")
def admin_or_owner(spark, sf_dir):
    """How many events each user may see: administrators all, others their own."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    whole = events.agg(F.sum("n").alias("whole"))
    who = keys(spark, sf_dir).join(events, "user_id").crossJoin(F.broadcast(whole))
    return who.select("user_id", F.when(F.col("is_admin"), F.col("whole")).otherwise(F.col("n")).alias("visible"))


@query("semi_join_tenant_chunks", f"WITH {DOCS}, {VECS} SELECT doc_id, label::INT AS label FROM vecs WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE tenant = 'de')")
def semi_join_tenant_chunks(spark, sf_dir):
    return store.delete(vectors(spark, sf_dir), documents(spark, sf_dir).filter("tenant = 'de'"), ["doc_id"]).select("doc_id", "label")


@query("cascade_delete", f"WITH {DOCS}, {VECS}, gone AS (SELECT doc_id FROM docs WHERE collection = 'src3') SELECT 'documents' AS kind, count(*) AS n FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'vectors', count(*) FROM vecs WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM gone)")
def cascade_delete(spark, sf_dir):
    docs, vecs, labels = documents(spark, sf_dir), vectors(spark, sf_dir), table(spark, sf_dir, "labels")
    left = store.cascade(docs.filter("collection = 'src3'"), (docs, "doc_id"), (vecs, "doc_id"), (labels, "doc_id"))
    a, b, c = (t.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for t, k in zip(left, ("documents", "vectors", "labels")))
    return a.unionByName(b).unionByName(c)


@query("purge_tenant", f"WITH {DOCS} SELECT tenant, count(*) AS n FROM docs WHERE tenant <> 'fr' GROUP BY tenant")
def purge_tenant(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return store.delete(docs, docs.filter("tenant = 'fr'"), ["doc_id"]).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))


#: Two snapshots of the corpus: some files removed, some changed, some new.
OLD_SQL = f"{DOCS}, old AS (SELECT path, sha256(text) AS content_hash FROM docs WHERE doc_id % 10 <> 2), new AS (SELECT path, sha256(CASE WHEN doc_id % 10 = 1 THEN text || '!' ELSE text END) AS content_hash FROM docs WHERE doc_id % 10 <> 0)"
SYNC_SQL = f"{OLD_SQL}, diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'updated' ELSE 'unchanged' END AS change FROM old o FULL JOIN new n ON o.path = n.path)"


def snapshots(spark, sf_dir):
    docs = documents(spark, sf_dir)
    new = F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return (
        docs.filter("doc_id % 10 <> 2").select("path", F.sha2("text", 256).alias("content_hash")),
        docs.filter("doc_id % 10 <> 0").select("path", F.sha2(new, 256).alias("content_hash")),
    )


@query("sync_diff", f"WITH {SYNC_SQL} SELECT path, change FROM diff")
def sync_diff(spark, sf_dir):
    return store.sync(*snapshots(spark, sf_dir))


@query(
    "sync_one_source",
    f"""WITH {DOCS}, old AS (SELECT path, collection, sha256(text) AS content_hash FROM docs), new AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE sha256(text) END AS content_hash FROM docs WHERE collection = 'src3' AND doc_id % 3 <> 0),
    change AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'updated' ELSE 'unchanged' END AS change FROM (SELECT * FROM old WHERE collection = 'src3') o LEFT JOIN new n ON o.path = n.path)
    SELECT d.path, coalesce(change, 'of another source') AS change FROM docs d LEFT JOIN change USING (path)""",
)
def sync_one_source(spark, sf_dir):
    """A listing of one source, of which a third is gone and some have changed: the documents of all other sources stay."""
    docs = documents(spark, sf_dir).select("path", "collection", "doc_id", F.sha2("text", 256).alias("content_hash"))
    listing = docs.filter("collection = 'src3' and doc_id % 3 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("content_hash")))
    changes = store.sync_within(docs, listing, F.col("path").startswith("docs/src3/"))
    return docs.select("path").join(changes, "path", "left").select("path", F.coalesce("change", F.lit("of another source")).alias("change"))


@query("sync_counts", f"WITH {SYNC_SQL} SELECT change, count(*) AS n FROM diff GROUP BY change")
def sync_counts(spark, sf_dir):
    return store.sync(*snapshots(spark, sf_dir)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("removed_paths", f"WITH {OLD_SQL} SELECT path FROM old EXCEPT SELECT path FROM new")
def removed_paths(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return old.select("path").join(new, "path", "left_anti")


@query("incremental_skip", f"WITH {OLD_SQL} SELECT n.path FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.path = n.path AND o.content_hash = n.content_hash)")
def incremental_skip(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return store.to_index(old, new).select("path")


@query("upsert_documents", f"WITH {DOCS} SELECT path, tenant, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM docs WHERE doc_id % 5 = 0 OR doc_id % 10 <> 0")
def upsert_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    old = docs.filter("doc_id % 10 <> 0").select("path", "tenant", F.lit("old").alias("version"))
    return store.upsert(old, docs.filter("doc_id % 5 = 0").select("path", "tenant", F.lit("new").alias("version")), ["path", "tenant"])


@query("upsert_chunks", f"WITH {DOCS}, {VECS}, c AS (SELECT substr(sha256(path || text), 1, 16) AS chunk_id, doc_id, doc_id % 3 = 0 AS renewed FROM docs) SELECT chunk_id, doc_id, renewed, v.doc_id IS NOT NULL AS has_vector FROM c LEFT JOIN vecs v USING (doc_id)")
def upsert_chunks(spark, sf_dir):
    docs = documents(spark, sf_dir).select(T.hash_id(F.concat("path", "text")).alias("chunk_id"), "doc_id")
    merged = store.upsert(docs.withColumn("renewed", F.lit(False)), docs.filter("doc_id % 3 = 0").withColumn("renewed", F.lit(True)), ["chunk_id", "doc_id"])
    vecs = vectors(spark, sf_dir).select("doc_id", F.lit(True).alias("has"))
    return merged.join(vecs, "doc_id", "left").select("chunk_id", "doc_id", "renewed", F.coalesce("has", F.lit(False)).alias("has_vector"))


@query("vector_upsert_delete", f"WITH {VECS} SELECT doc_id, (CASE WHEN doc_id % 4 = 0 THEN -1 ELSE label END)::INT AS label FROM vecs WHERE doc_id % 7 <> 0")
def vector_upsert_delete(spark, sf_dir):
    vecs = vectors(spark, sf_dir).select("doc_id", "label")
    renewed = store.upsert(vecs, vecs.filter("doc_id % 4 = 0").withColumn("label", F.lit(-1)), ["doc_id"])
    return store.delete(renewed, vecs.filter("doc_id % 7 = 0"), ["doc_id"])


@query("vector_codec_roundtrip", f"WITH {VECS} SELECT doc_id, len(embedding)::BIGINT AS dim, true AS same FROM vecs")
def vector_codec_roundtrip(spark, sf_dir):
    from larkspur.sources.codecs import decode_vector, encode_vector

    coded = vectors(spark, sf_dir).select("doc_id", "embedding", encode_vector("embedding").alias("blob"))
    back = coded.withColumn("back", decode_vector("blob"))
    return back.select("doc_id", F.size("back").cast("long").alias("dim"), (F.col("back") == F.col("embedding")).alias("same"))


def _folder(spark) -> str:
    return f"{store.shared_folder(spark)}/tables"


@query("vector_index_roundtrip", f"WITH {VECS} SELECT label::INT AS label, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS total FROM vecs GROUP BY label")
def vector_index_roundtrip(spark, sf_dir):
    target = store.snapshot(spark, {"vectors": vectors(spark, sf_dir)}, _folder(spark) + "/v", datetime.datetime.now(datetime.UTC))
    return store.restore(spark, target, "vectors").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("embedding")[0].cast("double")), 6).alias("total"))


@query("snapshot_tables", f"WITH {DOCS}, {VECS} SELECT 'documents' AS name, count(*) AS n FROM docs UNION ALL SELECT 'vectors', count(*) FROM vecs")
def snapshot_tables(spark, sf_dir):
    target = store.snapshot(spark, {"documents": documents(spark, sf_dir), "vectors": vectors(spark, sf_dir)}, _folder(spark) + "/s", datetime.datetime.now(datetime.UTC))
    a, b = (store.restore(spark, target, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("documents", "vectors"))
    return a.unionByName(b)


# --- kept vector indexes

def kept_vectors(spark, sf_dir):
    """An index without the vectors of every seventh document, and with those of every fourth in the place of others."""
    from larkspur.operators.vectorindex import VectorIndex

    vecs = vectors(spark, sf_dir).select("doc_id", "embedding")
    index = VectorIndex.create(vecs, f"{_folder(spark)}/vectors-{uuid.uuid4().hex}")
    index.remove(vecs.filter("doc_id % 7 = 0"))
    index.add(vecs.filter("doc_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    return index


@query("vector_index_rows", f"WITH {VECS} SELECT doc_id, round(CASE WHEN doc_id % 4 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM vecs WHERE doc_id % 7 <> 0 OR doc_id % 4 = 0")
def vector_index_rows(spark, sf_dir):
    return kept_vectors(spark, sf_dir).vectors().select("doc_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query("vector_index_search", f"WITH {VECS}, cos AS (SELECT v.doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM vecs v, vecs q WHERE q.doc_id = 0) SELECT doc_id, score FROM cos ORDER BY score DESC, doc_id LIMIT 10")
def vector_index_search(spark, sf_dir):
    """The 10 nearest to the vector of document 0 by the index, every cell of it."""
    index = vector_index(spark, sf_dir)
    return index.search(vectors(spark, sf_dir).filter("doc_id = 0").first()["embedding"], 10, share=1.0)


#: Vectors whose nearest ones are looked for by the index as it is shipped, and the recall that it has to have.
ASKED, RECALL = 50, 0.9


def recall(asked, found, exact):
    """(questions, enough): whether what was found are nine tenths of the exact hits."""
    hits = found.select("question", "doc_id").join(exact.select("question", "doc_id"), ["question", "doc_id"]).agg(F.count(F.lit(1)).alias("hits"))
    questions = asked.agg(F.count(F.lit(1)).alias("questions"))
    return questions.crossJoin(hits).select("questions", (F.col("hits") >= RECALL * 10 * F.col("questions")).alias("enough"))


def questions_of(vecs):
    return vecs.filter(f"doc_id % {ASKED} = 0").select(F.col("doc_id").alias("question"), F.col("embedding").alias("q"))


@query("vector_index_recall", f"SELECT count(*) AS questions, true AS enough FROM embeddings WHERE vec_id % {ASKED} = 0")
def vector_index_recall(spark, sf_dir):
    """Whether the nearest ten that the index finds by default are nine of the ten that a scan of all finds."""
    from larkspur.operators.vectorindex import scan_many

    vecs = vectors(spark, sf_dir)
    asked = questions_of(vecs)
    return recall(asked, vector_index(spark, sf_dir).search_many(asked, 10), scan_many(vecs, asked, 10))


@query("vector_graph_recall", f"SELECT count(*) AS questions, true AS enough FROM embeddings WHERE vec_id % {ASKED} = 0")
def vector_graph_recall(spark, sf_dir):
    """The same of a graph index that is built for it, after removals and additions."""
    from larkspur.operators.graphindex import GraphIndex
    from larkspur.operators.vectorindex import scan_many

    vecs = vectors(spark, sf_dir).select("doc_id", "embedding")
    index = GraphIndex.create(vecs, f"{_folder(spark)}/graph-{uuid.uuid4().hex}")
    index.remove(vecs.filter("doc_id % 7 = 0"))
    index.add(vecs.filter("doc_id % 4 = 0"))
    asked = questions_of(vecs)
    return recall(asked, index.search_many(asked, 10), scan_many(vecs.filter("doc_id % 7 <> 0 or doc_id % 4 = 0"), asked, 10))


@query(
    "vector_index_tenant",
    f"WITH {DOCS}, {VECS}, cos AS (SELECT v.doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM vecs v JOIN docs d ON d.doc_id = v.doc_id, vecs q WHERE q.doc_id = 0 AND tenant = 'es' AND starts_with(path, 'docs/src1')) SELECT doc_id, score FROM cos ORDER BY score DESC, doc_id LIMIT 3",
)
def vector_index_tenant(spark, sf_dir):
    """Hits of one tenant and folder: the index goes on reading cells until it has them."""
    index = search_vectors(spark, sf_dir)
    return index.search(vectors(spark, sf_dir).filter("doc_id = 0").first()["embedding"], 3, F.col("path").startswith("docs/src1"), "es", share=1.0)


@query("vector_index_fallback", f"WITH {VECS}, cos AS (SELECT v.doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM vecs v, vecs q WHERE q.doc_id = 0) SELECT doc_id, score FROM cos ORDER BY score DESC, doc_id LIMIT 10")
def vector_index_fallback(spark, sf_dir):
    """An index that has been cleared has no hits, so all vectors are scanned."""
    from larkspur.operators.vectorindex import VectorIndex, search_or_scan

    vecs = vectors(spark, sf_dir).select("doc_id", "embedding")
    index = VectorIndex.create(vecs, f"{_folder(spark)}/vectors-{uuid.uuid4().hex}")
    index.clear()
    return search_or_scan(index, vecs, vecs.filter("doc_id = 0").first()["embedding"], 10)


@query("pq_index_counts", f"WITH {VECS} SELECT 'codes' AS name, 8 * count(*) AS n FROM vecs WHERE doc_id % 3 <> 0 UNION ALL SELECT 'vectors', 4 * 64 * count(*) FROM vecs WHERE doc_id % 3 <> 0 UNION ALL SELECT 'codebook', 4 * 16 * 64")
def pq_index_counts(spark, sf_dir):
    """Bytes of a trained index after additions and removals, from its kept codebook and codes."""
    from larkspur.operators.vectorindex import PqIndex

    vecs = vectors(spark, sf_dir).select("doc_id", "embedding")
    index = PqIndex.train(vecs, f"{_folder(spark)}/pq-{uuid.uuid4().hex}")
    index.add(vecs)
    index.remove(vecs.filter("doc_id % 3 = 0"))
    return spark.createDataFrame(sorted(index.memory().items()), "name string, n long")


# --- metrics over the event log

@query("metric_counter_by_label", "SELECT event_type, user_id % 4 AS tenant, count(*) AS n FROM events GROUP BY 1, 2")
def metric_counter_by_label(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 4).alias("tenant")).agg(F.count(F.lit(1)).alias("n"))


BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500)
HIST_SQL = f"b AS (SELECT unnest([{', '.join(f'{x}.0::DOUBLE' for x in BOUNDS)}, 'infinity'::DOUBLE]) AS le), h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY 1, 2)"


def histogram(spark, sf_dir):
    """(event_type, le, n): one pass, a counter for each bound."""
    counted = table(spark, sf_dir, "events").groupBy("event_type").agg(F.array(*[F.struct(F.lit(float(x)).alias("le"), F.count_if(F.col("value") <= float(x)).alias("n")) for x in (*BOUNDS, "inf")]).alias("h"))
    return counted.select("event_type", F.explode("h").alias("h")).select("event_type", "h.le", "h.n")


@query("metric_histogram", f"WITH {HIST_SQL} SELECT event_type, CASE WHEN isinf(le) THEN 1e9 ELSE le END AS le, n FROM h")
def metric_histogram(spark, sf_dir):
    return histogram(spark, sf_dir).withColumn("le", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")))


@query(
    "metric_p95",
    f"""WITH {HIST_SQL}, r AS (SELECT *, coalesce(lag(n) OVER w, 0) AS n0, coalesce(lag(le) OVER w, 0) AS le0, max(n) OVER (PARTITION BY event_type) AS total FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
    f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS i FROM r WHERE n >= 0.95e0 * total AND total > 0)
    SELECT event_type, round(CASE WHEN isinf(le) THEN le0 ELSE le0 + (le - le0) * (0.95e0 * total - n0) / (n - n0) END, 6) AS p95 FROM f WHERE i = 1""",
)
def metric_p95(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("le")
    rows = histogram(spark, sf_dir).withColumns({"n0": F.coalesce(F.lag("n").over(w), F.lit(0)), "le0": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("n").over(Window.partitionBy("event_type"))})
    reached = rows.filter((F.col("n") >= 0.95 * F.col("total")) & (F.col("total") > 0)).withColumn("i", F.row_number().over(w)).filter("i = 1")
    inside = F.col("le0") + (F.col("le") - F.col("le0")) * (0.95 * F.col("total") - F.col("n0")) / (F.col("n") - F.col("n0"))
    return reached.select("event_type", F.round(F.when(F.col("le") == float("inf"), F.col("le0")).otherwise(inside), 6).alias("p95"))


@query("metric_gauge_per_tenant", f"WITH {DOCS} SELECT tenant, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes, max(doc_id) AS newest FROM docs GROUP BY tenant")
def metric_gauge_per_tenant(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("tenant").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("bytes"), F.max("doc_id").alias("newest"))


@query("metric_hit_ratio", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(count(*) FILTER (WHERE value > 50)::DOUBLE / count(*), 6) AS ratio, round(count(*) / 86400.0e0, 6) AS per_second FROM events GROUP BY 1")
def metric_hit_ratio(spark, sf_dir):
    by = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return by.agg(F.round(F.count_if(F.col("value") > 50) / F.count(F.lit(1)), 6).alias("ratio"), F.round(F.count(F.lit(1)) / 86400.0, 6).alias("per_second"))
