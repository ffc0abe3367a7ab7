"""The engine: index files, remember texts, search, assemble context, count, forget.

Tables are kept below one folder as changes by tenant, collection and path (``segments.SegmentStore``): ``documents`` (doc_id, tenant, collection, path, file_type,
content_hash, text), ``chunks`` and ``vectors``. A change writes its own documents' rows only; readers see whole changes. A full-text index follows
the changes, so a search reads its terms' postings and no texts but those of its hits.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.config import Config
from larkspur.functions import text as T
from larkspur.operators import chunkers, embed, search, store
from larkspur.operators import context as contexts
from larkspur.operators.segments import SegmentStore
from larkspur.operators.textindex import FORMAT, TextIndex
from larkspur.operators.vectorindex import VectorIndex
from larkspur.sources import codecs
from larkspur.streaming import index as files
from larkspur.streaming import watch as watching

DOCUMENTS = "doc_id string, tenant string, collection string, path string, file_type string, content_hash string, modified timestamp, file_size long, text string"
CHUNKS = "doc_id string, document_id string, tenant string, collection string, path string, file_type string, heading string, text string, token_count long"
VECTORS = "doc_id string, tenant string, collection string, path string, embedding array<double>"
#: What a document is told by.
KEYS = ["tenant", "collection", "path"]
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "vectors": VECTORS}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Engine:
    """One corpus in one folder. A chunk is what is searched: its id is the ``doc_id`` of hits."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, embedder: Callable[[DataFrame], DataFrame] | None = None, counter=None, splitters: dict | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or Config()
        #: (doc_id, text) -> (doc_id, embedding)
        self.embedder = embedder or (lambda df: embed.dense(embed.hash_embedding(df, "doc_id", "text"), "doc_id"))
        #: array of pieces -> array of their tokens; None: a quarter of the bytes
        self.counter = counter
        #: file type -> (text -> array of pieces), besides ``chunkers.SPLITTERS``
        self.splitters = splitters
        self.kept = SegmentStore(spark, self.folder, KEYS, TABLES)
        self.text_index = TextIndex(spark, f"{self.folder}/text-index-{FORMAT}", ("text",), "doc_id", "string")
        #: of the vectors, once there are many
        self.vector_index = VectorIndex(spark, f"{self.folder}/vector-index", "doc_id", "string", dict.fromkeys(KEYS, "string"), KEYS)
        self._results: OrderedDict[tuple, tuple[float, list]] = OrderedDict()

    def version(self) -> int:
        """The number of the last change, 0 if there is none."""
        return self.kept.version()

    def table(self, name: str) -> DataFrame:
        return self.kept.table(name)

    # --- changes

    def _replace(self, new: DataFrame, gone: DataFrame | None = None, **more) -> None:
        """Put ``new`` documents in the place of those of the same keys, and drop ``gone`` (keys), all with their chunks and vectors; ``more`` stands in the change's entry."""
        made = self._chunks(new)
        vectors = self.embedder(made.select("doc_id", "text")).select("doc_id", "embedding")
        owners = made.select("doc_id", *KEYS).dropDuplicates(["doc_id"])
        rows = {"documents": new.select(_names(DOCUMENTS)), "chunks": made.select(_names(CHUNKS)), "vectors": vectors.join(owners, "doc_id").select(_names(VECTORS))}
        self._put(rows, gone, **more)

    def _put(self, rows: dict[str, DataFrame], gone: DataFrame | None, **more) -> None:
        self.kept.put(rows, gone, **more)
        self._results.clear()
        self.build_index()
        self.index_vectors()

    def _chunks(self, documents: DataFrame) -> DataFrame:
        """Chunks of documents by the splitters of their kinds; memories stay whole."""
        pieces = chunkers.split_by_kind(F.col("file_type"), F.col("text"), self.splitters)
        keyed = documents.withColumnRenamed("doc_id", "document_id")
        chunks = chunkers.chunks(keyed, pieces, chunkers.is_heading, key="document_id", max_tokens=self.config.max_tokens, min_bytes=self.config.min_bytes, tokens=self.counter)
        if self.config.overlap_characters:
            chunks = chunkers.overlapped(chunks, self.config.overlap_characters, "document_id")
        found = chunks.join(keyed.select("document_id", "tenant", "collection", "path", "file_type"), "document_id")
        return found.select(
            T.hash_id(F.concat("document_id", F.lit(":"), "chunk", F.lit(":"), "content")).alias("doc_id"),
            "document_id", "tenant", "collection", "path", "file_type",
            T.detect_heading(F.col("first_piece"))["heading"].alias("heading"),
            F.col("content").alias("text"), "token_count",
        )

    def _documents(self, found: DataFrame, tenant: str, collection: str) -> DataFrame:
        """Documents of files (path, file_type, content_hash, modified, file_size, content); ``failed`` tells those that cannot be decoded, whose text is empty."""
        raw = F.col("content")
        text = F.when(F.col("file_type") == "docx", codecs.docx_text(raw)).when(F.col("file_type") == "pdf", F.array_join(codecs.pdf_text(raw), "\n\n")).otherwise(raw.cast("string"))
        return found.select(
            T.hash_id(F.concat_ws("|", F.lit(tenant), F.lit(collection), "path")).alias("doc_id"), F.lit(tenant).alias("tenant"), F.lit(collection).alias("collection"),
            "path", "file_type", "content_hash", "modified", "file_size", F.coalesce(text, F.lit("")).alias("text"), text.isNull().alias("failed"),
        )

    def _tracked(self, source: str, tenant: str, collection: str) -> DataFrame:
        """(path, content_hash, modified, file_size) of the documents that come from a folder."""
        below = F.col("path").startswith(store.qualified(self.spark, source) + "/")
        mine = (F.col("tenant") == tenant) & (F.col("file_type") != "memory") & (F.col("collection") == collection)
        return self.table("documents").filter(mine & below).select("path", "content_hash", "modified", "file_size")

    def _changed(self, found: DataFrame, tracked: DataFrame, tenant: str, collection: str) -> DataFrame:
        """Documents of the files whose contents are not known, with what was known (``old``)."""
        old = tracked.select("path", F.col("content_hash").alias("old"))
        return self._documents(found, tenant, collection).join(old, "path", "left").filter(F.col("old").isNull() | (F.col("old") != F.col("content_hash")))

    def _take(self, found: DataFrame | None, tracked: DataFrame, removed: DataFrame | None, tenant: str, collection: str) -> dict[str, int]:
        """Put files that are new or have changed, and drop those that are ``removed`` (path). The counts come with the writing."""
        seen, gone = Observation(), Observation()
        added, failed = F.col("old").isNull(), F.col("failed")
        new = self._changed(files.none(self.spark) if found is None else found, tracked, tenant, collection)
        if found is not None:
            new = new.observe(seen, F.count_if(added & ~failed).alias("added"), F.count_if(~added & ~failed).alias("updated"), F.count_if(failed).alias("failed"))
        if removed is not None:
            removed = removed.observe(gone, F.count(F.lit(1)).alias("removed")).select(F.lit(tenant).alias("tenant"), F.lit(collection).alias("collection"), "path")
        self._replace(new, removed)
        return (seen.get if found is not None else {}) | (gone.get if removed is not None else {})

    def index(self, source: str, tenant: str = "", collection: str = "", batch_files: int = 10_000) -> dict[str, int]:
        """Bring the tenant's documents of a folder up to date: counts of added, updated, removed, unchanged and failed files.

        Documents of other folders, collections and tenants stay as they are; a path may be in several collections. Files are listed, and those of another size or time
        than before are read, ``batch_files`` at once; a batch is one change. So a run that was stopped goes on where it was when it is started again.
        """
        listed = files.listed(self.spark, source)
        tracked = self._tracked(source, tenant, collection)
        known = tracked.select("path", "modified", "file_size")
        stale = listed.join(known, ["path", "modified", "file_size"], "left_anti").select("path")
        removed = tracked.join(listed, "path", "left_anti").select("path")
        total = dict.fromkeys(("added", "updated", "removed", "unchanged", "failed"), 0)
        after, n = "", 0
        while True:
            batch = [r["path"] for r in stale.filter(F.col("path") > after).orderBy("path").limit(batch_files).collect()]
            gone = None if n or removed.isEmpty() else removed
            if not batch and gone is None:
                break
            counts = self._take(files.read(self.spark, batch) if batch else None, tracked, gone, tenant, collection)
            for k, v in counts.items():
                total[k] += v
            after, n = (batch or [after])[-1], n + 1
            if len(batch) < batch_files:
                break
        total["unchanged"] = listed.count() - total["added"] - total["updated"] - total["failed"]
        return total

    def watch(self, source: str, checkpoint: str, tenant: str = "", collection: str = "", seconds: float | None = None) -> StreamingQuery:
        """Follow a folder: a stream whose batches bring files that are created or changed and take away those that are removed. Without ``seconds`` it ends when it has what is
        there now. A batch that runs again after its change was written is left out: its number stands with the change.
        """
        stream = f"{store.qualified(self.spark, checkpoint)} {tenant} {collection}"

        def each(changes: DataFrame, n: int) -> None:
            if any(e.get("stream") == stream and e.get("batch", -1) >= n for e in self.kept.log.entries().values()):
                return
            found = files.described(changes.filter("change <> 'removed'").select("path", F.col("modified").alias("modificationTime"), F.col("file_size").alias("length"), "content"))
            gone = changes.filter("change = 'removed'").select(F.lit(tenant).alias("tenant"), F.lit(collection).alias("collection"), "path")
            self._replace(self._changed(found, self._tracked(source, tenant, collection), tenant, collection), gone, stream=stream, batch=n)

        return watching.watch(self.spark, source, checkpoint, each, seconds)

    def remember(self, texts: DataFrame, tenant: str = "") -> DataFrame:
        """Keep texts (text, source) as memories; gives (memory_id, summary, searchable) of each."""
        new = texts.filter("text is not null and trim(text) <> ''").dropDuplicates(["text"]).select(
            T.hash_id(F.col("text"), 32).alias("doc_id"), F.lit(tenant).alias("tenant"), F.coalesce("source", F.lit("")).alias("collection"),
            F.concat(F.lit("memory://"), T.hash_id(F.col("text"), 32)).alias("path"), F.lit("memory").alias("file_type"), F.sha2("text", 256).alias("content_hash"),
            F.current_timestamp().alias("modified"), F.octet_length("text").cast("long").alias("file_size"), "text",
        )
        self._replace(new)
        size = F.octet_length("text") + 1
        return new.select(F.col("doc_id").alias("memory_id"), T.ellipsis(F.col("text"), 100).alias("summary"), (size > self.config.min_bytes).alias("searchable"))

    def forget(self, tenant: str, path: str | None = None) -> None:
        """Drop one document of a tenant, or all of them."""
        own = self.table("documents").filter(F.col("tenant") == tenant)
        gone = own if path is None else own.filter(F.col("path") == path)
        self._put({}, gone)

    def build_index(self) -> TextIndex:
        """The full-text index, brought up to the last change: each change that it has not seen is one of its own, so it costs what the change brings."""
        index, owner = self.text_index, F.md5(F.concat_ws("\0", *KEYS))
        known = index.state()
        if known < self.version():
            changes = self.kept.changes(known)
            if changes is None:  # all was cleared
                index.clear(self.version())
                changes = self.kept.log.live()
            for c in changes:
                chunks = self.kept.rows_of(c, "chunks").withColumn("owner", owner) if "chunks" in c.entry["tables"] else None
                index.change(chunks, self.kept.keys_of(c).select(owner.alias("owner")), {"text": "text"}, "owner", c.high)
        return index.as_it_is()

    def index_vectors(self) -> VectorIndex | None:
        """The index of the vectors, brought up to the last change; None while there are few of them."""
        index, now = self.vector_index, self.version()
        if not index.exists():
            if self.table("vectors").count() < self.config.vector_index_from:
                return None
            VectorIndex.create(self.table("vectors"), index.folder, "doc_id", KEYS, KEYS, state=now)
            return index
        if index.kept.state() < now:
            changes = self.kept.changes(index.kept.state())
            if changes is None:  # all was cleared
                index.clear(state=now)
                changes = self.kept.log.live()
            for c in changes:
                if "vectors" in c.entry["tables"]:
                    index.add(self.kept.rows_of(c, "vectors"), self.kept.keys_of(c), state=c.high)
                else:
                    index.remove(self.kept.keys_of(c), state=c.high)
        return index

    # --- questions

    def search(self, query: str, **options) -> list:
        """Hits as rows: doc_id, score, vector_score, fts_score, rank, path, heading, text, token_count. Kept for ``cache_seconds`` by version."""
        o = search.SearchOptions(**({"top_k": self.config.top_k, "mode": self.config.mode} | options))
        key = (self.version(), query, repr(o))
        kept = self._results.get(key)
        if kept and time.monotonic() - kept[0] < self.config.cache_seconds:
            return kept[1]
        found = self.hits(query, o).orderBy("rank").collect()
        if found:
            self._results[key] = (time.monotonic(), found)
            while len(self._results) > self.config.cache_entries:
                self._results.popitem(last=False)
        return found

    def hits(self, query: str, options: search.SearchOptions) -> DataFrame:
        chunks = self.table("chunks")
        asked = self.spark.createDataFrame([("q", query)], "doc_id string, text string")
        zero = F.transform(F.sequence(F.lit(1), F.lit(embed.DIMENSION)), lambda _: F.lit(0.0))
        q = asked.join(self.embedder(asked), "doc_id", "left").select(F.coalesce("embedding", zero).alias("q"))
        found = search.enrich(search.search(chunks, self.index_vectors() or self.table("vectors"), query, q, options, self.build_index()), chunks)
        if options.rerank:
            found = search.reranked(found.withColumn("content", F.col("text")).withColumn("line_start", F.lit(0)), query, options.rerank)
        return found.select("doc_id", "score", "vector_score", "fts_score", "rank", "path", "heading", "text", "token_count")

    def context(self, query: str, budget: int | None = None, **options):
        """One row: context, token_count, token_budget, truncated."""
        o = search.SearchOptions(**({"mode": self.config.mode} | options | {"top_k": contexts.HITS}))
        return contexts.context(self.hits(query, o).select("rank", F.col("text").alias("content"), "token_count"), budget or self.config.token_budget).first()

    def stats(self, tenant: str | None = None) -> dict[str, int]:
        """Documents, chunks and vectors, of one tenant or of all."""
        mine = (lambda df: df) if tenant is None else (lambda df: df.filter(F.col("tenant") == tenant))
        chunks = mine(self.table("chunks"))
        return {"documents": mine(self.table("documents")).count(), "chunks": chunks.count(), "vectors": self.table("vectors").join(chunks.select("doc_id"), "doc_id", "left_semi").count()}
