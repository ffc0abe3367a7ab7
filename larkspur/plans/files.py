"""Queries on files: decoders, a directory stream, provider fallback. Their inputs are files made from the tables."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators import embed, store
from larkspur.plans.chunking import WORDY
from larkspur.plans.registry import documents, query, table
from larkspur.sources.codecs import docx_text as decode_docx
from larkspur.sources.codecs import pdf_text as decode_pdf
from larkspur.streaming import index, watch


def docx_bytes(text: str) -> bytes:
    escaped = text.replace("&", "&amp;").replace("<", "&lt;")
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in escaped.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf_bytes(text: str) -> bytes:
    shown = text.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    body = zlib.compress(b"BT " + b" T* ".join(b"(" + line + b") Tj" for line in shown.split(b"\n")) + b" ET")
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(body)).encode() + b" /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream endobj"


def pdf_file(text: str) -> bytes:
    """A file as programs write it now: objects in an object stream, a cross-reference stream, a page for each ten lines, two-byte codes of the font's own with a
    Unicode map, and lines placed from the bottom up."""
    chars = sorted(set(text))
    code = {c: i + 1 for i, c in enumerate(chars)}
    pairs = "".join(f"<{code[c]:04X}> <{c.encode('utf-16-be').hex()}>\n" for c in chars)
    cmap = f"1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n{len(chars)} beginbfchar\n{pairs}endbfchar".encode()
    lines = [line for line in text.split("\n") if line]
    groups = [lines[i : i + 10] for i in range(0, len(lines), 10)]
    hexed = lambda s: "".join(f"{code[c]:04X}" for c in s)
    contents = ["BT /F1 10 Tf " + " ".join(f"1 0 0 1 50 {700 - 12 * i} Tm <{hexed(x)}> Tj" for i, x in reversed(list(enumerate(g)))) + " ET" for g in groups]
    inner = {1: "<< /Type /Catalog /Pages 2 0 R >>", 3: "<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"}
    inner |= {100 + i: f"<< /Type /Page /Parent 2 0 R /Contents {10000 + i} 0 R >>" for i in range(len(groups))}
    inner[2] = f"<< /Type /Pages /Count {len(groups)} /Resources << /Font << /F1 3 0 R >> >> /Kids [{' '.join(f'{100 + i} 0 R' for i in range(len(groups)))}] >>"
    bodies, heads, at = [], [], 0
    for n, body in inner.items():
        heads.append(f"{n} {at}")
        bodies.append(body)
        at += len(body) + 1
    head = " ".join(heads) + " "
    streams = {4: cmap, 5: (head + " ".join(bodies)).encode()} | {10000 + i: c.encode() for i, c in enumerate(contents)}
    out = b"%PDF-1.7\n"
    for n, body in streams.items():
        packed = zlib.compress(body)
        more = f" /Type /ObjStm /N {len(inner)} /First {len(head)}" if n == 5 else ""
        out += f"{n} 0 obj\n<< /Length {len(packed)} /Filter /FlateDecode{more} >>\nstream\n".encode() + packed + b"\nendstream\nendobj\n"
    table = zlib.compress(b"")
    return out + f"6 0 obj\n<< /Type /XRef /Root 1 0 R /Size 20000 /W [1 3 1] /Length {len(table)} /Filter /FlateDecode >>\nstream\n".encode() + table + b"\nendstream\nendobj\nstartxref\n0\n%%EOF"


@F.pandas_udf(T.BinaryType())
def to_pdf_file(texts: pd.Series) -> pd.Series:
    return texts.map(pdf_file)


@F.pandas_udf(T.BinaryType())
def to_docx(texts: pd.Series) -> pd.Series:
    return texts.map(docx_bytes)


@F.pandas_udf(T.BinaryType())
def to_pdf(texts: pd.Series) -> pd.Series:
    return texts.map(pdf_bytes)


@query("docx_text", "SELECT doc_id, text FROM documents")
def docx_text(spark, sf_dir):
    files = documents(spark, sf_dir).select("doc_id", to_docx("text").alias("content"))
    return files.select("doc_id", decode_docx("content").alias("text"))


@query("pdf_text")
def pdf_text(spark, sf_dir):
    files = documents(spark, sf_dir).select("doc_id", to_pdf("text").alias("content"))
    return files.select("doc_id", F.posexplode(decode_pdf("content")).alias("page", "text"))


@query(
    "pdf_pages",
    r"""WITH src AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[^\p{L}\p{N}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
    line AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM src),
    page AS (SELECT doc_id, i // 10 AS p, string_agg(l, chr(10) ORDER BY i) AS text FROM line GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p)::INT - 1 AS page, sha256(text) AS digest FROM page WHERE strlen(text) >= 50""",
)
def pdf_pages(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", F.expr(f"array_join({WORDY}, '\n')").alias("text"))
    files = docs.select("doc_id", to_pdf_file("text").alias("content"))
    return files.select("doc_id", F.posexplode(decode_pdf("content")).alias("page", "text")).select("doc_id", "page", F.sha2("text", 256).alias("digest"))


@query("stream_index")
def stream_index(spark, sf_dir):
    """Pages written as files, then indexed by the directory stream."""
    folder = f"{store.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, sf_dir, "pages").select(F.regexp_replace("html", "[\r\n]+", " ").alias("value")).repartition(4).write.mode("overwrite").text(f"{folder}/in")
    index.watch(spark, f"{folder}/in", index.write_version(f"{folder}/out"), f"{folder}/state").awaitTermination()
    return index.current(spark, f"{folder}/out").select("chunk", "chunk_id", "token_count")


#: Texts for each file that is written to be watched.
PER_FILE = 1000


@query("watch_changes", "SELECT DISTINCT source, 'created' AS change FROM documents UNION SELECT DISTINCT source, 'removed' FROM documents WHERE source = 'src2'")
def watch_changes(spark, sf_dir):
    """Documents written as files, a folder of texts for each source, which a stream follows; then one folder goes and the stream goes on."""
    folder = f"{store.shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("source", F.regexp_replace("text", "[\r\n]+", " ").alias("value"))
    # a source's texts in files of bounded size, as a reader of the stream gets each file whole
    docs.repartition("source").write.option("maxRecordsPerFile", PER_FILE).partitionBy("source").text(f"{folder}/in")
    each = lambda changes, n: changes.select("path", "change").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    watch.finished(watch.watch(spark, f"{folder}/in", f"{folder}/state", each))
    store.remove(spark, f"{folder}/in/source=src2")
    watch.finished(watch.watch(spark, f"{folder}/in", f"{folder}/state", each))
    seen = spark.read.schema("path string, change string").parquet(f"{folder}/out")
    return seen.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "change").distinct()


class _Down:
    name, dimension = "down", 4

    def healthy(self):
        return False

    def embed(self, texts):
        raise RuntimeError("down")


class _Lengths:
    name, dimension = "lengths", 2

    def healthy(self):
        return True

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


@query("embed_fallback", "SELECT doc_id, 'lengths' AS provider, length(text)::DOUBLE AS first FROM documents")
def embed_fallback(spark, sf_dir):
    provider = embed.pick([_Down(), _Lengths()])
    out = embed.embed_with(documents(spark, sf_dir).select("doc_id", "text"), "text", provider)
    return out.select("doc_id", F.lit(provider.name).alias("provider"), F.col("embedding")[0].alias("first"))
