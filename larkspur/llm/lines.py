"""Line deduplication in DataFrame functions alone.

A line's key is hashed to 128 bits. The rows (hash, document, position) are range-partitioned by hash and sorted by document and position
within, so that the first occurrence of a hash streams past before its repeats. The result is, for each document that loses lines,
the runs of its dropped positions: a run-length-coded keep bitmap instead of text.

Hot lines: the keys that occur most often, HOT of them at most, are found by a pre-aggregated count and resolved by a broadcast of (hash,
first document), whose size HOT bounds. Any other key has less than 1/HOT of all rows, so no range
holds an unbounded group.

Defined results: null or empty text is one empty line; a null doc_id is a document before all others; rows that share a doc_id count as
one document but keep their own lines; repeated rows get equal results; other columns are kept by
``dedup`` and ignored by the digest; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, shuffle_partitions, table

#: Keys that are resolved by broadcast: 32 bytes each, 64 KB together.
HOT = 2000
MIN_KEY = 10
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIRST = -(2**63)


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case and no other letter changed."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() folds more than A-Z, so it serves lines of one byte a character only
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(documents: DataFrame) -> DataFrame:
    """(doc, row, pos, h1, h2) of each line whose key is long enough."""
    key = line_key(F.col("line"))
    return (
        documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("doc"), F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .select("doc", "row", "pos", key.alias("key"))
        .filter(F.char_length("key") >= MIN_KEY)
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def dropped_runs(documents: DataFrame) -> DataFrame:
    """(doc, row, runs array<struct<start,len>>): the keep bitmap of each document that loses lines, as runs of dropped lines."""
    lines = cut_lineage(hashed_lines(documents))
    hot = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).orderBy(F.desc("n"), "h1", "h2").limit(HOT).select("h1", "h2", "first")
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    in_order = Window.partitionBy("h1", "h2").orderBy("doc", "pos")
    cold = (
        marked.filter(F.col("first").isNull())
        .repartitionByRange(shuffle_partitions(documents.sparkSession), "h1", "h2")
        .sortWithinPartitions("h1", "h2", "doc", "pos")
        .withColumn("first", F.first("doc").over(in_order))
    )
    again = marked.filter(F.col("first").isNotNull()).unionByName(cold).filter("doc > first").select("doc", "row", "pos").distinct()
    nth = F.row_number().over(Window.partitionBy("doc", "row").orderBy("pos"))
    return (
        again.withColumn("run", F.col("pos") - nth)
        .groupBy("doc", "row", "run")
        .agg(F.struct(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("len")).alias("part"))
        .groupBy("doc", "row")
        .agg(F.sort_array(F.collect_list("part")).alias("runs"))
    )


def with_runs(documents: DataFrame) -> DataFrame:
    """(own struct of all columns, doc_id, text, runs): runs are null where no line is dropped."""
    keyed = documents.select(F.struct("*").alias("own"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("key_doc"), F.xxhash64("text").alias("key_row"))
    joined = keyed.join(dropped_runs(documents), (F.col("key_doc") == F.col("doc")) & (F.col("key_row") == F.col("row")), "left")
    return joined.select("own", F.col("own.doc_id").cast("long").alias("doc_id"), F.col("own.text").cast("string").alias("text"), "runs")


def kept_text() -> Column:
    """Join the lines between the dropped runs: linear in the lines, however many runs there are."""
    lines = "split(coalesce(text, ''), '\n', -1)"
    ends = f"concat(transform(runs, r -> r.start), array(size({lines})))"
    begins = "concat(array(0), transform(runs, r -> r.start + r.len))"
    between = f"flatten(zip_with({begins}, {ends}, (b, e) -> slice({lines}, b + 1, e - b)))"
    return F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.expr(between), "\n"))


def digest_columns(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""
    dropped = F.expr("coalesce(aggregate(runs, 0L, (n, r) -> n + r.len), 0L)")
    return with_runs(documents.select("doc_id", "text")).select(
        "doc_id",
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
        F.sha2(kept_text(), 256).alias("kept_sha256"),
    )


def dedup(documents: DataFrame) -> DataFrame:
    """Documents with the repeated lines taken out of ``text`` and ``n_chars`` counted anew; null texts stay null."""
    changed = with_runs(documents).withColumn("kept", F.when(F.col("text").isNotNull(), kept_text()))
    renewed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return changed.select(*[renewed.get(c, F.col(f"own.`{c}`")).alias(c) for c in documents.columns])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, lines, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, lines[pos] AS line, translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM line
), first AS (
  SELECT key, min(doc_id) AS doc_id FROM keyed WHERE length(key) >= {MIN_KEY} GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, f.doc_id IS NOT NULL AND k.doc_id > f.doc_id AS gone FROM keyed k LEFT JOIN first f USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
