"""Index files as they come: a file stream, chunks of each micro-batch, and an upsert into a version of the chunk table.

Restarting goes on from the stream's checkpoint; a batch that runs twice writes the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import chunkers as C

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All supported files below a folder: path, modified, file_type, file_size, content_hash, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return described(files)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, file_size) of all supported files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("file_size"))
    return files.filter(T.file_type(F.col("path")).isNotNull() & ~T.excluded(F.col("path")))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of those paths, as ``scan`` gives them."""
    return described(spark.read.format("binaryFile").load([p.replace("\\", "\\\\").translate({ord(c): f"\\{c}" for c in "*?[]{}"}) for p in paths]))


def none(spark: SparkSession) -> DataFrame:
    return described(spark.createDataFrame([], FILE_SCHEMA))


def described(files: DataFrame) -> DataFrame:
    kind = T.file_type(F.col("path"))
    out = files.select("path", F.col("modificationTime").alias("modified"), kind.alias("file_type"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("content_hash"), "content")
    return out.filter(F.col("file_type").isNotNull() & ~T.excluded(F.col("path")))


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of text files, with ids from the whole content."""
    texts = files.filter(~F.col("file_type").isin("pdf", "docx")).select("path", F.col("content").cast("string").alias("text"))
    chunked = C.chunks(texts, C.sections(F.col("text")), lambda p: F.lit(True), key="path")
    return chunked.select("path", "chunk", T.hash_id(F.concat("path", "content")).alias("chunk_id"), "content", "token_count")


def watch(spark: SparkSession, folder: str, each_batch: Callable[[DataFrame, int], None], checkpoint: str, max_files: int = 1000):
    """Start a stream over new files below a folder; ``each_batch`` gets the described files of each micro-batch."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    return stream.writeStream.foreachBatch(lambda df, n: each_batch(described(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_version(target: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: chunks of micro-batch ``n`` go to a folder of its own, replaced if the batch runs again."""

    def write(files: DataFrame, n: int) -> None:
        chunk_files(files).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return write


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each path's last batch."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"]).drop("batch")


def throttle(events: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Leading-edge debounce of a stream of (key, ts): state is the last accepted time of each key.

    Needs a state store with column families (RocksDB).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Throttle(StatefulProcessor):
        def init(self, handle):
            self.last = handle.getValueState("last", "ts timestamp")

        def handleInputRows(self, key, rows, timers):
            last = self.last.get()[0] if self.last.exists() else None
            for pdf in rows:
                kept = []
                for ts in pdf.sort_values("ts")["ts"]:
                    if last is None or (ts - last).total_seconds() >= gap_seconds:
                        kept.append(ts)
                        last = ts
                if kept:
                    yield pd.DataFrame({"key": [str(key[0])] * len(kept), "ts": kept})
            if last is not None:
                self.last.update((last,))

        def close(self):
            pass

    return events.groupBy(key).transformWithStateInPandas(Throttle(), "key string, ts timestamp", "Append", "None")
