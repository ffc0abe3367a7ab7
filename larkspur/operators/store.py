"""Tables without a table format: upserts, deletes with their dependents, sync by content hash, snapshots, versions."""

from __future__ import annotations

import atexit
import datetime
import shutil
import tempfile
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose keys are not in ``new``, and the new rows."""
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(stored.columns))


def delete(stored: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stored.join(gone.select(*keys), list(keys), "left_anti")


def cascade(gone: DataFrame, *tables: tuple[DataFrame, str], key: str = "doc_id") -> list[DataFrame]:
    """Tables without the rows that depend on the deleted keys."""
    ids = gone.select(F.col(key).alias("__gone"))
    return [t.join(ids, F.col(c) == F.col("__gone"), "left_anti") for t, c in tables]


def sync(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(path, change): added, updated, unchanged or removed, from two snapshots with hashes."""
    a = old.select(key, F.col(digest).alias("__old"))
    b = new.select(key, F.col(digest).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "updated").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def sync_within(old: DataFrame, new: DataFrame, within: Column, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """(path, change) of one source: only the tracked rows that are ``within`` it can be missing from its listing."""
    return sync(old.filter(within), new, key, digest)


def to_index(stored: DataFrame, files: DataFrame, key: str = "path", digest: str = "content_hash") -> DataFrame:
    """Files that are new or changed; the others are skipped."""
    return files.join(stored.select(key, digest), [key, digest], "left_anti")


def page(df: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def live_only(df: DataFrame, as_of: str, column: str = "expires_at") -> DataFrame:
    """Rows that have not expired at the given time."""
    return df.filter(F.col(column) > F.lit(as_of).cast("timestamp_ntz"))


def transition(progress: DataFrame, path: str, status: str, error: str | None = None) -> DataFrame:
    """Set a running record's status; others stay as they are."""
    mine = (F.col("root_path") == path) & (F.col("status") == "running")
    return progress.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "error": F.when(mine, F.lit(error)).otherwise(F.col("error"))})


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], folder: str, at: datetime.datetime) -> str:
    """Write all tables to a folder of the time's own and give its name. Readers see whole versions only; snapshots of one second do not meet."""
    target = f"{folder.rstrip('/')}/{at:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{target}/{name}")
    return target


def restore(spark: SparkSession, target: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{target}/{name}")


# --- folders and small files, on whatever store Spark reads

_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where none is and Spark runs in this process alone, one temporary folder for the application, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _temporary:
        _temporary[application] = tempfile.mkdtemp(prefix="larkspur-")
        atexit.register(shutil.rmtree, _temporary[application], ignore_errors=True)
    return _temporary[application]


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def listing(spark: SparkSession, name: str) -> list[str]:
    """Path, size and time of each file below a path, sorted."""
    path, fs = _path(spark, name)
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        out.append(f"{f.getPath()}\t{f.getLen()}\t{f.getModificationTime()}")
    return sorted(out)


def names(spark: SparkSession, name: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    path, fs = _path(spark, name)
    return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def read_text(spark: SparkSession, name: str) -> str | None:
    """The first line of a small file; None if there is no such file or nothing in it."""
    path, fs = _path(spark, name)
    if not fs.exists(path):
        return None
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(path)))
    try:
        return reader.readLine()
    finally:
        reader.close()


def size(spark: SparkSession, name: str) -> int:
    """Bytes of all files below a folder."""
    path, fs = _path(spark, name)
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def age(spark: SparkSession, name: str) -> float:
    """Seconds since anything in a folder changed last."""
    path, fs = _path(spark, name)
    last, found = fs.getFileStatus(path).getModificationTime(), fs.listFiles(path, True)
    while found.hasNext():
        last = max(last, found.next().getModificationTime())
    return time.time() - last / 1000


def qualified(spark: SparkSession, name: str) -> str:
    """The full name of a path, as the names of its files begin."""
    path, fs = _path(spark, name)
    return fs.makeQualified(path).toString().rstrip("/")


def create_once(spark: SparkSession, name: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it did. The store has to refuse to create a file that exists."""
    path, fs = _path(spark, name)
    try:
        out = fs.create(path, False)
    except Exception as error:  # the gateway wraps the store's own error
        if fs.exists(path):
            return False
        raise error
    out.write(text.encode())
    out.close()
    return True


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder and all in it, if it is there."""
    path, fs = _path(spark, name)
    fs.delete(path, True)
