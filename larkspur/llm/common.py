"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from larkspur.operators.store import shared_folder

#: Rows that a Python operator works on at once; bounds a worker's memory together with CHUNK_CHARS.
CHUNK_ROWS = 512
#: Code points that a Python operator works on at once (one longer text makes a chunk of its own).
CHUNK_CHARS = 1_000_000
#: Key of a chunk's list of which texts were null; no column's name.
WAS_NULL = None
#: Bytes of the texts that a model is fitted on at most.
FIT_BYTES = 64_000_000
#: Entries of a per-worker word cache before its older half is dropped, and code points of the longest key that is kept.
CACHE_ENTRIES, CACHE_KEY = 400_000, 64


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of the dataset through Spark, whatever store it lies in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the folder the cluster names in ``spark.checkpoint.dir``.

    The setting is read from the session; a folder of our own is set only where none is (local tests).
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_kept: dict[str, object] = {}


def one_per_worker(name: str, make: Callable[[], object]):
    """This process's object of that name. Another operator's goes, so that a worker which runs several stages holds one stage's caches."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what ``one_per_worker`` keeps."""
    _kept.clear()


class WordCache(dict):
    """A dict that computes missing entries and forgets its older half when it is full; long keys are never kept, so its bytes are bounded, too."""

    def __init__(self, compute: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(key) > CACHE_KEY:
            return self.compute(key)
        if len(self) >= self.entries:
            for old in list(self)[: self.entries // 2]:
                del self[old]
        self[key] = value = self.compute(key)
        return value


class BatchCache(dict):
    """Values by word, computed for many missing words at once; forgets its older half when it is full, and long words are never kept."""

    def __init__(self, compute: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def many(self, words: list[str]) -> list:
        """The values of distinct words."""
        found = list(map(self.get, words))
        missing = [w for w, x in zip(words, found) if x is None]
        if missing:
            made = dict(zip(missing, self.compute(missing)))
            if len(self) + len(made) > self.entries:
                for old in list(self)[: self.entries // 2]:
                    del self[old]
            self.update((w, x) for w, x in made.items() if len(w) <= CACHE_KEY)
            found = [made[w] if x is None else x for w, x in zip(words, found)]
        return found


def chunk_slices(batches: Iterable[pa.RecordBatch], text: str = "text", most_rows: int = CHUNK_ROWS, most_chars: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded rows and bounded text."""
    for batch in batches:
        start = 0
        column = batch.column(batch.schema.names.index(text))
        while start < batch.num_rows:
            stop, size = start, 0
            while stop < batch.num_rows and stop - start < most_rows and (stop == start or size < most_chars):
                value = column[stop]
                size += len(value.as_buffer()) if value.is_valid else 0
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def listed(part: pa.RecordBatch, text: str, names: Iterable[str]) -> dict[str, list]:
    """The named columns as lists; null text becomes empty, and which texts were null stands under WAS_NULL."""
    rows = {name: part.column(name).to_pylist() for name in {*names, text}}
    rows[WAS_NULL] = [t is None for t in rows[text]]
    rows[text] = [t or "" for t in rows[text]]
    return rows


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most_rows: int = CHUNK_ROWS, most_chars: int = CHUNK_CHARS) -> Iterator[dict[str, list]]:
    """The slices of the batches as lists by column."""
    for part in chunk_slices(batches, text, most_rows, most_chars):
        yield listed(part, text, part.schema.names)


def map_chunks(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | StructType, text: str = "text", keep: Iterable[str] = (), most_rows: int = CHUNK_ROWS, most_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Map bounded chunks of ``df`` with the function that ``make()`` builds once per Python worker task.

    No shuffle: each input split becomes output rows in the task that reads it. Columns in ``keep`` pass as they are.
    """
    parsed = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow, kept = to_arrow_schema(parsed), frozenset(keep)
    wanted = [c for c in df.columns if c not in kept]

    def run(batches):
        work = make()
        for part in chunk_slices(batches, text, most_rows, most_chars):
            out = work(listed(part, text, wanted))
            yield pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) if f.name in kept else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, parsed)


def numbered(documents: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their columns called c0, c1, ..., so that no name can clash, and what the needed ones (in any case) are called now.

    ``toDF(*documents.columns)`` gives the names back.
    """
    names = [f"c{i}" for i in range(len(documents.columns))]
    places = {c.lower(): name for c, name in zip(documents.columns, names)}
    return documents.toDF(*names), {c: places[c] for c in needed if c in places}


def bounded_sample(known: DataFrame, rows: int, size: int) -> DataFrame:
    """Rows of ``known`` (doc_id, text, ...) of the ids with the smallest hashes: ``rows`` rows and ``size`` bytes of text at most.

    An id with more than a sixteenth of either is left out, so that one id cannot be the sample.
    """
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    first = ids.filter((F.col("n") <= max(1, rows // 16)) & (F.col("bytes") <= size // 16)).orderBy(*by_hash).limit(rows)
    so_far = Window.orderBy(*by_hash).rowsBetween(Window.unboundedPreceding, 0)  # over ``rows`` rows at most
    picked = first.withColumns({"n": F.sum("n").over(so_far), "bytes": F.sum("bytes").over(so_far)}).filter((F.col("n") <= rows) & (F.col("bytes") <= size))
    return known.join(F.broadcast(picked.select("doc_id")), "doc_id")


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts in order, where each text's words begin and the last one's end).

    Words lie between white space; the empty word may be one of them. Texts may not hold lone surrogates.
    """
    found = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    coded = found.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), found.offsets.to_numpy()


def gathered(parts: list[bytes], numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the parts of those numbers one behind the other, in bytes; where each begins and the last one ends). ``width`` divides all lengths."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    starts = np.cumsum(sizes) - sizes
    of = sizes[numbers]
    ends = np.concatenate([[0], np.cumsum(of)])
    at = np.arange(ends[-1]) + np.repeat(starts[numbers] - ends[:-1], of)
    items = np.frombuffer(b"".join(parts), np.dtype(f"V{width}"))
    return items[at], ends
