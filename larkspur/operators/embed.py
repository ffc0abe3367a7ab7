"""Embedding providers: an offline one in DataFrame functions, an HTTP service, and batches through any callable."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.functions.text import tokens

DIMENSION = 64
#: Rows, and bytes of their texts, whose vectors a task holds at once.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


class Provider(Protocol):
    """What embeds texts; it is sent to the executors, so it holds no connection until first used."""

    name: str
    dimension: int

    def healthy(self) -> bool: ...

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def hash_embedding(df: DataFrame, key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, bucket, weight): feature hashing of the terms to the buckets of their md5's first 16 bits, unit length; zeros have no row."""
    terms = df.select(key, F.explode(tokens(F.col(text))).alias("term"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("long"), F.lit(dimension))
    counts = terms.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.select(key, "bucket", (F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).alias("weight"))


def dense(sparse: DataFrame, key: str, dimension: int = DIMENSION) -> DataFrame:
    """(key, embedding) from (key, bucket, weight)."""
    by = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return by.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))


def pick(providers: Iterable[Provider]) -> Provider:
    """The first healthy provider; raises where there is none."""
    for provider in providers:
        if provider.healthy():
            return provider
    raise RuntimeError("no embedding provider is healthy")


class HttpProvider:
    """A service that embeds one text a request: POST {model, prompt} to ``path`` gives {embedding}.

    A batch is asked with ``concurrency`` requests at once, in order; each has ``timeout`` seconds and ``retries`` further tries with growing pauses.
    """

    def __init__(self, url: str, model: str, dimension: int, path: str = "/api/embeddings", health: str = "/", timeout: float = 30.0, retries: int = 2, pause: float = 0.2, concurrency: int = 4):
        self.name, self.url, self.model, self.dimension, self.path, self.health = "http", url.rstrip("/"), model, dimension, path, health
        self.timeout, self.retries, self.pause, self.concurrency = timeout, retries, pause, concurrency

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(self.url + self.health, timeout=self.timeout) as answer:
                return answer.status < 300
        except (urllib.error.URLError, OSError):
            return False

    def asked(self, body: dict) -> dict:
        """The service's answer to a request."""
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(self.url + self.path, json.dumps(body).encode(), {"Content-Type": "application/json"} | self.headers())
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, OSError):
                if attempt == self.retries:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def headers(self) -> dict[str, str]:
        return {}

    def vector(self, found: Sequence[float]) -> list[float]:
        if len(found) != self.dimension:
            raise ValueError(f"{len(found)} dimensions instead of {self.dimension}")
        return [float(x) for x in found]

    def one(self, text: str) -> list[float]:
        return self.vector(self.asked({"model": self.model, "prompt": text})["embedding"])

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(self.one, texts))


class BatchProvider(HttpProvider):
    """A service that embeds many texts a request: POST {model, input: [texts]} to ``path`` gives {data: [{index, embedding}]}, in any order.

    ``per_request`` texts go in one request, ``concurrency`` requests at once. The key is read from the environment variable ``key_from`` where requests are made, so it is in no plan.
    """

    def __init__(self, url: str, model: str, dimension: int, path: str = "/v1/embeddings", health: str = "/v1/models", per_request: int = 32, key_from: str | None = None, **options):
        super().__init__(url, model, dimension, path, health, **options)
        self.name, self.per_request, self.key_from = "batch", per_request, key_from

    def headers(self) -> dict[str, str]:
        key = os.environ.get(self.key_from) if self.key_from else None
        return {"Authorization": f"Bearer {key}"} if key else {}

    def many(self, texts: Sequence[str]) -> list[list[float]]:
        found = {x["index"]: x["embedding"] for x in self.asked({"model": self.model, "input": list(texts)})["data"]}
        if sorted(found) != list(range(len(texts))):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [self.vector(found[i]) for i in range(len(texts))]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        parts = [texts[i : i + self.per_request] for i in range(0, len(texts), self.per_request)]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return [v for part in pool.map(self.many, parts) for v in part]


def _each(call: Callable, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, error) of each text: a batch that fails is asked again text by text."""
    try:
        found = [([float(x) for x in v], None) for v in call(texts)]
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return found
    except Exception as error:
        if len(texts) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        return [x for t in texts for x in _each(call, [t])]


def slices(whole: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of SLICE_ROWS rows and SLICE_BYTES of text at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(whole.column(whole.schema.names.index(text))), 0)
    ends, start = np.cumsum(np.asarray(sizes).astype(np.int64)), 0
    while start < whole.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, min(start + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        yield whole.slice(start, stop - start)
        start = stop


def embed_with(df: DataFrame, text: str, provider: Provider | Callable, batch: int = 64, out: str = "embedding", errors: str | None = None) -> DataFrame:
    """Add the provider's vectors, asked for in batches on the executors; a null text has none.

    Any failure raises; with ``errors``, the name of one more column, texts that fail have no vector but their error there, and the others keep theirs.
    """
    call = provider.embed if hasattr(provider, "embed") else provider

    def run(parts):
        for whole in parts:
            for part in slices(whole, text):
                texts = part.column(part.schema.names.index(text)).to_pylist()
                found: list = [None] * len(texts)
                wrong: list = [None] * len(texts)
                at = [i for i, t in enumerate(texts) if t is not None]
                for low in range(0, len(at), batch):
                    some = at[low : low + batch]
                    asked = [texts[i] for i in some]
                    pairs = _each(call, asked) if errors else [([float(x) for x in v], None) for v in call(asked)]
                    for i, (vector, error) in zip(some, pairs):
                        found[i], wrong[i] = vector, error
                columns = [*part.columns, pa.array(found, pa.list_(pa.float64())), *([pa.array(wrong, pa.string())] if errors else [])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    kept = [f for f in df.schema.fields if f.name not in (out, errors)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType())), *([T.StructField(errors, T.StringType())] if errors else [])])
    arrow = to_arrow_schema(schema)
    return df.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
