"""Document fingerprints by invertible Bloom lookup tables over paragraph digests.

A text is cut into paragraphs: lines, and within a line behind code points at which a hash of the last few meets a condition, so that an edit
in a long line stays local, in any language and script. Each paragraph's digest (with its number, where it occurs again) is
added to three cells of count, key and check sums. The fingerprint is the table of BASE cells.

Two versions' tables subtract cell by cell; what both hold cancels. Peeling then recovers the differing digests: a cell whose count is one
and whose check fits its key gives a digest, which is taken out of its other cells. If peeling gets stuck, both sides retry with GROWTH
times the cells until it succeeds (or, where tables many times larger than the digests do not help, as two equal digests on one side would have it, the
digests are counted). From the differing digests the likeness follows: shared digests / all digests.

Neighbours in order of doc_id meet by a range partitioning whose bounds are ids of the table, so that each range's first row is
known and goes to the range before it, too. An id that many rows share (null, say) has several ranges, by a hash of the text. Each range is one
partition; no range is larger than the others (but for equal rows) and no row is collected.

Defined results: null text counts as empty; two texts without paragraphs are alike (1), one without is unlike any other (0); a null doc_id
comes before all others; rows of one doc_id are in order of a hash of their texts, and a repeated row is its own neighbour's equal; the only row
of a table is its own next; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import CHUNK_CHARS, U, mix, shuffle_partitions, table

#: Cells of a fingerprint, in three parts; and the factor of a retry.
BASE, GROWTH = 24, 4
PART = 3
NULL_ID = -(2**63)
#: Code points of the hashed window; of a part of a line on average and at most.
WINDOW, MEAN, MOST = 3, 24, 128


def paragraphs(text: str) -> list[bytes]:
    """The lines, cut behind windows whose hash meets a condition and where MOST code points have none; four bytes a code point."""
    data = text.encode("utf-32-le", "replace")
    points = np.frombuffer(data, np.uint32)
    lines = np.flatnonzero(points == 10)
    wide = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        rolled = wide[WINDOW - 1 :].copy()
        for k in range(1, WINDOW):
            rolled = rolled * U(0x9E3779B97F4A7C15) + wide[WINDOW - 1 - k : len(wide) - k]
    inner = np.flatnonzero(mix(rolled) % U(MEAN) == 0) + WINDOW
    bounds = np.unique(np.concatenate([[0], inner, lines, lines + 1, [len(points)]]))
    if (np.diff(bounds) > MOST).any():
        bounds = np.unique(np.concatenate([bounds, *(np.arange(a, b, MOST) for a, b in zip(bounds, bounds[1:]) if b - a > MOST)]))
    starts = bounds[:-1]
    some = points[starts] != 10  # a line's end is no paragraph
    return [data[a:b] for a, b in zip((4 * starts[some]).tolist(), (4 * bounds[1:][some]).tolist())]


def digests(text: str) -> np.ndarray:
    """64-bit digests of the text's paragraphs; the second and later of equal ones are mixed with their number."""
    out = np.array([*map(xxhash.xxh3_64_intdigest, paragraphs(text))], np.uint64)
    order = np.argsort(out, kind="stable")
    ranked, at = out[order], np.arange(len(out))
    fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(out)]
    number = np.empty(len(out), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    with np.errstate(over="ignore"):
        return np.where(number > 0, mix(out + number * U(0x9E3779B97F4A7C15)), out)


class Tables:
    """Lookup tables of ``n`` texts with ``cells`` cells each, side by side."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, np.uint64)
        self.check = np.zeros(n * cells, np.uint64)

    def places(self, owner: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        width = self.cells // PART
        return [owner * self.cells + i * width + (mix(keys ^ U(0xA5A5 + 977 * i + self.cells)) % U(width)).astype(np.int64) for i in range(PART)]

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        times = np.asarray(sign, np.int64).astype(U)  # sums are modulo 2**64, so -1 takes out
        with np.errstate(over="ignore"):
            key, check = keys * times, mix(keys) * times
        for at in self.places(owner, keys):
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key)
            np.add.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests only in the first version, only in the second, whether all were recovered), by text. Empties the tables."""
        only = np.zeros((2, self.n), np.int64)
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[pure]
            with np.errstate(over="ignore"):
                keys, check = self.key[pure] * sign.astype(U), self.check[pure] * sign.astype(U)
            fits = mix(keys) == check
            if not fits.any():
                break
            owner, keys, sign = pure[fits] // self.cells, keys[fits], sign[fits]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            first = np.append(True, (np.diff(owner) != 0) | (keys[1:] != keys[:-1]))  # a digest may show in several cells
            owner, keys, sign = owner[first], keys[first], sign[first]
            np.add.at(only[0], owner[sign > 0], 1)
            np.add.at(only[1], owner[sign < 0], 1)
            self.add(owner, keys, -sign)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return only[0], only[1], ~left.reshape(self.n, self.cells).any(axis=1)

    def packed(self) -> list[str]:
        """Each text's cells as base64 of little-endian counts (32 bits), keys and checks (64 bits)."""
        out = []
        for i in range(self.n):
            at = slice(i * self.cells, (i + 1) * self.cells)
            data = self.count[at].astype("<i4").tobytes() + self.key[at].astype("<u8").tobytes() + self.check[at].astype("<u8").tobytes()
            out.append(base64.b64encode(data).decode())
        return out


def spread(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    return np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """Number of paragraphs and BASE cells of each set of digests."""
    tables = Tables(len(sets), BASE)
    tables.add(*spread(sets), 1)
    return [f"{len(s)}:{cells}" for s, cells in zip(sets, tables.packed())]


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared digests / all digests of each pair of versions, by subtracting tables and peeling."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    shared = np.zeros(len(a), np.int64)
    todo, cells = np.arange(len(a)), BASE
    enough = GROWTH**2 * (int((size_a + size_b).max(initial=0)) + BASE)  # tables in which peeling fails for equal keys on one side only
    while len(todo):
        if cells > enough:
            for i in todo:
                shared[i] = sum((Counter(a[i].tolist()) & Counter(b[i].tolist())).values())
            break
        tables = Tables(len(todo), cells)
        tables.add(*spread([a[i] for i in todo]), 1)
        tables.add(*spread([b[i] for i in todo]), -1)
        only_a, _, whole = tables.peel()
        shared[todo[whole]] = size_a[todo[whole]] - only_a[whole]
        todo, cells = todo[~whole], cells * GROWTH
    total = size_a + size_b - shared
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the following one, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _rows(keys: list[int], texts: list[str]) -> pa.RecordBatch:
    """Result rows of all texts but the last, which is only a neighbour."""
    own = [digests(t) for t in texts]
    versions = [edited(t, f) for t, f in zip(texts, texts[1:])]
    changed = [digests(v) for v in versions]
    columns = [
        [None if k == NULL_ID else k for k in keys[:-1]],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(v.encode("utf-8", "replace")).hexdigest() for v in versions],
        fingerprints(own[:-1]),
        fingerprints(changed),
        likeness(own[:-1], changed),
        likeness(own[:-1], own[1:]),
    ]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class Ranges:
    """Ranges of (key, hash) by bounds that begin them; range 0 has none."""

    def __init__(self, cuts: list[int], least: int):
        self.least, bounds = least, []
        often = Counter(cuts)
        for c, n in sorted(often.items()):
            if c > least:
                bounds.append((c, NULL_ID))
            # a key that is several cuts holds so many ranges' rows
            bounds += [(c, NULL_ID + k * 2**64 // n) for k in range(1, n)]
        self.keys, self.hashes = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))
        self.hot = sorted(c for c, n in often.items() if n > 1)
        self.last = len(bounds)

    def of(self, key: np.ndarray, digest: np.ndarray) -> np.ndarray:
        out = np.searchsorted(self.keys, key, side="left")
        for c in np.unique(key[np.isin(key, self.keys)]):
            low, high = np.searchsorted(self.keys, c, side="left"), np.searchsorted(self.keys, c, side="right")
            at = key == c
            out[at] += np.searchsorted(self.hashes[low:high], digest[at], side="right")
        return out.astype(np.int32)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """SCHEMA for each document and its version edited with the next one. One shuffle of the texts."""
    spark = documents.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text).alias("digest"), text.alias("text"))
    cuts = F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts) if parts > 1 else F.array(F.lit(None).cast("long"))
    facts = docs.agg(F.min("key").alias("least"), cuts.alias("cuts")).first()
    if facts["least"] is None:
        return spark.createDataFrame([], SCHEMA)
    ranges = Ranges([x for x in facts["cuts"] if x is not None], facts["least"])

    def places(batches):
        for batch in batches:
            key, digest = batch.column("key").to_numpy(), batch.column("digest").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(key, digest)), *batch.columns], names=["part", "key", "digest"])

    # the first row of each range goes to the one before, too: known by its id where a bound is an id, else by the least hash there is
    starts = {r: (int(ranges.keys[r - 1]), None) for r in range(1, ranges.last + 1) if ranges.hashes[r - 1] == NULL_ID}
    filled = {0, *starts}
    if ranges.hot:
        of_hot = docs.filter(F.col("key").isin(*ranges.hot)).select("key", "digest").mapInArrow(places, "part int, key long, digest long")
        for r in of_hot.groupBy("part").agg(F.min("key").alias("key"), F.min("digest").alias("digest")).collect():  # ``parts`` rows at most
            filled.add(r["part"])
            if r["part"] and r["part"] not in starts:
                starts[r["part"]] = r["key"], r["digest"]
    in_order = sorted(filled)
    before = dict(zip(in_order[1:], in_order))
    wanted = [(key, digest, before[r], 1) for r, (key, digest) in starts.items()] + [(ranges.least, None, in_order[-1], 2)]
    keys_wanted = np.array([w[0] for w in wanted], np.int64)

    def deal(batches):
        for batch in batches:
            key, digest = batch.column("key").to_numpy(), batch.column("digest").to_numpy()
            at, to, edge = [np.arange(len(key))], [ranges.of(key, digest)], [np.zeros(len(key), np.int32)]
            some = np.flatnonzero(np.isin(key, keys_wanted))
            if len(some):
                for k, h, target, kind in wanted:
                    mine = some[(key[some] == k) & (True if h is None else digest[some] == h)]
                    if len(mine):  # of several first rows the one of least hash is the neighbour
                        at.append(mine[digest[mine].argmin()][None])
                        to.append(np.array([target], np.int32))
                        edge.append(np.array([kind], np.int32))
            at, to, edge = np.concatenate(at), np.concatenate(to), np.concatenate(edge)
            for low in range(0, len(at), 256):
                part = slice(low, low + 256)
                taken = batch.take(pa.array(at[part]))
                yield pa.RecordBatch.from_arrays([pa.array(to[part]), pa.array(edge[part]), *taken.columns], names=["part", "edge", "key", "digest", "text"])

    def work(batches):
        keys, texts, size, part, ended = [], [], 0, None, False
        for batch in batches:
            for p, edge, key, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if len(keys) > 1:
                        yield _rows(keys, texts)
                    keys, texts, size, part, ended = [], [], 0, p, False
                if ended:
                    continue  # of several first rows of the next range, the first is the neighbour
                keys.append(key)
                texts.append(text)
                size += len(text)
                ended = edge > 0
                if len(keys) > 512 or size > CHUNK_CHARS:
                    if len(keys) > 1:
                        yield _rows(keys, texts)
                    keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if len(keys) > 1:
            yield _rows(keys, texts)

    dealt = docs.mapInArrow(deal, "part int, edge int, key long, digest long, text string").repartitionById(parts, "part")
    return dealt.sortWithinPartitions("part", "edge", "key", "digest", "text").mapInArrow(work, SCHEMA)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
