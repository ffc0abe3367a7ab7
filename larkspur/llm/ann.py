"""Approximate nearest neighbours with shifted space-filling curves.

Vectors are projected to a few dimensions, shifted, put on a grid and ordered along a Hilbert curve; several projections and
shifts give several orders. A sketch of an order's keys gives CELLS cuts at equal shares of the rows. A query's window in an order reaches from
the cut WINDOW of all rows before its own key to the cut that share behind it, K rows either side at least. Each order is dealt by key range over Spark
partitions; what travels are eight-bit codes of the vectors, packed by task and range. A query goes to the ranges that its window touches and is held
there against the rows whose keys lie within the window, no others. The KEPT nearest by code of each window are merged over the
orders, and the KEPT nearest of those are reranked by the exact distance of the original vectors.

The window is a share of the order, so that the recall is the same at every size: vectors without structure (64 nearly independent
dimensions, where the 10th neighbour is at four fifths of the mean distance) cannot be found to nine tenths in windows of a fixed number of rows. The work is a
stated query set against CURVES * 2 * WINDOW of all rows, in blocks; on vectors with structure far smaller shares will do.

Equal vectors are one entry with its K + 1 smallest ids, so a vector that a third of the rows hold fills no window; different vectors of one
key are spread by a hash of their ids behind it.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part, as
queries or candidates; null ids take no part; rows repeated with one id count once; an id with several vectors asks with the smallest of them
and is found by the nearest; ties go to the smaller id among those found; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, mix, shuffle_partitions, table

K, EVERY = 10, 100
CURVES, DIMS, BITS, TIE_BITS = 32, 8, 7, 6
#: Share of an order on either side of a query's place.
WINDOW = 0.015
#: Cuts of an order; a range is a number of whole cells.
CELLS = 1000
#: Vectors of one range, on average, at most (up to CELLS times as many vectors; then ranges grow).
RANGE_ROWS = 20_000
#: Rows that are decoded at once, and candidates that are kept of a window and in all for each neighbour asked for.
BLOCK, KEPT = 65_536, 3
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of non-negative integers below 2**bits (bits * columns <= 62).

    The transpose form of the index: Gray-code the axes from the top bit down, undo the excess rotations, interleave.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[i] & high) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections and shifts, fitted to the range of the vectors' norms alone."""

    def __init__(self, length: int, norm: float, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        dims = min(dims, length)
        # projections of one rotation are orthogonal to each other, so they tell different things
        groups = length // dims
        rotations = [np.linalg.qr(rng.normal(size=(length, length)))[0] for _ in range(-(-curves // groups))]
        self.axes = [rotations[c // groups][:, c % groups * dims : (c % groups + 1) * dims] for c in range(curves)]
        # a projection spreads as norm / sqrt(length); 2.5 times that either way is on the grid, the rest at its rim
        self.scale = 2.5 * norm / np.sqrt(length)
        self.shifts = rng.random((curves, dims))
        self.bits = bits

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
        """Each order's keys; vectors of one place on the curve are spread by their ids."""
        top = (1 << self.bits) - 1
        out = []
        for c, (axes, shift) in enumerate(zip(self.axes, self.shifts)):
            place = (vectors @ axes / self.scale + 1) / 2  # 0 to 1
            key = hilbert_keys(np.clip((place + shift) / 2 * top, 0, top).astype(np.int64), self.bits)
            out.append(key << TIE_BITS | (mix(ids.astype(np.uint64) + np.uint64(c)) >> np.uint64(64 - TIE_BITS)).astype(np.int64))
        return out


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight-bit codes of vectors and what a unit of each stands for."""
    unit = np.abs(vectors).max(axis=1) / 127
    return np.rint(vectors / unit[:, None]).astype(np.int8), unit.astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    good = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return out.filter(good)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each distinct vector (-0.0 is 0.0) with its ``most`` smallest ids.

    Thinned within each task's rows first, so the holders of one common vector never meet in one place.
    """
    ids = rows.select(F.spark_partition_id().alias("task"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "vec_id")

    def smallest(df, *by):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        return df.dropDuplicates([*by, "vec_id"]).withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")

    thin = smallest(smallest(ids, "task", "v").drop("task"), "v")
    return thin.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.array(batch.column("v").flatten()).reshape(-1, length)


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, window: float = WINDOW, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    rows = usable(vectors)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length = common["n"]
    rows = rows.filter(F.size("v") == length)
    entries = cut_lineage(distinct_vectors(rows, k + 1).withColumn("id", F.col("ids")[0]))
    facts = entries.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")).alias("norm")).first()
    model = Curves(length, facts["norm"], curves)
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("id")).agg(F.min("v").alias("v"))

    def order(batches):
        for batch in batches:
            if batch.num_rows:
                for c, key in enumerate(model.keys(_matrix(batch, length), batch.column("id").to_numpy())):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), c), pa.int32()), pa.array(key)], names=["curve", "key"])

    keyed = entries.select("id", "v").mapInArrow(order, "curve int, key long")
    sketch = keyed.groupBy("curve").agg(F.percentile_approx("key", [i / CELLS for i in range(1, CELLS)], 10 * CELLS).alias("cuts")).collect()
    cuts = {r["curve"]: np.array(r["cuts"], np.int64) for r in sketch}  # CURVES x CELLS numbers, whatever the table
    ranges = min(CELLS, -(-facts["n"] // RANGE_ROWS))
    firsts = np.arange(1, ranges) * CELLS // ranges - 1  # the cuts where ranges begin
    reach = int(np.ceil(min(1.0, max(window, k / facts["n"])) * CELLS))

    def deal(batches):
        """Packed rows of each range."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _matrix(batch, length), batch.column("id").to_numpy()
            codes, units = coded(v)
            for c, key in enumerate(model.keys(v, ids)):
                place = np.searchsorted(cuts[c][firsts], key, side="right")
                rows = []
                for r in np.unique(place).tolist():
                    at = place == r
                    rows.append((c * ranges + r, key[at].tobytes(), ids[at].tobytes(), codes[at].tobytes(), units[at].tobytes()))
                yield _packed(rows, STORED)

    def ask(batches):
        """Packed queries of each range that their windows touch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _matrix(batch, length), batch.column("id").to_numpy()
            for c, key in enumerate(model.keys(v, ids)):
                edges = np.concatenate([[NEVER_LESS], cuts[c], [NEVER_MORE]])
                cell = np.searchsorted(cuts[c], key, side="right")
                low, high = edges[np.maximum(cell - reach, 0)], edges[np.minimum(cell + reach + 1, CELLS)]
                first, last = np.searchsorted(cuts[c][firsts], low, side="right"), np.searchsorted(cuts[c][firsts], high, side="left")
                rows = []
                for r in range(int(first.min()), int(last.max()) + 1):
                    at = (first <= r) & (r <= last)
                    if at.any():
                        rows.append((c * ranges + r, low[at].tobytes(), high[at].tobytes(), ids[at].tobytes(), v[at].astype(np.float32).tobytes()))
                yield _packed(rows, ASKED)

    def search(batches):
        held, bucket = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    yield from found(held)
                    held, bucket = [], row["bucket"]
                held.append(row)
        yield from found(held)

    def found(held):
        asked, stored = [x for x in held if x["low"] is not None], [x for x in held if x["low"] is None]
        if not asked or not stored:
            return

        def joined(of, name, kind):
            return np.frombuffer(b"".join([x[name] for x in of]), kind)

        key, ids, unit = joined(stored, "key", np.int64), joined(stored, "id", np.int64), joined(stored, "unit", np.float32)
        code = joined(stored, "code", np.int8).reshape(-1, length)
        low, high, query_ids = joined(asked, "low", np.int64), joined(asked, "high", np.int64), joined(asked, "id", np.int64)
        wanted = joined(asked, "code", np.float32).reshape(-1, length)
        in_order = np.lexsort((ids, key))
        key, ids, unit, code = key[in_order], ids[in_order], unit[in_order], code[in_order]
        start, stop = np.searchsorted(key, low, side="left"), np.searchsorted(key, high, side="left")
        for at in range(0, len(key), BLOCK):
            some = code[at : at + BLOCK] * unit[at : at + BLOCK, None]
            square, own = (some * some).sum(axis=1), ids[at : at + BLOCK]
            out = [], [], []
            for q in np.flatnonzero((start < at + BLOCK) & (stop > at)).tolist():
                a, b = max(0, start[q] - at), min(len(own), stop[q] - at)
                likely = square[a:b] - 2 * (some[a:b] @ wanted[q])
                most = KEPT * k + 1  # the query itself may be among them
                best = np.argpartition(likely, most - 1)[:most] if b - a > most else np.arange(b - a)
                out[0].append(np.full(len(best), query_ids[q]))
                out[1].append(own[a:b][best])
                out[2].append(likely[best])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "id", "likely"])

    stored = entries.select("id", "v").mapInArrow(deal, STORED).withColumns({"low": F.lit(None).cast("binary"), "high": F.lit(None).cast("binary")})
    asked = queries.mapInArrow(ask, ASKED).withColumnRenamed("v", "code").withColumns({"key": F.lit(None).cast("binary"), "unit": F.lit(None).cast("binary")})
    dealt = stored.unionByName(asked).repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket")
    windows = dealt.mapInArrow(search, "query_id long, id long, likely float")
    merged = windows.groupBy("query_id", "id").agg(F.min("likely").alias("likely"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("likely", "id"))
    few = merged.withColumn("nth", nth).filter(F.col("nth") <= KEPT * k + 1).drop("nth", "likely")
    exact = F.expr("sqrt(aggregate(zip_with(v, q, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
    pairs = few.join(entries, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = pairs.select("query_id", F.explode("ids").alias("vec_id"), exact.alias("score")).filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = scored.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


NEVER_LESS, NEVER_MORE = -(2**63), 2**63 - 1
STORED = "bucket int, key binary, id binary, code binary, unit binary"
ASKED = "bucket int, low binary, high binary, id binary, v binary"


def _packed(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
