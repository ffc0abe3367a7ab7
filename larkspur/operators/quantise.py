"""Product quantisation of vectors.

The codebook is rows (sub, code, centroid). It has subspaces x codes rows whatever the data's size, so it may be broadcast; vectors never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.vectors import squared_euclidean

SUBSPACES, CODES, ROUNDS = 8, 16, 10
SAMPLE = 2000


def parts(vecs: DataFrame, key: str = "doc_id", subspaces: int = SUBSPACES) -> DataFrame:
    """(key, sub, part): each vector cut into subspaces."""
    width = F.floor(F.size("embedding") / subspaces).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda i: F.slice("embedding", i * width + 1, width))
    return vecs.select(key, F.posexplode(cut).alias("sub", "part"))


def with_codebook(cut: DataFrame, codebook: DataFrame) -> DataFrame:
    """Parts beside an array of their subspace's (code, centroid)."""
    book = codebook.groupBy("sub").agg(F.sort_array(F.collect_list(F.struct("code", "centroid"))).alias("book"))
    return cut.join(F.broadcast(book), "sub")


def nearest_code(part: Column, book: Column) -> Column:
    """struct(distance, code): the nearest centroid, ties to the smaller code."""
    return F.array_min(F.transform(book, lambda b: F.struct(F.round(squared_euclidean(part, b["centroid"]), 9).alias("distance"), b["code"].alias("code"))))


def encode(vecs: DataFrame, codebook: DataFrame, key: str = "doc_id", subspaces: int = SUBSPACES) -> DataFrame:
    """(key, codes array<int>)."""
    coded = with_codebook(parts(vecs, key, subspaces), codebook).select(key, "sub", nearest_code(F.col("part"), F.col("book"))["code"].alias("code"))
    return coded.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("sub", "code"))), lambda x: x["code"].cast("int")).alias("codes"))


def decode(codes: DataFrame, codebook: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, embedding array<double>) rebuilt from codes."""
    each = codes.select(key, F.posexplode("codes").alias("sub", "code")).join(F.broadcast(codebook), ["sub", "code"])
    return each.groupBy(key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("sub", "centroid"))), lambda x: x["centroid"])).alias("embedding"))


def fixed_codebook(vecs: DataFrame, key: str = "doc_id", subspaces: int = SUBSPACES, codes: int = CODES) -> DataFrame:
    """The parts of the vectors with the smallest keys as centroids."""
    first = vecs.orderBy(key).limit(codes)
    return parts(first, key, subspaces).select("sub", F.col(key).cast("int").alias("code"), F.transform("part", lambda x: x.cast("double")).alias("centroid"))


def train(vecs: DataFrame, key: str = "doc_id", subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """A codebook by Lloyd's rounds from a farthest-point start, on at most ``sample`` vectors (the smallest hashes of the key).

    Empty clusters keep their centroid; fewer distinct vectors than codes give fewer codes. The sample bounds what the driver holds.
    """
    import numpy as np

    rows = vecs.orderBy(F.xxhash64(key), key).limit(sample).select("embedding").collect()
    if len(rows) < codes:
        raise ValueError(f"{len(rows)} vectors cannot train {codes} codes")
    x = np.array([r[0] for r in rows], float)
    width, book = x.shape[1] // subspaces, []
    for s in range(subspaces):
        p = x[:, s * width : (s + 1) * width]
        chosen, far = [p[0]], ((p - p[0]) ** 2).sum(1)
        while len(chosen) < codes and far.max() > 0:
            chosen.append(p[far.argmax()])
            far = np.minimum(far, ((p - chosen[-1]) ** 2).sum(1))
        c = np.array(chosen)
        for _ in range(rounds):
            near = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([p[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        book += [(s, k, [float(v) for v in c[k]]) for k in range(len(c))]
    return vecs.sparkSession.createDataFrame(book, "sub int, code int, centroid array<double>")


def adc_table(q: DataFrame, codebook: DataFrame, subspaces: int = SUBSPACES) -> DataFrame:
    """One row, ``lookup`` map (sub, code) -> squared distance of the query's part to the centroid."""
    cut = parts(q.select(F.lit(0).alias("k"), F.col("q").alias("embedding")), "k", subspaces)
    d = cut.join(F.broadcast(codebook), "sub").select((F.col("sub") * 100000 + F.col("code")).alias("at"), squared_euclidean(F.col("part"), F.col("centroid")).alias("d"))
    return d.agg(F.map_from_entries(F.collect_list(F.struct("at", "d"))).alias("lookup"))


def adc_distance(codes: Column, lookup: Column) -> Column:
    return F.aggregate(F.transform(codes, lambda c, i: F.element_at(lookup, i * 100000 + c)), F.lit(0.0), lambda s, x: s + x)
