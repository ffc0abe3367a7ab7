"""Kept vector indexes: an inverted file of exact vectors, and product-quantised codes; both take additions, replacements and removals.

``VectorIndex`` lays vectors out by about as many cells as the square root of their number, in groups of cells (a group is a folder, sorted by cell), so a search ranks the
groups, then the cells of the nearest groups, and compares exactly what it reads. How many cells it reads depends on how many of its tenant's vectors they hold, and it
goes on until it has as many hits as were asked for. ``PqIndex`` keeps a code for each vector and compares codes by a lookup table. Centroids of groups and codebooks are
fitted on bounded samples, those of cells by Spark, a group a task, on a bounded sample of its vectors; every vector is indexed. What tasks and the driver hold is
bounded by CELLS_MOST; vectors never come to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.functions.vectors import cosine_similarity
from larkspur.operators import quantise, store
from larkspur.operators.segments import SegmentStore

CELLS_MOST, PER_CELL, ROUNDS = 16_384, 64, 8
#: Share of the live vectors that a search reads at least, live vectors for each hit, and how much more it reads each time that it has found too few.
SHARE, NEED, MORE = 0.6, 20, 4
#: Questions and vectors that a task compares at most, and questions whose scores it holds at once.
QUESTIONS, ROWS, BLOCK = 8192, 16_384, 64


def spherical(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of spherical k-means, from rows at equal steps."""
    x = x[np.linalg.norm(x, axis=1) > 0] if len(x) else x
    if not len(x):
        raise ValueError("no vector to place centroids by")
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def usable(vecs: DataFrame, *columns: str) -> DataFrame:
    """The columns and the embedding as doubles, without empty vectors and zeros."""
    return vecs.select(*columns, F.transform("embedding", lambda x: x.cast("double")).alias("embedding")).filter("size(embedding) > 0 and exists(embedding, x -> x <> 0)")


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, whether each has that length; others are zeros)."""
    right = np.asarray(column.value_lengths()) == width
    out = np.zeros((len(column), width))
    out[right] = np.asarray(column.filter(pa.array(right)).flatten()).reshape(-1, width)
    return out, right


def asked_of(questions: DataFrame, blocks: int) -> DataFrame:
    """(question, q, block): the questions (question, q) in that many blocks."""
    return questions.select("question", F.transform("q", lambda x: x.cast("double")).alias("q"), F.pmod(F.xxhash64("question"), F.lit(blocks)).cast("int").alias("block"))


def best_of(found: DataFrame, k: int, key: str) -> DataFrame:
    """(question, key, score): of the best of each part the ``k`` best of each question."""
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), key))
    return found.select("question", key, F.round("score", 6).alias("score")).withColumn("place", place).filter(F.col("place") <= k).drop("place")


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def compared(asked: pa.Table, rows: pa.Table, k: int, key: str, arrow: pa.Schema) -> pa.Table:
    """(question, key, score): the ``k`` of the rows (key, embedding, cell) nearest to each question (question, q, cells) by cosine; of the rows in its cells, unless these are null."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if asked.num_rows and rows.num_rows:
        rows = rows.take(pc.sort_indices(rows, [(key, "ascending")]))
        vectors, wanted, cells = rows.column("embedding").combine_chunks(), asked.column("q").combine_chunks(), asked.column("cells").to_pylist()
        cell, lengths = rows.column("cell").to_numpy(), np.asarray(wanted.value_lengths())
        for width in np.unique(lengths).tolist():
            x, mine = unit(matrix(vectors, width)[0]), np.flatnonzero(lengths == width)
            q = unit(matrix(wanted, width)[0][mine])
            for low in range(0, len(mine), BLOCK):
                similar = q[low : low + BLOCK] @ x.T
                for i, of in enumerate(mine[low : low + BLOCK].tolist()):
                    if cells[of] is not None:
                        read = np.zeros(cell.max() + 1, bool)
                        read[[c for c in cells[of] if c < len(read)]] = True
                        similar[i, ~read[cell]] = -np.inf
                # what rounding to six places may bring among the k best
                least = np.partition(similar, -k, axis=1)[:, -k] - 1e-6 if similar.shape[1] > k else np.full(len(similar), -np.inf)
                near = (similar >= least[:, None]) & (similar > -np.inf)
                for i, of in enumerate(mine[low : low + BLOCK].tolist()):
                    at = np.flatnonzero(near[i])
                    score = np.round(similar[i, at], 6)
                    first = np.lexsort((at, -score))[:k]
                    parts.append((np.full(len(first), of), at[first], score[first]))
    of, at, score = (np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
    return pa.table([asked.column("question").take(pa.array(of, pa.int64())), rows.column(key).take(pa.array(at, pa.int64())), pa.array(score, pa.float64())], names=arrow.names).cast(arrow)


class VectorIndex:
    """An inverted file in one folder; rows are (key, columns, embedding), told by their keys. ``columns`` (name -> type) may be filtered by; ``tenant`` is counted by cell."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", key_type: str = "long", columns: dict[str, str] | None = None, keys: Sequence[str] = ()):
        self.spark, self.folder, self.key, self.columns = spark, folder.rstrip("/"), key, dict(columns or {})
        names = ", ".join(f"`{n}` {t}" for n, t in {key: key_type, **self.columns}.items())
        by = ["grp", "cell", *(c for c in ("tenant",) if c in self.columns)]
        self.kept = SegmentStore(spark, f"{self.folder}/cells", list(keys) or [key], {"vectors": f"{names}, embedding array<double>, grp int, cell int"}, {"vectors": ["grp", "cell"]}, {"counts": ("vectors", by)})
        self._groups: np.ndarray | None = None

    @classmethod
    def create(cls, vecs: DataFrame, folder: str, key: str = "doc_id", columns: Sequence[str] = (), keys: Sequence[str] = (), cells: int | None = None, **more) -> VectorIndex:
        """A new index of ``vecs``."""
        types = dict(vecs.dtypes)
        index = cls(vecs.sparkSession, folder, key, types[key], {c: types[c] for c in columns}, keys)
        index._fit(usable(vecs, key), cells)
        index.add(vecs, **more)
        return index

    def _fit(self, rows: DataFrame, cells: int | None) -> None:
        """Centroids of groups from a sample on the driver, then of each group's cells in a task of its own."""
        n = rows.count()
        cells = min(CELLS_MOST, max(1, round(n**0.5))) if cells is None else cells
        first = rows.orderBy(F.xxhash64(self.key), self.key).limit(quantise.SAMPLE).select("embedding").collect()
        groups = spherical(np.array([r[0] for r in first], float), max(1, round(cells**0.5)))
        self.spark.createDataFrame([(g, c.tolist()) for g, c in enumerate(groups)], "grp int, centroid array<double>").coalesce(1).write.parquet(f"{self.folder}/groups")
        sent, width = self.spark.sparkContext.broadcast(groups), groups.shape[1]

        def group(batches):
            for batch in batches:
                x, right = matrix(batch.column("embedding"), width)
                of = (x @ sent.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(of[right], pa.int32()), batch.column("embedding").filter(pa.array(right))], names=["grp", "embedding"])

        # about PER_CELL vectors for each cell, by a hash of the key
        share = min(1.0, PER_CELL * cells / max(1, n))
        some = rows.filter(F.pmod(F.xxhash64(self.key), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        per_group = max(1, -(-cells // len(groups)))

        def cells_of(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.array(pdf["embedding"].tolist(), float)
            found = spherical(x, max(1, min(per_group, len(x))))
            return pd.DataFrame({"grp": np.full(len(found), pdf["grp"].iloc[0]), "cell": np.arange(len(found)), "centroid": list(found)})

        grouped = some.select("embedding").mapInArrow(group, "grp int, embedding array<double>")
        made = grouped.groupBy("grp").applyInPandas(cells_of, "grp int, cell int, centroid array<double>")
        made.repartitionByRange("grp").sortWithinPartitions("grp", "cell").write.parquet(f"{self.folder}/centroids")

    def exists(self) -> bool:
        return store.exists(self.spark, f"{self.folder}/centroids/_SUCCESS")

    def groups(self) -> np.ndarray:
        if self._groups is None:
            self._groups = np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.folder}/groups").orderBy("grp").collect()])
        return self._groups

    def centroids(self, groups: Sequence[int] | None = None) -> list[tuple[int, int, list[float]]]:
        """(grp, cell, centroid) of some groups, or of all."""
        rows = self.spark.read.parquet(f"{self.folder}/centroids")
        if groups is not None:
            rows = rows.filter(F.col("grp").isin(*groups))
        return [tuple(r) for r in rows.select("grp", "cell", "centroid").orderBy("grp", "cell").collect()]

    # --- changes

    def add(self, vecs: DataFrame, gone: DataFrame | None = None, **more) -> None:
        """Add vectors, in the place of those of the same keys, and take away those of the keys in ``gone``; empty vectors, zeros, and those of another length are left out."""
        book: dict[int, tuple[list[int], list[list[float]]]] = {}
        for g, c, x in self.centroids():
            cells, centres = book.setdefault(g, ([], []))
            cells.append(c)
            centres.append(x)
        known = np.array([g for g in sorted(book)], np.int32)  # a group that no vector of the sample was in has no cells
        model = known, self.groups()[known], {g: (np.array(c, np.int32), np.array(x)) for g, (c, x) in book.items()}
        sent, width, names = self.spark.sparkContext.broadcast(model), model[1].shape[1], [self.key, *self.columns]

        def place(batches):
            known, groups, cells = sent.value
            for batch in batches:
                x, right = matrix(batch.column("embedding"), width)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                grp = known[(x @ groups.T).argmax(axis=1)]
                cell = np.zeros(len(x), np.int32)
                for g in np.unique(grp).tolist():
                    at = grp == g
                    cell[at] = cells[g][0][(x[at] @ cells[g][1].T).argmax(axis=1)]
                keep = pa.array(right)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*batch.columns, pa.array(grp), pa.array(cell))], names=[*names, "embedding", "grp", "cell"])

        placed = usable(vecs, *names).mapInArrow(place, self.kept.tables["vectors"])
        self.kept.put({"vectors": placed}, gone, **more)

    def remove(self, keys: DataFrame, **more) -> None:
        self.kept.put({}, keys.select(self.kept.keys), **more)

    def clear(self, **more) -> None:
        self.kept.clear(**more)

    # --- questions

    def vectors(self) -> DataFrame:
        """(key, columns, embedding) of all that is in the index."""
        return self.kept.table("vectors").drop("grp", "cell")

    def count(self) -> int:
        return self.vectors().count()

    def nearest_cells(self, q: Sequence[float], need: float, tenant: str | None = None) -> tuple[list[tuple[int, int]], bool]:
        """The cells nearest to a vector that hold ``need`` live vectors (of one tenant, if it is given) or more; and whether these are all cells that hold any."""
        counted = self.kept.counted("counts")
        if tenant is not None and "tenant" in self.columns:
            counted = counted.filter(F.col("tenant") == tenant)
        held = {(r["grp"], r["cell"]): r["n"] for r in counted.groupBy("grp", "cell").agg(F.sum("n").alias("n")).collect()}  # a row for each cell
        q = np.asarray(q, float)
        by_group: dict[int, int] = {}
        for (g, _), n in held.items():
            by_group[g] = by_group.get(g, 0) + n
        near, total = [], 0
        similar = self.groups() @ q if len(q) == self.groups().shape[1] else np.zeros(len(self.groups()))
        for g in np.argsort(-similar, kind="stable").tolist():
            if by_group.get(g) and total < 2 * need:
                near.append(g)
                total += by_group[g]
        cells = [(float(np.dot(q, x)) if len(q) == len(x) else 0.0, g, c) for g, c, x in (self.centroids(near) if near else []) if (g, c) in held]
        chosen, total = [], 0
        for _, g, c in sorted(cells, key=lambda x: (-x[0], x[1:])):
            if total >= need:
                break
            chosen.append((g, c))
            total += held[g, c]
        return chosen, len(chosen) == len(held)

    def search(self, q: Sequence[float], k: int, where: Column | None = None, tenant: str | None = None, share: float = SHARE) -> DataFrame:
        """(key, score): the ``k`` nearest found by cosine, of the rows that fit ``where`` and the tenant; exact where ``share`` is 1.

        Cells are read until there are ``k`` hits, or none are left.
        """
        asked = F.array(*[F.lit(float(x)) for x in q])
        total = self.kept.counted("counts")
        if tenant is not None and "tenant" in self.columns:
            total = total.filter(F.col("tenant") == tenant)
        need = max(NEED * k, share * (total.agg(F.sum("n")).first()[0] or 0))
        while True:
            cells, all_of_them = self.nearest_cells(q, need, tenant)
            by_group: dict[int, list[int]] = {}
            for g, c in cells:
                by_group.setdefault(g, []).append(c)
            rows, mine = self.kept.table("vectors"), F.lit(False)
            for g, own in by_group.items():
                mine = mine | (F.col("grp") == g) & F.col("cell").isin(*own)
            rows = rows.filter(F.col("grp").isin(*by_group) & mine) if by_group else rows.limit(0)
            if tenant is not None and "tenant" in self.columns:
                rows = rows.filter(F.col("tenant") == tenant)
            if where is not None:
                rows = rows.filter(where)
            best = rows.select(self.key, F.round(cosine_similarity(F.col("embedding"), asked), 6).alias("score")).orderBy(F.desc("score"), self.key).limit(k)
            found = best.collect()  # k rows
            if len(found) == k or all_of_them:
                return self.spark.createDataFrame(found, best.schema)
            need *= MORE

    def search_many(self, questions: DataFrame, k: int, share: float = SHARE) -> DataFrame:
        """(question, key, score): for each of ``questions`` (question, q) what ``search`` gives for it, all in one pass.

        A task compares at most QUESTIONS questions with ROWS rows of a group of cells, in blocks. Questions that have found too few hits are asked again, with more cells.
        """
        held = {(r["grp"], r["cell"]): r["n"] for r in self.kept.counted("counts").groupBy("grp", "cell").agg(F.sum("n").alias("n")).collect()}  # a row for each cell
        total, out = sum(held.values()), []
        need, left = max(NEED * k, share * total), questions.select("question", "q")
        while True:
            folder = f"{store.shared_folder(self.spark)}/answers-{uuid.uuid4().hex}"
            self._nearest(left, k, need, held).write.parquet(folder)
            found = self.spark.read.parquet(folder)
            out.append(found)
            if need >= total:
                break
            short = left.join(found.groupBy("question").agg(F.count(F.lit(1)).alias("n")), "question", "left").filter(F.coalesce("n", F.lit(0)) < k).select("question", "q")
            if short.isEmpty():
                break
            # what they have found is found again
            out[-1] = found.join(short, "question", "left_anti")
            need, left = need * MORE, short
        return reduce(DataFrame.unionByName, out)

    def _nearest(self, questions: DataFrame, k: int, need: float, held: dict[tuple[int, int], int]) -> DataFrame:
        blocks, key, named = max(1, -(-questions.count() // QUESTIONS)), self.key, dict(questions.dtypes)["question"]
        by_group: dict[int, int] = {}
        for (g, _), n in held.items():
            by_group[g] = by_group.get(g, 0) + n
        slices = {g: -(-n // ROWS) for g, n in by_group.items()}
        known = [(g, c, x) for g, c, x in self.centroids() if (g, c) in held]
        key_type = StructType.fromDDL(self.kept.tables["vectors"])[key].dataType.simpleString()
        result, dealt = f"question {named}, `{key}` {key_type}, score double", f"question {named}, q array<double>, block int, grp int, slice int, cells array<int>"
        arrow, arrow_dealt = to_arrow_schema(StructType.fromDDL(result)), to_arrow_schema(StructType.fromDDL(dealt))
        if not known:
            return self.spark.createDataFrame([], result)
        model = self.groups(), np.array([g for g, _, _ in known]), np.array([c for _, c, _ in known]), np.array([x for _, _, x in known])
        sent = self.spark.sparkContext.broadcast((*model, np.array([held[g, c] for g, c, _ in known]), by_group, slices))

        def deal(batches):
            groups, of, cells, centres, counts, by_group, slices = sent.value
            for batch in batches:
                x, _ = matrix(batch.column("q"), groups.shape[1])
                rows: list[int] = []
                out: tuple[list, list, list] = [], [], []
                for i, (far, near) in enumerate(zip(-(x @ groups.T), x @ centres.T)):
                    taken, so_far = set(), 0
                    for g in np.argsort(far, kind="stable").tolist():
                        if g in by_group and so_far < 2 * need:
                            taken.add(g)
                            so_far += by_group[g]
                    among = np.flatnonzero(np.isin(of, list(taken)))
                    among = among[np.argsort(-near[among], kind="stable")]
                    among = among[: int(np.searchsorted(np.cumsum(counts[among]), need)) + 1]
                    for g in np.unique(of[among]).tolist():
                        own = cells[among[of[among] == g]].tolist()
                        for s in range(slices[g]):
                            rows.append(i)
                            for column, value in zip(out, (g, s, own)):
                                column.append(value)
                taken_rows = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((*taken_rows.columns, *(pa.array(c, f.type) for c, f in zip(out, list(arrow_dealt)[3:]))), arrow_dealt)], schema=arrow_dealt)

        asked = asked_of(questions, blocks).mapInArrow(deal, dealt)
        count = F.element_at(F.create_map(*[F.lit(x) for item in slices.items() for x in item]), F.col("grp"))
        rows = self.kept.table("vectors").select(key, "embedding", "grp", "cell", F.pmod(F.xxhash64(key), count).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        found = asked.groupBy("grp", "slice", "block").cogroup(rows.groupBy("grp", "slice", "block")).applyInArrow(lambda a, b: compared(a, b, k, key, arrow), result)
        return best_of(found, k, key)


def scan_many(vecs: DataFrame, questions: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(question, key, score): for each of ``questions`` (question, q) what ``scan`` gives for it; every pair is compared, in slices and blocks of bounded size."""
    rows = vecs.filter(F.size("embedding") > 0).select(key, F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), F.lit(0).alias("cell"))
    blocks, slices = max(1, -(-questions.count() // QUESTIONS)), max(1, -(-rows.count() // ROWS))
    result = f"question {dict(questions.dtypes)['question']}, `{key}` {dict(rows.dtypes)[key]}, score double"
    arrow = to_arrow_schema(StructType.fromDDL(result))
    asked = asked_of(questions, blocks).select("*", F.lit(None).cast("array<int>").alias("cells"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    rows = rows.select("*", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = asked.groupBy("slice", "block").cogroup(rows.groupBy("slice", "block")).applyInArrow(lambda a, b: compared(a, b, k, key, arrow), result)
    return best_of(found, k, key)


def scan(vecs: DataFrame, q: Sequence[float], k: int, key: str = "doc_id") -> DataFrame:
    """(key, score): the ``k`` nearest of all vectors."""
    scored = vecs.filter(F.size("embedding") > 0).select(key, F.round(cosine_similarity(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q])), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def search_or_scan(index: VectorIndex | None, vecs: DataFrame, q: Sequence[float], k: int, key: str = "doc_id", **options) -> DataFrame:
    """The index's answer; where there is no index, or it has fewer than ``k`` hits, that of a scan of all vectors."""
    if index is not None and index.exists():
        found = index.search(q, k, **options)
        if found.count() == k:  # rows that are here already
            return found
    return scan(vecs, q, k, key)


def save_codebook(codebook: DataFrame, folder: str) -> None:
    """A codebook as one file: (sub, code, centroid)."""
    codebook.select("sub", "code", "centroid").orderBy("sub", "code").coalesce(1).write.mode("errorifexists").parquet(folder)


def load_codebook(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("sub int, code int, centroid array<double>").parquet(folder)


class PqIndex:
    """Codes of vectors in one folder, and the codebook they are of."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", key_type: str = "long"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.kept = SegmentStore(spark, f"{self.folder}/codes", [key], {"codes": f"`{key}` {key_type}, codes array<int>"})

    @classmethod
    def train(cls, vecs: DataFrame, folder: str, key: str = "doc_id", **options) -> PqIndex:
        """Fit and keep a codebook; the index is empty."""
        save_codebook(quantise.train(vecs, key, **options), f"{folder.rstrip('/')}/codebook")
        return cls(vecs.sparkSession, folder, key, vecs.schema[key].dataType.simpleString())

    def codebook(self) -> DataFrame:
        return load_codebook(self.spark, f"{self.folder}/codebook")

    def subspaces(self) -> int:
        return self.codebook().agg(F.max("sub")).first()[0] + 1

    def add(self, vecs: DataFrame) -> None:
        self.kept.put({"codes": quantise.encode(vecs, self.codebook(), self.key, self.subspaces())})

    def remove(self, keys: DataFrame) -> None:
        self.kept.put({}, keys.select(self.key))

    def codes(self) -> DataFrame:
        return self.kept.table("codes")

    def count(self) -> int:
        return self.codes().count()

    def memory(self) -> dict[str, int]:
        """Bytes of codes (a byte each), codebook (32-bit floats), and what the vectors would take."""
        n, subs = self.count(), self.subspaces()
        book = self.codebook().agg(F.sum(F.size("centroid"))).first()[0]
        width = self.codebook().agg(F.max(F.size("centroid"))).first()[0]
        return {"codes": n * subs, "codebook": 4 * book, "vectors": 4 * n * subs * width}

    def search(self, q: list[float], k: int) -> DataFrame:
        """(key, distance): the ``k`` nearest by the sum of squared distances of the query's parts to the centroids."""
        asked = self.spark.createDataFrame([([float(x) for x in q],)], "q array<double>")
        table = quantise.adc_table(asked, self.codebook(), self.subspaces())
        scored = self.codes().crossJoin(F.broadcast(table)).select(self.key, F.round(quantise.adc_distance(F.col("codes"), F.col("lookup")), 6).alias("distance"))
        return scored.orderBy("distance", self.key).limit(k)
