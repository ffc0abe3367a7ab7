"""A kept graph index of vectors: a layered proximity graph for each shard, built and searched by tasks, with additions and removals.

Vectors are dealt to shards by their nearest centroid (about SHARD vectors each; centroids come from a bounded sample). A shard's graph is rows: a node's key, vector, highest
layer (from a hash of its key) and, for each layer, its neighbours' keys. Neighbours are the nearest ones of which none is nearer to one chosen before it, and the
nearest one of those before the node in the order of layers, so that every node can be reached from the first. A search reads the nearest shards, by default a share of all; in each, a task goes
down the layers from the nearest of a few first nodes and looks, in the last one, at the neighbours of the best WIDTH nodes seen. An addition builds its shards anew; a removal marks nodes,
which are passed through, but are no hits, until their shard is built anew.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.operators import quantise, store
from larkspur.operators.segments import SegmentStore
from larkspur.operators.vectorindex import QUESTIONS, asked_of, best_of, matrix, spherical, usable

SHARD, SHARDS_MOST = 4096, 16_384
#: Neighbours in a layer (twice as many in the last one), nodes that a search keeps, shards that it reads.
LINKS, WIDTH, PROBES = 6, 40, 4
#: Share of the shards that a search for hits reads, if that is more, and nodes that it keeps: vectors without structure have their nearest ones in most shards.
SHARE, WIDE = 0.8, 100
#: Nodes of the highest layers of which the nearest is the first one of a search.
ENTRIES = 32
BLOCK = 512


def units(vectors: Sequence) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors], float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def chosen(similar: np.ndarray, among: np.ndarray, most: int) -> list[int]:
    """Of candidates, nearest first, those that are not nearer to one chosen before. ``among``: the candidates' similarity to each other."""
    kept: list[int] = []
    for i in range(len(similar)):
        if len(kept) == most:
            break
        if not kept or among[i, kept].max() < similar[i]:
            kept.append(i)
    return kept


def layer(x: np.ndarray, most: int) -> list[list[int]]:
    """Neighbours of each vector of a layer, the vectors in the order of their layers."""
    n, wanted = len(x), 2 * most
    links: list[list[int]] = [[] for _ in range(n)]
    for at in range(0, n, BLOCK):
        similar = x[at : at + BLOCK] @ x.T
        for i in range(at, min(n, at + BLOCK)):
            row = similar[i - at]
            row[i] = -2.0
            near = np.argpartition(-row, wanted - 1)[:wanted] if n > wanted else np.arange(n)
            near = near[np.argsort(-row[near], kind="stable")]
            near = near[near != i]
            links[i] += near[chosen(row[near], x[near] @ x[near].T, most)].tolist()
            if i:
                before = int(np.argmax(row[:i]))
                links[before].append(i)  # so that it can be reached
                links[i].append(before)
    back: list[list[int]] = [list(dict.fromkeys(own)) for own in links]
    for i, own in enumerate(links):
        for j in own:
            if len(back[j]) < 2 * most and i not in back[j]:
                back[j].append(i)
    return back


def graph(keys: Sequence, levels: np.ndarray, x: np.ndarray) -> list[list[list]]:
    """By node, by layer from the last one (0) up: the keys of its neighbours."""
    order = np.lexsort((np.arange(len(keys)), -levels))
    links: list[list[list]] = [[] for _ in keys]
    for at in range(int(levels.max()) + 1):
        nodes = order[levels[order] >= at]
        for i, own in zip(nodes.tolist(), layer(x[nodes], 2 * LINKS if at == 0 else LINKS)):
            links[i].append([keys[nodes[j]] for j in own])
    return links


class Walker:
    """The nodes of one graph, made ready for many questions."""

    def __init__(self, keys: Sequence, levels: Sequence[int], links: Sequence, x: np.ndarray):
        place = {k: i for i, k in enumerate(keys)}
        self.levels, self.x = levels, x
        self.near = [[np.array([place[k] for k in own if k in place], np.int64) for own in of_node] for of_node in links]
        # clusters far from each other are no slope to walk along, so the first nodes are several
        least = sorted(levels, reverse=True)[: ENTRIES][-1]
        high = [i for i, level in enumerate(levels) if level >= least]
        self.first = high[:: -(-len(high) // ENTRIES)]

    def walk(self, q: np.ndarray, width: int) -> tuple[list[tuple[float, int]], int]:
        """((similarity, place) of the best nodes found, best first; how many were looked at)."""
        x, levels = self.x, self.levels
        seen, looked = np.zeros(len(x), bool), np.zeros(len(x), bool)
        seen[self.first] = True
        here, at = max(zip((x[self.first] @ q).tolist(), self.first))
        for level in range(levels[at], 0, -1):
            while True:
                near = self.near[at][level] if level < len(self.near[at]) else ()
                if not len(near):
                    break
                seen[near] = True
                best = max(zip((x[near] @ q).tolist(), near.tolist()))
                if best[0] <= here:
                    break
                here, at = best
        todo, best = [(-here, at)], [(here, at)]
        looked[at] = True
        while todo:
            away, i = heapq.heappop(todo)
            if len(best) == width and -away < best[0][0]:
                break
            near = self.near[i][0]
            near = near[~looked[near]]
            if not len(near):
                continue
            looked[near] = True
            for s, j in zip((x[near] @ q).tolist(), near.tolist()):
                if len(best) < width or s > best[0][0]:
                    heapq.heappush(todo, (-s, j))
                    heapq.heappush(best, (s, j))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted(best, key=lambda b: (-b[0], b[1])), int((seen | looked).sum())


def walk(keys: Sequence, levels: Sequence[int], links: Sequence, x: np.ndarray, q: np.ndarray, width: int) -> tuple[list[tuple[float, int]], int]:
    """``Walker.walk`` for one question."""
    return Walker(keys, levels, links, x).walk(q, width)


class GraphIndex:
    """A graph index in one folder; rows are (key, embedding)."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", key_type: str = "long"):
        self.spark, self.folder, self.key, self.key_type = spark, folder.rstrip("/"), key, key_type
        schema = f"`{key}` {key_type}, shard int, level int, alive boolean, embedding array<double>, links array<array<{key_type}>>"
        self.kept = SegmentStore(spark, f"{self.folder}/nodes", [key], {"nodes": schema}, {"nodes": ["shard"]})

    @classmethod
    def create(cls, vecs: DataFrame, folder: str, key: str = "doc_id", shard: int = SHARD) -> GraphIndex:
        """A new index of ``vecs``, with about ``shard`` vectors in each graph."""
        index = cls(vecs.sparkSession, folder, key, dict(vecs.dtypes)[key])
        rows = usable(vecs, key)
        sample = rows.orderBy(F.xxhash64(key), key).limit(quantise.SAMPLE).select("embedding").collect()
        centres = spherical(np.array([r[0] for r in sample], float), min(SHARDS_MOST, max(1, -(-rows.count() // shard))))
        index.spark.createDataFrame([(s, c.tolist()) for s, c in enumerate(centres)], "shard int, centroid array<double>").coalesce(1).write.parquet(f"{index.folder}/centroids")
        index.add(vecs)
        return index

    def exists(self) -> bool:
        return store.exists(self.spark, f"{self.folder}/centroids/_SUCCESS")

    def centroids(self) -> np.ndarray:
        return np.array([r["centroid"] for r in self.spark.read.parquet(f"{self.folder}/centroids").orderBy("shard").collect()])

    def add(self, vecs: DataFrame) -> None:
        """Add vectors, in the place of those of the same keys; their shards' graphs are built anew. Empty vectors, zeros, and those of another length are left out."""
        centres = self.centroids()
        sent, width, key = self.spark.sparkContext.broadcast(centres), centres.shape[1], self.key

        def place(batches):
            for batch in batches:
                x, right = matrix(batch.column("embedding"), width)
                shard = (x @ sent.value.T).argmax(axis=1)
                keep = pa.array(right)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (*batch.columns, pa.array(shard, pa.int32()))], names=[key, "embedding", "shard"])

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
            pdf["links"] = graph(pdf[key].tolist(), pdf["level"].to_numpy(), units(pdf["embedding"]))
            return pdf.assign(alive=True)[[key, "shard", "level", "alive", "embedding", "links"]]

        new = usable(vecs, key).dropDuplicates([key]).mapInArrow(place, f"`{key}` {self.key_type}, embedding array<double>, shard int")
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # numbers of shards
        moved = self.kept.table("nodes").join(new.select(key), key, "left_semi").select("shard").distinct().collect()
        shards = sorted({*touched, *(r[0] for r in moved)})
        old = self.kept.table("nodes").filter(F.col("shard").isin(*shards) & F.col("alive")).join(new.select(key), key, "left_anti").select(key, "embedding", "shard") if shards else None
        rows = new if old is None else old.unionByName(new)
        chance = (F.pmod(F.xxhash64(F.lit(1), key), F.lit(1 << 30)) + 1) / (1 << 30)
        leveled = rows.withColumn("level", F.floor(-F.log(chance) / np.log(LINKS)).cast("int"))
        gone = self.kept.table("nodes").filter(F.col("shard").isin(*shards) & ~F.col("alive")).select(key) if shards else None
        self.kept.put({"nodes": leveled.groupBy("shard").applyInPandas(build, self.kept.tables["nodes"])}, gone)

    def remove(self, keys: DataFrame) -> None:
        """Mark nodes: they are passed through, but are no hits."""
        marked = self.kept.table("nodes").join(keys.select(self.key), self.key, "left_semi").withColumn("alive", F.lit(False))
        self.kept.put({"nodes": marked})

    def clear(self) -> None:
        self.kept.clear()

    def count(self) -> int:
        return self.kept.table("nodes").filter("alive").count()

    def _probes(self, share: float) -> int:
        return max(PROBES, math.ceil(share * len(self.centroids())))

    def search(self, q: Sequence[float], k: int, probes: int | None = None, width: int = WIDE) -> DataFrame:
        """(key, score): the ``k`` nearest found by cosine in the ``probes`` nearest shards (by default SHARE of all)."""
        probes = self._probes(SHARE) if probes is None else probes
        return self.looked_at(q, max(k, width), probes).filter("hit").select(self.key, F.round("score", 6).alias("score")).orderBy(F.desc("score"), self.key).limit(k)

    def looked_at(self, q: Sequence[float], width: int = WIDTH, probes: int = PROBES) -> DataFrame:
        """(key, score, hit, looked, nodes): the best nodes of each shard that is read, whether they are hits, and how many of the shard's nodes were looked at."""
        wanted = units([q])[0]
        near = np.argsort(-(self.centroids() @ wanted), kind="stable")[:probes].tolist()
        key = self.key

        def find(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
            links = [[list(x) for x in own] for own in pdf["links"]]
            best, looked = walk(pdf[key].tolist(), pdf["level"].tolist(), links, units(pdf["embedding"]), wanted, width)
            at = [i for _, i in best]
            return pd.DataFrame({key: pdf[key].to_numpy()[at], "score": [s for s, _ in best], "hit": pdf["alive"].to_numpy()[at], "looked": looked, "nodes": len(pdf)})

        rows = self.kept.table("nodes").filter(F.col("shard").isin(*near))
        return rows.groupBy("shard").applyInPandas(find, f"`{key}` {self.key_type}, score double, hit boolean, looked long, nodes long")

    def search_many(self, questions: DataFrame, k: int, share: float = SHARE, width: int = WIDE) -> DataFrame:
        """(question, key, score): for each of ``questions`` (question, q) the ``k`` nearest found by cosine in a ``share`` of the shards, PROBES at least.

        One pass: a task has one shard's graph and the questions, QUESTIONS at most, that read it.
        """
        centres, key = self.centroids(), self.key
        probes, blocks = self._probes(share), max(1, -(-questions.count() // QUESTIONS))
        sent = self.spark.sparkContext.broadcast(centres)

        def deal(batches):
            for batch in batches:
                x, right = matrix(batch.column("q"), sent.value.shape[1])
                near = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :probes]
                of = np.repeat(np.arange(len(x)), near.shape[1])
                keep = right[of]
                taken = batch.take(pa.array(of[keep]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near.ravel()[keep], pa.int32())], names=["question", "q", "block", "shard"])

        def find(asked: pa.Table, nodes: pa.Table) -> pa.Table:
            out: tuple[list, list, list] = [], [], []
            if asked.num_rows and nodes.num_rows:
                nodes = nodes.take(pc.sort_indices(nodes, [(key, "ascending")]))
                keys, alive = nodes.column(key).to_pylist(), nodes.column("alive").to_pylist()
                walker = Walker(keys, nodes.column("level").to_pylist(), nodes.column("links").to_pylist(), units(nodes.column("embedding").to_pylist()))
                wanted = units(asked.column("q").to_pylist())
                for name, q in zip(asked.column("question").to_pylist(), wanted):
                    hits = [(round(s, 6), keys[i]) for s, i in walker.walk(q, max(k, width))[0] if alive[i]]
                    for s, found in sorted(hits, key=lambda h: (-h[0], h[1]))[:k]:
                        out[0].append(name)
                        out[1].append(found)
                        out[2].append(s)
            return pa.table(list(out), schema=arrow)

        named = dict(questions.dtypes)["question"]
        result = f"question {named}, `{key}` {self.key_type}, score double"
        arrow = to_arrow_schema(StructType.fromDDL(result))
        asked = asked_of(questions, blocks).mapInArrow(deal, f"question {named}, q array<double>, block int, shard int")
        nodes = self.kept.table("nodes").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = asked.groupBy("shard", "block").cogroup(nodes.groupBy("shard", "block")).applyInArrow(find, result)
        return best_of(found, k, key)
