"""Near duplicates: Jaccard similarity of five-word shingles by a chosen-path join.

1. Texts become sets of hashed shingles; texts of one set are copies, and one of them stands for all.
2. A set is embedded as MINHASHES (place, value) tokens. In each of several independent runs a set chooses tokens by a hash that all sets
   share, each with probability 1 / (threshold * tokens); a chosen token is a path, and its sets are a bucket.
   A pair at the threshold meets in a run with probability 1 - 1/e at least; the runs repeat until the target recall.
3. Buckets of LEAF sets or fewer are compared by brute force on the embedded tokens. In a larger one all sets are compared with one
   pivot and linked to it where they are near. Sets very near to it are done (what is near to them is linked to the pivot, too); if few are not
   near, they are compared with the others in blocks; else all choose further tokens under the bucket's path, and
   so on until no bucket is large.
4. Linked sets form candidate classes. Within each class every pair of sets is compared exactly, in blocks where a class is
   large; a class's texts are shipped once to each of its blocks, and pairs are counted, never written out as rows.

Defined results: words are maximal runs of letters, digits and underscores in lower case; a text of one to four words has one shingle, all its words; null
texts and texts without words are like nothing, not even each other; repeated rows are copies; documents without id are
members of their classes, whose class_id is the smallest id there is (null where no member has one); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import U, WordCache, cut_lineage, map_chunks, mix, one_per_worker, shuffle_partitions, table
from larkspur.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
MINHASHES = 64
#: Sets that a bucket may have to be compared by brute force; sets of one side of a block of texts.
LEAF, BLOCK = 4096, 400
#: Agreement of embedded tokens (standard error 0.05) from which two sets are candidates, and from which one is done with its pivot.
CANDIDATE, DONE = 0.58, 0.92
#: Below the first level a set chooses that many times the tokens, so that a pair parts less often; above 1.25 crowds of like sets multiply.
BOOST = 1.2

_SPREAD = np.random.default_rng(20240229).integers(1, 2**63, size=(2, MINHASHES), dtype=np.uint64)
_A, _B = _SPREAD[0] | U(1), _SPREAD[1]
_word = re.compile(r"\w+").findall


def word_hashes() -> WordCache:
    return one_per_worker("near", lambda: WordCache(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    found = _word(text.lower())
    hashes = word_hashes()
    h = np.array([hashes[w] for w in found], dtype=np.uint64)
    n = min(len(h), words)
    if not n:
        return h
    total = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            total = total * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(total))


def signature(s: np.ndarray, n: int = MINHASHES) -> np.ndarray:
    """The first ``n`` minima of 32 bits; the first paths are chosen by all of them, what is kept for later are 16 bits of each."""
    low = None
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 2048):
            part = ((s[at : at + 2048, None] * _A[:n] + _B[:n]) >> U(32)).min(axis=0)
            low = part if low is None else np.minimum(low, part)
    return low.astype(np.uint32)


def runs_needed(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(math.exp(-1)))


def chosen(sig: np.ndarray, seeds: np.ndarray, boost: float, threshold: float) -> np.ndarray:
    """The paths (64 bits) that a set of tokens ``sig`` takes from each path in ``seeds``."""
    place = np.arange(MINHASHES, dtype=np.uint64) << U(32)
    picks = mix(mix(seeds)[:, None] ^ mix(place | sig.astype(np.uint64))[None, :])
    return mix(np.unique(picks[picks < U(int(2**64 * min(1.0, boost / (threshold * MINHASHES)) - 1))])).view(np.int64)


def keyed(documents: DataFrame) -> DataFrame:
    """(nameless, doc, row, text): doc is the id, or a hash of the text where there is none; row is that hash."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return documents.select(doc_id.isNull().alias("nameless"), F.coalesce(doc_id, F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))


def embed(documents: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """(nameless, doc, row, node, size, sig, paths): node is a digest of the set, null where the text has no words. No shuffle."""
    runs = runs_needed(recall)

    def make():
        seeds = np.arange(1, runs + 1, dtype=np.uint64)

        def work(rows):
            out = {"nameless": rows["nameless"], "doc": rows["doc"], "row": rows["row"], "node": [], "size": [], "sig": [], "paths": []}
            for text in rows["text"]:
                s = shingles(text, words)
                if not len(s):
                    for column, empty in (("node", None), ("size", 0), ("sig", None), ("paths", None)):
                        out[column].append(empty)
                    continue
                sig = signature(s)
                out["node"].append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63)
                out["size"].append(len(s))
                out["sig"].append(sig.astype(np.uint16).tobytes())
                out["paths"].append(chosen(sig, seeds, 1, threshold))
            return out

        return work

    return map_chunks(keyed(documents), make, "nameless boolean, doc long, row long, node long, size int, sig binary, paths array<long>")


def grouped(batches, key: str) -> Iterator[dict[str, list]]:
    """Groups of consecutive rows with an equal key, from batches of rows sorted by it."""
    held: dict[str, list] | None = None
    for batch in batches:
        rows = batch.to_pydict()
        keys, at = rows[key], 0
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            part = {k: v[at:stop] for k, v in rows.items()}
            if held is not None and held[key][0] == keys[at]:
                for k, v in part.items():
                    held[k] += v
            else:
                if held is not None:
                    yield held
                held = part
            at = stop
    if held is not None:
        yield held


def forest(n: int, pairs) -> list[int]:
    """The smallest index that each of ``n`` is joined to by ``pairs``."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def agreeing(sigs: np.ndarray, least: float) -> np.ndarray:
    """Pairs (i < j) whose tokens agree in the share ``least`` at least."""
    found = []
    for i in range(len(sigs) - 1):
        at = np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(axis=1) >= least * MINHASHES)
        if len(at):
            found.append(np.column_stack([np.full(len(at), i), at + i + 1]))
    return np.concatenate(found) if found else np.empty((0, 2), int)


def dealt(rows: DataFrame, group: str, item: str, blocks: Column) -> DataFrame:
    """The rows with (bucket, side) instead of their group, so that any two items of a group of several blocks meet in one bucket.

    A bucket is one block (side 0) or two (sides 1 and 2); an item is in as many buckets as its group has blocks.
    """
    block = F.pmod(F.xxhash64(item), F.col("__blocks"))
    spread = rows.withColumn("__blocks", blocks.cast("long")).withColumn("__block", block).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    low, high = F.least("__block", "__other"), F.greatest("__block", "__other")
    side = F.when(low == high, 0).when(F.col("__block") == low, 1).otherwise(2)
    return spread.select(F.xxhash64(F.col(group), low, high).alias("bucket"), side.alias("side"), *[c for c in rows.columns if c != group])


def _emit(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names.split())


def leaf_edges(members: DataFrame, sigs: DataFrame, parts: int) -> DataFrame:
    """Spanning edges (a, b) of the candidates within each leaf, from rows (leaf, doc) and (doc, sig)."""

    def run(batches):
        for group in grouped(batches, "leaf"):
            order = sorted(range(len(group["doc"])), key=group["doc"].__getitem__)
            docs = [group["doc"][i] for i in order]
            sigs = np.frombuffer(b"".join([group["sig"][i] for i in order]), np.uint16).reshape(-1, MINHASHES)
            roots = forest(len(docs), agreeing(sigs, CANDIDATE).tolist())
            if rows := [(docs[i], docs[r]) for i, r in enumerate(roots) if r != i]:
                yield _emit(rows, "a b")

    return members.join(sigs, "doc").select("leaf", "doc", "sig").repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(run, "a long, b long")


def against_pivots(large: DataFrame, threshold: float) -> DataFrame:
    """Rows (path, doc, pivot, like, further) from rows (path, doc, sig, pivot, pivot_sig): likeness to the pivot and further paths."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, doc, sig, pivot, pivot_sig in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(sig, np.uint16)
                like = float((own == np.frombuffer(pivot_sig, np.uint16)).mean())
                seeds = np.array([path], dtype=np.int64).view(np.uint64)
                rows.append((path, doc, pivot, like, chosen(own, seeds, BOOST, threshold).tolist() if like < DONE else []))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names="path doc pivot like further".split())

    wanted = large.select("path", "doc", "sig", "pivot", "pivot_sig")
    return wanted.mapInArrow(run, "path long, doc long, pivot long, like double, further array<long>")


def candidate_edges(nodes: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Edges (a, b) that join all sets whose similarity may reach the threshold."""
    sigs = nodes.select("doc", "sig")
    rows, edges = nodes.select(F.explode("paths").alias("path"), "doc"), None
    while True:
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        crowd = cut_lineage(rows.join(counts, "path"))
        leaves = crowd.filter(F.col("n") <= LEAF).groupBy("path").agg(F.sort_array(F.collect_set("doc")).alias("docs"))
        # runs often gather the same sets again; equal leaves are compared once
        leaves = leaves.groupBy(F.xxhash64("docs").alias("leaf"), F.xxhash64(F.lit(7), "docs").alias("check")).agg(F.first("docs").alias("docs"))
        found = leaf_edges(leaves.select("leaf", F.explode("docs").alias("doc")), sigs, parts)
        edges = found if edges is None else edges.unionByName(found)
        heavy = crowd.filter(F.col("n") > LEAF).select("path", "doc")
        if heavy.isEmpty():
            return edges
        heavy = heavy.join(sigs, "doc")
        # any member will do as the pivot; a hash picks one that is typical of a dense bucket more often than not
        by_chance = F.xxhash64("doc", "path")
        pivots = heavy.groupBy("path").agg(F.min_by("doc", by_chance).alias("pivot"), F.min_by("sig", by_chance).alias("pivot_sig"))
        seen = cut_lineage(against_pivots(heavy.join(pivots, "path"), threshold))
        edges = edges.unionByName(seen.filter((F.col("like") >= CANDIDATE) & (F.col("doc") != F.col("pivot"))).select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
        # pairs of two candidates of the pivot are joined already; what is left are pairs with a set that is no candidate of it
        apart = F.col("like") < CANDIDATE
        tally = seen.filter(F.col("like") < DONE).groupBy("path").agg(F.sum(apart.cast("long")).alias("apart"), F.sum((~apart).cast("long")).alias("beside")).filter("apart > 0")
        left = seen.filter(F.col("like") < DONE).join(tally, "path")
        # few of those: they are compared with the others in blocks
        blocks = F.greatest(F.ceil(F.col("beside") / LEAF), F.lit(1)).cast("long")
        block = F.when(apart, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), blocks)))
        few = left.filter(F.col("apart") <= LEAF).withColumn("block", F.explode(block)).select(F.xxhash64("path", "block").alias("leaf"), "doc")
        edges = edges.unionByName(leaf_edges(few, sigs, parts))
        rows = left.filter(F.col("apart") > LEAF).select(F.explode("further").alias("path"), "doc").distinct()


def exact_links(texts: DataFrame, words: int, threshold: float, parts: int) -> DataFrame:
    """Rows (doc, label, texts, docs, many) by block, from (bucket, side, doc, node, copies, many, text).

    ``label`` is the smallest doc that links within the block lead to; the counts are of linked texts and of their copies.
    """

    def run(batches):
        for group in grouped((pa.RecordBatch.from_pylist(x) for x in _with_sets(batches, words)), "bucket"):
            first = {}
            for i in sorted(range(len(group["doc"])), key=group["doc"].__getitem__):
                first.setdefault((group["side"][i], group["doc"][i], group["node"][i]), i)
            at = list(first.values())
            docs, sides = [group["doc"][i] for i in at], np.array([group["side"][i] for i in at])
            copies = np.array([group["copies"][i] for i in at])
            near = similar([np.frombuffer(group["set"][i], np.uint64) for i in at], threshold)
            if sides.any():  # a block of two sides counts the pairs across only
                near &= sides[:, None] != sides[None, :]
            pairs = np.argwhere(np.triu(near))
            roots = forest(len(docs), pairs.tolist())
            many = int(group["many"][0])
            yield _emit([(docs[i], docs[r], int(near[i].sum()), int(copies[near[i]].sum()), many) for i, r in enumerate(roots)], "doc label texts docs many")

    return texts.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, label long, texts long, docs long, many long")


def _with_sets(batches, words: int) -> Iterator[list[dict]]:
    """Rows with their sets instead of their texts; a row whose text isn't the one that was embedded goes."""
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            out = []
            for row in batch.slice(start, 64).to_pylist():
                s = shingles(row.pop("text") or "", words).tobytes()
                if xxhash.xxh3_64_intdigest(s) - 2**63 == row["node"]:
                    out.append(row | {"set": s})
            if out:
                yield out


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, by exact intersections; memory is bounded by columns done at a time."""
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, len(values), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), min(width, len(values) - low)), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    near = common.astype(np.float64) >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    return near


def classed_documents(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(nameless, doc, row, class_id, unnamed, docs, texts) of each row of ``keyed``; unnamed tells whether its class holds a document without id.

    Sets are known by their digests throughout, so neither null ids nor an id that several texts share join classes.
    """
    parts = shuffle_partitions(documents.sparkSession)
    embedded = cut_lineage(embed(documents, words, threshold, recall))
    known = embedded.filter("node is not null")
    key = F.struct("nameless", "doc")  # one of the set's texts, of the smallest id if it has any
    nodes = cut_lineage(
        known.groupBy("node")
        .agg(F.min(key).alias("k"), F.max("nameless").alias("unnamed"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("sig", "paths"), key).alias("s"))
        .select("node", "k.*", "unnamed", "copies", "s.*")
    )
    classes = components(candidate_edges(nodes.select(F.col("node").alias("doc"), "sig", "paths"), threshold, parts))
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    classed = classes.join(sizes, "label").select("node", "label", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
    classed = nodes.select("node", "nameless", "doc", "copies").join(classed, "node")
    texts = keyed(documents).drop("row")
    texts = texts.filter("not nameless").unionByName(texts.filter("nameless").groupBy("nameless", "doc").agg(F.first("text").alias("text")))
    texts = texts.join(classed, ["nameless", "doc"]).drop("nameless").withColumn("doc", F.col("node"))
    # a class of several blocks meets in every pair of its blocks, a class of one block in that
    blocks = dealt(texts.select("label", "doc", "node", "copies", (F.col("blocks") > 1).cast("int").alias("many"), "text", "blocks"), "label", "node", F.col("blocks")).drop("blocks")
    links = cut_lineage(exact_links(blocks, words, threshold, parts))
    found = links.groupBy("doc").agg(F.min("label").alias("label"), F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    spread = links.filter("many = 1")
    if not spread.isEmpty():
        joined = components(spread.select(F.col("doc").alias("a"), F.col("label").alias("b"))).select(F.col("node").alias("doc"), F.col("label").alias("whole"))
        found = found.join(joined, "doc", "left").withColumn("label", F.coalesce("whole", "label")).drop("whole")
    least = F.when(~F.col("nameless"), F.col("doc"))
    of_node = nodes.select("node", least.alias("least"), "unnamed", "copies").join(found.withColumnRenamed("doc", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_class = of_node.filter("texts > 0").groupBy("label").agg(F.min("least").alias("class_least"), F.max("unnamed").alias("class_unnamed"))
    of_node = of_node.join(of_class, "label", "left").select(
        "node", F.when(F.col("class_unnamed").isNotNull(), F.col("class_least")).otherwise(F.col("least")).alias("class_id"), F.coalesce("class_unnamed", "unnamed").alias("unnamed"), "copies", "texts", "docs"
    )
    whole = embedded.select("nameless", "doc", "row", "node").join(of_node, "node", "left")
    return whole.select(
        "nameless",
        "doc",
        "row",
        F.when(F.col("node").isNotNull(), F.col("class_id")).otherwise(least).alias("class_id"),
        F.coalesce("unnamed", F.lit(False)).alias("unnamed"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("docs"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("texts"),
    )


def near_duplicates(documents: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that links lead to), n_links (documents at the threshold or above), n_text_links (distinct sets among them)."""
    doc_id = F.when(~F.col("nameless"), F.col("doc")).alias("doc_id")
    return classed_documents(documents, words, threshold, recall).select(doc_id, "class_id", F.col("docs").alias("n_links"), F.col("texts").alias("n_text_links"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of one document of each class: that of the smallest id. Documents without id stay; a class that has one keeps no other.

    Rows are judged by their own texts: an id may lose the row of one text, which is in a class of a smaller id, and keep that of another.
    """
    gone = classed_documents(documents).filter("not nameless and (unnamed or doc <> class_id)").select("doc", "row").distinct()
    return documents.join(gone, (documents["doc_id"].cast("long") == gone["doc"]) & (F.xxhash64(documents["text"].cast("string")) == gone["row"]), "left_anti")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
