"""Hard negatives by inverted lists of k-means clusters with stored radii.

Every row lies in the list of its nearest centroid; a list keeps the largest distance of its rows from the centroid, so a row's score with an anchor a lies
within a.c - |a| r and a.c + |a| r (Cauchy-Schwarz). An anchor visits the lists by this upper bound, from the largest on. It skips lists that lie outside the window
of scores it looks for, and stops when a bound falls strictly below the k-th score found so far. Results are exact: bounds only leave out what cannot be among them.

The plan: centroids are fitted on a bounded sample (SAMPLE rows), and all rows are listed. Lists are dealt to slices (large lists over
several), anchors to groups that a task can hold; a task has the anchors of one group and the rows of one slice, which stream in list order, HELD rows at a time. An anchor is sent
only to slices with a list that it may visit. What it knows before is the k-th score among the sample's rows, which any task can look at. The first
round finds the positives, the second the negatives within the windows that they open. So rows travel once for each group of anchors and anchors once for
each slice; nothing is ever sent once for each pair.

Scores are inner products of whole numbers. They are found by floating-point products as long as these are exact, else by integer ones.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; rows of one id count once (the one with the
smallest label, then vector); a vector shorter than the longest counts as if zeros followed; components beyond 2**22 in size count as that; ties go to the smaller
id; anchors without another row of their label, and positives without negatives in their window (all whose score is below 0 are), give no rows; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import cut_lineage, shuffle_partitions, table

EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Rows that centroids are fitted on and first thresholds come from; clusters; rounds of fitting.
SAMPLE, CLUSTERS, ROUNDS = 4096, 256, 8
#: Rows of a list that are held and compared at once, and anchors of a group.
HELD, GROUP = 16_384, 32_768
SCALE, LARGEST = 256, 2**22
EXACT = 2**53
#: Scores that are made at once.
PAIRS = 2**21
#: Scores that no row has.
LEAST, MOST = -(2**62), 2**62


# --- vectors of whole numbers


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v array<long>) of the rows that take part, one for each id."""
    bound = float(LARGEST)
    whole = F.transform("embedding", lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-bound)), F.lit(bound))))
    good = "vec_id is not null and label is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The vectors with the next label where the id is divisible by ``every``."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T  # whole numbers all the way, many times slower


# --- the model


def centroids_of(x: np.ndarray, clusters: int) -> np.ndarray:
    """Lloyd's rounds over a sample, from rows at equal steps; an empty cluster keeps its centroid."""
    x = np.unique(x, axis=0).astype(float)
    centres = x[np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


@dataclass
class Lists:
    """What every task knows of the lists; its size is bounded by SAMPLE and CLUSTERS."""

    centres: np.ndarray
    #: largest distance of a row, and rows, by cluster
    radii: np.ndarray
    sizes: np.ndarray
    #: the sample: ids, labels and vectors
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: first slice and number of slices of each cluster's list, slices in all, groups of anchors
    first: np.ndarray | None = None
    pieces: np.ndarray | None = None
    slices: int = 1
    groups: int = 1

    def deal(self, slices: int, groups: int) -> None:
        """Lists to about ``slices`` slices of equal size: a large list over several, several small ones into one."""
        share = max(1, -(-int(self.sizes.sum()) // max(1, slices)))
        self.pieces = np.maximum(1, -(-self.sizes // share))
        self.first, at, held = np.zeros(len(self.sizes), np.int64), 0, 0
        for c, n in enumerate(self.sizes.tolist()):
            if held and held + n > share:
                at, held = at + 1, 0
            self.first[c] = at
            if self.pieces[c] > 1:
                at, held = at + int(self.pieces[c]), 0
            else:
                held += n
        self.slices, self.groups = at + (1 if held else 0) or 1, groups

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score that a row of each list can have with each anchor."""
        a = anchors.astype(float)
        middle, spread = a @ self.centres.T, np.linalg.norm(a, axis=1)[:, None] * self.radii
        # what rounding may have taken off
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
        return middle - spread - slack, middle + spread + slack


def fitted(rows: DataFrame, width: int, sample: int = SAMPLE, clusters: int = CLUSTERS) -> tuple[Lists, DataFrame]:
    """The model, and the rows with their lists (vec_id, label, v, list) in the shared folder."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    x = matrix(picked.column("v").combine_chunks(), width)
    centres = centroids_of(x, min(clusters, max(1, int(len(x) ** 0.5) * 4)))

    def listed(batches):
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("v"), width).astype(float)
                of = nearest(v, centres)
                away = np.linalg.norm(v - centres[of], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32()), pa.array(away)], names=["vec_id", "label", "v", "list", "away"])

    lists = cut_lineage(rows.mapInArrow(listed, "vec_id long, label long, v array<long>, list int, away double"))
    found = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # a row for each cluster
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in found:
        radii[r["list"]], sizes[r["list"]] = r["radius"], r["n"]
    model = Lists(centres, radii, sizes, picked.column("vec_id").to_numpy(), picked.column("label").to_numpy(), x)
    return model, lists.drop("away")


# --- searches: anchors with asked windows [low, high] of scores, each for its k best


@dataclass
class Asked:
    """Questions of a group of anchors, ``n`` for each: windows of scores, and the best rows found so far."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    #: anchors x n
    low: np.ndarray
    high: np.ndarray
    k: int
    #: whether rows of the anchor's own label are looked for, or of all others
    same: bool

    def __post_init__(self):
        #: found: question, score, id, sorted by question, then best first
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Look at rows for the anchors of those places, a bounded number of pairs at once."""
        step = max(1, PAIRS // max(1, len(ids)))
        for begin in range(0, len(at), step):
            self._take(at[begin : begin + step], ids, labels, vectors)

    def _take(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores = products(self.vectors[at], vectors)
        fit = (labels == self.labels[at][:, None]) == self.same
        fit &= ids != self.ids[at][:, None]
        n, new = self.low.shape[1], []
        for j in range(n):
            low, high = self.low[at, j][:, None], self.high[at, j][:, None]
            who, row = np.nonzero(fit & (scores >= low) & (scores <= high))
            if len(who):
                new.append((at[who] * n + j, scores[who, row], ids[row]))
        if new:
            self._merge(*(np.concatenate(x) for x in zip(*new)))

    def _merge(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        question, score, ids = (np.concatenate(x) for x in zip(self.found, (question, score, ids)))
        order = np.lexsort((ids, -score, question))
        question, score, ids = question[order], score[order], ids[order]
        begins = np.flatnonzero(np.r_[True, question[1:] != question[:-1]])
        nth = np.arange(len(question)) - np.repeat(begins, np.diff(np.r_[begins, len(question)]))
        last = nth == self.k - 1
        # the k-th score is the least that still counts; one equal to it may win by its id
        self.low.reshape(-1)[question[last]] = np.maximum(self.low.reshape(-1)[question[last]], score[last])
        best = nth < self.k
        self.found = question[best], score[best], ids[best]


def visit(asked: Asked, model: Lists, lists: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> int:
    """Look at held rows, sorted by list: each anchor at its lists by falling bound, until the bound is below what it needs. Gives the scores that were made."""
    begins = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
    ends, here = np.r_[begins[1:], len(lists)], lists[begins]
    least, most = (b[:, here] for b in model.bounds(asked.vectors))
    by_bound, made = np.argsort(-most, axis=1, kind="stable"), 0
    going = np.arange(len(asked.ids))
    for step in range(len(here)):
        which = by_bound[going, step]
        # all later lists have smaller bounds
        on = most[going, which] >= asked.low[going].min(axis=1)
        going, which = going[on], which[on]
        if not len(going):
            break
        in_window = ((most[going, which][:, None] >= asked.low[going]) & (least[going, which][:, None] <= asked.high[going])).any(axis=1)
        for c in np.unique(which[in_window]).tolist():
            at = going[in_window & (which == c)]
            made += len(at) * int(ends[c] - begins[c])
            asked.take(at, ids[begins[c] : ends[c]], labels[begins[c] : ends[c]], vectors[begins[c] : ends[c]])
    return made


ANCHOR = "vec_id long, label long, v array<long>, low array<long>, high array<long>"
DEALT = f"task int, list int, {ANCHOR}"


def search(model: Lists, lists: DataFrame, anchors: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, question int, vec_id, score): the ``k`` best rows within each window of each anchor (``anchors``: as in ANCHOR)."""
    spark = lists.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def ask(batches):
        """An anchor for each slice with a list that it may visit, with the k-th scores among the sample's rows."""
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                asked = held_anchors(part, width, k, same)
                asked.take(np.arange(len(asked.ids)), model.ids, model.labels, model.vectors)
                least, most = model.bounds(asked.vectors)
                group = np.abs(asked.ids) % model.groups
                who, task = [], []
                wanted = ((most[:, :, None] >= asked.low[:, None, :]) & (least[:, :, None] <= asked.high[:, None, :])).any(axis=2) & (model.sizes > 0)
                for i, c in enumerate(wanted):
                    slices = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(model.first[x], model.first[x] + model.pieces[x]) for x in np.flatnonzero(c))]))
                    who.append(np.full(len(slices), i))
                    task.append(group[i] * model.slices + slices)
                who = pa.array(np.concatenate(who))
                rows = [pa.array(np.concatenate(task), pa.int32()), pa.nulls(len(who), pa.int32()), *(part.column(c).take(who) for c in ("vec_id", "label", "v"))]
                rows += [_lists(asked.low, who), _lists(asked.high, who)]
                yield pa.RecordBatch.from_arrays(rows, names=["task", "list", "vec_id", "label", "v", "low", "high"])

    def look(batches):
        """One task's anchors come first, its rows behind them by list."""
        model = sent.value
        task, asked, anchors_held, rows = None, None, [], []

        def flush(rows):
            if rows and asked is not None:
                held = pa.Table.from_batches(rows).combine_chunks()
                visit(asked, model, *(held.column(c).to_numpy() for c in ("list", "vec_id", "label")), matrix(held.column("v").combine_chunks(), width))

        def result():
            if asked is not None and len(asked.found[0]):
                question, score, ids = asked.found
                n = asked.low.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[question // n]), pa.array(question % n, pa.int32()), pa.array(ids), pa.array(score)], names=["anchor_id", "question", "vec_id", "score"])

        for batch in batches:
            tasks = batch.column("task").to_numpy()
            cuts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1]]) if len(tasks) else []
            for begin, end in zip(cuts, [*cuts[1:], len(tasks)]):
                part = batch.slice(begin, end - begin)
                if tasks[begin] != task:
                    flush(rows)
                    yield from result()
                    task, asked, anchors_held, rows = tasks[begin], None, [], []
                anchor = part.column("list").null_count
                if anchor:
                    anchors_held.append(part.slice(0, anchor))
                part = part.slice(anchor)
                if part.num_rows and anchors_held:
                    if asked is None:
                        asked = held_anchors(pa.Table.from_batches(anchors_held).combine_chunks().to_batches()[0], width, k, same)
                    rows.append(part)
                    if sum(r.num_rows for r in rows) >= HELD:
                        flush(rows)
                        rows = []
        flush(rows)
        yield from result()

    dealt_rows = _dealt(model, lists)
    dealt = anchors.mapInArrow(ask, DEALT).unionByName(dealt_rows).repartitionById(model.slices * model.groups, "task").sortWithinPartitions("task", "list", "vec_id")
    found = dealt.mapInArrow(look, "anchor_id long, question int, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "question").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def held_anchors(batch: pa.RecordBatch, width: int, k: int, same: bool) -> Asked:
    low, high = (np.asarray(batch.column(c).flatten()).reshape(batch.num_rows, -1).copy() for c in ("low", "high"))
    return Asked(batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), width), low, high, k, same)


def _lists(x: np.ndarray, who: pa.Array) -> pa.Array:
    n = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n, pa.int32()), pa.array(x.reshape(-1))).take(who)


def _dealt(model: Lists, lists: DataFrame) -> DataFrame:
    """The rows, once for each group of anchors."""
    places = lists.sparkSession.createDataFrame([(c, int(model.first[c]), int(model.pieces[c])) for c in range(len(model.sizes))], "list int, first int, pieces int")
    slice_of = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces").cast("long")).cast("int")
    each = lists.join(F.broadcast(places), "list").select(slice_of.alias("slice"), "list", "vec_id", "label", "v")  # a row for each cluster
    groups = each.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(model.groups - 1))))
    none = F.lit(None).cast("array<long>")
    return groups.select((F.col("group") * model.slices + F.col("slice")).cast("int").alias("task"), "list", "vec_id", "label", "v", none.alias("low"), none.alias("high"))


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sample: int = SAMPLE, clusters: int = CLUSTERS, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding. Anchors are the rows whose id is divisible by ``every``.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors))
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    if not facts["anchors"] or not facts["width"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = facts["width"]
    model, lists = fitted(rows, width, sample, clusters)
    groups = -(-facts["anchors"] // group)
    model.deal(max(1, shuffle_partitions(spark) // groups), groups)
    anchors = lists.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "v")
    whole = anchors.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    near = cut_lineage(search(model, lists, whole, width, positives, True))
    # at most ``positives`` for each anchor; a window that nothing fits stands for a missing one
    pairs = near.filter("score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("rank", "vec_id", "score")).alias("found"))
    empty = F.struct(F.lit(MOST).alias("low"), F.lit(LEAST).alias("high"))
    nth = lambda i: F.get(F.filter("found", lambda f: f["rank"] == i), F.lit(0))["score"]
    share = lambda hundredths: F.call_function("div", hundredths, F.lit(100))  # noqa: E731  of whole numbers from 0 on
    windows = F.array(*[F.when(nth(i).isNotNull(), F.struct(share(nth(i) * low + 99).alias("low"), share(nth(i) * high).alias("high"))).otherwise(empty) for i in range(1, positives + 1)])
    asking = anchors.join(pairs, F.col("vec_id") == F.col("anchor_id")).withColumn("windows", windows)
    asking = asking.select("vec_id", "label", "v", F.transform("windows", lambda w: w["low"]).alias("low"), F.transform("windows", lambda w: w["high"]).alias("high"))
    hard = search(model, lists, asking, width, negatives, False)
    named = near.select("anchor_id", (F.col("rank") - 1).alias("question"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor_id", "question"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
