"""Filter interaction audit: what each of several filters removes, in every order that they may be applied in.

A document becomes a mask of the filters that it fails. Documents of one part (a language, say) and one mask are one cell, so all that follows works on at most
2**k cells a part, whatever the corpus. The orders are visited by adjacent transpositions (the plain changes of bell ringers): each order follows from
the one before by swapping two neighbours, and only these two steps change, by the documents that fail both filters and none of those
before them. Shapley sums accumulate along the walk: a filter's count is added up when it changes, times the orders that it stood for.

The plan: texts become masks and digests within their task and go no further; a label is joined by id; copies are counted by digest, pre-aggregated, so that a
text which a third of the rows hold is a few rows for each task; then cells, then one row of cells for each part.

Defined results: a null text is empty, and equal to an empty one; a null id is nobody's smaller id, so such rows neither fail ``E`` nor make others fail it;
rows repeated with one id count each, and a row is no copy of its own id; several labels of one id count as 1 if any is; a document without labels loses nothing;
a null part is the empty string; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import table

FILTERS = "ABCDE"
MOST_FILTERS = 8
BLANKS = r"[\x20\x09-\x0D]+"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def swaps(n: int) -> Iterator[int]:
    """Places i, such that swapping the items at i and i + 1 in turn visits all orders of ``n`` items, each once (plain changes)."""
    if n < 2:
        return
    inner, down = swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        at = next(inner, None)
        if at is None:
            return
        # the largest item is at one end, so the others' places are shifted by it or not
        yield at + 1 if down else at
        down = not down


def walk(cells: Sequence[tuple[int, int, int, int]], k: int) -> tuple[list[tuple[tuple[int, ...], list[list[int]]]], list[int]]:
    """(for each order, in the order of the visit: the filters' numbers, and for each step [kept, removed, good lost, toxic lost]; Shapley sums by filter).

    ``cells``: (mask, documents, good ones, toxic ones).
    """
    whole = sum(n for _, n, _, _ in cells)

    def having(all_of: int, none_of: int) -> list[int]:
        """Documents, good and toxic ones that fail all of the first and none of the second filters."""
        out = [0, 0, 0]
        for mask, *counts in cells:
            if mask & all_of == all_of and not mask & none_of:
                out = [a + b for a, b in zip(out, counts)]
        return out

    order, lost, before = list(range(k)), [], 0
    for f in order:
        lost.append(having(1 << f, before))
        before |= 1 << f
    shapley, since, visited = [0] * k, [0] * k, []
    changes = swaps(k)
    while True:
        kept, steps = whole, []
        for counts in lost:
            kept -= counts[0]
            steps.append([kept, *counts])
        visited.append((tuple(order), steps))
        at = next(changes, None)
        if at is None:
            break
        first, second = order[at], order[at + 1]
        for place in (at, at + 1):
            f = order[place]
            shapley[f] += lost[place][0] * (len(visited) - since[f])
            since[f] = len(visited)
        both = having(1 << first | 1 << second, sum(1 << f for f in order[:at]))
        lost[at], lost[at + 1] = [a + b for a, b in zip(lost[at + 1], both)], [a - b for a, b in zip(lost[at], both)]
        order[at], order[at + 1] = second, first
    for place, f in enumerate(order):
        shapley[f] += lost[place][0] * (len(visited) - since[f])
    return visited, shapley


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every part and order.

    ``cells``: part string, mask int (bit i: fails the i-th filter), n, good, toxic long; at most 2**k rows a part. ``filters``: a letter for each.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited, not {k}")
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def run(batches):
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                own = [(c["mask"], c["n"], c["good"], c["toxic"]) for c in own]
                visited, shapley = walk(own, k)
                fails = [sum(n for mask, n, _, _ in own if mask >> f & 1) for f in range(k)]
                only = [sum(n for mask, n, _, _ in own if mask == 1 << f) for f in range(k)]
                rows = [
                    (part, "".join(filters[f] for f in order), i, kept, removed, fails[f] - removed, only[f], good, toxic, shapley[f])
                    for order, steps in visited
                    for i, (f, (kept, removed, good, toxic)) in enumerate(zip(order, steps), 1)
                ]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)], names=["part", "filter_order", "step", *MEASURES, "shapley"])

    return by_part.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES) + ", shapley long")


def failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 100 words), B (under 80 % distinct words), C (over 10 % capitals), D (a symbol)."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 100,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10,
        text.rlike("[#$%&*|]"),
    ]


def masks(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, digest of the text). No shuffle; the texts stay where they are read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(failures(F.col("text")))), F.lit(0))
    return read.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def label_flags(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic int), a row for each id."""
    one = lambda c: F.max(F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).cast("int"))
    return labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


def cells_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of whole documents: ``E`` holds for those whose text a smaller id has."""
    # rows of one id, part and text are one row with their number
    rows = masks(documents).groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    labelled = rows.join(label_flags(labels), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # an id has one row in a group, so the rows of the group's smallest id are those of one row
    groups = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("without"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("of_first")
    )
    # a group of copies is a few rows by now, one for each part and label
    told = groups.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    original = F.col("without") + F.when(F.col("first") == F.col("least"), F.col("of_first")).otherwise(0)
    bit = 1 << FILTERS.index("E")
    each = told.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", original.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - original).alias("n")))).alias("x"))
    counted = each.select("part", "x.mask", "x.n", "good", "toxic").filter("n > 0")
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH labelled AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), read AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), failed AS (
  SELECT doc_id, part,
         [len(words) < 100,
          100 * len(list_distinct(words)) < 80 * len(words),
          100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          regexp_matches(text, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f
  FROM read
), cell AS (
  SELECT part, f, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN labelled USING (doc_id) GROUP BY part, f
), item AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS i
), filter_order AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM item a, item b, item c, item d, item e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), step AS (
  SELECT o, i AS step, o[i] AS x, o[1:i - 1] AS earlier FROM filter_order, item
), counted AS (
  SELECT part, o, step, x,
         sum(CASE WHEN NOT f[x] AND len(list_filter(earlier, lambda y: f[y])) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN f[x] AND len(list_filter(earlier, lambda y: f[y])) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN f[x] AND len(list_filter(earlier, lambda y: f[y])) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f[x] AND len(list_filter(f, lambda y: y)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN f[x] AND len(list_filter(earlier, lambda y: f[y])) = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN f[x] AND len(list_filter(earlier, lambda y: f[y])) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY part, o, step, x
)
SELECT part, array_to_string(list_transform(o, lambda y: 'ABCDE'[y]), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM counted
"""
