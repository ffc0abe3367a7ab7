"""A kept inverted index that takes changes: postings by term, in segments that are never changed.

A segment's tables: ``postings`` (bucket, term, level, field, key, owner, tf, lens, pos), by a hash bucket of the term, sorted by term and falling level, so that a question
reads its terms' buckets, of these the row groups that may hold the terms, and of a common word's postings only the levels that matter; ``blocks``
(bucket, term, field, level, df, cf, most_tf, least_len): what a level holds at most; ``forward`` (part, owner, key, tokens): what a document's postings are, sorted by a
hash of its owner. The numbers of documents and of each field's terms stand in the log.

A change is a segment with the new documents' tables, the owners whose older documents are dead (``gone``), and ``corrections``: what the dead ones had added to the
statistics of the segment they are in. So statistics are sums of small tables, and a question leaves out the dead by a join with ``gone``. Nothing else is
read: a change costs its own documents, and their postings' terms. Segments of like size are merged (``segments.Log``).

``level`` tells how much of the greatest part a term can add a posting may give (in LEVELS steps, by the average length at the time it is written). ``top`` uses it: it
scores a few postings of the highest levels, takes the k-th score as a threshold, and then scores only documents with a posting of a level at which the threshold can
still be reached; bounds come from ``most_tf`` and ``least_len``, so they hold whatever the average is now.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larkspur.functions.text import tokens
from larkspur.operators import fulltext, store
from larkspur.operators.segments import Log, Span

#: Hash buckets of terms, a folder each, of a segment with at least so many documents (a smaller one has one); parts of owners, no folders.
BUCKETS, BUCKETS_FROM, PARTS = 32, 50_000, 1024
LEVELS = 16
#: Documents of a segment below which each of its tables is one file, and terms of texts for each file of a larger one's postings.
FEW, PER_FILE = 1000, 1_000_000
#: Terms of texts whose postings are made at once.
AT_ONCE = 500_000
#: Changes with the layout of the tables, so that an index of another layout is another one.
FORMAT = 3
#: Documents from which on ``top`` skips: below, one pass over the postings is faster than two jobs more.
SKIP_FROM = 200_000
#: Postings of the highest levels that the threshold comes from, for each hit asked for; candidates that are joined by broadcast at most.
FIRST, BROADCAST = 20, 50_000


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    """The same on the driver."""
    return zlib.crc32(term.encode()) % buckets


def part_of(owner: Column) -> Column:
    return F.pmod(F.crc32(owner.cast("string").cast("binary")), F.lit(PARTS)).cast("int")


def placed(batches: Iterator[pa.RecordBatch], names: list[str], fields: tuple[str, ...], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The postings of each document (names, a list of terms for each field) by itself; AT_ONCE terms, or one document, at once."""
    for whole in batches:
        sizes = sum(np.asarray(whole.column(f"t_{f}").value_lengths()).astype(np.int64) for f in fields)
        ends, start = np.cumsum(sizes), 0
        while start < whole.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
            batch, start = whole.slice(start, stop - start), stop
            lengths = {f: np.asarray(batch.column(f"t_{f}").value_lengths()).astype(np.int64) for f in fields}
            lens = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(fields), np.stack(list(lengths.values()), axis=1).astype(np.int32).ravel())
            for f, own in lengths.items():
                coded = batch.column(f"t_{f}").flatten().dictionary_encode()
                terms, row = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(own)), own)
                if not len(terms):
                    continue
                pos = np.arange(len(terms)) - np.repeat(np.cumsum(own) - own, own)
                of = row * len(coded.dictionary) + terms
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.diff(of[order], prepend=-1))
                at, offsets = pa.array(row[order[first]]), np.append(first, len(order))
                columns = [coded.dictionary.take(pa.array(terms[order[first]])), pa.array([f]).take(pa.array(np.zeros(len(first), np.int64))), *[batch.column(n).take(at) for n in names]]
                columns += [pa.array(np.diff(offsets)), lens.take(at), pa.ListArray.from_arrays(offsets.astype(np.int32), pos[order].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([c.cast(x.type) for c, x in zip(columns, arrow)], schema=arrow)


class TextIndex:
    """The index in one folder. A document has a key, and an owner by which changes replace it (its key, unless another column is named)."""

    def __init__(self, spark: SparkSession, folder: str, fields: tuple[str, ...], key: str = "doc_id", key_type: str = "long", owner_type: str | None = None, spans: list[Span] | None = None):
        self.spark, self.folder, self.fields, self.key = spark, folder.rstrip("/"), tuple(fields), key
        self.key_type, self.owner_type = key_type, owner_type or key_type
        self.log = Log(spark, folder)
        self._spans = spans

    @classmethod
    def build(cls, docs: DataFrame, folder: str, fields: dict[str, str], key: str = "doc_id", owner: str | None = None, state: int = 0) -> TextIndex:
        """Write the index of the named fields (field -> column) of ``docs`` as the first change of a new folder."""
        types = dict(docs.dtypes)
        index = cls(docs.sparkSession, folder, tuple(fields), key, types[key], types[owner or key])
        index.change(docs, None, fields, owner, state)
        return index

    @classmethod
    def kept(cls, spark: SparkSession, folder: str, docs: Callable[[], DataFrame], fields: dict[str, str], key: str = "doc_id", key_type: str = "long") -> TextIndex:
        """The build that the folder's marker names; where there is none yet, one is built from ``docs()``. Readers see whole builds, and of two builders one wins."""
        marker = f"{folder.rstrip('/')}/CURRENT"
        current = store.read_text(spark, marker)
        if current is None:
            own = f"build-{uuid.uuid4().hex}"
            cls.build(docs(), f"{folder.rstrip('/')}/{own}", fields, key)
            current = own if store.create_once(spark, marker, own) else store.read_text(spark, marker)
        return cls(spark, f"{folder.rstrip('/')}/{current}", tuple(fields), key, key_type).as_it_is()

    # --- segments

    def spans(self) -> list[Span]:
        """The living segments; those that were given, or the folder's."""
        return self.log.live() if self._spans is None else self._spans

    def as_it_is(self) -> TextIndex:
        """The index as of now, whatever changes come: a question's parts see the same documents."""
        return TextIndex(self.spark, self.folder, self.fields, self.key, self.key_type, self.owner_type, self.log.live())

    def state(self) -> int:
        """The number that the last change was given, -1 if there is none."""
        return max((e["state"] for e in self.log.entries().values() if "state" in e), default=-1)

    def size(self) -> int:
        """Documents, dead ones not counted out."""
        return sum(s.entry["totals"][0] for s in self.spans())

    def _schema(self, name: str) -> str:
        key, owner = f"key {self.key_type}", f"owner {self.owner_type}"
        return {
            "postings": f"term string, level int, field string, {key}, {owner}, tf long, lens array<int>, pos array<int>, segment long, bucket int",
            "blocks": "term string, field string, level int, df long, cf long, most_tf long, least_len int, segment long, bucket int",
            "forward": f"part int, {owner}, {key}, {', '.join(f'`t_{f}` array<string>' for f in self.fields)}, segment long",
            "gone": f"{owner}, segment long",
            "corrections": "term string, field string, df long, cf long, dead_in int, segment long, bucket int",
        }[name]

    def _tables(self, name: str, spans: list[Span] | None = None, terms: list[str] | None = None) -> DataFrame:
        """A table of all segments that have it, with their numbers (``at``); of the rows of some terms only, if any are given.

        The filter on the buckets prunes folders, the one on the terms goes to the scan.
        """
        spans = [s for s in (self.spans() if spans is None else spans) if name in s.entry["tables"]]
        at, found = F.lit(None).cast("int"), []
        for s in spans:
            at = F.when(F.col("segment") == s.entry["segment"], s.high).otherwise(at)
        small = [s for s in spans if s.entry["buckets"] == 1]  # without folders of buckets, so one scan reads them all
        for some in ([small] if small else []) + [[s] for s in spans if s.entry["buckets"] > 1]:
            rows, buckets = self.spark.read.schema(self._schema(name)).parquet(*[f"{self.folder}/{s.folder}/{name}" for s in some]), some[0].entry["buckets"]
            if terms is not None:
                rows = rows.filter(F.col("bucket").isin(*sorted({bucket_of(t, buckets) for t in terms})) & F.col("term").isin(*terms))
            found.append(rows.withColumn("at", at).drop("segment"))
        if not found or terms == []:
            return self.spark.createDataFrame([], self._schema(name).replace(", segment long", "") + ", at int")
        return reduce(DataFrame.unionByName, found)

    def _living(self, rows: DataFrame, spans: list[Span]) -> DataFrame:
        """Rows (owner, at, ...) whose owner no later segment of ``spans`` has taken away."""
        if not any("gone" in s.entry["tables"] for s in spans[1:]):
            return rows
        gone = self._tables("gone", spans[1:]).groupBy("owner").agg(F.max("at").alias("last")).withColumnRenamed("owner", "gone")
        return rows.join(gone, F.col("owner").eqNullSafe(F.col("gone")) & (F.col("last") > F.col("at")), "left_anti")

    def change(self, docs: DataFrame | None, gone: DataFrame | None, fields: dict[str, str], owner: str | None = None, state: int = 0) -> None:
        """Bring in documents in the place of all older ones of their owners, and take away those of the owners in ``gone`` (a column of them).

        ``state``: a number that the caller knows the change by.
        """
        spans, made = self.log.live(), _Segment(self)
        touched = [] if gone is None else [gone.select(F.col(gone.columns[0]).cast(self.owner_type).alias("owner"))]
        if docs is not None:
            texts = [F.coalesce(F.col(c), F.lit("")).alias(f"t_{f}") for f, c in fields.items()]
            mine = F.col(owner or self.key)
            # texts are dealt as they are and cut once; all else is made from the forward table
            made.forward(docs.select(part_of(mine).alias("part"), mine.alias("owner"), F.col(self.key).alias("key"), *texts), [tokens(F.col(f"t_{f}")).alias(f"t_{f}") for f in fields])
            made.postings(self._postings_of(made.read("forward"), made.means()))
            touched.append(made.read("forward").select("owner"))
        if spans and touched:
            made.write("gone", reduce(DataFrame.unionByName, touched).distinct())
            taken = made.read("gone").withColumnRenamed("owner", "taken").drop("segment")
            # the owners' parts are few numbers, by which the scan skips what is sorted elsewhere
            parts = [r[0] for r in taken.select(part_of(F.col("taken"))).distinct().collect()]
            older = self._living(self._tables("forward", spans).filter(F.col("part").isin(*parts)), spans)
            dead = older.join(taken, F.col("owner").eqNullSafe(F.col("taken")), "left_semi")
            made.lost = {r["at"]: [r[c] for c in self._totals()] for r in dead.groupBy("at").agg(*self._counts()).collect()}
            if made.lost:
                by_term = self._postings_of(dead, {}).groupBy("at", "term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
                made.by_bucket("corrections", by_term.withColumnRenamed("at", "dead_in"))
        made.commit("put", state=state)
        if run := self.log.due():
            self.merge(run)

    def clear(self, state: int = 0) -> None:
        """Take away all documents."""
        self.log.commit({"kind": "span", "low": 0, "high": self.log.version(), "folder": None, "state": state})

    def merge(self, run: list[Span]) -> None:
        """Write neighbouring segments as one: the living documents' tables, and what they take away from older ones."""
        first, made = run[0].low, _Segment(self)
        made.forward(self._living(self._tables("forward", run), run).drop("at"))
        made.postings(self._living(self._tables("postings", run), run).drop("at", "bucket"))
        if any(s.high < first for s in self.log.live()):
            made.write("gone", self._tables("gone", run).select("owner").distinct())
            for s in run:
                for dead_in, counts in s.entry["lost"].items():
                    if int(dead_in) < first:
                        made.lost[int(dead_in)] = [a + b for a, b in zip(made.lost.get(int(dead_in), [0] * len(counts)), counts)]
            if made.lost:
                older = self._tables("corrections", run).filter(F.col("dead_in") < first)
                made.by_bucket("corrections", older.groupBy("dead_in", "term", "field").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
        made.commit("span", low=first, high=run[-1].high)
        self.log.vacuum()

    def _totals(self) -> list[str]:
        return ["n", *[f"len_{f}" for f in self.fields]]

    def _counts(self) -> list[Column]:
        return [F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.size(f"t_{f}")), F.lit(0)).cast("long").alias(f"len_{f}") for f in self.fields]]

    def _own_length(self) -> Column:
        """Of the posting's field."""
        return F.element_at("lens", F.array_position(F.array(*[F.lit(f) for f in self.fields]), F.col("field")).cast("int"))

    def _postings_of(self, forward: DataFrame, means: dict[str, float]) -> DataFrame:
        """(term, field, key, owner, tf, lens, pos, level, and ``at`` where it is known) of documents; ``means``: the fields' average lengths."""
        names = ["key", "owner", *(["at"] if "at" in forward.columns else [])]
        types = {"key": self.key_type, "owner": self.owner_type, "at": "int"}
        schema = f"term string, field string, {', '.join(f'{n} {types[n]}' for n in names)}, tf long, lens array<int>, pos array<int>"
        arrow, fields = to_arrow_schema(StructType.fromDDL(schema)), self.fields
        posts = forward.select(*names, *[f"t_{f}" for f in fields]).mapInArrow(lambda batches: placed(batches, names, fields, arrow), schema)
        # several documents of one key count as one
        if not forward.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            posts = posts.groupBy("term", "field", *names).agg(F.sum("tf").alias("tf"), F.first("lens").alias("lens"), F.sort_array(F.flatten(F.collect_list("pos"))).alias("pos"))
        mean = F.lit(1.0)
        for f, x in means.items():
            mean = F.when(F.col("field") == f, F.lit(max(x, 1e-9))).otherwise(mean)
        share = fulltext.saturated(F.col("tf"), self._own_length(), mean) / (fulltext.K1 + 1)
        return posts.withColumn("level", F.least(F.floor(share * LEVELS), F.lit(LEVELS - 1)).cast("int"))

    # --- what questions read

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, level, field, key, owner, tf, lens, pos) of the terms in living documents."""
        return self._living(self._tables("postings", terms=terms), self.spans()).drop("bucket", "at")

    def prefixed(self, prefix: str) -> DataFrame:
        """The postings of all terms with that beginning; the scan skips what is sorted elsewhere."""
        return self._living(self._tables("postings").filter(F.col("term").startswith(prefix)), self.spans()).drop("bucket", "at")

    def totals(self) -> dict[str, int]:
        """n, and len_ of each field, of living documents: sums of what stands in the log."""
        out = [0] * (1 + len(self.fields))
        for s in self.spans():
            out = [a + b for a, b in zip(out, s.entry["totals"])]
            for lost in s.entry["lost"].values():
                out = [a - b for a, b in zip(out, lost)]
        return dict(zip(self._totals(), out))

    def statistics(self, terms: list[str] | None = None) -> DataFrame:
        """(term, field, df, cf) of some terms, or of all, in living documents."""
        rows = self._tables("blocks", terms=terms).select("term", "field", "df", "cf")
        if any("corrections" in s.entry["tables"] for s in self.spans()):
            rows = rows.unionByName(self._tables("corrections", terms=terms).select("term", "field", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
        return rows.groupBy("term", "field").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def terms(self) -> DataFrame:
        """(term, field, df, cf) of the whole vocabulary."""
        return self.statistics()

    # --- scores

    def bm25(self, terms: list[str], weights: dict[str, float] | None = None, keys: DataFrame | None = None) -> DataFrame:
        """(key, score, n_terms) of the documents with any of the terms, as ``fulltext.bm25_fields`` gives them from the texts; of the ``keys`` (key) only, if any are given."""
        weights = weights or {self.fields[0]: 1.0}
        places = {name: self.fields.index(name) for name in weights}
        length = reduce(lambda a, b: a + b, [F.col("lens")[i] for i in places.values()])
        weight = reduce(lambda w, item: w.when(F.col("field") == item[0], F.lit(float(item[1]))), weights.items(), F)
        posts = self.postings(terms).filter(F.col("field").isin(*weights)).select("term", "key", length.alias("dl"), (F.col("tf") * weight).alias("f"))
        if len(weights) == 1:
            counted = self.statistics(terms).filter(F.col("field").isin(*weights)).select("term", "df")
        else:
            posts = posts.groupBy("term", "key").agg(F.first("dl").alias("dl"), F.sum("f").alias("f"))
            counted = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if keys is not None:
            posts = posts.join(keys, "key", "left_semi")
        whole = self.totals()
        n, mean = F.lit(whole["n"]), F.lit(sum(whole[f"len_{name}"] for name in weights) / max(1, whole["n"]))
        # one row for each of the question's terms
        facts = posts.join(F.broadcast(counted), "term")
        part = fulltext.idf(n, F.col("df")) * fulltext.saturated(F.col("f"), F.col("dl"), mean)
        # summed in the order of the terms, whatever the order of the rows
        places_of = F.lit(0)
        for i, t in enumerate(terms):
            places_of = F.when(F.col("term") == t, i).otherwise(places_of)
        parts = facts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(places_of.alias("i"), part.alias("x")))).alias("parts"))
        return parts.select(F.col("key").alias(self.key), F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["x"]).alias("score"), F.size("parts").cast("long").alias("n_terms"))

    def top(self, terms: list[str], k: int, found: DataFrame | None = None, skip: bool | None = None) -> DataFrame:
        """(key, score): the ``k`` best by the first field's BM25, of those ``found`` if that is given; the rows of ``fulltext.top`` over ``bm25``.

        ``skip``: whether to leave out postings that cannot matter; by default where the index is large.
        """
        among = (lambda df: df) if found is None else (lambda df: df.join(found.select(self.key), self.key, "left_semi"))
        if (self.size() >= SKIP_FROM) if skip is None else skip:
            keys = self.candidates(terms, k, among)
            if keys is not None:
                return fulltext.top(among(self.bm25(terms, keys=keys)).select(self.key, "score"), k, self.key)
        return fulltext.top(among(self.bm25(terms)).select(self.key, "score"), k, self.key)

    def candidates(self, terms: list[str], k: int, among: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame | None:
        """(key): documents that hold all of the ``k`` best; None if they cannot be told from the others.

        By levels: LEVELS rows a term come to the driver.
        """
        field = self.fields[0]
        rows = self._tables("blocks", terms=terms).filter(F.col("field") == field).groupBy("term", "level").agg(F.sum("df").alias("df"), F.max("most_tf").alias("tf"), F.min("least_len").alias("len")).collect()
        counted = {r["term"]: r["df"] for r in self.statistics(terms).filter(F.col("field") == field).collect()}
        totals = self.totals()
        if not rows or not totals["n"]:
            return None
        mean = totals[f"len_{field}"] / totals["n"]
        most = {(r["term"], r["level"]): fulltext.idf_of(totals["n"], counted[r["term"]]) * fulltext.saturated(r["tf"], r["len"], mean) for r in rows if r["term"] in counted}
        held = {(r["term"], r["level"]): r["df"] for r in rows}
        known = [t for t in terms if t in counted]
        levels = {t: sorted({level for u, level in most if u == t}, reverse=True) for t in known}
        # the first postings, by what they can add
        seen, cut = 0, {}
        for t, level in sorted(most, key=lambda x: (-most[x], x)):
            if seen >= FIRST * k:
                break
            seen += held[t, level]
            cut[t] = min(level, cut.get(t, level))
        first = self._at_levels({t: cut[t] for t in known if t in cut}, field)
        least = fulltext.top(among(self.bm25(terms, keys=first)).select(self.key, "score"), k, self.key).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
        if least["n"] < k:
            return None
        # rounding to six places may lift a score by half of the last
        threshold = least["least"] - 1e-6
        best, cost = None, None
        for choice in itertools.islice(itertools.product(*[[None, *levels[t]] for t in known]), 100_000):
            # below its level (all of them, if that is None) a term adds this much at most
            rest = sum(max((most[t, x] for x in levels[t] if c is None or x < c), default=0.0) for t, c in zip(known, choice))
            rows_read = sum(held[t, x] for t, c in zip(known, choice) if c is not None for x in levels[t] if x >= c)
            if rest < threshold and (cost is None or rows_read < cost):
                best, cost = choice, rows_read
        if best is None:
            return None
        keys = self._at_levels({t: c for t, c in zip(known, best) if c is not None}, field)
        return F.broadcast(keys) if cost <= BROADCAST else keys

    def _at_levels(self, cut: dict[str, int], field: str) -> DataFrame:
        """(key) of the documents with a posting of one of the terms at its level or above."""
        chosen = reduce(lambda a, b: a | b, [(F.col("term") == t) & (F.col("level") >= level) for t, level in cut.items()], F.lit(False))
        # the least of the levels goes to the scan beside the terms
        rows = self.postings(list(cut)).filter((F.col("level") >= min(cut.values(), default=0)) & (F.col("field") == field) & chosen)
        return rows.select("key").distinct()

    # --- matches

    def match(self, q: str, fields: tuple[str, ...] = ()) -> DataFrame:
        """(key) of the documents that a query matches in the given fields (all, if none is given); only the query's terms are read."""
        tree = fulltext.parse(q)
        words, prefixes = fulltext.leaves(tree)
        found = self.postings(sorted(words)).select("key", F.struct("field", "term", "pos").alias("hit"))
        for p in sorted(prefixes):
            starts = self.prefixed(p).select("key", "field").distinct()
            found = found.unionByName(starts.select("key", F.struct("field", F.lit(p + "*").alias("term"), F.array().cast("array<int>").alias("pos")).alias("hit")))
        # at most (words and prefixes) x (fields) entries for each document
        by_doc = found.groupBy("key").agg(F.collect_list("hit").alias("hits"))
        return by_doc.filter(self._condition(tree, fields or self.fields)).select(F.col("key").alias(self.key))

    def _places(self, name: str, word: str) -> Column:
        """Where the word stands in the field of the document; empty if nowhere."""
        mine = F.filter("hits", lambda h: (h["field"] == name) & (h["term"] == word))
        return F.coalesce(F.get(mine, F.lit(0))["pos"], F.array().cast("array<int>"))

    def _condition(self, tree, fields: tuple[str, ...]) -> Column:
        kind = tree[0]
        if kind in ("and", "or", "not"):
            left, right = (self._condition(t, fields) for t in tree[1:])
            return left & right if kind == "and" else left | right if kind == "or" else left & ~right
        if kind == "near":
            return reduce(lambda a, b: a | b, [self._near(name, tree[1], tree[2]) for name in fields])
        wanted = [tree[1]] if tree[1] else list(fields)
        if kind == "prefix":
            return F.exists("hits", lambda h: h["field"].isin(*wanted) & (h["term"] == tree[2] + "*"))
        return reduce(lambda a, b: a | b, [self._phrase(name, tree[2]) for name in wanted])

    def _phrase(self, name: str, words: list[str]) -> Column:
        others = [self._places(name, w) for w in words[1:]]
        if not others:
            return F.size(self._places(name, words[0])) > 0
        return F.exists(self._places(name, words[0]), lambda p: reduce(lambda a, b: a & b, [F.array_contains(o, p + i) for i, o in enumerate(others, 1)]))

    def _near(self, name: str, words: list[str], distance: int) -> Column:
        others = [self._places(name, w) for w in words[1:]]
        if not others:
            return F.size(self._places(name, words[0])) > 0
        return F.exists(self._places(name, words[0]), lambda p: reduce(lambda a, b: a & b, [F.exists(o, lambda x: F.abs(x - p) <= distance + 1) for o in others]))


class _Segment:
    """A segment that is being written."""

    def __init__(self, index: TextIndex):
        self.index, self.name, self.id = index, index.log.new_folder(), uuid.uuid4().int >> 66
        self.tables: list[str] = []
        self.totals, self.lost, self.buckets = [0] * (1 + len(index.fields)), {}, 1

    def write(self, name: str, rows: DataFrame, *folders: str) -> None:
        writer = rows.withColumn("segment", F.lit(self.id)).write
        (writer.partitionBy(*folders) if folders else writer).parquet(f"{self.index.folder}/{self.name}/{name}")
        self.tables.append(name)

    def read(self, name: str) -> DataFrame:
        return self.index.spark.read.schema(self.index._schema(name)).parquet(f"{self.index.folder}/{self.name}/{name}")

    def forward(self, rows: DataFrame, cut: list[Column] | None = None) -> None:
        """``cut``: what makes terms of the rows' texts, after they are dealt."""
        dealt = rows.repartitionByRange("part", "owner", "key").sortWithinPartitions("part", "owner")
        self.write("forward", dealt.select("part", "owner", "key", *cut) if cut else dealt)
        self.totals = list(self.read("forward").agg(*self.index._counts()).first())
        self.buckets = BUCKETS if self.totals[0] >= BUCKETS_FROM else 1

    def means(self) -> dict[str, float]:
        return {f: x / max(1, self.totals[0]) for f, x in zip(self.index.fields, self.totals[1:])}

    def by_bucket(self, name: str, rows: DataFrame, *order, by: str = "term") -> None:
        """Rows with a term, in its bucket, in the order of the terms; a bucket's are dealt to several files by a hash of a column."""
        places = ["bucket", "term", *order]
        dealt = rows.withColumn("bucket", bucket(F.col("term"), self.buckets))
        if self.totals[0] < FEW:
            dealt = dealt.coalesce(1)
        else:
            # no ranges, which are told from a sample, so that rows would be made twice
            files = max(1, -(-sum(self.totals[1:]) // (PER_FILE * self.buckets)))
            dealt = dealt.repartitionById(self.buckets * files, F.col("bucket") * files + F.pmod(F.xxhash64(by), F.lit(files)).cast("int"))
        self.write(name, dealt.sortWithinPartitions(*places), *(["bucket"] if self.buckets > 1 else []))

    def postings(self, rows: DataFrame) -> None:
        self.by_bucket("postings", rows, F.desc("level"), "field", "key", by="key")
        most = [F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most_tf"), F.min(self.index._own_length()).alias("least_len")]
        self.by_bucket("blocks", self.read("postings").groupBy("term", "field", "level").agg(*most))

    def commit(self, kind: str, **more) -> None:
        log = self.index.log
        lost = {str(k): v for k, v in self.lost.items()}
        log.commit({"kind": kind, "folder": self.name, "tables": self.tables, "segment": self.id, "buckets": self.buckets, "totals": self.totals, "lost": lost, "bytes": log.size(self.name)} | more)


def digest_of(spark: SparkSession, path: str, fields: dict[str, str]) -> str:
    """Of the layout, the fields, and the names, sizes and times of the files below a path: what differs in any of them has another index."""
    facts = [f"{FORMAT} {BUCKETS}", *(f"{name} {column}" for name, column in fields.items()), *store.listing(spark, path)]
    return hashlib.sha256("\n".join(facts).encode()).hexdigest()[:32]
