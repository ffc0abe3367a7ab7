"""Full-text search: postings, corpus statistics, a small query language, BM25.

These functions work on texts, in one pass over them. A standing corpus has a kept index (``textindex.TextIndex``), which reads the question's
terms alone and gives the same rows. Only statistics of one row (documents, average length) and of the query's own terms are broadcast.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larkspur.functions.text import MARKED, PLAIN, tokens

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
#: Terms of texts that are counted at once; keys of several rows that are told from the others by a broadcast.
AT_ONCE, REPEATED = 500_000, 50_000


def fold(s: str) -> str:
    return s.lower().translate(str.maketrans(MARKED, PLAIN))


def query_terms(q: str) -> list[str]:
    """Index terms of a query, each once, in order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", fold(q))))


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term): every term's places."""
    return docs.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "term"))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, key, tf) of each row (key, its terms) by itself; AT_ONCE terms, or one row, at once."""
    for whole in batches:
        ends, start = np.cumsum(np.asarray(whole.column(1).value_lengths()).astype(np.int64)), 0
        while start < whole.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
            keys, lists, start = whole.column(0).slice(start, stop - start), whole.column(1).slice(start, stop - start), stop
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            size = len(coded.dictionary)
            of = np.sort(np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())) * size + np.asarray(coded.indices))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            columns = [coded.dictionary.take(pa.array(of[first] % size)), keys.take(pa.array(of[first] // size)), pa.array(np.diff(first, append=len(of)))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", whole.schema.names[0], "tf"])


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf).

    A row's terms are counted where it is read, and these are the postings of a key that one row has: they are not shuffled. Rows of one key are added up;
    which keys those are is found out first, by a pass over the keys alone.
    """
    schema = StructType([StructField("term", StringType()), docs.schema[key], StructField("tf", LongType())])

    def count(rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(text).isNotNull()).select(key, tokens(F.col(text)).alias("terms")).mapInArrow(counted, schema)

    def add_up(rows: DataFrame) -> DataFrame:
        return count(rows).groupBy("term", key).agg(F.sum("tf").alias("tf"))

    again = docs.groupBy(F.col(key).alias("__again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__again")
    n = again.limit(REPEATED + 1).count()
    if n == 0:
        return count(docs)
    if n > REPEATED:
        return add_up(docs)
    parts = {how: docs.join(F.broadcast(again), docs[key].eqNullSafe(F.col("__again")), how) for how in ("left_anti", "left_semi")}
    return count(parts["left_anti"]).unionByName(add_up(parts["left_semi"]))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl): terms of each document."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def term_stats(posts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, cf)."""
    return posts.groupBy("term").agg(F.count(key).alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def idf_of(n: int, df: int) -> float:
    """The same on the driver."""
    return max(math.log((n - df + 0.5) / (df + 0.5)), IDF_FLOOR)


def saturated(f, length, mean):
    """What a frequency gives, of columns or of numbers."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", weight: float = 1.0) -> DataFrame:
    """(key, score, n_terms) of the documents with any of the terms; statistics are of all ``docs``.

    One pass over the texts counts only the query's terms, so what is shuffled is a row for each document that has one.
    """
    return bm25_fields(docs, terms, {text: weight}, key)


def bm25_fields(docs: DataFrame, terms: list[str], weights: dict[str, float], key: str = "doc_id") -> DataFrame:
    """BM25 over several columns: lengths and frequencies add up, each column's frequency by its weight."""
    if not terms:
        return docs.sparkSession.createDataFrame([], f"{docs.select(key).schema[0].simpleString().replace(':', ' ')}, score double, n_terms long")
    columns = [tokens(F.coalesce(F.col(c), F.lit(""))) for c in weights]
    parsed = docs.select(key, *[c.alias(f"__t{i}") for i, c in enumerate(columns)])
    length = reduce(lambda a, b: a + b, [F.size(f"__t{i}") for i in range(len(columns))]).cast("long")

    def frequency(term: str) -> Column:
        return reduce(lambda a, b: a + b, [F.size(F.filter(f"__t{i}", lambda x: x == term)) * F.lit(float(w)) for i, w in enumerate(weights.values())])

    counted = parsed.select(key, length.alias("dl"), *[frequency(t).alias(f"__f{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("dl").alias("__avg"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"__d{i}") for i in range(len(terms))])
    scored = counted.filter(reduce(lambda a, b: a | b, [F.col(f"__f{i}") > 0 for i in range(len(terms))])).crossJoin(F.broadcast(stats))

    def part(i: int) -> Column:
        f = F.col(f"__f{i}")
        return F.when(f > 0, idf(F.col("__n"), F.col(f"__d{i}")) * saturated(f, F.col("dl"), F.col("__avg"))).otherwise(F.lit(0.0))

    score = reduce(lambda a, b: a + b, [part(i) for i in range(len(terms))])
    matched = reduce(lambda a, b: a + b, [(F.col(f"__f{i}") > 0).cast("long") for i in range(len(terms))])
    return scored.select(key, score.alias("score"), matched.alias("n_terms"))


def top(scored: DataFrame, k: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """The ``k`` best by rounded score, ties to the smaller key (TakeOrderedAndProject)."""
    return scored.withColumn(score, F.round(score, 6)).orderBy(F.desc(score), key).limit(k)


# --- the query language: AND (implicit), OR, NOT, "phrase", prefix*, NEAR(a b, n), column:term, parentheses

_lexeme = re.compile(r'\s*(?:(NEAR)\s*\(\s*([^,)]*?)\s*(?:,\s*(\d+)\s*)?\)|(AND|OR|NOT)\b|([()])|(?:(\w+)\s*:\s*)?(?:"([^"]*)"|([^\s()":*]+)(\*)?))')


def parse(q: str):
    """A nested tuple: ("and"|"or"|"not", a, b), ("phrase", column, words), ("prefix", column, word), ("near", words, n)."""
    items, at = [], 0
    q = q.strip()
    while at < len(q):
        m = _lexeme.match(q, at)
        if m is None:
            raise ValueError(f"query not understood at {q[at:]!r}")
        at = m.end()
        near, words, distance, word, bracket, column, phrase, term, star = m.groups()
        if near:
            items.append(("near", query_terms(words), int(distance or 10)))
        elif word or bracket:
            items.append(word or bracket)
        else:
            found = re.findall(r"[^\W_]+", fold(phrase if phrase is not None else term))
            if star and len(found) == 1:
                items.append(("prefix", column, found[0]))
            elif found:
                items.append(("phrase", column, found))
    tree, rest = _either(items)
    if rest:
        raise ValueError(f"unexpected {rest[0]!r}")
    return tree


def _either(items):
    left, items = _all(items)
    while items and items[0] == "OR":
        right, items = _all(items[1:])
        left = ("or", left, right)
    return left, items


def _all(items):
    left, items = _one(items)
    while items and items[0] not in (")", "OR"):
        if items[0] == "NOT":
            right, items = _one(items[1:])
            left = ("not", left, right)
        else:
            right, items = _one(items[1:] if items[0] == "AND" else items)
            left = ("and", left, right)
    return left, items


def _one(items):
    if not items or items[0] in (")", "AND", "OR", "NOT"):
        raise ValueError("a term is missing")
    if items[0] == "(":
        tree, rest = _either(items[1:])
        if not rest or rest[0] != ")":
            raise ValueError("a bracket is not closed")
        return tree, rest[1:]
    return items[0], items[1:]


def leaves(tree) -> tuple[set[str], set[str]]:
    """The whole words and the prefixes that a parsed query asks for."""
    if tree[0] in ("and", "or", "not"):
        parts = [leaves(t) for t in tree[1:]]
        return set().union(*[w for w, _ in parts]), set().union(*[p for _, p in parts])
    if tree[0] == "prefix":
        return set(), {tree[2]}
    return set(tree[1] if tree[0] == "near" else tree[2]), set()


def condition(tree, columns: dict[str, Column]) -> Column:
    """A predicate over columns of term arrays."""
    kind = tree[0]
    if kind == "and":
        return condition(tree[1], columns) & condition(tree[2], columns)
    if kind == "or":
        return condition(tree[1], columns) | condition(tree[2], columns)
    if kind == "not":
        return condition(tree[1], columns) & ~condition(tree[2], columns)
    if kind == "near":
        return reduce(lambda a, b: a | b, [_near(c, tree[1], tree[2]) for c in columns.values()])
    wanted = [columns[tree[1]]] if tree[1] else list(columns.values())
    if kind == "prefix":
        return reduce(lambda a, b: a | b, [F.exists(c, lambda t: t.startswith(tree[2])) for c in wanted])
    return reduce(lambda a, b: a | b, [_phrase(c, tree[2]) for c in wanted])


def _phrase(terms: Column, words: list[str]) -> Column:
    if len(words) == 1:
        return F.array_contains(terms, words[0])
    # terms hold no blank, so a phrase is a substring between blanks
    return F.contains(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")), F.lit(f" {' '.join(words)} "))


def _near(terms: Column, words: list[str], distance: int) -> Column:
    """Each word within ``distance`` terms of the first one, at one of its places."""
    def places(w):
        return F.filter(F.transform(terms, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())

    others = [places(w) for w in words[1:]]
    if not others:
        return F.array_contains(terms, words[0])
    return F.exists(places(words[0]), lambda p: reduce(lambda a, b: a & b, [F.exists(o, lambda x: F.abs(x - p) <= distance + 1) for o in others]))


def match(docs: DataFrame, q: str, columns: dict[str, str]) -> DataFrame:
    """The documents that a query matches; ``columns`` names the searched columns."""
    named = {name: tokens(F.coalesce(F.col(c), F.lit(""))) for name, c in columns.items()}
    parsed = docs.withColumns({f"__{name}": c for name, c in named.items()})
    return parsed.filter(condition(parse(q), {name: F.col(f"__{name}") for name in named})).select(docs.columns)
