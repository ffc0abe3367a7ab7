"""Chunkers: a splitter for each kind of file, and one greedy packing kernel for all.

A chunk is flushed when the next piece would exceed the token limit, or when it opens a section, provided that the chunk has more than
the least bytes. The fold runs over one document's pieces inside the row (``aggregate``) and gives where chunks begin, so nothing is shuffled. Lines inside fences
(``` or ~~~) open no section.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import markdown

MAX_TOKENS, MIN_BYTES = 512, 50
#: Noncharacters, which no text has.
MARK = "\ufdd0\ufdd1"
FENCE = r"^\s*(```|~~~)"
HELD = 256


def lines(s: Column) -> Column:
    """Non-blank lines: paragraphs of word-processor files, blocks of Markdown."""
    return F.filter(F.split(s, "\n"), lambda x: F.trim(x) != "")


def paragraphs(s: Column) -> Column:
    """Text between blank lines: pages of a print format."""
    return F.filter(F.split(s, "\n\n"), lambda x: F.trim(x) != "")


def places(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """Numbers of the items at which a condition holds that depends on a state, which each item changes.

    ``step(state and at, item)``: (the next state, the condition). A fold copies what its state holds at each step, so the places of HELD items are found in a fold of their
    own: each place is copied HELD times at most, and once for each HELD items behind it.
    """
    none = F.array().cast("array<int>")
    same = lambda a: [a[n].alias(n) for n in [*state, "at"]]

    def one(a, x):
        new, here = step(a, x)
        held = F.when(here, F.concat(a["held"], F.array(a["at"]))).otherwise(a["held"])
        return F.struct(*[c.alias(n) for n, c in new.items()], (a["at"] + 1).alias("at"), held.alias("held"))

    def many(a, some):
        return F.aggregate(some, F.struct(*same(a), none.alias("held")), one, lambda r: F.struct(*same(r), F.concat(a["done"], F.array(r["held"])).alias("done")))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest((F.size(items) - 1) / HELD, F.lit(0)).cast("int")), lambda b: F.slice(items, b * HELD + 1, HELD))
    first = F.struct(*[c.alias(n) for n, c in state.items()], F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("done"))
    return F.aggregate(blocks, first, many, lambda a: F.flatten(a["done"]))


def pieces_between(items: Column, starts: Column, made: Callable[[Column, Column], Column]) -> Column:
    """``made(start, length)`` for each stretch that the starts begin."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(items)))
    return F.zip_with(starts, ends, lambda s, e: made(s, e - s))


def sections(s: Column) -> Column:
    """Text split before every heading line that is not inside a fence."""
    # cut before each line that opens or closes a fence, the even parts are outside; a line's end in front keeps the first part outside
    parts = F.split(F.concat(F.lit("\n"), s), r"(?md)(?=^[^\S\n]*(?:```|~~~))")
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"(?md)^(#{1,6}(?:\s|$))", MARK + "$1")).otherwise(p))
    return F.filter(F.split(F.substring(F.array_join(marked, ""), 2, 2**31 - 1), MARK), lambda x: F.trim(x) != "")


def declarations(s: Column) -> Column:
    """Source split before every top-level declaration."""
    return F.filter(F.split(F.regexp_replace(s, r"(?m)^(func|package|type|const|var)(\s)", MARK + "$1$2"), MARK), lambda x: F.trim(x) != "")


def printed(s: Column) -> Column:
    """Non-blank lines of print and word-processor files."""
    return F.filter(F.split(s, "\n+"), lambda x: F.trim(x) != "")


#: The splitter of each kind of file (text -> array of pieces); a kind without one has DEFAULT.
SPLITTERS: dict[str, Callable[[Column], Column]] = {"go": declarations, "memory": lambda s: F.array(s), "md": markdown.pieces, "pdf": printed, "docx": printed}
DEFAULT = sections


def split_by_kind(kind: Column, text: Column, splitters: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """Pieces of a text by its kind; ``splitters`` add to the known ones or stand in their place."""
    out = None
    for name, splitter in (SPLITTERS | (splitters or {})).items():
        out = F.when(kind == name, splitter(text)) if out is None else out.when(kind == name, splitter(text))
    return out.otherwise(DEFAULT(text))


def chunk_starts(facts: Column, max_tokens: int, min_bytes: int) -> Column:
    """Numbers of the pieces that chunks begin with, from array<struct<tokens, bytes, opens, fence>>."""
    state = {"tokens": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long"), "fenced": F.lit(False)}

    def step(a, p):
        flush = (a["bytes"] > min_bytes) & ((a["tokens"] + p["tokens"] > max_tokens) | (p["opens"] & ~a["fenced"]))
        new = {
            "tokens": F.when(flush, p["tokens"]).otherwise(a["tokens"] + p["tokens"]),
            "bytes": F.when(flush, p["bytes"]).otherwise(a["bytes"] + p["bytes"]),
            "fenced": a["fenced"] != p["fence"],
        }
        return new, flush | (a["at"] == 0)

    return places(facts, state, step)


def _split(docs: DataFrame, splitter: Column, opens, separator: str, key: str, max_tokens: int, min_bytes: int, tokens) -> DataFrame:
    """(key, pieces, facts, starts) of each document."""
    opens, tokens = opens or (lambda p: F.lit(False)), tokens or T.token_estimate
    # a piece's bytes count its separator
    size = lambda p: (F.octet_length(p) + len(separator)).cast("long")
    # a piece with all of a fenced block opens and closes it
    fence = lambda p: p.rlike(FENCE) & (F.size(F.regexp_extract_all(p, F.lit("(?m)" + FENCE), F.lit(0))) % 2 == 1)
    split = docs.select(key, splitter.alias("pieces"))
    if tokens is T.token_estimate:
        split = split.withColumn("counts", F.transform("pieces", T.token_estimate))
    else:
        split = split.withColumn("counts", tokens(F.col("pieces")))
    each = lambda p, n: F.struct(n.cast("long").alias("tokens"), size(p).alias("bytes"), F.coalesce(opens(p), F.lit(False)).alias("opens"), fence(p).alias("fence"))
    return split.withColumn("facts", F.zip_with("pieces", "counts", each)).drop("counts").withColumn("starts", chunk_starts(F.col("facts"), max_tokens, min_bytes))


def pack(docs: DataFrame, splitter: Column, opens=None, separator: str = "\n", key: str = "doc_id", max_tokens: int = MAX_TOKENS, min_bytes: int = MIN_BYTES, tokens=None) -> DataFrame:
    """(key, chunk, pos, piece, tokens, bytes): every piece with its chunk number. No shuffle.

    ``opens``: whether a piece opens a section. ``tokens``: array of pieces -> array of their tokens (default: the estimate of a quarter of the bytes).
    """
    split = _split(docs, splitter, opens, separator, key, max_tokens, min_bytes, tokens)
    sizes = pieces_between(F.col("pieces"), F.col("starts"), lambda at, n: n)
    numbered = split.withColumn("no", F.flatten(F.transform(sizes, lambda n, c: F.array_repeat(c, n))))
    out = numbered.select(key, F.posexplode(F.arrays_zip("pieces", "facts", "no")).alias("pos", "z"))
    return out.select(key, F.col("z.no").cast("long").alias("chunk"), F.col("pos").cast("long").alias("pos"), F.col("z.pieces").alias("piece"), "z.facts.tokens", "z.facts.bytes")


def chunks(docs: DataFrame, splitter: Column, opens=None, separator: str = "\n", key: str = "doc_id", max_tokens: int = MAX_TOKENS, min_bytes: int = MIN_BYTES, tokens=None) -> DataFrame:
    """(key, chunk, content, token_count, n_pieces, first_piece) of the chunks that ``pack`` numbers, without a shuffle; those not longer than the least bytes are dropped."""
    split = _split(docs, splitter, opens, separator, key, max_tokens, min_bytes, tokens)

    def chunk(at, n):
        mine, facts = F.slice("pieces", at + 1, n), F.slice("facts", at + 1, n)
        total = lambda name: F.aggregate(facts, F.lit(0).cast("long"), lambda s, f: s + f[name])
        return F.struct(F.array_join(mine, separator).alias("content"), total("tokens").alias("token_count"), n.cast("long").alias("n_pieces"), F.get("pieces", at).alias("first_piece"), total("bytes").alias("size"))

    out = split.select(key, F.posexplode(pieces_between(F.col("pieces"), F.col("starts"), chunk)).alias("chunk", "z"))
    return out.select(key, F.col("chunk").cast("long").alias("chunk"), "z.*").filter(F.col("size") > min_bytes).drop("size")


def is_heading(p: Column) -> Column:
    return p.rlike(r"^#{1,6}\s+\S")


def heading_in_effect(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pieces with the last Markdown heading at or before them."""
    so_far = Window.partitionBy(key).orderBy("pos")
    fenced = F.coalesce(F.sum(F.col("piece").rlike(FENCE).cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    title = F.when(is_heading(F.col("piece")) & ~F.col("__fenced"), F.trim(F.regexp_replace("piece", r"^#{1,6}\s+", "")))
    return packed.withColumn("__fenced", fenced).withColumn("heading", F.coalesce(F.last(title, True).over(so_far), F.lit("section"))).drop("__fenced")


def overlapped(chunked: DataFrame, characters: int, key: str = "doc_id") -> DataFrame:
    """Chunks that begin with the end of the chunk before."""
    before = F.lag("content").over(Window.partitionBy(key).orderBy("chunk"))
    tail = F.when(before.isNotNull(), F.concat(F.substring(before, -characters, characters), F.lit("\n"))).otherwise(F.lit(""))
    return chunked.withColumn("content", F.concat(tail, "content"))
