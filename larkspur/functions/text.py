"""Text functions as Column expressions; sizes are in bytes, cuts in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters with marks and what they become without; the tokeniser's folding.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
# Fixed value: what marks a cut text.
CUT_MARK = " [片段截断...]"


def ascii_lower(s: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(s, UPPER, LOWER)


def split_words(s: Column) -> Column:
    """Words between blanks, commas, full stops, line ends and tabs."""
    return F.filter(F.split(s, r"[ ,.\n\t]+"), lambda x: x != "")


def tokens(s: Column) -> Column:
    """Index terms: runs of letters and digits, lower case, marks folded."""
    low = F.lower(s)
    folded = F.when(F.octet_length(s) == F.char_length(s), low).otherwise(F.translate(low, MARKED, PLAIN))  # ASCII has no marks
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def token_estimate(s: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(s) / 4).cast("long")


def hash_id(s: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(s, 256), 1, digits)


def word_matches(query: Column, content: Column) -> Column:
    """How many words of the query (two bytes or more, repeats counted) occur in the content."""
    words = split_words(ascii_lower(content))
    return F.size(F.filter(split_words(ascii_lower(query)), lambda w: (F.octet_length(w) >= 2) & F.array_contains(words, w)))


def contains_any_word(query: Column, content: Column) -> Column:
    return word_matches(query, content) > 0


def contains_phrase(query: Column, content: Column) -> Column:
    """The query, of three bytes or more, occurs in the content as it stands, case folded."""
    return (F.octet_length(query) >= 3) & F.contains(ascii_lower(content), ascii_lower(query))


def ellipsis(s: Column, n: int) -> Column:
    """The first ``n`` characters and three dots where the text has more than ``n`` bytes."""
    return F.when(F.octet_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def smart_truncate(s: Column, budget: Column) -> Column:
    """At most twice ``budget`` characters, cut behind the last sentence end, which is marked; else three dots.

    Sentence ends are tried in order; a later kind wins only if it lies beyond the end of the best so far.
    """
    limit = (budget * 2).cast("int")
    head = F.substring(s, F.lit(1), limit)
    back = F.reverse(head)
    places = F.array(*[F.when(F.contains(head, F.lit(end)), F.char_length(head) - F.locate(end, back) + 1).otherwise(F.lit(0)) for end in "。.！!？?\n"])
    best = F.aggregate(places, F.lit(0), lambda b, at: F.when(at > F.when(b > 0, b + 1).otherwise(F.lit(0)), at).otherwise(b))
    cut = F.when(best > 0, F.concat(F.substring(head, F.lit(1), best), F.lit(CUT_MARK))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.octet_length(s) <= limit, s).otherwise(cut)


def detect_heading(section: Column) -> Column:
    """struct(heading, level) of a text section by its first line."""
    line = F.trim(F.element_at(F.split(section, "\n", 2), 1))
    marks = F.regexp_extract(line, r"^(#{1,3}) ", 1)
    pair = F.contains(line, F.lit(":")) & ~F.contains(line, F.lit(" "))
    heading = F.when(marks != "", F.trim(F.regexp_replace(line, r"^#{1,3} ", ""))).when(pair, line).otherwise(F.lit("section"))
    level = F.when(marks != "", F.char_length(marks)).when(pair, F.lit(1)).otherwise(F.lit(0))
    return F.struct(heading.alias("heading"), level.cast("int").alias("level"))


def code_heading(section: Column) -> Column:
    """struct(heading, level) of a declaration: functions and types 2, else 1, plain text 0."""
    line = F.trim(F.element_at(F.split(section, "\n", 2), 1))
    kind = F.regexp_extract(line, r"^(func|type|package|const|var)\b", 1)
    name = F.regexp_extract(line, r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|package\s+|const\s+|var\s+)([A-Za-z_]\w*)", 1)
    heading = F.when(kind == "", F.lit("code")).when(name == "", kind).otherwise(F.concat_ws(" ", kind, name))
    level = F.when(kind.isin("func", "type"), 2).when(kind != "", 1).otherwise(0)
    return F.struct(heading.alias("heading"), level.cast("int").alias("level"))


def breadcrumb(path: Column, heading: Column, style: str = "section") -> Column:
    """The line that goes before a chunk's text."""
    if style == "section":
        return F.concat(F.lit("Section: ["), path, F.lit("] > "), heading, F.lit("\n\n"))
    return F.concat(F.lit("File: "), path, F.lit(" | "), heading, F.lit("\n\n"))


def highlights(term: str, s: Column, around: int = 20) -> Column:
    """The first place of a term: struct(text, start, end), null where there is none; offsets from 0."""
    at = F.locate(term, ascii_lower(s))
    start = F.greatest(at - around, F.lit(1))
    return F.when(
        at > 0,
        F.struct(F.substring(s, start, F.lit(len(term) + 2 * around)).alias("text"), (at - 1).cast("long").alias("start"), (at - 1 + len(term)).cast("long").alias("end")),
    )


# Suffixes that share another one's type, types that are indexed, folders that are never watched.
SAME_TYPE = {"yml": "yaml", "conf": "cfg", "htm": "html", "cc": "cpp", "cxx": "cpp", "h": "c", "bash": "sh", "zsh": "sh"}
SUPPORTED = "md pdf docx go yaml json txt toml ini cfg hcl env properties xml html css js ts py rb java cpp c sh ps1".split()
EXCLUDED = (".git", "node_modules", ".venv", "vendor")


def file_type(path: Column) -> Column:
    """Type by the lower-cased suffix, null where it is not supported."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kind = F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in SAME_TYPE.items()], suffix)
    return F.when(kind.isin(SUPPORTED), kind)


def excluded(path: Column) -> Column:
    """Whether a folder of the path is one that is never watched."""
    return F.exists(F.split(path, "/"), lambda x: x.isin(*EXCLUDED))
