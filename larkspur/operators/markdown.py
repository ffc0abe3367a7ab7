"""Blocks of Markdown texts, by one automaton over the lines: each line is looked at once, whatever the text.

A block is a heading (``#`` or underlined), a paragraph, a fenced or indented code block, a list with all its items, a quotation, or a block of HTML. Rules between
blocks (``---``) are no blocks. Nested blocks belong to the list or quotation they are in.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))

_fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_heading = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_underline = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_rule = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_item = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_quote = re.compile(r" {0,3}> ?")
_html = re.compile(r" {0,3}<(?:(!--)|(script|pre|style|textarea)\b|[/?!]?[a-zA-Z])", re.I)
_code = re.compile(r"(?: {4}|\t)")


class _Blocks:
    def __init__(self):
        self.found: list[tuple[str, int, str]] = []
        self.kind, self.lines, self.level = None, [], 0
        #: what closes an open fence or block of HTML; whether the line before was blank
        self.until, self.blank = None, False

    def close(self) -> None:
        if self.kind is not None:
            lines = self.lines
            while lines and not lines[-1].strip():
                lines.pop()
            if lines:
                self.found.append((self.kind, self.level, "\n".join(lines)))
        self.kind, self.lines, self.level, self.until = None, [], 0, None

    def open(self, kind: str, line: str, level: int = 0) -> None:
        self.close()
        self.kind, self.lines, self.level = kind, [line], level

    def feed(self, line: str) -> None:
        blank = not line.strip()
        self._feed(line, blank)
        self.blank = blank

    def _feed(self, line: str, blank: bool) -> None:
        kind = self.kind
        if self.until is not None:  # inside a fence, or of HTML that ends by a mark
            self.lines.append(line)
            if self.until(line):
                self.close()
            return
        if blank:
            if kind in ("list", "code"):
                self.lines.append("")
            else:
                self.close()
            return
        if kind == "list" and (line.startswith((" ", "\t")) and len(line) - len(line.lstrip()) >= 2 or _item.match(line) and not _rule.match(line)):
            self.lines.append(line)
            return
        if kind == "code" and _code.match(line):
            self.lines.append(line)
            return
        if kind == "html" and not self.blank:
            self.lines.append(line)
            return
        if kind == "paragraph" and (m := _underline.match(line)):
            text = "\n".join(self.lines)
            self.kind = None
            self.close()
            self.found.append(("heading", 1 if m[1][0] == "=" else 2, text.strip()))
            return
        if (m := _fence.match(line)) and not (m[1][0] == "`" and "`" in m[2]):
            self.open("code", line, 1)
            end = re.compile(r" {0,3}" + re.escape(m[1][0]) + "{" + str(len(m[1])) + r",}[ \t]*$")
            self.until = lambda later: end.match(later) is not None
        elif (m := _heading.match(line)) is not None:
            self.close()
            self.found.append(("heading", len(m[1]), (m[2] or "").strip()))
        elif _rule.match(line):
            self.close()
        elif _quote.match(line):
            bare = _quote.sub("", line, count=1)
            if kind == "quote":
                self.lines.append(bare)
            else:
                self.open("quote", bare)
        elif _item.match(line) and not (kind == "paragraph" and not _item.match(line)[0].strip()):
            self.open("list", line)
        elif kind is None and _code.match(line):
            self.open("code", line)
        elif kind != "paragraph" and (m := _html.match(line)) is not None:
            self.open("html", line)
            mark = "-->" if m[1] else f"</{m[2].lower()}>" if m[2] else None
            if mark is not None:
                if mark in line.lower():
                    self.close()
                else:
                    self.until = lambda later: mark in later.lower()
        elif kind in ("paragraph", "quote") or kind == "list" and not self.blank:
            self.lines.append(line.strip())  # a lazy line goes on with what is open
        else:
            self.open("paragraph", line.strip())


def blocks_of(text: str) -> list[tuple[str, int, str]]:
    """(kind, level of a heading (1 for a fenced code block), text) of each block."""
    state = _Blocks()
    for line in text.replace("\r\n", "\n").split("\n"):
        state.feed(line)
    state.close()
    return state.found


@F.pandas_udf(BLOCKS)
def blocks(texts: pd.Series) -> pd.Series:
    """Blocks of each text; null stays null."""
    return texts.map(lambda t: None if t is None else blocks_of(t))


def pieces(text: Column) -> Column:
    """A text's blocks as pieces for a chunker: a heading with its signs, whatever way it was written."""
    return F.transform(blocks(text), lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).otherwise(b["text"]))
