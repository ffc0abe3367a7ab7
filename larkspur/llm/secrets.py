"""Secret scanning with one combined deterministic automaton over all rules.

Each rule's regex becomes an NFA over bytes; subset construction joins all of them behind an unanchored start, and partition
refinement minimises the result into transition rows of 256 bytes with a bit mask of accepting rules. One
pass over a text's bytes finds, for each rule, every maximal stretch of accepting places; all rules end in a repeated class
or a fixed text, so a stretch's end is a match's end. Its leftmost start, not before the end of the rule's previous
match, comes from the rule's reversed automaton. That is leftmost-longest, non-overlapping matching by rule.

Defined results: null text counts as empty (no spans); offsets are code points, ends exclusive; repeated rows each
give a row; columns other than the two named are ignored (``redact`` keeps them); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import WAS_NULL, map_chunks, numbered, table


class Rule(NamedTuple):
    kind: str
    pattern: str  #: ASCII literals, classes, groups, alternatives and repeats
    tail: int = 1  #: least bytes from the first accepting place to the end; shorter matches are found, then dropped
    rest: tuple[str, ...] = ()  #: what belongs to the match behind its end: the one that goes farthest
    bound: bool = False  #: whether a match without a rest is none


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

#: The base rules. A hexadecimal run accepts from its 8th character on, else every letter a-f would open a stretch
#: (and from the 24th on would cost three times the states); what ``tail`` drops has been matched like the rest.
BASE = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{8}[0-9a-f]*", 17),
)
#: Behind a key's first line: all up to its END line, with no "--" between; or, where that is missing, header lines, runs of
#: base64 characters too long for words, and the short run on the line behind them.
_PLAIN = r"[\t\n\r\x20-,.-~]"
_HEADER = r"[\x20\t\r\n]*[A-Z][A-Za-z-]*:\x20[\x20-~]*(\n|\\n)"
_RUN = r"""[\x20\t\r\n\\"'+,>#|]*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=]*"""
_LAST = r"(\r?\n|\\n)[\x20\t]*[A-Za-z0-9+/=]+"
KEY_BODY = (rf"(-?{_PLAIN})*-----END [A-Z ]*PRIVATE KEY-----", rf"({_HEADER})*({_RUN})+({_LAST})?")
#: How the body of a private key begins (DER by length, OpenSSH, PBES2) and the last header line of an encrypted one: a body is found
#: even where its first line is missing, as line dedup takes that from all documents but the first.
#: (The automaton finds two letters; the rest, with its free places, would multiply the states of all rules.)
_B = "[A-Za-z0-9+/]"
KEY_START = "M[A-I]|b3BlbnNzaC1rZXkt|DEK-Info:"
KEY_REST = rf"(I{_B}{{2}}[AQgw]IBA[AD]|[GH]{_B}AgE[AB]|{_B}CAQ[AE]|I{_B}{{5}}BgkqhkiG9w0BBQ0|djE|\x20[A-Z0-9-]+,[0-9A-F]+)[A-Za-z0-9+/=]*({_RUN})*({_LAST})?"
#: What the automaton finds besides: well-known public formats of credentials.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 20),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 30),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 10),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", rest=KEY_BODY),
    Rule("key", KEY_START, rest=(KEY_REST,), bound=True),
)


class Parser:
    """Patterns of literals, classes, groups, alternatives and repeats as trees: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", least, most, part)."""

    ESCAPES = {"t": "\t", "n": "\n", "r": "\r"}

    def __init__(self, pattern: str):
        if not pattern.isascii():
            raise ValueError("rules are ASCII")
        self.pattern, self.at = pattern, 0

    def parse(self):
        tree = self.either()
        if self.at < len(self.pattern):
            raise ValueError(f"unexpected {self.pattern[self.at]!r} at {self.at}")
        return tree

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.pattern):
            raise ValueError("the pattern ends too early")
        self.at += 1
        return self.pattern[self.at - 1]

    def either(self):
        options = [self.row()]
        while self.peek() == "|":
            self.take()
            options.append(self.row())
        return options[0] if len(options) == 1 else ("alt", options)

    def row(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.one()
            while self.peek() in ("*", "+", "?", "{") and self.peek():
                part = ("rep", *self.times(), part)
            parts.append(part)
        return ("cat", parts)

    def times(self) -> tuple[int, int | None]:
        sign = self.take()
        if sign != "{":
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        least, comma, most = self.pattern[self.at : (end := self.pattern.index("}", self.at))].partition(",")
        self.at = end + 1
        return int(least), (int(most) if most else None) if comma else int(least)

    def one(self):
        c = self.take()
        if c == "(":
            tree = self.either()
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return tree
        if c == "[":
            return ("set", self.members())
        if c == "\\":
            return ("set", frozenset({self.escaped()}))
        if c in ".^$*+?{":
            raise ValueError(f"a rule may hold literals and plain classes only, not {c}")
        return ("set", frozenset({ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum() and c not in self.ESCAPES:
            raise ValueError(f"a rule may hold literals and plain classes only, not \\{c}")
        return ord(self.ESCAPES.get(c, c))

    def members(self) -> frozenset:
        found: set[int] = set()
        if self.peek() == "^":
            raise ValueError("a rule's class may not be negated")
        while (c := self.take()) != "]":
            low = high = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.pattern[self.at + 1 : self.at + 2] != "]":
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            found.update(range(low, high + 1))
        return frozenset(found)


class Nfa:
    """Thompson construction; ``step[s]`` holds (byte set, next), ``free[s]`` the states reached for nothing."""

    def __init__(self):
        self.step: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def add(self, tree, at: int, backward: bool) -> int:
        """Attach a parsed pattern behind state ``at``; give the state behind it."""
        if tree[0] == "set":
            after = self.state()
            self.step[at].append((tree[1], after))
            return after
        if tree[0] == "cat":
            for part in reversed(tree[1]) if backward else tree[1]:
                at = self.add(part, at, backward)
            return at
        if tree[0] == "alt":
            end = self.state()
            for option in tree[1]:
                self.free[self.add(option, at, backward)].append(end)
            return end
        _, least, most, body = tree
        for _ in range(least):
            at = self.add(body, at, backward)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(body, loop, backward)].append(loop)
            return loop
        ends = [at]
        for _ in range(most - least):
            ends.append(at := self.add(body, at, backward))
        after = self.state()
        for end in ends:
            self.free[end].append(after)
        return after

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def subset_construction(nfa: Nfa, start: list[int], finals: dict[int, int]) -> tuple[list[list[int]], list[int]]:
    """(rows of next state by byte, mask of accepting rules by state); state 0 is the start."""
    first = nfa.closure(start)
    number, rows, masks, todo = {first: 0}, [], [], [first]
    while todo:
        states = todo.pop(0)
        by_byte = defaultdict(set)
        for s in states:
            for found, after in nfa.step[s]:
                for b in found:
                    by_byte[b].add(after)
        row = []
        seen: dict[frozenset, int] = {}
        for b in range(256):
            key = frozenset(by_byte.get(b, ()))
            if key not in seen:
                target = nfa.closure(key)
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                seen[key] = number[target]
            row.append(seen[key])
        rows.append(row)
        masks.append(sum(1 << r for s, r in finals.items() if s in states))
    return rows, masks


def minimise(rows: list[list[int]], masks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Partition refinement: states stay together while their masks and their targets' parts are the same."""
    columns = sorted(set(zip(*rows)))  # bytes that no state tells apart count once
    part = masks
    while True:
        names: dict[tuple, int] = {}
        new = [names.setdefault((part[s], *[part[c[s]] for c in columns]), len(names)) for s in range(len(rows))]
        if len(names) == len(set(part)):
            break
        part = new
    keep = {p: s for s, p in reversed(list(enumerate(new)))}
    order = sorted(keep, key=lambda p: (p != new[0], p))
    place = {p: i for i, p in enumerate(order)}
    return [[place[new[t]] for t in rows[keep[p]]] for p in order], [masks[keep[p]] for p in order]


def linked(rows: list[list[int]], masks: list[int]) -> list[list]:
    """Rows that hold the next rows themselves; entry 256 is the mask, 257 tells whether a match can still come."""
    alive = {s for s, m in enumerate(masks) if m}
    while more := {s for s, row in enumerate(rows) if s not in alive and not alive.isdisjoint(row)}:
        alive |= more
    out = [[None] * 258 for _ in rows]
    for s, row in enumerate(rows):
        out[s][:256] = [out[t] for t in row]
        out[s][256], out[s][257] = masks[s], s in alive
    return out


class Automaton:
    """All rules as one minimal automaton, and each rule alone, anchored, forward and reversed."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        nfa, start, finals = Nfa(), [], {}
        again = nfa.state()
        nfa.step[again].append((frozenset(range(256)), again))
        for r, rule in enumerate(rules):
            start.append(at := nfa.state())
            nfa.free[again].append(at)
            finals[nfa.add(Parser(rule.pattern).parse(), at, False)] = r
        self.rows, self.masks = minimise(*subset_construction(nfa, [again], finals))
        self.start = linked(self.rows, self.masks)[0]
        self.forward = [self.alone(rule.pattern, False) for rule in rules]
        self.reverse = [self.alone(rule.pattern, True) for rule in rules]
        self.rest = [[self.alone(pattern, False) for pattern in rule.rest] for rule in rules]

    @staticmethod
    def alone(pattern: str, backward: bool) -> list:
        nfa = Nfa()
        at = nfa.state()
        end = nfa.add(Parser(pattern).parse(), at, backward)
        return linked(*minimise(*subset_construction(nfa, [at], {end: 0})))[0]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start and then by rule."""
        data = text.encode("utf-8", "replace")
        found, previous = [], [0] * len(self.rules)
        for rule, end in self.ends(data):
            start = self.leftmost(rule, data, end, previous[rule]) if end > previous[rule] else None
            if start is not None:
                whole = self.with_rest(rule, data, end)
                previous[rule] = whole
                if end - self.first_accept(rule, data, start) + 1 >= self.rules[rule].tail and (whole > end or not self.rules[rule].bound):
                    found.append((start, rule, whole))
        found.sort()
        if found and len(data) != len(text):
            places = {}
            at, chars = 0, 0
            for b in sorted({x for s, _, e in found for x in (s, e)}):
                chars += len(data[at:b].decode("utf-8"))
                places[b], at = chars, b
            found = [(places[s], r, places[e]) for s, r, e in found]
        return found

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """One pass: (rule, end) of each maximal stretch of accepting places, by end."""
        out, row, mask = [], self.start, 0
        for i, b in enumerate(data):
            row = row[b]
            if row[256] != mask:
                gone, mask = mask & ~row[256], row[256]
                while gone:
                    low = gone & -gone
                    out.append((low.bit_length() - 1, i))
                    gone ^= low
        out += [(r, len(data)) for r in range(len(self.rules)) if mask >> r & 1]
        return out

    def leftmost(self, rule: int, data: bytes, end: int, least: int) -> int | None:
        row, best = self.reverse[rule], None
        for i in range(end - 1, least - 1, -1):
            row = row[data[i]]
            if row[256]:
                best = i
            if not row[257]:
                break
        return best

    def with_rest(self, rule: int, data: bytes, end: int) -> int:
        """The end of what belongs to a match that ends at ``end``."""
        far = end
        for row in self.rest[rule]:
            for i in range(end, len(data)):
                row = row[data[i]]
                if row[256]:
                    far = max(far, i + 1)
                if not row[257]:
                    break
        return far

    def first_accept(self, rule: int, data: bytes, start: int) -> int:
        row, i = self.forward[rule], start
        while True:
            row = row[data[i]]
            i += 1
            if row[256]:
                return i


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """One automaton per Python worker."""
    return Automaton(rules)


def digest_columns(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans. No shuffle."""

    def make():
        automaton, kinds = compiled(rules), [rule.kind for rule in rules]

        def work(rows):
            out = defaultdict(list, doc_id=rows["doc_id"])
            for text in rows["text"]:
                spans = automaton.spans(text)
                base = [x for x in spans if x[1] < len(BASE)]
                for r, rule in enumerate(BASE):
                    out[f"n_{rule.kind}"].append(sum(x[1] == r for x in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in spans))
            return out

        return work

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_chunks(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, automaton: Automaton) -> str:
    """The text with each span (overlapping ones together) replaced by its first kind in brackets."""
    out, at = [], 0
    for start, rule, end in automaton.spans(text):
        if start >= at:
            out += [text[at:start], f"[{automaton.rules[rule].kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with their secrets replaced in ``text`` and ``n_chars`` counted anew; null texts stay null."""
    docs, called = numbered(documents, "text", "n_chars")
    text, n_chars = called["text"], called.get("n_chars")

    def make():
        automaton = compiled(rules)

        def work(rows):
            texts = [None if null else redacted(t, automaton) for t, null in zip(rows[text], rows[WAS_NULL])]
            return rows | {text: texts, n_chars: [None if t is None else len(t) for t in texts]}

        return work

    docs = docs.withColumns({text: F.col(text).cast("string")} | ({n_chars: F.col(n_chars).cast("long")} if n_chars else {}))
    return map_chunks(docs, make, docs.schema, text, [c for c in docs.columns if c not in (text, n_chars)]).toDF(*documents.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(table(spark, sf_dir, "documents"))
