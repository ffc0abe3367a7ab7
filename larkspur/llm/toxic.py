"""Toxicity by noisy-channel deobfuscation and a lexicon learned from labels.

A word that may be disguised (leetspeak, separators, stretched letters, spaced-out letters) is a lattice: each character stands for itself, for letters it
resembles, or for noise, at a cost. Viterbi decoding under a character trigram model finds the cheapest reading, and that is what is scored.
Words and word beginnings that labelled documents tie to toxicity are the features; a document's score is the chance that at least one of
its readings makes it toxic (noisy-or).

Lexicon and character model are counted over all labelled rows outside the held-out fold, by Spark jobs (``fit``): near copies go, words are counted for the
character model, its readings of each text are counted as features, and how much evidence a feature needs is chosen by cross-validation over all these
rows. The driver gets letter trigrams, the features that some limits could choose and sums. Every document's whole text is scored.

Defined results: null, empty and wordless texts get the score of documents without features; labels of null or other than 0 and 1 are not
learned from, of several labels for one id the largest holds; without any toxic training row every score is 0; repeated rows get equal
scores; other columns are ignored by ``score_documents`` and kept by ``reject``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from larkspur.llm.common import WordCache, forget, map_chunks, numbered, one_per_worker, table, text_chunks
from larkspur.llm.near import shingles, signature
from larkspur.operators.store import remove, shared_folder

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Least evidence (log-likelihood ratio against the base rate) and share of toxic documents of a feature: what cross-validation chooses from, and its parts.
EVIDENCE, LEAST_SHARE, PARTS = (3.0, 4.5, 6.0, 8.0, 10.0, 14.0, 20.0), (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95), 4
LIMITS = list(product(EVIDENCE, LEAST_SHARE))
PREFIXES = range(4, 9)
#: Minhashes by which rows are found to be near copies, and how many of them have to be one other row's.
MARKS, COPY = 16, 5
#: Letters of the character model, the most frequent ones.
ALPHABET = 64

#: Words of 64 bits in the sieve of labelled ids.
SIEVE = 1 << 19
#: Words whose features a worker remembers while it counts.
FEATURE_ENTRIES = 100_000
#: Keys that a task counts, and code points of the texts they come from, before it hands the counts on; rows that it hands on at once.
HELD_KEYS, HELD_CHARS, HANDED = 300_000, 16_000_000, 50_000

#: What a character may stand for besides itself.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
LIKE, NOISE, MARK, STRETCHED, DOUBLED, UNKNOWN = 0.3, 6.0, 0.3, 0.4, 6.0, 9.0
_edge = " \t\n.,;:!?\"'()[]{}<>|/\\-_*&%#~^`=+«»“”‘’…"
_sign = re.compile(r"[^\w\s]").match
_letters = re.compile(r"[^\W\d_]+").findall
_stretch = re.compile(r"(.)\1\1")
_spaced = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S))+")
_gap = re.compile(r"\s+")
#: Letters of a spaced-out run that are read from an offset on; longer than any word.
LONGEST = 40


class CharacterModel:
    """Interpolated character trigrams; costs are negative natural logarithms."""

    def __init__(self, three: dict[str, int]):
        """From how often each trigram stands in words (``grams``)."""
        two, one = Counter(), Counter()
        for g, n in three.items():
            two[g[1:]] += n
            one[g[2]] += n
        context3, context2, total = Counter(), Counter(), sum(one.values()) or 1
        for g, n in three.items():
            context3[g[:2]] += n
        for g, n in two.items():
            context2[g[0]] += n
        base = {c: n / total for c, n in one.items()}
        pairs = {g: 0.8 * n / context2[g[0]] + 0.2 * base[g[1]] for g, n in two.items()}
        self.one = {c: -math.log(0.04 * p) for c, p in base.items()}
        self.two = {g: -math.log(0.2 * p) for g, p in pairs.items()}
        self.three = {g: -math.log(0.8 * n / context3[g[:2]] + 0.2 * pairs[g[1:]]) for g, n in three.items()}

    def cost(self, context: str, c: str) -> float:
        g = context + c
        return self.three.get(g) or self.two.get(g[1:]) or self.one.get(c, UNKNOWN)


def alphabet(letters: dict[str, int]) -> frozenset[str]:
    """The most frequent letters; ties go to the smaller ones."""
    return frozenset(sorted(letters, key=lambda c: (-letters[c], c))[:ALPHABET])


def letters_of(words: Iterable[tuple[str, int]]) -> Counter:
    """How often each letter stands in words, given with their numbers."""
    out = Counter()
    for word, n in words:
        for c in word:
            out[c] += n
    return out


def grams(words: Iterable[tuple[str, int]], known: frozenset[str]) -> Counter:
    """How often each trigram stands in the words that have known letters only."""
    out = Counter()
    for word, n in words:
        if known.issuperset(word):
            padded = f"^^{word}$"
            for i in range(2, len(padded)):
                out[padded[i - 2 : i + 1]] += n
    return out


def plain_words(text: str) -> list[str]:
    return [w for w in text.lower().split() if w.isalpha()]


def readings(word: str, i: int):
    """(letters it gives, cost) of the ``i``-th character."""
    c = word[i]
    if c.isalpha():
        yield c, 0.0
        if i and word[i - 1] == c:
            stretched = (i > 1 and word[i - 2] == c) or (i + 1 < len(word) and word[i + 1] == c)
            yield "", STRETCHED if stretched else DOUBLED
        return
    for letter in LEET.get(c, ""):
        yield letter, LIKE
    if c in LEET:
        yield "", NOISE
    elif c == "*":
        yield "", MARK
        for letter in "aeiou":
            yield letter, NOISE
    else:
        yield "", MARK


def decode(word: str, model: CharacterModel, ends: bool = False) -> str:
    """The cheapest reading of a disguised word: Viterbi over states of the last two letters.

    With ``ends`` words may end anywhere (a blank in the reading), each at the cost of its end and of the next one's beginning.
    """
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}  # letters are linked backwards, so a step costs the same at any length
    for i in range(len(word)):
        after: dict[str, tuple[float, tuple | None]] = {}
        options = list(readings(word, i))
        if ends and i:
            ended = min(((cost + model.cost(context, "$"), k, said) for k, (context, (cost, said)) in enumerate(best.items()) if context != "^^"), default=None)
            if ended is not None and ("^^" not in best or ended[0] < best["^^"][0]):
                best["^^"] = (ended[0], (" ", ended[2]))
        for context, (cost, said) in best.items():
            for letter, price in options:
                total = cost + price + (model.cost(context, letter) if letter else 0.0)
                key = context[1] + letter if letter else context
                if key not in after or total < after[key][0]:
                    after[key] = (total, (letter, said) if letter else said)
        best = after
    costs = {context: cost + model.cost(context, "$") for context, (cost, _) in best.items()}
    least = min(costs.values())
    return min(unlinked(best[context][1]) for context, cost in costs.items() if cost == least)


def unlinked(said: tuple | None) -> str:
    letters = []
    while said is not None:
        letters.append(said[0])
        said = said[1]
    return "".join(reversed(letters))


def core(token: str) -> str:
    """The token without punctuation and repeated signs at its ends."""
    start, end, before = 0, len(token), None
    while before != (start, end):
        before = start, end
        at = end
        while at > start and token[at - 1] == token[end - 1]:
            at -= 1
        if end - at > 1 and _sign(token[at]):
            end = at
        at = start
        while at < end and token[at] == token[start]:
            at += 1
        if at - start > 1 and _sign(token[start]):
            start = at
    return token[start:end].strip(_edge)


def disguised(word: str) -> bool:
    return not word.isalpha() and any(c.isalpha() for c in word) or bool(_stretch.search(word))


def restored(token: str, model: CharacterModel) -> tuple[str, ...]:
    """The words that a token of a lower-cased text may say."""
    bare = token.strip(_edge)
    word = bare if bare.isalpha() and not _stretch.search(bare) else core(token)
    if not disguised(word):
        return (word,) if word.isalpha() else ()
    plain = [w for w in _letters(word) if len(w) > 3]
    return (*dict.fromkeys(decode(w, model) for w in unstretched(word)), *plain)


def unstretched(word: str) -> list[str]:
    """The word, and its versions with each stretched letter single or double (all alike where there are many): either may be meant."""
    parts = re.split(r"((.)\2\2+)", word)
    runs = len(parts) // 3
    if not runs:
        return [word]
    choices = list(product((1, 2), repeat=runs)) if runs <= 3 else [(1,) * runs, (2,) * runs]
    return [word, *("".join(parts[3 * k] + parts[3 * k + 2] * n for k, n in enumerate(times)) + parts[-1] for times in choices)]


def features(word: str) -> list[str]:
    """The word itself and, marked with a star, its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if n < len(word))]


def spaced_words(text: str, model: CharacterModel) -> set[str]:
    """Readings of runs of single characters with blanks between them.

    A run is read as a whole, and by its words where some gaps are wider than others; each of these from every offset on (a word may
    begin anywhere), and cut into the likeliest words. Work is linear in the run.
    """
    out = set()
    for m in _spaced.finditer(text):
        run = m[0]
        for piece in {"".join(run.split()), *wide_words(run)}:
            if any(c.isalpha() for c in piece):
                word = decode(piece, model)
                out.update(word[k : k + LONGEST] for k in range(len(word)))
                out.update(decode(piece, model, True).split())
    return out


def wide_words(run: str) -> list[str]:
    """The words of a run whose gaps are not all alike: a gap wider than the narrowest one, or with a line's end unlike it, ends a word."""
    gaps = {g: ("\n" in g, len(g)) for g in set(_gap.findall(run))}
    narrowest = min(gaps.values())
    if all(x == narrowest for x in gaps.values()):
        return []
    words, held, at = [], [], 0
    for m in _gap.finditer(run):
        held.append(run[at : m.start()])
        at = m.end()
        if gaps[m[0]] > narrowest:
            words.append("".join(held))
            held = []
    return [*words, "".join(held) + run[at:]]


def words_of(text: str, model: CharacterModel, cache: dict | None = None) -> set[str]:
    text = text.lower()
    found = cache if cache is not None else WordCache(lambda t: restored(t, model))
    out = {w for token in set(text.split()) for w in found[token]}
    return out | spaced_words(text, model)


def digest_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - 2**63


def marks_of(text: str) -> list[int]:
    """Minhashes of the text's runs of three words."""
    found = shingles(text, 3)
    return signature(found, MARKS).tolist() if len(found) else [0] * MARKS


def without_copies(rows: Iterable[tuple[str, int]]) -> dict[tuple[int, int], str]:
    """Texts by digest and label, one of each group of near copies with the same label: what copies share says nothing about the label.

    A minhash belongs to the smallest digest of its label that has it. A row goes where COPY of its minhashes belong to one other row.
    """
    texts = {(digest_of(text), label): text for text, label in rows}
    marks = {key: marks_of(text) for key, text in texts.items()}
    firsts: dict[tuple, int] = {}
    for (digest, label), mine in marks.items():
        for k in enumerate(mine):
            firsts[label, k] = min(digest, firsts.get((label, k), digest))
    forget()  # the hashes of words, on the driver

    def copied(digest: int, label: int) -> bool:
        others = Counter(first for k in enumerate(marks[digest, label]) if (first := firsts[label, k]) != digest)
        return max(others.values(), default=0) >= COPY

    return {key: text for key, text in texts.items() if not copied(*key)}


def said(text: str, model: CharacterModel, cache: dict | None = None) -> list[str]:
    """The words that are learned from, in order."""
    return sorted(words_of(text, model, cache) - {""})


class Tally:
    """For each feature, the numbers of toxic and of other documents that have it."""

    def __init__(self, n: int, toxic: int, bad: np.ndarray, good: np.ndarray):
        self.n, self.toxic, self.bad, self.good = n, toxic, bad, good

    @classmethod
    def of(cls, counts: np.ndarray, totals: np.ndarray, without: int | None = None) -> Tally:
        """Counts by feature and place (two a part: other documents, toxic ones), numbers of documents by place, and the part to leave out."""
        parts = [part for part in range(PARTS) if part != without]
        good, bad = counts.reshape(-1, PARTS, 2)[:, parts].sum(axis=1).T
        others, toxic = totals.reshape(PARTS, 2)[parts].sum(axis=0).tolist()
        return cls(others + toxic, toxic, bad, good)

    def judged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By feature: chance of toxicity, evidence (none where one document at most has it) and share of toxic documents."""
        base = min(max(self.toxic / max(1, self.n), 1e-6), 1 - 1e-6)
        k, good = self.bad.astype(float), self.good.astype(float)
        share = k / np.maximum(k + good, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = k * np.log(share / base) + np.where(good > 0, good * np.log((1 - share) / (1 - base)), 0.0)
        return (k + 0.5) / (k + good + 1), np.where((k > 1) & (share > base), ratio, -np.inf), share


def place_of(digest: int, label: int) -> int:
    """Place of a document's counts: its part in cross-validation, and its label."""
    return 2 * (digest % PARTS) + label


def eligible(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Which features the widest limits choose, from all parts or from all but one."""
    out = np.zeros(len(counts), bool)
    for without in (None, *range(PARTS)):
        _, ratio, share = Tally.of(counts, totals, without).judged()
        out |= (ratio >= EVIDENCE[0]) & (share >= LEAST_SHARE[0])
    return out


def features_of(words: Iterable[str], of_word: Callable[[str], list[str]] = features) -> set[str]:
    return set().union(*map(of_word, words))


class Trial:
    """By limits: whether a document is judged wrong by the counts of the other parts, and whether it has no feature that all parts choose."""

    def __init__(self, names: list[str], counts: np.ndarray, totals: np.ndarray):
        self.numbers = {f: i for i, f in enumerate(names)}
        self.of_word = WordCache(lambda w: [i for f in features(w) if (i := self.numbers.get(f)) is not None])
        self.judged = [Tally.of(counts, totals, part).judged() for part in (*range(PARTS), None)]
        self.evidence, self.least = np.array(LIMITS).T

    def chosen(self, part: int, found: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The chances of these features, and by feature and limits which are chosen."""
        p, ratio, share = (x[found][:, None] for x in self.judged[part])
        return p, (ratio >= self.evidence) & (share >= self.least)

    def of_document(self, words: list[str], place: int) -> tuple[np.ndarray, np.ndarray]:
        found, starts = [], []
        for mine in map(self.of_word.__getitem__, words):
            if mine:
                starts.append(len(found))
                found += mine
        if not found:
            return np.full(len(LIMITS), bool(place % 2)), np.ones(len(LIMITS), bool)
        p, chosen = self.chosen(place // 2, found)
        best = np.maximum.reduceat(np.where(chosen, p, 0.0), starts, axis=0)
        return (1 - np.multiply.reduce(1 - best, axis=0) >= THRESHOLD) != bool(place % 2), ~self.chosen(PARTS, found)[1].any(axis=0)

    def sums(self, docs: Iterable[tuple[list[str], int]]) -> np.ndarray:
        """Numbers of documents by limits: wrong ones, then ones without features, other ones and toxic ones each."""
        out = np.zeros((len(LIMITS), 4), int)
        for words, place in docs:
            wrong, bare = self.of_document(words, place)
            out[:, place % 2] += wrong
            out[:, 2 + place % 2] += bare
        return out


def chosen_limits(sums: np.ndarray, totals: np.ndarray) -> int:
    """The place in LIMITS of those with the least balanced error (ties: the strictest)."""
    good, bad = np.maximum(1, totals.reshape(PARTS, 2).sum(axis=0)).tolist()
    return min(range(len(LIMITS)), key=lambda i: (int(sums[i, 0]) / good + int(sums[i, 1]) / bad, -LIMITS[i][0], -LIMITS[i][1]))


def chance(shares: list[float], without: float) -> float:
    """Noisy-or of the words' chances and the chance of a document without features."""
    clean = 1 - without
    for p in shares:
        clean *= 1 - p
    return 1 - clean


class Model:
    """Chance of toxicity by feature, chance without any, and the character model."""

    def __init__(self, rows: Iterable[tuple[str, int]] = ()):
        """Learn from a few rows (text, label) in memory what ``fit`` learns from tables."""
        texts = without_copies(rows)
        words = Counter(w for text in texts.values() for w in plain_words(text)).items()
        self.characters = CharacterModel(grams(words, alphabet(letters_of(words))))
        self.shares: dict[str, float] = {}
        self.without, self.limits = 0.0, None
        docs = [(said(text, self.characters), place_of(*key)) for key, text in texts.items()]
        totals = np.bincount([place for _, place in docs], minlength=2 * PARTS) if docs else np.zeros(2 * PARTS, int)
        if not totals[1::2].sum():
            return
        tally: dict[str, np.ndarray] = {}
        for found, place in docs:
            for f in features_of(found):
                tally.setdefault(f, np.zeros(2 * PARTS, int))[place] += 1
        names, counts = list(tally), np.array(list(tally.values()))
        self.choose(names, counts, totals, Trial(names, counts, totals).sums(docs))

    def choose(self, names: list[str], counts: np.ndarray, totals: np.ndarray, sums: np.ndarray) -> None:
        """Limits by the trial's sums, and the features that they choose."""
        best = chosen_limits(sums, totals)
        self.limits = LIMITS[best]
        p, ratio, share = Tally.of(counts, totals).judged()
        self.shares = {names[i]: float(p[i]) for i in np.flatnonzero((ratio >= self.limits[0]) & (share >= self.limits[1])).tolist()}
        others, toxic = sums[best, 2:].tolist()
        self.without = (toxic + 0.5) / (others + toxic + 1)

    def word_share(self, word: str) -> float:
        return max((self.shares.get(f, 0.0) for f in features(word)), default=0.0)


class Scorer:
    """Scores texts; one per Python worker and model, with a cache of words."""

    def __init__(self, model: Model):
        self.model = model
        self.cache = WordCache(self._entry)

    def _entry(self, token: str) -> tuple[tuple[str, float], ...] | None:
        found = tuple((w, p) for w in restored(token, self.model.characters) if (p := self.model.word_share(w)))
        return found or None

    def score(self, text: str) -> float:
        text = text.lower()
        cache = self.cache
        found = dict(x for t in set(text.split()) if (hits := cache[t]) for x in hits)
        for word in spaced_words(text, self.model.characters):
            if p := self.model.word_share(word):
                found[word] = p
        return chance(list(found.values()), self.model.without)


def scorer(digest: str, packed: bytes) -> Scorer:
    return one_per_worker(f"toxic {digest}", lambda: Scorer(pickle.loads(packed)))


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def known_labels(labels: DataFrame, rows: int | None) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known if rows is None else known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sieved(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose doc_id may be one of ``ids``: a bit of each id's hash is broadcast, SIEVE words in all, so no text without a label is shuffled. Others may pass, too."""
    word, bit = F.pmod(F.shiftright(F.xxhash64("doc_id"), 6), F.lit(SIEVE)), F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")
    bits = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return texts.withColumn("word", word).join(F.broadcast(bits), "word").filter(F.col("bits").bitwiseAND(bit) != 0).select(texts.columns)


def marked(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, digest, marks) of the documents with a label, and some others."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")

    def make():
        return lambda rows: {"digest": [digest_of(t) for t in rows["text"]], "marks": [marks_of(t) for t in rows["text"]]}

    return map_chunks(sieved(texts, known), make, "doc_id long, text string, digest long, marks array<long>", keep=("doc_id", "text"))


def copies(rows: DataFrame) -> DataFrame:
    """(digest, toxic) of the rows (digest, toxic, marks) that ``without_copies`` leaves out."""
    each = rows.select("digest", "toxic", F.posexplode("marks").alias("at", "mark"))
    firsts = each.groupBy("toxic", "at", "mark").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    others = each.join(firsts, ["toxic", "at", "mark"]).filter("first <> digest")
    return others.groupBy("digest", "toxic", "first").count().filter(F.col("count") >= COPY).select("digest", "toxic").distinct()


def tallied(df: DataFrame, text: str, make: Callable[[], Callable], places: int = 1) -> DataFrame:
    """(key, n0, n1, ...): for each place how often a key was counted. The function that ``make()`` builds gives (place, keys or their numbers) from chunks of rows.

    A task adds up what it counts and hands it on when it holds much, so that one row for a key and a place is shuffled for many texts.
    """

    def handed(held: list[Counter]):
        for place, counter in enumerate(held):
            keys, numbers = list(counter), list(counter.values())
            counter.clear()
            for at in range(0, len(keys), HANDED):
                part = slice(at, at + HANDED)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.string()), pa.array([place] * len(keys[part]), pa.int32()), pa.array(numbers[part], pa.int64())], names=["key", "place", "n"])

    def run(batches):
        count, held, chars = make(), [Counter() for _ in range(places)], 0
        for rows in text_chunks(batches, text):
            for place, keys in count(rows):
                held[place].update(keys)
            chars += sum(map(len, rows[text]))
            if chars > HELD_CHARS or sum(map(len, held)) > HELD_KEYS:
                yield from handed(held)
                chars = 0
        yield from handed(held)

    counted = df.mapInArrow(run, "key string, place int, n long")
    return counted.groupBy("key").agg(*[F.sum(F.when(F.col("place") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(places)])


def character_model(texts: DataFrame, folder: str) -> CharacterModel:
    tallied(texts, "text", lambda: lambda rows: ((0, plain_words(t)) for t in rows["text"])).write.parquet(f"{folder}/vocabulary")
    words = texts.sparkSession.read.parquet(f"{folder}/vocabulary")
    letters = tallied(words, "key", lambda: lambda rows: [(0, letters_of(zip(rows["key"], rows["n0"])))])
    known = alphabet({r["key"]: r["n0"] for r in letters.orderBy(F.desc("n0"), "key").limit(ALPHABET).collect()})
    three = tallied(words, "key", lambda: lambda rows: [(0, grams(zip(rows["key"], rows["n0"]), known))])
    return CharacterModel({r["key"]: r["n0"] for r in three.collect()})


def fit(documents: DataFrame, labels: DataFrame, rows: int | None = None) -> Model:
    """Learn from all labelled documents outside the held-out fold (from ``rows`` ids with the smallest hashes, if that is asked for).

    What goes between the jobs lies in the folder named in spark.checkpoint.dir until the model is made.
    """
    spark = documents.sparkSession
    folder = f"{shared_folder(spark)}/toxic-{uuid.uuid4().hex}"
    try:
        return fitted(documents, known_labels(labels, rows), folder)
    finally:
        remove(spark, folder)


def fitted(documents: DataFrame, known: DataFrame, folder: str) -> Model:
    spark = documents.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    model = Model()
    labelled = stored(marked(documents, known), "marked")
    rows = stored(labelled.select("doc_id", "digest", "marks").join(known, "doc_id").groupBy("digest", "toxic").agg(F.first("marks").alias("marks")), "rows")
    kept = rows.select("digest", "toxic").join(copies(rows), ["digest", "toxic"], "left_anti")
    place = (2 * F.pmod("digest", F.lit(PARTS)) + F.col("toxic")).cast("int").alias("place")
    texts = stored(labelled.groupBy("digest").agg(F.first("text").alias("text")).join(kept, "digest").select("text", place), "texts")
    remove(spark, f"{folder}/marked")
    model.characters = character_model(texts, folder)
    totals = np.zeros(2 * PARTS, int)
    for r in texts.groupBy("place").count().collect():
        totals[r["place"]] = r["count"]
    if not totals[1::2].sum():
        return model

    characters = spark.sparkContext.broadcast(model.characters)

    def read():
        cache = one_per_worker(f"toxic words {folder}", lambda: WordCache(lambda t: restored(t, characters.value)))
        return lambda rows: {"words": [" ".join(said(t, characters.value, cache)) for t in rows["text"]]}

    docs = stored(map_chunks(texts, read, "words string, place int", keep=("place",)), "words")
    remove(spark, f"{folder}/texts")

    def count():
        of_word = WordCache(features, FEATURE_ENTRIES).__getitem__
        return lambda rows: ((place, features_of(words.split(), of_word)) for words, place in zip(rows["words"], rows["place"]))

    counted = tallied(docs, "words", count, 2 * PARTS)
    columns = [f"n{i}" for i in range(2 * PARTS)]

    def possible(batches):
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            yield batch.filter(pa.array(eligible(counts, totals)))

    several = counted.filter(sum((F.col(c) for c in columns[1::2]), F.lit(0)) > 1)
    kept = several.mapInArrow(possible, several.schema).toArrow()
    names, counts = kept.column("key").to_pylist(), np.stack([kept.column(c).to_numpy() for c in columns], axis=1)
    del kept

    sent = spark.sparkContext.broadcast((names, counts, totals))

    def tried(batches):
        trial = one_per_worker(f"toxic trial {folder}", lambda: Trial(*sent.value))
        sums = trial.sums((words.split(), place) for rows in text_chunks(batches, "words") for words, place in zip(rows["words"], rows["place"]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(LIMITS)), pa.int32()), *map(pa.array, sums.T)], names=["at", *measures])

    measures, sums = ["s0", "s1", "s2", "s3"], np.zeros((len(LIMITS), 4), int)
    for r in docs.mapInArrow(tried, "at int, s0 long, s1 long, s2 long, s3 long").groupBy("at").agg(*[F.sum(c).alias(c) for c in measures]).collect():
        sums[r["at"]] = r[1:]
    model.choose(names, counts, totals, sums)
    for x in (characters, sent):
        x.destroy()
    return model


def with_score(documents: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """The documents, their columns numbered, with one more; and that one's name. No shuffle."""
    packed = pickle.dumps(model)
    digest = hashlib.sha256(packed).hexdigest()
    sent = documents.sparkSession.sparkContext.broadcast(packed)
    docs, called = numbered(documents, "text")
    text, score = called["text"], "score"

    def make():
        work_on = scorer(digest, sent.value)
        return lambda rows: {score: [work_on.score(t) for t in rows[text]]}

    return map_chunks(docs.withColumn(text, F.col(text).cast("string")), make, StructType([*docs.schema, StructField(score, DoubleType())]), text, docs.columns), score


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted. No shuffle."""
    docs, score = with_score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return docs.toDF("doc_id", "text", score).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def reject(documents: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    docs, score = with_score(documents, model)
    return docs.filter(F.col(score) < THRESHOLD).drop(score).toDF(*documents.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))
