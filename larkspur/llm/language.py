"""Language identification: script ranges, per-word scores, and a Viterbi path with a switching penalty.

A word's score for a language is the log-likelihood of its letter trigrams, word ends included. The script of its letters narrows the
languages to those that use the script in training. The best path through a text's words, with PENALTY for each change of
language, labels spans; the language of most letters is the document's.

A text where no other language could pay for its switches needs no path search: that is tested exactly, by the largest gain of
any stretch of words, and gives the same labels.

The trigram table is fitted on the driver on a bounded sample of labelled rows (FIT_ROWS and FIT_BYTES, by a hash of doc_id). Every whole text is
labelled.

Defined results: null texts and texts without a letter are ``und`` with score 0; null languages are not learned from; without training rows all is
``und``; ties go to the language of smaller name; repeated rows get equal results; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import FIT_BYTES, BatchCache, bounded_sample, distinct_words, gathered, map_chunks, one_per_worker, table

FIT_ROWS = 4000
FOLDS, HELD_OUT = 5, 0
#: Cost of changing the language between two words, in natural logarithms.
PENALTY = 12.0
#: Share of a language's letters from which it counts as using a script.
SCRIPT_SHARE = 0.001
UNDETERMINED = "und"
_letters = re.compile(r"[^\W\d_]+").findall
_letter = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=100_000)
def script(letter: str) -> str:
    """The script range of a letter, by the first word of its Unicode name (LATIN, CYRILLIC, CJK, ...)."""
    return unicodedata.name(letter, "UNKNOWN").split(" ")[0].split("-")[0]


def script_of(word: str) -> str:
    """The script of most of its letters (ties: that of the first)."""
    if word.isascii():
        return "LATIN"
    return Counter(map(script, word)).most_common(1)[0][0]


class Model:
    """Trigram log-probabilities by language, and the languages of each script."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in rows})
        place = {lang: i for i, lang in enumerate(self.languages)}
        counts: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(place))
        scripts = [Counter() for _ in place]
        words = [Counter() for _ in place]
        for text in sorted(set(rows)):  # copies count once
            words[place[text[1]]].update(_letters(text[0].lower()))
        for i, seen in enumerate(words):
            for word, n in seen.items():
                scripts[i][script_of(word)] += n * len(word)
                for gram in trigrams(word):
                    counts[gram][i] += n
        totals = [sum(c[i] for c in counts.values()) for i in range(len(place))]
        floor = [math.log(0.5 / (t + 0.5 * len(counts) + 1)) for t in totals]
        size = 0.5 * len(counts) + 1
        # row 0 is for unknown trigrams
        self.grams = {g: i for i, g in enumerate(counts, 1)}
        self.table = np.array([floor, *([math.log((n + 0.5) / (t + size)) for n, t in zip(c, totals)] for c in counts.values())]).reshape(1 + len(counts), len(place))
        self.allowed: dict[str, np.ndarray] = {}
        for name in {s for c in scripts for s in c}:
            self.allowed[name] = np.array([c[name] >= SCRIPT_SHARE * max(1, sum(c.values())) for c in scripts])

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word (at least one) by language; languages that do not use the word's script are far below the others."""
        get = self.grams.get
        padded = [f"^{w}$" for w in words]
        places = np.array([get(p[i : i + 3], 0) for p in padded for i in range(len(p) - 2)])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.add.reduceat(self.table[places], np.cumsum(sizes) - sizes, axis=0)
        anything = np.ones(out.shape[1], bool)
        fits = np.array([f if (f := self.allowed.get(script_of(w), anything)).any() else anything for w in words])
        return np.where(fits, out, out.min(axis=1, keepdims=True) - 2 * PENALTY)


def trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path (ties: the smaller index)."""
    n, languages = scores.shape
    best = int(scores.sum(axis=0).argmax())
    gain = scores - scores[:, best : best + 1]
    total = np.vstack([np.zeros(languages), gain.cumsum(axis=0)])
    # what stretches in other languages gain over the best: a path of c changes has c - 1 of them inside at most, and one at either end
    # of the text; so none pays if an inner one gains no more than a change costs and the two at the ends less together
    if (total - np.minimum.accumulate(total, axis=0)).max() <= penalty and total.max() + (total[-1] - total).max() < penalty:
        return np.full(n, best)
    rows = scores.tolist()
    value, before = rows[0], []
    for row in rows[1:]:
        before.append(value)
        least = max(value) - penalty  # a language below it is left for the best one
        value = [(v if v >= least else least) + s for v, s in zip(value, row)]
    path = [value.index(max(value))]
    for value in reversed(before):
        k, top = path[-1], max(value)
        path.append(k if value[k] >= top - penalty else value.index(top))
    return np.array(path[::-1])


#: Rows and code points that are labelled at once.
ROWS, CHARS = 4096, 4_000_000


class Labeller:
    """Labels texts; one per Python worker and model, with a cache of blank-separated words."""

    def __init__(self, model: Model):
        self.model, self.width = model, 1 + len(model.languages)
        self.cache = BatchCache(self._entries)

    def _entries(self, tokens: list[str]) -> list[bytes]:
        """Letters, then the scores of the languages; empty where there is no letter."""
        found = [_letters(t) for t in tokens]
        words = [w for f in found for w in f]
        if not words:
            return [b""] * len(tokens)
        rows = np.column_stack([np.fromiter(map(len, words), float, len(words)), self.model.scores(words)])
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        some = sizes > 0
        data = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0).tobytes()
        wide = 8 * self.width
        ends = (np.cumsum(some) * wide).tolist()
        return [data[e - wide : e] if n else b"" for n, e in zip(sizes.tolist(), ends)]

    def tables_of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the rows (letters, scores of the languages) of its words with letters; a word is looked up once for all texts."""
        words, numbers, offsets = distinct_words([t.lower() for t in texts])
        rows, ends = gathered(self.cache.many(words), numbers, 8 * self.width)
        places, rows = ends[offsets].tolist(), rows.view(np.float64).reshape(-1, self.width)
        return [rows[a:b] for a, b in zip(places, places[1:])]

    def label(self, text: str) -> tuple[str, float]:
        return self.labels([text])[0]

    def labels(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text: the score is its share of the letters times its posterior over those words."""
        if self.width == 1:
            return [(UNDETERMINED, 0.0)] * len(texts)
        return [self._label(rows)[:2] if len(rows) else (UNDETERMINED, 0.0) for rows in self.tables_of(texts)]

    def labels_and_spans(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; a text of one language is one span, whose ends are looked for only."""
        if self.width == 1:
            return [(UNDETERMINED, 0.0, [])] * len(texts)
        out = []
        for text, rows in zip(texts, self.tables_of(texts)):
            if not len(rows):
                out.append((UNDETERMINED, 0.0, []))
                continue
            name, score, mixed = self._label(rows)
            out.append((name, score, self.spans(text) if mixed else [(*lettered(text), name)]))
        return out

    def _label(self, rows: np.ndarray) -> tuple[str, float, bool]:
        path = best_path(rows[:, 1:])
        letters = np.bincount(path, weights=rows[:, 0], minlength=self.width - 1)
        best = int(letters.argmax())
        sums = rows[path == best, 1:].sum(axis=0)
        posterior = 1 / np.exp(np.minimum(sums - sums[best], 50)).sum()
        return self.model.languages[best], float(min(1.0, letters[best] / letters.sum() * posterior)), bool((path != path[0]).any())

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of maximal stretches, in code points, from the first letter-bearing word to the last."""
        lowered = text.lower() if len(text.lower()) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", lowered)]
        entries = dict(zip(words := list({lowered[a:b] for a, b in tokens}), self.cache.many(words)))
        places = [(a, b) for a, b in tokens if entries[lowered[a:b]]]
        if not places or self.width == 1:
            return []
        path = best_path(np.frombuffer(b"".join([entries[lowered[a:b]] for a, b in places])).reshape(-1, self.width)[:, 1:])
        out: list[tuple[int, int, str]] = []
        for (a, b), k in zip(places, path.tolist()):
            name = self.model.languages[k]
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], b, name)
            else:
                out.append((a, b, name))
        return out


def lettered(text: str) -> tuple[int, int]:
    """From where the first word with a letter begins to where the last one ends."""
    first, end = _letter.search(text), len(text)
    if first is None:  # its lower case alone has letters
        return 0, end
    start = first.start()
    while start and not text[start - 1].isspace():
        start -= 1
    while not _letter.match(text[end - 1]):
        end -= 1
    while end < len(text) and not text[end].isspace():
        end += 1
    return start, end


def labeller(digest: str, packed: bytes) -> Labeller:
    return one_per_worker(f"language {digest}", lambda: Labeller(pickle.loads(packed)))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(documents: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from at most ``rows`` documents (and FIT_BYTES of text) with a language outside the held-out fold, those with the smallest hashes of doc_id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    found = bounded_sample(known, rows, FIT_BYTES).select("text", "lang").distinct().collect()
    return Model([(r["text"], r["lang"]) for r in found])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (start:end:language of each stretch, in code points, by commas). No shuffle."""
    packed = pickle.dumps(model)
    digest = hashlib.sha256(packed).hexdigest()
    sent = documents.sparkSession.sparkContext.broadcast(packed)

    def make():
        by = labeller(digest, sent.value)

        def work(rows):
            found = by.labels_and_spans(rows["text"])
            spans = [",".join(f"{a}:{b}:{name}" for a, b, name in x[2]) for x in found]
            return {"doc_id": rows["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": spans}

        return work

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = map_chunks(docs, make, "doc_id long, lang_pred string, score double, spans string", most_rows=ROWS, most_chars=CHARS)
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, fit(documents))
