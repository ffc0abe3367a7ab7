"""Quality rules: measured limits first, then a logistic regression over hashed word and character n-grams.

Words and characters of a text are counted as n-grams (one and two words; two, three and four characters), hashed into SLOTS places. A word behind an equal word
is one and the same n-gram whatever the word, so repetition is seen in any language. A text's features are the shares of its n-grams, so its length does not matter, and
its score is the sum of each family's mean weight: a look-up for each n-gram, on whole Arrow batches.

Weights are fitted on the driver (limited-memory BFGS) on a bounded sample of labelled rows (FIT_ROWS and FIT_BYTES, by a hash of doc_id) that executors have turned into
counts; scores are turned into probabilities by a sigmoid that is fitted to out-of-fold scores within that sample (Platt). KEEP_AT is fixed. Rows whose
crc32(doc_id) mod 5 is 0 are not learned from, so that errors can be measured on them.

Defined results: null and empty texts have no words and fail the first limit; a null id is scored like any other; labels other than 0 and 1 are not learned
from, of several labels of one id the largest holds, and equal texts of one label count once; with labels of one kind only every probability is
(good + 1) / (labels + 1), so 1 without any; repeated rows get equal results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_sample, map_chunks, mix, one_per_worker, table

#: Labelled rows, and bytes of their texts, that the model is fitted on at most.
FIT_ROWS, FIT_BYTES = 4000, 5_000_000
FOLDS, HELD_OUT = 5, 0
#: Probability of good quality from which a text is kept.
KEEP_AT = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
SLOTS = 1 << 18
CHARACTERS = (2, 3, 4)
FAMILIES = 2 + len(CHARACTERS)
#: Scale of shares, ridge penalty, rounds, kept steps of the fit; parts of cross-validation.
SCALE, RIDGE, ROUNDS, MEMORY, PARTS = 30.0, 1e-3, 40, 8, 3
U = np.uint64


# --- words of a chunk of texts


class Words:
    """The words of some texts as numbers: ``number`` of each word, ``doc`` of each word, ``distinct`` words as bytes."""

    def __init__(self, texts: Sequence[str]):
        found = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))  # the six blanks and no other
        coded = found.flatten().dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.asarray(found.value_lengths()))
        self.distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        real = number != (self.distinct.index(b"") if b"" in self.distinct else -1)
        self.number, self.doc, self.texts = number[real], doc[real], len(texts)
        self.count = np.bincount(self.doc, minlength=len(texts))

    def together(self, n: int) -> np.ndarray:
        """Places at which ``n`` words of one text begin."""
        at = np.arange(max(0, len(self.number) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]]

    def repeated(self) -> np.ndarray:
        """For each text, its words in three-word windows that it has twice or more."""
        at = self.together(3)
        if not len(at):
            return np.zeros(self.texts, np.int64)
        size = len(self.distinct)
        _, pair = np.unique(self.number[at] * size + self.number[at + 1], return_inverse=True)
        _, window = np.unique(pair * size + self.number[at + 2], return_inverse=True)
        _, own, times = np.unique(window * self.texts + self.doc[at], return_inverse=True, return_counts=True)
        twice = at[times[own] > 1]
        covered = np.zeros(len(self.number), bool)
        for i in range(3):
            covered[twice + i] = True
        return np.bincount(self.doc[covered], minlength=self.texts)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def measures(texts: Sequence[str], words: Words) -> dict[str, list[int]]:
    """The measures of each text, and whether it fails a limit."""
    repeated = words.repeated()
    return {
        "n_words": words.count.tolist(),
        "word_chars": [len(t) - sum(map(t.count, BLANKS)) for t in texts],
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": repeated.tolist(),
        "base_failed": ((words.count < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words.count)).tolist(),
    }


# --- n-grams


def ngrams(texts: Sequence[str], words: Words):
    """For each family of n-grams: (place of each in the table, text of each)."""
    with np.errstate(over="ignore"):
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.distinct), U, len(words.distinct))
        of = hashes[words.number] if len(words.number) else np.zeros(0, U)
        yield slots(of), words.doc
        at = words.together(2)
        first, second = of[at], of[at + 1]
        yield slots(np.where(first == second, U(1), mix(first * U(3) + second))), words.doc[at]
        # code points of all texts, one behind the other
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        so_far = points + U(1)
        for n in range(2, max(CHARACTERS) + 1):
            # the hash of n characters is that of n - 1 and one more
            so_far = so_far[: max(0, len(so_far) - 1)] * U(0x9E3779B97F4A7C15) + points[n - 1 :] + U(n)
            if n in CHARACTERS:
                at = doc[: len(so_far)] == doc[n - 1 : n - 1 + len(so_far)]
                yield slots(mix(so_far[at])), doc[: len(so_far)][at]


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(SLOTS - 1)).astype(np.int64)


def scores(texts: Sequence[str], words: Words, weights: np.ndarray) -> np.ndarray:
    """For each text the sum over families of the mean weight of its n-grams, and the intercept (the weights' last)."""
    out = np.full(len(texts), float(weights[-1]))
    for place, doc in ngrams(texts, words):
        n = np.bincount(doc, minlength=len(texts))
        out += SCALE * np.bincount(doc, weights[place], len(texts)) / np.maximum(n, 1)
    return out


def shares(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, places of the table and the scaled shares that they have in the text: ``scores`` is their product with the weights."""
    parts = []
    for place, doc in ngrams(texts, Words(texts)):
        n = np.bincount(doc, minlength=len(texts))
        parts.append((doc * SLOTS + place, SCALE / np.maximum(n, 1)[doc]))
    key, share = (np.concatenate(x) for x in zip(*parts))
    once, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, share, len(once))
    ends = np.searchsorted(once, np.arange(len(texts) + 1) * SLOTS)
    return [((once[a:b] % SLOTS).astype(np.int32), total[a:b].astype(np.float32)) for a, b in zip(ends[:-1], ends[1:])]


# --- the fit


class Design:
    """Rows of (places, shares), one behind the other."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]):
        self.place = np.concatenate([np.zeros(0, np.int32), *(p for p, _ in rows)])
        self.share = np.concatenate([np.zeros(0, np.float32), *(s for _, s in rows)])
        self.row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p, _ in rows])
        self.rows = len(rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place] * self.share, self.rows) + weights[-1]

    def back(self, errors: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.place, errors[self.row] * self.share, SLOTS), errors.sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def logistic(design: Design, labels: np.ndarray) -> np.ndarray:
    """Weights and intercept of least ridge-penalised log loss, both kinds of labels weighing alike; limited-memory BFGS."""
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))

    def loss(w):
        x = design.times(w)
        gradient = design.back(weight * (sigmoid(x) - labels))
        gradient[:-1] += RIDGE * w[:-1]
        return float(weight @ np.logaddexp(0, np.where(labels == 1, -x, x)) + RIDGE / 2 * (w[:-1] @ w[:-1])), gradient

    w = np.zeros(SLOTS + 1)
    value, gradient = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        way, kept = -gradient, []
        for s, y in reversed(steps):
            a = s @ way / (s @ y)
            kept.append(a)
            way = way - a * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            way = way + (a - y @ way / (s @ y)) * s
        slope, length = gradient @ way, 1.0
        if slope > -1e-10:
            break
        after, turned = loss(w + way)
        while after > value + 1e-4 * length * slope and length > 1e-6:
            length /= 2
            after, turned = loss(w + length * way)
        s, y = length * way, turned - gradient
        w, value, gradient = w + s, after, turned
        if s @ y > 1e-12:
            steps = [*steps[1 - MEMORY :], (s, y)]
    return w


def calibrated(x: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the sigmoid that turns scores into probabilities: Newton's steps, targets drawn in a little so that none is 0 or 1."""
    good = labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    both, z = np.stack([x, np.ones(len(x))]), np.array([0.0, np.log((good + 1) / (len(labels) - good + 1))])
    loss = lambda z: float(np.logaddexp(0, z @ both).sum() - target @ (z @ both))
    for _ in range(50):
        p = sigmoid(z @ both)
        step = np.linalg.solve((both * (p * (1 - p))) @ both.T + 1e-9 * np.eye(2), both @ (p - target))
        length = 1.0
        while loss(z - length * step) > loss(z) and length > 1e-6:
            length /= 2
        z = z - length * step
        if np.abs(length * step).max() < 1e-9:
            break
    return float(z[0]), float(z[1])


class Model:
    """Weights and the calibrating sigmoid."""

    def __init__(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        self.weights, self.slope, self.offset = np.zeros(SLOTS + 1, np.float32), 0.0, 0.0
        if not labels.sum() or labels.all():
            share = (labels.sum() + 1) / (len(labels) + 1)  # 1 without labels
            self.offset = float(np.log(share / (1 - share))) if share < 1 else np.inf
            return
        outside = np.zeros(len(rows))
        for part in range(PARTS):
            held = np.arange(len(rows)) % PARTS == part
            w = logistic(Design([r for r, h in zip(rows, held) if not h]), labels[~held])
            outside[held] = Design([r for r, h in zip(rows, held) if h]).times(w)
        self.slope, self.offset = calibrated(outside, labels)
        self.weights = logistic(Design(rows), labels).astype(np.float32)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * x + self.offset)


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Learn from at most ``rows`` labelled documents (and ``size`` bytes of text) outside the held-out fold, those with the smallest hashes of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # ids and labels only; documents are read behind a filter on these ids
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sample = bounded_sample(texts.join(F.broadcast(picked), "doc_id"), rows, size).dropDuplicates(["text", "quality"])

    def counted(chunk):
        found = shares(chunk["text"])
        return {"doc_id": chunk["doc_id"], "quality": chunk["quality"], "place": [p for p, _ in found], "share": [s for _, s in found]}

    made = map_chunks(sample.select("doc_id", "text", "quality"), lambda: counted, "doc_id long, quality int, place array<int>, share array<float>").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    each = [(np.asarray(p.values), np.asarray(s.values)) for p, s in zip(made.column("place"), made.column("share"))]
    return Model(each, np.array(made.column("quality").to_pylist(), np.int64))


SCHEMA = "doc_id long, held_out boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean"


def judge(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, the measures, base_failed, quality (probability), kept, held_out of each document. No shuffle."""
    packed = pickle.dumps(model)
    name, sent = f"quality {hashlib.sha256(packed).hexdigest()}", documents.sparkSession.sparkContext.broadcast(packed)

    def make():
        model = one_per_worker(name, lambda: pickle.loads(sent.value))

        def work(chunk):
            texts = chunk["text"]
            words = Words(texts)
            found = measures(texts, words)
            p = model.probability(scores(texts, words, model.weights))
            kept = [not failed and q >= KEEP_AT for failed, q in zip(found["base_failed"], p.tolist())]
            return found | {"doc_id": chunk["doc_id"], "held_out": chunk["held_out"], "quality": p, "kept": kept}

        return work

    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return map_chunks(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held), make, SCHEMA)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return judge(documents, fit(documents, table(spark, sf_dir, "labels")))
