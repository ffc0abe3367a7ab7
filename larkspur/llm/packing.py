"""Packing of token sequences as vector bin packing with a dot-product heuristic.

A bin is a sequence with three limits at once: tokens, segments and loss-bearing tokens. It takes, again and again, the waiting example that
fits and has the largest dot product of its demands with the bin's remaining room, both as shares of the limits. When none fits, an example is
cut to fill the bin. A bin that stays below the full length (at the end of a partition, or where segments run out) is cut
into sequences of powers of two, which need no padding.

Every partition packs its own documents: no shuffle, memory bounded by POOL waiting remainders of less than a full sequence each. The
sequence ids carry the partition's number, so a task that runs again on another executor gives the same rows.

Defined results: null or empty text is a document of its end token alone; repeated rows are packed each; other columns are ignored; a null doc_id
stays null; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from larkspur.llm.bpe import lower, newer, vocabulary_path
from larkspur.llm.common import distinct_words, gathered, one_per_worker, table, text_chunks

TOKENS, SEGMENTS = 2048, 64
END_ID = 1
#: Remainders that wait at most before a bin is filled.
POOL = 1024
#: Words remembered by a Python worker, some 200 bytes each.
CACHE_ENTRIES = 800_000
#: Signs that form a word of their own behind letters (an apostrophe may not).
SIGNS = '.,;:!?()[]{}"#$%&*+-/<=>@\\^_`|~'
#: Stands for the ids of words about which tables of Unicode may differ.
NEWER = b"none"
#: Rows and code points that are encoded at once.
ROWS, CHARS = 4096, 3_000_000


class IdSource:
    """Ids of whole texts by the tokenizers library, remembered by blank-separated word."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words of letters in normal form and lower case, which need neither normalising nor splitting; what it is asked is
        # remembered here, so it need not remember it itself
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.letters.model._resize_cache(0)
        # a word's last token carries the vocabulary's mark of an end, no other does
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if mark:
            self.last[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.cache: dict[str, bytes] = {}
        self.newer = newer().search
        self.lone = re.compile("[\ud800-\udfff]").search
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # white space of str.split() that the vocabulary keeps, and special tokens: such texts go whole
        self.odd = ("\x1c", "\x1d", "\x1e", "\x1f", *special)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words; those of letters and signs behind them are made from these parts. NEWER: tables of Unicode may differ."""
        cache = self.cache
        letters, others, composed = [], [], []
        for w in words:
            if not w.isascii() and self.newer(w):
                cache[w] = NEWER
                continue
            if w.isalpha():
                letters.append(w)
                continue
            core = w.rstrip(SIGNS)
            if len(core) < len(w) and core.isalpha():
                composed.append((w, core, w[len(core) :]))
            else:
                others.append(w)
        inner = {c for _, c, _ in composed if c not in cache and c not in words}
        signs = {t for _, _, t in composed if t not in cache and t not in words}
        self._learn([*letters, *inner], True)
        self._learn([*others, *signs], False)
        for w, core, tail in composed:
            cache[w] = cache[core] + cache[tail]

    def _learn(self, words: list[str], letters: bool) -> None:
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            if letters:  # many in one text, told apart by their last tokens
                ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) != len(part):
                    self._learn(part, False)
                    continue
            else:  # one by one
                found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
                ids, ends = np.array(found.ids, np.uint32), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), side="right")
            data, ends = ids.tobytes(), (4 * ends).tolist()
            self.cache.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends], ends))

    def plain(self, text: str) -> str | None:
        """The text in lower case (the vocabulary lowers case itself; this way fewer words are to be remembered); None: it goes whole."""
        if any(x in text for x in self.odd):
            return None
        if text.isascii():
            return text.lower()
        # the vocabulary lowers case after normalising: where lower case is to be normalised again, that is not the same
        low = lower(unicodedata.normalize("NFC", text))
        return low if unicodedata.is_normalized("NFC", low) and not self.lone(low) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        lows = [self.plain(t) for t in texts]
        words, numbers, offsets = distinct_words([t for t in lows if t is not None])
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            for old in list(cache)[: CACHE_ENTRIES // 2]:
                del cache[old]
        parts = list(map(cache.get, words))
        if missing := {w for w, p in zip(words, parts) if p is None}:
            self.learn(missing)
            parts = [cache[w] if p is None else p for w, p in zip(words, parts)]
        newer = NEWER in parts and np.fromiter((p is NEWER for p in parts), bool, len(parts))
        ids, ends = gathered(parts, numbers, 4)
        before = np.concatenate([[0], np.cumsum(newer[numbers])]) if newer is not False else np.zeros(len(numbers) + 1)
        whole, places, data = np.diff(before[offsets]) > 0, (4 * ends[offsets]).tolist(), ids.tobytes()
        out, k = [], -1
        for text, low in zip(texts, lows):
            k += low is not None
            out.append(self.ids(text) if low is None or whole[k] else data[places[k] : places[k + 1]])
        return out


def id_source(path: str) -> IdSource:
    """One per Python worker."""
    return one_per_worker(f"packing {path}", lambda: IdSource(path))


class Packer:
    """Places examples of (key, ids, prompt length); the ids before the prompt length bear no loss."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, first_sequence: int = 0):
        self.limits = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.next = first_sequence
        self.size = np.zeros(0, np.int64)  # of each waiting remainder
        self.loss = np.zeros(0, np.int64)
        self.waiting: list[tuple] = []  # (key, ids, prompt length, start)
        self.out: list[tuple] = []

    @staticmethod
    def loss_of(prompt: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, prompt))

    def room_for(self, prompt: int, start: int, left: int, room: np.ndarray) -> int:
        """How many ids from ``start`` on the room takes."""
        return int(min(left, room[0], max(0, prompt - start) + room[2]))

    def add(self, key, ids: bytes, prompt: int = 0) -> None:
        n, start = len(ids) // 4, 0
        while n - start >= self.limits[0]:
            length = self.room_for(prompt, start, n - start, self.limits)
            self.close([(key, ids, prompt, start, length)])
            start += length
        if start < n:
            self.wait([(key, ids, prompt, start)])
        while len(self.waiting) > POOL:
            self.fill()

    def wait(self, items: list[tuple]) -> None:
        self.waiting += items
        left = [len(ids) // 4 - start for _, ids, _, start in items]
        self.size = np.append(self.size, left)
        self.loss = np.append(self.loss, [self.loss_of(p, s, n) for (_, _, p, s), n in zip(items, left)])

    def fill(self) -> None:
        """Fill one bin from the waiting remainders and close it."""
        room, held, gone = self.limits.copy(), [], np.zeros(len(self.waiting), bool)
        again = []
        size, loss = self.size / self.limits[0], self.loss / self.limits[2]
        while room[0] >= 1 and room[1] >= 1 and room[2] >= 1 and not gone.all():
            share = room / self.limits
            fits = ~gone & (self.size <= room[0]) & (self.loss <= room[2])
            if room[1] == 1:  # the last segment has to fill the bin, if anything can
                fits &= self.size == room[0]
            if fits.any():
                dot = np.where(fits, size * share[0] + share[1] / self.limits[1] + loss * share[2], -1.0)
                i = int(dot.argmax())
                key, ids, prompt, start = self.waiting[i]
                length = int(self.size[i])
            else:
                i = int(np.where(gone, -1, self.size).argmax())
                key, ids, prompt, start = self.waiting[i]
                length = self.room_for(prompt, start, int(self.size[i]), room)
                if length < self.size[i]:
                    again.append((key, ids, prompt, start + length))
            gone[i] = True
            held.append((key, ids, prompt, start, length))
            room -= (length, 1, self.loss_of(prompt, start, length))
        stay = np.flatnonzero(~gone)
        self.waiting = [self.waiting[i] for i in stay]
        self.size, self.loss = self.size[stay], self.loss[stay]
        if again:
            self.wait(again)
        self.close(held)

    def close(self, held: list[tuple]) -> None:
        """Write a bin's pieces as one full sequence, or as sequences of powers of two."""
        total = sum(length for *_, length in held)
        full = int(self.limits[0])
        sizes = [full] * (total // full) + [1 << b for b in reversed(range((total % full).bit_length())) if total % full >> b & 1]
        room, offset = sizes.pop(0), 0
        for key, ids, prompt, start, length in held:
            while length:
                part = min(length, room - offset)
                self.out.append((key, start, part, zlib.crc32(ids[4 * start : 4 * (start + part)]), len(ids) // 4, self.next, offset, self.loss_of(prompt, start, part)))
                start, length, offset = start + part, length - part, offset + part
                if offset == room:
                    self.next, offset, room = self.next + 1, 0, sizes.pop(0) if sizes else 0

    def finish(self) -> None:
        while self.waiting:
            self.fill()

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(documents: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt: str | None = None) -> DataFrame:
    """Pieces of the packed sequences: SCHEMA, a row for each piece. ``loss``: limit on loss-bearing tokens; ``prompt``: a column of prompt lengths in tokens."""
    path = path or vocabulary_path()
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        source = id_source(path)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 32)
        for rows in text_chunks(batches, most_rows=ROWS, most_chars=CHARS):
            for key, ids, before in zip(rows["doc_id"], source.encode(rows["text"]), rows["prompt"]):
                packer.add(key, ids + end, before or 0)
            if packer.out:
                yield _batch(packer.take())
        packer.finish()
        if packer.out:
            yield _batch(packer.take())

    before = F.lit(0) if prompt is None else F.col(f"`{prompt}`").cast("int")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), before.alias("prompt"))
    return docs.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
