"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the adjacent pairs of a word's symbols, each with its merge rank and place; an inner node
holds the smaller of its children, so the root is the leftmost pair of lowest rank. A merge rewrites three
leaves and the paths above them, O(log n), until no pair is mergeable.

Vocabulary files are read at run time from a path; they are public and never copied here.

Tables of Unicode differ by version. Texts that hold a code point which Unicode 3.2 did not know are normalised and split into words by the
tokenizers library itself; about all other code points, all versions agree.

Defined results: null text counts as empty (no tokens, digests of nothing); repeated rows each give
a row; every column but the two named is ignored, so clashing names are harmless; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm.common import WordCache, map_chunks, one_per_worker, table

VOCABULARY = "word_bpe_49k.json"
#: A leaf is its pair's rank << 32 | place; NONE lies above all of them.
NONE, PLACE = 1 << 62, (1 << 32) - 1
#: Runs remembered by a Python worker, some 250 bytes each.
ENTRIES = 800_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class SegmentTree:
    """Minimum over the ranks of adjacent pairs; ``tree[1]`` is the best one, NONE if there is none."""

    def __init__(self, leaves: list[int]):
        size = 1 << (len(leaves) - 1).bit_length()
        rows = [leaves + [NONE] * (size - len(leaves))]
        while len(rows[-1]) > 1:
            below = rows[-1]
            rows.append(list(map(min, below[::2], below[1::2])))
        tree = [NONE]
        for row in reversed(rows):
            tree += row
        self.tree, self.size = tree, size

    def put(self, i: int, value: int) -> None:
        tree = self.tree
        i += self.size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            if tree[i] == value:
                return
            tree[i] = value


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def newer() -> re.Pattern:
    """A code point that Unicode 3.2 had not assigned."""
    known = unicodedata.ucd_3_2_0.category
    points = [i for i in range(0x110000) if known(chr(i)) in ("Cn", "Cs")]
    starts = [i for i, before in zip(points, [-2, *points]) if i != before + 1]
    ends = [i for i, after in zip(points, [*points[1:], -2]) if i + 1 != after]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]")


def lower(text: str) -> str:
    """Lower case letter by letter; str.lower() looks around a capital sigma."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordBpe:
    """Encoder and decoder of a BPE vocabulary with word ends, lower case, and dropped white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab.get(c) for c in letters]
        self.final = [vocab.get(c + end) for c in letters]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank << 32
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # the vocabulary's own splitting pattern, with white space spelt out as the Unicode property
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.whole = None not in self.inner and None not in self.final
        self.cache = WordCache(self._entry, ENTRIES)
        self.newer = newer().search
        self.tokenizer = Tokenizer.from_file(path)
        # what str.split() takes for white space and the vocabulary does not
        self.odd_space = re.compile("[\x1c-\x1f]")

    def merge(self, ids: list[int]) -> list[int]:
        """Merge a word's symbols as far as the ranks go."""
        n = len(ids)
        get, merged = self.ranks.get, self.merged
        leaves = [get(a << 20 | b, NONE) | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        if not leaves or min(leaves) >= NONE:
            return ids
        segments = SegmentTree(leaves)
        tree, put = segments.tree, segments.put
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) < NONE:
            i = best & PLACE
            j = after[i]
            new = ids[i] = merged[best >> 32]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(j, NONE)
                put(i, get(new << 20 | ids[k], NONE) | i)
            else:
                put(i, NONE)
            p = before[i]
            if p >= 0:
                put(p, get(ids[p] << 20 | new, NONE) | p)
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "replace")
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        return self.merge(ids if self.whole else [x for x in ids if x is not None])

    def _coded(self, word: str) -> tuple[bytes, str]:
        ids, tokens = self.encode_word(word), self.tokens
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([tokens[x] for x in ids])

    def _entry(self, run: str) -> tuple[bytes, str] | None:
        """(little-endian ids, decoded tokens) of a run without white space; None if it holds a newer code point."""
        if not run.isascii() and self.newer(run):
            return None
        if run.isalpha():
            return self._coded(run)
        words = self.words.findall(run)
        if len(words) == 1:
            return self._coded(words[0])
        parts = [self.cache[w] for w in words]  # words of one kind of character: they do not split further
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(little-endian ids, decoded tokens) of each word; special tokens in the text are words of their own."""
        if self.cut is not None and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append((self.special[m[0]].to_bytes(4, "little"), m[0]))
                at = m.end()
            return out + self._plain(text[at:])
        return self._plain(text)

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        low = lower(unicodedata.normalize("NFC", text))
        # no word of the pattern spans white space, so whole blank-separated runs can be remembered
        runs = self.words.findall(low) if self.odd_space.search(low) else low.split()
        cache = self.cache
        found = [cache[w] for w in runs]
        return self._by_library(text) if None in found else found

    def _by_library(self, text: str) -> list[tuple[bytes, str]]:
        """The same with the library's own normaliser and word splitter, for texts about which tables of Unicode differ."""
        plain = self.tokenizer.normalizer.normalize_str(text.encode("utf-8", "replace").decode())
        return [self._coded(plain[a:b]) for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_bytes(self, text: str) -> bytes:
        return b"".join([p[0] for p in self.pieces(text)])

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included; unknown ids are left out."""
        return " ".join(self.tokens[x] for x in ids if x in self.tokens)


def load(path: str) -> WordBpe:
    """One encoder, with its word cache, per Python worker."""
    return one_per_worker(f"bpe {path}", lambda: WordBpe(path))


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256. No shuffle."""
    path = path or vocabulary_path()

    def make():
        bpe = load(path)

        def work(rows):
            out = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in rows["text"]:
                pieces = bpe.pieces(text)
                ids = b"".join([p[0] for p in pieces])
                decoded = " ".join([p[1] for p in pieces if p[1]])
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            return out

        return work

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_chunks(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
