"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a batch, in byte order, are the leaves of a trie in depth-first order: stepping from one
word to the next backtracks to their longest common prefix and descends again. Each trie node (a prefix) carries
one state, the last token of the prefix's encoding, and is visited once however many words share it. The encoding of
a prefix is the encoding of what precedes its last token, followed by that token, so the states along a path are all
that is needed to read a word's ids back.

A node's last token is the token ``t`` that ends there and is compatible with the state of the node where ``t``
starts. Two tokens are compatible if merging their joined bytes gives the two back. In a merge table whose
tokens are each the encoding of their own bytes, a sequence of pairwise compatible tokens is the encoding, so
exactly one token qualifies at each node.

Defined results: a null text encodes as the empty text; an empty text has no ids; special tokens of the
vocabulary that occur literally in a text are that one id, as the public library does; very long texts and very long words or runs of
white space are encoded whole, in time linear in their length; repeated and null ids each get their row's result; an empty table gives no rows; other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks, record_batch, texts

#: Fixed values of byte-level BPE: the pattern that splits text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept with their ids in each Python worker, code points of the longest of them, and compatible pairs kept; beyond, the store starts anew.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 64, 1_000_000
#: The state of the root; ids are below it.
NONE = (1 << 17) - 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_alphabet()
        raw = {t: bytes(as_byte[c] for c in t) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw[a], raw[b]): r for r, (a, b) in enumerate(merges)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *special.values()]))
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        #: By the two bytes at a token's end: the length of the longest such token.
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[-2:]] = max(len(b), self.longest.get(b[-2:], 1))
        self.word_pattern = regex.compile(WORDS)
        self.special = {s: np.uint32(i).tobytes() for s, i in special.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.known: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def merged(self, word: bytes) -> list[bytes]:
        """The merge procedure itself, for the few bytes of a pair of tokens."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            pair = (parts[best[1]], parts[best[1] + 1])
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def compatible(self, pair: int) -> bool:
        """Whether two tokens, ``a << 17 | b``, follow each other in an encoding; ``NONE`` before a word's first."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        x, y = self.bytes_of[pair >> 17] if pair >> 17 != NONE else b"", self.bytes_of[pair & NONE]
        said = self.fits[pair] = self.merged(y) == [y] and (not x or self.merged(x + y) == [x, y])
        return said

    def traverse(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Depth-first over the trie of distinct words in byte order; yields each word's ids."""
        last = [NONE]  # of the node at each depth of the current path
        before, get, longest, fits = b"", self.ids.get, self.longest.get, self.fits.get
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[1 + shared :]
            for end in range(shared + 1, len(word) + 1):
                most = longest(word[end - 2 : end], 1) if end > 1 else 1
                for start in range(end - most if end > most else 0, end):
                    if (t := get(word[start:end])) is not None:
                        pair = last[start] << 17 | t
                        if (said := fits(pair)) or said is None and self.compatible(pair):
                            last.append(t)
                            break
                else:
                    raise ValueError(f"the vocabulary can't encode {word[:end]!r}")
            ids, end = [], len(word)
            while end:
                ids.append(t := last[end])
                end -= len(self.bytes_of[t])
            ids.reverse()
            yield ids
            before = word

    def split(self, text: str) -> list[str]:
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.word_pattern.findall(text)
        out: list[str] = []
        for k, piece in enumerate(self.special_pattern.split(text)):
            out += [piece] if k % 2 else self.word_pattern.findall(piece)
        return out

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in batch]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known, long = self.known, {}
        new = {w for words in split for w in words if w not in known}
        known.update({s: new_ids for s, new_ids in self.special.items() if s in new})
        pairs = sorted((w.encode("utf-8", "surrogatepass"), w) for w in new if w not in self.special)
        for (_, word), ids in zip(pairs, self.traverse(b for b, _ in pairs), strict=True):
            (known if len(word) <= KEPT_LENGTH else long)[word] = struct.pack(f"<{len(ids)}I", *ids)
        if long:
            return [b"".join([known[w] if w in known else long[w] for w in words]) for words in split]
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(2)
def encoder(path: str) -> TrieEncoder:
    """One for each Python worker."""
    return TrieEncoder(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids``, binary: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(b, "text"):
                ids = encoder(path).encode_batch(c.column("text").to_pylist())
                yield record_batch("doc_id long, ids binary", [c.column("doc_id"), ids])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of ``doc_id``, ``ids``; a null ``ids`` decodes as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [encoder(path).decode(i or b"") for i in b.column("ids").to_pylist()]
            yield record_batch("doc_id long, text string", [b.column("doc_id"), text])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode and digest in one pass, so that neither ids nor texts travel: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    spec = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for c in chunks(b, "text"):
                ids = enc.encode_batch(c.column("text").to_pylist())
                digests = [hashlib.sha256(i).hexdigest() for i in ids]
                decoded = [hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids]
                yield record_batch(spec, [c.column("doc_id"), [len(i) // 4 for i in ids], digests, decoded])

    return texts(docs).mapInArrow(run, spec)
