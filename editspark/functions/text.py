"""Text normalisation, tokens and token weights.

Null texts count as empty. Tokens and counted words come from Arrow functions, which look words up instead of matching patterns at every character; all else is JVM-side column expressions.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


#: The characters of ``WS``.
SPACES = "".join(x for x in map(chr, range(0x3001)) if re.match(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), C.WS), x))


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included; looks at the ends alone, where a pattern would be tried at every character."""
    return F.btrim(c, F.lit(SPACES))


def standard_unit(token: Column) -> Column:
    units = F.create_map(*[F.lit(x) for pair in C.UNITS.items() for x in pair])
    return F.coalesce(F.try_element_at(units, token), token)


class Tokens(dict):
    """The tokens of words that a worker has met, up to a bound: no rule looks past its word."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > KEPT_WORDS:
            self.clear()
        bare = word.strip(_EDGES)
        if bare.isascii() and bare.isalpha():  # most words
            low = bare.lower()
            found = self[word] = (C.UNITS.get(low, low),)
            return found
        low = _BETWEEN.sub(" ", _HYPHEN.sub("", unicodedata.normalize("NFC", word).lower()))
        out: list[str] = []
        for part in low.split(" "):
            bare = part.strip(_EDGES)
            bare = C.UNITS.get(bare, bare)
            out += [bare] if _NUMBER.fullmatch(bare) else _SUB_TOKEN.findall(bare)
        found = self[word] = tuple(out)
        return found

    def each(self, words: Iterable[str]) -> list[tuple[str, ...]]:
        """The tokens of each of these composed, lower-cased words: those of letters alone, which most are, need no looking up among all words met, of which many come once."""
        unit, of_letters = C.UNITS.get, _SUB_TOKEN.findall
        return [
            ((unit(bare, bare),) if bare.isascii() else tuple(of_letters(bare))) if (bare := word.strip(_EDGES)).isalpha() else self[word]
            for word in words
        ]

    def words(self, text: str | None) -> list[str]:
        """A text's words, composed and lower-cased; a marker of a list is no part of its line."""
        words: list[str] = []
        for line in unicodedata.normalize("NFC", text or "").lower().splitlines():
            some = line.split()
            if some and ((first := some[0][0]) in _BULLETS or first.isdecimal()):
                some[0] = _MARKER.sub("", some[0], count=1)
            words += some
        return words

    def of(self, text: str | None) -> list[str]:
        words = self.words(text)
        distinct = set(words)
        known = dict(zip(distinct, self.each(distinct), strict=True))
        return list(itertools.chain.from_iterable(map(known.__getitem__, words)))

    def counted(self, text: str | None) -> dict[str, int]:
        """A text's distinct tokens and how often each is there: its words are counted first."""
        words, bag = Counter(self.words(text)), {}
        for tokens, n in zip(self.each(words), words.values(), strict=True):
            for token in tokens:
                bag[token] = bag.get(token, 0) + n
        return bag


def tokens_of(text: str | None) -> list[str]:
    """``tokens`` inside a function over batches."""
    return _KNOWN.of(text)


def counted_in(text: str | None) -> dict[str, int]:
    """``counted_tokens`` inside a function over batches."""
    return _KNOWN.counted(text)


KEPT_WORDS = 200_000
COUNTS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tf", T.LongType())]))
HASHED = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("tf", T.LongType())]))
_KNOWN = Tokens()  # a worker's
_HYPHEN, _BETWEEN = re.compile("(?<=[a-z])-(?=[a-z])"), re.compile(r"(?<=[a-z])(?=\d)|(?<=\d)(?=[a-z])")
_EDGES, _BULLETS, _MARKER = ",.;:!?()[]{}\"'", "-*•", re.compile(r"^(?:\d+[.)]|[-*•])")
_WORD_RUN = re.compile(r"\w{2,}")  # letters, numbers and underscores, as in ``WORD_RUN``
_NUMBER, _SUB_TOKEN = re.compile(r"[+-]?\d+(?:\.\d+)?"), re.compile(r"[a-z0-9]+|[+-]?\d+(?:\.\d+)?")


def _lists(rows: Iterable[list[str]]) -> pa.Array:
    """Lists of texts, whose values are laid out together."""
    sizes, flat = [0], []
    for r in rows:
        flat += r
        sizes.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.string()))


def _counts(bags: Iterable[dict[str, int]]) -> pa.Array:
    """``list<struct<word, tf>>``, words in the order in which they come first."""
    ends, words, counts = [0], [], []
    for bag in bags:
        words += bag
        counts += bag.values()
        ends.append(len(words))
    values = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _tokens(texts: pa.Array) -> pa.Array:
    return _lists(_KNOWN.of(t.as_py()) for t in texts)


@F.arrow_udf(COUNTS)
def _counted_tokens(texts: pa.Array) -> pa.Array:
    return _counts(_KNOWN.counted(t.as_py()) for t in texts)


@F.arrow_udf(COUNTS)
def _counted_terms(lowered: pa.Array) -> pa.Array:
    def bags() -> Iterator[Counter]:
        for t in lowered:
            w = _WORD_RUN.findall(t.as_py())
            yield Counter(w + [a + " " + b for a, b in itertools.pairwise(w)])

    return _counts(bags())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a word character, and its number in hashes."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)]), _mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_BASE))


@functools.lru_cache(2)
def _first_powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << 16, base, np.uint64)]))


def _powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to ``n``, modulo 2 ** 64."""
    if n <= 1 << 16:
        return _first_powers(base)[: n + 1]
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def hashes_of_terms(lowered: str) -> np.ndarray:
    """A hash of each run of two word characters at least, then of each pair of neighbouring runs.

    A run's characters are a polynomial's coefficients, so that all runs of a text come from one running sum.
    """
    is_word, number = _characters()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(is_word[points], prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    start, end = start[end - start > 1], end[end - start > 1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(number[points] * _powers(_BASE, len(points))[:-1])])
    runs = _mixed((sums[end] - sums[start]) * _powers(_BACK, len(points))[start] + (end - start).astype(np.uint64))
    return np.concatenate([runs, _mixed(_mixed(runs[:-1]) + runs[1:])])


@F.arrow_udf(HASHED)
def _hashed_terms(lowered: pa.Array) -> pa.Array:
    found = [np.unique(hashes_of_terms(t.as_py()), return_counts=True) for t in lowered]
    ends = np.cumsum([0, *(len(words) for words, _ in found)])
    words, counts = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    values = pa.StructArray.from_arrays([pa.array(words.astype(np.uint64).view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def tokens(c: Column) -> Column:
    """The tokens of a text as the metric sees them.

    No rule looks past its word but that for list markers, which looks at the first word of a line; so a batch's words are looked up among those met before. Lists of white space and line
    ends are the same as Python's.
    """
    return _tokens(c.cast("string"))


def counted_tokens(c: Column) -> Column:
    """``array<struct<word, tf>>``: each distinct token of a text once, with its count."""
    return _counted_tokens(c.cast("string"))


def counted_terms(c: Column) -> Column:
    """The same of the runs of word characters of a text, lower-cased, and the pairs of neighbours joined by a space."""
    return _counted_terms(F.lower(text_or_empty(c)))


def hashed_terms(c: Column) -> Column:
    """``counted_terms`` with a 64-bit hash for each term, where no term is returned: among 10 ** 9 distinct terms two share one with a chance of 0.03, and their idfs are then one."""
    return _hashed_terms(F.lower(text_or_empty(c)))


def words_of(counts: str) -> Column:
    """How many words a counted column has, repeats counted."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda n, x: n + x.tf)


def normalize_text(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def token_weight(t: Column) -> Column:
    return (
        F.when(t == "", 0.0)
        .when(t.isin(C.CRITICAL) | t.rlike(C.NUMBER), C.CRITICAL_WEIGHT)
        .when(t.isin(C.FUNCTION_WORDS), C.FUNCTION_WEIGHT)
        .otherwise(C.CONTENT_WEIGHT)
    )


def sentences(dictation: Column) -> Column:
    """Pieces between full stops and semicolons; decimals are split too."""
    pieces = F.split(strip(text_or_empty(dictation)), r"[.;]" + C.WS + "*")
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def capitalize(c: Column) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def measurements(c: Column) -> Column:
    """Lengths with their units in the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"({C.MEASUREMENT})"), 1)
