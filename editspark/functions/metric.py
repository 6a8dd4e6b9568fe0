"""The weighted token edit distance.

Its dynamic programme is the one kernel without a built-in: an Arrow function with a rolling row, which receives only pairs that
differ and are not empty. Weights are multiples of a quarter, so costs are exact.

Common beginnings and ends cost nothing and are cut first. That is exact, as the costs are a metric on tokens and the gap (a gap is as far from a token as
the token's weight, two tokens as the greater weight): an alignment that leaves equal first tokens apart pays for each with something that the direct way, by
the triangle inequality, gets for less or as much. Where what is left of the shorter side can be had from the longer by leaving tokens out, as after most edits, the cost is the difference of
their weights, without a table: no step changes the total weight by more than it costs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from .text import token_weight, tokens_of

_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?\Z")
_WEIGHTS = {**dict.fromkeys(C.FUNCTION_WORDS, C.FUNCTION_WEIGHT), **dict.fromkeys(C.CRITICAL, C.CRITICAL_WEIGHT), "": 0.0}


def weight_of(token: str) -> float:
    w = _WEIGHTS.get(token)
    return w if w is not None else C.CRITICAL_WEIGHT if _NUMBER.match(token) else C.CONTENT_WEIGHT


#: Cells of a row of the tables that are filled together; pairs that are held as lists at a time.
TOGETHER, PAIRS = 1 << 14, 2_000


def trimmed(ref: list[str], pred: list[str]) -> tuple[list[str], list[str]]:
    """Both sides without their common beginning and end, the shorter first: costs are the same both ways."""
    start, most = 0, min(len(ref), len(pred))
    while start < most and ref[start] == pred[start]:
        start += 1
    end = 0
    while end < most - start and ref[-1 - end] == pred[-1 - end]:
        end += 1
    short, long = sorted((ref[start : len(ref) - end], pred[start : len(pred) - end]), key=len)
    return short, long


def costs_of(pairs: list[tuple[list[str], list[str]]]) -> list[float]:
    """Of each pair the least total weight of deletions, insertions and substitutions (the greater weight of the two); pairs of like lengths are worked on together."""
    number, weights = {"": 0}, [0]
    coded, out = {}, np.zeros(len(pairs))
    for k, p in enumerate(pairs):
        short, long = trimmed(*p)
        rest = iter(long)
        if all(t in rest for t in short):
            out[k] = sum(map(weight_of, long)) - sum(map(weight_of, short))
            continue
        for t in (*short, *long):
            if t not in number:
                number[t] = len(weights)
                weights.append(int(weight_of(t) * 4))
        coded[k] = tuple(np.array([number[t] for t in side], np.int32) for side in (short, long))
    weight = np.array(weights, np.int32)
    order = sorted(coded, key=lambda k: (len(coded[k][1]), len(coded[k][0])))
    at = 0
    while at < len(order):
        # lengths rise: the last pair of a group has the longest row, which the group's size must suit
        end = at + 1
        while end < len(order) and (end + 1 - at) * (len(coded[order[end]][1]) + 1) <= TOGETHER and len(coded[order[end]][1]) <= 2 * len(coded[order[at]][1]) + 8:
            end += 1
        some = order[at:end]
        out[some] = together([coded[k] for k in some], weight) / 4
        at = end
    return out.tolist()


def together(pairs: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> np.ndarray:
    """The costs, in quarters, of some pairs of numbered tokens, a row of all their tables at a time. Insertions add up along a row, so the best of them is a running minimum of what is left without them.

    Shorter sides are filled up with a token without weight, which changes no cell that is read.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    short, long = (np.zeros((len(pairs), int(size.max())), np.int32) for size in (n, m))
    for k, (a, b) in enumerate(pairs):
        short[k, : len(a)], long[k, : len(b)] = a, b
    w_long, w_short = weight[long], weight[short]
    inserted = np.concatenate([np.zeros((len(pairs), 1), np.int32), np.cumsum(w_long, axis=1, dtype=np.int32)], axis=1)
    row, best, every = inserted.copy(), np.empty_like(inserted), np.arange(len(pairs))
    out = row[every, m].copy()
    for i in range(short.shape[1]):
        w = w_short[:, i : i + 1]
        best[:, :1] = row[:, :1] + w
        np.minimum(row[:, 1:] + w, row[:, :-1] + np.maximum(w_long, w) * (long != short[:, i : i + 1]), out=best[:, 1:])
        np.subtract(best, inserted, out=best)
        np.minimum.accumulate(best, axis=1, out=row)
        row += inserted
        done = n == i + 1
        out[done] = row[done, m[done]]
    return out


def by_loops(ref: list[str], pred: list[str]) -> float:
    """The definition, one cell at a time: what the tests hold ``costs_of`` against."""
    weights = [weight_of(t) for t in pred]
    row = [0.0]
    for w in weights:
        row.append(row[-1] + w)
    for r in ref:
        w_ref, corner = weight_of(r), row[0]
        row[0] = left = corner + w_ref
        for j, (p, w) in enumerate(zip(pred, weights, strict=True), 1):
            above = row[j]
            best = corner if r == p else corner + (w_ref if w_ref > w else w)
            if above + w_ref < best:
                best = above + w_ref
            if left + w < best:
                best = left + w
            row[j] = left = best
            corner = above
    return row[-1]


@F.arrow_udf(T.DoubleType())
def _cost(ref: pa.Array, pred: pa.Array) -> pa.Array:
    known = (ref.is_valid().to_numpy(zero_copy_only=False)) & (pred.is_valid().to_numpy(zero_copy_only=False))
    some, out = np.flatnonzero(known), [None] * len(ref)
    for k in range(0, len(some), PAIRS):
        part = pa.array(some[k : k + PAIRS])
        for at, cost in zip(part.to_pylist(), costs_of(list(zip(ref.take(part).to_pylist(), pred.take(part).to_pylist(), strict=True))), strict=True):
            out[at] = cost
    return pa.array(out, pa.float64())


@F.arrow_udf(T.StructType([T.StructField("edit", T.DoubleType()), T.StructField("changed", T.BooleanType())]))
def _compared(ref: pa.Array, pred: pa.Array, tmpl: pa.Array) -> pa.Array:
    edit, changed = np.ones(len(ref)), np.zeros(len(ref), bool)
    for k in range(0, len(ref), PAIRS):
        at, pairs = [], []
        for i, (r, p, t) in enumerate(zip(*(c.slice(k, PAIRS).to_pylist() for c in (ref, pred, tmpl)), strict=True), k):
            said = None if r is None or r == p == t else tokens_of(r)
            changed[i] = r is not None and r != t and said != tokens_of(t)
            if r is None or p is None:
                continue
            guess = said if r == p else tokens_of(p)
            if said == guess:
                edit[i] = 0.0
            elif said and guess:
                at.append(i)
                pairs.append((said, guess))
        most = [max(sum(map(weight_of, side)) for side in p) for p in pairs]
        edit[at] = np.clip(np.array(costs_of(pairs)) / np.array(most), 0.0, 1.0)
    return pa.StructArray.from_arrays([pa.array(edit), pa.array(changed)], ["edit", "changed"])


def compared(ref: Column, pred: Column, tmpl: Column) -> Column:
    """``struct<edit, changed>`` of three texts: ``edit_distance`` of the first two's tokens (1 where one is null), and whether the first's tokens differ from the third's.

    Tokens stay in the function that makes them, and of equal texts none are made.
    """
    return _compared(ref.cast("string"), pred.cast("string"), tmpl.cast("string"))


def total_weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + token_weight(t))


def edit_cost(ref: Column, pred: Column) -> Column:
    """Unnormalised cost between two token arrays."""
    hard = (ref != pred) & (F.size(ref) > 0) & (F.size(pred) > 0)
    return F.when(ref == pred, 0.0).when(F.size(ref) == 0, total_weight(pred)).when(F.size(pred) == 0, total_weight(ref)).otherwise(_cost(F.when(hard, ref), F.when(hard, pred)))


def edit_distance(ref: Column, pred: Column) -> Column:
    """Between 0 and 1: the cost over the greater total weight; 0 for equal and 1 for one empty token array."""
    most = F.greatest(total_weight(ref), total_weight(pred))
    return F.when(ref == pred, 0.0).when((F.size(ref) == 0) | (F.size(pred) == 0), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), edit_cost(ref, pred) / most)))
