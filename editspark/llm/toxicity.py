"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained with numpy on confirmed toxic examples (P) and unlabelled
text (U), never on rows marked clean. With the class prior ``p`` and the logistic loss ``l``, the risk is

    p * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - p * E_P[l(f, -1)])

whose second term estimates the clean class's risk; when a step finds it below zero (the classifier starts to
memorise P) that term's gradient is reversed and damped. ``p`` is the share of toxic rows among the labelled rows that may be learned from.
A feature's value is the square root of its rate among the text's words, so long and short texts compare.

A score is a probability: P and U are cut into parts by what a row holds, so that a row of both stays on one side; each part gets the
margins of a classifier it was kept from, in units of their spread over the rows that one was trained on, and the margin's scale and shift are those of the least prior-corrected logistic
risk over them. The fewer toxic rows, the more parts (``parts``), the stronger the decay of the weights and the surer a feature's difference between P and U must be (``surely``), so that a few
rows are enough to learn from. ``THRESHOLD`` is applied to that probability; no share of rows is fixed beforehand.

Fitted on a bounded sample: ``MOST_TOXIC`` and ``MOST_UNLABELLED`` ids at most, the first by a hash of ``doc_id``, one text each, and of a text with more than
``MOST_FEATURES`` features as many, drawn by hash. Every row is scored over its whole text. Labels, language, source and ids are no inputs of a score.

Defined results: null and empty texts score as texts without words; a very long text is scored whole; without any toxic label to learn from every score is 0; of
several labels of a document a toxic one counts; of an id's several texts the first by hash is learned from; repeated rows and rows without an id each get their
score, equal texts equal ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import judged, record_batch, small_or_joined, texts, thinned, trained

MOST_TOXIC, MOST_UNLABELLED, MOST_FEATURES = 2_000, 8_000, 4_096
BITS = 18
THRESHOLD = 0.7
#: Parts that are kept from training in turn, to calibrate on: so many rows over those of P, within these ends.
PART_ROWS, PARTS = 1_000, (2, 20)
#: The decay of weights is ``DECAY``, or ``DECAY_ROWS`` over the rows of P where that is more.
STEPS, RATE, DECAY, DECAY_ROWS, DAMPING = 100, 0.3, 1e-4, 0.03, 0.1
#: Deviations by which a feature's rows in P must differ from those expected: so many rows over those of P, at most the second.
SURE_ROWS, MOST_SURE = 100, 3.0
#: Least scale of a calibrated margin: below it the kept rows don't show that the classifier tells anything, and its order is kept with scores near the prior.
LEAST_SCALE = 0.1
#: A feature must occur in this share of U or of P to have a weight, so that single documents' words don't; of P in so many rows at least.
LEAST_SHARE, LEAST_TOXIC = 0.006, 3
_WORDS = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (3, 4, 5, 6)
KEPT_WORDS = 50_000


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & ((1 << BITS) - 1)


class Features:
    """Hashed features of texts; each worker keeps those of the words it has met, up to a bound."""

    def __init__(self):
        self.known: dict[str, list[int]] = {}

    def of_word(self, word: str) -> list[int]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = self.known[word] = [_bucket(word), *(_bucket("^" + word[:k]) for k in _BEGINNINGS if len(word) > k)]
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, each once, and their values."""
        words = Counter(_WORDS.findall(text.casefold()))
        total, counts, known = sum(words.values()), {}, self.known.get
        for word, n in words.items():
            for f in known(word) or self.of_word(word):
                counts[f] = counts.get(f, 0) + n
        found = np.fromiter(counts.keys(), np.int32, len(counts))
        return found, np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(1, total)).astype(np.float32)


@functools.lru_cache(1)
def worker_features() -> Features:
    """One for each Python worker."""
    return Features()


class Rows:
    """Sparse rows."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self._hold(
            np.array([len(f) for f, _ in rows], np.int64),
            np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int32),
            np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.float32),
        )

    def _hold(self, sizes: np.ndarray, features: np.ndarray, values: np.ndarray) -> Rows:
        self.sizes, self.features, self.values = sizes, features, values
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return self

    def __len__(self) -> int:
        return len(self.sizes)

    def parts(self, count: int) -> np.ndarray:
        """The part of each row: by a hash of its features."""
        ends = np.cumsum(self.sizes)
        return np.array([xxhash.xxh32_intdigest(self.features[e - n : e].tobytes(), 7) % count for n, e in zip(self.sizes, ends, strict=True)])

    def frequency(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen rows each feature is; a million entries at a time, as counting makes them wide."""
        out = np.zeros(1 << BITS, np.int64)
        for at in range(0, len(self.features), 1 << 20):
            some = slice(at, at + (1 << 20))
            out += np.bincount(self.features[some][chosen[self.row[some]]], minlength=1 << BITS)
        return out

    def only(self, chosen: np.ndarray, seen: np.ndarray) -> Rows:
        """The chosen rows with the features for which ``seen`` holds, numbered anew among these."""
        of = chosen[self.row]
        of &= seen[self.features]
        number = (np.cumsum(seen) - 1).astype(np.int32)
        return Rows([])._hold(np.bincount(self.row[of], minlength=len(self))[chosen], number[self.features[of]], self.values[of])

    def _runs(self, sizes: np.ndarray):
        """(segments, entries) of runs of whole segments, of about a million entries, so that products take bounded memory."""
        ends = np.cumsum(sizes)
        at = start = 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, start + (1 << 20), "right")))
            yield slice(at, stop), slice(start, int(ends[stop - 1]))
            at, start = stop, int(ends[stop - 1])

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        full = np.flatnonzero(self.sizes)
        sizes = self.sizes[full]
        for rows, at in self._runs(sizes):
            out[full[rows]] = np.add.reduceat(w[self.features[at]] * self.values[at], np.cumsum(sizes[rows]) - sizes[rows])
        return out

    def back(self, by_row: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for at in range(0, len(self.features), 1 << 20):
            some = slice(at, at + (1 << 20))
            out += np.bincount(self.features[some], by_row[self.row[some]] * self.values[some], n)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrated(on_p: np.ndarray, on_u: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of margins by which their sigmoid is the probability of being toxic, from held-out rows of P and U.

    The least of ``E_U[l(g, -1)] - prior * E_P[l(g, -1)] + prior * E_P[l(g, +1)]``, which is ``E_U[log(1 + exp(g))] - prior * E_P[g]`` and
    convex in both; a small square term keeps the scale finite where the two kinds are apart. Margins above the median of P count as it: of rows that are surely
    toxic, chance differences between P and U would else weigh as much as the rows in question.
    """
    on_p, on_u = np.minimum(on_p, np.median(on_p)), np.minimum(on_u, np.median(on_p))
    center, width = on_u.mean(), on_u.std() + 1e-6
    p, u = (on_p - center) / width, (on_u - center) / width
    a = np.array([1.0, np.log(prior / (1 - prior))])
    both, wanted = np.column_stack([u, np.ones(len(u))]), prior * np.array([p.mean(), 1.0])
    ridge = np.array([0.1, 0.01]) / len(u)

    def risk(x: np.ndarray) -> float:
        return np.logaddexp(0, both @ x).mean() - wanted @ x + (ridge * x * x).sum() / 2

    for _ in range(100):
        q = _sigmoid(both @ a)
        slope = (both * q[:, None]).mean(axis=0) - wanted + ridge * a
        step = np.linalg.solve((both * (q * (1 - q))[:, None]).T @ both / len(u) + np.diag(ridge), slope)
        size = 1.0
        while size > 1e-6 and risk(a - size * step) > risk(a):
            size /= 2
        a = a - size * step
        if np.abs(step).max() < 1e-9:
            break
    if a[0] < LEAST_SCALE:
        warnings.warn(f"toxicity: {len(on_p)} kept toxic rows have margins like {len(on_u)} others; scores stay near the share of toxic labels", stacklevel=2)
        a = np.array([LEAST_SCALE, np.log(prior / (1 - prior))])
    scale = a[0] / width
    return scale, a[1] - scale * center


def fit(toxic: Rows, unlabelled: Rows, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the least risk over the whole sample, calibrated on margins of rows that were kept from training."""
    sides, margins = (toxic, unlabelled), ([], [])
    count = int(np.clip(round(PART_ROWS / len(toxic)), *PARTS))
    part = [rows.parts(count) for rows in sides]

    for k in range(count):
        if all(0 < (of == k).sum() < len(of) for of in part):
            w, center, width = learned(toxic, unlabelled, prior, *(of != k for of in part))
            for out, rows, of in zip(margins, sides, part, strict=True):
                out.append((rows.dot(w[:-1])[of == k] - center) / width)
    w, center, width = learned(toxic, unlabelled, prior, *(of >= 0 for of in part))
    # too few rows to keep some: calibrated on those learned from
    scale, shift = calibrated(*(np.concatenate(out) if out else (rows.dot(w[:-1]) - center) / width for out, rows in zip(margins, sides, strict=True)), prior)
    return (scale / width * w[:-1]).astype(np.float32), float(shift - scale / width * center)


def objective(w: np.ndarray, toxic: Rows, unlabelled: Rows, prior: float) -> tuple[float, np.ndarray]:
    """What a step descends on, and its slope: the risk, or its first term less ``DAMPING`` times a clean risk below zero; and the decay of the weights."""
    on_p, on_u = toxic.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
    clean_risk = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
    turn, decay = 1.0 if clean_risk >= 0 else -DAMPING, max(DECAY, DECAY_ROWS / len(toxic))
    p = prior / len(toxic) * (_sigmoid(on_p) - 1 - turn * _sigmoid(on_p))
    u = turn / len(unlabelled) * _sigmoid(on_u)
    slope = np.append(toxic.back(p, len(w) - 1) + unlabelled.back(u, len(w) - 1) + decay * w[:-1], p.sum() + u.sum())
    return prior * np.logaddexp(0, -on_p).mean() + turn * clean_risk + decay / 2 * (w[:-1] ** 2).sum(), slope


def surely(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The features whose rows in P, of ``n_p``, differ from those expected of its size by enough deviations for so few rows."""
    share = (p + u) / (n_p + n_u)
    expected = share * n_p
    deviation = np.sqrt(expected * (1 - share) * n_u / (n_p + n_u))
    return np.abs(p - expected) >= min(MOST_SURE, SURE_ROWS / n_p) * deviation


def learned(toxic: Rows, unlabelled: Rows, prior: float, of_p: np.ndarray, of_u: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights of the least risk over the rows that ``of_p`` and ``of_u`` choose and the bias after them, by Adam over all of them; the mean and the spread of the margins, without the bias, of U.

    Of the samples only the entries that can have weights are copied, so that the driver never holds copies of whole samples.
    """
    n, n_p, n_u = 1 << BITS, int(of_p.sum()), int(of_u.sum())
    p, u = toxic.frequency(of_p), unlabelled.frequency(of_u)
    seen = (u >= max(2, LEAST_SHARE * n_u)) | (p >= max(LEAST_TOXIC, LEAST_SHARE * n_p))
    seen &= surely(p.astype(float), u.astype(float), n_p, n_u)
    toxic, unlabelled = toxic.only(of_p, seen), unlabelled.only(of_u, seen)
    w = np.zeros(int(seen.sum()) + 1)
    w[-1] = np.log(prior / (1 - prior))
    moments = [np.zeros(len(w)), np.zeros(len(w))]
    for t in range(1, STEPS + 1):
        _, slope = objective(w, toxic, unlabelled, prior)
        for m, decay, x in zip(moments, (0.9, 0.99), (slope, slope * slope), strict=True):
            m *= decay
            m += (1 - decay) * x
        w -= RATE * (1 - (t - 1) / STEPS) * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.99**t)) + 1e-6)
    on_u = unlabelled.dot(w[:-1])
    out = np.zeros(n + 1)
    out[:n][seen], out[n] = w[:-1], w[-1]
    return out, float(on_u.mean()), float(on_u.std()) + 1e-6


def sampled(found: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of a text's features, drawn by a hash of each with their number."""
    if len(found) > most:
        order = np.argsort([xxhash.xxh32_intdigest(int(f).to_bytes(4, "little"), len(found)) for f in found])[:most]
        found, values = found[np.sort(order)], values[np.sort(order)]
    return found, values


def train(docs: DataFrame, labels: DataFrame, learn_from) -> tuple[np.ndarray, float] | None:
    """The classifier from the rows of ``docs`` and ``labels`` for which the column ``learn_from`` of ``doc_id`` holds; None without toxic ones."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(learn_from & F.col("doc_id").isNotNull())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(learn_from & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("p")).first().p

    def first(rows: DataFrame, most: int) -> DataFrame:
        """Distinct ids: so many of least hash, thinned by about how many there are."""
        by_hash = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 32))
        about = rows.agg(F.approx_count_distinct("doc_id").alias("n")).first().n
        return rows.filter(thinned(F.col("doc_id"), most, F.lit(about))).distinct().orderBy(by_hash, "doc_id").limit(most)

    toxic = first(small_or_joined(ids, known.filter("toxic > 0").select("doc_id"), "doc_id", "left_semi"), MOST_TOXIC)
    some = first(ids, MOST_UNLABELLED)
    chosen = toxic.withColumn("of", F.lit("P")).union(some.withColumn("of", F.lit("U")))
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow())  # at most as many ids as the bounds
    spec, most = "of string, features binary, values binary", MOST_FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = worker_features()
        for b in batches:
            found = [sampled(*features(t), most) for t in b.column("text").to_pylist()]
            yield record_batch(spec, [b.column("of"), [f.tobytes() for f, _ in found], [v.tobytes() for _, v in found]])

    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("of", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    if not share:
        return None
    return trained(rows.select("of", "text").mapInArrow(run, spec), functools.partial(fit_sample, prior=min(share, 0.95)))


def fit_sample(sample: pa.Table, prior: float) -> tuple[np.ndarray, float] | None:
    """The classifier from sampled rows ``of`` P or U, ``features, values``."""
    groups: dict[str, list] = {"P": [], "U": []}
    for part in sample.to_batches(max_chunksize=1_000):
        for of, f, v in zip(*(part.column(c) for c in ("of", "features", "values")), strict=True):
            groups[of.as_py()].append((np.frombuffer(f.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)))  # no copies
    if not groups["P"]:
        return None
    # rows arrive in the order of tasks; sums must not depend on it
    for rows in groups.values():
        rows.sort(key=lambda x: (xxhash.xxh3_64_intdigest(x[0].tobytes()), xxhash.xxh3_64_intdigest(x[1].tobytes())))
    return fit(Rows(groups.pop("P")), Rows(groups.pop("U")), prior)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, keep_rows: bool = False) -> DataFrame:
    """``score`` and ``predicted`` of every row, after its ``doc_id`` or the whole ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input

    def judge(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if shared.value is None:
            return np.zeros(len(batch)), np.zeros(len(batch), np.int32)
        (w, bias), features = shared.value, worker_features()
        scores = _sigmoid(np.array([float(w[f] @ v) + bias for f, v in map(features, batch)]))
        return scores, (scores >= THRESHOLD).astype(np.int32)

    return judged(docs, judge, "score double, predicted int", keep_rows)
