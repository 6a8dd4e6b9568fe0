"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text's subwords are the runs of 1 to ``ORDERS`` characters of its lower-cased letters, anything else being a space between words. Each subword's
hash picks a row of an embedding table; their mean goes through a linear layer and a softmax. Table and layer are trained together by
stochastic gradient descent in numpy. After training, table times layer is one score a subword and language, so a text is scored by a
mean of table rows.

A part of the sample is kept from training. On it one temperature is fitted, so that the softmax gives probabilities among the learned languages. As a softmax
must choose among these, whether a text is in any of them is judged apart: by the share of its runs of ``ORDERS`` characters that texts learned from in the predicted
language have (a bit table for each language). A logistic curve of that share is fitted on the kept texts, and once more on what is left of them without the words that texts learned from
have, against two kinds of strangers made from them: their letters shuffled, and their likeness to the best of the other languages, as if their own hadn't been learned. ``score`` is the product of both
probabilities; a text is rejected if the second is below one half (less, if over ``REJECTED`` of the kept texts, or of those of unseen words, were).

Fitted on a bounded sample: ``MOST_ROWS`` ids of each language, fewer where all languages together would have over ``MOST_SAMPLE``, the first by a hash of ``doc_id``, one text each, and of a
text with more than ``MOST_FEATURES`` distinct subwords or runs as many (fewer where the sample's would be over ``MOST_VALUES``), drawn by hash or evenly from all of it; every row is scored over its
whole text. Languages beyond the ``MOST_LANGUAGES`` commonest, more than there are names for, aren't learned.
Languages, sources and ids are no inputs of a prediction.

Defined results: a null text and one without letters is ``und``, score 0, rejected; a very long text is scored in parts that add up exactly; of equally probable languages
the first by name is said; without any row to learn from all texts are ``und``; of an id's several texts in a language the first by hash is learned from; repeated rows
and rows without an id each get their prediction; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import freed, from_rows, judged, thinned, trained

MOST_ROWS, MOST_LANGUAGES, MOST_FEATURES = 400, 1_000, 4_096
#: Ids of all languages together, and subwords of all their texts; a language and a text keep these at least.
MOST_SAMPLE, MOST_VALUES, LEAST_ROWS, LEAST_FEATURES = 12_800, 1_600 * 4_096, 12, 256
#: Letters of a text that are shuffled into a strange one: evenly from all of it.
SHUFFLED = 1 << 20
BITS, WIDTH, ORDERS = 16, 16, 4
#: Bits of the hash of a run of ``ORDERS`` characters.
RUN_BITS = 20
PASSES, RATE = 6, 4.0
#: Share of texts that is taken to be strange, share of kept texts that may be rejected, and runs that a text counts for beside its own, of the usual share.
STRANGE, REJECTED, USUAL = 0.05, 0.005, 12
UNKNOWN = "und"
#: Characters of a text that are scored at a time.
PART = 1 << 16
_GAPS = re.compile(r"[\W\d_]+")
_MIX = np.uint32(0x9E3779B1)


def letters(text: str | None) -> str:
    """Lower-cased words between single spaces, or nothing if there is no letter."""
    cleaned = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {cleaned} " if any(map(str.isalpha, cleaned)) else ""


def subwords(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``ORDERS`` characters of a text from ``letters``, and finer ones of those of ``ORDERS``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found, runs, state = [], np.zeros(0, np.int32), np.zeros(len(points), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            break
        state = (state[: len(points) - n + 1] ^ points[n - 1 :]) * _MIX
        state ^= state >> np.uint32(15)
        full = state * (_MIX + np.uint32(2 * n))
        found.append((full >> np.uint32(32 - BITS)).astype(np.int32))
        if n == ORDERS:
            runs = (full >> np.uint32(32 - RUN_BITS)).astype(np.int32)
    return np.concatenate(found) if found else np.zeros(0, np.int32), runs


def words_of_runs(text: str) -> np.ndarray:
    """Of a text from ``letters``, for each run of ``ORDERS`` characters a hash of the word that it begins in; the space before a word is its beginning."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.cumsum(points == ord(" "), dtype=np.int32)[: max(0, len(text) - ORDERS + 1)] - 1
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in text.split()], np.uint32)[number]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """``table`` and ``bias`` give logits, ``seen`` has a row of bits for each language, ``usual, slope, shift`` turn shares of runs into probabilities, and ``least`` is the lowest that isn't rejected."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, seen: np.ndarray):
        self.languages, self.table, self.bias, self.seen = languages, table, bias, seen
        self.temperature, self.usual, self.slope, self.shift, self.least = 1.0, 0.0, 0.0, 0.0, 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return _softmax(logits / self.temperature)

    def hits(self, language: int, runs: np.ndarray) -> int:
        return int((self.seen[language][runs >> 3] >> (runs & 7) & 1).sum())

    def share(self, hits: int, n: int) -> float:
        return (hits + USUAL * self.usual) / (n + USUAL)

    def known(self, share: float) -> float:
        """The probability that a text with this share of known runs is in a learned language."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.shift, -40, 40))))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not (words := letters(text)):
            return UNKNOWN, 0.0, True
        logits = np.zeros(len(self.languages))
        n, runs = 0, []
        for at in range(0, len(words), PART):  # long texts in parts, so that subwords take bounded memory
            before = words[max(0, at - ORDERS + 1) : at]
            found, here = subwords(before + words[at : at + PART])
            again, _ = subwords(before)
            logits += self.table[found].sum(axis=0, dtype=np.float64) - self.table[again].sum(axis=0, dtype=np.float64)
            n += len(found) - len(again)
            runs.append(here)
        p = self.probabilities(logits / n + self.bias)
        best = int(p.argmax())
        known = self.known(self.share(sum(self.hits(best, x) for x in runs), sum(map(len, runs))))
        return self.languages[best], float(p[best]) * known, known < self.least


def _logit(share):
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def loss_and_slopes(table: np.ndarray, layer: np.ndarray, bias: np.ndarray, found: np.ndarray, share: np.ndarray, truth: int):
    """Of one text: the loss, and its slopes by the embeddings of ``found``, the layer and the bias."""
    mean = share @ table[found]
    p = _softmax(mean @ layer + bias)
    wrong = p.copy()
    wrong[truth] -= 1
    return -np.log(max(p[truth], 1e-30)), np.outer(share, layer @ wrong), np.outer(mean, wrong), wrong


def calibrated_temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Of least loss against smoothed labels, so that it stays finite where no kept text is mistaken."""
    n, k = logits.shape
    if k < 2:
        return 1.0
    wanted = np.full((n, k), 1 / (n + 2) / (k - 1))
    wanted[np.arange(n), truth] = 1 - 1 / (n + 2)
    return min((float(-(wanted * np.log(np.maximum(_softmax(logits / t), 1e-30))).sum()), float(t)) for t in np.geomspace(1e-3, 20, 200))[1]


def calibrated_share(known: np.ndarray, strange: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over logits of shares that tells known texts from strange ones, of which there are ``STRANGE``."""
    x = _logit(np.concatenate([known, strange]))
    y = np.append(np.ones(len(known)), np.zeros(len(strange)))
    weight = np.where(y == 1, (1 - STRANGE) / len(known), STRANGE / len(strange))
    both, a = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-both @ a))
        slope = both.T @ (weight * (p - y)) + 1e-3 * a * [1, 0]
        a -= np.linalg.solve((both * (weight * p * (1 - p))[:, None]).T @ both + np.diag([1e-3, 1e-6]), slope)
    return float(max(a[0], 0.0)), float(a[1])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Model | None:
    """From (language, subwords, their shares, runs, runs of the shuffled text, words of the runs) of each sampled text."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    draw = np.random.default_rng(11)
    order = draw.permutation(len(rows))
    kept = order[: len(rows) // 5] if len(rows) >= 50 else order
    learned = order[len(rows) // 5 :] if len(rows) >= 50 else order
    table = draw.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    number = {lang: k for k, lang in enumerate(languages)}
    for step in range(PASSES):
        rate = RATE * (1 - step / PASSES)
        for k in draw.permutation(learned):
            lang, found, share, *_ = rows[k]
            _, by_table, by_layer, by_bias = loss_and_slopes(table, layer, bias, found, share, number[lang])
            table[found] -= rate * 10 * by_table  # shares are small: embeddings move faster than the layer
            layer -= rate * 0.1 * by_layer
            bias -= rate * 0.01 * by_bias
    seen = np.zeros((len(languages), 1 << RUN_BITS), bool)
    for k in learned:
        seen[number[rows[k][0]], rows[k][3]] = True
    model = Model(languages, (table @ layer).astype(np.float32), bias.astype(np.float64), np.packbits(seen, axis=1, bitorder="little"))
    logits = np.array([rows[k][2] @ model.table[rows[k][1]] + bias for k in kept], np.float64)
    truth = np.array([number[rows[k][0]] for k in kept])
    model.temperature = calibrated_temperature(logits, truth)
    calibrate_rejection(model, [rows[k] for k in kept], logits, np.unique(np.concatenate([rows[k][5] for k in learned])))
    return model


def calibrate_rejection(model: Model, kept: list[tuple], logits: np.ndarray, words: np.ndarray) -> None:
    """``words``: those of the texts learned from."""
    best = logits.argmax(axis=1)
    counted = [(model.hits(b, r[3]), len(r[3])) for b, r in zip(best, kept, strict=True) if len(r[3])]
    if not counted:
        return
    model.usual = float(np.median([h / n for h, n in counted]))
    strange = [(model.hits(b, r[4]), len(r[4])) for b, r in zip(best, kept, strict=True) if len(r[4])]
    if len(model.languages) > 1:
        second = np.argsort(logits, axis=1)[:, -2]
        strange += [(model.hits(b, r[3]), len(r[3])) for b, r in zip(second, kept, strict=True) if len(r[3])]
    left = [(b, r[3][~np.isin(r[5], words)]) for b, r in zip(best, kept, strict=True)]
    unseen = [(model.hits(b, runs), len(runs)) for b, runs in left if len(runs)]
    seen, unseen, strange = (np.array([model.share(h, n) for h, n in x]) for x in (counted, unseen, strange))
    model.slope, model.shift = calibrated_share(np.append(seen, unseen), strange)
    model.least = min(0.5, *(float(np.quantile([model.known(x) for x in shares], REJECTED)) for shares in (seen, unseen) if len(shares)))


def shuffled(words: str, seed: int) -> str:
    """The text's letters in another order, its spaces where they were."""
    points = np.array(list(words))
    at = np.flatnonzero(points != " ")
    points[at] = points[np.random.default_rng(seed).permutation(at)]
    return "".join(points)


def spread(runs: np.ndarray, most: int) -> np.ndarray:
    """``most`` of the runs at most, evenly from all of them."""
    return runs if len(runs) <= most else runs[np.linspace(0, len(runs) - 1, most).astype(np.int64)]


SAMPLE = "lang string, found binary, share binary, runs binary, strange binary, words binary"


def features(lang: str, words: str, most: int = MOST_FEATURES) -> tuple | None:
    """A row of ``SAMPLE`` of a text from ``letters``."""
    buckets, runs = subwords(words)
    if not len(buckets):
        return None
    counts = np.bincount(buckets)
    found = np.flatnonzero(counts).astype(np.int32)
    if len(found) > most:
        found = np.sort(found[np.argsort(_mixed(found, len(buckets)))[:most]])
    share = (counts[found] / counts[found].sum()).astype(np.float32)
    _, strange = subwords(shuffled(words[:: -(-len(words) // SHUFFLED)], len(words)))
    return lang, found.tobytes(), share.tobytes(), spread(runs, most).tobytes(), spread(strange, most).tobytes(), spread(words_of_runs(words), most).tobytes()


def _mixed(numbers: np.ndarray, seed: int) -> np.ndarray:
    x = (numbers.astype(np.uint32) ^ np.uint32(seed & 0xFFFFFFFF)) * _MIX
    return (x ^ (x >> np.uint32(13))) * _MIX


def train(docs: DataFrame, learn_from) -> Model | None:
    """The model from the rows of ``docs`` with a language for which the column ``learn_from`` of ``doc_id`` holds."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.filter(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang").limit(MOST_LANGUAGES)
    languages = sizes.count()
    quota = int(np.clip(MOST_SAMPLE // max(1, languages), min(LEAST_ROWS, MOST_ROWS), MOST_ROWS))
    some = known.select("doc_id", "lang").join(F.broadcast(sizes), "lang").filter(thinned(F.col("doc_id"), quota, F.col("ids"))).select("doc_id", "lang").distinct()
    by_hash = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 32))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(by_hash, "doc_id"))
    chosen = some.withColumn("n", rank).filter(F.col("n") <= quota).select("doc_id", "lang")
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow())  # at most ``MOST_SAMPLE`` ids, or ``LEAST_ROWS`` a language

    most = int(np.clip(MOST_VALUES // max(1, languages * quota), min(LEAST_FEATURES, MOST_FEATURES), MOST_FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(lang, letters(text), most) for lang, text in zip(*(b.column(c).to_pylist() for c in ("lang", "text")), strict=True)]
            yield from_rows(SAMPLE, [r for r in rows if r])
            freed()

    texts = known.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return trained(texts.select("lang", "text").mapInArrow(run, SAMPLE), fit_sample)


def fit_sample(found: pa.Table) -> Model | None:
    """The model from rows of ``SAMPLE``."""
    sample = found.to_pylist()
    sample.sort(key=lambda r: tuple(r.values()))  # rows arrive in the order of tasks; training must not depend on it
    kinds = {"found": np.int32, "share": np.float32, "runs": np.int32, "strange": np.int32, "words": np.uint32}
    return fit([(r["lang"], *(np.frombuffer(r[name], kind) for name, kind in kinds.items())) for r in sample])


def predict(docs: DataFrame, model: Model | None, keep_rows: bool = False) -> DataFrame:
    """``lang_pred``, ``score`` and ``rejected`` of every row, after its ``doc_id`` or the whole ``row``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 384 KB for each of ``MOST_LANGUAGES``

    def judge(batch: list[str]) -> tuple[list, list, list]:
        held = shared.value
        said = [(UNKNOWN, 0.0, True) if held is None else held.predict(t) for t in batch]
        return [p for p, _, _ in said], [s for _, s, _ in said], [r for _, _, r in said]

    return judged(docs, judge, "lang_pred string, score double, rejected boolean", keep_rows)
