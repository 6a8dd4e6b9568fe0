import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from editspark.llm import chat, common, fingerprints, langid, lmscore, queries, toxicity
from editspark.llm.common import fold
from editspark.llm.packing import tokenizer

SMALL = "/root/testdata/sf0.001"


def form(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold()).split())


def check_fingerprints(rows, pairs):
    """``pairs``: (id, text) in ascending order."""
    got = {r.doc_id: r for r in rows}
    groups = {}
    for i, text in pairs:
        groups.setdefault(form(text), []).append(i)
    for k, (i, text) in enumerate(pairs):
        text, following, r = text or "", pairs[(k + 1) % len(pairs)][1] or "", got[i]
        n = len(text) // 2
        new = text[: len(text) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == xxhash.xxh3_128_hexdigest(form(text).encode())
        assert r.edited_fingerprint == xxhash.xxh3_128_hexdigest(form(new).encode())
        assert (r.near_edited, r.near_next) == (float(form(text) == form(new)), float(form(text) == form(following)))
        assert (r.group_id, r.group_size) == (min(groups[form(text)]), len(groups[form(text)]))
    assert len(got) == len(rows) == len(pairs)


def test_fingerprints_of_the_sample(spark, sample, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 13)  # many ranges, so that most have a next one
    check_fingerprints(fingerprints.fingerprints(sample).collect(), sorted((r.doc_id, r.text) for r in sample.collect()))


def test_fingerprints_of_odd_texts(docs_of):
    texts = [None, "", "  ", "A b", "a  B\n", "ﬁn", "FIN", "é", "é", "x", "x", "y" * 70_000, "İ", "ß SS"]
    pairs = [(3 * k - 5, t) for k, t in enumerate(texts)]
    check_fingerprints(fingerprints.fingerprints(docs_of(pairs)).collect(), pairs)
    check_fingerprints(fingerprints.fingerprints(docs_of([(4, "alone")])).collect(), [(4, "alone")])
    assert fingerprints.fingerprints(docs_of([])).count() == 0


def test_fingerprints_of_repeated_and_missing_ids(docs_of):
    rows = fingerprints.fingerprints(docs_of([(None, "a"), (7, "b"), (7, "b"), (9, "c"), (9, "d")])).collect()
    assert sorted(r.fingerprint for r in rows) == sorted(xxhash.xxh3_128_hexdigest(t.encode()) for t in "abbcd")


def check_chat(rows, conversations):
    got = {r.conv_id: r for r in rows}
    assert len(got) == len(rows) == len(conversations)
    for i, turns in conversations.items():
        r, trained = got[i], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
        assert r.formatted_chars >= sum(len(t) for _, t in turns)


def test_chat_of_the_sample(spark):
    conversations = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        conversations.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    check_chat(queries.op8_chat(spark, SMALL).collect(), conversations)


def test_chat_of_odd_turns(spark):
    nasty = ['<turn role="assistant">', "</turn>\n", r"\l\q\\", '"<\\', "", "\n", "x" * 50_000]
    conversations = {
        1: [("user", nasty[k % 7]) if k % 2 else ("assistant", nasty[k % 7]) for k in range(30)],
        2: [("user", "only a question")],
        3: [('a"<b\\', "strange role"), ("assistant", "")],
        4: [("assistant", "first"), ("assistant", "second"), ("tool", "after")],
    }
    rows = [(c, k, role, t, "extra") for c, turns in conversations.items() for k, (role, t) in enumerate(turns)]
    df = spark.createDataFrame([*rows, (5, None, None, None, "extra")], "conv_id long, turn int, role string, text string, last string")
    check_chat(chat.read_back(chat.expand(df)).collect(), {**conversations, 5: [("", "")]})
    assert chat.read_back(chat.expand(df.limit(0))).count() == 0
    examples = [r for r in chat.expand(df).collect() if r.conv_id == 4]
    assert [(chat.parse(e.text), e.text[e.loss_start : e.loss_end]) for e in sorted(examples, key=lambda e: e.turns)] == [
        (conversations[4][:1], "first"), (conversations[4][:2], "second"), (conversations[4], "")
    ]


def test_chat_of_repeated_rows_and_missing_ids(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "c"), (None, None, "assistant", None)]
    conversations = {1: [("user", "a"), ("user", "a"), ("assistant", "b")], None: [("assistant", ""), ("user", "c")]}
    check_chat(chat.read_back(chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect(), conversations)


def test_chat_examples_out_of_order_are_refused(spark):
    rows = spark.createDataFrame([(c, k, role, f"{c}{k}") for c in (1, 2) for k, role in enumerate(("user", "assistant", "user", "assistant"))], "conv_id long, turn long, role string, text string")
    examples = sorted(chat.expand(rows).collect(), key=lambda r: (r.turns, r.conv_id))
    with pytest.raises(Exception, match="out of order"):
        chat.read_back(spark.createDataFrame(examples, chat.EXAMPLES).coalesce(1)).collect()


def test_chat_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    expected = con.sql(queries.oracle_sql()["op8_chat"])
    assert sorted(map(str, (tuple(r) for r in queries.op8_chat(spark, SMALL).select(*expected.columns).collect()))) == sorted(map(str, expected.fetchall()))


WORDS = {"en": "the of and with that this was have from they", "fr": "le la les des une dans pour avec sur être", "de": "der die das und nicht mit ein für auf ist"}


def made_texts(n, seed=0):
    random.seed(seed)
    return [(lang, " ".join(random.choice(WORDS[lang].split()) + random.choice(["", "er", "x"]) for _ in range(random.randrange(2, 40)))) for lang in WORDS for _ in range(n)]


def letters_of(texts):
    return " ".join(t for _, t in texts) * 40


def test_languages_of_held_out_rows(docs_of):
    known = made_texts(80)
    docs = docs_of([t for _, t in known], lang={k: lang for k, (lang, _) in enumerate(known)})
    model = langid.train(docs, fold(5) != 0)
    fresh = made_texts(40, 1)
    got = {r.doc_id: r for r in langid.predict(docs_of([t for _, t in fresh]), model).collect()}
    assert sum(got[k].lang_pred == lang for k, (lang, _) in enumerate(fresh)) >= 0.95 * len(fresh)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in langid.predict(docs_of([None, "", "123 !! ___", "²½"]), model).collect()}
    assert set(odd.values()) == {("und", 0.0, True)}
    long, parts = letters_of(fresh), langid.PART
    whole, runs = langid.subwords(langid.letters(long))
    p = model.probabilities(model.table[whole].mean(axis=0, dtype=np.float64) + model.bias)
    known = model.known(model.share(model.hits(int(p.argmax()), runs), len(runs)))
    assert len(long) > parts and model.predict(long)[1] == pytest.approx(p.max() * known)
    kept = langid.predict(docs_of(["the and of"]), model, keep_rows=True).select("row.*").first()
    assert kept.text == "the and of" and kept.score == "x" and kept.node == 2.5


def test_language_ignores_what_it_may_not_see(spark, sample):
    model = langid.train(sample, fold(5) != 0)
    held = sample.filter(fold(5) == 0)
    shuffled = held.withColumnsRenamed({"lang": "source", "source": "lang"})
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict(x, model).collect()) for x in (held, shuffled))
    assert a == b
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert np.mean([truth[i] == lang for i, lang, _ in a]) >= 0.95


STRANGERS = [
    "Tämä on suomenkielinen lause, jota malli ei ole koskaan nähnyt opetuksessa.", "To jest zdanie w języku polskim, którego model nie widział podczas nauki.",
    "Это предложение на русском языке, которого модель не видела.", "これは日本語の文章です。モデルは見たことがありません。", "asdkfj qwoeiru zxcmvn qpwoeiruty alskdjf zmxncb",
    "Ez egy magyar nyelvű mondat, amelyet a modell soha nem látott.", "这是一个中文句子模型没有见过", "هذه جملة باللغة العربية لم يرها النموذج",
]


def test_strangers_are_rejected_and_learned_languages_are_not(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs, fold(5) != 0)
    assert 1e-3 < model.temperature < 20
    got = {r.doc_id: r for r in langid.predict(docs_of(STRANGERS), model).collect()}
    assert all(r.rejected and r.score < 0.1 for r in got.values())
    held = langid.predict(docs.filter(fold(5) == 0), model).collect()
    assert np.mean([r.rejected for r in held]) <= 0.01
    random.seed(9)
    mixed = ["".join(random.sample(r.text, len(r.text))) for r in docs.filter(fold(5) == 0).limit(60).collect() if r.text and len(r.text) > 200]
    assert np.mean([r.rejected for r in langid.predict(docs_of(mixed), model).collect()]) >= 0.9


@pytest.mark.parametrize("modulus", [2, 5])
def test_words_kept_out_of_training_are_not_strange(spark, docs_of, modulus):
    """Held-out documents reduced to words that no text learned from has: a half or a fifth of all distinct words."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.lang and r.text]

    def cut(text, unseen):
        return " ".join(w for w in langid.letters(text).split() if (zlib.crc32(w.encode()) % modulus == 0) == unseen)

    held = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    pairs = [(r.doc_id, cut(r.text, r.doc_id in held)) for r in rows]
    docs = docs_of(pairs, lang={r.doc_id: r.lang for r in rows})
    seen = {w for i, t in pairs if i not in held for w in t.split()}
    assert not any(w in seen for i, t in pairs if i in held for w in t.split())
    model = langid.train(docs, fold(5) != 0)
    truth = {r.doc_id: r.lang for r in rows}
    got = [r for r in langid.predict(docs.filter((fold(5) == 0) & (F.length("text") > 0)), model).collect()]
    assert len(got) > 100 and np.mean([not r.rejected for r in got]) >= 0.95
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) >= 0.95
    assert np.mean([r.rejected for r in langid.predict(docs_of(STRANGERS), model).collect()]) >= 0.9


def test_language_samples_are_bounded_whatever_repeats(docs_of, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROWS", 15)
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    monkeypatch.setattr(langid, "MOST_FEATURES", 40)
    pairs = [(6, f"the same id again {k}") for k in range(2_000)] + [(k, f"le texte {k} des mots et la suite de tous les mots qui sont là") for k in range(100, 200)] + [(k, "der die das") for k in range(300, 305)]
    docs = docs_of(pairs, lang={**{6: "en"}, **dict.fromkeys(range(100, 200), "fr"), **dict.fromkeys(range(300, 305), "de")})
    held = []
    monkeypatch.setattr(langid, "fit", held.extend)
    langid.train(docs, fold(5) != 0)
    count = {lang: sum(r[0] == lang for r in held) for lang in ("en", "fr", "de")}
    assert count["fr"] == 15 and count["en"] + count["de"] <= 15 and not (count["en"] and count["de"])
    assert max(len(x) for r in held for x in (r[1], r[3], r[4])) == 40


def test_samples_of_many_languages_are_bounded_together(docs_of, monkeypatch):
    """Every language is learned; their rows and features are fewer the more languages there are."""
    monkeypatch.setattr(langid, "MOST_SAMPLE", 200)
    monkeypatch.setattr(langid, "MOST_VALUES", 2_000)
    monkeypatch.setattr(langid, "LEAST_ROWS", 2)
    monkeypatch.setattr(langid, "LEAST_FEATURES", 9)
    pairs = [(k, f"{chr(97 + k % 26)}{chr(97 + k % 40 // 26)} words of text {k} and some more of these") for k in range(1, 4_001)]
    held = []
    monkeypatch.setattr(langid, "fit", held.extend)
    langid.train(docs_of(pairs, lang={k: f"l{k % 40:02}" for k, _ in pairs}), fold(5) != 0)
    counts = {lang: sum(r[0] == lang for r in held) for lang in {r[0] for r in held}}
    assert set(counts) == {f"l{k:02}" for k in range(40)} and set(counts.values()) == {5}
    assert max(len(x) for r in held for x in (r[1], r[3], r[4])) == 10


def test_languages_are_learned_from_odd_rows_too(docs_of):
    long = "und der lange text " * 200_000  # shuffled letters come from all of it
    pairs = [(1, None), (2, ""), (3, "12 !"), (4, long)] + [(k, f"the words of text {k} and that") for k in range(6, 60)] + [(k, f"der die das und {k}") for k in range(60, 120)]
    docs = docs_of(pairs, lang={1: "xx", 2: "yy", 3: "zz", 4: "de", **dict.fromkeys(range(6, 60), "en"), **dict.fromkeys(range(60, 120), "de")})
    model = langid.train(docs, fold(5) != 0)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert got[4].lang_pred == "de" and {got[k].lang_pred for k in (1, 2, 3)} == {"und"} and got[7].lang_pred == "en"
    assert langid.features("a", " " + "ab" * 10 + " " + "z" * 3_000_000 + " ", 50) is not None


def test_language_slopes_are_those_of_the_loss():
    draw = np.random.default_rng(0)
    table, layer, bias = draw.normal(0, 1, (9, 4)), draw.normal(0, 1, (4, 3)), draw.normal(0, 1, 3)
    found, share = np.array([1, 4, 7]), np.array([0.2, 0.5, 0.3])
    # forward, term by term
    logits = [bias[c] + sum(s * table[f][d] * layer[d][c] for f, s in zip(found, share, strict=True) for d in range(4)) for c in range(3)]
    loss, by_table, by_layer, by_bias = langid.loss_and_slopes(table, layer, bias, found, share, 2)
    assert loss == pytest.approx(np.log(sum(np.exp(z - logits[2]) for z in logits)))
    for array, slopes, rows in ((table, by_table, found), (layer, by_layer, range(4))):
        for i, row in enumerate(rows):
            for j in range(array.shape[1]):
                kept = array[row, j]
                ends = []
                for d in (1e-6, -1e-6):
                    array[row, j] = kept + d
                    ends.append(langid.loss_and_slopes(table, layer, bias, found, share, 2)[0])
                array[row, j] = kept
                assert slopes[i, j] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)
    assert by_bias.sum() == pytest.approx(0)


def test_equally_probable_languages_go_by_name(docs_of):
    table = np.zeros((1 << langid.BITS, 2), np.float32)
    model = langid.Model(["aa", "bb"], table, np.zeros(2), np.zeros((2, 1 << langid.RUN_BITS - 3), np.uint8))
    assert {r.lang_pred for r in langid.predict(docs_of(["some text", "other"]), model).collect()} == {"aa"}


def test_language_without_anything_to_learn(docs_of):
    assert langid.train(docs_of(["a"]), fold(5) != 0) is None
    assert langid.predict(docs_of(["a"]), None).first()[1:] == ("und", 0.0, True)
    assert langid.predict(docs_of([]), None).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels, fold(3) != 1)
    held = toxicity.score(docs.filter(fold(3) == 1), model).join(labels, "doc_id").select("toxic", "score", "predicted").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() >= 0.8 and clean.predicted.mean() <= 0.02
    order = held.score.rank()
    auc = (order[held.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc >= 0.93


@pytest.mark.parametrize(("size", "found", "wrong"), [("sf0.001", 0.4, 0.0), ("sf0.01", 0.7, 0.01)])
def test_toxicity_of_few_labels(spark, size, found, wrong):
    """Few toxic rows to learn from: six and 33."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, fold(3) != 1)
    held = toxicity.score(docs.filter(fold(3) == 1), model).join(labels, "doc_id").select("toxic", "score", "predicted").toPandas()
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert held.score.nunique() > 10
    assert (toxic.predicted == 1).mean() >= found and (clean.predicted == 1).mean() <= wrong
    if len(toxic) > 10:
        above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()).mean() + (toxic.score.to_numpy()[:, None] == clean.score.to_numpy()).mean() / 2
        assert above >= 0.85


def test_no_scale_is_dropped_in_silence():
    draw = np.random.default_rng(3)
    with pytest.warns(UserWarning, match="kept toxic rows"):
        p, u = draw.normal(-1, 1, 40), draw.normal(0, 1, 400)
        scale, shift = toxicity.calibrated(p, u, 0.1)
    assert scale > 0 and 1 / (1 + np.exp(-scale * np.minimum(u, np.median(p)).mean() - shift)) == pytest.approx(0.1)


def test_toxicity_edges(spark, docs_of):
    docs = docs_of([None, "", "fine words", "x" * 100_000, "same", "same"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none, fold(3) != 1) is None
    assert {(r.score, r.predicted) for r in toxicity.score(docs, None).collect()} == {(0.0, 0)}
    assert toxicity.score(docs_of([]), None).count() == 0
    w = np.zeros(1 << toxicity.BITS, np.float32)
    got = {r.doc_id: r.score for r in toxicity.score(docs, (w, -3.0)).collect()}
    assert got[0] == got[1] and got[4] == got[5] and len(got) == 6


def test_risk_is_the_prior_corrected_one():
    """With U a mixture of P and clean rows, the fitted margin separates clean rows of U from toxic ones, which no row was marked for."""
    draw = np.random.default_rng(0)

    def row(toxic):
        found = np.unique(np.append(draw.integers(100, 400, 30), draw.integers(0, 10, 6) if toxic else [])).astype(np.int32)
        return found, np.full(len(found), 0.2, np.float32)

    p, hidden = [row(True) for _ in range(60)], [k < 60 for k in range(400)]
    u = [row(t) for t in hidden]
    w, bias = toxicity.fit(toxicity.Rows(p), toxicity.Rows(u), 0.15)
    said = toxicity.Rows(u).dot(w) + bias >= np.log(0.7 / 0.3)
    hidden = np.array(hidden)
    assert said[hidden].mean() > 0.8 and said[~hidden].mean() < 0.03


@pytest.mark.parametrize("bias", [0.5, -9.0])
def test_slopes_are_those_of_the_objective(bias):
    """Numerically, where the clean risk is above and below zero."""
    draw = np.random.default_rng(3)

    def row():
        found = np.unique(draw.integers(0, 12, 5)).astype(np.int32)
        return found, draw.random(len(found)).astype(np.float32)

    p, u, w = toxicity.Rows([row() for _ in range(9)]), toxicity.Rows([row() for _ in range(20)]), np.append(draw.normal(0, 1, 12), 0.0)
    if bias < 0:  # P far on the toxic side, U on the clean one
        p, u = toxicity.Rows([(np.array([0], np.int32), np.ones(1, np.float32))] * 3), toxicity.Rows([(np.array([1], np.int32), np.ones(1, np.float32))] * 5)
        w[0], w[1] = 12.0, -12.0
    clean = np.logaddexp(0, u.dot(w[:-1]) + w[-1]).mean() - 0.3 * np.logaddexp(0, p.dot(w[:-1]) + w[-1]).mean()
    assert (clean < 0) == (bias < 0)
    _, slope = toxicity.objective(w, p, u, 0.3)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert slope[k] == pytest.approx((toxicity.objective(w + step, p, u, 0.3)[0] - toxicity.objective(w - step, p, u, 0.3)[0]) / 2e-6, abs=1e-6)


def test_scores_equal_a_plain_computation(docs_of):
    """Of every word and beginning, by a dictionary instead of hashed tables."""
    texts = [None, "", "Fine words, FINE day", "one two three two", "straße STRASSE"]
    w = np.random.default_rng(5).normal(0, 5, 1 << toxicity.BITS).astype(np.float32)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs_of(texts), (w, 0.25)).collect()}
    for k, t in enumerate(texts):
        words = "".join(c if c.isalpha() else " " for c in (t or "").casefold()).split()
        counts = {}
        for word in words:
            for f in [word, *("^" + word[:n] for n in (3, 4, 5, 6) if len(word) > n)]:
                b = xxhash.xxh32_intdigest(f) & ((1 << toxicity.BITS) - 1)
                counts[b] = counts.get(b, 0) + 1
        expected = 1 / (1 + np.exp(-0.25 - sum(float(w[b]) * np.sqrt(n / len(words)) for b, n in counts.items())))
        assert got[k] == (pytest.approx(expected, rel=1e-4), int(expected >= 0.7))


@pytest.mark.parametrize("share", [0.05, 0.01, 0.002])
def test_rare_toxic_texts_are_found(share):
    draw = np.random.default_rng(7)

    def row(toxic):
        found = np.unique(np.append(draw.integers(100, 400, 30), draw.integers(0, 10, 12) if toxic else [])).astype(np.int32)
        return found, np.full(len(found), 0.2, np.float32)

    w, bias = toxicity.fit(toxicity.Rows([row(True) for _ in range(max(30, int(8_000 * share)))]), toxicity.Rows([row(k < 8_000 * share) for k in range(8_000)]), share)
    hidden = np.arange(2_000) < 400
    said = toxicity.Rows([row(x) for x in hidden]).dot(w) + bias >= np.log(0.7 / 0.3)
    assert said[hidden].mean() >= 0.9 and said[~hidden].mean() <= 0.005


def test_samples_are_bounded_whatever_repeats(spark, docs_of, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TOXIC", 20)
    monkeypatch.setattr(toxicity, "MOST_UNLABELLED", 30)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 50)
    docs = docs_of([(7, f"same id {k}") for k in range(3_000)] + [(k, f"bad words {k} " + " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200))) for k in range(100, 400)])
    labels = spark.createDataFrame([(7, 1), *((k, k % 2) for k in range(100, 400))], "doc_id long, toxic int")
    held = {}
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: held.update(p=p, u=u))
    toxicity.train(docs, labels, fold(3) != 1)
    assert len(held["p"]) == 20 and len(held["u"]) == 30 and max(held["u"].sizes) == 50


def test_words_of_toxic_examples_count_however_rare_among_unlabelled():
    draw = np.random.default_rng(1)

    def row(toxic):
        found = np.unique(np.append(draw.integers(100, 400, 30), draw.integers(0, 10, 6) if toxic else [])).astype(np.int32)
        return found, np.full(len(found), 0.2, np.float32)

    p, u = [row(True) for _ in range(100)], [row(k < 4) for k in range(2_000)]  # 0.2 % of U is toxic
    w, bias = toxicity.fit(toxicity.Rows(p), toxicity.Rows(u), 0.002)
    assert (w[:10] > 0).all()
    found = toxicity.Rows(u).dot(w) + bias
    assert found[:4].min() > found[4:].max()


@pytest.mark.parametrize("share", [0.05, 0.15, 0.3])
def test_the_threshold_is_no_quota(share):
    """Rows that the classifier tells apart are all found, and how many are said to be toxic follows the rows that are scored."""
    draw = np.random.default_rng(2)

    def row(toxic):
        found = np.unique(np.append(draw.integers(100, 400, 30), draw.integers(0, 10, 12) if toxic else [])).astype(np.int32)
        return found, np.full(len(found), 0.2, np.float32)

    w, bias = toxicity.fit(toxicity.Rows([row(True) for _ in range(400)]), toxicity.Rows([row(k < 2_000 * share) for k in range(2_000)]), share)
    for fresh in (0.0, 0.05, 0.5):
        hidden = np.arange(1_000) < 1_000 * fresh
        said = toxicity.Rows([row(x) for x in hidden]).dot(w) + bias >= np.log(0.7 / 0.3)
        assert said[hidden].sum() >= 0.97 * hidden.sum() and said[~hidden].mean() <= 0.01


def test_lm_scores_by_definition(spark, docs_of, byte_bpe):
    texts = ["the cat sat", "the cat ran off", "buy now buy now", "", None, "the dog sat " * 300, "the cat sat"]
    good = spark.createDataFrame([(0,), (1,), (1,), (None,)], "doc_id int")
    got = {r.doc_id: r for r in lmscore.scores(docs_of(texts), good, byte_bpe).collect()}
    enc = tokenizer(byte_bpe)
    ids = [enc.encode(t or "") for t in texts]
    v = enc.n_vocab
    for k, mine in enumerate(ids):
        if not mine:
            assert (got[k].n_tokens, got[k].score) == (0, 0.0)
            continue
        expected = []
        for side in ({0, 1}, set(range(len(texts)))):  # leave-one-out counts by plain recounting; pairs aren't hashed here
            rest = [ids[j] for j in side if j != k and ids[j]]
            tokens = [t for r in rest for t in r]
            pairs = [p for r in rest for p in zip([v, *r[:-1]], r, strict=True)]
            starts = len(rest)
            total = 0.0
            for h, w in zip([v, *mine[:-1]], mine, strict=True):
                c_h = starts if h == v else tokens.count(h)
                c_hw = pairs.count((h, w))
                q = (tokens.count(w) + 1) / (len(tokens) + v)
                total -= np.log((c_hw + lmscore.MASS * q) / (max(c_h, c_hw) + lmscore.MASS))
            expected.append(total / len(mine))
        assert got[k].n_tokens == len(mine)
        assert (got[k].loss_target, got[k].loss_background) == (pytest.approx(expected[0]), pytest.approx(expected[1]))
        assert got[k].score == pytest.approx(expected[1] - expected[0])
    assert lmscore.scores(docs_of([]), good, byte_bpe).count() == 0


def test_lm_missing_and_repeated_ids(spark, docs_of, byte_bpe):
    docs = docs_of([(None, "a b c"), (None, "a b c"), (7, "x y z"), (7, "other text here"), (9, None)])
    rows = lmscore.scores(docs, spark.createDataFrame([(7,), (None,)], "doc_id int"), byte_bpe).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("7", 3), ("7", 3), ("9", 0), ("None", 3), ("None", 3)]
    assert len({r.score for r in rows if r.doc_id is None}) == 1


@pytest.mark.parametrize("fan", [512, 2])
def test_lm_pairs_are_counted_exactly(spark, docs_of, byte_bpe, monkeypatch, fan):
    """More distinct pairs than any table of fixed size would tell apart, over several chunks; added up at once and in lanes of lanes."""
    monkeypatch.setattr(lmscore, "CHUNK", 200_000)
    monkeypatch.setattr(lmscore, "FAN", fan)
    draw = np.random.default_rng(3)
    enc = tokenizer(byte_bpe)
    texts = [enc.fast.decode(draw.integers(1000, 40_000, 60_000).tolist()) for _ in range(8)]
    chunked = lmscore.written(lmscore.tokenised(lmscore.flagged(docs_of(texts), spark.createDataFrame([(0,)], "doc_id int")), byte_bpe), "tokens")
    v, found, seen = enc.n_vocab, {}, {}
    for row in chunked.toArrow().to_pylist():
        c = lmscore.Chunk(row, v)
        found[row["chunk"]] = c
        for x, n in zip(lmscore.unmixed(c.distinct).tolist(), c.often.tolist(), strict=True):
            seen[x] = seen.get(x, 0) + n
    expected = {}
    for t in texts:
        ids = enc.encode(t)
        for h, w in zip([v, *ids[:-1]], ids, strict=True):
            expected[h * (v + 1) + w] = expected.get(h * (v + 1) + w, 0) + 1
    assert seen == expected and len(found) > 1 and len(seen) > 400_000
    tokens, answers = lmscore.counts(chunked, v)
    assert tokens[0][:-1].sum() == sum(expected.values()) and tokens[0][-1] == len(texts)
    for row in answers.toArrow().to_pylist():
        c = found[row["chunk"]]
        got = np.concatenate([lmscore.opened(x["background"]) for x in row["answers"]])
        assert got.tolist() == [expected[x] for x in lmscore.unmixed(c.distinct).tolist()]


def test_lm_probabilities_add_up_to_one():
    """Over all tokens after a token, and the chance that the text ends there."""
    v, texts = 6, [np.array([0, 1, 2, 1, 1]), np.array([1, 2, 2]), np.array([3])]
    tokens = np.append(np.bincount(np.concatenate(texts), minlength=v), len(texts))
    pairs = [p for t in texts for p in zip([v, *t[:-1]], t, strict=True)]
    for h in range(v + 1):
        seen = [0 if h == v else sum(t[-1] == h for t in texts)]
        total = seen[0] / (tokens[h] + lmscore.MASS)
        for w in range(v):  # the text h w, of which only the last token's loss is wanted
            if h == v:
                total += np.exp(-lmscore.loss(np.array([w]), tokens, int(tokens[:-1].sum()), np.zeros(1), np.array([pairs.count((v, w))]), False))
            else:
                both = [lmscore.loss(np.array(x), tokens, int(tokens[:-1].sum()), np.zeros(len(x)), np.array([pairs.count(p) for p in zip([v, *x], x, strict=False)]), False) for x in ([h, w], [h])]
                total += np.exp(-(2 * both[0] - both[1]))
        assert total == pytest.approx(1)


def test_lm_scores_tell_good_documents(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = queries.op7_lmscore(spark, data).join(labels, "doc_id").select("quality", "score").toPandas()
    good, order = rows.quality == 1, rows.score.rank()
    auc = (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.85


def test_training_holds_no_second_copy_of_a_sample():
    """Slopes of a sample of four million entries need a bounded part of it at a time."""
    import tracemalloc

    import numpy as np

    from editspark.llm import toxicity

    n, m = 4_000, 1_000
    rows = toxicity.Rows([(np.arange(k % 7, k % 7 + m, dtype=np.int32), np.ones(m, np.float32)) for k in range(n)])
    tracemalloc.start()
    out = rows.back(np.ones(n), 2_000)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert out.sum() == n * m
    assert peak < 36 << 20


def test_large_samples_train_in_a_task_to_the_same_models(spark, docs_of, monkeypatch):
    docs = docs_of([(k, f"le texte {k} des mots {k * 7}" if k % 2 else f"the text {k} of words {k * 3} and more") for k in range(200)], lang={k: "fr" if k % 2 else "en" for k in range(200)})
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    here = langid.train(docs, fold(5) != 0), toxicity.train(docs, labels, fold(3) != 1)
    monkeypatch.setattr(common, "SMALL_SAMPLE", 0)
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "fit", None)  # the driver's alone
    there = langid.train(docs, fold(5) != 0), toxicity.train(docs, labels, fold(3) != 1)
    assert (there[0].table == here[0].table).all() and there[0].least == here[0].least and (there[1][0] == here[1][0]).all() and there[1][1] == here[1][1]
