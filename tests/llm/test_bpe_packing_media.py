import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from editspark.llm import bpe, media, packing, queries

ODD = [None, "", " ", "a", "<|endoftext|>x<|endoftext|>", "é" * 700, "word " * 30_000, "\n\t  \r\n", "naïve – “ok” 你好 🙂🙂", "a" * 5000, "same", "same", "it's we'll 12345"]


@pytest.fixture(scope="module")
def library(byte_bpe):
    t = Tokenizer.from_file(byte_bpe)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_library_and_decode_to_the_text(spark, docs_of, byte_bpe, library):
    docs = docs_of(ODD)
    encoded = bpe.encode_documents(docs, byte_bpe)
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in encoded.collect()}
    assert ids == {k: library(t or "") for k, t in enumerate(ODD)}
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, byte_bpe).collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.round_trip(docs.limit(0), byte_bpe).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    path = queries.BYTE_BPE
    enc = bpe.encoder(path)
    (ids,) = enc.encode_batch([text])
    t = test_any_text.__dict__.setdefault("library", Tokenizer.from_file(path))
    expected = t.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == expected
    assert enc.decode(ids) == text == t.decode(expected, skip_special_tokens=False)
    assert packing.tokenizer(path).encode(text) == expected


@pytest.mark.parametrize("unit", [" ", "\n", "ab", "你", " \n\t"])
def test_very_long_words_and_gaps(byte_bpe, library, unit):
    text = "start" + unit * (2_000_000 // len(unit)) + " end"
    expected = library(text)
    assert packing.tokenizer(byte_bpe).encode(text) == expected
    (ids,) = bpe.encoder(byte_bpe).encode_batch([text])
    assert np.frombuffer(ids, "<u4").tolist() == expected


def test_long_texts_of_either_encoder_agree(byte_bpe, library):
    text = "word " * 900 + "x" * 5000 + " tail <|endoftext|>" + " " * 5000 + "é"
    enc = packing.tokenizer(byte_bpe)
    assert enc.encode(text) == library(text) == enc.fast.encode(text, allowed_special="all")


def test_prefixes_are_encoded_once(byte_bpe):
    enc = bpe.TrieEncoder(byte_bpe)
    words = sorted({b"tokenization", b"tokens", b"token", b"tokenizer"})
    assert [enc.bytes_of[i] for i in list(enc.traverse(words))[0]] == enc.merged(b"token")
    assert [[enc.bytes_of[i] for i in ids] for ids in enc.traverse(words)] == [enc.merged(w) for w in words]


def test_query_digests(spark, library):
    rows = queries.op1_bpe(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows[:60]:
        ids = library(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(struct.pack("<I", i) for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def check_packing(rows, docs, library, capacity):
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for doc, text in docs.items():
        ids = [*library(text or ""), 0]
        mine = sorted(pieces.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        at = 0
        for k, r in enumerate(mine):
            assert r.start == at and 1 <= r.length <= capacity and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(mine) == 1)
    assert not pieces
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(fill)


def test_packing_of_the_sample(spark, library):
    rows = queries.op2_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    used = check_packing(rows, docs, library, 2048)
    assert used <= 1.01 * sum(r.length for r in rows) / 2048 + 1


def test_packing_of_odd_texts(spark, docs_of, byte_bpe, library):
    docs = docs_of(ODD)
    check_packing(packing.pack(docs, byte_bpe, 100).collect(), dict(enumerate(ODD)), library, 100)
    assert packing.pack(docs.limit(0), byte_bpe).count() == 0
    packed = packing.pack(docs, byte_bpe, 100, with_ids=True)
    held = Counter()
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == 4 * s.length <= 400
        held.update(np.frombuffer(bytes(s.ids), "<u4").tolist())
    assert held == Counter(i for t in ODD for i in [*library(t or ""), 0])


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_use_every_piece_once_and_waste_little(counts):
    patterns = packing.Plan(dict(counts), 40).run()
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 40
        for n in pattern:
            used[n] += times
    assert used == Counter(counts)
    bins, total = sum(t for _, t in patterns), sum(n * c for n, c in counts.items())
    decreasing, open_bins = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True), []
    for n in decreasing:  # best fit decreasing, piece by piece
        fits = [k for k, gap in enumerate(open_bins) if gap >= n]
        if fits:
            open_bins[min(fits, key=lambda k: open_bins[k])] -= n
        else:
            open_bins.append(40 - n)
    assert -(-total // 40) <= bins <= len(open_bins) + max(2, len(open_bins) // 10)


def test_exact_complements_fill_whole_sequences():
    patterns = packing.Plan({60: 50, 40: 20, 25: 30, 15: 30}, 100).run()
    assert sum(t for _, t in patterns) == 50


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=900))
def test_images_give_the_bytes_back(data):
    body = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    png = media.encode(body)
    assert media.decode(png).tobytes() == body
    assert len(media.feature(media.decode(png))) == 16


def plain_filter(rows, kinds):
    """The format's five filters by definition."""
    out, up = b"", bytes(len(rows[0]))
    for kind, row in zip(kinds, rows, strict=True):
        line = []
        for c, x in enumerate(row):
            a, b, d = row[c - 1] if c else 0, up[c], up[c - 1] if c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            line.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out += bytes([kind, *line])
        up = row
    return out


def test_all_filters_are_undone():
    random.seed(3)
    rows = [bytes(random.randrange(256) for _ in range(64)) for _ in range(40)]
    kinds = [random.randrange(5) for _ in rows]
    raw = np.frombuffer(plain_filter(rows, kinds), np.uint8).reshape(-1, 65)
    assert media.unfiltered(raw, 64).tobytes() == b"".join(rows)


def test_damage_is_found():
    png = media.encode(media.payload("text"))
    for at in (0, 20, len(png) - 5, len(png) // 2):
        with pytest.raises(ValueError):
            media.decode(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode(png[:-12])


def test_media_query(spark, docs_of):
    rows = {r.doc_id: r for r in media.read_back(media.store(docs_of(ODD))).collect()}
    for k, text in enumerate(ODD):
        raw = (text or "").encode()
        body = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
    assert rows[10].feature == rows[11].feature and rows[10].media_sha256 == rows[11].media_sha256
    assert media.read_back(media.store(docs_of([]))).count() == 0


def test_very_long_texts_and_clashing_columns(spark, docs_of, byte_bpe):
    texts = ["é\n" * 1_500_000, "x" * 4_000_001, "short"]
    docs = docs_of(texts).selectExpr("*", "'a' AS ids", "1 AS png", "2 AS n_tokens", "'b' AS payload")
    for r in media.read_back(media.store(docs)).collect():
        raw = texts[r.doc_id].encode()
        assert r.n_bytes == len(raw) and r.payload_sha256 == hashlib.sha256(raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))).hexdigest()
    encoded = bpe.encode_documents(docs, byte_bpe)
    assert encoded.columns == ["doc_id", "ids"]
    decoded = bpe.decode_documents(encoded.selectExpr("*", "'a' AS text", "1 AS key"), byte_bpe).collect()
    assert {r.doc_id: r.text for r in decoded} == dict(enumerate(texts))


def test_missing_and_repeated_ids(spark, docs_of, byte_bpe):
    """Every row has its result, whatever ids say."""
    docs = docs_of([(None, "a b"), (None, "a b"), (7, "x y z"), (7, "other text"), (7, "x y z"), (9, None)])
    encoded = bpe.round_trip(docs, byte_bpe).collect()
    assert sorted(str(r.doc_id) for r in encoded) == ["7", "7", "7", "9", "None", "None"] and len({r.ids_sha256 for r in encoded}) == 4
    pieces = packing.pack(docs, byte_bpe, 4).collect()
    assert sum(r.length for r in pieces) == sum(r.n_tokens + 1 for r in encoded) and len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces)
    stored = media.read_back(media.store(docs)).collect()
    assert len(stored) == 6 and len({r.payload_sha256 for r in stored}) == 4


def test_the_index_of_sums_gives_combinations_that_are_there():
    draw = np.random.default_rng(3)
    for _ in range(40):
        left = np.zeros(61, np.int64)
        left[draw.integers(1, 61, 6)] = draw.integers(1, 3, 6)
        sums = packing.Sums(left)
        held = [n for n in range(61) for _ in range(left[n])]
        for _ in range(12):
            total = int(draw.integers(1, 61))
            for k, found in ((2, sums.pair(total)), (3, sums.triple(total))):
                there = any(sum(c) == total for c in itertools.combinations(held, k))
                assert (found is not None) == there
                if found:
                    assert sum(found) == total and not Counter(found) - Counter(held)
            if held:
                gone = held.pop(int(draw.integers(len(held))))
                left[gone] -= 1


def test_similar_pictures_have_near_features():
    draw = np.random.default_rng(1)
    base, other = (np.kron(draw.integers(0, 250, (16, 8)), np.ones((8, 8))).astype(np.uint8) for _ in range(2))
    noisy = base + draw.integers(0, 4, base.shape).astype(np.uint8)
    bits = [int(media.feature(x), 16) for x in (base, noisy, other)]
    assert (bits[0] ^ bits[1]).bit_count() <= 8 < (bits[0] ^ bits[2]).bit_count()
