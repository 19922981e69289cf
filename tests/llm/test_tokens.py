"""Token encoding, the range coder, the token store and packing."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltmark.llm import packing, rangecoder, tokens, tokenstore
from siltmark.llm.tokens import Encoder, tokenizer_path
from siltmark.plans.session import new_path
from tests.llm.fixtures import documents, empty, frame

ODD = ["", "a  b", " x", "x ", "\n", "a\nb\n", "İstanbul’s ſ ﬁ é ́x", "don't can't it's.", "ＡＢ１２", "a\tb \tc", "日本語 テスト.", "ΣΑΣ ΑΣ.", "a b  c", "1234,56. x.y", ".,", "\x1c\x1d"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    encoder = Encoder(tokenizer_path(name))
    for text in ODD + [r[1] or "" for r in documents()[:50]]:
        assert list(np.frombuffer(encoder.ids(text), "<u2")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encoder.ids(None) == b""


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n\t'é́Σß1日 "), max_size=40))
def test_encoder_on_random_text(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = _cached(name)
        assert list(np.frombuffer(encoder.ids(text), "<u2")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [1, 50, 1 << 23])
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_many_texts_are_encoded_at_once(monkeypatch, name, size):
    """Words of plain letters with marks are not looked up one by one, and slices of texts change nothing."""
    monkeypatch.setattr(tokens, "SLICE_BYTES", size)
    letters = [c for c in map(chr, range(0x140)) if c.isalpha()]
    texts = [*ODD, None, *letters, *[f"x{c}{c}y" for c in letters], "Ab.. ab, AB aB!? Ab", "ÄÖ äö. äÖ'", *[r[1] for r in documents()[:50]], None]
    encoder = Encoder(tokenizer_path(name))
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(np.frombuffer(b, "<u2")) for b in encoder.ids_of(pa.array(texts))] == want
    assert list(encoder.ids_of(pa.array(texts[:40])[7:7])) == [] and list(encoder.ids_of(pa.array([None], pa.string()))) == [b""]
    assert [list(np.frombuffer(b, "<u2")) for b in encoder.ids_of(pa.array(texts)[10:90])] == want[10:90]
    if encoder.drops_space:
        asked = []
        monkeypatch.setattr(tokens._Words, "__missing__", lambda self, word: asked.append(word) or b"")
        list(Encoder(tokenizer_path(name)).ids_of(pa.array(["Some plain words, of letters. Großer Ärger; 1 don't"])))
        assert sorted(asked) == ["1", "don't"]


def test_kept_encoder_meets_words_again(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    tokens.forget()
    first = tokens.kept_encoder(path)
    want = list(first.ids_of(pa.array(["Wörter once, and again."])))
    again = tokens.kept_encoder(path)
    monkeypatch.setattr(again.first, "tokenize", None)  # nothing is asked of the model
    assert again is first and list(again.ids_of(pa.array(["Wörter once, and again."]))) == want
    tokens.forget()
    assert tokens.kept_encoder(path) is not first
    tokens.forget()


@pytest.mark.parametrize("room", [0, 300, 3000])
def test_words_are_kept_within_their_room(room):
    encoder = Encoder(tokenizer_path("word_bpe_49k.json"), room)
    texts = [r[1] for r in documents()[:20]]
    for _ in range(2):
        assert list(encoder.ids_of(pa.array(texts, pa.string()))) == [_cached("word_bpe_49k.json").ids(t) for t in texts]
    assert len(encoder.first) <= room // tokens.ENTRY_BYTES + 1


def _cached(name, held={}):
    if name not in held:
        held[name] = Encoder(tokenizer_path(name))
    return held[name]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 200), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([2, 50, 5000, 65536]))
def test_range_coder_round_trip(steps, lanes, seed, top):
    ids = np.random.default_rng(seed).integers(0, top, (steps, lanes)).astype(np.uint16)
    assert (rangecoder.decode(rangecoder.encode(ids), steps) == ids).all()


def test_range_coder_learns_and_blocks_are_independent():
    rng = np.random.default_rng(1)
    skewed = (rng.zipf(1.3, (2048, 4)) % 40000).astype(np.uint16)
    repeated = np.tile(rng.integers(0, 40000, (64, 4)), (32, 1)).astype(np.uint16)
    assert sum(map(len, rangecoder.encode(skewed))) < 0.6 * skewed.nbytes
    assert sum(map(len, rangecoder.encode(repeated))) < 0.2 * repeated.nbytes
    assert rangecoder.encode(skewed)[2] == rangecoder.encode(skewed[:, 2:3].copy())[0]


def test_coder_beats_plain_compression(sf_dir):
    """Bits an id on real ids: below DEFLATE on the same blocks and near an ideal adaptive order-0 code with escapes (8.6)."""
    import pyarrow.parquet as pq

    encode = _cached("word_bpe_49k.json").ids
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"]).column(0).to_pylist()
    ids = np.frombuffer(b"".join(encode(t) for t in texts), "<u2")
    blocks = ids[: len(ids) // 2048 * 2048].reshape(-1, 2048)
    coded = rangecoder.encode(np.ascontiguousarray(blocks.T))
    assert (rangecoder.decode(coded, 2048).T == blocks).all()
    bits, plain = (8 * sum(map(len, c)) / blocks.size for c in (coded, [zlib.compress(b.tobytes(), 9) for b in blocks]))
    assert bits < 0.9 * plain and bits < 9.2


@pytest.mark.parametrize("ids", [[], [0], [65535], [7] * 2048, [0, 65535] * 1024, list(range(2048)), list(range(0, 65536, 32)), [3, 2, 1]])
def test_alphabets_round_trip(ids):
    if ids:
        column = np.array(ids, np.uint16)[:, None]
        both = np.concatenate([column, column[::-1]], axis=1)
        assert (rangecoder.decode(rangecoder.encode(both), len(ids)) == both).all()
        sizes = np.array([len(set(ids))] * 2)
        alphabet, read, after = rangecoder.read_alphabets(rangecoder.write_alphabets(np.array(sorted(set(ids)) * 2, np.uint16), sizes))
        assert alphabet.tolist() == sorted(set(ids)) * 2 and read.tolist() == sizes.tolist()
    else:
        with pytest.raises(ValueError):
            rangecoder.encode(np.zeros((2049, 1), np.uint16))


def test_chunks_check_their_sums():
    chunk = tokenstore._Chunk()
    chunk.add(5, np.arange(5000, dtype="<u2").tobytes())
    chunk.add(None, b"")
    data = tokenstore.pack_chunks([chunk])[0]
    (docs, ids), = tokenstore.unpack_chunks([data])
    assert docs["n"].tolist() == [5000, 0] and docs["null"].tolist() == [0, 1] and (ids == np.arange(5000)).all()
    bad = data[:-40] + bytes([data[-40] ^ 255]) + data[-39:]
    with pytest.raises(ValueError):
        tokenstore.unpack_chunks([bad])
    with pytest.raises(ValueError):
        tokenstore.unpack_chunks([b"?" + data[1:]])


def test_store_round_trip(spark):
    encoder = Encoder(tokenizer_path("word_bpe_49k.json"))
    rows = documents() + [(None, "no id", "en", "s", 5, "x", 1)]
    path = new_path(spark, "test-tokens")
    tokenstore.write_tokens(frame(spark).union(spark.createDataFrame(rows[-1:], frame(spark).schema)), path)
    got = sorted(map(tuple, tokenstore.read_tokens(spark, path).withColumn("crc", F.crc32("ids")).drop("ids").collect()), key=lambda r: r[1])
    want, at = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*np.frombuffer(encoder.ids(text), "<u2"), 1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_store_of_nothing(spark):
    path = new_path(spark, "test-tokens")
    tokenstore.write_tokens(empty(spark), path)
    assert tokenstore.read_tokens(spark, path).count() == 0


@given(st.integers(0, 100000))
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 1024 for x in lengths) and lengths == sorted(lengths, reverse=True)
    assert len([x for x in lengths if x < 1024]) == len({x for x in lengths if x < 1024})


def test_pack(spark):
    encoder = Encoder(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(frame(spark)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    texts = {r[0]: r[1] for r in documents()}
    for doc_id, text in texts.items():
        ids = np.array([*np.frombuffer(encoder.ids(text), "<u2"), 0], "<u4")
        mine = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.start)
        twice = 2 if doc_id == 3 else 1
        assert sum(r.length for r in mine) == twice * len(ids) and {r.doc_tokens for r in mine} == {len(ids)}
        if twice == 1:
            assert b"".join(bytes(r.ids) for r in mine) == ids.tobytes()
        assert [r.length for r in mine if twice == 1] == (packing.piece_lengths(len(ids)) if twice == 1 else [])
    assert packing.pack(empty(spark)).count() == 0


def test_buckets(spark):
    path = new_path(spark, "test-buckets")
    packing.write_buckets(frame(spark), path)
    stored = spark.read.parquet(path)
    assert stored.where("bucket <> length").count() == 0 and stored.count() == packing.pack(frame(spark)).count()
    ranges = stored.groupBy("bucket").agg(F.min("sequence_id").alias("a"), F.max("sequence_id").alias("b")).orderBy("bucket").collect()
    assert len(ranges) > 5 and all(x.b < y.a for x, y in zip(ranges, ranges[1:]))
