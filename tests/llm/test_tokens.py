"""Byte BPE, packing and containers against their libraries, brute force and round trips."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe, isomedia, packing

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ODD = ["", " ", "a", "\n\n  x", "é" * 40, "ab" * 4000, " " * 3000, "日本語テキスト", "🤷🏽‍♀️ emoji", "don't we'll", "İstanbul. ΣΑΣ, ß", "a\x1cb\x85c d", "<|endoftext|> x", "x.y, z., w!? \"q\".", "ſt ŉ ǅ."]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_transducer_is_the_merges(encoding, text):
    assert bpe.encode_text(text, RANKS, P.PATTERN).tolist() == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(encoding, text):
    assert bpe.encode_text(text, RANKS, P.PATTERN).tolist() == encoding.encode_ordinary(text)


def test_small_state_table(encoding):
    small = bpe.Transducer(bpe.read_ranks(RANKS), max_states=50)
    for word in (" international", " antidisestablishmentarianism", "zzzzqqqq", "    "):
        assert small.encode(word.encode()) == encoding.encode_ordinary(word)
    assert len(small._states) <= 60


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.integers(1, 5))
def test_streaming_decode(text, step):
    _, decoder, _ = bpe._codec(RANKS, P.PATTERN)
    decoder.reset()
    ids = bpe.encode_text(text, RANKS, P.PATTERN)
    parts = [decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
    for part in parts:
        part.decode("utf-8")  # whole characters only
    assert b"".join(parts) + decoder.flush() == text.encode()


def test_decode_of_broken_bytes():
    ranks = bpe.read_ranks(RANKS)
    decoder = bpe.StreamingDecoder({i: t for t, i in ranks.items()})
    ids = np.array([ranks[bytes([b])] for b in b"a\xe2\x82b\xff\xe2"], np.uint32)
    assert decoder.feed(ids) + decoder.flush() == b"a\xe2\x82b\xff\xe2" and not decoder.valid


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def test_round_trip_query(spark, encoding):
    texts = [*ODD, None, "same", "same"]
    got = {r["doc_id"]: r for r in bpe.round_trip(docs(spark, texts), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(docs(spark, []), RANKS, P.PATTERN).count() == 0
    assert [r["ids"] for r in bpe.encode_documents(docs(spark, ["a b"]), RANKS, P.PATTERN).collect()] == [encoding.encode_ordinary("a b")]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_are_the_tokenizer(text):
    words = packing._words(WORDS)
    assert np.frombuffer(packing.encode_words(text, WORDS), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_words_of_odd_texts(text):
    test_words_are_the_tokenizer.hypothesis.inner_test(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_places_all(lengths):
    counts = collections.Counter(lengths)
    plan = packing.plan(dict(counts), 32)
    used = collections.Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 32 and n > 0
        for x in pattern:
            used[x] += n
    assert used == counts


def test_plan_finds_exact_complements():
    # pairs and triples that fill a sequence exactly, which best fit alone misses
    assert sum(n for _, n in packing.plan({20: 2, 12: 1, 7: 1, 5: 1}, 32)) == 2
    assert sum(n for _, n in packing.plan({16: 1, 8: 2, 6: 2, 4: 1, 10: 1, 2: 1, 12: 0}, 32)) == 2
    rng = random.Random(3)
    for _ in range(20):
        whole = []
        for _ in range(30):  # sequences cut at random into two to four pieces
            cuts = sorted(rng.sample(range(1, 256), rng.randint(1, 3)))
            whole += [b - a for a, b in zip([0, *cuts], [*cuts, 256])]
        assert sum(n for _, n in packing.plan(dict(collections.Counter(whole)), 256)) <= 32


def test_packing_query(spark):
    texts = [*ODD, None, "word " * 9000, "word " * 4095, "same", "same"]
    got = packing.pack(packing.pieces_of(docs(spark, texts), WORDS)).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    tokenizer = packing._words(WORDS).tokenizer
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["length"] for r in own] == [min(4096, len(ids) - a) for a in range(0, len(ids), 4096)]
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for row in places.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces_of(docs(spark, []), WORDS)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 64, 1023, 1024, 1025, 8192, 100_000])
def test_container_round_trip(size):
    payload = random.Random(size).randbytes(size)
    data = isomedia.write_media(payload)
    track = isomedia.read_track(data)
    assert b"".join(data[a : a + n] for a, n in track.ranges(np.arange(len(track.sizes))).tolist()) == payload
    assert track.codec == "raw " and track.duration == size and track.timescale == 8000
    starts = {int(track.offsets[k]) for k in track.keyframes}
    assert starts == {int(track.offsets[k]) for k in range(0, len(track.sizes), isomedia.KEY_EVERY)}
    assert isomedia.write_media(payload) == data


def test_container_forms():
    # 64-bit sizes, a box to the end of the file, one size for all samples, co64
    box = isomedia._box
    stbl = box(b"stbl", isomedia._full(b"stsd", struct.pack(">I", 1), box(b"abcd")), isomedia._full(b"stts", struct.pack(">III", 1, 3, 5)), isomedia._full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), isomedia._full(b"stsz", struct.pack(">II", 2, 3)), isomedia._full(b"co64", struct.pack(">IQ", 1, 8)))
    mdhd = isomedia._box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQ", 0, 0, 10, 0))
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd, isomedia._full(b"hdlr", b"\0" * 4, b"vide"), box(b"minf", stbl))))
    data = box(b"mdat", b"ABCDEF") + struct.pack(">I4sQ", 1, b"free", 16) + moov + struct.pack(">I4s", 0, b"skip") + b"rest"
    track = isomedia.read_track(data)
    assert (track.codec, track.handler, track.timescale, track.duration) == ("abcd", "vide", 10, 15)
    assert [data[a : a + n] for a, n in zip(track.offsets, track.sizes)] == [b"AB", b"CD", b"EF"] and len(track.keyframes) == 3


def test_container_columns(spark):
    good = isomedia.write_media(b"x" * 5000)
    df = spark.createDataFrame([(1, good, "a"), (2, b"junk", "b"), (3, None, "c"), (4, good[:200], "d")], "id int, media binary, codec string")
    got = {r["id"]: r for r in isomedia.media_columns(df).collect()}
    assert got[1]["codec"] == "raw " and got[1]["error"] is None and got[1]["duration_s"] == 0.625 and len(got[1]["keyframes"]) == 1
    assert all(got[i]["codec"] is None and got[i]["error"] for i in (2, 3, 4))
    texts = ["", None, "é", "x" * 64, "x" * 65, "same", "same"]
    rows = {r["doc_id"]: r for r in isomedia.digest_media(isomedia.store_texts(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert rows[5].asDict() | {"doc_id": 0} == rows[6].asDict() | {"doc_id": 0}
