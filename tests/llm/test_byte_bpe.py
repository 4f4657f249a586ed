"""Byte-level BPE against the library that the rank files are made for."""

import base64
import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from test_corpus import DOCS, ODD

from kithmark.llm import byte_bpe, queries


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as p
    import tiktoken

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers as p

    with open(p.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return byte_bpe.ByteBpe(f.read(), p.PATTERN)


def digest(library, text):
    ids = library.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def same(codec, library, text):
    ids = library.encode_ordinary(text)
    ((n, joined, raw),) = codec.digests([text])
    return codec.encode(text) == ids and joined == ",".join(map(str, ids)) and n == len(ids) and raw == codec.decode(ids) == text.encode()


def test_random_texts(codec, library):
    rng = np.random.default_rng(13)
    odd = ["it's", "'re", " 's", "  ", "\t\r\n ", "\x1c\x1f", "\x85\xa0", " x", "é", "Straße", "日本語", "१२३", "👩‍👩‍👧", "՘a", "a\U000323b0", "\U00011de01", "!?", "'LL", "x" * 40, "\0", "<|endoftext|>"]
    for k in range(1500):
        parts = [odd[i] if i < len(odd) else chr(int(rng.integers(32, (128, 0x500, 0x3100, 0x1FFFF)[k % 4]))) for i in rng.integers(0, 3 * len(odd), int(rng.integers(0, 40)))]
        text = "".join(p for p in parts if not (len(p) == 1 and 0xD800 <= ord(p) < 0xE000))
        assert same(codec, library, text), repr(text)


def test_character_classes(codec, library):
    """Each character of the first planes between letters, digits and marks, where its class decides the cuts."""
    every = [chr(c) for c in range(1, 0x33500, 3) if not 0xD800 <= c < 0xE000] + [c for c in byte_bpe.NEWER if c != "-"]
    for i in range(0, len(every), 500):
        assert same(codec, library, "".join(f"a{c}a 1{c}1 !{c}! {c}" for c in every[i : i + 500]))


def test_long_pre_tokens(codec, library):
    rng = np.random.default_rng(1)
    for text in ("a" * 200_000, "".join(chr(97 + i) for i in rng.integers(0, 26, 200_000)), " " * 100_000, "ab" * 50_000, "é" * 50_000, "=" * 70_001):
        start = time.time()
        ids = codec.encode(text)
        took = time.time() - start
        assert ids == library.encode_ordinary(text) and took < 20


def test_queue_gives_the_least_rank():
    rng, queue, held = np.random.default_rng(2), byte_bpe.RankQueue(), {}
    for _ in range(4000):
        if rng.random() < 0.7:
            r, p = int(rng.choice([0, 63, 64, 4095, 4096, 262_143, 262_144, int(rng.integers(300_000))])), int(rng.integers(1000))
            queue.push(r, p)
            held.setdefault(r, []).append(p)
        elif held:
            r = min(held)
            assert queue.pop() == (r, held.pop(r))
    while held:
        r = min(held)
        assert queue.pop() == (r, held.pop(r))
    assert not queue.top and not queue.words and not queue.buckets


def test_ranks_in_any_order():
    """A made-up vocabulary in which a merge can open one of lesser rank."""
    rng = np.random.default_rng(5)
    words = {bytes(rng.choice([97, 98, 99], int(rng.integers(2, 5)))) for _ in range(60)}
    order = [bytes([b]) for b in range(256)] + sorted(words, key=lambda w: hashlib.md5(w).digest())
    lines = b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(order))
    codec = byte_bpe.ByteBpe(lines, r"\p{L}+")

    def plain(raw):
        if raw in codec.ranks:
            return [codec.ranks[raw]]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while True:
            best = min(((codec.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in codec.ranks), default=None)
            if best is None:
                return [codec.ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for _ in range(500):
        raw = bytes(rng.choice([97, 98, 99], int(rng.integers(1, 60))))
        assert codec.merge(raw) == plain(raw) and codec._ids([raw]) == [plain(raw)]


def test_pieces_together_and_one_by_one(codec):
    rng = np.random.default_rng(8)
    raws = [bytes(rng.choice([32, 97, 98, 101, 116, 104, 0xC3, 0xA9, 61], int(rng.integers(1, 40)))) for _ in range(2000)] + [b"a" * k for k in range(1, 60)] + [b""]
    assert codec._ids([r for r in raws if r]) == [codec.merge(r) for r in raws if r]


def test_what_is_kept_changes_nothing(codec, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(50)) for _ in range(40)]
    want = codec.digests(texts * 2)
    monkeypatch.setattr(byte_bpe, "KEPT", 100)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 500)
    assert codec.digests(texts * 2) == want


def test_query_equals_the_library(spark, sf, library):
    want = Counter((r.doc_id, *digest(library, r.text or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = queries.QUERIES["op13_byte_bpe"](spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and Counter(map(tuple, got.collect())) == want


def test_odd_rows_and_round_trip(spark, library):
    odd = spark.createDataFrame(ODD, DOCS)
    assert Counter(map(tuple, byte_bpe.encode_documents(odd).collect())) == Counter((r[0], *digest(library, r[1] or "")) for r in ODD)
    assert byte_bpe.encode_documents(odd.limit(0)).count() == 0
    ids = byte_bpe.encode_ids(odd)
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in ODD)
    assert Counter((r.doc_id, bytes(r.raw)) for r in byte_bpe.decode_ids(ids).collect()) == Counter((r[0], (r[1] or "").encode()) for r in ODD)
