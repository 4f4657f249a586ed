"""What the SentencePiece encoder keeps by word and part, and its decoding by bytes."""

import numpy as np
import pytest

from kithmark.llm import piece_codec


@pytest.fixture
def codec():
    with open(piece_codec.default_model(), "rb") as f:
        return piece_codec.Codec(f.read())


def by_runs(codec, ids):
    """Decoding with runs of byte pieces decoded by themselves."""
    out, raw = [], bytearray()
    for i in [*ids, None]:
        piece, _, kind = codec.pieces[i] if i is not None else ("", 0, 0)
        if kind == piece_codec.BYTE:
            raw.append(int(piece[1:-1], 16))
            continue
        out += [raw.decode("utf-8", "replace"), " \u2047 " if kind == piece_codec.UNKNOWN else "" if kind == piece_codec.CONTROL else piece.replace(piece_codec.MARK, " ")]
        raw.clear()
    return "".join(out)


def test_ids_decode_as_by_runs_of_bytes(codec):
    rng, raw = np.random.default_rng(4), list(codec.bytes.values())
    for k in range(400):
        ids = rng.integers(0, len(codec.pieces), 30)
        ids = np.where(rng.random(30) < (0.2, 0.5, 0.9)[k % 3], rng.choice(raw, 30), ids).tolist()
        assert codec._decode(ids) == by_runs(codec, ids)


def test_words_are_cut_and_merged_as_their_marks_say(codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT", 7)
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzeeeettaaABXYZ019.,-\n\t") + list("äßüñçéЖя中文ạ\U0001f600\x00\ud7ff")
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 40, 600)] + ["a" * 300, "x" * 255 + "中", "中" * 400, "hello", "world"]
    for _ in range(2):
        for k in range(0, len(words), 3):
            text = " ".join(words[k : k + 3])
            ids, spans = codec.aligned(text)
            want = codec.encode_spans(text)
            assert ids == [i for i, _, _ in want] == codec.encode(text) and spans.tolist() == [[a, b] for _, a, b in want]
            assert codec.merge(piece_codec.MARK + words[k]) == [s for part in codec.cut(piece_codec.MARK + words[k]) for s in codec._merge(part)]
            assert codec.decode(ids) == text


def test_a_word_without_a_cut_is_kept_once(codec):
    codec.digest("the hello world of thereandthat")
    assert len(codec.words) == 5 and not codec.parts
