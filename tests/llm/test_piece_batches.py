"""Texts whose words are encoded together: digests as of each text by itself and of the library."""

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from test_corpus import TEXTS

from kithmark.llm import piece_codec

LETTERS = [list("abenst.é日🎉 \n"), list("aabehnorst.,'éñü  ▁"), list("the in    ationer "), list("中文\x00ạ﷽  xyz\t")]


@pytest.fixture
def codec():
    with open(piece_codec.default_model(), "rb") as f:
        return piece_codec.Codec(f.read())


@pytest.mark.parametrize(("long", "together", "words"), [(256, 4 << 20, 1 << 16), (5, 100, 7), (0, 3000, 1), (40, 1, 40)])
def test_texts_together_equal_each_by_itself_and_the_library(codec, monkeypatch, long, together, words):
    rng, library = np.random.default_rng(6), sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = [*TEXTS, *("".join(rng.choice(LETTERS[k % 4], int(rng.integers(0, 60)))) for k in range(1200)), *("".join(rng.choice(letters[:7], 2000)) for letters in LETTERS)]
    want = [codec.digest_spans(t) for t in texts]
    for name, value in (("LONG", long), ("TOGETHER", together), ("WORDS", words)):
        monkeypatch.setattr(piece_codec, name, value)
    for t, (n, ids, decoded, spans), got in zip(texts, want, codec.digest_texts(pa.array(texts)), strict=True):
        assert (got[0], bytes(got[1]), got[2], bytes(got[3])) == (n, ids.encode(), decoded.encode(), spans), t
        assert got[1:3] == (",".join(map(str, library.encode(t))).encode(), library.decode(library.encode(t)).encode())


def test_words_of_a_batch_are_not_merged_one_by_one(codec, monkeypatch):
    calls = []
    monkeypatch.setattr(piece_codec.Codec, "_merge", lambda self, unit, pairs=None: calls.append(unit))
    texts = pa.array([f"thereandthat number{k}  of\nthe world" for k in range(300)])
    assert len(list(codec.digest_texts(texts))) == 300 and not calls and not codec.words


def test_no_texts(codec):
    assert list(codec.digest_texts(pa.array([], pa.string()))) == []
    assert list(codec.digest_texts(pa.array(["", "▁"]).slice(0, 1))) == [(0, b"", b"", b"")]
