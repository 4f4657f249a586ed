"""The encoding query takes its ids from the aligned path and says which bytes each piece stands for."""

import hashlib
import struct

import numpy as np
from test_corpus import TEXTS

from kithmark.llm import piece_codec, queries


def codec():
    with open(piece_codec.default_model(), "rb") as f:
        return piece_codec.Codec(f.read())


def test_spans_kept_by_word_equal_the_walk_over_the_text():
    own, rng = codec(), np.random.default_rng(4)
    odd = ["".join(rng.choice(list("abenst.é日🎉 \n"), int(rng.integers(1, 40)))) for _ in range(2000)]
    for t in [*TEXTS, *odd, *odd]:
        ids, spans = own.aligned(t)
        want = own.encode_spans(t)
        assert [(i, a, b) for i, (a, b) in zip(ids, spans.tolist(), strict=True)] == want, t
        assert own.digest_spans(t)[2] == own.decode([i for i, _, _ in want])


def test_the_query_yields_spans(spark, sf):
    own = codec()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_sentencepiece"](spark, sf).collect():
        spans = b"".join(struct.pack("<qq", a, b) for _, a, b in own.encode_spans(texts[r.doc_id]))
        assert r.spans_sha256 == hashlib.sha256(spans).hexdigest()
