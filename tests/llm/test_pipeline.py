"""The pipeline's stages against a brute-force version on small tables."""

from collections import Counter

from pyspark.sql import functions as F
from test_corpus import DOCS, ODD, WORD, brute_lines
from test_near_copies import brute_groups

import corpus_pipeline
from kithmark.llm import piece_codec


def columns(df):
    return [(c, k) for c, k in df.dtypes]


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "sentencepiece"]

    kept = stages["language_id"](spark, docs, sf)
    assert columns(kept) == columns(docs)
    want = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, want))

    lines = stages["line_dedup"](spark, kept, sf)
    assert columns(lines) == columns(docs)
    got = sorted(((r.doc_id, r.text) for r in lines.collect()), key=repr)
    assert got == sorted(((d, t) for d, t, *_ in brute_lines([(r.doc_id, r.text, r.lang, r.source) for r in want], 0.01)), key=repr)

    near = stages["near_dedup"](spark, lines, sf)
    assert columns(near) == columns(docs)
    roots = brute_groups(got)
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, r in roots.items() if d == r)

    mixed = stages["mixing"](spark, near, sf)
    assert columns(mixed) == columns(docs)
    sizes = {r.doc_id: len(WORD.findall(r.text or "")) for r in near.collect()}
    source, times = {r.doc_id: r.source for r in near.collect()}, Counter(r.doc_id for r in mixed.collect())
    of, taken = Counter(), Counter()
    for d, n in sizes.items():
        of[source[d]] += n
        taken[source[d]] += times[d] * n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(of))}
    stopped = set()
    while True:  # targets by sharing anew until none is above three times its source
        left, w = sum(of.values()) - sum(3 * of[s] for s in stopped), sum(weight[s] for s in of if s not in stopped)
        target = {s: 3 * of[s] if s in stopped else left * weight[s] / w for s in of}
        over = {s for s in of if s not in stopped and target[s] > 3 * of[s]}
        if not over:
            break
        stopped |= over
    most = {s: max(n for d, n in sizes.items() if source[d] == s) for s in of}
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in of) and max(times.values()) <= 3

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    texts = {r.doc_id: r.text for r in near.collect()}
    last = stages["sentencepiece"](spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in last) == times and all(r.n_tokens == len(library.encode(texts[r.doc_id])) for r in last)

    run = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, last))


def test_stages_take_odd_and_empty_tables(spark, sf):
    for docs in (spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, sf)
            assert got.columns == docs.columns
            got.agg(F.count("*")).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()
