"""Near copies of the pipeline against all pairs of shingle sets."""

import numpy as np
import pytest
from test_corpus import ASCII, DOCS, ODD, WORD

import corpus_pipeline
from kithmark.llm import near_copies


def brute_set(text, words=5):
    w = WORD.findall((text or "").translate(ASCII))
    return frozenset([" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)] * bool(w))


def brute_groups(texts):
    """doc id -> least id reachable over sets of similarity 0.8 or more, for (id, text)."""
    sets = {d: brute_set(t) for d, t in texts}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in ids}


def edited():
    """Texts, and copies of them in which runs of words are replaced: similarities about 0.8; and a crowd that shares a passage."""
    rng, out = np.random.default_rng(3), []
    for k in range(60):
        n = int(rng.integers(6, 400))
        w = [f"w{x}" for x in rng.integers(0, 5000, n)]
        out.append(" ".join(w))
        for _ in range(3):
            x = list(w)
            for at in rng.integers(0, n, int(rng.integers(0, 1 + max(1, n // 50)))):
                x[at] = f"x{k}"
            out.append(" ".join(x[: n - int(rng.integers(0, 1 + n // 8))]))
    passage = " ".join(f"p{i}" for i in range(60))
    return out + [f"{passage} own{i} " + " ".join(f"q{i % 3}{x}" for x in range(i)) for i in range(40)]


@pytest.mark.parametrize("common", [0, 200_000])
def test_groups_match_all_pairs(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    texts = list(enumerate(edited()))
    got = near_copies.copy_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(texts)


def test_the_stage_takes_what_lies_beyond_five_bits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, r in want.items() if d == r)


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    want = brute_groups({(r[0], r[1]) for r in ODD if r[0] is not None})
    assert {r.doc_id: r.component_id for r in near_copies.copy_groups(odd).collect() if r.doc_id is not None} == want
    kept = near_copies.one_of_copies(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(None) == 2 and sorted(i for i in ids if i is not None) == sorted({r for r in want.values()})
    assert near_copies.one_of_copies(odd.limit(0)).count() == 0


def test_sketches_rule_out_no_copies(spark):
    rng, rows, want = np.random.default_rng(5), [], []
    for n in (1, 2, 9, 10, 90, 400, 3000):
        for cut in (0, n // 10, n // 9, n // 5, n // 3):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate((x[cut:], rng.integers(0, 1 << 63, cut, dtype=np.uint64))))
            rows.append((near_copies.parity(x).tolist(), near_copies.parity(y).tolist(), len(x), len(y)))
            want.append(bool(near_copies.alike(len(np.intersect1d(x, y)), len(x), len(y))))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, n long, m long").select(near_copies.may_be_alike(*(near_copies.F.col(c) for c in "xynm")).alias("may"))
    got = [r.may for r in got.collect()]
    assert all(g for g, w in zip(got, want, strict=True) if w) and not all(got)


def family(n, seed=9):
    """Documents of 300 words, each with 4 words of one text changed: similarities of 0.76 on average, some pairs above 0.8."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in range(300)], []
    for k in range(n):
        w = list(base)
        for at in rng.choice(300, 4, replace=False):
            w[at] = f"x{k}_{at}"
        out.append(" ".join(w))
    return list(enumerate(out))


def test_a_family_of_near_copies_needs_few_candidates(spark, monkeypatch):
    texts, tried = family(400), []
    real = near_copies.Verifier.links

    def counted(self, pairs):
        tried.append(pairs.distinct().count())
        return real(self, pairs)

    monkeypatch.setattr(near_copies.Verifier, "links", counted)
    got = near_copies.copy_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(texts)
    assert sum(tried) < 60 * len(texts)  # all pairs are 200 a document
