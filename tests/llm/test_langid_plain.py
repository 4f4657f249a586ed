"""Language ID's query against a plain version of the whole of it: sample, counts, models, EM and the choice of the set."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from kithmark.llm import langid, queries

M = 0xFFFFFFFF


def plain_trigrams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return None
    out = Counter()
    s = " " + " ".join(words) + " "
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        h = (ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA77 ^ ord(c) * 0xC2B2AE3D) & M
        out[((h ^ h >> 15) * 0x2C1B3C6D & M) >> 16] += 1
    return out


def plain_models(docs, fit):
    by = defaultdict(list)
    for d, text, lang in docs:
        if None not in (d, text, lang) and zlib.crc32(str(d).encode()) % 5:
            by[lang].append((int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16), d, text))
    out = {}
    for lang, rows in by.items():
        n = Counter()
        for _, _, text in sorted(rows)[:fit]:
            n.update(plain_trigrams(text) or {})
        total = sum(n.values()) + 0.1 * langid.BINS
        out[lang] = {h: (k + 0.1) / total for h, k in n.items()} | {None: 0.1 / total}
    return out


def plain_mixture(chosen, start, n, models):
    p = {h: [models[l].get(h, models[l][None]) for l in chosen] for h in n}
    w, before, total = start, -math.inf, sum(n.values())
    while True:
        mixed = {h: sum(a * b for a, b in zip(w, p[h], strict=True)) for h in n}
        now = sum(k * math.log(mixed[h]) for h, k in n.items())
        if now - before < langid.TOLERANCE:
            return w, now
        w, before = [a * sum(k * p[h][i] / mixed[h] for h, k in n.items()) / total for i, a in enumerate(w)], now


def plain_prediction(text, models):
    n = plain_trigrams(text or "")
    if not n:
        return "und", 0.0
    names = sorted(models)
    alone = {l: plain_mixture([l], [1.0], n, models)[1] for l in names}
    first = max(names, key=lambda l: (alone[l], -names.index(l)))
    chosen, w, best = [first], [1.0], alone[first]
    while len(chosen) < len(names):
        tried = [(*plain_mixture([*chosen, l], [x * 0.9 for x in w] + [0.1], n, models), l) for l in names if l not in chosen]
        more, now, l = max(tried, key=lambda x: x[1])
        if now - best <= langid.PENALTY * 0.5 * math.log(max(2, sum(n.values()))):
            break
        chosen, w, best = [*chosen, l], more, now
    score = max(w)
    return chosen[w.index(score)], score / sum(w)


def test_query_matches_a_plain_version(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    models = plain_models(docs, langid.FIT_DOCS)
    got = {r.doc_id: r for r in queries.QUERIES["op10_language_id"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d, text, _ in docs:
        lang, score = plain_prediction(text, models)
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert got[d].lang_pred == lang and got[d].score == pytest.approx(score, abs=2e-3), d


def test_sample_is_the_first_by_hash(spark):
    docs = [(i, f"{'abcdef'[i % 6] * 3} {'uvwxyz'[i % 6] * 4}", "x" if i % 3 else "y") for i in range(60)] + [(None, "aaa", "x"), (70, None, "x"), (71, "bbb", None)]
    names, logs = langid.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), 5)
    models = plain_models(docs, 5)
    assert names == sorted(models)
    for k, name in enumerate(names):
        for h in range(0, langid.BINS, 997):
            assert logs[k][h] == pytest.approx(math.log(models[name].get(h, models[name][None])), abs=1e-4)
        for h in models[name]:
            if h is not None:
                assert logs[k][h] == pytest.approx(math.log(models[name][h]), abs=1e-4)
