"""Source divergence and filter interaction against plain versions."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_corpus import ASCII, DOCS, ODD, WORD

from kithmark.llm import divergence, filter_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(docs, least, top):
    counts, total, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(ASCII))
        counts[lang or "", source or ""].update(terms)
        total[lang or ""].update(terms)
        seen[lang or ""].update(set(terms))
    kept = {g: [t for t, n in c.items() if n >= least] for g, c in seen.items()}
    p = lambda n, all_n, v: 1 + 1_000_000_000 * (n + 5) // (all_n + 5 * v)
    probs = {g: {t: p(c[t], sum(c[x] for x in kept[g[0]]), len(kept[g[0]])) for t in kept[g[0]]} for g, c in counts.items()}
    out = []
    for lang, source in counts:
        terms, mine = kept[lang], probs[lang, source]
        pairs = sorted(((-sum(abs(mine[t] - probs[lang, s][t]) for t in terms), s.encode()) for g, s in counts if g == lang and s != source))
        out += [(lang, source, "pair", s.decode(), -v, k + 1) for k, (v, s) in enumerate(pairs)]
        n = sum(total[lang][x] for x in terms)
        own = sorted((p(total[lang][t], n, len(terms)) - mine[t], t.encode()) for t in terms if counts[lang, source][t] and mine[t] > p(total[lang][t], n, len(terms)))
        out += [(lang, source, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(own[:top])]
    return Counter(out)


@pytest.mark.parametrize("room, tile", [(1024, 64), (64, 2), (64, 1)])
def test_divergences_match_a_plain_version(spark, room, tile):
    rng = np.random.default_rng(room + tile)
    words = [f"{c}{chr(0xE0 + k)}" for c in "abcdeABCDE" for k in range(30)]
    docs = [(" ".join(words[int(i)] for i in rng.zipf(1.3, 80) % (300 - 7 * s)) + " 12, É-é", lang, f"s{s}") for lang in ("en", "de") for s in range(6) for _ in range(12)]
    docs += [(None, "en", "empty"), ("", "en", None), ("Rare x", "fr", "a"), (None, "fr", None), ("ß", None, None)]
    got = divergence.divergences(spark.createDataFrame(docs, "text string, lang string, source string"), least_docs=5, top=7, room=room, tile=tile)
    assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergence(docs, 5, 7)


def test_probabilities_beyond_longs(spark):
    rows = [(10**13 + 7, 3 * 10**14, 10**6), (0, 0, 1), (5, 9 * 10**18, 10**9)]
    got = spark.createDataFrame(rows, "n long, total long, v long").select(divergence.probability("n", "total", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in rows]


def test_divergences_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    for least in (1, 30):
        got = divergence.divergences(odd, least_docs=least)
        assert Counter(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_divergence([(r[1], r[2], r[3]) for r in ODD], least, 50)
    assert divergence.divergences(odd.limit(0)).count() == 0


def brute_interactions(docs, labels):
    least, flags, parts = {}, defaultdict(set), defaultdict(list)
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, q, t in labels:
        flags[d] |= {name for name, flag in (("good", q), ("toxic", t)) if flag == 1}
    for d, text, source in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {f for f, c in {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and least[text] < d}.items() if c}
        parts[source or ""].append((fails, flags[d] if d is not None else set()))
    out = []
    for part, rows in parts.items():
        removed = Counter()
        got = []
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [(x, l) for x, l in rows if f in x and not before & x]
                removed[f] += len(here)
                got.append((part, order, k + 1, sum(not x & (before | {f}) for x, _ in rows), len(here), sum(f in x and bool(before & x) for x, _ in rows), sum(x == {f} for x, _ in rows), sum("good" in l for _, l in here), sum("toxic" in l for _, l in here)))
        out += [(*g, removed[g[1][g[2] - 1]]) for g in got]
    return Counter(out)


def test_interactions_match_a_plain_version(spark):
    rng = np.random.default_rng(12)
    texts = ["", "Short ONE", "a b " * 40, "CAPS WORDS " * 30 + "#", " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + " $", "x y z " * 20, "é" * 100 + " A B C"]
    docs = [(int(rng.integers(120)) if rng.random() < 0.95 else None, texts[int(i)] if i < len(texts) else None, [None, "", "a", "b"][int(rng.integers(4))]) for i in rng.integers(0, len(texts) + 1, 300)]
    labels = [(int(d), int(q), int(t)) for d, q, t in zip(rng.integers(0, 120, 90), rng.integers(0, 2, 90), rng.integers(0, 2, 90), strict=True)] + [(None, 1, 1), (3, None, None)]
    got = filter_audit.interactions(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"))
    assert Counter(map(tuple, got.collect())) == brute_interactions(docs, labels)


def test_interactions_of_odd_rows(spark):
    odd, labels = spark.createDataFrame(ODD, DOCS), [(1, 1, 0), (2, 0, 1)]
    flags = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    assert Counter(map(tuple, filter_audit.interactions(odd, flags).collect())) == brute_interactions([(r[0], r[1], r[3]) for r in ODD], labels)
    assert filter_audit.interactions(odd.limit(0), flags.limit(0)).count() == 0


def test_fields_hold_large_counts():
    every = {m: filter_audit.outcomes(m) for m in range(32)}
    total = sum((2**62 + m) // 32 * every[m]["removed"] for m in range(32))
    want = [sum((2**62 + m) // 32 for m in range(32) if m >> "ABCDE".index(f) & 1 and not any(m >> "ABCDE".index(g) & 1 for g in o[: s - 1])) for o, s, f in filter_audit.STEPS]
    assert filter_audit.unpacked(total).tolist() == want
