"""What near-dedup lists and writes beside its result stays small."""

import numpy as np
from test_near_copies import brute_groups

from kithmark.llm import near_copies, simhash


def far_families(families=3, members=40, words=600, changed=10):
    """Families of long documents, 0.71 alike on average, and a passage of 80 words in a document of each."""
    rng, out = np.random.default_rng(11), []
    passage = [f"p{i}" for i in range(80)]
    for f in range(families):
        for k in range(members):
            w = [f"f{f}_{i}" for i in range(words)]
            for at in rng.choice(words, changed, replace=False):
                w[at] = f"x{f}_{k}_{at}"
            out.append(" ".join(w + passage if not k else w))
    return list(enumerate(out))


def rows_of_join_on_h(node):
    """Rows that merge joins on h have made, in an executed plan."""
    if "QueryStage" in node.nodeName():
        return rows_of_join_on_h(node.plan())
    if node.nodeName() == "AdaptiveSparkPlan":
        return rows_of_join_on_h(node.executedPlan())
    own = node.metrics().apply("numOutputRows").value() if node.nodeName() == "SortMergeJoin" and node.simpleString(50).startswith("SortMergeJoin [h#") else 0
    return own + sum(rows_of_join_on_h(node.children().apply(i)) for i in range(node.children().size()))


def test_families_that_are_not_copies_list_few_pairs(spark, monkeypatch):
    texts, seen = far_families(), {}
    real = near_copies.met_in_heads

    def counted(each, sketches, folder):
        got = real(each, sketches, folder)
        pairs = got.collect()
        seen["rows"] = rows_of_join_on_h(got._jdf.queryExecution().executedPlan())
        return spark.createDataFrame(pairs, got.schema)

    monkeypatch.setattr(near_copies, "met_in_heads", counted)
    got = near_copies.copy_groups(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(texts)
    assert seen["rows"] < 10 * len(texts)  # all pairs of a family are 20 a document


def test_a_shared_passage_is_one_row_of_each_document(spark, tmp_path):
    rows = [(r, 200, i, 1000 + i) for r in (1, 2, 3) for i in range(40)] + [(r, 200, 40 + i, 5000 + i) for r in (2, 3, 3) for i in range(5)] + [(1, 200, 50, 9)]
    each = spark.createDataFrame(rows, "rep long, n long, pos int, h long")
    links = spark.createDataFrame([], "a long, b long")
    got = near_copies.split_shingles(each, links, f"file://{tmp_path}")
    assert sorted((r.rep, r.n, r.pos, r.h, r.root) for r in got.collect()) == [(1, 200, 0, 1000, 1), (2, 200, 0, 1000, 2), (2, 200, 40, 5000, 2), (3, 200, 0, 1000, 3), (3, 200, 40, 5000, 3)]


def test_wide_sketches_rule_out_no_copies(spark):
    rng, rows, want = np.random.default_rng(6), [], []
    for n in (0, 1, 5, 63, 64, 65, 127, 128, 500, 1030, 5000):
        for less in (0, n // 100, n // 10, n // 5):
            for cut in (0, n // 20, n // 9, n // 4):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                y = np.unique(np.concatenate((x[cut : len(x) - less], rng.integers(0, 1 << 63, cut, dtype=np.uint64))))
                rows.append((near_copies.wide_parity(x).tolist(), near_copies.wide_parity(y).tolist(), len(x), len(y)))
                want.append(bool(near_copies.alike(len(np.intersect1d(x, y)), len(x), len(y))))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, n long, m long").select(near_copies.wide_may_be_alike(*(near_copies.F.col(c) for c in "xynm")).alias("may"))
    got = [r.may for r in got.collect()]
    assert any(len(x) != len(y) and w for (x, y, _, _), w in zip(rows, want, strict=True))
    assert all(g for g, w in zip(got, want, strict=True) if w) and not all(got)
    big = [g for g, w, r in zip(got, want, rows, strict=True) if r[2] >= 500 and not w]
    assert sum(big) < 0.2 * len(big)


def plain_roots(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def test_components_of_few_links_are_written_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = [(i, i + 1) for i in range(-300, 300)] + [(1000, 1000 + i) for i in range(1, 90)] + [tuple(map(int, p)) for p in rng.integers(2000, 2400, (150, 2))] + [(7, 7), (9000, 8999), (8999, 9000)]
    links = spark.createDataFrame(pairs, "a long, b long")
    real, many = simhash.written, []
    monkeypatch.setattr(simhash, "written", lambda df, name, folder=None: (many.append(name), real(df, name, folder))[1])
    assert {r.node: r.root for r in simhash.connected(links.coalesce(1)).collect()} == plain_roots(pairs)
    assert len(many) <= 2
    monkeypatch.setattr(simhash, "GATHERED", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # links of a component lie in many batches: rounds must join them
    try:
        assert {r.node: r.root for r in simhash.connected(links).collect()} == plain_roots(pairs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert simhash.connected(links.limit(0)).collect() == []
