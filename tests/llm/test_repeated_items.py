"""Rows that repeat an item take no other item's place in the top-k index."""

from kithmark.llm import mih


def test_an_item_repeated_more_than_k_times_leaves_the_others(spark):
    items = [(1, 7)] * 14 + [(2, 7), (3, 7), (4, 6)]
    got = mih.top_k(spark.createDataFrame(items, "id long, code long"), spark.createDataFrame([(4, 6), (1, 7)], "id long, code long"), 10)
    found = {q: [(r.distance, r.item_id) for r in sorted(got.collect(), key=lambda r: r.rank) if r.query_id == q] for q in (1, 4)}
    assert found == {1: [(0, 2), (0, 3), (1, 4)], 4: [(1, 1), (1, 2), (1, 3)]}
