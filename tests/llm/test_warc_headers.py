"""WARC derivatives keep the HTTP headers of their response."""

from pyspark.sql import functions as F

from kithmark.llm import queries, warc

HEADS = ["HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Odd: 100% \"é\" a: b \\ ~\r\n\r\n", "", "HTTP/1.1 404 Not Found\r\n\r\n"]


def test_written_records_have_the_source_headers(spark):
    found = spark.createDataFrame([(i, "https://e.org/", "2024-01-01T00:00:00Z", h, "<p>x") for i, h in enumerate(HEADS)], "page_id long, target_uri string, warc_date string, http_headers string, payload string")
    rows = warc.derive(found).collect()
    assert len(rows) == 2 * len(HEADS)
    for r in rows:
        fields, block = warc.parse_record(warc.warc_bytes(r.asDict()))
        assert warc.source_headers(fields) == r.source_headers == HEADS[r.page_id] and block.decode() == r.block


def test_the_query_keeps_the_source_headers(spark, sf):
    got = queries.QUERIES["op6_warc"](spark, sf)
    sizes = {r.page_id: r.n for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).collect()}
    for r in got.select("page_id", "source_headers").collect():
        assert r.source_headers == f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {sizes[r.page_id]}\r\n\r\n"
