"""What WARC derivatives keep of the records that they come from, and what a reader sees of odd pages."""

import gzip
import time
import zlib

import pytest

from kithmark.llm import warc

OWN = "<urn:uuid:11111111-2222-4333-8444-555555555555>"


def record(body, head, fields=()):
    block = head.encode("latin-1") + b"\r\n\r\n" + body
    lines = ["WARC/1.1", "warc-type: response", "Warc-Target-Uri: http://a/x", "warc-date: 2020-02-02T02:02:02Z", *fields, f"content-length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_a_file_keeps_its_ids_digests_and_bytes(spark, tmp_path):
    """Own ids, a Latin-1 payload and lower-case fields."""
    page = "<p>caf\xe9</p>".encode("latin-1")
    own = warc.digest(page)
    body = record(page, "HTTP/1.1 200 OK\r\ncontent-type: text/html; charset=ISO-8859-1", [f"warc-record-id: {OWN}", f"WARC-payload-Digest: {own}"])
    (tmp_path / "a.warc").write_bytes(body + record(page, "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1"))
    got = warc.derive(warc.read_responses(spark, str(tmp_path))).collect()
    assert len(got) == 4 and {r.source_digest for r in got} == {own} and {r.warc_date for r in got} == {"2020-02-02T02:02:02Z"}
    assert sorted(r.refers_to == OWN for r in got) == [False, False, True, True]
    assert [r.block for r in got if r.record_type == "conversion"] == ["caf\xe9"] * 2
    for r in got:
        fields, block = warc.parse_record(warc.warc_bytes(r.asDict()))
        assert (fields["warc-refers-to"], fields["WARC-SOURCE-PAYLOAD-DIGEST"], block.decode()) == (r.refers_to, own, r.block)


@pytest.mark.parametrize(("head", "body"), [
    ("Content-Encoding: gzip", gzip.compress("<p>\xe9</p>".encode())), ("content-encoding: deflate", zlib.compress("<p>\xe9</p>".encode())), ("Content-Encoding: br", "<p>\xe9</p>".encode()), ("Content-Encoding: gzip", "<p>\xe9</p>".encode()),
    ("Transfer-Encoding: chunked", b"4\r\n<p>\xc3\r\n5;x=y\r\n\xa9</p>\r\n0\r\n\r\n"), ("Transfer-Encoding: chunked", "<p>\xe9</p>".encode()), ("X: y", b"<meta charset=latin-1><p>\xe9</p>"), ("X: y", b"\xef\xbb\xbf<p>\xc3\xa9</p>"),
    ("Content-Type: text/html; charset=nonsense", "<p>\xe9</p>".encode()),
])
def test_payloads_are_decoded_as_they_say(head, body):
    assert warc.plain_text(warc.page_text(body, warc.http_fields(f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n"))) == "\xe9"


def test_quoted_values_hold_tag_ends():
    assert warc.plain_text("<img alt='a>b'>x<a title=\"y>z\" href=q>t</a> 5' <b class='open>u</b>") == "xt 5' u"
    assert warc.plain_text("it's <b>'bold'</b> <i x=\"1>2</i>") == "it's 'bold' 2"


@pytest.mark.parametrize("bit", ["<a b='", "<a b=\"'", "<a b='>", "='", "<a ='x' "])
def test_quotes_take_time_in_proportion(bit):
    start = time.time()
    warc.read_page(bit * (600_000 // len(bit)), "http://a.b/", "text/html")
    assert time.time() - start < 10
