"""WARC derivatives: each response becomes a linked metadata record and a plain-text conversion record.

A response read from a file keeps its record id and its payload digest, which is of the bytes as they are there; one that has none, and pages, get an id
derived from what they are (target, date, digest), so reruns agree. Derivatives' ids are derived from their response's. Both
name the response they come from (WARC-Refers-To, its target and date), keep its payload digest and
its HTTP headers, and carry a digest of their own block. The text is decoded as the headers or the page say (transfer and content coding, charset). A written record has the headers in the field
WARC-Source-HTTP-Headers, percent-encoded where they are not printable ASCII.
"""

from __future__ import annotations

import gzip
import hashlib
import html as entities
import io
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urljoin
from uuid import UUID, uuid4

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RESPONSE = "record_id string, target_uri string, warc_date string, payload_digest string, http_headers string, payload binary"
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, source_digest string, source_headers string, block_digest string, content_length long, block string"

#: Elements whose content no reader sees, and those that begin and end a line.
HIDDEN = frozenset(("script", "style", "noscript", "template"))
BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 table tr td th article section nav footer header main aside blockquote pre hr body html title".split())
OPEN = re.compile(r"<(?:([/!?]?)([A-Za-z][^\s/>]*)|!)")
META_CHARSET = re.compile(rb"<meta\s[^>]*charset\s*=\s*[\"']?([A-Za-z0-9_:.-]+)", re.IGNORECASE)
CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in (*HIDDEN, "title")}
HEAD_ENDS = re.compile(r"</head\s*>|(?=<body[\s/>])", re.IGNORECASE)
TITLE, ANY_TAG = re.compile(r"<title[\s/>]", re.IGNORECASE), re.compile(r"<[^<>]*>")
#: The end of a tag, or the quote that begins an attribute's value.
ENDS = re.compile(r">|=\s*([\"'])")
SPACE, LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
LANG = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.IGNORECASE)
HREF = re.compile(r"\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: What a header field of a record takes as it is; inner spaces are encoded, so none is lost at an end.
PRINTABLE = "!\"#$&'()*+,/:;<=>?@[\\]^`{|}"


def digest(block: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{UUID(bytes=hashlib.sha256('\0'.join(parts).encode()).digest()[:16], version=4)}>"


class Fields(dict):
    """Header fields by name, in any case; as read by their own spelling."""

    def __init__(self):
        super().__init__()
        self.known: dict[str, str] = {}

    def __setitem__(self, name: str, value: str) -> None:
        super().__setitem__(self.known.setdefault(name.lower(), name), value)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(self.known.get(name.lower(), name))

    def __contains__(self, name: object) -> bool:
        return str(name).lower() in self.known

    def get(self, name: str, other=None):
        return self[name] if name in self else other


def http_fields(head: str) -> Fields:
    """Fields of HTTP headers, the last of those that repeat."""
    out = Fields()
    for line in head.split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


def dechunked(body: bytes) -> bytes:
    """The body of a chunked transfer; as much of it as is well formed, or the body itself if it doesn't begin as one."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            break
        if n <= 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else body


def page_text(body: bytes, fields: Fields) -> str:
    """A payload as text: transfer and content coding undone, then its charset (headers, byte order mark, the page's meta element, UTF-8)."""
    if "chunked" in fields.get("Transfer-Encoding", "").lower():
        body = dechunked(body)
    for coding in reversed(fields.get("Content-Encoding", "").lower().replace(" ", "").split(",")):
        window = {"gzip": 31, "x-gzip": 31, "deflate": 47}.get(coding)
        if window:
            try:
                body = zlib.decompressobj(window).decompress(body)
            except zlib.error:  # it isn't what it says
                break
    named = re.search(r"charset\s*=\s*\"?([^\s;\"]+)", fields.get("Content-Type", ""), re.IGNORECASE)
    meta = META_CHARSET.search(body, 0, 4096)
    charset = named[1] if named else "utf-8-sig" if body.startswith(b"\xef\xbb\xbf") else meta[1].decode() if meta else "utf-8"
    try:
        return body.decode(charset, "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def tag_end(page: str, at: int, closes: dict[str, int]) -> int:
    """Where the tag ends whose name ends at `at`: at the first > outside of quoted values; -1 if nowhere.

    A quote that isn't closed is none. `closes` holds from where on a quote is known to be missing, so no stretch is searched twice for it.
    """
    end = page.find(">", at)
    if end < 0 or (page.find('"', at, end) < 0 and page.find("'", at, end) < 0):  # most tags have no quotes
        return end
    while True:
        m = ENDS.search(page, at)
        if not m:
            return -1
        if m[1] is None:
            return m.start()
        quote_ = m[1]
        close = page.find(quote_, m.end()) if closes.get(quote_, len(page)) > m.end() else -1
        if close < 0:
            closes[quote_] = min(closes.get(quote_, len(page)), m.end())
            at = m.end()
        else:
            at = close + 1


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before it, name with its slash, tag) for each tag that a reader's page has; the rest of the text at last, with an empty tag.

    Comments, hidden elements and the head are one tag each, by the name of "!". One walk over the page: what is found to close
    nowhere isn't looked for again, so time grows with the page's length whatever it holds.
    """
    text, at, end, closes = [], 0, len(page), {}
    while (i := page.find("<", at)) >= 0:
        m = OPEN.match(page, i)
        if not m:
            text.append(page[at : i + 1])
            at = i + 1
            continue
        text.append(page[at:i])
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at, name, tag = end if j < 0 else j + 3, "!", ""
        elif (j := tag_end(page, m.end(), closes)) < 0:  # no tag ends from here on
            at = i
            break
        else:
            name, tag, at = (m[2] or "!").lower(), page[i : j + 1], j + 1
            if m[1] == "/":
                name = "/" + name
            elif name in HIDDEN or name == "head":
                close = (HEAD_ENDS if name == "head" else CLOSE[name]).search(page, at)
                at, name = close.end() if close else end, "!"
        yield "".join(text), name, tag
        text = []
    yield "".join(text) + page[at:], "", ""


def title_of(page: str) -> str | None:
    """What the first title element holds; one that isn't closed holds nothing, nor does any after it."""
    start = TITLE.search(page)
    at = page.find(">", start.end() - 1) if start else -1
    close = CLOSE["title"].search(page, at) if at >= 0 else None
    return one_line(page[at + 1 : close.start()]) if close else None


def one_line(text: str) -> str:
    return " ".join(entities.unescape(ANY_TAG.sub("", text)).split())


def read_page(page: str, uri: str, content_type: str) -> tuple[str, str]:
    """(metadata, plain text) of a page.

    Metadata is application/warc-fields: content type, title, language, and each outlink once, absolute. The text is what a
    reader sees: no scripts, styles, comments or head; a line for each block; entities decoded last.
    """
    parts, links, lang = [], {}, None
    for text, name, tag in tags(page):
        parts.append(text)
        if name == "!":
            parts.append(" ")
        elif name.removeprefix("/") in BLOCK:
            parts.append("\n")
        if name == "html" and lang is None and (m := LANG.search(tag)):
            lang = m[1]
        elif name == "a" and (m := HREF.search(tag)):
            at = entities.unescape(next(x for x in (*m.groups(), "") if x is not None)).strip()
            try:
                links[urljoin(uri, at)] = None
            except ValueError:  # not a URL
                links[at] = None
    fields = [("sourceContentType", content_type)]
    if (title := title_of(page)) is not None:
        fields.append(("title", title))
    if lang:
        fields.append(("languages-html", lang))
    fields += [("outlink", " ".join(x.split())) for x in links]
    plain = LINES.sub("\n", SPACE.sub(" ", entities.unescape("".join(parts)))).strip()
    return "".join(f"{k}: {v}\r\n" for k, v in fields), plain


def plain_text(page: str) -> str:
    return read_page(page, "", "")[1]


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) as WARC responses: page_id and RESPONSE, without a record id and a digest of their own. Null url or html is empty."""
    payload = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), head.alias("http_headers"), payload.cast("binary").alias("payload"))


def derive(found: DataFrame) -> DataFrame:
    """Two rows (DERIVED) for each response, metadata and conversion, in that order.

    Nulls count as empty: an empty payload gives an empty conversion and metadata without title or
    links; a response without record id gets one, and one without payload digest that of its payload (binary, or a string's UTF-8). Rows that repeat a response repeat its records, with the same ids. Payloads of any length are taken whole.
    Other columns are ignored; no rows come from an empty table.
    """
    names = [x.split()[0] for x in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                body, uri, date, head = row["payload"], row["target_uri"], row["warc_date"], row["http_headers"]
                source = row["payload_digest"] or digest(body)
                response = row["record_id"] or record_id("response", uri, date, source)
                fields = http_fields(head)
                meta, plain = read_page(page_text(body, fields), uri, fields.get("Content-Type", ""))
                for type_, form, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", plain)):
                    data = block.encode()
                    out.append((row["page_id"], type_, record_id(type_, response), response, uri, date, form, source, head, digest(data), len(data), block))
            arrays = [pa.array([x[i] for x in out], pa.int64() if names[i] in ("page_id", "content_length") else pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    own = [F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in ("record_id", "payload_digest")]
    texts = (F.coalesce(c, F.lit("")).alias(c) for c in ("target_uri", "warc_date", "http_headers"))
    ready = found.select("page_id", *own, *texts, F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    return ready.mapInArrow(run, DERIVED)


def warc_bytes(row: dict) -> bytes:
    """One derived row as a gzip member of a WARC/1.1 file."""
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["warc_date"], "WARC-Target-URI": row["target_uri"], "WARC-Refers-To": row["refers_to"],
        "WARC-Refers-To-Target-URI": row["target_uri"], "WARC-Refers-To-Date": row["warc_date"], "WARC-Source-Payload-Digest": row["source_digest"], "WARC-Block-Digest": row["block_digest"],
        "WARC-Source-HTTP-Headers": quote(row["source_headers"], safe=PRINTABLE), "Content-Type": row["content_type"], "Content-Length": str(row["content_length"]),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + row["block"].encode() + b"\r\n\r\n", mtime=0)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of a WARC file, plain or of gzip members, one at a time."""
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        fields = Fields()
        while line := stream.readline().strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name] = value.strip()
        yield fields, stream.read(int(fields["Content-Length"]))


def response_row(fields: Fields, block: bytes) -> tuple[str | None, str, str, str | None, str, bytes]:
    """RESPONSE of a response record: its block is the HTTP headers, an empty line and the payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    return fields.get("WARC-Record-ID"), fields.get("WARC-Target-URI", ""), fields.get("WARC-Date", ""), fields.get("WARC-Payload-Digest"), (head + gap).decode("latin-1"), payload


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Part]:
        fs, root = FileSystem.from_uri(self.path)
        found = fs.get_file_info(root)
        found = fs.get_file_info(FileSelector(root, recursive=True)) if found.type == FileType.Directory else [found]
        names = sorted(x.path for x in found if x.type == FileType.File and x.path.endswith((".warc", ".warc.gz")) and not x.base_name.startswith(("_", ".")))
        return [_Part(x) for x in names] or [_Part("")]

    def read(self, part: _Part) -> Iterator[tuple]:
        if part.path:
            fs, _ = FileSystem.from_uri(self.path)
            with fs.open_input_stream(part.path, compression=None) as f:
                for fields, block in records(io.BufferedReader(f)):
                    if fields.get("WARC-Type") == "response":
                        yield response_row(fields, block)


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    """Each task writes a hidden file; commit gives it its name, so a task that runs twice leaves one file."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator[Row]) -> _Done:
        fs, root = FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        path = f"{root}/.{uuid4().hex}.warc.gz"
        with fs.open_output_stream(path, compression=None) as f:
            for row in rows:
                f.write(warc_bytes(row.asDict()))
        return _Done(path)

    def commit(self, messages: list[_Done | None]) -> None:
        fs, _ = FileSystem.from_uri(self.path)
        for k, done in enumerate(x for x in messages if x):
            folder, _, name = done.path.rpartition("/")
            fs.move(done.path, f"{folder}/part-{k:05d}-{name[1:]}")

    def abort(self, messages: list[_Done | None]) -> None:
        fs, _ = FileSystem.from_uri(self.path)
        for done in messages:
            if done:
                fs.delete_file(done.path)


class WarcSource(DataSource):
    """Format "warc": reads the response records of .warc and .warc.gz files as RESPONSE, a file in a task; appends DERIVED rows as .warc.gz files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RESPONSE

    def _path(self) -> str:
        path = self.options["path"]
        return path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._path())


def write_warc(derived: DataFrame, path: str) -> None:
    """.warc.gz files of the derived records, each a gzip member, one file from each task."""
    derived.sparkSession.dataSource.register(WarcSource)
    derived.write.format("warc").mode("append").save(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """RESPONSE rows, with a null page_id, of a file or folder of WARC files; derive() takes them."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path).withColumn("page_id", F.lit(None).cast("long"))


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of one record, plain or gzip."""
    return next(records(io.BufferedReader(io.BytesIO(member))))


def source_headers(fields: dict[str, str]) -> str:
    """The response's HTTP headers from the fields of a derived record."""
    return unquote(fields.get("WARC-Source-HTTP-Headers", ""))


def op6(spark, sf_dir: str) -> DataFrame:
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
