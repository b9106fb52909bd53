"""WARC derivatives: metadata and plain-text conversion records of response records.

A response keeps its HTTP head and body as its block.  For each one, a metadata
record (JSON of status, headers, title and links) and a conversion record (plain
text) are made; both name the response in WARC-Refers-To and carry its target, date
and payload digest.  Record ids follow from what a record is made of, so a task
that runs again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = b"\r\n"
SCHEMA = (
    "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "source_headers array<struct<name:string,value:string>>, block_digest string, payload_digest string, block binary"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]
#: fixed values: elements without visible text, and elements that begin a line
DROPPED = ("script", "style", "head", "nav", "noscript", "template")
BLOCKS = "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer blockquote pre hr".split()
_NAME = re.compile(r"\s*(/?)\s*([a-z][a-z0-9]*)", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*DROPPED, "title")}
_TITLE = re.compile(r"<title(?=[\s>/])", re.I)
_HREF = re.compile(r"""\shref\s*=\s*(?:(["'])|([^\s>"']+))""", re.I)
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r"\s*\n\s*")


class Scan:
    """Tags of a page in one pass; what is looked for and not found once is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, set()

    def end(self, name: str, at: int) -> int:
        """Where the first ``name`` behind a place ends, or -1: a closing tag, or a text."""
        if name in self.missing:
            return -1
        if name in _ENDS:
            found = _ENDS[name].search(self.page, at)
            end = found.end() if found else -1
        else:
            end = self.page.find(name, at)
            end = end + len(name) if end >= 0 else -1
        if end < 0:
            self.missing.add(name)
        return end

    def tags(self, dropped: bool) -> Iterator[tuple[int, int, str]]:
        """(start, end, name) of each tag or comment; ``dropped`` elements are one with all they hold.

        Names of closing tags begin with a slash; comments and others have none.
        """
        at = 0
        while (start := self.page.find("<", at)) >= 0:
            if self.page.startswith("<!--", start) and (end := self.end("-->", start + 4)) >= 0:
                yield start, end, ""
                at = end
                continue
            end = self.end(">", start)
            if end < 0:
                return
            found = _NAME.match(self.page, start + 1, end)
            name = found[2].lower() if found else ""
            if dropped and name in DROPPED and not found[1] and (close := self.end(name, end)) >= 0:
                end, name = close, ""
            yield start, end, found[1] + name if name else ""
            at = end


def plain_text(page: str) -> str:
    """Visible text: a line for each block, single spaces, entities resolved."""
    parts, at = [], 0
    for start, end, name in Scan(page).tags(dropped=True):
        parts.append(page[at:start])
        if name.lstrip("/") in BLOCKS:
            parts.append("\n")
        at = end
    parts.append(page[at:])
    return _LINES.sub("\n", _SPACES.sub(" ", html.unescape("".join(parts)))).strip()


def page_title(page: str) -> str | None:
    """What the first title element holds."""
    found = _TITLE.search(page)
    if not found or (begin := page.find(">", found.end())) < 0:
        return None
    close = _ENDS["title"].search(page, begin + 1)
    return " ".join(html.unescape(page[begin + 1 : close.start()]).split()) if close else None


def page_links(page: str) -> list[str]:
    """Targets of all links in their order; a quoted one ends at its quote, even behind a ``>``."""
    scan, out = Scan(page), []
    for start, end, name in scan.tags(dropped=False):
        if name == "a" and (found := _HREF.search(page, start, end)):
            stop = scan.end(found[1], found.end()) if found[1] else -1
            if found[2] or stop >= 0:
                out.append(html.unescape(found[2] or page[found.end() : stop - 1]))
    return out


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def response(uri: str, page: str, date: str) -> tuple:
    body = page.encode()
    headers = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    head = CRLF.join([b"HTTP/1.1 200 OK", *[f"{k}: {v}".encode() for k, v in headers]])
    block = head + CRLF + CRLF + body
    payload = digest(body)
    return ("response", record_id("response", uri, date, payload), None, uri, date, "application/http; msgtype=response", headers, digest(block), payload, block)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers (each in its place, repeated ones too) and body of an HTTP response or a record."""
    head, _, body = block.partition(CRLF + CRLF)
    status, *rest = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in rest) if k.strip()], body


def derivatives(source: dict) -> list[tuple]:
    """Metadata and conversion record of one response record."""
    status, headers, body = split_http(source["block"] or b"")
    page = body.decode("utf-8", "replace")
    about = {
        "status": status,
        "headers": headers,
        "title": page_title(page),
        "links": page_links(page),
        "block-digest": source["block_digest"],
    }
    blocks = {
        "metadata": ("application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        "conversion": ("text/plain", plain_text(page).encode("utf-8", "replace")),
    }
    same = (source["target_uri"], source["warc_date"])
    payload = source["payload_digest"] or digest(body)
    return [
        (kind, record_id(kind, source["record_id"] or ""), source["record_id"], *same, content_type, headers, digest(block), payload, block)
        for kind, (content_type, block) in blocks.items()
    ]


def to_bytes(row: dict) -> bytes:
    """The record as it stands in a WARC file."""
    fields = {
        "WARC-Type": row["warc_type"], "WARC-Record-ID": row["record_id"], "WARC-Refers-To": row["refers_to"], "WARC-Target-URI": row["target_uri"],
        "WARC-Date": row["warc_date"], "WARC-Block-Digest": row["block_digest"], "WARC-Payload-Digest": row["payload_digest"],
        "Content-Type": row["content_type"], "Content-Length": str(len(row["block"])),
    }
    lines = [b"WARC/1.0", *[f"{k}: {v}".encode() for k, v in fields.items() if v is not None]]
    return CRLF.join(lines) + CRLF + CRLF + row["block"] + CRLF + CRLF


def parse(data: bytes) -> Iterator[dict]:
    """Records of the bytes of an uncompressed WARC file.

    Bytes that are no record (no head, no good length, or too few bytes left) come back
    as a record of the type ``broken`` with those bytes as its block; reading goes on
    at the next line that begins a record.
    """
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        fields = {k.lower(): v for k, v in split_http(data[at:end])[1]} if end >= 0 and data.startswith(b"WARC/", at) else {}
        size = fields.get("content-length", "")
        if not (size.isascii() and size.isdigit()) or end + 4 + int(size) > len(data):
            after = data.find(CRLF + b"WARC/", at + 1)
            stop = after + 2 if after >= 0 else len(data)
            if data[at:stop].strip():
                yield dict(zip(COLUMNS, ["broken", *[None] * 5, [], None, None, data[at:stop]], strict=True))
            at = stop
            continue
        block = data[end + 4 : end + 4 + int(size)]
        source = split_http(block)[1] if fields.get("content-type", "").startswith("application/http") else []
        names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type")
        yield dict(zip(COLUMNS, [*[fields.get(n) for n in names], source, fields.get("warc-block-digest"), fields.get("warc-payload-digest"), block], strict=True))
        at = end + 4 + int(size)
        while data.startswith(CRLF, at):
            at += 2


_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def _table(rows: list[tuple], keys: list, kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.string()] * 6 + [_HEADERS, pa.string(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    columns = [[[{"name": a, "value": b} for a, b in x] for x in c] if t == _HEADERS else list(c) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["key", *COLUMNS])


def _chunks(batch: pa.RecordBatch, size: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def responses(pages: DataFrame, key: str = "page_id", uri: str = "url", page: str = "html", date: str = "2024-01-31T00:00:00Z") -> DataFrame:
    """One response record of every page, after the page's key.

    A null page is an empty body, a null address an empty one; pages of equal
    address and body have records of equal id; an empty table gives an empty result;
    columns other than the three named do not matter, whatever their names.
    """
    picked = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{uri}`").alias("uri"), F.col(f"`{page}`").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                rows = [response(u or "", p or "", date) for u, p in zip(part.column("uri").to_pylist(), part.column("page").to_pylist(), strict=True)]
                yield _table(rows, part.column("key").to_pylist(), part.column("key").type)

    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def build_derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Metadata and conversion records of the response records among ``records``.

    Other record types are passed over; a response without block gives records of
    an empty page; every response row gives its two records, repeated ones too; an
    empty table gives an empty result; a page of any size takes time in proportion to
    it.  Rows never leave their partition.
    """
    wanted = records.where("warc_type = 'response'").select(F.col(f"`{key}`").alias("key"), *COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch):
                rows = part.drop_columns(["source_headers"]).to_pylist()
                made = [x for row in rows for x in derivatives(row)]
                yield _table(made, [row["key"] for row in rows for _ in range(2)], part.column("key").type)

    kind = wanted.schema["key"].dataType.simpleString()
    return wanted.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def with_bytes(records: DataFrame, out: str = "record") -> DataFrame:
    """``records`` with the bytes of each record as it stands in a file."""

    @F.pandas_udf("binary")
    def build(rows):  # noqa: ANN001, ANN202
        return rows.apply(lambda r: to_bytes(r), axis=1)

    return records.withColumn(out, build(F.struct(*[c for c in COLUMNS if c != "source_headers"])))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed WARC files, with the ``path`` of each one's file; bytes that are no record are of type ``broken``.

    A file is read as one row, so it has less than 2 GB, as WARC files usually have.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = [tuple(r[c] for c in COLUMNS) for r in parse(data)]
                yield _table(rows, [name] * len(rows), pa.string())

    return files.mapInArrow(run, f"key string, {SCHEMA}").withColumnRenamed("key", "path")
