r"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record.

Records are rows (``RECORD``). A derivative's WARC-Refers-To is the response's
WARC-Record-ID; it keeps the target URI and date, and carries the source's HTTP
status, content type, remaining headers and payload digest, so that it stands
without the response. Ids of derivatives follow from the source's id and their
type, hence a task that runs again writes the same records.

``serialized`` gives the bytes of a record, ``parsed`` reads records from whole
WARC files (plain or gzip members). A derivative's WARC-Payload-Digest is its
own; the source's goes in X-Source-Payload-Digest. Line ends in header values
become blanks, so that no value can add a header.

A response without an HTTP head is all payload, its status null. Chunked and
gzip or deflate bodies are decoded; one that cannot be decoded, or would grow
beyond ``MOST_DECODED`` bytes, is kept as it came. A charset that is not one of
``CHARSETS`` is read as UTF-8; what a charset cannot read becomes U+FFFD. Marked
sections in a page ("<![" to the next ">") are skipped like comments, as browsers
do; where the HTML parser gives up for any other reason, what it has not read
yet counts as text, once. Only HTML and
plain text get a conversion; an empty or null body gives an empty one. Pages of
any length are converted whole. Null URIs and dates stay null. Every row is
independent, repeated rows give repeated records. Extra columns, whatever their
names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, source_status int, source_type string, source_headers string, block binary"
NAMES = [x.split()[0] for x in RECORD.split(", ")]
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg"))
BREAKS = frozenset(("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "pre", "blockquote", "title", "body", "head", "html", "main", "aside", "hr", "dl", "dt", "dd", "form", "figure"))
SPACES = re.compile(r"[^\S\n]+")
MOST_DECODED = 1 << 28
CHARSETS = re.compile(r"(utf-?(8|16|32)([-_]?[bl]e)?|(us-)?ascii|latin-?1|iso-?8859-\d{1,2}|windows-\d{3,4}|cp\d{3,4}|koi8-[ru]|gb2312|gbk|gb18030|big5|euc-(jp|kr)|shift[-_]?jis|mac-?roman|tis-620)", re.I)
ENDS = re.compile(r"[\r\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Page(HTMLParser):
    """Visible text, title and links of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.heading, self.hidden, self.in_title, self.lang = [], [], [], 0, False, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BREAKS:
            self.parts.append("\n")
        self.in_title = self.in_title or tag == "title"
        found = dict(attrs)
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
        if tag == "html" and found.get("lang"):
            self.lang = found["lang"]

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BREAKS:
            self.parts.append("\n")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.heading.append(data)
        elif not self.hidden:
            self.parts.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section that the parser would refuse, or read as another markup language's, is a comment to browsers."""
        return self.parse_bogus_comment(i)

    def unread(self, text: str) -> str:
        """What follows the place that the parser has come to."""
        line, column = self.getpos()
        at = 0
        for _ in range(line - 1):
            at = text.index("\n", at) + 1
        return text[at + column :]

    def text(self) -> str:
        lines = (SPACES.sub(" ", x).strip() for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)


def head_and_body(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """HTTP status, headers and payload of a response block."""
    if not block.startswith(b"HTTP/"):
        return None, [], block
    end = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    first, *rest = head.decode("latin-1").replace("\r\n", "\n").split("\n")
    status = re.match(r"HTTP/\S+ +(\d{3})", first)
    headers = [(k.strip(), v.strip()) for k, colon, v in (x.partition(":") for x in rest) if colon]
    return int(status[1]) if status else None, headers, body


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.find(b"\n", at)
        size = int(body[at:line].split(b";")[0].strip() or b"0", 16) if line >= 0 else 0
        if size < 0:
            raise ValueError("a chunk of negative size")
        if not size:
            return b"".join(out)
        out.append(body[line + 1 : line + 1 + size])
        at = line + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1


def inflated(body: bytes, kinds: tuple[int, ...]) -> bytes:
    """Decompressed members one after the other, never more than MOST_DECODED bytes; kinds: window sizes to try."""
    for i, kind in enumerate(kinds):
        try:
            out, size, rest = [], 0, body
            while rest:
                part = zlib.decompressobj(kind)
                out.append(part.decompress(rest, MOST_DECODED - size + 1))
                size += len(out[-1])
                if size > MOST_DECODED:
                    raise ValueError("too large")
                if not part.eof:
                    raise EOFError("cut off")
                rest = part.unused_data.lstrip(b"\0")
            return b"".join(out)
        except zlib.error:
            if i + 1 == len(kinds):
                raise
    return body


def payload(headers: list[tuple[str, str]], body: bytes) -> bytes:
    found = {k.lower(): v.lower() for k, v in headers}
    try:
        if "chunked" in found.get("transfer-encoding", ""):
            body = dechunked(body)
        if "gzip" in found.get("content-encoding", ""):
            body = inflated(body, (31,))
        elif "deflate" in found.get("content-encoding", ""):
            body = inflated(body, (15, -15))
    except (ValueError, OSError, EOFError, zlib.error):
        pass
    return body


def decoded(body: bytes, kind: str) -> str:
    named = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        return body.decode(named[1] if named and CHARSETS.fullmatch(named[1]) else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return body.decode("utf-8", "replace")


def read_page(text: str) -> Page:
    """The page as far as the parser comes; what is left from there on is text."""
    page = Page()
    try:
        page.feed(text)
        page.close()
    except (AssertionError, ValueError):
        page.hidden, page.in_title = 0, False
        page.handle_data(page.unread(text))
    return page


def derivatives(record: dict) -> list[dict]:
    """The metadata and conversion records of one response."""
    block = record["block"] or b""
    status, headers, body = head_and_body(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "" if headers else "text/html")
    body_digest = record.get("payload_digest") or digest(body)
    text = decoded(payload(headers, body), kind)
    html, plain = "html" in kind.lower(), kind.lower().startswith("text/plain")
    page = read_page(text) if html else Page()
    source = {"refers_to": record["record_id"], "target_uri": record["target_uri"], "date": record["date"], "payload_digest": body_digest, "source_status": status, "source_type": kind or None, "source_headers": json.dumps(headers)}
    title = " ".join("".join(page.heading).split())
    fields = [("source-digest", body_digest), ("http-status", str(status or "")), ("title", title), ("lang", page.lang), *(("outlink", " ".join(x.split())) for x in page.links)]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {ENDS.sub(' ', v)}\r\n" for k, v in fields if v).encode("utf-8", "replace"))]
    if html or plain:
        made.append(("conversion", "text/plain", (page.text() if html else text).encode("utf-8", "replace")))
    # WARC ids are URIs in angle brackets
    own = lambda name: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record['record_id']}#{name}')}>"
    return [{"warc_type": name, "record_id": own(name), "content_type": t, "block_digest": digest(data), "block": data, **source} for name, t, data in made]


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


ARROW = pa.schema([(n, pa.int32() if n == "source_status" else pa.binary() if n == "block" else pa.string()) for n in NAMES])


def derived(responses: DataFrame, *keep: str) -> DataFrame:
    """Derivatives of response records; ``keep`` (long columns) go along."""
    schema = pa.schema([*((k, pa.int64()) for k in keep), *ARROW])
    wanted = [*keep, "record_id", "target_uri", "date", "payload_digest", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                rows = b.slice(at, 128).to_pylist()
                yield batch_of([d | {k: r[k] for k in keep} for r in rows for d in derivatives(r)], schema)

    return responses.select(*wanted).mapInArrow(run, ", ".join([*(f"{k} long" for k in keep), RECORD]))


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table (page_id, url, html), made of Column expressions."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    hashed = F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url")).cast("binary"))
    part = lambda a, n: F.substring(hashed, a, n)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("string").alias("payload_digest"),
        F.concat(head.cast("binary"), body).alias("block"),
    )


def as_bytes(r: dict) -> bytes:
    """One record as a gzip member, which can be joined to others."""
    block = r["block"] or b""
    named = [("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Refers-To", r["refers_to"]), ("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["date"]), ("Content-Type", r["content_type"]), ("WARC-Block-Digest", r["block_digest"] or digest(block)), ("WARC-Payload-Digest", r["block_digest"] or digest(block)), ("X-Source-Payload-Digest", r["payload_digest"]), ("X-Source-Status", r["source_status"]), ("X-Source-Type", r["source_type"]), ("X-Source-Headers", r["source_headers"])]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {ENDS.sub(' ', str(v))}\r\n" for k, v in named if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n", 6, mtime=0)


def serialized(records: DataFrame) -> DataFrame:
    """record_id and the bytes of each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                rows = b.slice(at, 128).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["record_id"] for r in rows], pa.string()), pa.array(map(as_bytes, rows), pa.binary())], ["record_id", "bytes"])

    return records.select(*NAMES).mapInArrow(run, "record_id string, bytes binary")


def records_in(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, one at a time. It ends at the first place that is not a record."""
    f = gzip.open(io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line.startswith(b"WARC/"):
            return
        found: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            found[k.strip().lower()] = v.strip()
        block = f.read(int(found.get("content-length") or 0))
        get = found.get
        yield {"warc_type": get("warc-type"), "record_id": get("warc-record-id"), "refers_to": get("warc-refers-to"), "target_uri": get("warc-target-uri"), "date": get("warc-date"), "content_type": get("content-type"), "block_digest": get("warc-block-digest"), "payload_digest": get("x-source-payload-digest"), "source_status": int(get("x-source-status")) if get("x-source-status") else None, "source_type": get("x-source-type"), "source_headers": get("x-source-headers"), "block": block}


def parsed(files: DataFrame, column: str = "content") -> DataFrame:
    """Records of whole WARC files, as spark.read.format("binaryFile") gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for r in records_in(data.as_py() or b""):
                    rows.append(r)
                    if len(rows) == 128:
                        yield batch_of(rows, ARROW)
                        rows = []
                if rows:
                    yield batch_of(rows, ARROW)

    return files.select(column).mapInArrow(run, RECORD)


def report(pages: DataFrame) -> DataFrame:
    """Both derivatives of every page, without the blocks themselves."""
    made = derived(responses_of(pages), "page_id")
    return made.select(
        "page_id", *[n for n in NAMES if n != "block"], F.octet_length("block").cast("long").alias("content_length"),
        F.sha2("block", 256).alias("block_sha256"),
    )
