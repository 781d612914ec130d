"""WARC derivatives: responses become linked metadata records and plain-text conversion records."""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.common import fresh, map_column

#: Used where a page has no date; a run must not stamp its own time, or reruns would differ.
NO_DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, a fixed value of RFC 4122

#: Elements whose content is not shown, elements that begin a line, and where the addresses of links stand.
HIDDEN = {"script", "style", "template", "noscript"}
BREAK = {
    "p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "header", "footer",
    "nav", "title", "head", "body", "html", "blockquote", "pre", "br", "hr",
}
LINKS = {"a", "area", "link", "img", "script", "iframe", "source", "form"}
ADDRESS = {"href", "src", "action"}
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)(\s*=\s*)?")
#: A tag without values, or with values in double quotes that hold neither < nor >: most tags, read at once.
USUAL = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z-]*=\"[^\"<>]*\")*)\s*/?>")
VALUES = re.compile(r"([a-zA-Z-]+)=\"([^\"]*)\"")
BARE = re.compile(r"[^\s>]*")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
SPACES = re.compile(r"[ \t\r\f\v ]+")
#: Codecs of Python that no page is written in.
NO_CHARSETS = {"idna", "punycode", "undefined", "unicode-escape", "raw-unicode-escape", "unicode_escape", "raw_unicode_escape", "utf-7", "mbcs", "oem"}
#: A compressed body that grows beyond this many bytes is an error of its record, so that a task's memory stays bounded.
MOST_INFLATED = 1 << 28


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.0 record; header values are kept on one line."""
    lines = ["WARC/1.0", *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(url: str | None, body: str | None, date: str = NO_DATE) -> bytes:
    """The response record of a page. Its id follows from address and content: equal pages, equal records."""
    payload = (body or "").encode("utf-8", "replace")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", digest(block))),
        ("WARC-Date", date), ("WARC-Target-URI", url or ""), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)),
    ]
    return record(headers, block)


def head(data: bytes, first: str) -> tuple[list[tuple[str, str]], int]:
    """Header lines that follow a first line beginning with `first`, and where the block begins."""
    end = data.find(b"\r\n\r\n")
    lines = data[: end if end >= 0 else 0].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith(first):
        raise ValueError(f"no {first} header")
    out: list[tuple[str, list[str]]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1][1].append(line.strip())
        else:
            name, _, value = line.partition(":")
            out.append((name.strip(), [value.strip()]))
    return [(name, " ".join(values)) for name, values in out], end + 4


def by_name(headers: list[tuple[str, str]]) -> dict:
    """All headers: the value of a name, or the list of its values in order where it stands more than once."""
    out: dict = {}
    for name, value in headers:
        out.setdefault(name, []).append(value)
    return {name: values[0] if len(values) == 1 else values for name, values in out.items()}


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body; what follows a chunk that is no chunk is left out."""
    parts, pos = [], 0
    while (end := body.find(b"\r\n", pos, pos + 1024)) >= 0:
        size = body[pos:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size) or not int(size, 16):
            break
        parts.append(body[end + 2 : end + 2 + int(size, 16)])
        pos = end + 4 + int(size, 16)
    return b"".join(parts)


def inflated(body: bytes, most: int) -> bytes:
    """A gzip or zlib body, as far as it goes; ValueError beyond `most` bytes or if it is neither."""
    for wbits in (47, -15):
        inflate = zlib.decompressobj(wbits)
        try:
            out = inflate.decompress(body, most)
        except zlib.error:
            continue
        if inflate.unconsumed_tail:
            raise ValueError("content inflates beyond the limit")
        return out
    raise ValueError("content is not compressed as stated")


def decoded_body(payload: bytes, http: list[tuple[str, str]], most: int = MOST_INFLATED) -> tuple[bytes, bytes]:
    """(payload without chunks, content): transfer and content encodings undone, in the order of their headers."""
    stated = {n: [x.strip().lower() for k, v in http if k.lower() == n for x in v.split(",")] for n in ("transfer-encoding", "content-encoding")}
    plain = dechunked(payload) if "chunked" in stated["transfer-encoding"] else payload
    content = plain
    for kind in reversed(stated["content-encoding"]):
        if kind in ("gzip", "x-gzip", "deflate"):
            content = inflated(content, most) if content else content
        elif kind not in ("", "identity"):
            raise ValueError(f"content encoding {kind}")
    return plain, content


def to_text(content: bytes, charset: str | None) -> str:
    """Decoded by the stated charset, or as UTF-8 if that is no charset of pages; nothing is an error."""
    try:
        if charset and codecs.lookup(charset).name not in NO_CHARSETS:
            return content.decode(charset, "replace")
    except (LookupError, UnicodeError, ValueError):
        pass
    return content.decode("utf-8", "replace")


class Page:
    """One pass over the markup of a page, in time that grows with its length: text, title and links.

    A tag ends at the first > outside quoted values. Where a quote is never closed, the tag ends at its first >. A tag
    that runs to the end of the page hides the rest; a < without any > after it is text.
    """

    def __init__(self, source: str):
        self.source, self.pieces, self.links, self.title = source, [], [], None
        self.never: set[str] = set()  # quotes that don't occur again
        self.opened: int | None = None  # where the text of an open title begins
        pos, size, last = 0, len(source), source.rfind(">")
        while pos < size:
            at = source.find("<", pos)
            self.pieces.append(source[pos : at if at >= 0 else size])
            if at < 0:
                break
            if usual := USUAL.match(source, at):
                tag, closes, address, pos = usual[2].lower(), bool(usual[1]), None, usual.end()
                if tag in LINKS and usual[3]:
                    address = next((v for k, v in VALUES.findall(usual[3]) if k.lower() in ADDRESS), None)
                pos = self.element(tag, closes, address, pos)
                continue
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                self.pieces.append(" ")
                pos = end + 3 if end >= 0 else size
                continue
            name = NAME.match(source, at)
            if at > last or not (name or source[at + 1 : at + 2] in ("!", "?")):
                self.pieces.append("<")
                pos = at + 1
                continue
            if not name:
                pos = source.index(">", at) + 1
                continue
            tag, closes = name[1].lower(), source[at + 1] == "/"
            pos, address = self.attributes(name.end())
            pos = self.element(tag, closes, address, pos)
        if self.title is None and self.opened is not None:
            self.title = "".join(self.pieces[self.opened : self.opened + 1])

    def element(self, tag: str, closes: bool, address: str | None, pos: int) -> int:
        """Take in a tag that ends at pos; where the text goes on after it."""
        if tag in LINKS and not closes and address is not None:
            self.links.append({"path": tag.upper(), "url": html.unescape(address)})
        if tag in BREAK:
            self.pieces.append("\n")
        if tag == "title":
            if closes and self.opened is not None and self.title is None:
                self.title = "".join(self.pieces[self.opened :])
            self.opened = None if closes else len(self.pieces)
        elif tag in HIDDEN and not closes:
            end = re.compile(rf"</{tag}\s*>", re.I).search(self.source, pos)
            self.pieces.append(" ")
            pos = end.end() if end else len(self.source)
        return pos

    def attributes(self, pos: int) -> tuple[int, str | None]:
        """Where the tag ends whose attributes begin at pos, and its first address."""
        source, size, begin, address = self.source, len(self.source), pos, None
        while pos < size:
            found = ATTRIBUTE.match(source, pos)
            pos = max(found.end(), pos)
            if not found[2]:
                if pos < size and source[pos] == ">":
                    return pos + 1, address
                pos += found.end() == found.start()
                continue
            quote = source[pos : pos + 1]
            if quote in ('"', "'") and quote:
                end = source.find(quote, pos + 1) if quote not in self.never else -1
                if end < 0:
                    self.never.add(quote)
                    return source.index(">", begin) + 1 if source.find(">", begin) >= 0 else size, address
                value, pos = source[pos + 1 : end], end + 1
            else:
                value = BARE.match(source, pos)[0]
                pos += len(value)
            if address is None and found[1].lower() in ADDRESS:
                address = value
        return size, address

    def text(self) -> str:
        """Visible text: a line for each block element, entities resolved, white space collapsed."""
        lines = (SPACES.sub(" ", x).strip() for x in html.unescape("".join(self.pieces)).split("\n"))
        return "\n".join(x for x in lines if x)


def plain_text(source: str) -> str:
    return Page(source).text()


def derive(data: bytes | None) -> dict:
    """Metadata and conversion record of one response record; `error` says why there are none.

    Both refer to the response by id and repeat its address and date. The metadata record holds all headers of
    the source, repeated ones as lists, the HTTP status and headers, title and links; the digests of the source are kept
    and compared with the content (digest_ok; that of the payload with its chunks or without). Text, title and links
    come from the body as its encodings and its charset say; an unknown content encoding is an error.
    """
    if not data:
        return {"error": "empty record"}
    try:
        warc, at = head(data, "WARC/")
        named = {k.lower(): v for k, v in warc}
        if named.get("warc-type") != "response":
            return {"error": "not a response"}
        size = int(named["content-length"])
        if size < 0:
            raise ValueError("negative length")
        block = data[at : at + size]
        if len(block) < size:
            return {"error": "truncated block"}
        http, body_at = head(block, "HTTP/")
        payload = block[body_at:]
        plain_payload, content = decoded_body(payload, http)
    except (ValueError, KeyError) as e:
        return {"error": str(e) or type(e).__name__}
    status = block.split(b"\r\n", 1)[0].decode("latin-1").split(" ")
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    found = CHARSET.search(kind.encode()) or CHARSET.search(content[:1024])
    page = Page(to_text(content, found[1].decode() if found else None))
    title, links, text = html.unescape(page.title or "").strip(), page.links, page.text()
    own, refers = named.get("warc-record-id", ""), [("WARC-Target-URI", named.get("warc-target-uri", "")), ("WARC-Date", named.get("warc-date", NO_DATE))]
    envelope = {
        "Envelope": {
            "Format": "WARC",
            "WARC-Header-Metadata": by_name(warc),
            "Payload-Metadata": {
                "Actual-Content-Type": "application/http; msgtype=response",
                "HTTP-Response-Metadata": {
                    "Response-Message": {"Status": status[1] if len(status) > 1 else "", "Version": status[0]},
                    "Headers": by_name(http),
                    "Entity-Length": len(payload),
                    "Entity-Digest": digest(payload),
                    "HTML-Metadata": {"Head": {"Title": title}, "Links": links},
                },
            },
        }
    }
    meta, plain = json.dumps(envelope, ensure_ascii=False).encode("utf-8", "replace"), text.encode("utf-8", "replace")
    out = {"error": None, "refers_to": own, "target_uri": refers[0][1], "title": title}
    for name, block_type, content in (("metadata", "application/json", meta), ("conversion", "text/plain", plain)):
        out[f"{name}_id"] = record_id(name, own)
        headers = [
            ("WARC-Type", name), ("WARC-Record-ID", out[f"{name}_id"]), ("WARC-Refers-To", own), *refers,
            ("Content-Type", block_type), ("WARC-Block-Digest", digest(content)),
        ]
        out[f"{name}_record"] = record(headers, content)
    stated = (named.get("warc-block-digest"), named.get("warc-payload-digest"))
    return out | {
        "source_block_digest": stated[0],
        "source_payload_digest": stated[1],
        "digest_ok": stated[0] in (None, digest(block)) and stated[1] in (None, digest(payload), digest(plain_payload)),
        "n_links": len(links),
        "text": text,
    }


FIELDS = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("error", "refers_to", "target_uri", "title", "metadata_id", "conversion_id", "source_block_digest", "source_payload_digest", "text")),
        T.StructField("digest_ok", T.BooleanType()),
        T.StructField("n_links", T.LongType()),
        T.StructField("metadata_record", T.BinaryType()),
        T.StructField("conversion_record", T.BinaryType()),
    ]
)
_KINDS = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}


def with_responses(pages: DataFrame, url: str = "url", body: str = "html", date: str = NO_DATE) -> DataFrame:
    """Add `record`, the response record of every page (null address or body: empty ones), and drop the body. Columns of
    any other name stay."""
    both = fresh(pages, "page")
    source = pages.withColumn(both, F.to_json(F.struct(F.col(url).alias("u"), F.col(body).alias("b"))))

    def make():
        def kernel(values):
            each = (json.loads(v) for v in values.to_pylist())
            return [pa.array([response(p.get("u"), p.get("b"), date) for p in each], pa.binary())]

        return kernel

    return map_column(source, both, make, [T.StructField("record", T.BinaryType())], drop=(both, body))


def derivatives(records: DataFrame, column: str = "record", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the metadata and conversion record of every response record, their ids and what they tell.

    A row whose record is null, empty, cut short or no response gets `error` and nulls: rows are never lost.
    Equal records get equal derivatives. Other columns stay, but for those named like a new one; an empty table gives an
    empty one. Time and memory grow with the length of a record.
    """

    def make():
        def kernel(values):
            rows = [derive(v.as_py()) for v in values]
            return [pa.array([r.get(f.name) for r in rows], _KINDS[f.dataType]) for f in FIELDS]

        return kernel

    return map_column(records, column, make, FIELDS.fields, drop)
