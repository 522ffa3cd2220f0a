"""WARC derivative builder: metadata and plain-text records linked to responses.

Records are rows of ``RECORD``: the named header fields, further fields as an
ordered array of (name, value), and the block's bytes. ``derive`` turns every
response into a ``metadata`` record (source headers, title, language, links) and
a ``conversion`` record (plain text). Both refer to the response by its id, keep
its target URI and date, and repeat its payload digest. Ids are derived from the
source's id and the record type, so that a second run makes the same records.

``to_bytes`` and ``parse`` write and read WARC/1.1; ``read_warc`` reads files,
gzip members included, by Spark's binary source.

Defined results: a null or empty page is a response with an empty payload; its
conversion has an empty block. A null URL is an empty target. A response block
without an HTTP header is all payload. Payloads are read in the charset of their
Content-Type, else as UTF-8, however long; a file is one task's, of 2 GB at most. Records of other types are left out.
Chunks and content codings (gzip, deflate) that the header names are undone before text is read; a payload that is not
coded as named, or in another way, is read as it is. Digests are always those of the stored bytes.
Repeated rows give repeated records with the same ids; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "record_id string, warc_type string, target_uri string, warc_date string, refers_to string, "
    "content_type string, block_digest string, payload_digest string, "
    "fields array<struct<name:string,value:string>>, block binary"
)
#: Header fields that have columns of their own, in the order they are written.
NAMED = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "warc_date": "WARC-Date",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "block_digest": "WARC-Block-Digest",
    "payload_digest": "WARC-Payload-Digest",
}
_FIELD = pa.struct([("name", pa.string()), ("value", pa.string())])
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "warc_type", "target_uri", "warc_date", "refers_to", "content_type", "block_digest", "payload_digest")]
    + [("fields", pa.list_(_FIELD)), ("block", pa.binary())]
)

#: A tag's attributes; ``>`` in a quoted value does not end the tag, a quote that is never closed is a character like others.
_ATTRIBUTES = r"""(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
#: Comments, elements whose content is no visible markup, tags, declarations. Each alternative runs to its end or the
#: page's, so that no character is tried again from an earlier start.
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|title)(?=[\s/>]){_ATTRIBUTES}>?(?P<inside>.*?)(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements that do not break a line.
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time u var wbr".split())
_LANG = re.compile(r"""(?<![\w-])lang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[ \t\r\n\f\v ]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name-based id that is the same for the same parts."""
    name = hashlib.sha1("\0".join(parts).encode("utf-8", "surrogatepass")).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"


def read_page(page: str, base: str = "") -> tuple[str, str, str, list[str]]:
    """(text, title, language, links) of a page, in one pass."""
    out, at, title, lang = [], 0, None, ""
    links: dict[str, None] = {}
    for m in _TAG.finditer(page):
        if at < m.start():
            out.append(page[at : m.start()])
        at = m.end()
        raw, inside, end, name, attributes = m.groups()
        if name:
            name = name.lower()
            if name not in _INLINE:
                out.append(None)
            if end:
                continue
            if name == "a" and (h := _HREF.search(attributes)):
                target = html.unescape(h[1] or h[2] or h[3] or "").strip()
                try:
                    links.setdefault(urljoin(base, target))
                except ValueError:
                    links.setdefault(target)
            elif name == "html" and not lang and (found := _LANG.search(attributes)):
                lang = found[1]
        elif raw and title is None and raw.lower() == "title":
            title = _SPACE.sub(" ", html.unescape(inside)).strip(" ")
    out.append(page[at:])
    joined = "".join("\n" if x is None else html.unescape(x).replace("\n", " ") for x in out)
    lines = (_SPACE.sub(" ", line).strip(" ") for line in joined.split("\n"))
    return "\n".join(line for line in lines if line), title or "", lang, list(links)


def plain_text(page: str) -> str:
    """Visible text: a line for each block element, spaces collapsed.

    A title is not part of it. Whatever else stands in a head is no text, and text there ends the head, written or not.
    """
    return read_page(page)[0]


def page_facts(page: str, base: str) -> tuple[str, str, list[str]]:
    """(title, language, absolute links without repeats) of a page; the first title and the first language that ``html`` names."""
    return read_page(page, base)[1:]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of a response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not gap:
        return "", [], block
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = [tuple(x.strip() for x in line.split(":", 1)) for line in lines[1:] if ":" in line]
    return lines[0], pairs, payload


_STEP = 1 << 14


def _inflated(data: bytes, window: int) -> bytes:
    """The content of all members; of a cut-off or broken one what can be read of it, and nothing after it."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        member = zlib.decompressobj(window)
        try:
            while not member.eof and at < len(view):
                part = view[at : at + _STEP]
                out.append(member.decompress(part))
                at += len(part) - len(member.unused_data)
        except zlib.error:
            break
        while at < len(view) and not (ahead := view[at : at + _STEP].tobytes().lstrip(b"\0")):
            at += _STEP
        if at >= len(view) or not member.eof or window != 31:
            break
        at += len(view[at : at + _STEP]) - len(ahead)
        if bytes(view[at : at + 2]) != b"\x1f\x8b":
            break
    return b"".join(out)


def unzipped(data: bytes) -> bytes:
    """The content of all gzip members, as far as they can be read."""
    return _inflated(data, 31) if data[:2] == b"\x1f\x8b" else b""


_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")


def unchunked(data: bytes) -> bytes:
    """The body that chunks carry, as far as it goes; bytes that do not start with a chunk are given back."""
    out, at = [], 0
    while size := _SIZE.match(data, at):
        n = int(size[1], 16)
        out.append(data[size.end() : size.end() + n])
        at = size.end() + n + 2
        if not n:
            break
    return b"".join(out) if out else data


def body(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without the transfer and content codings that its header names, last one first."""
    named = lambda header: [c.strip().lower() for name, value in headers if name.lower() == header for c in value.split(",")]
    for coding in reversed(named("content-encoding") + named("transfer-encoding")):
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = unzipped(payload) or payload
        elif coding == "deflate":
            payload = _inflated(payload, 15) or _inflated(payload, -15) or payload
    return payload


_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """The page's text in the charset that its Content-Type names, UTF-8 where it names none that is known."""
    named = next((m[1] for name, value in headers if name.lower() == "content-type" and (m := _CHARSET.search(value))), "utf-8")
    try:
        return payload.decode(named, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def _response(key: str, url: str, page: str, date: str) -> dict:
    payload = page.encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + payload
    return {
        "record_id": record_id("response", key, url, digest(payload)), "warc_type": "response", "target_uri": url, "warc_date": date,
        "refers_to": None, "content_type": "application/http; msgtype=response", "block_digest": digest(block),
        "payload_digest": digest(payload), "fields": [], "block": block,
    }


def derivatives(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    status, headers, payload = split_http(source["block"] or b"")
    page, target = decoded(body(payload, headers), headers), source["target_uri"] or ""
    shown, title, lang, links = read_page(page, target)
    facts = [("source-status", status)] if status else []
    facts += [(f"source-{name.lower()}", value) for name, value in headers]
    facts += [(f"source-{f['name'].lower()}", f["value"]) for f in source["fields"] or []]
    facts += [("title", title), ("language", lang), *(("outlink", x) for x in links)]
    one_line = lambda v: v.replace("\r", " ").replace("\n", " ")
    notes = "".join(f"{n}: {one_line(v)}\r\n" for n, v in facts).encode("utf-8", "surrogatepass")
    text = shown.encode("utf-8", "surrogatepass")
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", notes), ("conversion", "text/plain; charset=utf-8", text)):
        links_back = [("WARC-Source-Payload-Digest", source["payload_digest"] or digest(payload))]
        if source["block_digest"]:
            links_back.append(("WARC-Source-Block-Digest", source["block_digest"]))
        out.append(
            {
                "record_id": record_id(kind, source["record_id"] or ""), "warc_type": kind, "target_uri": target,
                "warc_date": source["warc_date"], "refers_to": source["record_id"], "content_type": content,
                "block_digest": digest(block), "payload_digest": None,
                "fields": [{"name": n, "value": v} for n, v in links_back], "block": block,
            }
        )
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``RECORD`` rows with the page's id in front: one response for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, urls, htmls = (c.to_pylist() for c in part.columns)
                made = [_response(str(k), u or "", h or "", date) for k, u, h in zip(keys, urls, htmls, strict=True)]
                yield _with_id(part.column(0), made)

    picked = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, {RECORD}").withColumnRenamed("_id", id_col)


def _with_id(ids: pa.Array, records: list[dict]) -> pa.RecordBatch:
    body = pa.RecordBatch.from_pylist(records, schema=_ARROW)
    return pa.RecordBatch.from_arrays([ids, *body.columns], names=["_id", *_ARROW.names])


def derive(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``RECORD`` rows: metadata and conversion records of all responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                made = [derivatives(r) for r in part.to_pylist()]
                ids = part.column(0).take(pa.array([k for k, m in enumerate(made) for _ in m], pa.int64()))
                yield _with_id(ids, [r for m in made for r in m])

    picked = records.filter("warc_type = 'response'").select(F.col(id_col).alias("_id"), *_ARROW.names)
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"_id {kind}, {RECORD}").withColumnRenamed("_id", id_col)


def to_bytes(record: dict) -> bytes:
    """One record in WARC/1.1."""
    block = record["block"] or b""
    head = [(label, record[column]) for column, label in NAMED.items() if record[column]]
    head += [(f["name"], f["value"]) for f in record["fields"] or []]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{n}: {v}\r\n" for n, v in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or of gzip members; a cut-off last record is left out."""
    if data[:2] == b"\x1f\x8b":
        data = unzipped(data)
    columns = {label.lower(): column for column, label in NAMED.items()}
    at = data.find(b"WARC/")
    while at >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0:
            return
        record: dict = dict.fromkeys(_ARROW.names) | {"fields": []}
        size = 0
        for line in data[at:head_end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip(), value.strip()
            if name.lower() == "content-length":
                size = int(value) if value.isdigit() else 0
            elif name.lower() in columns:
                record[columns[name.lower()]] = value
            elif name:
                record["fields"].append({"name": name, "value": value})
        start = head_end + 4
        if start + size > len(data):
            return
        record["block"] = data[start : start + size]
        yield record
        at = data.find(b"WARC/", start + size)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD`` rows with the file's path in front; one file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = list(parse(content or b""))
                for at in range(0, len(records), 256):
                    part = records[at : at + 256]
                    yield _with_id(pa.array([name] * len(part), pa.string()), part)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"_id string, {RECORD}").withColumnRenamed("_id", "path")


def warc_bytes(records: DataFrame) -> DataFrame:
    """(record_id, warc): every record serialised, ready for a binary sink."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_bytes(r) for r in rows], pa.binary())], names=["record_id", "warc"]
            )

    return records.select(*_ARROW.names).mapInArrow(run, "record_id string, warc binary")
