"""WARC derivatives: linked metadata and plain-text conversion records of response records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import sys
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESPONSE_SCHEMA = (
    "record_id string, target_uri string, date string, payload_digest string, block_digest string, "
    "http_status int, http_headers array<struct<name:string,value:string>>, payload binary"
)
DERIVED_SCHEMA = (
    "record_id string, record_type string, refers_to string, refers_to_target_uri string, refers_to_date string, "
    "date string, content_type string, block_digest string, content_length long, "
    "source_payload_digest string, source_digest_ok boolean, source_headers string, text string, record binary"
)
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
FIELDS_TYPE, TEXT_TYPE = "application/warc-fields", "text/plain"
# Elements that end a line of text, and those whose content is no text.
LINES = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section table td th title tr ul"
)
SILENT = "script style template noscript iframe object svg math title"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<silent>" + SILENT.replace(" ", "|")
    + r")(?=[\s/>]).*?(?:</(?P=silent)\s*>|\Z)|</?(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*>|<[A-Za-z!?/][^<>]*>",
    re.S | re.I,
)
BREAKS = frozenset(LINES.split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(*parts: str) -> str:
    """An id that follows from content: a rerun and a retried task name a record alike."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def plain_text(html: str) -> str:
    """Visible text, one line per block element; entities decoded, runs of blanks folded, empty lines dropped."""

    def instead(m: re.Match) -> str:
        if m["silent"]:
            return "\n"
        return "\n" if m["tag"] and m["tag"].lower() in BREAKS else ""

    flat = unescape(MARKUP.sub(instead, re.sub(r"[\t\r\f ]+", " ", html)))
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in flat.split("\n"))
    return "\n".join(x for x in lines if x)


def one_line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def serialized(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "\r\n".join([VERSION, *(f"{k}: {one_line(v)}" for k, v in headers if v is not None)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one serialized record."""
    head, rest = record.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def responses_of_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Response records of a table of saved pages, keyed by ``id_col``.

    The table has no transfer headers, so the type and length stand for them. A null
    page has a null payload.
    """
    html = F.encode(F.col(html_col), "UTF-8")
    name = F.md5(F.concat_ws("\x1f", F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(url_col, F.lit(""))))
    urn = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))

    def pair(header: str, value: Column) -> Column:
        return F.struct(F.lit(header).alias("name"), value.cast("string").alias("value"))

    return pages.select(
        F.col(id_col), urn.alias("record_id"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"),
        sha1_digest(html).alias("payload_digest"), F.lit(None).cast("string").alias("block_digest"), F.lit(200).alias("http_status"),
        F.array(pair("Content-Type", F.lit("text/html; charset=utf-8")), pair("Content-Length", F.octet_length(html))).alias("http_headers"),
        html.alias("payload"),
    )


def sha1_digest(data: Column) -> Column:
    """``digest`` as a Column: ten hex digits at a time make eight of base 32, then written in its letters."""
    hashed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hashed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    letters = F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(F.lit("sha1:"), letters)


def derive_records(responses: DataFrame, keep: list[str] | None = None, with_record: bool = True) -> DataFrame:
    """A metadata and a conversion record for every response record.

    ``responses`` has the columns of ``RESPONSE_SCHEMA``; those in ``keep`` are carried along.
    Both records refer to the response by id, target URI and date. The metadata record's
    block (warc-fields) preserves the response's digests, its status and each HTTP header under
    its own name with the prefix ``source-``, and says whether the payload still has the digest it
    was stored with. The conversion record's block is the plain text of an HTML payload, or
    a text payload itself; bytes that are no UTF-8 are replaced. Other and empty payloads give no
    conversion record, only metadata that say so. ``record`` is the whole record as bytes,
    of which files are made by concatenation (``gzip_member``); ids derive from the response's id
    and type of the record.

    A null payload counts as empty. A response without an id is named by its URI, date and
    digest. Repeated responses give repeated records of the same ids. A null header list is
    an empty one; line ends in headers become blanks. An empty table gives no rows. A
    column of ``keep`` that bears the name of a derived one comes out as ``kept_`` and its name.
    """
    keep = keep or []

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {f: [] for f in names}
            source: list[int] = []
            for at, row in enumerate(rows_of(batch)):
                for out in both_records(row, with_record):
                    source.append(at)
                    for f in names:
                        columns[f].append(out.get(f))
                if len(source) >= 500:
                    yield built(batch, source, columns)
                    columns, source = {f: [] for f in names}, []
            if source:
                yield built(batch, source, columns)

    def built(batch, source, columns):
        derived = [pa.array(columns[f], kinds[f]) for f in names]
        kept = [batch.column(i).take(pa.array(source)) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, *derived], names=[*shown, *names])

    fields = [x.strip().split(" ") for x in DERIVED_SCHEMA.split(",")]
    names = [n for n, _ in fields]
    kind_of = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    kinds = {n: kind_of[t] for n, t in fields}
    wanted = [n for n in (x.strip().split(" ")[0] for x in re.sub(r"<.*?>>", "", RESPONSE_SCHEMA).split(","))]
    shown = []
    for k in keep:
        while k in (*names, *shown):
            k = f"kept_{k}"
        shown.append(k)
    narrow = responses.select(*[F.col(k).alias(f"_kept_{i}") for i, k in enumerate(keep)], *wanted)
    head = "".join(f"`{s}` {responses.schema[k].dataType.simpleString()}, " for s, k in zip(shown, keep, strict=True))
    return narrow.mapInArrow(derive, head + DERIVED_SCHEMA)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def both_records(row: dict, with_record: bool) -> Iterator[dict]:
    payload = row["payload"] or b""
    uri, date = row["target_uri"] or "", row["date"] or ""
    stored = row["payload_digest"]
    name = row["record_id"] or record_name("response", uri, date, stored or digest(payload))
    headers = [(one_line(h["name"]), one_line(h["value"] or "")) for h in row["http_headers"] or [] if h and h["name"]]
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").lower()
    text = None
    if payload and ("html" in kind or not kind):
        text = plain_text(payload.decode("utf-8", "replace"))
    elif payload and kind.startswith("text/"):
        text = payload.decode("utf-8", "replace")
    actual = digest(payload)
    fine = None if stored is None else stored == actual
    about = [
        ("source-record-id", name), ("source-payload-digest", stored), ("source-block-digest", row["block_digest"]),
        ("source-payload-digest-computed", actual), ("source-payload-length", str(len(payload))),
        ("source-http-status", row["http_status"]), *((f"source-{k}", v) for k, v in headers),
        ("converted", "yes" if text is not None else "no"),
    ]
    fields = "".join(f"{k}: {one_line(v)}\r\n" for k, v in about if v is not None).encode()
    for record_type, content, block in (("metadata", FIELDS_TYPE, fields), ("conversion", TEXT_TYPE, None if text is None else text.encode())):
        if block is None:
            continue
        own = record_name(record_type, name)
        warc = [
            ("WARC-Type", record_type), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Refers-To", name), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date),
            ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block))),
        ]
        yield {
            "record_id": own, "record_type": record_type, "refers_to": name, "refers_to_target_uri": uri,
            "refers_to_date": date, "date": date, "content_type": content, "block_digest": digest(block),
            "content_length": len(block), "source_payload_digest": stored, "source_digest_ok": fine,
            "source_headers": json.dumps(headers, ensure_ascii=False),
            "text": text if record_type == "conversion" else fields.decode(),
            "record": serialized(warc, block) if with_record else None,
        }


def gzip_member(record: bytes) -> bytes:
    """One record as its own gzip member, as files of records are compressed; equal for equal records."""
    return gzip.compress(record, mtime=0)
