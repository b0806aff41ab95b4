"""WARC derivatives: metadata and plain-text conversion records of response records.

Every response gives two records, in DataFrame functions. The ``metadata`` record holds JSON: the
title, the links, and the response's HTTP header; the ``conversion`` record holds the plain text.
Both name the response in ``WARC-Refers-To`` (with its URI and date), each other in
``WARC-Concurrent-To``, and carry the response's payload digest beside the digest of their own block.
Record ids follow from the response's id and the type, so a repeated run gives the same records.

Digests that are computed are ``sha256:`` and lowercase hex; one that the response names is kept as it is. Edge cases: a NULL payload is empty; a NULL URI or header is
empty in the records; repeated responses give repeated records; an empty table gives none; an
unclosed comment, script or style is left to the rule for tags; other columns of pages are not read.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is not text.
HIDDEN_ELEMENTS = ("script", "style", "noscript", "template")
#: Tags that end a line of text.
LINE_TAGS = (
    "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|"
    "li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul"
)
#: Character references that are decoded; ``&amp;`` comes last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®",
    "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&euro;": "€", "&amp;": "&",
}
CRLF = "\r\n"


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_text(html: Column) -> Column:
    """Lines of text, blanks run together, without empty lines."""
    hidden = f"(?is)<!--.*?-->|<({'|'.join(HIDDEN_ELEMENTS)})\\b[^>]*>.*?</\\1[ \\t\\r\\n]*>"
    text = F.regexp_replace(html, hidden, "")
    text = F.regexp_replace(text, f"(?i)</?({LINE_TAGS})\\b[^>]*>", "\n")
    text = decoded(F.regexp_replace(text, "</?[a-zA-Z!][^>]*>", ""))
    text = F.regexp_replace(text, "[ \\t\\r\\f]{2,}|[\\t\\r\\f]", " ")
    return F.trim(F.regexp_replace(text, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def title(html: Column) -> Column:
    found = F.regexp_extract(html, "(?is)<title\\b[^>]*>(.*?)</title", 1)
    return F.trim(F.regexp_replace(decoded(found), "[ \\t\\r\\n\\f]+", " "))


def links(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit("(?i)<a\\b[^>]*?\\bhref=\"([^\"]*)\""), F.lit(1))
    return F.transform(found, decoded)


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A URN whose UUID is the MD5 of the parts."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of crawled pages: ``page_id, record_id, target_uri, warc_date, http_header, payload``."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    header = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
    )
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(html.cast("binary"))).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        header.alias("http_header"),
        html.alias("payload"),
    )


def derivatives(responses: DataFrame, *keep: str) -> DataFrame:
    """Two records of each response, with the columns ``keep``.

    The source's digest is ``payload_digest``, if there and not NULL, else that of ``payload_bytes``, if there,
    else that of ``payload``. The source's own headers go on with ``keep``: ``derivatives(read, "fields")``."""
    own = set(responses.columns)
    named = [F.col("payload_digest")] if "payload_digest" in own else []
    whole = F.coalesce(F.col("payload_bytes"), F.lit(b"")) if "payload_bytes" in own else F.coalesce("payload", F.lit(""))
    payload, header = F.coalesce("payload", F.lit("")), F.coalesce("http_header", F.lit(""))
    metadata, conversion = (record_id(F.lit(kind), F.col("record_id")) for kind in ("metadata", "conversion"))
    source = responses.select(
        *keep,
        F.col("record_id").alias("refers_to"),
        F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        F.col("warc_date"),
        F.coalesce(*named, digest(whole)).alias("source_digest"),
        F.to_json(F.struct(title(payload).alias("title"), links(payload).alias("links"), header.alias("http_header"))).alias("json"),
        plain_text(payload).alias("plain"),
        metadata.alias("metadata_id"),
        conversion.alias("conversion_id"),
    )
    two = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.col("conversion_id").alias("concurrent_to"),
                 F.lit("application/json").alias("content_type"), F.col("json").alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.col("metadata_id").alias("concurrent_to"),
                 F.lit("text/plain").alias("content_type"), F.col("plain").alias("block")),
    )
    return source.select(*keep, "refers_to", "target_uri", "warc_date", "source_digest", F.inline(two)).withColumns(
        {"content_length": F.octet_length("block").cast("long"), "block_digest": digest(F.col("block"))}
    )


def _header(fields: dict[str, Column | str]) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in fields.items():
        column = F.col(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), column.cast("string")))
    return F.concat_ws(CRLF, *lines)


def derivative_records(records: DataFrame) -> DataFrame:
    """``record``: each derivative as it stands in a file, without the closing blank lines."""
    header = _header({
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "warc_date", "WARC-Target-URI": "target_uri",
        "WARC-Refers-To": "refers_to", "WARC-Refers-To-Target-URI": "target_uri", "WARC-Refers-To-Date": "warc_date",
        "WARC-Concurrent-To": "concurrent_to", "WARC-Payload-Digest": "source_digest", "WARC-Block-Digest": "block_digest",
        "Content-Type": "content_type", "Content-Length": "content_length",
    })
    return records.select(F.concat(header, F.lit(CRLF * 2), F.col("block")).alias("record"))


def response_records(responses: DataFrame) -> DataFrame:
    """``record``: each response as it stands in a file."""
    block = F.concat("http_header", F.lit(CRLF * 2), "payload")
    header = _header({
        "WARC-Type": F.lit("response"), "WARC-Record-ID": "record_id", "WARC-Date": "warc_date", "WARC-Target-URI": "target_uri",
        "WARC-Payload-Digest": digest(F.col("payload")), "WARC-Block-Digest": digest(block),
        "Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.octet_length(block),
    })
    return responses.select(F.concat(header, F.lit(CRLF * 2), block).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one for each partition."""
    records.select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def _parsed(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``fields`` (names in lower case) and ``block`` of every record; a file is read by one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                raw: BinaryIO = io.BytesIO(data)
                file = gzip.GzipFile(fileobj=raw) if data[:2] == b"\x1f\x8b" else raw
                for fields, block in _parsed(file):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["fields", "block"]
                    )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "fields map<string,string>, block binary")


def _decoded_block(block: bytes) -> tuple[str, str]:
    """HTTP header and payload as text: by the header's charset, else UTF-8; wrong bytes are replaced."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, body = b"", block
    named = re.search(rb"(?im)^content-type:[^\r\n]*?charset\s*=\s*[\"']?([\w.:-]+)", head)
    try:
        text = body.decode(named[1].decode("ascii", "replace") if named else "utf-8", "replace")
    except (LookupError, UnicodeError):
        text = body.decode("utf-8", "replace")
    return head.decode("utf-8", "replace"), text


def responses_of(records: DataFrame) -> DataFrame:
    """Response records that were read from files, as ``derivatives`` takes them.

    ``payload`` is decoded by the charset of the HTTP header, ``payload_bytes`` are its bytes, ``fields`` are the record's
    own WARC headers, and ``payload_digest`` is the one that the record names, NULL if none."""
    field = lambda name: F.get(F.map_values(F.map_filter("fields", lambda k, _: k == name)), F.lit(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [b or b"" for b in batch.column(5).to_pylist()]
            texts = [_decoded_block(b) for b in blocks]
            bodies = [b.partition(b"\r\n\r\n")[2] if b"\r\n\r\n" in b else b for b in blocks]
            columns = [*batch.columns[:3], pa.array([h for h, _ in texts], pa.string()), pa.array([t for _, t in texts], pa.string())]
            columns += [pa.array(bodies, pa.binary()), batch.column(3), batch.column(4)]
            names = ["record_id", "target_uri", "warc_date", "http_header", "payload", "payload_bytes", "payload_digest", "fields"]
            yield pa.RecordBatch.from_arrays(columns, names)

    chosen = records.filter(field("warc-type") == "response").select(
        field("warc-record-id").alias("record_id"), field("warc-target-uri").alias("target_uri"), field("warc-date").alias("warc_date"),
        field("warc-payload-digest").alias("payload_digest"), "fields", "block",
    )
    return chosen.mapInArrow(
        work,
        "record_id string, target_uri string, warc_date string, http_header string, payload string, payload_bytes binary, "
        "payload_digest string, fields map<string,string>",
    )
